"""The same pattern as portable SQL, evaluated another way: a chain of self-joins with recursive CTEs for Kleene variables."""

from __future__ import annotations

from ..functions.kleene import ALIASES
from .expr import TIMES, Constraint, Node, render
from .spec import Pattern, Var


def list_function(name: str, v: str, t: str, k: int | None = None) -> str:
    """Kleene functions over a list of values ``v`` and of timestamps ``t``."""
    n = f"len({v})"
    return {
        "first": f"{v}[1]",
        "last": f"{v}[len({v})]",
        "permutations": f"{v}[1]",
        "nth": f"{v}[{(k or 0) + 1}]",
        "count": n,
        "size": n,
        "sum": f"coalesce(list_sum({v}), 0)",
        "average": f"coalesce(list_avg({v}), 0)",
        "min": f"list_min({v})",
        "max": f"list_max({v})",
        "least_squares": f"coalesce((SELECT CASE WHEN count(DISTINCT x) > 1 THEN regr_slope(y, x) ELSE 0 END FROM (SELECT unnest({v}) AS y, unnest(list_transform({t}, lambda z: datediff('day', DATE '2000-01-01', CAST(z AS DATE)))) AS x)), 0)",
        "increasing": f"CASE WHEN {n} > 1 AND {v} = list_sort({v}) AND len(list_distinct({v})) = {n} THEN 1 ELSE -1 END",
        "decreasing": f"CASE WHEN {n} > 1 AND {v} = list_reverse_sort({v}) AND len(list_distinct({v})) = {n} THEN 1 ELSE -1 END",
        "non_increasing": f"CASE WHEN {n} > 1 AND {v} = list_reverse_sort({v}) THEN 1 ELSE -1 END",
        "non_decreasing": f"CASE WHEN {n} > 1 AND {v} = list_sort({v}) THEN 1 ELSE -1 END",
        "standard_deviation": f"CASE WHEN {n} <= 1 THEN -1000 WHEN list_sum({v}) = 0 THEN 0 ELSE 100 * list_stddev_samp({v}) / list_avg({v}) END",
        "sum_square_difference": f"CASE WHEN {n} <= 1 THEN -1 ELSE 2.0 * {n} / ({n} - 1) * list_var_pop({v}) - 4 * list_var_pop({v}) * list_var_pop({v}) END",
        "merge_sort": f"list_sort({v})[{(k or 0) + 1}]",
        "bubble_sort": f"coalesce(list_sort({v})[{(k or 0) + 1}], -1)",
        "mann_kendall_test": f"(SELECT coalesce(sum(sign(b.y - a.y)), 0) FROM (SELECT unnest({v}) AS y, unnest(range(len({v}))) AS i) a JOIN (SELECT unnest({v}) AS y, unnest(range(len({v}))) AS i) b ON a.i < b.i)",
        "linear_regression_r2": f"coalesce((SELECT CASE WHEN count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN power(corr(y, x), 2) ELSE 0 END FROM (SELECT unnest({v}) AS y, unnest(list_transform({t}, lambda z: datediff('day', DATE '2000-01-01', CAST(z AS DATE)))) AS x)), 0)",
        "triplet_sum": f"power(coalesce(list_sum({v}), 0), 3)",
    }[ALIASES.get(name, name)]


def oracle(p: Pattern, source: str = "events", cols: dict[str, str] | None = None) -> str:
    """DuckDB SQL for ``match`` (without its first_us and last_us): columns as there."""
    c = {"id": "event_id", "ts": "ts", "type": "event_type", "value": "value"} | (cols or {})
    key = p.key or "0"
    ctes = [f"ev AS (SELECT {c['id']} AS id, {c['ts']} AS ts, {key} AS k, {c['type']} AS typ, CAST({c['value']} AS DOUBLE) AS v, row_number() OVER (PARTITION BY {key} ORDER BY {c['ts']}, {c['id']}) AS rn FROM {source})"]
    ctes.append("s0 AS (SELECT DISTINCT k, CAST(NULL AS TIMESTAMP) AS w0_f_ts, CAST(NULL AS TIMESTAMP) AS w0_l_ts, CAST(NULL AS BIGINT) AS w0_l_id, CAST(NULL AS BIGINT) AS w0_l_rn FROM ev)")
    left, prev, bound, unions = [x for x in p.where], "s0", [], dict(p.unions)

    def leaf(alias: str):
        def go(n: Node) -> str:
            name = n.args[0] if n.kind == "call" else n.name
            if name in unions:
                part = lambda m: f"list_transform(range(1, len({alias}.{m}_ids) + 1), lambda j: {{'t': {alias}.{m}_ts[j], 'i': {alias}.{m}_ids[j], 'v': {alias}.{m}_vs[j]}})" if p.var(m).kleene else f"[{{'t': {alias}.{m}_t, 'i': {alias}.{m}_id, 'v': {alias}.{m}_v}}]"
                every = f"list_sort(flatten([{', '.join(part(m) for m in unions[name])}]))"
                ts, vs = f"list_transform({every}, lambda z: z.t)", f"list_transform({every}, lambda z: z.v)"
                return f"(epoch_us(({ts})[{f'len({ts})' if n.name == 'last_time' else 1}]) / 1e6)" if n.name in TIMES else list_function(n.name, f"({vs})", f"({ts})", n.args[1])
            v = p.var(name)
            if n.kind == "call" and n.name in TIMES:
                at = (f"s[len({alias}.{name}_ts)]" if n.name == "last_time" else "s[1]") if v.kleene else ""
                return f"(epoch_us({alias}.{name}_t{at}) / 1e6)"
            if n.kind == "call":
                return list_function(n.name, f"{alias}.{name}_vs" if v.kleene else f"[{alias}.{name}_v]", f"{alias}.{name}_ts" if v.kleene else f"[{alias}.{name}_t]", n.args[1])
            return f"{alias}.{name}_v" if not v.kleene else f"{alias}.{name}_vs[len({alias}.{name}_vs)]"

        return go

    def types(v: Var) -> str:
        if not v.types:
            return "TRUE"
        return f"e.typ {'NOT IN' if v.negated else 'IN'} ({', '.join(repr(t) for t in v.types)})"

    def element_tests(v: Var, alias: str) -> tuple[list[str], list[Constraint]]:
        """Tests on the current element e; step tests apart."""
        tests, steps = [], []
        for x in list(left):
            if v.kleene and v.name in x.elements and p.needs(x) - {v.name} <= set(bound):
                left.remove(x)
                if x.is_step:
                    steps.append(x)
                else:
                    tests.append(render(x, lambda n: "e.v" if n.kind == "elem" else leaf(alias)(n)))
            elif not v.kleene and x.variables == {v.name} and not any(n.kind == "call" for n in x.nodes()):
                left.remove(x)
                tests.append(render(x, lambda n: "e.v"))
        return tests, steps

    for i, v in enumerate(p.vars, 1):
        n = v.name
        window = [f"(p.w0_f_ts IS NULL OR epoch_us(e.ts) - epoch_us(p.w0_f_ts) <= {int(round(p.within * 1e6))})"] if p.within is not None else []
        after = "(p.w0_l_ts IS NULL OR (e.ts, e.id) > (p.w0_l_ts, p.w0_l_id))"
        gap = [f"(p.w0_l_ts IS NULL OR epoch_us(e.ts) - epoch_us(p.w0_l_ts) <= {int(round(p.max_gap * 1e6))})"] if p.max_gap is not None else []
        strict = ["(p.w0_l_rn IS NULL OR e.rn = p.w0_l_rn + 1)"] if v.strategy == "strict" else []
        tests, steps = element_tests(v, "p")
        on = " AND ".join(["e.k = p.k", after, types(v), *tests, *window, *gap, *strict])
        move = "coalesce(p.w0_f_ts, e.ts) AS w0_f_ts, e.ts AS w0_l_ts, e.id AS w0_l_id, e.rn AS w0_l_rn"
        if not v.kleene:
            ctes.append(f"s{i} AS (SELECT p.* EXCLUDE (w0_f_ts, w0_l_ts, w0_l_id, w0_l_rn), {move}, e.id AS {n}_id, e.v AS {n}_v, e.ts AS {n}_t FROM {prev} p JOIN ev e ON {on})")
            if v.strategy == "stnm":
                olds = ", ".join(f"{x.name}_ids" if x.kleene else f"{x.name}_id" for x in p.vars[: i - 1])
                if olds:
                    ctes[-1] = f"s{i}all AS" + ctes[-1].removeprefix(f"s{i} AS")
                    ctes.append(f"s{i} AS (SELECT * FROM s{i}all QUALIFY row_number() OVER (PARTITION BY k, {olds} ORDER BY w0_l_ts, w0_l_id) = 1)")
        else:
            empty = f"CAST([] AS BIGINT[]) AS {n}_ids, CAST([] AS DOUBLE[]) AS {n}_vs, CAST([] AS TIMESTAMP[]) AS {n}_ts"
            grow = f"list_append(p.{n}_ids, e.id), list_append(p.{n}_vs, e.v), list_append(p.{n}_ts, e.ts)"
            st = [f"(len(p.{n}_vs) = 0 OR {render(x, lambda m: 'e.v' if m.kind == 'elem' else f'p.{n}_vs[len(p.{n}_vs)]' if m.kind == 'prev' or m.kind == 'call' and m.args[0] == n else leaf('p')(m))})" for x in steps]
            if v.most is not None:
                st.append(f"len(p.{n}_ids) < {v.most}")
            if v.strategy == "contiguous":
                st.append(f"(len(p.{n}_ids) = 0 OR NOT EXISTS (SELECT 1 FROM ev x WHERE x.k = p.k AND {types(v).replace('e.', 'x.')} AND (x.ts, x.id) > (p.w0_l_ts, p.w0_l_id) AND (x.ts, x.id) < (e.ts, e.id)))")
            ctes.append(
                f"k{i} AS (SELECT p.* EXCLUDE (w0_f_ts, w0_l_ts, w0_l_id, w0_l_rn), p.w0_f_ts, p.w0_l_ts, p.w0_l_id, p.w0_l_rn, {empty} FROM {prev} p UNION ALL "
                f"SELECT p.* EXCLUDE (w0_f_ts, w0_l_ts, w0_l_id, w0_l_rn, {n}_ids, {n}_vs, {n}_ts), {move}, {grow} FROM k{i} p JOIN ev e ON {' AND '.join([on, *st])})"
            )
            size = [f"len({n}_ids) >= {v.least}"]
            ctes.append(f"s{i} AS (SELECT * FROM k{i} WHERE {' AND '.join(size)})")
        bound.append(n)
        ready = [x for x in left if p.needs(x) <= set(bound) and not x.elements]
        for x in ready:
            left.remove(x)
        if ready:
            ctes.append(f"t{i} AS (SELECT p.* FROM s{i} p WHERE {' AND '.join(render(x, leaf('p')) for x in ready)})")
            prev = f"t{i}"
        else:
            prev = f"s{i}"
    cols_out = [f"k AS {p.key}"] if p.key else []
    for v in p.vars:
        cols_out.append(f"array_to_string({v.name}_ids, ',') AS {v.name.lower()}_ids" if v.kleene else f"{v.name}_id AS {v.name.lower()}_id")
    for name, members in p.unions:
        lists = ", ".join(f"{m}_ids" if p.var(m).kleene else f"[{m}_id]" for m in members)
        cols_out.append(f"array_to_string(list_sort(flatten([{lists}])), ',') AS {name.lower()}_ids")
    if left:
        raise ValueError(f"cannot place {left[0].text!r}")
    whole = ""
    if not p.expand_unconstrained:
        free = [v for v in p.vars if v.kleene and v.strategy == "stam" and not any(v.name in p.needs(c) for c in p.where)]
        others = lambda f: ", ".join(["k"] + [f"{v.name}_ids" if v.kleene else f"{v.name}_id" for v in p.vars if v is not f])
        if free:
            whole = " QUALIFY " + " AND ".join(f"len({f.name}_ids) = max(len({f.name}_ids)) OVER (PARTITION BY {others(f)})" for f in free)
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT {', '.join(cols_out)} FROM {prev} WHERE w0_f_ts IS NOT NULL{whole}"
