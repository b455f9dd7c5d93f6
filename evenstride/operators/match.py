"""Batch evaluation of a pattern: one shuffle, then narrow expansion inside each group.

Events are dealt into groups of (key, window-wide time bucket); each also goes to the bucket before, so every match lies whole in the
group of its first event's bucket, and a group holds the events of two windows whatever the length of the stream. In a group every
variable has its sorted array of candidates. Single events are bound first where all strategies are skip-till-any (the cheap anchors),
Kleene variables after them between their neighbours, by a fold over the candidates that prunes as it builds. Each constraint is a
filter at the first point where all its variables are bound, cheapest first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import micros
from ..functions.kleene import lookup
from ..plans.expr import TIMES, Constraint, Node, render
from ..plans.spec import Pattern, Var

#: Candidates from which the subsets of a Kleene variable are built in two halves.
HALVED = 10
#: Columns of the input.
EVENT_COLUMNS = ("event_id", "ts", "event_type", "value")


def _call(n: Node, array: str) -> str:
    fn = lookup(n.name)
    if fn.indexed and n.args[1] is None:
        raise ValueError(f"{n.name} needs an index, as in {n.name}({n.args[0]})[0]")
    return fn.build(array, n.args[1])


def at_time(which: str, array: str) -> str:
    """Time in seconds of a sequence's first (``time``, ``first_time``) or last element."""
    return f"cast(get({array}, {f'size({array}) - 1' if which == 'last_time' else 0}).us / 1e6 as double)"


def row_leaf(p: Pattern, arrays: dict[str, str] | None = None):
    """Renders references to variables that are bound in a row."""
    unions = dict(p.unions)

    def leaf(n: Node) -> str:
        name = n.args[0] if n.kind == "call" else n.name
        if name in unions:
            parts = ", ".join(f"`{m}`" if p.var(m).kleene else f"array(`{m}`)" for m in unions[name])
            arr = f"array_sort(concat({parts}))"
            return at_time(n.name, arr) if n.name in TIMES else _call(n, arr)
        v = p.var(name)
        if n.kind == "call" and n.name in TIMES:
            return at_time(n.name, f"`{name}`") if v.kleene else f"cast(`{name}`.us / 1e6 as double)"
        if n.kind == "call":
            arr = (arrays or {}).get(name) or (f"`{name}`" if v.kleene else f"array(`{name}`)")
            return _call(n, arr)
        if n.kind in ("elem", "prev"):
            raise ValueError(f"{n.name}[i] stands outside its sequence")
        return f"`{name}`.value" if not v.kleene else _call(Node("call", "last", (name, None)), f"`{name}`")

    return leaf


def cost_of(p: Pattern, c: Constraint, size: int = 8) -> float:
    return sum(lookup(n.name).cost(size) for n in c.nodes() if n.kind == "call" and n.name not in TIMES)


def derived_filters(p: Pattern, v: Var) -> list[str]:
    """Bounds on every element that bounds on min and max imply; sound only in that direction."""
    out = []
    for c in p.where:
        if c.scope != "match":
            continue
        for a, op, b in c.parts:
            if a.kind == "num" and b.kind == "call":
                a, b, op = b, a, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
            if a.kind == "call" and b.kind == "num" and a.args[0] == v.name:
                d = lookup(a.name).derives if a.name not in TIMES else None
                if d == "lower" and op in (">", ">=") or d == "upper" and op in ("<", "<="):
                    out.append(f"e.value {op} CAST({b.value!r} AS DOUBLE)")
    return out


def span_bound(p: Pattern, v: Var) -> int | None:
    """Microseconds that last_time - first_time of a sequence may span at most, where a constraint says so: it prunes while folding."""
    out = None
    for c in p.where:
        for a, op, b in c.parts:
            if b.kind == "bin" and a.kind == "num":
                a, b, op = b, a, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
            if b.kind == "num" and op in ("<", "<=", "=") and c.scope == "match" and a == Node("bin", "-", (Node("call", "last_time", (v.name, None)), Node("call", "first_time", (v.name, None)))):
                most = int(round(b.value * 1e6))
                out = most if out is None else min(out, most)
    return out


def _is_scan_filter(p: Pattern, c: Constraint) -> bool:
    """A test of single elements against numbers: it can go to the scan of its variable's candidates."""
    return len(c.variables) == 1 and not any(n.kind in ("call", "prev") for n in c.nodes()) and (bool(c.elements) or not p.var(next(iter(c.variables))).kleene)


class _Plan:
    def __init__(self, p: Pattern) -> None:
        self.p = p
        self.w = None if p.within is None else int(round(p.within * 1e6))
        self.scan = {v.name: [c for c in p.where if _is_scan_filter(p, c) and c.variables == {v.name}] for v in p.vars}
        self.left = [c for c in p.where if not _is_scan_filter(p, c)]
        self.any = all(v.strategy == "stam" for v in p.vars)
        self.strict = any(v.strategy == "strict" for v in p.vars)
        self.run_vars = {x for c in p.where if c.scope == "run" for x in p.needs(c)}

    def type_of(self, v: Var) -> str:
        if not v.types:
            return "true"
        names = ", ".join("'" + t.replace("'", "\\'") + "'" for t in v.types)
        return f"event_type {'NOT IN' if v.negated else 'IN'} ({names})"

    def candidates(self, events: DataFrame) -> DataFrame:
        """One row per group with an array of candidates for each variable."""
        p = self.p
        key = [F.col(p.key).alias("__key")] if p.key else [F.lit(0).alias("__key")]
        df = events.select(*key, "event_id", "ts", "event_type", F.col("value").cast("double").alias("value"), micros(events).alias("us"))
        if not self.strict and all(v.types and not v.negated for v in p.vars):
            df = df.where(F.col("event_type").isin(sorted({t for v in p.vars for t in v.types})))
        df = df.where("us is not null and event_id is not null")
        if self.w is None:
            df = df.withColumn("__b", F.lit(0).cast("long")).withColumn("own", F.lit(True))
        else:
            b = f"(us div {max(self.w, 1)} - if(us % {max(self.w, 1)} < 0, 1, 0))"
            df = df.withColumn("__at", F.explode(F.expr(f"array(named_struct('b', {b}, 'own', true), named_struct('b', {b} - 1, 'own', false))")))
            df = df.withColumn("__b", F.col("__at.b")).withColumn("own", F.col("__at.own")).drop("__at")
        pos = F.lit(0)
        if self.strict:
            from pyspark.sql import Window

            pos = F.row_number().over(Window.partitionBy("__key", "__b").orderBy("us", "event_id"))
        df = df.withColumn("pos", pos)
        el = F.struct("us", "event_id", "pos", "value", "ts")
        aggs, can = [], []
        for v in p.vars:
            tests = [self.type_of(v)] + [render(c, lambda n: "value") for c in self.scan[v.name]]
            if v is p.vars[0] and (not v.kleene):
                tests.append("own")
            cond = " AND ".join(f"coalesce({t}, false)" for t in tests)
            aggs.append(F.array_sort(F.collect_list(F.when(F.expr(cond), el))).alias(f"c_{v.name}"))
            if v.least > 0:
                can.append(f"size(c_{v.name}) >= {v.least}")
        out = df.groupBy("__key", "__b").agg(*aggs)
        return out.where(" AND ".join(can)) if can else out

    # bounds of what is bound so far
    def _edge(self, name: str, last: bool) -> str:
        v = self.p.var(name)
        e = f"`{name}`" if not v.kleene else (f"get(`{name}`, size(`{name}`) - 1)" if last else f"get(`{name}`, 0)")
        return f"if({e} is null, null, named_struct('us', {e}.us, 'event_id', {e}.event_id, 'pos', {e}.pos))"

    def _extreme(self, fn: str, parts: list[str]) -> str | None:
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else f"{fn}({', '.join(parts)})"

    def bind(self, df: DataFrame, v: Var, bound: list[str]) -> DataFrame:
        p, at = self.p, [x.name for x in self.p.vars].index(v.name)
        before = [x.name for x in p.vars[:at] if x.name in bound]
        after = [x.name for x in p.vars[at + 1 :] if x.name in bound]
        low = self._extreme("greatest", [self._edge(x, True) for x in before])
        high = self._extreme("least", [self._edge(x, False) for x in after])
        first = self._extreme("least", [self._edge(x, False) for x in before + after])
        last = self._extreme("greatest", [self._edge(x, True) for x in before + after])
        df = df.withColumn("__lim", F.expr(f"named_struct('low', {low or 'null'}, 'high', {high or 'null'}, 'first', {first or 'null'}, 'last', {last or 'null'})"))
        me = "named_struct('us', e.us, 'event_id', e.event_id, 'pos', e.pos)"
        tests = []
        if low:
            tests.append(f"(__lim.low is null or {me} > __lim.low)")
        if high:
            tests.append(f"(__lim.high is null or {me} < __lim.high)")
        if self.w is not None and first:
            tests.append(f"(__lim.first is null or e.us <= __lim.first.us + {self.w})")
            tests.append(f"(__lim.last is null or e.us >= __lim.last.us - {self.w})")
        if low and p.max_gap is not None and not v.kleene:
            tests.append(f"(__lim.low is null or e.us <= __lim.low.us + {int(p.max_gap * 1e6)})")
        if v.strategy == "strict" and low and not v.kleene:
            tests.append("(__lim.low is null or e.pos = __lim.low.pos + 1)")
        tests += derived_filters(p, v) if v.kleene else []
        leaf = row_leaf(p)
        for c in list(self.left):
            if c.scope == "match" and v.name in c.elements and not c.is_step and p.needs(c) - {v.name} <= set(bound):
                tests.append(render(c, lambda n: "e.value" if n.kind == "elem" else leaf(n)))
                self.left.remove(c)
        arr = f"filter(`c_{v.name}`, e -> {' AND '.join(tests)})" if tests else f"`c_{v.name}`"
        if not v.kleene:
            options = f"slice({arr}, 1, 1)" if v.strategy == "stnm" and before else arr
            return df.withColumn(v.name, F.expr(f"explode({options})")).drop("__lim")
        if v.name in self.run_vars:
            df = df.withColumn(f"run_{v.name}", F.expr(arr))
            arr = f"`run_{v.name}`"
        steps = [c for c in self.left if c.is_step and v.name in c.elements and p.needs(c) - {v.name} <= set(bound)]
        for c in steps:
            self.left.remove(c)
        if p.max_candidates is None and v.strategy == "stam" and not steps and not self.whole(v):
            # without a bound on the candidates: rows for the subsets of the first half, and of each its extensions, so that no array
            # holds more than 2^(n/2) sequences
            df = df.withColumn("__free", F.expr(arr)).withColumn("__half", F.expr(f"if(size(__free) < {HALVED}, 0, size(__free) div 2)"))
            df = df.withColumn("__head", F.expr(f"explode({self.sequences(v, '__free', steps, at, half='head')})"))
            return df.withColumn(v.name, F.expr(f"explode({self.sequences(v, '__free', steps, at, half='tail')})")).drop("__lim", "__free", "__half", "__head")
        return df.withColumn(v.name, F.expr(f"explode({self.sequences(v, arr, steps, at)})")).drop("__lim")

    def whole(self, v: Var) -> bool:
        """Whether the variable stays its whole run."""
        return not self.p.expand_unconstrained and v.strategy == "stam" and not any(v.name in self.p.needs(c) for c in self.p.where)

    def sequences(self, v: Var, arr: str, steps: list[Constraint], at: int, half: str | None = None) -> str:
        """All sequences of the candidates ``arr`` that the variable's strategy, size and step constraints allow. ``half``: only those of
        the first ``__half`` candidates whatever their size ('head'), or those that ``__head`` begins, with the rest ('tail')."""
        p, leaf = self.p, row_leaf(self.p)

        def step(prev: str, cur: str) -> str:
            def name(n: Node) -> str:
                if n.kind == "elem" and n.name == v.name:
                    return f"{cur}.value"
                if n.kind == "prev" and n.name == v.name or n.kind == "call" and n.name == "last" and n.args[0] == v.name:
                    return f"{prev}.value"
                return leaf(n)

            tests = [render(c, name) for c in steps]
            if v.strategy == "strict":
                tests.append(f"{cur}.pos = {prev}.pos + 1")
            if p.max_gap is not None:
                tests.append(f"{cur}.us <= {prev}.us + {int(p.max_gap * 1e6)}")
            return " AND ".join(tests) or "true"

        most = v.most if v.most is not None else 2147483647
        sized = lambda x: f"filter({x}, s -> size(s) >= {v.least} and size(s) <= {most})"
        steady = lambda x: f"filter({x}, s -> forall(zip_with(slice(s, 1, greatest(size(s) - 1, 0)), slice(s, 2, greatest(size(s) - 1, 0)), (p, q) -> {step('p', 'q')}), ok -> ok))"
        if v.strategy == "contiguous":
            runs = f"flatten(transform(sequence(1, greatest(size(f), 1)), i -> transform(sequence(least({max(v.least, 1)}, size(f) - i + 1), size(f) - i + 1), k -> slice(f, i, greatest(k, 0)))))"
            empty = "array(slice(f, 1, 0))" if v.least == 0 else "slice(array(f), 1, 0)"
            body = f"concat({empty}, filter({sized(runs)}, s -> size(s) > 0))"
            return steady(f"transform(array({arr}), f -> if(size(f) = 0, {empty}, {body}))[0]")
        if v.strategy == "stnm":
            cut = "f"
            if at + 1 < len(p.vars):
                nxt = p.vars[at + 1]
                stop = f"get(filter(`c_{nxt.name}`, n -> (n.us, n.event_id) > (get(f, {max(v.least, 1) - 1}).us, get(f, {max(v.least, 1) - 1}).event_id)), 0)"
                cut = f"transform(array({stop}), z -> filter(f, e -> z is null or (e.us, e.event_id) < (z.us, z.event_id)))[0]"
            return steady(sized(f"transform(array({arr}), f -> array(slice({cut}, 1, {most})))[0]"))
        if self.whole(v):
            return sized(f"array({arr})")
        start = "(__lim.low is null or e.pos = __lim.low.pos + 1)" if v.strategy == "strict" else "true"
        # a sequence within the window and, where it opens the match, begun in the group's own bucket: nothing is expanded to be thrown away
        span = span_bound(p, v)
        if self.w is not None:
            span = self.w if span is None else min(span, self.w)
            if at == 0:
                start += f" and (e.us div {max(self.w, 1)} - if(e.us % {max(self.w, 1)} < 0, 1, 0)) = __b"
        near = f" and (size(s) = 0 or e.us <= get(s, 0).us + {span})" if span is not None else ""
        grow = f"transform(filter(acc, s -> size(s) < {most}{near} and if(size(s) = 0, {start}, {step('get(s, size(s) - 1)', 'e')})), s -> concat(s, array(e)))"
        # a sequence that can't reach its least size any more goes at once
        alive = f"filter(acc, s -> size(s) + size(f) - i + 1 >= {v.least})" if v.least > 1 else "acc"
        low, high, begun = {None: ("1", "size(f)", "slice(f, 1, 0)"), "head": ("1", "__half", "slice(f, 1, 0)"), "tail": ("__half + 1", "size(f)", "__head")}[half]
        fold = f"if({high} < {low}, array({begun}), aggregate(sequence({low}, {high}), array({begun}), (old, i) -> transform(array({alive.replace('acc', 'old', 1)}), acc -> transform(array(get(f, i - 1)), e -> concat(acc, {grow}))[0])[0]))"
        if half == "head":
            return f"transform(array({arr}), f -> {fold})[0]"
        if v.strategy == "stam" and not steps and p.max_candidates is not None:
            guard = f"raise_error(concat('{v.name}: ', size(f), ' candidates; max_candidates is {p.max_candidates}'))"
            fold = f"if(size(f) > {p.max_candidates}, {guard}, {fold})"
        return sized(f"transform(array({arr}), f -> {fold})[0]")

    def apply(self, df: DataFrame, bound: list[str]) -> DataFrame:
        ready = [c for c in self.left if self.p.needs(c) <= set(bound) and not c.elements]
        for c in sorted(ready, key=lambda c: cost_of(self.p, c)):
            arrays = {x: f"`run_{x}`" for x in c.variables if self.p.var(x).kleene} if c.scope == "run" else None
            df = df.where(F.expr(f"coalesce({render(c, row_leaf(self.p, arrays))}, false)"))
            self.left.remove(c)
        return df

    def run(self, events: DataFrame) -> DataFrame:
        p = self.p
        order = [v for v in p.vars if not v.kleene] + [v for v in p.vars if v.kleene] if self.any else list(p.vars)
        df, bound = self.candidates(events), []
        for v in order:
            df = self.bind(df, v, bound)
            bound.append(v.name)
            df = self.apply(df, bound)
        if self.left:
            raise ValueError(f"cannot place constraint {self.left[0].text!r}")
        first = self._extreme("least", [self._edge(v.name, False) for v in p.vars])
        last = self._extreme("greatest", [self._edge(v.name, True) for v in p.vars])
        df = df.withColumn("__f", F.expr(first)).withColumn("__l", F.expr(last)).where("__f is not null")
        if self.w is not None:
            b = f"(__f.us div {max(self.w, 1)} - if(__f.us % {max(self.w, 1)} < 0, 1, 0))"
            df = df.where(f"__l.us - __f.us <= {self.w} and {b} = __b")
        return df


def match(events: DataFrame, p: Pattern) -> DataFrame:
    """Matches as rows: the key (if any), for each single variable ``<name>_id``, for each Kleene variable ``<name>_ids`` (comma-joined
    event ids), and ``first_us``/``last_us`` (microseconds). ``events`` has event_id, ts, event_type, value and the key column.

    Ties in ts are ordered by event_id; events with null ts or id are left out, a null value fails every test of it. An empty
    stream gives no rows. A Kleene variable with more than ``max_candidates`` candidates and no step constraint raises, never drops; with
    ``max_candidates`` None none raises, and all subsets are built however many the candidates.
    """
    df = _Plan(p).run(events)
    cols = [F.col("__key").alias(p.key)] if p.key else []
    for v in p.vars:
        n = v.name
        cols.append(F.expr(f"array_join(transform(`{n}`, x -> cast(x.event_id as string)), ',')").alias(f"{n.lower()}_ids") if v.kleene else F.col(f"{n}.event_id").alias(f"{n.lower()}_id"))
    for name, members in p.unions:
        arrays = ", ".join(f"`{m}`" if p.var(m).kleene else f"array(`{m}`)" for m in members)
        cols.append(F.expr(f"array_join(transform(array_sort(concat({arrays})), x -> cast(x.event_id as string)), ',')").alias(f"{name.lower()}_ids"))
    return df.select(*cols, F.col("__f.us").alias("first_us"), F.col("__l.us").alias("last_us"))


def match_structs(events: DataFrame, p: Pattern) -> DataFrame:
    """Matches with each variable as a struct (single) or array of structs (Kleene), for further DataFrame work."""
    return _Plan(p).run(events).select(*([F.col("__key").alias(p.key)] if p.key else []), *[v.name for v in p.vars])


def count_matches(events: DataFrame, p: Pattern) -> DataFrame:
    """Number of matches per key without building them, for patterns of single events and one unconstrained Kleene variable under
    skip-till-any: n candidates make 2^n subsets less those too small."""
    kleene = [v for v in p.vars if v.kleene]
    plan = _Plan(p)
    if len(kleene) != 1 or not plan.any or kleene[0].most is not None or any(kleene[0].name in p.needs(c) for c in plan.left) or len(p.vars) < 2:
        raise ValueError("counting needs one Kleene variable without constraints beyond single elements, and a single variable")
    k = kleene[0]
    df, bound = plan.candidates(events), []
    for v in p.vars:
        if not v.kleene:
            df = plan.apply(plan.bind(df, v, bound), bound + [v.name])
            bound.append(v.name)
    at = [x.name for x in p.vars].index(k.name)
    singles_f = plan._extreme("least", [plan._edge(x, False) for x in bound])
    singles_l = plan._extreme("greatest", [plan._edge(x, True) for x in bound])
    lows = plan._extreme("greatest", [plan._edge(x.name, True) for x in p.vars[:at]])
    highs = plan._extreme("least", [plan._edge(x.name, False) for x in p.vars[at + 1 :]])
    me = "named_struct('us', e.us, 'event_id', e.event_id, 'pos', e.pos)"
    tests = [f"{me} > {lows}"] if lows else []
    tests += [f"{me} < {highs}"] if highs else []
    if plan.w is not None:
        tests += [f"e.us <= ({singles_f}).us + {plan.w}", f"e.us >= ({singles_l}).us - {plan.w}"]
    df = df.withColumn("__n", F.expr(f"filter(`c_{k.name}`, e -> {' AND '.join(tests)})"))
    if plan.w is not None and at == 0:  # the first event decides the group: only subsets that start in this bucket count
        own = f"(e.us div {plan.w} - if(e.us % {plan.w} < 0, 1, 0)) = __b"
        df = df.withColumn("__own", F.expr(f"size(filter(__n, e -> {own}))")).withColumn("__m", F.expr("size(__n)"))
        total = _subsets("__m", k.least) + " - " + _subsets("(__m - __own)", k.least)
    else:
        df = df.withColumn("__m", F.expr("size(__n)"))
        total = _subsets("__m", k.least)
        if plan.w is not None:
            df = df.where(f"({singles_l}).us - ({singles_f}).us <= {plan.w}")
    out = df.select("__key", F.expr(f"cast({total} as decimal(38,0))").alias("n"))
    key = F.col("__key").alias(p.key) if p.key else F.lit(0).alias("all")
    return out.groupBy(key).agg(F.sum("n").cast("long").alias("matches")).where("matches > 0")


def _subsets(n: str, least: int) -> str:
    """Subsets of n elements with at least ``least``."""
    small = " - ".join(f"aggregate(sequence(1, greatest({k}, 1)), 1D, (c, i) -> if(i > {k}, c, c * ({n} - {k} + i) / i)) * if({n} >= {k}, 1, 0)" for k in range(least))
    return f"(power(2D, {n})" + (f" - {small})" if small else ")")


def timeouts(events: DataFrame, p: Pattern) -> DataFrame:
    """First events that no match completed within the window: ``(key, <first>_id, timeout_us)``; the first variable must be single."""
    v = p.vars[0]
    if v.kleene or p.within is None:
        raise ValueError("timeouts need a single first variable and a window")
    opened = starts(events, p)
    done = match(events, p).select(F.col(f"{v.name.lower()}_id").alias("__id")).distinct()
    out = opened.join(done, opened["event_id"] == done["__id"], "left_anti")
    return out.select(*([F.col("__key").alias(p.key)] if p.key else []), F.col("event_id").alias(f"{v.name.lower()}_id"), (F.col("us") + int(round(p.within * 1e6))).alias("timeout_us"))


def starts(events: DataFrame, p: Pattern) -> DataFrame:
    """Events that the first variable (a single one) takes, by its own tests: ``(__key, event_id, us)``."""
    plan, v = _Plan(p), p.vars[0]
    key = F.col(p.key) if p.key else F.lit(0)
    tests = [plan.type_of(v)] + [render(c, lambda n: "value") for c in plan.scan[v.name]]
    return events.where(" AND ".join(tests)).select(key.alias("__key"), "event_id", micros(events).alias("us"))
