"""Streaming evaluation of a pattern: a stateful processor per key that shares the batch semantics.

Events are buffered until the watermark has passed them, then handled in the order of (ts, event_id); an event that arrives later than
the watermark is dropped, which is the only difference from a batch run over the same rows. State per key is the waiting events, the
open partial matches and the starts that no match has completed yet, each a row of its own; all of them expire with the window. A key
has one timer for each batch of its rows and one for each start that may time out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import micros
from ..functions.kleene import ALIASES
from ..plans.expr import TIMES, Constraint, Node
from ..plans.spec import Pattern, Var

OUTPUT = "key string, status string, first_us long, last_us long, ids string"
_OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b}


def sequence_function(name: str, values: list[float], index: int | None, days: list[int] | None = None) -> float | None:
    """Kleene functions over a plain list (``days``: the day of each value), for events that arrive one by one."""
    import itertools
    import math
    import statistics

    n, name = len(values), ALIASES.get(name, name)
    up = lambda ok: 1.0 if n > 1 and all(ok(a, b) for a, b in zip(values, values[1:])) else -1.0
    if name == "count":
        return float(n)
    if name in ("average", "sum"):
        return float(sum(values)) / (n if name != "sum" and n else 1)
    if name == "triplet_sum":
        return float(sum(values)) ** 3
    if name in ("increasing", "decreasing", "non_increasing", "non_decreasing"):
        return up({"increasing": lambda a, b: a < b, "decreasing": lambda a, b: a > b, "non_increasing": lambda a, b: a >= b, "non_decreasing": lambda a, b: a <= b}[name])
    if name == "mann_kendall_test":
        return float(sum((b > a) - (b < a) for a, b in itertools.combinations(values, 2)))
    if name == "bubble_sort":
        return sorted(values)[index] if index is not None and index < n else -1.0
    if name == "subset_sum":
        sums = [sum(c) for k in range(n + 1) for c in itertools.combinations(values, k)]
        return float(sums[len(sums) // 2]) if n else 0.0
    if name == "combinations_square":
        return math.comb(n, index) / n * sum(x * x for x in values) if n and index is not None and index <= n else 0.0
    if name == "least_squares":
        mx = my = c = d = 0.0
        for k, (a, b) in enumerate(((a - 10957 if days else a, b) for a, b in zip(days or range(n), values) if b is not None), 1):
            u, my = a - mx, my + (b - my) / k
            mx, c = mx + u / k, math.fma(u, b - my, c)
            d += (a - mx) * u
        return (c / k) / (d / k) if d else 0.0
    if name == "linear_regression_r2":
        x = [d - days[0] for d in days] if days else list(range(n))
        sx, sy, sxx, sxy, syy = sum(x), sum(values), sum(a * a for a in x), sum(a * b for a, b in zip(x, values)), sum(b * b for b in values)
        top, low = n * sxy - sx * sy, n * sxx - sx * sx
        return top * top / (low * (n * syy - sy * sy)) if low and n * syy - sy * sy else 0.0
    if not n:
        return None
    if name == "standard_deviation":
        mean = sum(values) / n
        return -1000.0 if n == 1 else 0.0 if mean == 0 else 100 * statistics.stdev(values) / mean
    if name == "sum_square_difference":
        v = statistics.pvariance(values)
        return -1.0 if n == 1 else 2 * n / (n - 1) * v - 4 * v * v
    if name in ("merge_sort", "nth"):
        xs = sorted(values) if name == "merge_sort" else values
        return xs[index] if index is not None and index < n else None
    simple = {"first": values[0], "last": values[-1], "min": min(values), "max": max(values), "permutations": values[0]}
    if name not in simple:
        raise ValueError(f"{name} is not available on streams")
    return simple[name]


class Evaluator:
    """Grows partial matches event by event.

    A partial is (index of the current variable, sequences of (us, id, value) by variable, whether it may still go on to the next
    variable, number of its last event in the key's stream). Strategies: skip-till-any; for single variables also next match (the first
    event that the variable itself can take is the only one); strict (the event right after the last one) for all.
    """

    def __init__(self, p: Pattern) -> None:
        if p.within is None:
            raise ValueError("a stream needs a window: without it no partial match ever expires")
        for v in p.vars:
            if v.strategy == "contiguous" or v.strategy == "stnm" and v.kleene:
                raise ValueError(f"{v.name}: streams don't support {v.strategy} for it")
        if p.max_gap is not None or not p.expand_unconstrained:
            raise ValueError("streams support neither max_gap nor whole runs")
        self.p, self.w, self.unions = p, int(round(p.within * 1e6)), dict(p.unions)

    def takes(self, v: Var, kind: str) -> bool:
        return not v.types or (kind in v.types) != v.negated

    def value(self, n: Node, seqs: dict[str, list], elem: tuple | None, var: str | None) -> float | None:
        if n.kind == "num":
            return n.value
        if n.kind == "neg":
            a = self.value(n.args[0], seqs, elem, var)
            return None if a is None else -a
        if n.kind == "bin":
            a, b = (self.value(x, seqs, elem, var) for x in n.args)
            if a is None or b is None or n.name == "/" and b == 0:
                return None
            return {"+": a + b, "-": a - b, "*": a * b}[n.name] if n.name != "/" else a / b
        if n.kind == "elem":
            return elem[2] if n.name == var and elem else None
        if n.kind == "prev":
            return seqs[n.name][-1][2] if seqs.get(n.name) else None
        name = n.args[0] if n.kind == "call" else n.name
        seq = sorted(x for m in self.unions.get(name, (name,)) for x in seqs.get(m, []))
        if n.kind == "call" and n.name in TIMES:
            return seq[-1 if n.name == "last_time" else 0][0] / 1e6 if seq else None
        if n.kind == "call":
            return sequence_function(n.name, [x[2] for x in seq], n.args[1], [x[0] // 86_400_000_000 for x in seq])
        return seq[-1][2] if seq else None

    def holds(self, c: Constraint, seqs: dict[str, list], elem: tuple | None = None, var: str | None = None) -> bool:
        for a, op, b in c.parts:
            x, y = self.value(a, seqs, elem, var), self.value(b, seqs, elem, var)
            if x is None or y is None or not _OPS[op](x, y):
                return False
        return True

    def accepts(self, v: Var, seqs: dict[str, list], e: tuple) -> bool:
        """Tests of the event itself and of its step, with what came before."""
        for c in self.p.where:
            if v.name in c.elements and (not c.is_step or seqs.get(v.name)) and not self.holds(c, seqs, e, v.name):
                return False
        return True

    def done(self, seqs: dict[str, list]) -> bool:
        return all(self.holds(c, seqs) for c in self.p.where if not c.elements)

    def eligible(self, v: Var, e: tuple) -> bool:
        """What the event alone decides: tests of a single variable against numbers. The next match is the first that passes them."""
        own = [c for c in self.p.where if self.p.needs(c) == {v.name} and not c.elements and not any(n.kind == "call" for n in c.nodes())]
        return all(self.holds(c, {v.name: [e]}) for c in own)

    def step(self, partials: list[tuple], e: tuple, kind: str, number: int = 0) -> tuple[list, list[dict]]:
        """Partials after the event (the key's ``number``-th), and the matches that it completes."""
        vars_, out, matches = self.p.vars, [], []
        for at, seqs, *more in [*partials, (0, {})]:
            go_on, last = more or (True, 0)
            start = min((s[0][0] for s in seqs.values() if s), default=e[0])
            if e[0] - start > self.w:
                continue
            taken = False
            for i in range(at, len(vars_)):
                v = vars_[i]
                have = seqs.get(v.name, [])
                if i > at and not go_on:
                    break
                near = v.strategy != "strict" or not seqs or number == last + 1
                if near and self.takes(v, kind) and (v.most is None or len(have) < v.most) and self.accepts(v, seqs, e) and (v.kleene or v.strategy != "stnm" or self.eligible(v, e)):
                    new = seqs | {v.name: [*have, e]}
                    out.append((i, new, True, number))
                    taken = taken or v.strategy == "stnm" and bool(seqs)
                    rest = vars_[i + 1 :]
                    if len(new[v.name]) >= v.least and all(x.least == 0 for x in rest) and self.done(new | {x.name: [] for x in rest}):
                        matches.append(new)
                if len(have) < v.least:
                    break
            if seqs:
                out.append((at, seqs, go_on and not taken, last))
        return [x for x in out if self.alive(x, number)], matches

    def alive(self, partial: tuple, number: int) -> bool:
        """Whether a partial can still change: it may grow, or go on to a variable that needn't follow an event already past."""
        at, seqs, go_on, last = partial
        v = self.p.vars[at]
        grows = v.kleene and (v.most is None or len(seqs.get(v.name, [])) < v.most) and (v.strategy != "strict" or last >= number)
        following = self.p.vars[at + 1 :]
        need = next((i for i, x in enumerate(following) if x.least > 0), len(following))
        goes = go_on and any(x.strategy != "strict" or last >= number for x in following[: need + 1])
        return grows or goes


def _ids(p: Pattern, seqs: dict[str, list]) -> str:
    return ";".join(",".join(str(x[1]) for x in seqs.get(v.name, [])) for v in p.vars)


def processor(p: Pattern, timeouts: bool = False):
    """A StatefulProcessor for ``transformWithStateInPandas`` over rows (key, us, event_id, event_type, value)."""
    import pickle

    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    if timeouts and (p.vars[0].kleene or len(p.vars) < 2):
        raise ValueError("timeouts need a single first variable and another after it")

    class PatternProcessor(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.partials = handle.getListState("partials", "blob binary")
            self.seen = handle.getValueState("seen", "number long")
            self.starts = handle.getListState("starts", "us long, event_id long")
            self.waiting = handle.getListState("waiting", "us long, event_id long, event_type string, value double")
            self.match = Evaluator(p)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            mark = timerValues.getCurrentWatermarkInMs() * 1000
            latest = None
            for pdf in rows:
                for us, eid, kind, value in pdf[["us", "event_id", "event_type", "value"]].itertuples(index=False):
                    if us > mark:
                        self.waiting.appendValue((int(us), int(eid), kind, float(value)))
                        latest = us if latest is None else max(latest, us)
            if latest is not None:
                self.handle.registerTimer(int(latest) // 1000 + 1)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            mark, w, v = timerValues.getCurrentWatermarkInMs() * 1000, self.match.w, p.vars[0]
            held = [tuple(x) for x in self.waiting.get()]
            ready = sorted(x for x in held if x[0] <= mark)
            if ready:
                self.waiting.clear()
                for x in held:
                    if x[0] > mark:
                        self.waiting.appendValue(x)
            partials = [pickle.loads(x[0]) for x in self.partials.get()]
            number = self.seen.get()[0] if self.seen.exists() else 0
            starts = dict.fromkeys(tuple(x) for x in self.starts.get())
            out = []
            for us, eid, kind, value in ready:
                number += 1
                partials, found = self.match.step(partials, (us, eid, value), kind, number)
                for m in found:
                    first = min(s[0] for s in m.values() if s)
                    starts.pop(first[:2], None)
                    out.append((str(key[0]), "match", first[0], us, _ids(p, m)))
                if timeouts and self.match.takes(v, kind) and self.match.eligible(v, (us, eid, value)) and self.match.accepts(v, {}, (us, eid, value)):
                    starts.setdefault((us, eid))
                    self.handle.registerTimer((us + w) // 1000 + 1)
            for us, eid in sorted(s for s in starts if s[0] + w < mark):
                del starts[us, eid]
                out.append((str(key[0]), "timeout", us, us + w, str(eid)))
            self.partials.clear()
            for x in partials:
                if min(s[0][0] for s in x[1].values() if s) + w >= mark:
                    self.partials.appendValue((pickle.dumps(x),))
            self.starts.clear()
            for x in starts:
                self.starts.appendValue(x)
            self.seen.update((number,))
            if out:  # plain object columns: Arrow-backed strings arrive in chunks, which the writer does not take
                yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype="int64" if c.endswith("_us") else object) for i, c in enumerate(["key", "status", "first_us", "last_us", "ids"])})

        def close(self) -> None:
            pass

    return PatternProcessor()


def match_stream(events: DataFrame, p: Pattern, delay: str = "0 seconds", timeouts: bool = False) -> DataFrame:
    """Matches of a streaming DataFrame (event_id, ts, event_type, value and the key column) as rows of ``OUTPUT``; ``ids`` holds each
    variable's event ids, variables apart by ';'. Needs the RocksDB state store provider.

    With ``timeouts`` (for a single first variable) also rows with status "timeout": a first event whose window ended, at last_us,
    without a match.
    Times are those of the wall clock for a ``ts`` without time zone; the watermark follows the session's reading of it.
    """
    key = F.col(p.key).cast("string") if p.key else F.lit("")
    ts = F.col("ts").cast("timestamp")
    rows = events.withColumn("__ts", ts).withWatermark("__ts", delay).where("ts is not null and event_id is not null")
    rows = rows.select(key.alias("key"), "__ts", micros(events).alias("us"), "event_id", "event_type", F.col("value").cast("double").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=processor(p, timeouts), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
