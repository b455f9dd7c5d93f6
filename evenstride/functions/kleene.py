"""Registry of functions over Kleene sequences: SQL builders over an array of ``struct<ts, event_id, value>`` in arrival order.

Each entry builds a Catalyst expression (no Python at run time) and says what it costs and which element bound an outer bound implies.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd

from .clock import ntz_micros


@dataclass(frozen=True)
class KleeneFunction:
    """``build(array, index)`` gives Spark SQL; ``cost(n)`` the work on n elements; ``derives``: 'lower' if f >= x means every element >= x,
    'upper' if f <= x means every element <= x."""

    name: str
    build: Callable[[str, int | None], str]
    cost: Callable[[int], float] = lambda n: n
    derives: str | None = None
    indexed: bool = False
    generator: bool = False


REGISTRY: dict[str, KleeneFunction] = {}
#: Other names of functions.
ALIASES = {"avg": "average", "msd_exceeds_variance_threshold": "sum_square_difference", "size": "count", "cv": "standard_deviation", "slope": "least_squares", "mannkendalltest": "mann_kendall_test", "linearregressionr2": "linear_regression_r2"}
MAX_SUBSETS = 16


def register_kleene_fn(name: str, build: Callable[[str, int | None], str], **more) -> KleeneFunction:
    """Add a function; ``build`` must give null-safe SQL (conjunct order is no guard under ANSI mode)."""
    fn = REGISTRY[name] = KleeneFunction(name, build, **more)
    return fn


def register_python_fn(spark, name: str, fn: Callable[[list[float]], float | None], **more) -> KleeneFunction:
    """Add an opaque Python function of a sequence's values: it runs as a vectorised Arrow function over whole columns of sequences.

    Use it in constraints on bound variables (``f(K) > 1``); those of SQL functions are tested first, as its cost is the highest.
    """
    from pyspark.sql import functions as F

    @F.pandas_udf("double")
    def run(col: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fn([float(v) for v in x]) for x in col], dtype="float64")

    spark.udf.register(f"kleene_{name}", run)
    more.setdefault("cost", lambda n: 1000.0 * n)
    return register_kleene_fn(name, lambda a, _=None: f"kleene_{name}({_values(a)})", **more)


def lookup(name: str) -> KleeneFunction:
    name = ALIASES.get(name.lower(), name.lower())
    if name not in REGISTRY:
        raise ValueError(f"unknown function {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def _values(a: str) -> str:
    return f"transform({a}, x -> x.value)"


def _sum(a: str) -> str:
    return f"aggregate({a}, 0D, (s, x) -> s + x.value)"


def _squares(a: str) -> str:
    return f"aggregate({a}, 0D, (s, x) -> s + x.value * x.value)"


def _mean(a: str) -> str:
    return f"coalesce(try_divide({_sum(a)}, cast(size({a}) as double)), 0D)"


def _moments(a: str, body: str) -> str:
    """``body`` over m: struct(n, s, q, d) of count, sum, sum of squares and sum of squared distances from the mean (a second pass, so
    large values don't cancel), bound once."""
    off = f"aggregate({a}, 0D, (t, x) -> t + (x.value - s.s / s.n) * (x.value - s.s / s.n))"
    first = f"array(named_struct('n', cast(size({a}) as double), 's', {_sum(a)}))"
    return f"transform(transform({first}, s -> named_struct('n', s.n, 's', s.s, 'q', {_squares(a)}, 'd', if(s.n = 0, 0D, {off}))), m -> {body})[0]"


def _trend(op: str) -> Callable[[str, int | None], str]:
    def build(a: str, _: int | None = None) -> str:
        pairs = f"zip_with(slice({a}, 1, greatest(size({a}) - 1, 0)), slice({a}, 2, greatest(size({a}) - 1, 0)), (p, q) -> p.value {op} q.value)"
        return f"if(size({a}) > 1 and forall({pairs}, ok -> ok), 1, -1)"

    return build


def _split(x: str) -> str:
    """The upper 26 bits of a double, whose product with another such is exact."""
    return f"(134217729D * {x} - (134217729D * {x} - {x}))"


def _slope(a: str, origin: int | None = None) -> str:
    """Least squares over whole days since ``origin`` days after 2000-01-01, missing values left out.

    Running means, the covariance by fused multiply-add and the variance take the steps of the portable SQL's regr_slope, so that a slope
    that lies on a bound falls on the same side of it here. The product u * w is p + e exactly; c + p + e is rounded from exact parts.
    """
    day = f"cast(datediff(cast(x.ts as date), date'2000-01-01') - {origin or 0} as double)"
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    error = "z.uh * z.wh - z.p + z.uh * (z.w - z.wh) + (z.u - z.uh) * z.wh + (z.u - z.uh) * (z.w - z.wh)"
    total = "(r.t + ((r.p - (r.t - (r.t - r.p))) + (s.c - (r.t - r.p)) + r.e))"
    last = f"named_struct('n', z.n, 'x', z.x, 'y', z.y, 'c', {let('r', f"named_struct('t', z.p + s.c, 'p', z.p, 'e', {error})", total)}, 'd', s.d + (z.day - z.x) * z.u)"
    product = f"named_struct('n', z.n, 'day', z.day, 'x', z.x, 'y', z.y, 'u', z.u, 'w', z.v - z.y, 'p', z.u * (z.v - z.y), 'uh', {_split('z.u')}, 'wh', {_split('(z.v - z.y)')})"
    means = "named_struct('n', z.n, 'day', z.day, 'v', z.v, 'u', z.day - s.x, 'x', s.x + (z.day - s.x) / z.n, 'y', s.y + (z.v - s.y) / z.n)"
    step = let("z", let("z", let("z", f"named_struct('n', s.n + 1D, 'day', {day}, 'v', x.value)", means), product), last)
    acc = "named_struct('n', 0D, 'x', 0D, 'y', 0D, 'c', 0D, 'd', 0D)"
    return f"aggregate(filter({a}, x -> x.value is not null), {acc}, (s, x) -> {step}, s -> coalesce(try_divide(try_divide(s.c, s.n), try_divide(s.d, s.n)), 0D))"


def subset_rows(a: str) -> str:
    """All subsets as struct(size, places, sum), the empty one too."""
    one = "array(named_struct('n', 0, 'at', cast(array() as array<int>), 's', 0D))"
    grown = "transform(acc, t -> named_struct('n', t.n + 1, 'at', concat(t.at, array(i)), 's', t.s + v))"
    return f"aggregate(sequence(1, size({a})), {one}, (acc, i) -> transform(array(get({a}, i - 1).value), v -> concat(acc, {grown}))[0])"


def _subset_sum(a: str, _: int | None = None) -> str:
    """The middle one of all subset sums in size-then-place order (element 2^n div 2)."""
    guard = f"if(size({a}) > {MAX_SUBSETS}, raise_error('subset_sum over more than {MAX_SUBSETS} elements'), 0)"
    pick = f"get(array_sort({subset_rows(a)}), cast(shiftleft(1, size({a})) / 2 as int)).s"
    return f"if(size({a}) > {MAX_SUBSETS}, cast({guard} as double), if(size({a}) = 0, 0D, {pick}))"


def value_at(a: str, us: str, event_id: str | None = None) -> str:
    """Value of the event at an exact time (microseconds since 1970, SQL), null if nothing happened then; of several events the first, or
    that with ``event_id``."""
    return f"get(filter({a}, x -> {ntz_micros('x.ts')} = {us}{f' and x.event_id <=> {event_id}' if event_id else ''}), 0).value"


def _choose(n: str, k: int) -> str:
    return f"aggregate(sequence(1, {k}), 1D, (c, i) -> c * ({n} - {k} + i) / i)" if k > 0 else "1D"


register_kleene_fn("first", lambda a, _=None: f"get({a}, 0).value", cost=lambda n: 1)
register_kleene_fn("last", lambda a, _=None: f"get({a}, size({a}) - 1).value", cost=lambda n: 1)
register_kleene_fn("nth", lambda a, k: f"get({a}, {k}).value", cost=lambda n: 1, indexed=True)
register_kleene_fn("random", lambda a, _=None: f"get({a}, cast(pmod(xxhash64(7, transform({a}, x -> x.event_id)), greatest(size({a}), 1)) as int)).value", cost=lambda n: 1)
register_kleene_fn("count", lambda a, _=None: f"size({a})", cost=lambda n: 1)
register_kleene_fn("sum", lambda a, _=None: _sum(a))
register_kleene_fn("average", lambda a, _=None: _mean(a))
register_kleene_fn("min", lambda a, _=None: f"array_min({_values(a)})", derives="lower")
register_kleene_fn("max", lambda a, _=None: f"array_max({_values(a)})", derives="upper")
register_kleene_fn("least_squares", _slope)
register_kleene_fn("increasing", _trend("<"))
register_kleene_fn("decreasing", _trend(">"))
register_kleene_fn("non_increasing", _trend(">="))
register_kleene_fn("non_decreasing", _trend("<="))
register_kleene_fn(
    "standard_deviation",
    lambda a, _=None: _moments(a, "case when m.n <= 1 then -1000D when m.s = 0 then 0D else 100D * sqrt(m.d / (m.n - 1)) / (m.s / m.n) end"),
    cost=lambda n: 2 * n + 1,
)
register_kleene_fn(
    "sum_square_difference",
    lambda a, _=None: _moments(a, "case when m.n <= 1 then -1D else transform(array(m.d / m.n), s2 -> 2D * m.n / (m.n - 1) * s2 - 4D * s2 * s2)[0] end"),
)
register_kleene_fn("merge_sort", lambda a, k: f"get(array_sort({_values(a)}), {k})", cost=lambda n: n * max(1, n).bit_length(), indexed=True)
register_kleene_fn("bubble_sort", lambda a, k: f"coalesce(get(array_sort({_values(a)}), {k}), -1D)", cost=lambda n: n * max(1, n).bit_length(), indexed=True)
register_kleene_fn("binary_search_timestamp", lambda a, t: value_at(a, f"{t} * 1000000L"), indexed=True)
register_kleene_fn("triplet_sum", lambda a, _=None: f"power({_sum(a)}, 3D)")
register_kleene_fn("permutations", lambda a, _=None: f"get({a}, 0).value", cost=lambda n: 1)
register_kleene_fn("combinations_square", lambda a, k: _moments(a, f"case when m.n < {k} or m.n = 0 then 0D else {_choose('m.n', k)} / m.n * m.q end"), indexed=True)
register_kleene_fn("subset_sum", _subset_sum, cost=lambda n: 2.0**n)
register_kleene_fn(
    "mann_kendall_test",
    lambda a, _=None: f"aggregate(sequence(1, greatest(size({a}), 1)), 0, (t, i) -> t + aggregate(slice({a}, i, size({a})), 0, (u, y) -> u + cast(sign(y.value - get({a}, i - 1).value) as int)))",
    cost=lambda n: n * n,
)
def _r2(a: str) -> str:
    day = f"cast(datediff(cast(x.ts as date), cast(get({a}, 0).ts as date)) as double)"
    step = f"named_struct('n', s.n + 1D, 'x', s.x + {day}, 'y', s.y + x.value, 'xx', s.xx + {day} * {day}, 'xy', s.xy + {day} * x.value, 'yy', s.yy + x.value * x.value)"
    end = "coalesce(try_divide(power(s.n * s.xy - s.x * s.y, 2D), (s.n * s.xx - s.x * s.x) * (s.n * s.yy - s.y * s.y)), 0D)"
    return f"aggregate({a}, named_struct('n', 0D, 'x', 0D, 'y', 0D, 'xx', 0D, 'xy', 0D, 'yy', 0D), (s, x) -> {step}, s -> {end})"


register_kleene_fn("linear_regression_r2", lambda a, _=None: _r2(a))


def monotone_subsequences(a: str, op: str, least: int) -> str:
    """All subsequences of at least ``least`` elements whose neighbours satisfy ``op``: a fold that only extends what still fits."""
    kind = "array<array<struct<ts:timestamp_ntz,event_id:bigint,value:double>>>"
    grow = f"transform(filter(acc, s -> get(s, size(s) - 1).value {op} e.value), s -> concat(s, array(e)))"
    return f"filter(aggregate({a}, cast(array() as {kind}), (acc, e) -> concat(acc, array(array(e)), {grow})), s -> size(s) >= {least})"


#: Generators of monotone subsequences by name.
GENERATORS = {"increasing_dp": "<", "non_decreasing_dp": "<=", "non_increasing_dp": ">=", "decreasing_dp": ">"}
