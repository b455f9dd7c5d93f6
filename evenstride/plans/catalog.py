"""Named queries and their portable SQL: pattern queries here, the others from the modules they belong to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import expand, match_output, prep
from ..operators.match import count_matches, match, timeouts
from ..sources import queries as sources
from .oracle import oracle
from .parser import parse_match_recognize, parse_seq
from .spec import Pattern, pattern

DAY = 86400.0
_ABC = {"A": "signup", "B": "click", "C": "purchase"}
_k = partial(pattern, key="user_id")

SEQ_TEXT = """
PATTERN SEQ(a, b{2,}, c) SEMATIC skip_till_any_match
WHERE a.type = 'signup' AND b.type = 'click' AND b[i].value - b[i-1].value >= 0 AND c.type = 'purchase' AND c.value - 0.5 * a.value >= 0
WITHIN 2 days
"""
MR_TEXT = """
SELECT * FROM events MATCH_RECOGNIZE (
  PARTITION BY user_id ORDER BY ts
  PATTERN (A D{2,} B) WITHIN INTERVAL '3' DAY
  SUBSET U = (A, D)
  DEFINE A AS type = 'view' AND A BETWEEN 5 AND 80, D AS type = 'click' AND non_decreasing(D) > 0, B AS type IN ('error', 'purchase') AND B - min(D) >= 0
)
"""

WEATHER_TEXT = """
SELECT * FROM events MATCH_RECOGNIZE (
  PARTITION BY user_id ORDER BY ts
  PATTERN (A* D2+ B* Z) WITHIN INTERVAL '30' DAY
  SUBSET U = (A, D, B)
  DEFINE A AS type = 'signup' AND A[i].value >= 100,
  D AS type = 'click' AND D[i].value >= 30 AND tstamp - first(D.tstamp) <= INTERVAL '5' DAY,
  B AS type = 'error' AND B[i].value >= 100,
  Z AS type = 'purchase' AND Z.value >= 60 AND last(U.tstamp) - first(U.tstamp) BETWEEN INTERVAL '15' DAY AND INTERVAL '30' DAY
  AND mannkendalltest(U.value) >= 3.0 AND linearregressionr2(D.tstamp, D.value) >= 0.95 AND last(D.value) - first(D.value) < -20
)
"""

#: Pattern queries over ``events``.
PATTERNS: dict[str, Pattern] = {
    # pattern operators
    "seq_abc": _k("A B C", _ABC, within=2 * DAY),
    "kleene_plus": _k("A B+ C", _ABC, within=3 * DAY),
    "kleene_star": _k("A B* C", _ABC, within=2 * DAY),
    "optional": _k("A B? C", _ABC, within=2 * DAY),
    "quant_n": _k("A B{2} C", _ABC, within=3 * DAY),
    "quant_n_inf": _k("A B{2,} C", _ABC, within=3 * DAY),
    "quant_n_m": _k("A B{1,2} C", _ABC, within=3 * DAY),
    "quant_m": _k("A B{,2} C", _ABC, within=2 * DAY),
    "kl_prefix": _k("A+ B", _ABC, within=2 * DAY),
    "kl_middle": _k("A B{1,} C", _ABC, ("C - A >= 0",), 3 * DAY),
    "kl_suffix": _k("A B+", _ABC, within=2 * DAY),
    "kl_only": _k("A{4,}", {"A": "click"}, ("average(A) >= 40",), 6 * DAY),
    "kl_multi2": _k("A+ B+", _ABC, within=1.5 * DAY),
    "kl_multi_c": _k("A+ B+ C", _ABC, within=2 * DAY),
    "kl_prefix_mid": _k("A{2,} B C{2,} D", {"A": "click", "B": "signup", "C": "view", "D": "purchase"}, within=5 * DAY),
    "same_type_vars": _k("A B C", dict.fromkeys("ABC", "click"), ("B - A >= 0", "C - B <= 0"), 3 * DAY),
    "neg_type": _k("A B C", {"A": "signup", "B": ("!signup", "!purchase"), "C": "purchase"}, within=1 * DAY),
    "text_query": parse_seq(SEQ_TEXT, "user_id"),
    "mr_query": parse_match_recognize(MR_TEXT),
    "subset_union": _k("A B+ C", _ABC, within=2 * DAY, unions=(("U", ("A", "B", "C")),)),
    # selection strategies
    "sel_stam": _k("A B{2,} C", _ABC, within=2 * DAY),
    "sel_strict": _k("A B+ C", {"A": ("signup", "view"), "B": "click", "C": ("purchase", "error", "view")}, within=10 * DAY, strategy="strict"),
    "sel_stnm": _k("A B C", _ABC, within=5 * DAY, strategy="stnm"),
    "sel_contiguous": _k("A B+ C", _ABC, within=4 * DAY, strategy={"A": "stam", "B": "contiguous", "C": "stam"}),
    "sel_mixed": _k("A B C", _ABC, within=5 * DAY, strategy={"A": "stam", "B": "stnm", "C": "stam"}),
    # constraints
    "c_type": _k("A B", {"A": ("signup", "view"), "B": ("purchase", "error")}, within=1 * DAY),
    "c_scalar": _k("A B C", _ABC, ("20 <= A <= 60", "C > 30"), 3 * DAY),
    "c_elem": _k("A B+ C", _ABC, ("10 <= B[i] <= 60",), 3 * DAY),
    "c_step": _k("A B{2,} C", _ABC, ("-20 <= B[i] - last(B) <= 40",), 4 * DAY),
    "c_agg": _k("A B{2,} C", _ABC, ("30 <= average(B) <= 70", "max(B) <= 120"), 4 * DAY),
    "c_cross": _k("A B C", _ABC, ("0 <= C - 1.1*B <= 1000",), 2 * DAY),
    "c_cross_agg": _k("A{2,} B C", {"A": "click", "B": "error", "C": "purchase"}, ("-1000 <= B - min(A) <= 0", "C - max(A) >= 0"), 3 * DAY),
    "c_agg_agg": _k("A{2,} B{2,}", {"A": "click", "B": "view"}, ("0 <= last(B)/first(B) - last(A)/first(A) <= 1000",), 2 * DAY),
    "c_arith": _k("A B C", _ABC, ("(A + B) * 2 - C / 4 > 50", "-A + 3 * (B - C) <= 100"), 2 * DAY),
    "c_time": _k("A B C", _ABC, ("3600 <= time(C) - time(A) <= 100000",), 3 * DAY),
    "c_window": _k("A B", {"A": "signup", "B": "purchase"}, within=0.25 * DAY),
    "c_gap": _k("A B C", _ABC, within=4 * DAY, max_gap=0.5 * DAY),
    "c_count": _k("A B+ C", _ABC, ("2 <= count(B) <= 3",), 3 * DAY),
    # named queries
    "q_hadoop": _k("A B{2,} C", _ABC, ("B[i] - B[i-1] >= 0",), 3 * DAY),
    "q_stock": _k("A{5,} B{5,}", {"A": ("click", "signup"), "B": ("view", "error")}, ("0 <= A[i] - last(A) <= 1000", "0 <= B[i] - last(B) <= 1000", "0 <= last(A) - 1.1118 * first(A) <= 1000", "0 <= last(B) / first(B) - last(A) / first(A) <= 1000"), 12 * DAY),
    "q_flash": _k("A{5,} B C", {"A": "view", "B": "error", "C": "purchase"}, ("0.1 <= sum_square_difference(A) <= 1000", "-1000 <= B - min(A) <= 0", "0 <= C - max(A) <= 1000", "0 <= C - 1.1 * B <= 1000"), 10 * DAY),
    "q_lng": _k("A{2,} B{2,} C", {"A": "view", "B": "error", "C": "purchase"}, ("1.1 <= standard_deviation(A) <= 1000", "-1000 <= B[i] - last(B) <= 0", "250 <= C <= 10000"), 3 * DAY),
    "q_peak": _k("A B C", dict.fromkeys("ABC", "click"), ("0 < B - A <= 100", "0 < B - C <= 100", "259200 <= time(C) - time(A) <= 259200"), 3 * DAY, strategy={"A": "stam", "B": "stnm", "C": "stnm"}),
    "q_trough": _k("A B C", dict.fromkeys("ABC", "click"), ("0 < A - B <= 100", "0 < C - B <= 100", "259200 <= time(C) - time(A) <= 259200"), 3 * DAY, strategy={"A": "stam", "B": "stnm", "C": "stnm"}),
    "q_rise_fall": _k("D{2,5} A B C E{2,5}", {"D": "click", "A": "view", "B": "view", "C": "view", "E": "click"}, ("0.1 <= least_squares(D) <= 100", "0 < A - max(D) <= 100", "0 < B - A <= 100", "0 < B - C <= 100", "-100 <= least_squares(E) <= -0.1", "0 < C - max(E) <= 100"), 10 * DAY),
    "q_msft": _k("A B{10,} C", {"A": "click", "B": "view", "C": "click"}, ("C - 1.1 * A >= 0",), 16 * DAY),
    "q_prefix": _k("A{2,} B C{2,} D", {"A": "click", "B": "error", "C": "view", "D": "purchase"}, ("10 <= average(A) <= 60", "10 <= average(C) <= 60", "D - B >= 0"), 5 * DAY),
    "q_long": _k("A C E D G{3,} F+ B", {"A": "signup", "C": "view", "E": "error", "D": "view", "G": "click", "F": "purchase", "B": "error"}, ("sum(G) - sum(F) >= 0",), 6 * DAY),
    "q_weather": parse_match_recognize(WEATHER_TEXT),
    # whole runs, unions, times of sequences
    "x_runs_only": _k("A B+ C", _ABC, ("C - A >= 0",), 3 * DAY, expand_unconstrained=False),
    "c_union": _k("A B+ C", _ABC, ("average(U) >= 60", "max(U) <= 300", "last(U.tstamp) - first(U.tstamp) >= INTERVAL '1' DAY"), 2 * DAY, unions=(("U", ("A", "B")),)),
    "c_time_last": _k("A B{2,} C", _ABC, ("first_time(B) - time(A) <= INTERVAL '1' DAY", "time(C) - last_time(B) <= INTERVAL '1' DAY", "last_time(B) - first_time(B) <= INTERVAL '2' DAY"), 4 * DAY),
}
for _fn, _test in {"increasing": "increasing(A) > 0", "decreasing": "decreasing(A) > 0", "average": "average(A) >= 60", "max": "max(A) <= 40", "sum": "sum(A) >= 250", "standard_deviation": "standard_deviation(A) <= 40", "least_squares": "least_squares(A) >= 10"}.items():
    PATTERNS[f"q_udf_sweep_{_fn}"] = _k("A{4,}", {"A": "click"}, (_test,), 6 * DAY)

COUNTED: dict[str, Pattern] = {
    "q_count_prefix": _k("A+ B", _ABC, within=3 * DAY),
    "q_count_suffix": _k("A B+", _ABC, within=3 * DAY),
    "q_count_middle": _k("A B{2,} C", _ABC, within=4 * DAY),
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


#: Queries whose constants need other values or whole days: (factor of the value, days instead of times), as the surveyed prices have them.
BINDING: dict[str, tuple[float, bool]] = {"q_flash": (0.01, False), "q_lng": (5.0, False), "q_peak": (1.0, True), "q_trough": (1.0, True)}


def _match(p: Pattern, factor: float, daily: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    if factor != 1:
        e = e.withColumn("value", F.col("value") * factor)
    if daily:
        e = e.withColumn("ts", F.col("ts").cast("date").cast("timestamp_ntz"))
    return match(e, replace(p, max_candidates=None)).drop("first_us", "last_us")  # like their SQL, the queries refuse no group


def _count(p: Pattern, spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_matches(events(spark, sf_dir), p)


def _timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeouts(events(spark, sf_dir), PATTERNS["c_window"])


_TIMEOUT_SQL = """SELECT a.user_id, a.event_id AS a_id, epoch_us(a.ts) + 21600000000 AS timeout_us FROM events a WHERE a.event_type = 'signup' AND NOT EXISTS (
SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND (b.ts, b.event_id) > (a.ts, a.event_id) AND epoch_us(b.ts) - epoch_us(a.ts) <= 21600000000)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _name, _p in PATTERNS.items():
    _factor, _daily = BINDING.get(_name, (1.0, False))
    QUERIES[_name] = partial(_match, _p, _factor, _daily)
    ORACLES[_name] = oracle(_p, cols={"value": f"value * {_factor}", "ts": "CAST(date_trunc('day', ts) AS TIMESTAMP)" if _daily else "ts"} if _name in BINDING else None)
for _name, _p in COUNTED.items():
    QUERIES[_name] = partial(_count, _p)
    ORACLES[_name] = f"SELECT user_id, count(*) AS matches FROM ({oracle(_p)}) GROUP BY user_id"
QUERIES["timeouts"], ORACLES["timeouts"] = _timeouts, _TIMEOUT_SQL
for _part in (expand, match_output, prep, sources):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
