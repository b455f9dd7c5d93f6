"""Kleene functions, expansions and combination joins as queries over weekly click sequences of ``events``."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import ntz_micros
from ..functions.kleene import GENERATORS, lookup, monotone_subsequences, value_at

WEEK_SQL = "CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS BIGINT)"


def sequences(spark: SparkSession, sf_dir: str, kind: str = "click") -> DataFrame:
    """Each user's events of one type by week as an array in arrival order: ``(user_id, wk, a)``."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type") == kind)
    wk = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7).cast("long")
    el = F.struct("ts", "event_id", F.col("value").cast("double").alias("value"))
    return ev.groupBy("user_id", wk.alias("wk")).agg(F.array_sort(F.collect_list(el)).alias("a"))


def seq_sql(kind: str = "click") -> str:
    return f"SELECT user_id, {WEEK_SQL} AS wk, list(value ORDER BY ts, event_id) AS v, list(ts ORDER BY ts, event_id) AS t, list(event_id ORDER BY ts, event_id) AS ids FROM events WHERE event_type = '{kind}' GROUP BY ALL"


def digits(name: str) -> int:
    """Digits shown: fewer where values are large, so that the last bits of a sum in another order don't show."""
    return 2 if name == "triplet_sum" else 6


def function_query(name: str, index: int | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lookup(name).build("a", index)
    shown = f"round({f} * 1e6D) / 1e6D" if name == "least_squares" else f"round(cast({f} as double), {digits(name)})"  # halves as the SQL rounds them
    return sequences(spark, sf_dir).select("user_id", "wk", F.expr(shown).alias("result"))


def generator_query(op: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sequences(spark, sf_dir).withColumn("s", F.explode(F.expr(monotone_subsequences("a", op, 2))))
    return s.select("user_id", "wk", F.expr("array_join(transform(s, x -> cast(x.event_id as string)), ',')").alias("ids"))


def _generator_sql(op: str | None, least: int = 2) -> str:
    return f"""WITH RECURSIVE ev AS (SELECT user_id, {WEEK_SQL} AS wk, event_id, ts, value FROM events WHERE event_type = 'click'),
c AS (SELECT user_id, wk, ts, event_id, value, CAST(event_id AS VARCHAR) AS ids, 1 AS n FROM ev UNION ALL
SELECT c.user_id, c.wk, e.ts, e.event_id, e.value, c.ids || ',' || e.event_id, n + 1 FROM c JOIN ev e ON e.user_id = c.user_id AND e.wk = c.wk AND (e.ts, e.event_id) > (c.ts, c.event_id){f" AND c.value {op} e.value" if op else ""})
SELECT user_id, wk, ids FROM c WHERE n >= {least}"""


def _fsql(expr: str, name: str = "") -> str:
    return f"SELECT user_id, wk, round(CAST({expr} AS DOUBLE), {digits(name)}) AS result FROM ({seq_sql()})"


_FUNCTIONS: dict[str, tuple[str, int | None, str | None]] = {
    "f_first": ("first", None, "v[1]"),
    "f_last": ("last", None, "v[len(v)]"),
    "f_random": ("random", None, None),
    "f_nth": ("nth", 1, "v[2]"),
    "f_average": ("average", None, "list_avg(v)"),
    "f_sum": ("sum", None, "list_sum(v)"),
    "f_min": ("min", None, "list_min(v)"),
    "f_max": ("max", None, "list_max(v)"),
    "f_slope": ("least_squares", 8766, "coalesce((SELECT CASE WHEN count(DISTINCT x) > 1 THEN regr_slope(y, x) ELSE 0 END FROM (SELECT unnest(v) AS y, unnest(list_transform(t, lambda z: date_diff('day', DATE '2024-01-01', CAST(z AS DATE)))) AS x)), 0)"),
    "f_inc": ("increasing", None, "CASE WHEN len(v) > 1 AND v = list_sort(v) AND len(list_distinct(v)) = len(v) THEN 1 ELSE -1 END"),
    "f_dec": ("decreasing", None, "CASE WHEN len(v) > 1 AND v = list_reverse_sort(v) AND len(list_distinct(v)) = len(v) THEN 1 ELSE -1 END"),
    "f_noninc": ("non_increasing", None, "CASE WHEN len(v) > 1 AND v = list_reverse_sort(v) THEN 1 ELSE -1 END"),
    "f_nondec": ("non_decreasing", None, "CASE WHEN len(v) > 1 AND v = list_sort(v) THEN 1 ELSE -1 END"),
    "f_cv": ("standard_deviation", None, "CASE WHEN len(v) <= 1 THEN -1000 WHEN list_sum(v) = 0 THEN 0 ELSE 100 * list_stddev_samp(v) / list_avg(v) END"),
    "f_ssd": ("sum_square_difference", None, "CASE WHEN len(v) <= 1 THEN -1 ELSE 2.0 * len(v) / (len(v) - 1) * list_var_pop(v) - 4 * list_var_pop(v) * list_var_pop(v) END"),
    "f_msort": ("merge_sort", 1, "list_sort(v)[2]"),
    "f_bsort": ("bubble_sort", 2, "coalesce(list_sort(v)[3], -1)"),
    "f_triplet": ("triplet_sum", None, "power(list_sum(v), 3)"),
    "f_perm": ("permutations", None, "v[1]"),
    "f_combsq": ("combinations_square", 2, "CASE WHEN len(v) < 2 THEN 0 ELSE len(v) * (len(v) - 1) / 2.0 / len(v) * list_sum(list_transform(v, lambda x: x * x)) END"),
    "f_mann_kendall": ("mann_kendall_test", None, "(SELECT coalesce(sum(sign(b.y - a.y)), 0) FROM (SELECT unnest(v) AS y, unnest(range(len(v))) AS i) a JOIN (SELECT unnest(v) AS y, unnest(range(len(v))) AS i) b ON a.i < b.i)"),
    "f_r2": ("linear_regression_r2", None, "coalesce((SELECT CASE WHEN count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN power(corr(y, x), 2) ELSE 0 END FROM (SELECT unnest(v) AS y, unnest(list_transform(t, lambda z: date_diff('day', DATE '2024-01-01', CAST(z AS DATE)))) AS x)), 0)"),
}
_SUBSET_SQL = f"""WITH RECURSIVE q AS ({seq_sql()}), s AS (SELECT user_id, wk, v, 0 AS last, CAST([] AS INTEGER[]) AS pl, CAST(0 AS DOUBLE) AS total FROM q UNION ALL
SELECT user_id, wk, v, i, list_append(pl, i), total + v[i] FROM (SELECT *, unnest(range(last + 1, len(v) + 1))::INTEGER AS i FROM s)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, wk ORDER BY len(pl), pl) - 1 AS place, count(*) OVER (PARTITION BY user_id, wk) AS n FROM s)
SELECT user_id, wk, round(total, 6) AS result FROM r WHERE place = n // 2"""


def at_ts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value at an exact time: for sequences of even length that of the event after their middle, for others one nothing happened at."""
    s = sequences(spark, sf_dir)
    us = f"({ntz_micros('get(a, size(a) div 2).ts')} + if(size(a) % 2 = 0, 0L, 700000000000L))"
    return s.select("user_id", "wk", F.expr(f"round({value_at('a', us, 'get(a, size(a) div 2).event_id')}, 6)").alias("result"))


def powerset_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All non-empty subsets by a fold."""
    s = sequences(spark, sf_dir).withColumn("s", F.explode(F.expr("filter(aggregate(a, array(slice(a, 1, 0)), (acc, e) -> concat(acc, transform(acc, s -> concat(s, array(e))))), s -> size(s) >= 1)")))
    return s.select("user_id", "wk", F.expr("array_join(transform(s, x -> cast(x.event_id as string)), ',')").alias("ids"))


def contiguous_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = "flatten(transform(sequence(1, size(a)), i -> transform(sequence(1, size(a) - i + 1), k -> slice(a, i, k))))"
    s = sequences(spark, sf_dir).withColumn("s", F.explode(F.expr(runs)))
    return s.select("user_id", "wk", F.expr("array_join(transform(s, x -> cast(x.event_id as string)), ',')").alias("ids"))


_CONTIG_SQL = f"SELECT user_id, wk, array_to_string(ids[i:j], ',') AS ids FROM (SELECT user_id, wk, ids, i, unnest(range(i, len(ids) + 1)) AS j FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM ({seq_sql()})))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views of a user's week in one row."""
    return sequences(spark, sf_dir).join(sequences(spark, sf_dir, "view").withColumnRenamed("a", "b"), ["user_id", "wk"])


def product_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product of two variables' elements within the row: two explodes, no join."""
    p = _pairs(spark, sf_dir).withColumn("x", F.explode("a")).withColumn("y", F.explode("b"))
    return p.select("user_id", "wk", F.col("x.event_id").alias("a_id"), F.col("y.event_id").alias("b_id"))


def shared_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinations (click, view) and (view, error) that share the view."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("wk", F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7).cast("long"))
    one = lambda k, n: ev.where(F.col("event_type") == k).select("user_id", "wk", F.col("event_id").alias(f"{n}_id"), F.col("value").alias(n))
    ab = one("click", "a").join(one("view", "b"), ["user_id", "wk"]).where("b >= a")
    bc = one("view", "b").join(one("error", "c"), ["user_id", "wk"]).where("c >= b").drop("b")
    return ab.join(bc, ["user_id", "wk", "b_id"]).select("user_id", "wk", "a_id", "b_id", "c_id")


def spans(events: DataFrame, first: str, last: str, days: int) -> DataFrame:
    """Pairs of an event of one type and a later one of another within ``days``, of one user: ``(user_id, a_id, c_id, bs, be)``.

    An equi-join on user and ``days``-wide bucket (the first looks into its bucket and the next), the time as residual.
    """
    us, wide = F.expr(ntz_micros("ts")), days * 86_400_000_000
    a = events.where(F.col("event_type") == first).select("user_id", F.col("event_id").alias("a_id"), us.alias("bs"))
    a = a.withColumn("bucket", F.explode(F.expr(f"array(floor(bs / {wide}), floor(bs / {wide}) + 1)")))
    c = events.where(F.col("event_type") == last).select("user_id", F.col("event_id").alias("c_id"), us.alias("be")).withColumn("bucket", F.expr(f"floor(be / {wide})"))
    return a.join(c, ["user_id", "bucket"]).where(f"be > bs and be <= bs + {wide}").drop("bucket")


def contained(base: DataFrame, combos: DataFrame, days: int, strict: bool = False) -> DataFrame:
    """Combinations (times ``s`` to ``e``) within spans of at most ``days`` (``bs`` to ``be``): a span looks for starts in its two buckets."""
    wide, op = days * 86_400_000_000, "" if strict else "="
    combos = combos.withColumns({"s": F.expr(ntz_micros("s")), "e": F.expr(ntz_micros("e"))}).withColumn("bucket", F.expr(f"floor(s / {wide})"))
    base = base.withColumn("bucket", F.explode(F.expr(f"array(floor(bs / {wide}), floor(bs / {wide}) + 1)")))
    return base.join(combos, ["user_id", "bucket"]).where(f"s >{op} bs and e <{op} be")


def interval_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click sequences of a week that lie within a span between a signup and a purchase."""
    combos = sequences(spark, sf_dir).select("user_id", "wk", F.expr("a[0].ts").alias("s"), F.expr("get(a, size(a) - 1).ts").alias("e"))
    return contained(spans(spark.read.parquet(f"{sf_dir}/events.parquet"), "signup", "purchase", 9), combos, 9).select("user_id", "a_id", "c_id", "wk")


_EV_WK = f"(SELECT *, {WEEK_SQL} AS wk FROM events)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _key, (_fn, _i, _sql) in _FUNCTIONS.items():
    QUERIES[_key] = partial(function_query, _fn, _i)
    if _sql:
        ORACLES[_key] = _fsql(_sql, _fn)
QUERIES["f_subset_sum"], ORACLES["f_subset_sum"] = partial(function_query, "subset_sum", None), _SUBSET_SQL
QUERIES["f_at_ts"], ORACLES["f_at_ts"] = at_ts_query, _fsql("CASE WHEN len(v) % 2 = 0 THEN v[len(v) // 2 + 1] END")
for _key, _fn in {"g_inc": "increasing_dp", "g_nondec": "non_decreasing_dp", "g_noninc": "non_increasing_dp", "g_dec": "decreasing_dp"}.items():
    QUERIES[_key], ORACLES[_key] = partial(generator_query, GENERATORS[_fn]), _generator_sql(GENERATORS[_fn])
QUERIES["x_powerset"], ORACLES["x_powerset"] = powerset_query, _generator_sql(None, 1)
QUERIES["x_contig"], ORACLES["x_contig"] = contiguous_query, _CONTIG_SQL
QUERIES["x_product"] = QUERIES["j_cross"] = product_query
ORACLES["x_product"] = ORACLES["j_cross"] = f"SELECT a.user_id, a.wk, a.event_id AS a_id, b.event_id AS b_id FROM {_EV_WK} a JOIN {_EV_WK} b USING (user_id, wk) WHERE a.event_type = 'click' AND b.event_type = 'view'"
QUERIES["j_shared"] = shared_join_query
ORACLES["j_shared"] = f"SELECT a.user_id, a.wk, a.event_id AS a_id, b.event_id AS b_id, c.event_id AS c_id FROM {_EV_WK} a JOIN {_EV_WK} b USING (user_id, wk) JOIN {_EV_WK} c USING (user_id, wk) WHERE a.event_type = 'click' AND b.event_type = 'view' AND c.event_type = 'error' AND b.value >= a.value AND c.value >= b.value"
QUERIES["j_interval"] = interval_query
ORACLES["j_interval"] = f"SELECT a.user_id, a.event_id AS a_id, c.event_id AS c_id, q.wk FROM events a JOIN events c USING (user_id) JOIN (SELECT user_id, wk, t[1] AS s, t[len(t)] AS e FROM ({seq_sql()})) q USING (user_id) WHERE a.event_type = 'signup' AND c.event_type = 'purchase' AND c.ts > a.ts AND c.ts <= a.ts + INTERVAL 9 DAY AND q.s >= a.ts AND q.e <= c.ts"
