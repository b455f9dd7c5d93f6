"""Data preparation around patterns: set operations, differences, rolling sums, runs, forward thresholds, precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clock import micros


def union_sorted(a: DataFrame, b: DataFrame, *order: str) -> DataFrame:
    return a.unionByName(b).orderBy(*order)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of one of two inputs only."""
    return a.exceptAll(b).distinct().unionByName(b.exceptAll(a).distinct())


def differences(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``diff`` and ``pct`` (change relative to the row before; null where that is 0 or missing)."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("diff", F.col(value) - before).withColumn("pct", F.when(before != 0, (F.col(value) - before) / before))


def rolling_sum(df: DataFrame, key: str, order: list[str], value: str, rows: int) -> DataFrame:
    """Sum of the last ``rows`` rows; null until there are so many."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - rows, 0)
    return df.withColumn("rolling", F.when(F.count(value).over(w) == rows, F.sum(value).over(w)))


def runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Maximal runs of rises or falls per key as ``(key, run, direction, n, first_id, last_id)``: gaps and islands on the sign of the change."""
    w = Window.partitionBy(key).orderBy(*order)
    d = df.withColumn("sign", F.sign(F.col(value) - F.lag(value).over(w)).cast("int")).where("sign is not null")
    d = d.withColumn("new", F.when(F.lag("sign").over(w).eqNullSafe(F.col("sign")), 0).otherwise(1))
    d = d.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "run").agg(F.first("sign").alias("direction"), F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def find_increases(df: DataFrame, key: str, factor: float, days: float) -> DataFrame:
    """Pairs where a value is at least ``factor`` times an earlier one of its key within ``days``.

    An equi-join on key and day-wide bucket (each left row looks into the buckets its window reaches), with the rest as residual.
    """
    span = int(days * 86_400_000_000)
    us = micros(df)
    a = df.select(key, F.col("event_id").alias("a_id"), F.col("value").alias("av"), us.alias("au"))
    a = a.withColumn("bucket", F.explode(F.expr(f"array(au div {span}, au div {span} + 1)")))
    b = df.select(key, F.col("event_id").alias("b_id"), F.col("value").alias("bv"), us.alias("bu")).withColumn("bucket", F.expr(f"bu div {span}"))
    return a.join(b, [key, "bucket"]).where((F.col("bu") > F.col("au")) & (F.col("bu") - F.col("au") <= span) & (F.col("bv") >= factor * F.col("av"))).select(key, "a_id", "b_id")


def precision(found: DataFrame, golden: DataFrame, on: list[str]) -> DataFrame:
    """``(tp, fp, precision)`` of found records against golden ones."""
    g = golden.select(*on).distinct().withColumn("hit", F.lit(1))
    j = found.select(*on).join(g, on, "left")
    tp = F.coalesce(F.sum("hit"), F.lit(0))
    return j.agg(tp.alias("tp"), (F.count("*") - tp).alias("fp"), F.when(F.count("*") > 0, F.round(tp / F.count("*"), 6)).alias("precision"))


def safe_log(df: DataFrame, value: str) -> DataFrame:
    """Natural log with rows dropped where it isn't finite."""
    return df.withColumn("log", F.when(F.col(value) > 0, F.log(value))).where(F.col("log").isNotNull() & ~F.isnan("log"))


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


_ORDER = ["ts", "event_id"]


def p_union_sort(spark, sf_dir):
    e = _ev(spark, sf_dir).select("event_id", "user_id", "event_type", "value")
    return union_sorted(e.where("event_type = 'click' and value > 50"), e.where("event_type = 'error'"), "event_id")


def p_intersect(spark, sf_dir):
    e = _ev(spark, sf_dir)
    return e.where("event_type = 'click' and value > 80").select("user_id").intersect(e.where("event_type = 'error' and value > 80").select("user_id"))


def p_except(spark, sf_dir):
    e = _ev(spark, sf_dir)
    return symmetric_difference(e.where("event_type = 'click' and value > 100").select("user_id"), e.where("event_type = 'error' and value > 100").select("user_id"))


def p_distinct(spark, sf_dir):
    return _ev(spark, sf_dir).where("value > 90").select("user_id", "event_type").dropDuplicates()


def p_filter(spark, sf_dir):
    return _ev(spark, sf_dir).where(F.col("event_type").isin("click", "view") & F.col("ts").between("2024-01-05", "2024-01-12") & (F.col("value") > 20)).select("event_id", "user_id", "value")


def p_diff(spark, sf_dir):
    return differences(_ev(spark, sf_dir), "user_id", _ORDER, "value").select("event_id", F.round("diff", 6).alias("diff"))


def p_pct(spark, sf_dir):
    return differences(_ev(spark, sf_dir), "user_id", _ORDER, "value").select("event_id", F.round("pct", 6).alias("pct"))


def p_rolling(spark, sf_dir):
    return rolling_sum(_ev(spark, sf_dir), "user_id", _ORDER, "value", 5).select("event_id", F.round("rolling", 4).alias("rolling"))


def p_group_count(spark, sf_dir):
    return _ev(spark, sf_dir).groupBy("user_id").agg(F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).alias("high"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"))


def p_group_mean(spark, sf_dir):
    return _ev(spark, sf_dir).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"))


def p_value_counts(spark, sf_dir):
    return _ev(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def p_top1(spark, sf_dir):
    """Each user's event with the largest value (the first on a tie)."""
    return _ev(spark, sf_dir).groupBy("user_id").agg(F.max(F.struct("value", (-F.col("event_id")).alias("neg"))).alias("m")).select("user_id", F.col("m.value").alias("value"), (-F.col("m.neg")).alias("event_id"))


def p_runs(spark, sf_dir):
    return runs(_ev(spark, sf_dir), "user_id", _ORDER, "value").select("user_id", "direction", "n", "first_id", "last_id")


def p_longest(spark, sf_dir):
    r = runs(_ev(spark, sf_dir), "user_id", _ORDER, "value")
    return r.groupBy("user_id").agg(F.max(F.struct("n", (-F.col("first_id")).alias("neg"))).alias("m")).select("user_id", F.col("m.n").alias("n"), (-F.col("m.neg")).alias("first_id"))


def p_find_increase(spark, sf_dir):
    return find_increases(_ev(spark, sf_dir).where("event_type = 'click'"), "user_id", 1.5, 2)


def p_precision(spark, sf_dir):
    e = _ev(spark, sf_dir)
    return precision(e.where("event_type = 'click' and value > 30"), e.where("value > 60"), ["event_id"])


def p_log(spark, sf_dir):
    return safe_log(_ev(spark, sf_dir), "value").select("event_id", F.round("log", 6).alias("log"))


def j_inner(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("o_custkey", "l_orderkey", "l_linenumber", "l_quantity")


def j_range_self(spark, sf_dir):
    return find_increases(_ev(spark, sf_dir).where("event_type in ('click', 'view')"), "user_id", 2.0, 0.5)


_LAG = "lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)"
_RUNS = f"""WITH d AS (SELECT *, CAST(sign(value - {_LAG}) AS INTEGER) AS s FROM events), e AS (SELECT *, CASE WHEN lag(s) OVER w IS NOT DISTINCT FROM s THEN 0 ELSE 1 END AS nw FROM d WHERE s IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e), g AS (SELECT user_id, run, min(s) AS direction, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM r GROUP BY user_id, run)"""
ORACLES: dict[str, str] = {
    "p_union_sort": "SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'click' AND value > 50 UNION ALL SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'error'",
    "p_intersect": "SELECT user_id FROM events WHERE event_type = 'click' AND value > 80 INTERSECT SELECT user_id FROM events WHERE event_type = 'error' AND value > 80",
    "p_except": "SELECT * FROM ((SELECT user_id FROM events WHERE event_type = 'click' AND value > 100 EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'error' AND value > 100) UNION (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100 EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'click' AND value > 100))",
    "p_distinct": "SELECT DISTINCT user_id, event_type FROM events WHERE value > 90",
    "p_filter": "SELECT event_id, user_id, value FROM events WHERE event_type IN ('click', 'view') AND ts BETWEEN '2024-01-05' AND '2024-01-12' AND value > 20",
    "p_diff": f"SELECT event_id, round(value - {_LAG}, 6) AS diff FROM events",
    "p_pct": f"SELECT event_id, round(CASE WHEN {_LAG} <> 0 THEN (value - {_LAG}) / {_LAG} END, 6) AS pct FROM events",
    "p_rolling": "SELECT event_id, round(CASE WHEN count(value) OVER w = 5 THEN sum(value) OVER w END, 4) AS rolling FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    "p_group_count": "SELECT user_id, count(*) FILTER (value > 50) AS high, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id",
    "p_group_mean": "SELECT event_type, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type",
    "p_value_counts": "SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY event_type",
    "p_top1": "SELECT user_id, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1",
    "p_runs": _RUNS + " SELECT user_id, direction, n, first_id, last_id FROM g",
    "p_longest": _RUNS + " SELECT user_id, n, first_id FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_id) = 1",
    "p_find_increase": "SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 DAY AND b.value >= 1.5 * a.value WHERE a.event_type = 'click' AND b.event_type = 'click'",
    "p_precision": "SELECT count(*) FILTER (value > 60) AS tp, count(*) FILTER (value <= 60) AS fp, round(count(*) FILTER (value > 60) / count(*), 6) AS precision FROM events WHERE event_type = 'click' AND value > 30",
    "p_log": "SELECT event_id, round(ln(value), 6) AS log FROM events WHERE value > 0",
    "j_inner": "SELECT o_custkey, l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45",
    "j_range_self": "SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR AND b.value >= 2.0 * a.value WHERE a.event_type IN ('click', 'view') AND b.event_type IN ('click', 'view')",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: globals()[k] for k in ORACLES}
