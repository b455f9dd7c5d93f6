"""Matches as ordinary DataFrames: joins of two patterns, combination joins, dedupe, grouping, ranking, skip strategies, traces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clock import micros
from ..plans.oracle import oracle
from ..plans.spec import Pattern, pattern
from .expand import WEEK_SQL, contained, seq_sql, sequences, spans
from .match import match, starts

DAY = 86400.0
HADOOP = pattern("A B{2,} C", {"A": "signup", "B": "click", "C": "purchase"}, ("B[i] - B[i-1] >= 0",), 3 * DAY, "user_id")
FIRST = pattern("A B", {"A": "signup", "B": "click"}, ("B - A >= 0",), 1 * DAY, "user_id")
SECOND = pattern("C D", {"C": "view", "D": "purchase"}, ("D - C >= 0",), 1 * DAY, "user_id")


def join_patterns(left: DataFrame, right: DataFrame, key: str, within_us: int) -> DataFrame:
    """Matches of one pattern followed by matches of another within a window: key and bucket equality with the order as residual."""
    w = within_us
    a = left.withColumnRenamed("first_us", "f1").withColumnRenamed("last_us", "l1").withColumn("bucket", F.explode(F.expr(f"array(f1 div {w}, f1 div {w} + 1)")))
    b = right.withColumnRenamed("first_us", "f2").withColumnRenamed("last_us", "l2").withColumn("bucket", F.expr(f"f2 div {w}"))
    return a.join(b, [key, "bucket"]).where(f"f2 > l1 and l2 - f1 <= {w}").drop("bucket", "f1", "l1", "f2", "l2")


def skip_past_last(matches: DataFrame, key: str) -> DataFrame:
    """Of each key's matches in order of (first_us, last_us) those that start after the last kept one ended.

    Matches are dealt and sorted by key; a task goes through a key's rows once and holds one time stamp, whatever their number.
    """
    at = [matches.columns.index(c) for c in (key, "first_us", "last_us")]

    def run(batches) -> Iterator:
        now, end = object(), 0
        for b in batches:
            keep = []
            for i, (k, f, u) in enumerate(zip(*(b.column(x).to_pylist() for x in at))):
                if k != now or f > end:
                    keep.append(i)
                    now, end = k, u
            yield b.take(keep) if keep else b.slice(0, 0)

    return matches.repartition(key).sortWithinPartitions(key, "first_us", "last_us", *[c for c in matches.columns if c not in (key, "first_us", "last_us")]).mapInArrow(run, matches.schema)


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _hadoop(spark, sf_dir):
    return match(_ev(spark, sf_dir), HADOOP)


def j_two_nfa(spark, sf_dir):
    e = _ev(spark, sf_dir)
    return join_patterns(match(e, FIRST), match(e, SECOND), "user_id", int(2 * DAY * 1e6))


def j_filter(spark, sf_dir):
    """Rows of combinations whose variables a solved constraint keeps: a semi-join."""
    s = sequences(spark, sf_dir)
    good = s.where(F.expr("aggregate(a, 0D, (t, x) -> t + x.value) / size(a) >= 60")).select("user_id", "wk")
    return s.withColumn("x", F.explode("a")).select("user_id", "wk", F.col("x.event_id").alias("event_id")).join(good, ["user_id", "wk"], "left_semi")


def j_extend(spark, sf_dir):
    """Combinations of clicks extended by a view of the same week that is at least the last click."""
    s = sequences(spark, sf_dir).join(sequences(spark, sf_dir, "view").withColumnRenamed("a", "b"), ["user_id", "wk"])
    return s.withColumn("y", F.explode(F.expr("filter(b, y -> y.value >= get(a, size(a) - 1).value)"))).select("user_id", "wk", F.col("y.event_id").alias("b_id"), F.size("a").cast("long").alias("n"))


def x_missing(spark, sf_dir):
    """A variable without constraints is carried as its whole run."""
    s = sequences(spark, sf_dir).join(sequences(spark, sf_dir, "view").withColumnRenamed("a", "b"), ["user_id", "wk"])
    s = s.withColumn("x", F.explode("a")).where("x.value > 50")
    return s.select("user_id", "wk", F.col("x.event_id").alias("a_id"), F.expr("array_join(transform(b, y -> cast(y.event_id as string)), ',')").alias("b_ids"))


def x_shared_once(spark, sf_dir):
    """Combinations solved once per key, then joined to every anchor pair whose interval holds them."""
    s = sequences(spark, sf_dir).withColumn("p", F.explode(F.expr("flatten(transform(sequence(1, size(a)), i -> transform(sequence(1, size(a) - i + 1), k -> slice(a, i, k))))")))
    combos = s.where("size(p) >= 2 and aggregate(p, 0D, (t, x) -> t + x.value) / size(p) >= 50").select("user_id", F.expr("p[0].ts").alias("s"), F.expr("get(p, size(p) - 1).ts").alias("e"), F.expr("array_join(transform(p, x -> cast(x.event_id as string)), ',')").alias("ids"))
    base = spans(_ev(spark, sf_dir), "signup", "purchase", 4)
    return contained(base, combos, 4, strict=True).select("user_id", "a_id", "c_id", "ids")


def distinct_matches(spark, sf_dir):
    return _hadoop(spark, sf_dir).select("user_id", "a_id", "c_id").dropDuplicates()


def approx_matches(spark, sf_dir):
    return _hadoop(spark, sf_dir).agg(F.approx_count_distinct(F.xxhash64("user_id", "a_id", "b_ids", "c_id"), 0.01).alias("matches"))


def m_group_by_key(spark, sf_dir):
    return _hadoop(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.size(F.split("b_ids", ","))).cast("long").alias("longest"))


def m_rollup(spark, sf_dir):
    return _hadoop(spark, sf_dir).withColumn("len", F.size(F.split("b_ids", ",")).cast("long")).rollup("user_id", "len").agg(F.count("*").alias("n"))


def m_rank(spark, sf_dir):
    m = _hadoop(spark, sf_dir).withColumn("span", F.col("last_us") - F.col("first_us"))
    return m.select("user_id", "a_id", "b_ids", "c_id", F.rank().over(Window.partitionBy("user_id").orderBy("span")).cast("long").alias("place"))


def m_topk(spark, sf_dir):
    """The ten matches with the shortest span (a top-k report)."""
    m = _hadoop(spark, sf_dir).withColumn("span", F.col("last_us") - F.col("first_us"))
    return m.orderBy("span", "user_id", "a_id", "b_ids").limit(10).select("user_id", "a_id", "b_ids", "c_id", "span")


def m_skip_past_last(spark, sf_dir):
    return skip_past_last(match(_ev(spark, sf_dir), FIRST), "user_id").select("user_id", "a_id", "b_id")


def trace(events: DataFrame, p: Pattern) -> DataFrame:
    """At each event, the number of partial matches its key holds open: events of the first variable (with its own tests) whose window
    the event still lies in, itself included. The first variable must be single; what has expired isn't counted."""
    at = events.select(F.col(p.key).alias("__key"), "event_id", micros(events).alias("us"))
    opened = starts(events, p).select("__key", F.col("event_id").alias("__start"))
    at = at.join(opened, (at["event_id"] == opened["__start"]) & at["__key"].eqNullSafe(opened["__key"]), "left").select(at["__key"], "event_id", "us", "__start")
    w = Window.partitionBy("__key").orderBy("us").rangeBetween(-int(round(p.within * 1e6)), 0)
    return at.select(F.col("__key").alias(p.key), "event_id", F.count("__start").over(w).alias("nums"))


def trace_partials(spark, sf_dir):
    return trace(_ev(spark, sf_dir), HADOOP).select("event_id", "nums")


_H = oracle(HADOOP)
_HS = f"SELECT m.*, epoch_us(c.ts) - epoch_us(a.ts) AS span FROM ({_H}) m JOIN events a ON a.event_id = m.a_id JOIN events c ON c.event_id = m.c_id"
_VIEWS = seq_sql("view")
_EVW = f"(SELECT *, {WEEK_SQL} AS wk FROM events)"
ORACLES: dict[str, str] = {
    "j_two_nfa": "SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id, c.event_id AS c_id, d.event_id AS d_id FROM events a JOIN events b USING (user_id) JOIN events c USING (user_id) JOIN events d USING (user_id) WHERE a.event_type = 'signup' AND b.event_type = 'click' AND c.event_type = 'view' AND d.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 DAY AND c.ts > b.ts AND d.ts > c.ts AND d.ts <= c.ts + INTERVAL 1 DAY AND d.ts <= a.ts + INTERVAL 2 DAY AND b.value >= a.value AND d.value >= c.value",
    "j_filter": f"SELECT user_id, wk, unnest(ids) AS event_id FROM ({seq_sql()}) WHERE list_avg(v) >= 60",
    "j_extend": f"SELECT s.user_id, s.wk, e.event_id AS b_id, len(s.v) AS n FROM ({seq_sql()}) s JOIN {_EVW} e USING (user_id, wk) WHERE e.event_type = 'view' AND e.value >= s.v[len(s.v)]",
    "x_missing": f"SELECT e.user_id, e.wk, e.event_id AS a_id, array_to_string(s.ids, ',') AS b_ids FROM ({_VIEWS}) s JOIN {_EVW} e USING (user_id, wk) WHERE e.event_type = 'click' AND e.value > 50",
    "x_shared_once": f"SELECT a.user_id, a.event_id AS a_id, c.event_id AS c_id, array_to_string(q.p, ',') AS ids FROM events a JOIN events c USING (user_id) JOIN (SELECT user_id, ids[i:j] AS p, t[i] AS s, t[j] AS e, v[i:j] AS w FROM (SELECT *, unnest(range(i + 1, len(v) + 1)) AS j FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM ({seq_sql()})))) q USING (user_id) WHERE a.event_type = 'signup' AND c.event_type = 'purchase' AND c.ts > a.ts AND c.ts <= a.ts + INTERVAL 4 DAY AND list_avg(q.w) >= 50 AND q.s > a.ts AND q.e < c.ts",
    "distinct_matches": f"SELECT DISTINCT user_id, a_id, c_id FROM ({_H})",
    "m_group_by_key": f"SELECT user_id, count(*) AS n, max(len(string_split(b_ids, ','))) AS longest FROM ({_H}) GROUP BY user_id",
    "m_rollup": f"SELECT user_id, len, count(*) AS n FROM (SELECT user_id, len(string_split(b_ids, ',')) AS len FROM ({_H})) GROUP BY ROLLUP (user_id, len)",
    "m_rank": f"SELECT user_id, a_id, b_ids, c_id, rank() OVER (PARTITION BY user_id ORDER BY span) AS place FROM ({_HS})",
    "m_topk": f"SELECT user_id, a_id, b_ids, c_id, span FROM ({_HS}) ORDER BY span, user_id, a_id, b_ids LIMIT 10",
    "trace_partials": "SELECT event_id, (SELECT count(*) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'signup' AND p.ts <= e.ts AND p.ts >= e.ts - INTERVAL 3 DAY) AS nums FROM events e",
    "m_skip_past_last": f"""WITH RECURSIVE m AS (SELECT f.*, epoch_us(a.ts) AS first, epoch_us(b.ts) AS last FROM ({oracle(FIRST)}) f JOIN events a ON a.event_id = f.a_id JOIN events b ON b.event_id = f.b_id),
k AS (SELECT * FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY first, last, a_id, b_id) = 1)
UNION ALL SELECT * FROM (SELECT m.* FROM k JOIN m ON m.user_id = k.user_id AND m.first > k.last QUALIFY row_number() OVER (PARTITION BY m.user_id ORDER BY m.first, m.last, m.a_id, m.b_id) = 1))
SELECT user_id, a_id, b_id FROM k""",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: globals()[k] for k in [*ORACLES, "approx_matches"]}
