"""Queries over sources and generators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import generators as gen
from ..functions.clock import micros
from .readers import offset_time, reshape_prices, unpivot_prices


def _ev(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def scan_events(spark, sf_dir):
    return _ev(spark, sf_dir).where("value > 60").select("event_id", "user_id", "event_type", "value")


def source_unpivot(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ident = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return unpivot_prices(li, {"LOW": "l_discount", "HIGH": "l_tax", "CLOSE": "l_extendedprice"}, F.col("l_shipdate"), ident).select("event_id", "event_type", "value")


def source_project(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("event_id"), micros(o, "o_orderdate").alias("us"), F.col("o_orderstatus").alias("event_type"), F.col("o_totalprice").alias("value"))


def source_offset_ts(spark, sf_dir):
    timed = _ev(spark, sf_dir).select("event_id", offset_time(F.col("event_id")).alias("ts"))
    return timed.select("event_id", micros(timed).alias("us"))


def reshape(spark, sf_dir):
    """Events as daily-price rows: the value is the opening and closing price, 50 bounds peak and low."""
    e = _ev(spark, sf_dir).withColumns({"peak": F.greatest("value", F.lit(50.0)), "low": F.least("value", F.lit(50.0))})
    return reshape_prices(e, {"ticker": "event_type", "timestamp": "ts", "open_price": "value", "peak_price": "peak", "lowest_price": "low", "close_price": "value", "volume": "user_id"})


def gen_distribution(spark, sf_dir):
    return gen.distribution_events(spark, {"A": ("uniform", 0, 10), "B": ("normal", 5, 2), "C": ("exponential", 3, 1)}, 1000, kleene=("B",))


def gen_mixture(spark, sf_dir):
    return gen.mixture_events(spark, ["A", "B"], (0, 10), [20, 7], 0.1, 1000)


def gen_weighted(spark, sf_dir):
    return gen.weighted_events(spark, {"a": 0.2, "b": 0.2, "c": 0.6}, {"a": (1, 100), "b": (1, 100), "c": (200, 300)}, 1000)


def gen_hadoop(spark, sf_dir):
    return gen.hadoop_events(spark, 1000)


def gen_causal(spark, sf_dir):
    return gen.causal_events(spark, 1000)


ORACLES: dict[str, str] = {
    "scan_events": "SELECT event_id, user_id, event_type, value FROM events WHERE value > 60",
    "source_unpivot": "SELECT (l_orderkey * 8 + l_linenumber) * 3 + i AS event_id, ['LOW', 'HIGH', 'CLOSE'][i + 1] AS event_type, [l_discount, l_tax, l_extendedprice][i + 1] AS value FROM lineitem, range(3) r(i)",
    "source_project": "SELECT o_orderkey AS event_id, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS us, o_orderstatus AS event_type, o_totalprice AS value FROM orders",
    "source_offset_ts": "SELECT event_id, epoch_us(TIMESTAMP '2025-11-11 11:11:11') + event_id * 1000000 AS us FROM events",
    "reshape": "SELECT event_type AS ticker, epoch_us(ts) // 1000 AS timestamp, value AS open_price, greatest(value, 50) AS peak_price, least(value, 50) AS lowest_price, value AS close_price, CAST(user_id AS DOUBLE) AS volume FROM events",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: globals()[k] for k in [*ORACLES, "gen_distribution", "gen_mixture", "gen_weighted", "gen_hadoop", "gen_causal"]}
