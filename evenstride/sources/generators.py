"""Synthetic event streams, made in parallel from ``range`` with seeded hashes (so reruns and lost executors give the same rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clock import at_second

#: When synthetic streams start.
START = "2024-01-01 00:00:00"

def uniform(seed: int, *of: str) -> Column:
    """A number in (0, 1) that depends on the row's columns and the seed only."""
    return (F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def normal(seed: int, *of: str) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, *of))) * F.cos(2 * F.lit(3.141592653589793) * uniform(seed + 1, *of))


def exponential(seed: int, *of: str) -> Column:
    return -F.log(uniform(seed, *of))


def distribution_events(spark: SparkSession, variables: dict[str, tuple[str, float, float]], n: int, seed: int = 1, kleene: tuple[str, ...] = ()) -> DataFrame:
    """``n`` events of each variable: uniform (low, high), normal (mean, sd) or exponential (scale, offset) values; Kleene variables come
    every 1-2 s, others every 10-30 s."""
    parts = None
    for i, (name, (kind, a, b)) in enumerate(sorted(variables.items())):
        low, high = (1, 2) if name in kleene else (10, 30)
        s = seed + 100 * i
        value = {"uniform": a + (b - a) * uniform(s, "id"), "normal": a + b * normal(s, "id"), "exponential": b + a * exponential(s, "id")}[kind]
        gap = low + (high - low) * 0.5
        ts = at_second(F.col("id") * gap + (uniform(s + 7, "id") - 0.5) * (high - low), START)
        one = spark.range(n).select((F.col("id") * len(variables) + i).alias("event_id"), ts.alias("ts"), F.lit(name).alias("event_type"), value.alias("value"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def mixture_events(spark: SparkSession, names: list[str], normal_range: tuple[float, float], matched: list[float], probability: float, n: int, seed: int = 1) -> DataFrame:
    """Rows of one event per name: with ``probability`` the matched values, else uniform normal ones."""
    hit = uniform(seed, "id") < probability
    vals = [F.struct(F.lit(i).alias("at"), F.lit(t).alias("event_type"), F.when(hit, F.lit(float(matched[i]))).otherwise(normal_range[0] + (normal_range[1] - normal_range[0]) * uniform(seed + 1 + i, "id")).alias("value")) for i, t in enumerate(names)]
    k = len(names)
    return spark.range(n).select("id", F.explode(F.array(*vals)).alias("e")).select((F.col("id") * k + F.col("e.at")).alias("event_id"), at_second(F.col("id") * k + F.col("e.at"), START).alias("ts"), "e.event_type", "e.value")


def weighted_events(spark: SparkSession, weights: dict[str, float], ranges: dict[str, tuple[float, float]], n: int, seed: int = 1, step: int = 1) -> DataFrame:
    """``n`` events ``step`` seconds apart; types by cumulative weight, values uniform in the type's range."""
    total, cum, u = sum(weights.values()), 0.0, uniform(seed, "id")
    kind: Column | None = None
    value: Column | None = None
    for t, w in weights.items():
        cum += w / total
        low, high = ranges[t]
        v = low + (high - low) * uniform(seed + 1, "id")
        kind = F.when(u < cum, t) if kind is None else kind.when(u < cum, t)
        value = F.when(u < cum, v) if value is None else value.when(u < cum, v)
    last = list(weights)[-1]
    return spark.range(n).select(F.col("id").alias("event_id"), at_second(F.col("id") * step, START).alias("ts"), kind.otherwise(last).alias("event_type"), value.otherwise(ranges[last][0]).alias("value"))


# Log types in the order of their numeric codes, and the largest value of each (the smallest is 1).
HADOOP_TYPES = {"reducer_start": 1000, "load_std": 100, "reducer_end": 1000, "map_start": 1000, "map_end": 1000, "shuffle_start": 100, "shuffle_end": 100}
# Type weights and value ranges of the two other presets of ``weighted_events``.
LNG = {"weights": {"a": 0.2, "b": 0.2, "c": 0.6}, "ranges": {"a": (1, 100), "b": (1, 100), "c": (200, 300)}}
FLASH = {"weights": {"a": 0.3, "b": 0.4, "c": 0.3}, "ranges": {"a": (90, 110), "b": (50, 100), "c": (100, 150)}}


def hadoop_events(spark: SparkSession, n: int, series: int = 8, seed: int = 1) -> DataFrame:
    """Cluster log events of seven types with whole values and gaps of 1-5 s, in ``series`` independent series (one running sum each).

    ``code``: the type's number; ``seconds``: since the series began (with them, the rows are those of a headerless stream file).
    """
    names, most = F.array(*[F.lit(t) for t in HADOOP_TYPES]), F.array(*[F.lit(m) for m in HADOOP_TYPES.values()])
    at = F.floor(uniform(seed, "id") * len(HADOOP_TYPES)).cast("int")
    df = spark.range(n).withColumn("series", F.col("id") % series).withColumn("code", at).withColumn("gap", 1 + F.floor(uniform(seed + 1, "id") * 5))
    df = df.withColumn("seconds", F.sum("gap").over(Window.partitionBy("series").orderBy("id")))
    value = 1 + F.floor(F.get(most, F.col("code")) * uniform(seed + 2, "id"))
    return df.select(F.col("id").alias("event_id"), at_second(F.col("seconds"), START).alias("ts"), F.get(names, F.col("code")).alias("event_type"), value.cast("double").alias("value"), "series", "code", "seconds")


def causal_events(spark: SparkSession, n: int, series: int = 4, seed: int = 1) -> DataFrame:
    """Events of two variables, ``n`` of each, a second apart: A is 10 plus an autoregression (0.999) with bursts of +50 over 4-10 steps
    that leave the recurrence itself alone, B = 2 A + noise; B arrives just before the A that caused it.

    Each series is a recurrence, so one group function makes it; series run in parallel.
    """
    def run(key, pdf):
        import numpy as np
        import pandas as pd

        r = np.random.RandomState(seed + int(key[0]))
        x, out, burst = 0.0, [], 0
        for _ in range(len(pdf)):
            if burst == 0 and r.rand() < 0.01:
                burst = r.randint(4, 11)
            x = 0.999 * x + r.standard_normal()
            out.append(10 + x + (50 if burst > 0 else 0))
            burst = max(0, burst - 1)
        xs = np.array(out)
        both = np.stack([2 * xs + r.standard_normal(len(xs)), xs], 1).ravel()
        step = np.repeat(np.arange(len(xs)), 2)
        return pd.DataFrame({"series": int(key[0]), "step": step, "event_type": ["B", "A"] * len(xs), "value": both})

    made = spark.range(n).withColumn("series", F.col("id") % series).groupBy("series").applyInPandas(run, "series long, step long, event_type string, value double")
    number = (F.col("step") * series + F.col("series")) * 2 + (F.col("event_type") == "A").cast("long")
    return made.select(number.alias("event_id"), at_second(F.col("step"), START).alias("ts"), "event_type", "value", "series")
