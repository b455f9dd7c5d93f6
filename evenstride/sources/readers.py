"""Event sources as batch and streaming DataFrames of ``(event_id, ts, event_type, value)``, and sinks of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import at_second, micros

#: Where headerless stream files count seconds from.
STREAM_START = "2025-11-11 11:11:11"
EVENT_CSV = "type string, value double, timestamp string"
OHLC_CSV = "Date string, Low double, Open double, Volume double, High double, Close double, `Adjusted Close` double, Name string"
STREAM_FILE = "id long, ts_offset long, type string, grp long, value double"


def _numbered(df: DataFrame) -> DataFrame:
    """Give rows an event_id that grows with their place in the input (split by split), without a global sort."""
    return df.withColumn("event_id", F.monotonically_increasing_id())


def read_event_csv(spark: SparkSession, path: str) -> DataFrame:
    """``type,value,timestamp`` with a header, ``yyyy-MM-dd HH:mm:ss`` in UTC; ids follow the rows."""
    df = spark.read.csv(path, schema=EVENT_CSV, header=True, ignoreTrailingWhiteSpace=True, ignoreLeadingWhiteSpace=True)
    return _numbered(df).select("event_id", F.to_timestamp_ntz("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), F.col("type").alias("event_type"), "value").where("event_type is not null")


def unpivot_prices(df: DataFrame, names: dict[str, str], ts, ident) -> DataFrame:
    """A wide row as one event per price column, in that order: ids are three (or so) to a row, so the order within a row is kept."""
    parts = [F.struct(F.lit(i).alias("at"), F.lit(t).alias("event_type"), F.col(c).cast("double").alias("value")) for i, (t, c) in enumerate(names.items())]
    x = df.withColumn("__ts", ts).withColumn("__id", ident).withColumn("__e", F.explode(F.array(*parts)))
    return x.select((F.col("__id") * len(names) + F.col("__e.at")).alias("event_id"), F.col("__ts").alias("ts"), F.col("__e.event_type").alias("event_type"), F.col("__e.value").alias("value"))


def read_ohlc_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily prices: each row becomes LOW, HIGH and CLOSE events of its day."""
    df = spark.read.csv(path, schema=OHLC_CSV, header=True)
    return unpivot_prices(df, {"LOW": "Low", "HIGH": "High", "CLOSE": "Close"}, F.col("Date").cast("date").cast("timestamp_ntz"), F.monotonically_increasing_id())


def read_symbol_csv(spark: SparkSession, path: str) -> DataFrame:
    """Prices of several symbols (column Type): an event per row with the closing price."""
    df = spark.read.csv(path, header=True)
    return _numbered(df).select("event_id", F.col("Date").cast("date").cast("timestamp_ntz").alias("ts"), F.col("Type").alias("event_type"), F.col("Close").cast("double").alias("value"))


def read_stream_file(spark: SparkSession, path: str, start: str = STREAM_START) -> DataFrame:
    """Headerless ``id, offset, type, group, value`` lines: time is ``start`` plus id seconds."""
    df = spark.read.csv(path, schema=STREAM_FILE, header=False, ignoreLeadingWhiteSpace=True)
    return df.select(F.col("id").alias("event_id"), offset_time(F.col("id"), start).alias("ts"), F.trim("type").alias("event_type"), "value", "grp")


def offset_time(seconds, start: str = STREAM_START):
    return at_second(seconds, start)


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of event CSV files as a stream; ``files_per_trigger`` limits its rate."""
    df = spark.readStream.schema(EVENT_CSV).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(path)
    return df.select(F.xxhash64("type", "value", "timestamp").alias("event_id"), F.to_timestamp("timestamp").alias("ts"), F.col("type").alias("event_type"), "value")


#: Columns of reshaped prices and what they are called in price files.
RESHAPED = {"ticker": "Name", "timestamp": "Date", "open_price": "Open", "peak_price": "High", "lowest_price": "Low", "close_price": "Close", "volume": "Volume"}


def reshape_prices(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Price rows as ``(ticker, timestamp, open_price, peak_price, lowest_price, close_price, volume)``, the date as whole epoch milliseconds.

    ``names``: where the input calls a column otherwise than ``RESHAPED``. A date given as text is ``yyyy-MM-dd``.
    """
    names = RESHAPED | (names or {})
    df = df.withColumn("__ts", F.col(names["timestamp"]).cast("timestamp_ntz"))
    ms = F.floor(micros(df, "__ts") / 1000).cast("long")
    return df.select(F.col(names["ticker"]).alias("ticker"), ms.alias("timestamp"), *[F.col(names[c]).cast("double").alias(c) for c in list(RESHAPED)[2:]])


def write_metrics(spark: SparkSession, path: str, **row) -> None:
    """Append one row of a run's figures (such as window_time, selection_strategy, engine, handle_time, matches, memory_usage) as CSV."""
    spark.createDataFrame([tuple(row.values())], list(row)).coalesce(1).write.mode("append").option("header", True).csv(path)


def write_matches(matches: DataFrame, path: str, form: str = "parquet") -> None:
    """Matches to a table (parquet, csv or json)."""
    getattr(matches.write.mode("overwrite"), form)(path)


def console(matches: DataFrame):
    """A streaming query that prints matches."""
    return matches.writeStream.format("console").outputMode("append").start()
