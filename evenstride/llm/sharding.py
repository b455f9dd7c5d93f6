"""Sharding: longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def lpt(sizes: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Largest item first, each to the least-loaded shard (the smallest number on a tie), by a heap."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(heap)
        out[key] = s
        heapq.heappush(heap, (load + size, s))
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16, bundles: int = 8192, slot_rows: int = 4096) -> DataFrame:
    """Put documents into ``shards`` shards of near equal bytes; documents with equal texts stay together.

    A group's size is the sum of its documents' UTF-8 bytes plus ``overhead`` each. Groups larger than 1/``bundles`` of the whole are
    scheduled one by one; there are fewer than ``bundles`` of them at any scale. All other groups are pooled by a hash of their key
    into ``bundles`` bundles, which are scheduled like groups. So the heap sees at most 2 * ``bundles`` items, both maps have that size
    bound (they are broadcast), and no shard is off by more than about one item. A single group above a shard's share stays whole.
    ``slot`` numbers a shard's rows from 0: rows of a shard are dealt into parts of about ``slot_rows`` by a hash of doc_id, numbered
    within parts and offset by the parts before, so that no task gets a whole shard.

    Nulls: a null text has 0 bytes, checksum 0 and forms one group (apart from the empty text). Null or repeated doc_ids are kept, one
    row each. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    base = cut(docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.substring(F.concat(F.when(F.col("text").isNull(), F.lit("00")).otherwise(F.lit("01")), F.sha2(text, 256)), 1, 42)).alias("k"),
    ), "shard")
    groups = base.groupBy("k").agg(F.sum("size").alias("bytes"))
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    heavy = F.col("bytes") * bundles > F.lit(total)
    bundle = F.pmod(F.xxhash64("k"), F.lit(bundles)).cast("int")
    big = groups.where(heavy).select(F.hex("k").alias("k"), "bytes").collect()  # fewer than ``bundles`` rows
    small = groups.where(~heavy).groupBy(bundle.alias("b")).agg(F.sum("bytes").alias("bytes")).collect()  # at most ``bundles`` rows
    where = lpt([(r.bytes, r.k) for r in big] + [(r.bytes, f"b{r.b}") for r in small], shards)
    heavy_map = spark.createDataFrame([(bytearray.fromhex(r.k), where[r.k]) for r in big], "k binary, hs int")
    light_map = spark.createDataFrame([(r.b, where[f"b{r.b}"]) for r in small], "b int, ls int")
    placed = (
        base.join(F.broadcast(heavy_map), "k", "left")
        .withColumn("b", bundle)
        .join(F.broadcast(light_map), "b", "left")
        .withColumn("shard", F.coalesce("hs", "ls"))
        .withColumn("part", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("slot")), F.lit(max(1, -(-rows // (shards * slot_rows))))))
    )
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    w = Window.partitionBy("shard", "part").orderBy("doc_id", "k")
    return (
        placed.withColumn("rn", F.row_number().over(w))
        .join(before, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rn") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
