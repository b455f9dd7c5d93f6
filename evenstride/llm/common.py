"""Helpers shared by the training-data operators: shared storage, cutting lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the ASCII space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
_local_dirs: dict[str, str] = {}
_scopes: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only where that is unset (tests) one of our own."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="evenstride-")
    return _local_dirs[app]


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, kind: str = "cut", **measured: Column) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor loses nothing.

    ``measured``: aggregates of what is written, taken by the same query and found in ``_measured`` of the result.
    """
    spark = df.sparkSession
    path = new_path(spark, kind)
    if measured:
        seen = Observation()
        df = df.observe(seen, *[c.alias(k) for k, c in measured.items()])
    df.write.parquet(path)
    for held in _scopes:
        held.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if measured:
        out._measured = seen.get
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a ``cut`` table that nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        delete(df.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage now. Spark frees the shuffle files and broadcasts of finished queries, and the driver's heap shrinks
    again, only when that happens; between the phases of a long job that is worth the fraction of a second it takes."""
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> str | None:
    """Give back to the system what the driver's JVM has freed outside its heap, which the C library else keeps for each of some hundred
    threads. Returns the JVM's report; None where it can't (Linux, from 17.0.9 on)."""
    new, jvm = spark.sparkContext._gateway.new_array, spark._jvm

    def array(of, items: list):
        out = new(of, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    kind, lang = jvm.java.lang.Class.forName, jvm.java.lang
    takes = array(lang.Class, [kind("javax.management.ObjectName"), kind("java.lang.String"), kind("[Ljava.lang.Object;"), kind("[Ljava.lang.String;")])
    args = [jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", new(lang.Object, 0), new(lang.String, 0)]
    try:
        return kind("javax.management.MBeanServer").getMethod("invoke", takes).invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), array(lang.Object, args))
    except Py4JError:
        return None


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete every table that ``cut`` makes within the block at its end; what should stay must have been written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, component)``, component the smallest node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014); each round is two aggregations and joins, its result is
    written to the shared folder and the previous round's is deleted. Nodes without edges do not occur in the result.
    """
    seen = {"n": F.count(F.lit(1)), "keys": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    cur = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc", **seen)
    state = cur._measured  # edges that are stars already end after one round
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every edge of ``large`` points down already, so small-star needs each node's lower neighbours only
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        nxt = cut(small.select("e.*").where("u <> v").distinct(), "cc", **seen)
        drop_cut(cur)
        new = nxt._measured
        cur = nxt
        tidy(edges.sparkSession)
        if new == state:
            break
        state = new
    tidy(edges.sparkSession)
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select("v", "v").distinct())


def bitmap_filter(df: DataFrame, col: str, keys: DataFrame, key: str, bits: int = 1 << 22) -> DataFrame:
    """Rows of ``df`` whose ``col`` may occur in ``keys[key]``: none that does is lost, a few others pass, so an exact join must follow.

    Keys are hashed into a bitmap of ``bits`` bits, at most ``bits`` / 64 broadcast rows at any scale (65,536 here); with very many keys
    it fills up and filters less, never wrongly. It keeps long texts that a join would drop out of that join's shuffle.
    """
    h = f"pmod(xxhash64({{}}), {bits}L)"
    hk = h.format(f"`{key}`")
    words = keys.where(F.col(key).isNotNull()).groupBy(F.expr(f"shiftright({hk}, 6)").alias("__w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({hk} & 63 as int))")).alias("__bm"))
    hc = h.format(f"`{col}`")
    out = df.withColumn("__w", F.expr(f"shiftright({hc}, 6)")).join(F.broadcast(words), "__w")
    return out.where(F.expr(f"(shiftrightunsigned(__bm, cast({hc} & 63 as int)) & 1L) = 1L")).drop("__w", "__bm")


def grouped_batches(batches, keys: list[str]):
    """Rows of Arrow batches that come sorted by ``keys``, group by group, as pyarrow tables; only one group is held at a time."""
    import numpy as np
    import pyarrow as pa

    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        ends = [*starts[1:], b.num_rows]
        for s, e in zip(starts, ends):
            now = tuple(c[s] for c in cols)
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)
