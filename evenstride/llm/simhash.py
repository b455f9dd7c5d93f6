"""Document fingerprints: SimHash with permuted block tables, in DataFrame functions only."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a fingerprint.
BITS = 64
_HALVES = 0x100000001


def terms(text: str) -> Column:
    """Packed term hashes of a text column: one per pair of neighbouring lower-cased words (letters and digits), the last word alone.

    The low two bits hold the term's weight, 1 plus the number of its words of over three characters, so that pairs of function
    words vote less. The lambda variable ``ws`` binds the words once; naming the column again inside would split anew per word.
    """
    pair = "(xxhash64(x, get(ws, i + 1)) & -4L) | (1L + if(length(x) > 3, 1L, 0L) + if(length(get(ws, i + 1)) > 3, 1L, 0L))"
    words = rf"filter(split(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), w -> w <> '')"
    return F.expr(f"transform(array({words}), ws -> transform(ws, (x, i) -> {pair}))[0]")


def votes(df: DataFrame, keys: list[str], term: str = "term") -> DataFrame:
    """Fingerprint (long, column ``fp``) of each key from its packed terms: bit i is set where the weight of ones is over half.

    Two counters share a long (bits i and i + 32 in its halves), so a term costs 32 sums. A text without terms has fingerprint 0.
    """
    h, w = F.xxhash64(term), F.coalesce(F.col(term).bitwiseAND(F.lit(3)), F.lit(0))
    df = df.select(*keys, h.alias("h"), w.alias("w"))
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_HALVES)) * F.col("w")).alias(f"c{i}") for i in range(32)]
    agg = df.groupBy(*keys).agg(F.sum("w").alias("total"), *sums)
    bits = [(F.col(f"c{i}").bitwiseAND(F.lit(0xFFFFFFFF)), i) for i in range(32)] + [(F.shiftrightunsigned(f"c{i}", 32), i + 32) for i in range(32)]
    fp = F.lit(0).cast("long")
    for c, i in bits:
        fp = fp.bitwiseOR(F.when(c * 2 > F.col("total"), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return agg.select(*keys, fp.alias("fp"))


def as_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def _mask(blocks: tuple[int, ...], n: int) -> int:
    edge = [BITS * b // n for b in range(n + 1)]
    m = sum(((1 << (edge[b + 1] - edge[b])) - 1) << edge[b] for b in blocks)
    return m - (1 << 64) if m >= 1 << 63 else m


def within(queries: DataFrame, stored: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs ``(q, fp)`` of distinct fingerprints within ``radius`` bits: ``queries(q long)`` against ``stored(fp long)``.

    Fingerprints are cut into ``blocks`` blocks; two within the radius agree on ``blocks - radius`` of them at least, so each choice of
    so many blocks is a table keyed by those bits (20 tables of about 32 bits here). A pair is taken from the first table that holds
    both, which needs no distinct. Equal fingerprints count as a pair. Both inputs must hold each value once.
    """
    masks = [_mask(c, blocks) for c in combinations(range(blocks), blocks - radius)]
    arr = F.array(*[F.lit(m).cast("long") for m in masks])

    def posted(df: DataFrame, c: str) -> DataFrame:
        return df.select(c, F.posexplode(arr).alias("t", "m")).select(c, "t", F.col(c).bitwiseAND(F.col("m")).alias("k"))

    # a merge join: the planner doesn't know that posting makes many rows of one, so it would broadcast queries on their size before that
    both = posted(queries, "q").hint("merge").join(posted(stored, "fp"), ["t", "k"])
    x = F.col("q").bitwiseXOR(F.col("fp"))
    first = F.lit(len(masks))
    for t in reversed(range(len(masks))):
        first = F.when(x.bitwiseAND(F.lit(masks[t]).cast("long")) == 0, F.lit(t)).otherwise(first)
    return both.where((F.bit_count(x) <= radius) & (first == F.col("t"))).select("q", "fp")


def ordered_parts(df: DataFrame, col: str, rows_per_part: int = 2000, most: int = 1 << 14) -> Column:
    """Number of the range of ``col`` that a row falls into: ranges of about equal rows, found by a quantile sketch.

    The bounds stand in the plan as two levels of literals, so that a row compares itself with about twice the root of their number.
    """
    n = df.count()
    parts = min(most, max(1, math.ceil(n / rows_per_part)))
    cuts: list[int] = []
    if parts > 1:
        cuts = sorted(set(df.agg(F.percentile_approx(col, [i / parts for i in range(1, parts)], max(10000, 4 * parts))).first()[0] or []))
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    fine = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    longs = lambda xs: "array(" + ", ".join(f"{x}L" for x in xs) + ")"
    coarse = f"size(filter({longs(f[0] for f in fine)}, b -> b <= {col}))"
    inner = f"size(filter(get(array({', '.join(longs(f) for f in fine)}), {coarse} - 1), b -> b <= {col}))"
    return F.expr(f"if({col} is null or {coarse} = 0, 0, ({coarse} - 1) * {step} + {inner})")


def fingerprints(docs: DataFrame, radius: int = 3, every: int = 20) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document.

    Edited: the last floor(n_chars / 4) code points give way to the first as many (or all) of the next document by doc_id (after the
    last: the first). Documents are dealt into ranges of doc_id, with a copy of the first document of the following range in each, so
    one shuffle brings a text to its successor and everything after it up to the votes stays in that partition. ``n_near``: for
    documents whose id is divisible by ``every``, the number of other documents whose fingerprint is within ``radius`` bits (permuted
    block tables over all documents); null for the rest.

    Nulls: a null text is the empty text, whose fingerprint is 0. Null doc_ids come first. Repeated rows and ids are kept, ordered by a
    hash of the text. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    d = d.withColumn("part", ordered_parts(docs.select("doc_id"), "doc_id").cast("int"))
    lows = d.groupBy("part").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("has_null")).orderBy("part").collect()  # a row per range
    follow = [(lows[i - 1].part, lows[i].low if not lows[i].has_null else None) for i in range(len(lows))]
    nxt = spark.createDataFrame(follow, "to_part int, low long")
    copies = d.join(F.broadcast(nxt), d["doc_id"].eqNullSafe(nxt["low"])).select("doc_id", "t", F.col("to_part").alias("part"), F.lit(1).alias("copy"))
    rows = d.select("doc_id", "t", "part", F.lit(0).alias("copy")).union(copies).withColumn("th", F.xxhash64("t"))
    w = Window.partitionBy("part").orderBy("copy", "doc_id", "th")
    n = F.length("t")
    rows = rows.withColumn("rn", F.row_number().over(w)).withColumn("nt", F.coalesce(F.lead("t").over(w), F.lit("")))
    cutn = F.floor(n / 4).cast("int")
    rows = rows.select("part", "rn", "copy", "doc_id", n.cast("long").alias("n_chars"), F.col("t"), F.concat(F.expr("left(t, length(t) - cast(floor(length(t) / 4) as int))"), F.substring(F.col("nt"), F.lit(1), cutn)).alias("e"))
    keys = ["part", "rn", "copy", "doc_id", "n_chars", "edited_sha256", "edited"]
    own = F.explode(F.array(F.struct(F.lit(0).alias("edited"), F.col("t").alias("x")), F.struct(F.lit(1).alias("edited"), F.col("e").alias("x"))))
    rows = rows.withColumn("edited_sha256", F.sha2("e", 256)).select(*keys[:-1], own.alias("s")).where("copy = 0 or s.edited = 0")
    voted = votes(rows.select(*keys[:-1], F.col("s.edited").alias("edited"), F.explode_outer(terms("s.x")).alias("term")), keys)
    pair = voted.groupBy("part", "rn", "copy", "doc_id", "n_chars", "edited_sha256").agg(F.max(F.when(F.col("edited") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("edited") == 1, F.col("fp"))).alias("efp"))
    return pair.withColumn("nfp", F.lead("fp").over(Window.partitionBy("part").orderBy("rn"))).where("copy = 0").select("doc_id", "n_chars", "edited_sha256", "fp", "efp", "nfp")


def fingerprint_report(docs: DataFrame, radius: int = 3, every: int = 20) -> DataFrame:
    """``fingerprints`` as text, with likenesses and ``n_near`` (see there)."""
    from .common import cut

    f = cut(fingerprints(docs), "simhash")
    counts = f.groupBy("fp").agg(F.count("*").alias("n"))
    queries = f.where(F.col("doc_id") % every == 0).select(F.col("fp").alias("q")).distinct()
    near = within(queries, counts.select("fp"), radius).join(counts, "fp").groupBy("q").agg(F.sum("n").alias("n"))
    near = near.select(F.col("q").alias("fp"), (F.col("n") - 1).alias("n_near"), F.lit(True).alias("is_query"))
    asked = F.col("doc_id") % every == 0
    return f.join(near, "fp", "left").select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.coalesce("nfp", "fp")).alias("near_next"), F.when(asked, F.col("n_near")).alias("n_near"),
    )
