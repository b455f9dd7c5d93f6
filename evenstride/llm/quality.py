"""Quality classifier: interpolated modified Kneser-Ney character n-grams of trusted text; a document's perplexity against quantiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap_filter, cut, drop_cut, tidy

#: Characters in an n-gram; bits of a character in a packed n-gram.
ORDER, BITS = 5, 10
#: Model rows that are broadcast at once; a larger model is applied in several passes, each with a shard of its own.
SHARD_ROWS = 1_000_000
#: Characters handled at once.
PIECE = 1 << 20
#: Folds (by a hash of doc_id) of trusted text: a document is scored by a model of the other folds, so each trusted one is held out once.
FOLDS = 4
#: A document's mean is taken with so many further characters at its language's median, so that short ones need more evidence.
PRIOR_CHARS = 60
#: Threshold: this quantile of a language's trusted documents, each held out of the model that scores it.
QUANTILE = 0.99
_ALPHABET = np.arange(0x250, dtype=np.int64)
_ALPHABET[0] = 0x251
_ALPHABET[48:58] = 48
_EMPTY = np.int64(-1)


def token_ids(codes: np.ndarray) -> np.ndarray:
    """10-bit characters: Latin code points are themselves (digits are one), others fall into 430 classes by remainder; 0 stands before a text."""
    ids = 0x252 + (codes % 430).astype(np.int64)
    low = codes < 0x250
    ids[low] = _ALPHABET[codes[low]]
    return ids


def packed(pieces: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams that end at each character of the pieces (context of ORDER - 1 characters, text), end to end, and the pieces' lengths."""
    flat = "".join(c + t for c, t in pieces)
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array([len(t) for _, t in pieces])
    ids = token_ids(codes)
    lead = np.zeros(len(codes), bool)
    at = np.cumsum(lens + ORDER - 1) - lens - (ORDER - 1)
    for i in range(ORDER - 1):
        lead[at + i] = True
    begins = at[[c[0] == "\0" for c, _ in pieces]]
    for i in range(ORDER - 1):
        ids[begins + i] = 0
    keys = ids.copy()
    for i in range(1, ORDER):
        keys[i:] |= ids[:-i] << (BITS * i)
    return keys[~lead], lens


def text_pieces(texts: list[str], start: int = 0) -> Iterator[list[tuple[int, str, str]]]:
    """(row, context, text) in lists of about PIECE characters; a longer text is cut, its pieces overlapping by the context."""
    out, held = [], 0
    for i, t in enumerate(texts):
        for s in range(0, len(t), PIECE):
            part = t[s : s + PIECE]
            out.append((i + start, "\0" * (ORDER - 1) if s == 0 else t[s - ORDER + 1 : s], part))
            held += len(part)
            if held >= PIECE:
                yield out
                out, held = [], 0
    if out:
        yield out


def _by_lang(b, lang: int, text: int, fold: int | None = None) -> Iterator[tuple[tuple[int, str], np.ndarray, list[str]]]:
    """Rows and texts of a batch for each (fold, language); without a fold column all are of fold 0."""
    folds = b.column(fold).to_pylist() if fold is not None else [0] * b.num_rows
    rows: dict[tuple[int, str], list[int]] = {}
    for i, x in enumerate(zip(folds, b.column(lang).to_pylist())):
        rows.setdefault(x, []).append(i)
    texts = b.column(text)
    for x, at in rows.items():
        yield x, np.array(at), texts.take(np.array(at, np.int64)).to_pylist() if len(rows) > 1 else texts.to_pylist()


def _count(batches) -> Iterator:
    """Distinct n-grams of a partition with their counts."""
    import pyarrow as pa

    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts):
        k, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(k)
        k, n = k[order], n[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        at = np.flatnonzero(new)
        return k[at], np.add.reduceat(n, at) if len(at) else n

    for b in batches:
        for (_, lang), _, texts in _by_lang(b, 0, 1):
            for part in text_pieces(texts):
                keys = np.sort(packed([(c, t) for _, c, t in part])[0])
                new = np.ones(len(keys), bool)
                new[1:] = keys[1:] != keys[:-1]
                at = np.flatnonzero(new)
                parts = held.setdefault(lang, [])
                parts.append((keys[at], np.diff(np.append(at, len(keys)))))
                if len(parts) >= 8:
                    held[lang] = [merged(parts)]
    for lang, parts in held.items():
        k, n = merged(parts)
        for s in range(0, len(k), 100_000):
            m = len(k[s : s + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array(k[s : s + m]), pa.array(n[s : s + m].astype(np.int64))], ["lang", "key", "n"])


def _mask(m: int) -> int:
    return (1 << (BITS * m)) - 1


def discounts(c: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams that occur 1, 2, 3, 4 times; a fixed one where these don't allow it."""
    if min(c) == 0:
        return 0.5, 0.5, 0.5
    y = c[0] / (c[0] + 2 * c[1])
    d = [k + 1 - (k + 2) * y * c[k + 1] / c[k] for k in range(3)]
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


def train(trusted: DataFrame) -> DataFrame:
    """Model rows ``(lang, tag, key, val)`` from ``trusted(lang, text)``.

    n-gram counts are summed over all trusted text and sharded by their key; lower orders count distinct left neighbours. tag = m: log
    probability of an m-gram; tag = 8 + m: log back-off weight of a context of m characters; tag 15: log of the uniform share.
    """
    return _model(trusted.mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")))


def train_folds(trusted: DataFrame, folds: int) -> DataFrame:
    """Model rows as of ``train``, from ``trusted(fold, lang, text)``: for each fold a model of the text in all others, ``lang`` being "fold:lang"."""
    counts = trusted.select(F.concat_ws(":", "fold", "lang").alias("lang"), "text").mapInArrow(_count, "lang string, key long, n long")
    fold = F.substring_index("lang", ":", 1).cast("int")
    lang = F.expr("substring(lang, instr(lang, ':') + 1)")
    own = counts.groupBy(lang.alias("lang"), "key").agg(F.sum("n").alias("n"), *[F.coalesce(F.sum(F.when(fold == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(folds)])
    rest = F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), (F.col("n") - F.col(f"n{k}")).alias("n")) for k in range(folds)])).alias("x")
    return _model(own.select("lang", "key", rest).where("x.n > 0").select(F.concat_ws(":", "x.fold", "lang").alias("lang"), "key", F.col("x.n").alias("n")))


def _model(counts: DataFrame) -> DataFrame:
    """Model rows of n-gram counts ``(lang, key, n)``, in few queries: each one's plan and tasks cost the driver memory at any size.

    The n-grams of a context differ in their last character, so a window over a context holds 2 ** BITS rows at most.
    """
    spark = counts.sparkSession
    top = cut(counts, "kn-counts")
    level = {ORDER: top, ORDER - 1: cut(_lower(top, ORDER - 1), "kn-counts")}
    wider = level[ORDER - 1].select("lang", "key", F.explode(F.array(*[F.lit(m) for m in range(1, ORDER - 1)])).alias("m"))
    grams = wider.select("lang", "m", _last("key", F.col("m") + 1).alias("key")).distinct()
    small = cut(grams.groupBy("lang", "m", _last("key", F.col("m")).alias("key")).agg(F.count("*").alias("n")), "kn-counts")
    for m in range(1, ORDER - 1):
        level[m] = small.where(F.col("m") == m).select("lang", "key", "n")
    stats = None
    for m, t in level.items():
        one = t.groupBy("lang").agg(F.lit(m).alias("m"), F.count("*").alias("v"), *[F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)])
        stats = one if stats is None else stats.union(one)
    stats = stats.collect()  # a row per language and order
    whole = Window.partitionBy("lang", "ctx")
    rows, lower, made = [], None, [top, level[ORDER - 1], small]
    for m in range(1, ORDER + 1):
        d = spark.createDataFrame([(r.lang, *discounts([r.n1, r.n2, r.n3, r.n4]), 1.0 / (r.v + 1)) for r in stats if r.m == m], "lang string, d1 double, d2 double, d3 double, u double")
        t = level[m].join(F.broadcast(d), "lang").withColumn("ctx", F.shiftright("key", BITS)).withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        t = t.withColumns({"total": F.sum("n").over(whole), "held": F.sum("d").over(whole), "first": F.min("key").over(whole) == F.col("key")})
        if lower is None:
            t = t.withColumn("p_low", F.col("u"))
            rows.append(d.select("lang", F.lit(15).alias("tag"), F.lit(0).cast("long").alias("key"), F.log("u").alias("val")))
        else:
            t = t.withColumn("low", F.col("key").bitwiseAND(F.lit(_mask(m - 1)))).join(lower.select("lang", F.col("key").alias("low"), F.col("p").alias("p_low")), ["lang", "low"])
        share = F.col("held") / F.col("total")
        lower = cut(t.select("lang", "key", ((F.col("n") - F.col("d")) / F.col("total") + share * F.col("p_low")).alias("p"), F.when(F.col("first"), F.log(share)).alias("back")), "kn-p")
        made.append(lower)
        rows.append(lower.select("lang", F.lit(m).alias("tag"), "key", F.log("p").alias("val")))
        rows.append(lower.where("back is not null").select("lang", F.lit(8 + m - 1).alias("tag"), F.shiftright("key", BITS).alias("key"), F.col("back").alias("val")))
        tidy(spark)
    model = rows[0]
    for r in rows[1:]:
        model = model.union(r)
    model = cut(model, "kn-model")
    for t in made:
        drop_cut(t)
    tidy(spark)
    return model


def _last(key: str, m) -> Column:
    """The last ``m`` characters of a packed n-gram; m a column."""
    return F.col(key).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (m * BITS).cast("int")) - 1)


def _lower(t: DataFrame, m: int) -> DataFrame:
    """m-grams with the number of (m + 1)-grams of ``t`` that end in each."""
    return t.groupBy("lang", F.col("key").bitwiseAND(F.lit(_mask(m))).alias("key")).agg(F.count("*").alias("n"))


class Table:
    """Open-addressing hash table from int64 keys to a row of values (one for each fold), built and read a whole array at a time."""

    def __init__(self, keys: np.ndarray, vals: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.vals = np.full(1 << self.bits, _EMPTY), np.zeros((1 << self.bits, vals.shape[1]), np.float32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == _EMPTY
            self.keys[at[free]] = keys[left[free]]
            done = self.keys[at] == keys[left]
            self.vals[at[done]] = vals[left[done]]
            left, at = left[~done], (at[~done] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray, fold: int = 0) -> np.ndarray:
        """Values of a fold; nan where a key isn't there."""
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.vals[at, fold], np.float32(np.nan))
        left = np.flatnonzero((there != keys) & (there != _EMPTY))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.vals[at[hit], fold]
            go = ~hit & (there != _EMPTY)
            left, at = left[go], at[go]
        return out


_UNIFORM = 15 << 56


def log_probs(table: Table, keys: np.ndarray, fold: int = 0) -> np.ndarray:
    """Log probability of each n-gram's last character: the longest known n-gram, with the back-off weights of longer contexts."""
    out, left = np.zeros(len(keys)), np.arange(len(keys))
    for m in range(ORDER, 0, -1):
        v = table.get((keys[left] & _mask(m)) | (m << 56), fold)
        hit = ~np.isnan(v)
        out[left[hit]] += v[hit]
        left = left[~hit]
        if not len(left):
            return out
        out[left] += np.nan_to_num(table.get(((keys[left] >> BITS) & _mask(m - 1)) | (8 + m - 1) << 56, fold))
    out[left] += table.get(np.array([_UNIFORM]), fold)[0]
    return out


def _shard_of(keys, shards: int):
    return (keys >> BITS & _mask(2)) % 1000003 % shards


def _pack(folds: int):
    """Model rows of a partition as one row of bytes per language: keys, and their values fold by fold (nan where a fold has none)."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            code = b.column(0).dictionary_encode()
            at, names = code.indices.to_numpy(zero_copy_only=False), code.dictionary.to_pylist()
            keys = b.column(1).to_numpy()
            vals = np.stack([b.column(2 + k).to_numpy(zero_copy_only=False).astype(np.float32) for k in range(folds)], 1)
            mine = [at == i for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([keys[x].tobytes() for x in mine], pa.binary()), pa.array([vals[x].tobytes() for x in mine], pa.binary())], ["lang", "keys", "vals"])

    return run


def _score(model, folds: int, shard: int, shards: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        held = model.value
        if "tables" not in held:
            parts: dict[str, list] = {}
            for lang, k, v in held["rows"]:
                parts.setdefault(lang, []).append((np.frombuffer(k, np.int64), np.frombuffer(v, np.float32).reshape(-1, folds)))
            held["tables"] = {lang: Table(np.concatenate([k for k, _ in x]), np.concatenate([v for _, v in x])) for lang, x in parts.items()}
            del held["rows"]
        for b in batches:
            total, n = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for (fold, lang), at, texts in _by_lang(b, 1, 3, 4):
                t = held["tables"].get(lang)
                if t is None or np.isnan(t.get(np.array([_UNIFORM]), fold)[0]):
                    continue
                for part in text_pieces(texts):
                    keys, lens = packed([(c, x) for _, c, x in part])
                    row = np.repeat(at[[i for i, _, _ in part]], lens)
                    if shards > 1:
                        mine = _shard_of(keys, shards) == shard
                        keys, row = keys[mine], row[mine]
                    total += np.bincount(row, log_probs(t, keys, fold), b.num_rows)
                    n += np.bincount(row, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(-total), pa.array(n)], ["doc_id", "lang", "th", "loss", "n"])

    return run


def score(docs: DataFrame, model: DataFrame, shard_rows: int = SHARD_ROWS, folds: int | None = None) -> DataFrame:
    """``(doc_id, lang, th, loss, n, copies)``: negative log-likelihood and characters of each text (th: its hash), equal rows together.

    With ``folds``, ``model`` is that of ``train_folds`` and a document is scored by the values of its own fold (``fold_of``); the folds'
    values stand side by side in one table, so all texts are read once, not once for each fold.

    Every character is scored in the shard of the model that its two preceding characters belong to; n-grams and contexts too short
    for that are in all shards. Executors pack a shard (of about ``shard_rows`` n-grams at most) into bytes, the driver only passes them
    on, and a shard is taken back from all of them as soon as its pass over the texts is written; so neither holds more than one. The
    passes' sums are added.
    """
    spark, k = docs.sparkSession, folds or 1
    lang = F.col("lang") if folds is None else F.expr("substring(lang, instr(lang, ':') + 1)")
    fold = F.lit(0) if folds is None else F.substring_index("lang", ":", 1).cast("int")
    wide = model.select(lang.alias("lang"), fold.alias("fold"), "tag", "key", F.col("val").cast("float").alias("val"))
    if folds is not None:
        wide = wide.groupBy("lang", "tag", "key").agg(*[F.max(F.when(F.col("fold") == i, F.col("val"))).alias(f"v{i}") for i in range(k)])
    else:
        wide = wide.select("lang", "tag", "key", F.col("val").alias("v0"))
    wide = cut(wide, "kn-wide")
    shards = max(1, -(-wide.count() // shard_rows))
    own = F.lit(0) if folds is None else fold_of(folds)
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"), own.alias("fold"))
    short = F.col("tag").isin(1, 2, 8, 9, 15)
    ctx2 = F.when(F.col("tag") < 8, F.shiftright("key", BITS)).otherwise(F.col("key")).bitwiseAND(F.lit(_mask(2)))
    out = None
    for s in range(shards):
        part = wide.where(short | (ctx2 % 1000003 % shards == s)).select("lang", (F.shiftleft(F.col("tag").cast("long"), 56).bitwiseOR(F.col("key"))).alias("key"), *[f"v{i}" for i in range(k)])
        tab = part.mapInArrow(_pack(k), "lang string, keys binary, vals binary").toArrow()
        sent = spark.sparkContext.broadcast({"rows": list(zip(*(c.to_pylist() for c in tab.columns)))})
        del tab
        one = cut(d.mapInArrow(_score(sent, k, s, shards), "doc_id long, lang string, th long, loss double, n long"), "kn-pass")
        sent.destroy()
        out = one if out is None else out.union(one)
    drop_cut(wide)
    sums = out.groupBy("doc_id", "lang", "th").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"), (F.count("*") / shards).cast("int").alias("copies"))
    return sums.select("doc_id", "lang", "th", (F.col("loss") / F.col("copies")).alias("loss"), F.expr("n div copies").alias("n"), "copies")


def fold_of(folds: int):
    """The fold of a document, by a hash of its doc_id."""
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(folds)).cast("int")


def _quantiles(df: DataFrame, value: str, at: tuple[float, ...]) -> dict[str, list[float]]:
    """Quantiles by language of values rounded to thousandths: counts of at most some thousand different values per language."""
    hist = df.groupBy("lang", F.round(F.col(value) * 1000).cast("int").alias("b")).agg(F.sum("copies").alias("n")).collect()
    out: dict[str, list[float]] = {}
    for lang in {r.lang for r in hist}:
        bins = sorted((r.b, r.n) for r in hist if r.lang == lang)
        cum = np.cumsum([n for _, n in bins])
        out[lang] = [bins[int(np.searchsorted(cum, q * cum[-1]))][0] / 1000 for q in at]
    return out


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, folds: int = FOLDS) -> DataFrame:
    """``(doc_id, lang, n_chars, perplexity, threshold, kept)`` per row of ``docs``: what ``judge`` says of each text, for every row that has it."""
    out = judge(docs, labels, quantile, folds).withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "threshold", "kept")


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, folds: int = FOLDS) -> DataFrame:
    """``(doc_id, lang, th, copies, n_chars, perplexity, threshold, kept)``, equal rows together (th: xxhash64 of the text, lang "" for null);
    documents above their language's threshold are rejected.

    Trusted are documents with a label of quality 1, dealt into ``folds`` by a hash of doc_id. Each fold's documents, trusted or not, are
    scored by a model per language of the trusted text in the other folds. So all trusted text trains and all of it is held out once:
    the threshold is the ``quantile`` of a language's trusted documents. ``perplexity`` is per character: exp of the mean loss, taken with
    PRIOR_CHARS characters at the language's median. Labels of other documents are not used.

    A document whose language has no model or no held-out text is kept (threshold null); so is one that is null or empty (perplexity
    null). A null language is a language of its own. Repeated rows and doc_ids are scored each; a doc_id that is labelled more than once
    is trusted if some label says so. Without labels or documents nothing is rejected.
    """
    spark = docs.sparkSession
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    text = bitmap_filter(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text").where(F.length("text") > 0), "doc_id", trusted, "doc_id")
    model = train_folds(text.join(trusted.hint("shuffle_merge"), "doc_id").select(fold_of(folds).alias("fold"), "lang", "text"), folds)
    scored = cut(score(docs, model, folds=folds), "kn-scores")
    drop_cut(model)
    tidy(spark)
    held = scored.where("n > 0").join(trusted, "doc_id").withColumn("mean", F.col("loss") / F.col("n"))
    mid = _quantiles(held, "mean", (0.5,))
    mids = F.broadcast(spark.createDataFrame([(k, v[0]) for k, v in mid.items()], "lang string, mid double"))
    smooth = (F.col("loss") + PRIOR_CHARS * F.col("mid")) / (F.col("n") + PRIOR_CHARS)
    marks = _quantiles(held.join(mids, "lang").withColumn("mean", smooth), "mean", (quantile,))
    limits = F.broadcast(spark.createDataFrame([(k, mid[k][0], q + 0.0005) for k, (q,) in marks.items()], "lang string, mid double, most double"))  # upper end of what rounds to q
    out = scored.join(limits, "lang", "left").withColumn("mean", F.when(F.col("n") > 0, F.coalesce(smooth, F.col("loss") / F.col("n"))))
    return out.select("doc_id", "lang", "th", "copies", F.col("n").alias("n_chars"), F.exp("mean").alias("perplexity"), F.exp("most").alias("threshold"), F.coalesce(F.col("mean") <= F.col("most"), F.lit(True)).alias("kept"))
