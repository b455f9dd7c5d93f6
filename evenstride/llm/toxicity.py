"""Toxicity: noisy-channel deobfuscation by Viterbi decoding under a character language model, then a score of the restored text."""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

#: Labelled documents to learn from at most (a hash of doc_id chooses), and features (words and word beginnings) kept of them.
TRAIN_ROWS, FEATURES = 12_000, 600
#: Distinct tokens or n-grams that a task counts before it passes them on.
HELD = 200_000
#: Beginnings of words that are features beside words themselves, in characters.
BEGINNINGS = (4, 5, 6, 7)
#: Distance from chance that a feature must have: signed root of its likelihood ratio.
MIN_Z = 4.2
#: A feature's toxic share is shrunk by so many average documents; no text that holds it scores lower (a regression on texts with many
#: such words spreads the weight over all of them, so a single one would count too little).
PRIOR_DOCS = 20
#: Only a share of this and more counts so: it takes some dozens of documents, nearly all of them toxic.
SURE = 0.7
THRESHOLD = 0.3

# Letters that a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "¡": "i", "€": "e", "£": "l", "¢": "c", "§": "s",
}
# Costs (negative logs) of what the channel may do.
COST_SIGN, COST_DROP, COST_DROP_DIGIT, COST_REPEAT, COST_ANY, COST_BREAK = 0.4, 0.8, 4.0, 0.2, 2.5, 0.6
#: Signs that may stand for any letter.
BLANKS = "*_#%.-"

_WORD = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"[^\W\d_]+\Z")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_LONG_RUN = re.compile(r"([^\W\d_])\1{2,}")
#: Longer tokens are decoded in overlapping windows of so many characters.
WINDOW = 40
_EDGE = re.compile(r"^[^\w$@!|+(<]+|[^\w]+$")


def trigrams(words: dict[str, float]) -> dict[str, float]:
    """Summed weights of the character trigrams of words, each with its two leading marks and its end."""
    n: Counter = Counter()
    for w, k in words.items():
        s = "^^" + w + "$"
        for i in range(2, len(s)):
            n[s[i - 2 : i + 1]] += k
    return n


class CharModel:
    """Interpolated character trigrams of weighted words; half general text, half the lexicon to be recognised.

    General text is given as weighted words or, already counted, as weighted trigrams (``grams``).
    """

    def __init__(self, general: dict[str, float], lexicon: list[str], grams: dict[str, float] | None = None) -> None:
        if grams is None:
            grams = trigrams(general)
        self.parts = [self._shares(grams), self._shares(trigrams(dict.fromkeys(lexicon, 1.0)) or grams)]
        self.letters = sorted({g[-1] for g in grams if g[-1] != "$"} | {c for w in lexicon for c in w})
        self.uniform = 1.0 / (len(self.letters) + 1)
        self.memo: dict[tuple[str, str], float] = {}

    @staticmethod
    def _shares(grams: dict[str, float]) -> list[dict[str, float]]:
        n: list[Counter] = [Counter() for _ in range(3)]
        for g, k in grams.items():
            for m in range(3):
                n[m][g[2 - m :]] += k
        out: list[dict[str, float]] = []
        for m in range(3):
            total: Counter = Counter()
            for g, k in n[m].items():
                total[g[:-1]] += k
            out.append({g: k / (total[g[:-1]] + 0.5) for g, k in n[m].items()})
        return out

    def cost(self, before: str, c: str) -> float:
        key = (before, c)
        got = self.memo.get(key)
        if got is None:
            p = 0.0
            for tri in self.parts:
                p += 0.5 * (0.7 * tri[2].get(before + c, 0.0) + 0.2 * tri[1].get(before[1:] + c, 0.0) + 0.09 * tri[0].get(c, 0.0) + 0.01 * self.uniform)
            got = self.memo[key] = -math.log(p)
        return got

    def decode(self, signs: str, breaks: bool = False) -> str:
        """Likeliest reading of a string of signs: the shortest path through the lattice of what each sign may stand for.

        A sign is read as itself, as a letter it resembles, as any letter (blanks), as a repeat of the letter before, or left out; with
        ``breaks`` a word may end after any letter. States are the last two letters read.
        """
        states: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
        for c in signs:
            arcs: list[tuple[str, float]] = []
            if c.isalpha():
                arcs.append((c, 0.0))
            else:
                arcs += [(x, COST_SIGN) for x in SIGNS.get(c, "")]
                arcs.append(("", COST_DROP_DIGIT if c.isdigit() else COST_DROP))
                if c in BLANKS:
                    arcs += [(x, COST_ANY) for x in self.letters]
            new: dict[str, tuple[float, str]] = {}
            for before, (paid, text) in states.items():
                for x, price in arcs:
                    if x:
                        to, total, read = before[1] + x, paid + price + self.cost(before, x), text + x
                        if x == before[1] and (before not in new or new[before][0] > paid + price + COST_REPEAT):
                            new[before] = (paid + price + COST_REPEAT, text)
                    else:
                        to, total, read = before, paid + price, text
                    if to not in new or new[to][0] > total:
                        new[to] = (total, read)
            if breaks:
                for before, (paid, text) in list(new.items()):
                    total = paid + COST_BREAK + self.cost(before, "$")
                    if before != "^^" and ("^^" not in new or new["^^"][0] > total):
                        new["^^"] = (total, text + " ")
            if len(new) > 64:
                new = dict(sorted(new.items(), key=lambda kv: kv[1][0])[:64])
            states = new or states
        return min((paid + (0.0 if before == "^^" else self.cost(before, "$")), text) for before, (paid, text) in states.items())[1]


def suspicious(core: str) -> bool:
    """Whether a token (without its edges) may hide a word: signs among letters, or a letter three times in a row."""
    if "@" in core and "." in core:
        return False
    if _PLAIN.match(core):
        return _TRIPLE.search(core) is not None
    letters = sum(c.isalpha() for c in core)
    return letters > 0 and letters + sum(c in SIGNS or c in BLANKS for c in core) >= 3


def readings(core: str, model: CharModel) -> list[str]:
    """What a token may hide: its likeliest reading; of one longer than WINDOW (with runs of a letter cut to three) that of each half-overlapping window."""
    if len(core) > WINDOW:
        core = _LONG_RUN.sub(r"\1\1\1", core)
    if len(core) <= WINDOW:
        return [model.decode(core)]
    return [model.decode(core[s : s + WINDOW]) for s in range(0, len(core) - WINDOW // 2, WINDOW // 2)]


def token_words(token: str, model: CharModel | None) -> list[str]:
    """Words in a lower-cased token as it stands, and as restored where it looks obfuscated."""
    words = _WORD.findall(token)
    if model is not None:
        core = _EDGE.sub("", token)
        if core and suspicious(core):
            words += readings(core, model)
    return words


def spaced_words(text: str, model: CharModel) -> list[str]:
    """Words restored from runs of single characters."""
    out: list[str] = []
    for m in _SPACED.finditer(text):
        run = re.sub(r"(.)\1+", r"\1\1", "".join(m[0].split()))
        out += model.decode(run, breaks=True).split()
    return out


def features_of(word: str) -> list[str]:
    return [word, *(f"^{word[:k]}" for k in BEGINNINGS if len(word) >= k)]


def text_features(text: str, known: dict[str, int], model: CharModel, memo: dict[str, tuple[int, ...]]) -> set[int]:
    text = text.lower()
    out: set[int] = set()
    for t in set(text.split()):
        got = memo.get(t)
        if got is None:
            got = memo[t] = tuple({known[f] for w in token_words(t, model) for f in features_of(w) if f in known})
        if got:
            out.update(got)
    if _SPACED.search(text):
        out.update(known[f] for w in spaced_words(text, model) for f in features_of(w) if f in known)
    return out


def _count(batches) -> Iterator:
    """Number of documents that hold a feature, and of toxic ones among them; ``word`` tells words from beginnings."""
    import pyarrow as pa

    n, bad = Counter(), Counter()
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            fs = {f for t in set(text.lower().split()) for w in token_words(t, None) for f in features_of(w)}
            n.update(fs)
            if toxic:
                bad.update(fs)
    keys = list(n)
    for s in range(0, len(keys), 50_000):
        k = keys[s : s + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array([n[x] for x in k], pa.int64()), pa.array([bad[x] for x in k], pa.int64())], ["f", "n", "bad"])


def _pairs(n: dict, kind) -> Iterator:
    import pyarrow as pa

    keys = list(n)
    for s in range(0, len(keys), 50_000):
        k = keys[s : s + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array([n[x] for x in k], kind)], ["w", "n"])


def _words(batches) -> Iterator:
    """Words with the number of (document, token) pairs that hold them; a task passes on what it has whenever it holds HELD tokens."""
    import pyarrow as pa

    tokens: Counter = Counter()

    def flush() -> Iterator:
        n: Counter = Counter()
        for t, k in tokens.items():
            for w in _WORD.findall(t):
                n[w] += k
        tokens.clear()
        yield from _pairs(n, pa.int64())

    for b in batches:
        for text in b.column(0).to_pylist():
            tokens.update(set(text.lower().split()))
            if len(tokens) > HELD:
                yield from flush()
    yield from flush()


def _grams(batches) -> Iterator:
    """Character trigrams of words, a word weighing the root of its documents."""
    import pyarrow as pa

    grams: Counter = Counter()
    for b in batches:
        grams.update(trigrams({w: math.sqrt(k) for w, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}))
        if len(grams) > HELD:
            yield from _pairs(grams, pa.float64())
            grams.clear()
    yield from _pairs(grams, pa.float64())


def general_trigrams(docs: DataFrame) -> dict[str, float]:
    """Weighted character trigrams of the words of all documents, labelled or not."""
    words = docs.select("text").where("text is not null").mapInArrow(_words, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    grams = words.mapInArrow(_grams, "w string, n double").groupBy("w").agg(F.round(F.sum("n"), 3).alias("n"))  # sums in any order
    tab = grams.toArrow()
    return dict(sorted(zip(tab.column("w").to_pylist(), tab.column("n").to_pylist())))


def _matrix(shared):
    def run(batches) -> Iterator:
        import pyarrow as pa

        known, model = pickle.loads(shared.value)
        memo: dict = {}
        for b in batches:
            fs = [sorted(text_features(t, known, model, memo)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(fs, pa.list_(pa.int32()))], ["toxic", "fs"])

    return run


def _scores(shared):
    def run(batches) -> Iterator:
        import pyarrow as pa

        known, model, weights, bias, shares = pickle.loads(shared.value)
        memo: dict = {}
        for b in batches:
            out, least = np.empty(b.num_rows), np.zeros(b.num_rows)
            for i, t in enumerate(b.column(1)):
                fs = text_features(t.as_py(), known, model, memo)
                out[i] = bias
                if fs:
                    at = list(fs)
                    out[i] += weights[at].sum()
                    least[i] = shares[at].max()
                if len(memo) > 400_000:
                    memo.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.maximum(least, 1 / (1 + np.exp(-np.clip(out, -30, 30)))))], ["doc_id", "score"])

    return run


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 25) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps, each halved until the loss falls; weights and bias."""
    n, d = x.shape
    if not n or not y.any():
        return np.zeros(d), -6.0
    a = np.hstack([x, np.ones((n, 1), x.dtype)])
    keep = np.append(np.full(d, ridge), 1e-6)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        m = (a @ w.astype(a.dtype)).astype(np.float64)
        return float(np.logaddexp(0, m).sum() - m @ y + 0.5 * keep @ (w * w)), m

    w = np.zeros(d + 1)
    w[-1] = math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    now, m = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        hess = (a * (p * (1 - p)).astype(a.dtype)[:, None]).T @ a
        move = np.linalg.solve(hess.astype(np.float64) + np.diag(keep), a.T @ (p - y).astype(a.dtype) + keep * w)
        size = 1.0
        while size > 1e-3:
            new, m2 = loss(w - size * move)
            if new < now:
                break
            size /= 2
        else:
            break
        done = now - new < 1e-4
        w, now, m = w - size * move, new, m2
        if done:
            break
    return w[:-1], float(w[-1])


def held_out(doc_id):
    """Whether crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``.

    Learns from labelled documents that aren't held out, ``train_rows`` of them at most. Features are words and word beginnings whose
    documents are toxic more often than chance (MIN_Z); a logistic regression weighs them. The channel's language model mixes character
    trigrams of the words of all documents, labelled or not, with those of the words that tell toxic text. Every whole text is decoded and scored; only the text is
    an input of a score.

    Null and empty texts get the score of a text without features. A doc_id labelled more than once is toxic if some label says so;
    repeated documents are scored each; a null doc_id is not held out. Without labels or toxic ones all scores are near 0.
    """
    spark = docs.sparkSession
    pool = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = pool.orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(train_rows).collect()
    sample = F.broadcast(spark.createDataFrame([(r.doc_id, r.toxic) for r in ids], "doc_id long, toxic int"))
    rows = cut(docs.select("doc_id", "text").where("text is not null").join(sample, "doc_id").select("text", "toxic"), "tox-sample")
    found = cut(rows.mapInArrow(_count, "f string, n long, bad long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where("n >= 4"), "tox-counts")
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    # signed root of the likelihood ratio of a feature's toxic share against the share of all documents
    rate = min(max(bad / n, 1e-9), 1 - 1e-9) if n else 0.5
    x, y = F.col("bad"), F.col("n") - F.col("bad")
    part = lambda k, share: F.when(k > 0, k * F.log(k / (F.col("n") * share))).otherwise(0.0)
    z = F.signum(x - F.col("n") * rate) * F.sqrt(F.greatest(F.lit(0.0), 2 * (part(x, rate) + part(y, 1 - rate))))
    best = found.withColumn("z", z).where(f"z >= {MIN_Z}").orderBy(F.desc("z"), "f").limit(FEATURES).collect()
    known = {r.f: i for i, r in enumerate(best)}
    model = CharModel({}, [r.f for r in best if r.f[0] != "^"], general_trigrams(docs))
    sent = spark.sparkContext.broadcast(cloudpickle.dumps((known, model)))
    data = rows.mapInArrow(_matrix(sent), "toxic int, fs array<int>").collect()  # train_rows at most
    sent.destroy()
    x = np.zeros((len(data), len(known)), np.float32)
    for i, r in enumerate(data):
        x[i, r.fs] = 1
    weights, bias = fit(x, np.array([r.toxic for r in data], np.float32))
    shares = np.array([(r.bad + PRIOR_DOCS * rate) / (r.n + PRIOR_DOCS) for r in best])
    shares[shares < SURE] = 0
    shared = spark.sparkContext.broadcast(cloudpickle.dumps((known, model, weights, bias, shares)))  # by value: executors need no copy of this package
    scored = cut(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_scores(shared), "doc_id long, score double"), "tox-scores")
    shared.destroy()
    drop_cut(rows)
    drop_cut(found)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
