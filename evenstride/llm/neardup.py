"""MinHash near-duplicates by an inverted join over signature coordinates, confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_filter, components, cut, drop_cut, grouped_batches, tidy

#: Words in a shingle; coordinates of a signature; share of links at the threshold itself that may agree in too few coordinates.
WORDS, COORDINATES, MISSED = 5, 32, 4e-5
#: Entries of a posting list (texts of a cluster) that a task compares at once.
BLOCK = 256
#: Shingles of a cluster's block at most, about.
BLOCK_SHINGLES = 500_000
PIECE = 1 << 20

_rng = np.random.RandomState(20240229)
_BYTE = _rng.randint(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PLACE = _rng.randint(0, 1 << 63, WORDS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _rng.randint(0, 1 << 63, COORDINATES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.randint(0, 1 << 63, COORDINATES, dtype=np.int64).astype(np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def matches(percent: int) -> int:
    """Matching coordinates that make a candidate: the most that at most MISSED of the pairs with that similarity fall short of.

    18 at 85 percent (1.9e-5 of such pairs agree in fewer), 16 at 80 percent (3.3e-5).
    """
    p, short, m = percent / 100, 0.0, 0
    while m < COORDINATES:
        short += math.comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if short > MISSED:
            break
        m += 1
    return max(m, 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    if base not in cache or len(cache[base]) < n:
        p = np.full(max(n, PIECE + 1), base, np.uint64)
        p[0] = 1
        cache[base] = np.multiply.accumulate(p)
    return cache[base][:n]


def shingle_sets(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of texts laid end to end: (hashes sorted within each text, end of each text's).

    buf: their UTF-8 bytes; ends: where each text ends. Words are hashed by a polynomial over their bytes from prefix sums, shingles from
    the hashes of their five words; a text of fewer words is one shingle.
    """
    n, starts = len(buf), np.concatenate([[0], ends[:-1]])
    word = ~_SPACE[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = starts[(starts < n) & (starts > 0)]
    first[inner] |= word[inner]  # a word ends with its text
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    a, z = np.flatnonzero(first), np.flatnonzero(last)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _powers(_BASE, n), out=sums[1:])
    w = mix64((sums[z + 1] - sums[a]) * _powers(_BASE_INV, n)[a])
    at = np.searchsorted(a, ends)  # words before each text's end
    n_words = np.diff(np.concatenate([[0], at]))
    m = len(w)
    s = np.zeros(m, np.uint64)
    for i in range(min(WORDS, m)):
        s[: m - i] += w[i:] * _PLACE[i]
    s = mix64(s)
    text = np.repeat(np.arange(len(ends)), n_words)
    keep = np.arange(m) + WORDS <= at[text]
    firsts = at - n_words
    for i in np.flatnonzero((n_words > 0) & (n_words < WORDS)):  # the whole sequence as one
        f = firsts[i]
        keep[f] = True
        part = w[f : at[i]]
        s[f] = mix64(np.array([(part * _PLACE[: len(part)]).sum() + np.uint64(len(part))], np.uint64))[0]
    s, text = s[keep], text[keep]
    order = np.lexsort((s, text)) if len(ends) > 1 else np.argsort(s)
    s, text = s[order], text[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (text[1:] != text[:-1])
    s, text = s[new], text[new]
    return s, np.searchsorted(text, np.arange(len(ends)), side="right")


def signatures(s: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """int32[texts, COORDINATES]: the least of each hash family over each (non-empty) set."""
    starts = np.concatenate([[0], ends[:-1]])
    out = np.empty((len(ends), COORDINATES), np.int32)
    for k in range(COORDINATES):
        v = ((s * _MUL[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32)
        out[:, k] = np.minimum.reduceat(v, starts).view(np.int32)
    return out


def _text_pieces(col) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from-to of a string column with their bytes and ends, about PIECE bytes at a time (one row at least)."""
    import pyarrow as pa

    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i + 1 : j + 1] - off[i]
        i = j


BASE_SCHEMA = "doc_id long, th long, n long, node long, sig array<int>"
SET_SCHEMA = "node long, sig array<int>, n long, shingles binary"


def _nodes(s: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set that doesn't depend on order."""
    starts = np.concatenate([[0], ends[:-1]])
    n = np.diff(np.concatenate([[0], ends])).astype(np.uint64)
    return mix64(np.add.reduceat(mix64(s ^ _BASE), starts) * np.uint64(3) + np.bitwise_xor.reduceat(mix64(s), starts) + n).view(np.int64)


def _read(full: bool):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ids, col = b.column(0), b.column(1)
            for i, j, buf, ends in _text_pieces(col):
                s, at = shingle_sets(buf, ends)
                n = np.diff(np.concatenate([[0], at]))
                some = np.flatnonzero(n)
                node, sig = np.zeros(j - i, np.int64), np.zeros((0, COORDINATES), np.int32)
                if len(some):
                    node[some], sig = _nodes(s, at[some]), signatures(s, at[some])
                off = np.zeros(j - i + 1, np.int32)
                off[1:] = np.cumsum(n > 0) * COORDINATES
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(sig.ravel()))
                nodes = pa.array(node, mask=n == 0)
                if full:
                    byte = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(np.concatenate([[0], at * 8]).astype(np.int32)), pa.py_buffer(s)])
                    yield pa.RecordBatch.from_arrays([nodes, lists, pa.array(n.astype(np.int64)), byte], ["node", "sig", "n", "shingles"])
                else:
                    yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), b.column(2).slice(i, j - i), pa.array(n.astype(np.int64)), nodes, lists], ["doc_id", "th", "n", "node", "sig"])

    return run


class Forest:
    """Union-find that keeps the edges that joined two trees."""

    def __init__(self, n: int) -> None:
        self.up, self.edges = list(range(n)), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def _group(g) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    node = g.column("node").to_numpy()
    flat = g.column("sig").combine_chunks()
    sig = flat.values.to_numpy()[flat.offsets[0].as_py() :][: len(node) * COORDINATES].reshape(-1, COORDINATES)
    return node, sig, g.column("blk").to_numpy()


def _pairs(node, sig, blk, b1: int, b2: int, least: int):
    """Index pairs of a block pair with ``least`` equal coordinates at least, the best first."""
    left, right = np.flatnonzero(blk == b1), np.flatnonzero(blk == b2)
    if not len(left) or not len(right):
        return np.zeros((0, 2), int)
    same = np.zeros((len(left), len(right)), np.uint8)
    for k in range(COORDINATES):
        same += sig[left, k][:, None] == sig[right, k]
    ok = same >= least
    if b1 == b2:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    best = np.argsort(-same[i, j].astype(int), kind="stable")
    p = np.stack([left[i[best]], right[j[best]]], 1)
    return p[node[p[:, 0]] != node[p[:, 1]]]


def _edges_of(forest: Forest, node: np.ndarray, rows: list) -> None:
    """Each tree as a star around its smallest node: as many edges, and components needs fewer rounds than for chains."""
    tree = {i: forest.root(i) for e in forest.edges for i in e}
    least: dict[int, int] = {}
    for i, r in tree.items():
        least[r] = min(least.get(r, int(node[i])), int(node[i]))
    rows += [(int(node[i]), least[r]) for i, r in tree.items() if node[i] != least[r]]


def _emit(rows: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["a", "b"])


def _candidates(least: int):
    """A spanning forest of each block pair's candidate graph."""

    def run(batches) -> Iterator:
        rows: list = []
        for g in grouped_batches(batches, ["k", "b1", "b2"]):
            node, sig, blk = _group(g)
            if len(node) < 2:
                continue
            f = Forest(len(node))
            for i, j in _pairs(node, sig, blk, g.column("b1")[0].as_py(), g.column("b2")[0].as_py(), least).tolist():
                f.join(i, j)
            _edges_of(f, node, rows)
            if len(rows) >= 10000:
                yield _emit(rows)
                rows = []
        if rows:
            yield _emit(rows)

    return run


def _confirm(percent: int, least: int):
    def run(batches) -> Iterator:
        rows: list = []
        for g in grouped_batches(batches, ["k", "b1", "b2"]):
            node, sig, blk = _group(g)
            if len(node) < 2:
                continue
            sets: dict[int, np.ndarray] = {}
            col = g.column("shingles")
            f = Forest(len(node))
            for i, j in _pairs(node, sig, blk, g.column("b1")[0].as_py(), g.column("b2")[0].as_py(), least).tolist():
                if f.root(i) == f.root(j):
                    continue
                for x in (i, j):
                    if x not in sets:
                        sets[x] = np.frombuffer(col[x].as_py(), np.uint64)
                a, b = sets[i], sets[j]
                if len(a) > len(b):
                    a, b = b, a
                if 100 * len(a) < percent * len(b):
                    continue
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int((b[at] == a).sum())
                if 100 * both >= percent * (len(a) + len(b) - both):
                    f.join(i, j)
            _edges_of(f, node, rows)
            if len(rows) >= 10000:
                yield _emit(rows)
                rows = []
        if rows:
            yield _emit(rows)

    return run


def _block_pairs(df: DataFrame, key: str, blocks: str, cols: list[str]) -> DataFrame:
    """Deal each group's rows into ``blocks`` blocks and give every pair of blocks (k, b1, b2) its rows, sorted together."""
    df = df.withColumn("blk", F.expr(f"cast(pmod(xxhash64(node, 11), {blocks}) as int)")).withColumn("ob", F.explode(F.expr(f"sequence(0, cast({blocks} as int) - 1)")))
    df = df.select(F.col(key).alias("k"), F.least("blk", "ob").alias("b1"), F.greatest("blk", "ob").alias("b2"), "blk", "node", *cols)
    return df.repartition("k", "b1", "b2").sortWithinPartitions("k", "b1", "b2")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row: documents linked where 100 * intersection >= ``percent`` * union.

    1. Each text becomes its set of distinct 5-word shingles (64-bit hashes) and a signature; equal sets are one node from here on, so
       copies are never paired.
    2. Inverted join: nodes are posted under their (coordinate, value) pairs. A pair of candidates agrees in ``matches(percent)`` of
       COORDINATES, so it shares one of the COORDINATES - matches + 1 rarest postings of either (prefix); only those lists are merged, the long rest is
       skipped and its collisions are counted on the signatures themselves. Lists are cut into blocks of BLOCK, a task compares a pair of
       blocks and passes on a spanning forest of the candidates there, never the pairs.
    3. Connected candidates form clusters. The full sets of their texts (only) are made again, dealt into blocks per cluster, and every
       candidate pair that isn't connected yet is compared on them; what passes is linked.
    4. Components of the links; ``component_id`` is the smallest doc_id, ``kept`` says that a document has it.

    A link is lost only if the signatures of two texts agree in fewer than ``matches(percent)`` places (see there) and no chain of other links
    connects them. Texts that are null or without words have no shingles and are linked with nothing (their component is themselves).
    Rows with one doc_id are one document for ``kept`` but each keeps its row; a null doc_id never is the smallest unless alone, and is
    not kept then. An empty table gives no rows; other columns are ignored.
    """
    out = groups(docs, percent)
    comp = F.coalesce("label", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(False)).alias("kept"))


def chosen(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``(doc_id, th)`` of the rows that stay, one of each group of near-duplicates (th: xxhash64 of the text).

    Of each group the smallest doc_id stays, null last, ties by th. Texts without words are in no group and all stay. Decided row by
    row: of two texts under one doc_id, or two without any, each goes or stays by its own group. Only rows with their group's smallest
    doc_id are aggregated, by doc_id and group, so a large group brings its few candidates and no hot task.
    """
    rows = groups(docs, percent).where((F.col("n") == 0) | F.col("doc_id").eqNullSafe(F.col("label")))
    return rows.groupBy("doc_id", "group", F.when(F.col("n") == 0, F.col("th")).alias("alone")).agg(F.min("th").alias("th")).select("doc_id", "th")


def groups(docs: DataFrame, percent: int) -> DataFrame:
    """``(doc_id, th, n, group, label)`` per row: the text's hash, its set's size, its group (a node of it) and the group's smallest doc_id."""
    base = cut(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.xxhash64("text").alias("th")).mapInArrow(_read(False), BASE_SCHEMA), "near-base")
    nodes = cut(base.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "near-nodes")
    least = matches(percent)
    prefix = COORDINATES - least + 1
    posted = nodes.select("node", F.posexplode("sig").alias("c", "v")).select("node", F.xxhash64("c", "v").alias("e"))
    shared = posted.groupBy("e").agg(F.count("*").alias("n")).where("n >= 2")
    own = posted.join(shared, "e").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("es"))  # COORDINATES at most
    short = own.select("node", F.explode(F.expr(f"slice(es, 1, greatest(0, {prefix} - ({COORDINATES} - size(es))))")).alias("x")).select("node", F.col("x.e").alias("e"))
    short = cut(short, "near-posted")
    lists = short.groupBy("e").agg(F.count("*").alias("n")).where("n >= 2").select("e", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    merged = _block_pairs(short.join(lists, "e").join(nodes.select("node", "sig"), "node"), "e", "blocks", ["sig"])
    cand = cut(merged.mapInArrow(_candidates(least), "a long, b long").distinct(), "near-cand")
    drop_cut(short)
    tidy(docs.sparkSession)
    clusters = components(cand).select("node", F.col("component").alias("cluster"))
    reps = clusters.join(nodes.select("node", "rep"), "node")
    plain = docs.select("doc_id", "text")
    texts = bitmap_filter(plain, "doc_id", reps, "rep").union(plain.where("doc_id is null"))  # a node may have no other
    sets = texts.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(_read(True), SET_SCHEMA)
    sets = cut(sets.join(clusters, "node"), "near-sets")
    weight = sets.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("w")).select("cluster", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("w") / BLOCK_SHINGLES)).alias("blocks"))
    links = cut(_block_pairs(sets.join(weight, "cluster"), "cluster", "blocks", ["sig", "shingles"]).mapInArrow(_confirm(percent, least), "a long, b long").distinct(), "near-links")
    drop_cut(sets)
    tidy(docs.sparkSession)
    linked = nodes.select("node", "rep").join(components(links), "node", "left")
    lowest = linked.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    label = linked.join(lowest, "component", "left").select("node", F.coalesce("component", "node").alias("group"), F.coalesce("least", "rep").alias("label"))
    return base.select("doc_id", "th", "n", "node").join(label, "node", "left").select("doc_id", "th", "n", "group", "label")
