"""Embedding near-duplicates: Euclidean p-stable hashing in multiple tables, then exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop_cut, grouped_batches

#: Width of a quantised projection, projections in a table's key, tables. Unit vectors with a cosine of 0.95 are 0.316 apart and share a
#: slot of one projection with probability 0.90, a key with 0.08, some key with 0.994; at 0.96 some key with 0.999, at 0.97 with
#: 0.99994. Unrelated vectors (1.41 apart) share a slot with 0.57 and a key with 1e-6.
WIDTH, PROJECTIONS, TABLES = 2.5, 24, 64
#: Vectors of a bucket that a task compares at once.
BLOCK = 512


def _vectors(col, n: int) -> list:
    """Vectors as float64 arrays; None where the vector is null, empty, zero or holds a null or non-finite component."""
    out = []
    for i in range(n):
        v = None
        if col[i].is_valid:
            x = np.array(col[i].values.to_numpy(zero_copy_only=False), np.float64)
            norm = np.linalg.norm(x) if len(x) and np.isfinite(x).all() else 0.0
            if norm > 0 and np.isfinite(norm):
                v = x
        out.append(v)
    return out


def _family(dim: int, seed: int, tables: int, projections: int, width: float, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    key = (dim, seed, tables, projections, width)
    if key not in cache:
        r = np.random.RandomState(seed + dim)
        cache[key] = r.standard_normal((dim, tables * projections)), r.uniform(0, width, tables * projections)
    return cache[key]


def _codes(seed: int, tables: int, projections: int, width: float):
    """node and the key of each table, 32 bits; vectors that link with nothing have no keys."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        mul = np.random.RandomState(seed).randint(1, 1 << 62, projections, dtype=np.int64) * 2 + 1
        for b in batches:
            vecs = _vectors(b.column(1), b.num_rows)
            codes: list = [None] * b.num_rows
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vecs):
                if v is not None:
                    by_dim.setdefault(len(v), []).append(i)
            for dim, at in by_dim.items():
                a, shift = _family(dim, seed, tables, projections, width)
                for s in range(0, len(at), 2048):
                    part = at[s : s + 2048]
                    x = np.stack([vecs[i] for i in part])
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    q = np.floor((x @ a + shift) / width).astype(np.int64).reshape(len(part), tables, projections)
                    with np.errstate(over="ignore"):
                        h = ((q * mul).sum(2) ^ dim) * np.int64(0x5851F42D4C957F2D)
                    h = (h >> 32).astype(np.int32)
                    for i, row in zip(part, h):
                        codes[i] = row
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.list_(pa.int32()))], ["node", "codes"])

    return run


def _links(least: float):
    """Of each pair of blocks: a row (a, null, n) with the vectors that a links with there, and a spanning forest as rows (a, b, 0).

    A pair counts in the first table that holds both, so tables don't count it twice.
    """
    def run(batches) -> Iterator:
        import pyarrow as pa

        out: list = []
        for g in grouped_batches(batches, ["t", "k", "b1", "b2"]):
            n = g.num_rows
            if n < 2:
                continue
            node, blk, copies = g.column("node").to_numpy(), g.column("blk").to_numpy(), g.column("copies").to_numpy()
            t, b1, b2 = (g.column(c)[0].as_py() for c in ("t", "b1", "b2"))
            vecs = _vectors(g.column("embedding").combine_chunks(), n)
            flat = g.column("codes").combine_chunks()
            codes = flat.values.to_numpy()[flat.offsets[0].as_py() :].reshape(n, -1) if n else None
            left, right = np.flatnonzero(blk == b1), np.flatnonzero(blk == b2)
            dims = {len(v) for v in vecs}
            if not len(left) or not len(right) or len(dims) > 1 and b1 == b2 and n < 2:
                continue
            ok = np.zeros((len(left), len(right)), bool)
            for dim in dims:
                li, ri = [k for k, i in enumerate(left) if len(vecs[i]) == dim], [k for k, i in enumerate(right) if len(vecs[i]) == dim]
                if not li or not ri:
                    continue
                x, y = np.stack([vecs[left[k]] for k in li]), np.stack([vecs[right[k]] for k in ri])
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                y /= np.linalg.norm(y, axis=1, keepdims=True)
                ok[np.ix_(li, ri)] = x @ y.T >= least
            if b1 == b2:
                ok = np.triu(ok, 1)
            i, j = np.nonzero(ok)
            i, j = left[i], right[j]
            if t:
                new = np.ones(len(i), bool)
                for s in range(0, len(i), 20000):
                    new[s : s + 20000] = ~(codes[i[s : s + 20000], :t] == codes[j[s : s + 20000], :t]).any(1)
                i, j = i[new], j[new]
            if not len(i):
                continue
            links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
            for x in np.flatnonzero(links):
                out.append((int(node[x]), None, int(links[x])))
            up = list(range(n))
            for p, q in zip(i.tolist(), j.tolist()):
                r, s = p, q
                while up[r] != r:
                    up[r] = r = up[up[r]]
                while up[s] != s:
                    up[s] = s = up[up[s]]
                if r != s:
                    up[max(r, s)] = min(r, s)
                    out.append((int(node[p]), int(node[q]), 0))
            if len(out) >= 20000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "n"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "n"])

    return run


def near_vectors(vectors: DataFrame, least: float = 0.95, seed: int = 17, width: float = WIDTH, projections: int = PROJECTIONS, tables: int = TABLES) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors(vec_id, embedding)``: vectors linked by cosine >= ``least``.

    Equal vectors are one node (n_links counts each copy). Nodes are posted under their key in each table; buckets of one are left out,
    larger ones cut into blocks of BLOCK, and a task compares a pair of blocks in double precision. It returns counts per vector and a
    spanning forest, so a bucket of any size makes no pairs. Each pair counts once, in the first table that holds it.

    A vector that is null, empty, zero or holds null or non-finite components has no links and is its own component. Vectors of
    different lengths never link. Rows with one vec_id and equal vectors count as separate rows. An empty table gives no rows.
    """
    node = F.xxhash64("embedding")
    base = vectors.select("vec_id", "embedding", F.when(F.col("embedding").isNotNull(), node).alias("node"))
    nodes = cut(base.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep"), F.first("embedding").alias("embedding")), "emb-nodes")
    codes = cut(nodes.select("node", "embedding").mapInArrow(_codes(seed, tables, projections, width), "node long, codes array<int>").where("codes is not null"), "emb-codes")
    posted = codes.select("node", F.posexplode("codes").alias("t", "k"))
    full = posted.groupBy("t", "k").agg(F.count("*").alias("m")).where("m >= 2").select("t", "k", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    met = posted.join(full, ["t", "k"])
    met = met.withColumn("blk", F.expr("cast(pmod(xxhash64(node, 11), blocks) as int)")).withColumn("ob", F.explode(F.expr("sequence(0, cast(blocks as int) - 1)")))
    met = met.select("t", "k", F.least("blk", "ob").alias("b1"), F.greatest("blk", "ob").alias("b2"), "blk", "node").join(nodes.select("node", "copies", "embedding"), "node").join(codes, "node")
    keys = ["t", "k", "b1", "b2"]
    found = cut(met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_links(least), "a long, b long, n long"), "emb-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    comp = components(found.where("b is not null").select("a", "b"))
    linked = nodes.select("node", "copies", "rep").join(comp, "node", "left").join(counts, "node", "left").join(codes.select("node", F.lit(True).alias("usable")), "node", "left")
    small = linked.where("component is not null").groupBy("component").agg(F.min("rep").alias("low"))
    info = linked.join(small, "component", "left").select("node", F.coalesce("usable", F.lit(False)).alias("usable"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("low", "rep").alias("low"))
    out = base.select("vec_id", "node").join(info, "node", "left")
    ok = F.coalesce("usable", F.lit(False))
    cid = F.when(ok, F.col("low")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(ok, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), F.coalesce(F.col("vec_id") == cid, F.lit(False)).alias("kept"))
