"""Mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, tidy, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A document is taken so many times at most.
REPEATS = 3


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> dict[str | None, float]:
    """Share all words by weight; a source stops at ``repeats`` times its size, the excess is reshared by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = float(sum(sizes.values())), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > repeats * sizes[s]]
        if not over:
            out |= share
            break
        for s in over:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def quotas(target: dict[str | None, float]) -> dict[str | None, int]:
    """Whole words with the same sum, by largest remainders."""
    out = {s: int(t) for s, t in target.items()}
    short = round(sum(target.values())) - sum(out.values())
    for s in sorted(target, key=lambda s: (out[s] - target[s], s is None, s or ""))[: max(0, short)]:
        out[s] += 1
    return out


def min_cost_flow(arcs: list[tuple[int, int, int, int]], source: int, sink: int, nodes: int) -> list[int]:
    """Flow on each arc ``(from, to, capacity, cost)`` of the cheapest maximum flow: successive shortest paths with potentials."""
    head: list[list[int]] = [[] for _ in range(nodes)]
    to, cap, cost = [], [], []
    for u, v, c, w in arcs:
        head[u].append(len(to))
        to.append(v), cap.append(c), cost.append(w)
        head[v].append(len(to))
        to.append(u), cap.append(0), cost.append(-w)
    pot = [0] * nodes
    while True:
        dist, via = [None] * nodes, [-1] * nodes
        dist[source], heap = 0, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in head[u]:
                if cap[e] and (dist[to[e]] is None or d + cost[e] + pot[u] - pot[to[e]] < dist[to[e]]):
                    dist[to[e]] = d + cost[e] + pot[u] - pot[to[e]]
                    via[to[e]] = e
                    heapq.heappush(heap, (dist[to[e]], to[e]))
        if dist[sink] is None:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        pot = [p + (d or 0) if d is not None else p for p, d in zip(pot, dist)]
        push, v = None, sink
        while v != source:
            e = via[v]
            push = cap[e] if push is None else min(push, cap[e])
            v = to[e ^ 1]
        v = sink
        while v != source:
            e = via[v]
            cap[e] -= push
            cap[e ^ 1] += push
            v = to[e ^ 1]


def route(patterns: dict[tuple, int], quota: dict, repeats: int = REPEATS) -> dict[tuple, int]:
    """Words to take from each membership pattern: the k-th repetition of a pattern's words costs k - 1 a word (convex)."""
    ps, ss = sorted(patterns, key=repr), sorted(quota, key=lambda s: (s is None, s or ""))
    p_at, s_at = {p: 1 + i for i, p in enumerate(ps)}, {s: 1 + len(ps) + i for i, s in enumerate(ss)}
    sink = 1 + len(ps) + len(ss)
    arcs = [(0, p_at[p], patterns[p], k) for p in ps for k in range(repeats)]
    arcs += [(p_at[p], s_at[s], repeats * patterns[p], 0) for p in ps for s in p]
    arcs += [(s_at[s], sink, quota[s], 0) for s in ss]
    flow = min_cost_flow(arcs, 0, sink, sink + 1)
    return {p: sum(flow[repeats * i : repeats * (i + 1)]) for i, p in enumerate(ps)}


def pattern(name: str) -> tuple:
    """The sources of a membership pattern from its name: '+' and hexadecimal letters, or '-' for null, apart by commas."""
    return tuple(None if x == "-" else bytes.fromhex(x[1:]).decode() for x in name.split(",")) if name else ()


def mix(docs: DataFrame, seed: int = 7, parts: int = 4096) -> DataFrame:
    """How many words of each document the mix takes: ``(doc_id, size, source_size, target, taken, text_crc32)``, one row per input row.

    ``source`` is a string, or an array of strings where sources overlap (a document that belongs to several may fill any of their
    quotas; source_size and target are then summed over them). Documents are aggregated by membership pattern; the flow runs on the
    driver over that table (one row per pattern, which the number of sources bounds, not the number of documents). A pattern's words
    are then taken whole as often as they fit, and what remains goes to its documents in the order of a seeded hash; the last of them
    is taken in part, so a source's taken words equal its quota. No task orders a whole source: the hash deals documents into ``parts``
    parts, whose sums give each part its offset.

    A null text has size 0, a null source (or a null array of them) is a source of its own (the last); a document with an empty array
    belongs to none and is not taken. Repeated rows count each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tidy(spark)
    many = dict(docs.dtypes)["source"].startswith("array")
    member = F.coalesce(F.array_sort(F.array_distinct("source")), F.array(F.lit(None).cast("string"))) if many else F.array("source")
    name = F.expr("array_join(transform(p, x -> if(x is null, '-', concat('+', hex(x)))), ',')")  # of a pattern, without nulls
    rows = docs.select("doc_id", "text", member.alias("p"))
    base = cut(rows.select("doc_id", name.alias("pk"), word_count(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.xxhash64(F.lit(seed), "doc_id", F.crc32("text")).alias("u")), "mix")
    found = {r.pk: (pattern(r.pk), r.s) for r in base.groupBy("pk").agg(F.sum("size").alias("s")).collect()}  # a row per pattern
    pats = dict(found.values())
    sizes: dict = {}
    for p, n in pats.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    if many:  # shares are of all words once, however many sources hold them
        total = sum(sizes.values())
        target = {s: t * (sum(pats.values()) / total if total else 0) for s, t in targets(sizes).items()}
    else:
        target = targets(sizes)
    took = route(pats, quotas(target))
    plan = spark.createDataFrame(
        [(pk, sum(sizes[s] for s in p), float(sum(target[s] for s in p)), took[p] // n if n else 0, took[p] % n if n else 0) for pk, (p, n) in found.items()],
        "pk string, source_size long, target double, whole long, rest long",
    )
    part = F.pmod(F.shiftright("u", 20), F.lit(parts))
    base = base.withColumn("part", part)
    sums = base.groupBy("pk", "part").agg(F.sum("size").alias("n"))
    before = sums.select("pk", "part", (F.sum("n").over(Window.partitionBy("pk").orderBy("part")) - F.col("n")).alias("before"))
    w = Window.partitionBy("pk", "part").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.col("before") + F.sum("size").over(w) - F.col("size")
    extra = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("ahead")))
    return (
        base.join(before, ["pk", "part"])
        .withColumn("ahead", ahead)
        .join(plan, "pk")
        .select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"), "text_crc32")
    )


def take(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document once for each time it is taken whole, and its first words for a part.

    Documents of which nothing is taken go; ``n_chars``, if there, is that of the text that stays. Equal rows are told apart by number.
    """
    names = docs.columns
    w = Window.partitionBy("__doc", "__crc")
    plan = mix(docs, seed).select(F.col("doc_id").alias("__doc"), F.col("text_crc32").alias("__crc"), "size", "taken")
    plan = plan.withColumn("__rn2", F.row_number().over(w.orderBy("taken"))).where("taken > 0")
    plan = plan.select(F.col("__doc").alias("__id"), F.col("__crc").alias("__crc2"), "__rn2", F.expr("taken div size").alias("__whole"), F.expr("taken % size").alias("__part"))
    rows = docs.withColumn("__crc", F.crc32(F.coalesce("text", F.lit("")))).withColumnRenamed("doc_id", "__doc").withColumn("__rn", F.row_number().over(w.orderBy("__doc")))
    got = rows.join(plan, F.expr("__doc <=> __id and __crc = __crc2 and __rn = __rn2"))
    got = got.withColumn("__words", F.explode(F.expr("concat(array_repeat(-1L, cast(__whole as int)), if(__part > 0, array(__part), array()))")))
    words = F.regexp_extract_all("text", F.lit(WORD + WORD.replace("[^", "[").replace("+", "*")), F.lit(0))
    first = F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("__words"), F.lit(0)).cast("int")), "")
    got = got.withColumn("text", F.when(F.col("__words") < 0, F.col("text")).otherwise(first)).withColumnRenamed("__doc", "doc_id")
    if "n_chars" in names:
        got = got.withColumn("n_chars", F.length("text").cast("long"))
    return got.select(*names)
