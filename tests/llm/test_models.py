"""WARC, near-duplicates, embeddings, quality, toxicity, encoding and the pipeline against brute force."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenstride.llm import common, embedding, neardup, pieces, quality, toxicity, warc

PAGES = "page_id long, url string, html string"


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    got = {x.node: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if any(a != b and x in (a, b) for a, b in edges)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_warc_round_trip(spark, tmp_path):
    nasty = ["", "\r\n\r\n", "a\r\n\r\n\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", "é🎉" * 700, "x" * 5000, "\n", "tail\r\n"]
    rows = [(i, f"http://h/{i} a\n" if i % 3 else None, t) for i, t in enumerate(nasty * 2)] + [(100, None, None), (None, "u", "null id"), (7, "u", nasty[7]), (50, "u", "z")]
    d = spark.createDataFrame(rows, PAGES).withColumn("value", F.lit(1))
    got = [tuple(r) for r in warc.archive(d, chunk=64).collect()]
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", 10**9), i)
    want = []
    for i, _, t in rows:
        b = (t or "").encode()
        again = i is not None and first[t or ""] < i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[t or ""] if again else None))
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(want, key=key)
    # the payload itself, chunk by chunk, in files that hold plain WARC records
    path = str(tmp_path / "w")
    warc.write_warc(warc.chunk_table(d, 64), path)
    parts = warc.read_warc(spark, path, with_data=True).where("record_type = 'response' and page_id = 4").orderBy("chunk_no").collect()
    assert max(len(p.data) for p in parts) <= 64 and b"".join(bytes(p.data) for p in parts) == nasty[4].encode()
    raw = b"".join(gzip.open(f).read() for f in tmp_path.glob("w/*.gz"))
    assert raw.count(b"WARC-Type: continuation") > 60 and raw.startswith(b"WARC/1.1\r\n")
    assert warc.archive(d.limit(0)).count() == 0


def test_warc_parser_streams_and_detects_damage():
    body = b"HTTP/1.1 200 OK\r\n\r\n" + b"payload\r\n\r\nmore"
    pay = body[19:]
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:evenstride:page:5>\r\nWARC-Payload-Digest: sha1:%s\r\nX-Payload-Length: %d\r\nContent-Length: %d\r\n\r\n"
    good = head % (base64.b32encode(hashlib.sha1(pay).digest()), len(pay), len(body)) + body + b"\r\n\r\n"
    for n in (1, 3, 1000):
        p = warc.Parser()
        done = [r for s in range(0, 2 * len(good), n) for r in p.feed((good * 2)[s : s + n]) if r[-1]]
        assert [r[:2] for r in done] == [(5, len(pay))] * 2
    with pytest.raises(ValueError, match="differs"):
        list(warc.Parser().feed(good.replace(b"more", b"mare")))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}) if w else set()


def near_brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    low = defaultdict(lambda: None)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[root(k)] = i if low[root(k)] is None else min(low[root(k)], i)
    return sorted(((i, len(s), low[root(k)], i is not None and i == low[root(k)]) for k, (i, s) in enumerate(sets)), key=str)


def edited(words, r, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(500)]
    base = [[r.choice(vocab) for _ in range(n)] for n in (200, 120, 60, 300)]
    passage = [r.choice(vocab) for _ in range(60)]
    texts = [edited(b, r, k) for b in base for k in (0, 1, 2, 3, 4, 6) for _ in range(4)] + [" ".join(b) for b in base] * 3
    texts += [" ".join([r.choice(vocab) for _ in range(80)] + passage) for _ in range(20)]
    texts += ["", None, " \t\n", "one", "ONE", "one two", "One  Two", "a b c d e", "A B\nC D\x0bE", "é È", "É È"]
    texts.append(" ".join(r.choice(vocab) for _ in range(30000)))
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[0]), (None, "alone it is")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted((tuple(x) for x in neardup.near_duplicates(d.repartition(3)).collect()), key=str)
    assert got == near_brute(rows)
    assert len({g[2] for g in got}) < len(got) - 30


def test_a_document_without_id_links_others(spark):
    w = [f"w{i}" for i in range(200)]
    one = [f"x{i}" if i in (20, 60, 100) else x for i, x in enumerate(w)]
    two = [f"y{i}" if i in (40, 80, 120) else x for i, x in enumerate(one)]
    rows = [(7, " ".join(w)), (None, " ".join(one)), (5, " ".join(two))]
    got = sorted((tuple(x) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == near_brute(rows) and {g[2] for g in got} == {5}


def test_near_duplicates_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(x) for x in neardup.near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("block", [512, 3])
def test_near_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(embedding, "BLOCK", block)
    r = np.random.RandomState(2)
    c = r.standard_normal((12, 24))
    rows = [x + s * r.standard_normal(24) for x in c for s in (0.02, 0.03, 0.05, 0.1, 0.15)] + [r.standard_normal(24) for _ in range(40)]
    rows = [v.astype("f4").tolist() for v in rows] + [rows[0].astype("f4").tolist()] * 3
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0, None] + [0.5] * 22, [0.0] * 24, [3.0]]
    data = list(enumerate(rows + odd)) + [(0, rows[0])]
    d = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("codes", F.lit(2))
    got = sorted(tuple(x) for x in embedding.near_vectors(d.repartition(3)).collect())
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in data]
    unit = [np.array(v, "f8") / np.linalg.norm(np.array(v, "f8")) if g else None for (_, v), g in zip(data, good)]
    link = lambda a, b: good[a] and good[b] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.95
    n = len(data)
    adj = [[b for b in range(n) if b != a and link(a, b)] for a in range(n)]
    comp = list(range(n))
    for _ in range(n):
        new = [min([comp[a]] + [comp[b] for b in adj[a]]) for a in range(n)]
        if new == comp:
            break
        comp = new
    want = sorted((data[a][0], len(adj[a]), min(data[b][0] for b in range(n) if comp[b] == comp[a]), data[a][0] == min(data[b][0] for b in range(n) if comp[b] == comp[a])) for a in range(n))
    assert got == want and sum(w[1] for w in want) > 60
    assert embedding.near_vectors(d.limit(0)).count() == 0


def kn_brute(texts, order):
    """Interpolated modified Kneser-Ney by its definition, in plain dictionaries."""
    ids = lambda t: [0] * (order - 1) + quality.token_ids(np.array([ord(c) for c in t], np.uint32)).tolist()
    count = Counter(tuple(x[i - order + 1 : i + 1]) for x in map(ids, texts) for i in range(order - 1, len(x)))
    level = {order: dict(count)}
    for m in range(order - 1, 0, -1):
        level[m] = Counter(g[1:] for g in level[m + 1])
    disc = {m: quality.discounts([sum(v == k for v in level[m].values()) for k in (1, 2, 3, 4)]) for m in level}
    total, held = defaultdict(lambda: defaultdict(float)), defaultdict(lambda: defaultdict(float))
    for m in level:
        for g, c in level[m].items():
            total[m][g[:-1]] += c
            held[m][g[:-1]] += disc[m][min(c, 3) - 1]
    uniform = 1 / (len(level[1]) + 1)

    def p(g):
        m = len(g)
        low = p(g[1:]) if m > 1 else uniform
        if g[:-1] not in total[m]:
            return low
        c = level[m].get(g, 0)
        return (max(c - disc[m][min(c, 3) - 1], 0) if c else 0) / total[m][g[:-1]] + held[m][g[:-1]] / total[m][g[:-1]] * low

    return lambda t: -sum(math.log(p(tuple(x[i - order + 1 : i + 1]))) for x in [ids(t)] for i in range(order - 1, len(x)))


@pytest.mark.parametrize("shard_rows", [10**6, 150])
def test_kneser_ney(spark, shard_rows, monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 37)
    r = random.Random(4)
    texts = ["".join(r.choice("abcde ") for _ in range(r.randrange(1, 90))) for _ in range(40)] + ["日本語 12 345", "x"]
    model = quality.train(spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(3))
    probe = texts[:10] + ["zzz unknown 99", "abc" * 50, "é日", "", None]
    d = spark.createDataFrame([(i, "en", t) for i, t in enumerate(probe)] + [(99, "xx", "other language"), (0, "en", texts[0])], "doc_id long, lang string, text string")
    got = {x.doc_id: x for x in quality.score(d, model, shard_rows).collect()}
    brute = kn_brute(texts, quality.ORDER)
    for i, t in enumerate(probe):
        assert got[i].n == len(t or "") and got[i].loss == pytest.approx(brute(t or ""), rel=1e-5, abs=1e-6)
    assert got[99].n == 0 and got[0].copies == 2


def corpus(n, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice(["th", "er", "on", "an", "re", "in"]) for _ in range(r.randrange(1, 5))) for _ in range(300)]
    return [" ".join(r.choice(words) for _ in range(r.randrange(20, 80))) + "." for _ in range(n)], r


def test_quality_classifies(spark):
    good, r = corpus(240)
    bad = ["".join(r.choice("#$%&*!|xyzqj") for _ in range(200)) for _ in range(30)]
    rows = [(i, t, "en" if i % 2 else None, "s", 1) for i, t in enumerate(good + bad)] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "un texte", "fr", "s", 8), (None, good[0], "en", "s", 1), (3, good[3], "en", "s", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n", F.lit(1))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(i, 0, 0) for i in range(240, 250)] + [(5, 1, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    out = quality.classify(d, labels).collect()
    assert len(out) == len(rows)
    kept = {x.doc_id: x.kept for x in out}
    assert not any(kept[i] for i in range(240, 270)) and sum(kept[i] for i in range(240)) >= 238
    assert kept[900] and kept[901] and kept[902] and kept[None]
    assert quality.classify(d.limit(0), labels).count() == 0
    assert all(x.kept for x in quality.classify(d, labels.limit(0)).collect())


def test_viterbi_is_the_shortest_path():
    m = toxicity.CharModel({"stone": 3.0, "little": 2.0, "line": 1.0}, ["idiot", "loser", "stupid"])

    def brute(signs):
        paths = [("^^", 0.0, "")]
        for c in signs:
            new = []
            for before, paid, text in paths:
                arcs = [(c, 0.0)] if c.isalpha() else [(x, toxicity.COST_SIGN) for x in toxicity.SIGNS.get(c, "")] + [("", toxicity.COST_DROP_DIGIT if c.isdigit() else toxicity.COST_DROP)]
                for x, price in arcs:
                    if x:
                        new.append((before[1] + x, paid + price + m.cost(before, x), text + x))
                        if x == before[1]:
                            new.append((before, paid + price + toxicity.COST_REPEAT, text))
                    else:
                        new.append((before, paid + price, text))
            paths = new
        return min((p + m.cost(b, "$"), t) for b, p, t in paths)[1]

    for s in ("1d10t", "l0$er", "stuuupid", "$tupid", "5t0ne", "l1ne", "id!ot!", "s,t,u,p,1,d"):
        assert m.decode(s) == brute(s), s
    assert m.decode("idiotstone", breaks=True).split() == ["idiot", "stone"]


def test_toxicity(spark):
    good, r = corpus(900, 3)
    insults = ["idiot", "loser", "stupid"]
    rows, labels = [], []
    for i, t in enumerate(good):
        if i % 5 == 0:
            t = t.replace(" ", f" {insults[i % 3]} ", 2)
        rows.append((i, t))
        labels.append((i, 1, int(i % 5 == 0)))
    tricks = ["you 1d10t here", "the l0$er was", "s t u p i d thing", "stuuuupid", "id-iot"]
    rows += [(10000 + k, t) for k, t in enumerate(tricks)] + [(20000, None), (20001, ""), (None, "nothing"), (20002, "it was 3 of 10 on 2.0, a b c"), (1, good[1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(9)).withColumn("toxic", F.lit(1))
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None), (10, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(d, lab).collect()
    assert len(out) == len(rows)
    by = {x.doc_id: x for x in out}
    for i in range(900):
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    test = [i for i in range(900) if by[i].held_out]
    assert sum(by[i].predicted == int(i % 5 == 0) for i in test) / len(test) > 0.97
    assert all(by[10000 + k].predicted == 1 for k in range(len(tricks))), [(t, by[10000 + k].score) for k, t in enumerate(tricks)]
    assert all(by[k].predicted == 0 for k in (20000, 20001, 20002, None)) and not by[None].held_out
    assert all(0 <= x.score <= 1 for x in out)
    assert toxicity.score_documents(d.limit(0), lab).count() == 0
    assert {x.predicted for x in toxicity.score_documents(d, lab.limit(0)).collect()} == {0}


TEXTS = ["", "a", "The quick brown fox", "  two  spaces   here ", " x\n\n y\t z\r\n", "日本語 text 🎉🎉 ▁ literal", "▁", "ﬁ ligature Ω½", "a" * 300, "\n", "é́ naïve", "word " * 5000]


def test_encoding_matches_the_model_without_dropout():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    e = pieces.Encoder(pieces.load(), 1, 0.0)
    ids, ends = e.encode(TEXTS, np.zeros(len(TEXTS), np.int64))
    s = 0
    for t, z in zip(TEXTS, ends.tolist()):
        if "▁" not in t:
            assert ids[s:z].tolist() == sp.encode(t), t
        s = z


def test_dropout_follows_the_agenda():
    m = pieces.load()
    e = pieces.Encoder(m, 5, 0.3)

    def agenda(word, key):
        s, b = [int(x) for x in e.symbols(np.frombuffer(word.encode("utf-32-le"), np.uint32))], list(range(len(word) + 1))
        while True:
            c = []
            for i in range(len(s) - 1):
                to = int(e.merge_of(np.array([s[i]]), np.array([s[i + 1]]))[0])
                if to >= 0 and not e._dropped(np.array([key], np.uint64), *(np.array([b[i + k]]) for k in range(3)))[0]:
                    c.append((int(m["rank"][to]), i, to))
            if not c:
                return s
            _, i, to = min(c)
            s[i : i + 2], b[i + 1 : i + 2] = [to], []

    for k, w in enumerate([" understanding", " international", " ab", " aaaa", "x", " unbelievable", " é日x"]):
        sym = e.symbols(np.frombuffer(w.encode("utf-32-le"), np.uint32))[None]
        out, n = e.words(sym, np.array([k * 977], np.uint64))
        assert out[0, : n[0]].tolist() == agenda(w, k * 977), w


def test_encoding_round_trip(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (None, "no id"), (2, TEXTS[2]), (60, "The quick brown fox"), (61, "The quick brown fox"), (62, "The quick brown fox")], "doc_id long, text string").withColumn("ids", F.lit(3))
    out = pieces.encode(d, dropout=0.5)
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 6 and all(r.lossless and r.n_tokens == len(r.ids) for r in rows)
    back = {r.doc_id: r.text for r in pieces.decode(out).collect()}
    assert all(back[i] == t for i, t in enumerate(TEXTS)) and back[50] == "" and back[None] == "no id"
    a, b = ({r.doc_id: r.ids for r in pieces.encode(d.repartition(3), dropout=0.5, seed=s).collect()} for s in (11, 12))
    assert a == {r.doc_id: r.ids for r in rows} and a != b
    assert len({tuple(a[i]) for i in (60, 61, 62, 2)}) > 1
    assert pieces.encode(d.limit(0)).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    d, sizes = docs, [docs.count()]
    for name, stage in cp.STAGES:
        new = common.cut(stage(spark, d, sf_dir))
        if name != cp.STAGES[-1][0]:
            assert new.columns == docs.columns
        rows, olds = new.collect(), {r.doc_id: r for r in d.collect()}
        if name.startswith("quality"):
            gone = set(olds) - {r.doc_id for r in rows}
            clean = {r.doc_id for r in labels.where("quality = 1").collect()}
            assert len(gone) > 5 and len(gone & clean) <= 0.02 * len(clean)
        elif name.startswith("MinHash"):
            want = {i for i, _, _, kept in near_brute([(r.doc_id, r.text) for r in olds.values()]) if kept}
            assert {r.doc_id for r in rows} == want and len(rows) == len(want)
        elif name == "PII":
            assert len(rows) == len(olds)
            assert not any(re.search(r"[\w.]+@", olds[r.doc_id].text) and r.text == olds[r.doc_id].text for r in rows)
        elif name.startswith("mixing"):
            total = sum(len(r.text.split()) for r in olds.values())
            assert abs(sum(len(r.text.split()) for r in rows) - total) <= 1 and len(rows) != len(olds)
        else:
            assert all(r.lossless for r in rows) and len(rows) == sizes[-1]
        sizes.append(len(rows))
        d = new
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", None, 0), (2, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5)], docs.schema)
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        assert stage(spark, odd, sf_dir).count() <= 4
