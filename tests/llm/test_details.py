"""Long words, memberships with nulls, id numbers, keys and row-wise stages."""

import time

import numpy as np
from pyspark.sql import functions as F

from evenstride.llm import mixing, neardup, pieces, pii, sharding, toxicity, warc


def test_long_words_merge_as_short_ones_do():
    e = pieces.Encoder(pieces.load(), 5, 0.2)
    r = np.random.RandomState(1)
    words = ["".join(r.choice(list("abcdeinrst日é"), n)) for n in (2, 5, 30, 96, 97, 150, 300)] + ["a" * 200, "na" * 100]
    for k, w in enumerate(words):
        sym = e.symbols(np.frombuffer(w.encode("utf-32-le"), np.uint32))
        out, n = e.words(sym[None], np.array([k * 31], np.uint64))
        assert e.long_word(sym, k * 31).tolist() == out[0, : n[0]].tolist(), w


def test_a_word_of_a_million_characters():
    e = pieces.Encoder(pieces.load(), 5, 0.1)
    text = "".join(np.random.RandomState(2).choice(list("abcdefghijklmnopqrstuvwxyz日本"), 10**6))
    t = time.time()
    ids, ends = e.encode([text], np.zeros(1, np.int64))
    assert time.time() - t < 60
    raw, at = e.decode(ids, ends)
    assert raw.tobytes()[1:].decode() == text and at[0] == len(raw)


def test_memberships_with_nulls(spark):
    rows = [(1, "a b c", ["x"]), (2, "a b", None), (3, "a", []), (4, "a b c d", [None]), (5, "q r", ["x", None, "x"]), (5, "q r", ["x", None, "x"]), (6, None, ["x"]), (None, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source array<string>").withColumns({"size": F.lit(1), "pk": F.lit("p")})
    out = mixing.mix(d).collect()
    assert len(out) == len(rows) and sum(r.taken for r in out) == 14
    by = {r.doc_id: r for r in out}
    assert (by[3].taken, by[3].source_size, by[3].target) == (0, 0, 0.0) and by[2].source_size == by[4].source_size == 2 + 4 + 4 and by[1].source_size == 3 + 4


def test_a_column_of_the_same_name_as_one_of_ours(spark):
    d = spark.createDataFrame([(i, "a b c", "en", f"s{i % 2}", 5) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    d = d.withColumns({"text_crc32": F.lit("mine"), "taken": F.lit(1), "size": F.lit(2)})
    out = mixing.take(d)
    assert out.columns == d.columns and {r.text_crc32 for r in out.collect()} == {"mine"}


def valid(s):
    a, g, z = s.split("-")
    return a not in ("000", "666") and a < "900" and g != "00" and z != "0000"


def test_id_numbers_stay_what_they_are(spark):
    ids = ["001-01-0001", "665-99-9999", "667-01-0001", "899-50-1234", "000-12-3456", "666-12-3456", "900-12-3456", "999-00-0000", "123-00-4567", "123-45-0000"]
    ids += [f"{i * 7 % 1000:03d}-{i % 100:02d}-{i:04d}" for i in range(1500)]
    new = [r.t for r in spark.createDataFrame([(x,) for x in ids], "text string").select(pii.pseudonymise("text", "k").alias("t")).collect()]
    assert [valid(x) for x in ids] == [valid(x) for x in new] and len(set(new)) == len(set(ids))
    assert sum(a == b for a, b in zip(ids, new)) < 5


def test_areas_are_permuted_within_their_class(spark):
    ids = [f"{a:03d}-00-0000" for a in range(1000)]
    new = {r.text: r.t for r in spark.createDataFrame([(x,) for x in ids], "text string").select("text", pii.pseudonymise("text", "k").alias("t")).collect()}
    assert sorted(new.values()) == ids
    assert all(valid(a[:3] + "-11-1111") == valid(b[:3] + "-11-1111") for a, b in new.items())


def test_the_key_is_not_in_the_source(spark):
    assert pii.secret_key("given") == "given" and len(pii.secret_key()) == 32
    spark.conf.set(pii.KEY_SETTING, "of the session")
    try:
        assert pii.secret_key() == "of the session"
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    mails = spark.createDataFrame([("a@x.org",), ("a@x.org",), ("a@y.org",), ("a@z.org",), ("a@v.org",), ("a@w.org",)], "text string")
    new = [r.t for r in mails.select(pii.pseudonymise("text", "k").alias("t")).collect()]
    assert new[0] == new[1] and len({x[0] for x in new}) > 1 and all(x[1:] == y.text[1:] for x, y in zip(new, mails.collect()))


def test_feistel_against_plain_python(spark):
    import hashlib

    def plain(vals, kind, key):
        acc = list(vals)
        for rd in range(pii.ROUNDS):
            other = ",".join(str(v) for j, (v, _) in enumerate(acc) if j % 2 != rd % 2)
            prf = lambda i: int(hashlib.sha256("|".join([key, kind, str(len(acc)), str(rd), str(i), other]).encode()).hexdigest()[:12], 16)  # noqa: E731, B023
            acc = [((v + prf(i)) % r, r) if i % 2 == rd % 2 else (v, r) for i, (v, r) in enumerate(acc)]
        return [v for v, _ in acc]

    def ip(x):
        return ".".join(map(str, plain([(int(o), 256) for o in x.split(".")], "ipv4", "k")))

    def phone(x):
        d = [int(c) for c in x if c.isdigit()]
        new = plain([(d[0] - 2, 8) if d[0] >= 2 else (d[0], 2), *((v, 10) for v in d[1:])], "phone", "k")
        new[0] += 2 if d[0] >= 2 else 0
        it = iter(new)
        return "".join(str(next(it)) if c.isdigit() else c for c in x)

    for f, values in ((ip, ["79.31.107.87", "10.0.0.1", "255.255.255.255"]), (phone, ["437-555-0689", "(123) 456-7890", "037 555 0000"])):
        got = [r.t for r in spark.createDataFrame([(x,) for x in values], "text string").select(pii.pseudonymise("text", "k").alias("t")).collect()]
        assert got == [f(x) for x in values]


def test_rows_are_chosen_one_by_one(spark):
    w = [f"w{i}" for i in range(100)]
    near = " ".join(["x", *w[1:]])
    rows = [(1, " ".join(w)), (5, near), (5, "something else of its own entirely"), (None, " ".join(w)), (None, "two rows without an id"), (None, "two rows without an id"), (7, ""), (7, None), (8, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.chosen(d).join(d.withColumn("th", F.xxhash64("text")).withColumnRenamed("doc_id", "id"), "th").where("doc_id <=> id").select("doc_id", "text").distinct().collect()
    assert {(r.doc_id, r.text) for r in got} == {(1, " ".join(w)), (5, "something else of its own entirely"), (None, "two rows without an id"), (7, ""), (7, None), (8, "")}


def test_near_duplicate_stage_without_ids(spark, sf_dir):
    import corpus_pipeline as cp

    rows = [(None, "a b c d e f", "en", "s", 11)] * 3 + [(4, "a b c d e f", "en", "s", 11), (4, "other words stand here now", "en", "s", 11), (9, "", "en", "s", 0), (9, "", "en", "s", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text) for r in cp.near_duplicate_stage(spark, d, sf_dir).collect())
    assert got == [(4, "a b c d e f"), (4, "other words stand here now"), (9, "")]


def test_long_and_short_tokens_are_decoded():
    m = toxicity.CharModel({"stone": 3.0, "bad": 2.0}, ["idiot", "bad"])
    words = lambda t: toxicity.token_words(t, m)
    assert "idiot" in words("1d" + "i" * 60 + "0t") and "bad" in words("b4d")
    assert any("idiot" in w for w in words("x" + "st0ne" * 20 + "1d10t" + "st0ne" * 9))
    assert toxicity.spaced_words("he is b a d today", m) == ["bad"]
    assert toxicity.suspicious("1d10t" * 30) and not toxicity.suspicious("some.one@" + "x" * 60 + ".org") and not toxicity.suspicious("12")


def test_shards_are_near_equal(spark):
    import random

    r = random.Random(4)
    rows = [(i, "x" * r.choice((10, 50, 400)) + str(i % 3000)) for i in range(6000)] + [(10**6 + i, "copy " * 500) for i in range(40)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    load = sorted(x.b for x in out)
    group = 40 * (2500 + 16)  # the copies stay together
    assert len(load) == 40 and load[-1] - load[0] <= group and load[-2] - load[0] <= 0.02 * load[0]


def test_a_heavy_payload(spark, monkeypatch):
    rows = [(i, "u", "same" if i % 3 else f"own {i // 2}") for i in range(1, 400)] + [(None, "u", "same"), (2, "u", "same")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [sorted(map(tuple, warc.archive(d).collect()), key=str)]
    monkeypatch.setattr(warc, "HEAVY", 1)
    got.append(sorted(map(tuple, warc.archive(d).collect()), key=str))
    assert got[0] == got[1]
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    assert sorted((str(r[0]), r[4]) for r in got[0]) == sorted((str(i), first[t] if i is not None and first[t] < i else None) for i, _, t in rows)
