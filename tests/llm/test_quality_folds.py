"""Quality: all trusted text trains and sets the thresholds, each document held out of the model that scores it."""

import math

import pytest
from pyspark.sql import functions as F
from test_models import corpus, kn_brute

from evenstride.llm import quality


def test_threshold_is_a_quantile_of_all_held_out_trusted_text(spark):
    good, _ = corpus(120, 7)
    rows = [(i, t, "en" if i % 3 else "fr") for i, t in enumerate(good)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(120)], "doc_id long, quality int")
    fold = {x.doc_id: x.f for x in d.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(quality.FOLDS)).alias("f")).collect()}
    out = {x.doc_id: x for x in quality.classify(d, labels).collect()}
    for lang in ("en", "fr"):
        mine = [(i, t) for i, t, x in rows if x == lang]
        brute = {k: kn_brute([t for i, t in mine if fold[i] != k], quality.ORDER) for k in range(quality.FOLDS)}
        loss = {i: brute[fold[i]](t) for i, t in mine}
        mid = sorted(loss[i] / len(t) for i, t in mine)[(len(mine) - 1) // 2]
        smooth = sorted((loss[i] + quality.PRIOR_CHARS * mid) / (len(t) + quality.PRIOR_CHARS) for i, t in mine)
        want = smooth[math.ceil(quality.QUANTILE * len(mine)) - 1]
        assert all(math.log(out[i].threshold) == pytest.approx(want, abs=0.002) for i, _ in mine)
        assert sum(not out[i].kept for i, _ in mine) <= 1
