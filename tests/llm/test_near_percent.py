"""Near-duplicates at thresholds other than 0.85, in the operator and in the stage, against brute force."""

import random

import pytest
from test_models import near_brute, shingles

from evenstride.llm import neardup


def near_pairs(low, high, n, seed):
    """Pairs of texts whose similarity lies in [low, high) percent: words of one are replaced until it does."""
    r, out = random.Random(seed), []
    while len(out) < 2 * n:
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(60, 300))]
        other = list(words)
        while 100 * len(shingles(" ".join(words)) & shingles(" ".join(other))) >= high * len(shingles(" ".join(words)) | shingles(" ".join(other))):
            other[r.randrange(len(other))] = f"new{r.randrange(10**6)}"
        s, t = shingles(" ".join(words)), shingles(" ".join(other))
        if 100 * len(s & t) >= low * len(s | t):
            out += [" ".join(words), " ".join(other)]
    return out


def test_matches_follow_the_threshold():
    assert neardup.matches(85) == 18 and neardup.matches(80) == 16 and neardup.matches(50) < 16
    assert neardup.matches(100) == neardup.COORDINATES


@pytest.mark.parametrize("percent", [80, 50])
def test_operator_at_other_thresholds(spark, percent):
    rows = list(enumerate(near_pairs(percent, percent + 5, 60, percent)))
    got = sorted((tuple(x) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()), key=str)
    assert got == near_brute(rows, percent) and sum(not x[3] for x in got) == 60


def test_stage_follows_its_threshold(spark, sf_dir, monkeypatch):
    import corpus_pipeline as cp

    monkeypatch.setattr(cp, "NEAR_PERCENT", 80)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(near_pairs(80, 85, 40, 3))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in cp.near_duplicate_stage(spark, d, sf_dir).collect()}
    assert kept == {i for i, _, _, k in near_brute([(r[0], r[1]) for r in rows], 80) if k} and len(kept) == 40
