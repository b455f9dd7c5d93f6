"""The channel's language model is counted on the words of all documents, not on the labelled sample."""

import math
import re
from collections import Counter

import pytest

from evenstride.llm import toxicity


@pytest.mark.parametrize("held", [200_000, 5])
def test_general_trigrams_cover_all_documents(spark, held, monkeypatch):
    monkeypatch.setattr(toxicity, "HELD", held)
    texts = ["Ein schöner Tag, ein Tag", "the stone wall. Stone", "łódź 12 ok", None, "", "tag tag"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    words = Counter(w for t in texts if t for tok in set(t.lower().split()) for w in re.findall(r"[^\W\d_]+", tok))
    want = toxicity.trigrams({w: math.sqrt(n) for w, n in words.items()})
    assert toxicity.general_trigrams(d) == {g: pytest.approx(n, abs=0.002) for g, n in want.items()}


def test_unlabelled_text_reaches_the_model(spark, monkeypatch):
    made = []

    class Kept(toxicity.CharModel):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(toxicity, "CharModel", Kept)
    rows = [(i, "you idiot here" if i % 4 == 0 else "a quiet day") for i in range(200)] + [(1000, "žluťoučký kůň")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), labels, 40)
    assert "ž" in made[0].letters and "^ků" in made[0].parts[0][2]
