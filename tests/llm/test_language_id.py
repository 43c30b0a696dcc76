import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import language_id as lid

WORDS = {"en": "the house and river with morning light", "fr": "être où garçon français déjà forêt", "de": "straße schön über mädchen größe grün"}


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        lang = ("en", "fr", "de")[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split(), 12)), lang, "kept"))
    rows += [(900, None, "en", ""), (901, "", "en", ""), (902, "123 !? 456", "fr", ""), (903, WORDS["de"] * 4000, None, ""), (904, rows[0][1], "en", ""), (904, rows[0][1], "en", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")


def test_learns_and_treats_odd_rows(spark, docs):
    out = lid.predict(docs, lid.train(docs.where("doc_id % 4 != 2"))).collect()
    assert len(out) == 126
    by = {r["doc_id"]: r for r in out}
    held = [r for r in out if r["doc_id"] < 120 and r["doc_id"] % 4 == 2]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.95
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert by[903]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in out)
    again = lid.predict(docs, lid.train(docs.where("doc_id % 4 != 2"))).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_empty_table(spark, docs):
    none = docs.limit(0)
    assert lid.train(none) is None
    assert lid.predict(none, None).count() == 0
    assert {r["lang_pred"] for r in lid.predict(docs, None).collect()} == {"und"}


def test_grams_agree_with_plain_counting():
    s = lid.Settings(buckets=1 << 12)
    text = "Ab, c"
    where, count = lid.grams(text, s)
    assert count.sum() == 6 + 5 + 4  # " ab c " has 6, 5 and 4 grams
    assert lid.grams("12 .", s) is None


def test_stage_keeps_columns(spark, docs):
    out = lid.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {900, 901, 902}.isdisjoint(r["doc_id"] for r in out.select("doc_id").collect())
    assert out.where(F.col("doc_id") < 120).count() == 120


def test_blocks_change_nothing():
    r = random.Random(6)
    for n in (0, 1, 2, 5, 40, 300):
        text = "".join(r.choice("abÉß .,1\n") for _ in range(n))
        want = lid.grams(text, lid.Settings())
        for block in (1, 2, 3, 7, 64):
            got = lid.grams(text, lid.Settings(block=block))
            assert (got is None) == (want is None)
            assert want is None or all((a == b).all() for a, b in zip(got, want))
