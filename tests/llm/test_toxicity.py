import numpy as np
import pytest

from quillspark.llm import toxicity as tx

FILLER = [f"{a}{b}" for a in ("mor", "tal", "ven", "dis") for b in ("an", "el", "ir", "os", "ut")]


def made(rng, n, bad):
    words = list(rng.choice(FILLER, n))
    for w in bad:
        words.insert(int(rng.integers(len(words) + 1)), w)
    return " ".join(words)


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(600):
        grade = [0, 0, 0, 0, 1, 2][i % 6]
        bad = list(rng.choice(["Vile", "zugmax", "zugrel", "zugtor", "rotten!"], [0, 1, 6][grade]))
        rows.append((i, made(rng, int(rng.integers(5, 200)), bad), "x", 9))
        if i < 400:
            labels += [(i, grade)] * (1 + (i == 5))
    rows += [(900, None, "x", 9), (901, "", "x", 9), (902, "zugnew " * 30000, "x", 9), (903, "?!", "x", 9), (None, "vile", "x", 9), (4, rows[4][1], "x", 9)]
    labels += [(None, 1), (950, 1), (6, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic string, grade int"), spark.createDataFrame(labels, "doc_id long, grade int")


def test_grades_of_unseen_documents(spark, tables):
    docs, labels = tables
    model = tx.train(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    got = {r["doc_id"]: r for r in tx.predict(docs, model).where("doc_id IS NOT NULL").collect()}
    unseen = [got[i] for i in range(400, 600)]
    truth = [[0, 0, 0, 0, 1, 2][r["doc_id"] % 6] for r in unseen]
    assert np.mean([r["grade"] == y for r, y in zip(unseen, truth)]) >= 0.95
    assert [r["toxic"] for r in unseen] == [y > 0 for y in truth]
    assert all(0 <= r["expected_severity"] <= 2 for r in unseen)
    assert not got[900]["toxic"] and got[902]["toxic"] and not got[903]["toxic"]  # zugnew shares a beginning


def test_labels_of_two_kinds_are_divided(spark, tables):
    docs, labels = tables
    two = labels.selectExpr("doc_id", "least(grade, 1) grade")
    model = tx.train(docs, two)
    assert len(model.thresholds) == 2
    got = {r["doc_id"]: r["expected_severity"] for r in tx.predict(docs, model).where("doc_id BETWEEN 400 AND 599").collect()}
    by = [np.mean([x for i, x in got.items() if [0, 0, 0, 0, 1, 2][i % 6] == g]) for g in range(3)]
    assert by[0] < 0.2 < 0.7 < by[1] < by[2]
    assert len(tx.train(docs, two, tx.Settings(divide=False)).thresholds) == 1


def test_nothing_to_learn_from(spark, tables):
    docs, labels = tables
    assert tx.train(docs, labels.limit(0)) is None and tx.train(docs.limit(0), labels) is None
    assert tx.train(docs, labels.where("grade = 0")) is None
    assert {(r["expected_severity"], r["grade"], r["toxic"]) for r in tx.predict(docs, None).collect()} == {(0.0, 0, False)}
    assert tx.predict(docs.limit(0), None).count() == 0


def test_gradient_of_the_likelihood():
    """One step from zero moves score and thresholds the way that raises the likelihood."""
    for y in range(3):
        rows = [(np.array([0]), np.array([1.0]), y), *((np.array([1]), np.array([0.0]), k) for k in range(3))]
        w, t = tx.fit(rows, 2, 3, tx.Settings(epochs=200, l1=0.0, l2=0.0))
        assert t[0] < t[1] and abs(w[1]) < 1e-9
        p = np.concatenate(([1.0], tx._sigmoid(w[0] - t), [0.0]))
        assert np.argmax(-np.diff(p)) == y
