import numpy as np
import pytest

from quillspark.llm import dart_minhash as dm


def text(rng, n, vocabulary=4000):
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


def edited(rng, base, n):
    words = base.split()
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"e{rng.integers(1 << 30)}"
    return " ".join(words)


def brute(rows):
    """Connected components over all pairs of rows: for each class its sorted ids, null last."""
    shingler = dm.Shingler(5)
    texts = [t or "" for _, t in rows]
    sets = [shingler.elements(shingler.word_hashes(t)) for t in texts]
    label = [*range(len(rows))]

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if dm.similarity(sets[a], sets[b]) >= 0.8 if len(sets[a][0]) and len(sets[b][0]) else texts[a] == texts[b]:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    out = {}
    for i, (doc_id, _) in enumerate(rows):
        out.setdefault(root(i), []).append(doc_id)
    return sorted((sorted(x, key=order) for x in out.values()), key=lambda x: [*map(order, x)])


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def classes(found):
    """The classes of a result, after a look at its other columns."""
    out, ids = {}, {}
    for r in found.collect():
        out.setdefault(r["class_key"], []).append(r["doc_id"])
        ids[r["class_key"]] = r["class_id"]
        assert r["n_class"] >= 1
    for key, members in out.items():
        assert ids[key] in members or ids[key] is None and set(members) == {None}
    return sorted((sorted(x, key=order) for x in out.values()), key=lambda x: [*map(order, x)]), ids


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [(i, text(rng, int(rng.integers(1, 300)))) for i in range(60)]
    base = text(rng, 400)
    out += [(1000 + i, edited(rng, base, int(rng.integers(0, 14)))) for i in range(60)]
    passage = text(rng, 300)
    out += [(2000 + i, passage + " " + text(rng, int(rng.integers(10, 140)))) for i in range(60)]
    out += [(3000 + i, out[5][1]) for i in range(20)] + [(3100, out[7][1].upper() + "!")]
    out += [(4000, None), (4001, ""), (4002, "..."), (4003, "..."), (4004, "one"), (4005, "One"), (4006, text(rng, 30000)), (4007, "a b c d e " * 500), (4007, "a b c d e " * 500)]
    return out


def test_classes_equal_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, class_id int, same string, digest string")
    got, ids = classes(dm.near_duplicates(docs))
    assert got == brute(rows)
    assert sum(map(len, got)) == len(rows)
    assert [i for i in ids.values()] and len(set(ids.values())) == len(ids)


def test_exact_step_alone_finds_what_pivots_miss(spark, rows):
    few = [r for r in rows if 2000 <= r[0] < 2060]
    docs = spark.createDataFrame(few, "doc_id long, text string")
    assert classes(dm.near_duplicates(docs, dm.Settings(pivots=0)))[0] == brute(few)


def test_long_prefixes_meet_all_pairs(spark):
    """Texts whose prefixes are longer than what is remembered of them."""
    rng = np.random.default_rng(8)
    base = text(rng, 1500, 100_000)
    few = [(i, edited(rng, base, 20 + i)) for i in range(12)]
    docs = spark.createDataFrame(few, "doc_id long, text string")
    assert classes(dm.near_duplicates(docs, dm.Settings(pivots=0)))[0] == brute(few)


def test_shared_and_missing_ids_lose_no_text(spark):
    rng = np.random.default_rng(9)
    a, b, c, d = (text(rng, 50) for _ in range(4))
    few = [(1, a), (1, b), (2, b), (3, a), (None, c), (None, d), (None, a), (5, d), (None, None), (7, ""), (8, "?"), (1, a), (9, c.upper())]
    docs = spark.createDataFrame([(i, t, "en") for i, t in few], "doc_id long, text string, lang string")
    got, ids = classes(dm.near_duplicates(docs))
    assert got == brute(few)
    assert len(set(ids.values())) == len(ids)
    kept = sorted((r["text"] or "").lower() for r in dm.stage(spark, docs, "").collect())
    assert kept == sorted([a, b, c, d, "", "?"])


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(5)
    a = dict(zip(range(1, 301), rng.integers(1, 9, 300).astype(float)))
    b = {k: v + (k % 3) for k, v in a.items() if k % 5}
    sets = [(dm.mix(np.array(list(x), np.uint64)), np.array(list(x.values()))) for x in (a, b)]
    sets = [(k[np.argsort(k)], w[np.argsort(k)]) for k, w in sets]
    agree = np.mean([dm.signature(*sets[0], 2048) == dm.signature(*sets[1], 2048)])
    assert abs(agree - dm.similarity(*sets)) < 0.04


def test_weights_below_one_and_single_elements():
    key = np.array([12345], np.uint64)
    assert len(dm.signature(key, np.array([0.25]), 64)) == 64
    assert (dm.signature(key, np.array([1.0]), 64) == dm.signature(key, np.array([1.0]), 64)).all()


def test_empty_table_and_stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert dm.near_duplicates(docs.limit(0)).count() == 0
    assert dm.stage(spark, docs.limit(0), "").count() == 0
    out = dm.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(x[0] for x in brute(rows))


def test_many_at_once_equal_one_by_one():
    rng = np.random.default_rng(12)
    texts = [text(rng, int(n), 300) for n in rng.integers(0, 400, 60)] + ["", "one", "a b c d e", "a b c d e " * 90, text(rng, 5000)]
    shingler = dm.Shingler(5)
    hashes = [shingler.word_hashes(t) for t in texts]
    sets = shingler.many(hashes)
    for h, (keys, weights) in zip(hashes, sets):
        want = shingler.elements(h)
        assert (keys == want[0]).all() and (weights == want[1]).all()
    for found, s in zip(dm.signatures(sets, 64), sets):
        assert found is None and not len(s[0]) or (found == dm.signature(*s, 64)).all()


def test_bands_are_shuffled_once_and_texts_packed(spark, monkeypatch):
    from quillspark.llm import dart_minhash as M

    plans, plain = {}, M.materialise

    def watched(df, name, **more):
        plans.setdefault(name, df)
        return plain(df, name, **more)

    monkeypatch.setattr(M, "materialise", watched)
    words = [f"w{n}" for n in range(60)]
    rows = spark.createDataFrame([(n, " ".join(words) + f" end{n % 3}") for n in range(6)] + [(9, "other words"), (10, None)], "doc_id long, text string")
    assert M.linked(M.keyed(rows)).select("label").distinct().count() == 3
    text = plans["buckets"]._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("RepartitionByExpression [bucket") == 2 and "shared" not in plans  # both sides of the join alike, so that one exchange serves
    assert plans["texts"].schema["text"].dataType.simpleString() == "binary"
    texts = spark.createDataFrame([(1, "aé\U0001f600"), (2, "")], "node long, text string")
    assert {r.node: M.unpacked(bytes(r.text)) for r in M.packed(texts).collect()} == {1: "aé\U0001f600", 2: ""}
