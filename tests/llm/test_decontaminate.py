import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    found, hit, names = plain_words(text), set(), set()
    for name, item in items:
        w = plain_words(item)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(found) - n + 1):
                if found[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    names.add(str(name))
    return len(found), hit, sorted(names)


def check(text, items, window):
    automaton = dc.SuffixAutomaton([(str(n), dc.words(t)) for n, t in items], window)
    spans, names = automaton.scan(dc.words(text))
    n, hit, want = brute(text, items, window)
    assert {i for a, b in spans for i in range(a, b)} == hit
    assert sorted(names) == want
    assert len(dc.words(text)) == n
    assert spans == dc.merge(spans)


letters = st.lists(st.sampled_from("abC"), max_size=14).map(" ".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40).map(" ".join), st.lists(letters, max_size=5))
def test_scan_equals_brute_force(text, items):
    check(text, list(enumerate(items)), 4)


@pytest.fixture(scope="module")
def items():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abé") for _ in range(2))
    made = [(i, " ".join(word() for _ in range(25))) for i in range(8)]
    return [*made, (8, "Short, one"), (9, "..."), (10, made[0][1]), (11, None), (12, made[1][1][30:])]


def test_table(spark, items):
    texts = [None, "", "nothing here", items[0][1].upper(), "x " + items[2][1].replace(" ", " -- "), "a short ONE b", items[1][1] + " " + items[3][1], "pad " * 30000 + items[4][1], items[5][1][:40]]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*texts, texts[3]])], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limits in (dc.Settings(), dc.Settings(block_words=30)):
        for r in dc.scan(docs, bench, limits).collect():
            n, hit, names = brute(r["text"], items)
            assert (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) == (n, len(hit), names)
    assert dc.scan(docs, bench.limit(0)).where("size(spans) > 0 OR size(items) > 0").count() == 0
    assert dc.scan(docs.limit(0), bench).count() == 0


def test_query_columns(spark, items, tmp_path):
    spark.createDataFrame([(1, items[0][1] + " " + items[2][1]), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["doc_id"]: r for r in dc.query(spark, str(tmp_path)).collect()}
    assert rows[1]["items_sha256"] == hashlib.sha256(b"0,10,2").hexdigest() and rows[1]["n_hit"] == 50 and rows[1]["contaminated"]
    assert rows[2]["items_sha256"] == hashlib.sha256(b"").hexdigest() and rows[2]["n_words"] == 0


def test_stage_cuts_and_drops(spark, items, tmp_path):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pad = " ".join(f"p{i}" for i in range(60))
    texts = ["clean  text kept,\tas is", items[0][1], f"{pad} ({items[2][1]}) {pad}", items[0][1] + " y", None, f"{pad} {items[3][1][:35]} {items[2][1]} {items[3][1][35:]} {pad}"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in dc.stage(spark, docs, str(tmp_path)).collect()}
    assert set(out) == {0, 2, 4, 5}
    assert out[0]["text"] == texts[0] and out[2]["text"] == f"{pad} (\n) {pad}"
    assert all(not brute(r["text"], items)[1] for r in out.values())
    assert all(r["n_chars"] == len(r["text"] or "") for r in out.values())
