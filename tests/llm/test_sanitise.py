import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from quillspark.llm import sanitise as sn

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DOCS = "doc_id long, text string, email string, n_chars long"


def luhn(digits):
    each = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in each) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def table(spark, texts):
    return spark.createDataFrame([(i, t, "clash", len(t or "")) for i, t in enumerate(texts)], DOCS)


def bases(frame):
    return {r["doc_id"]: [tuple(s) for s in r["base"]] for r in frame.collect()}


def test_base_spans_equal_the_plain_patterns(spark):
    r = random.Random(4)
    texts = [None, "", "é😀 a@b.c,+49 (30) 123-4567", "1" * 40000, "1 2-" * 9000, "a" * 60000 + "@", "a." * 30000 + "@b" + ".c" * 20000, "4111111111111111", "4111-1111 1111 1111 x 4111 1111 1111 1112", "+" * 500 + "1" * 12, "000000255.1.1.001 256.1.1.1 1.2.3.4.5.6.7.8"]
    texts += ["".join(r.choice("ab@..-_+1234567890 (é\n") for _ in range(r.randint(0, 60))) for _ in range(4000)]
    texts += [" ".join(r.choice(("4111111111111111", "+1 (555) 010-9999", "x.y@z.co", "10.0.0.256", "10.0.0.25", "ü")) for _ in range(6)) for _ in range(200)]
    got = bases(sn.spans(table(spark, texts)))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t


def parts(kind, value):
    """The entities of one span."""
    digits = re.sub("[^0-9]", "", value)
    out = {f"kind:{kind}", f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else digits}"}
    if kind == "email":
        owner = re.match("[a-z]{3,}", value.lower())
        return out | {"domain:" + value.lower().split("@")[-1]} | ({"owner:" + owner[0]} if owner else set())
    return out | {{"ip": "network:" + ".".join(value.split(".")[:2]), "card": "issuer:" + digits[:6], "phone": "area:" + digits[:4]}[kind]}


def brute_terms(texts, disclosure=0.8, prior=1.0):
    """Marked spans of each text by counting over all texts."""
    words = [set(re.findall(r"\w{3,}", (t or "").lower())) for t in texts]
    base = [brute(t) for t in texts]
    entities = [set().union(*(parts(k, texts[i][a:b]) for k, a, b in spans)) for i, spans in enumerate(base)]
    of_term, of_entity, both, contexts = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(set)
    for t, ws, es in zip(texts, words, entities):
        for w in ws:
            of_term[w] += 1
        for e in es:
            of_entity[e] += 1
            for w in ws:
                both[e, w] += 1
                contexts[e, w].add(t)
    n = len(texts)

    def discloses(e, w):
        p = of_entity[e] / n
        q = (both[e, w] + prior * p) / (of_term[w] + prior)
        return len(contexts[e, w]) > 1 and p < 1 and math.log2(q / p) / -math.log2(p) >= disclosure

    out = []
    for t, ws, es, spans in zip(texts, words, entities, base):
        strong = {w for w in ws if any(discloses(e, w) for e in es)}
        out.append([("term", *m.span()) for m in re.finditer(r"\w{3,}", t or "") if m[0].lower() in strong and not any(a < m.end() and b > m.start() for _, a, b in spans)])
    return out


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(9)
    words = [f"filler{i}" for i in range(50)]
    texts = [" ".join(r.choices(words, k=30)) for _ in range(200)]
    far = lambda: " ".join(r.choices(words, k=40))
    texts += [f"{far()} Ariadne writes, ARIADNE no. {i} {far()} from ari@maze.example {far()} unariadne" for i in range(6)]
    texts += [texts[-1]] * 5  # copies support nothing by themselves
    texts += [f"{far()} lonely zeta@once.example here {i}" for i in range(1)] * 3
    texts += [f"{far()} clinic{i % 2} calls +49 (30) 5550-{1000 + i} {far()}" for i in range(8)]  # numbers of one area
    texts += [f"{far()} server rack{i} 10.7.0.{i} {far()}" for i in range(4)] + [f"{far()} zeta{i}@hub.example keepers {far()}" for i in range(3)]
    texts += [None, "", "Ariadne alone"]
    return texts


def test_disclosing_terms_follow_the_counts(spark, corpus):
    got = {r["doc_id"]: [tuple(s) for s in r["terms"]] for r in sn.spans(table(spark, corpus)).collect()}
    want = brute_terms(corpus)
    assert [got[i] for i in range(len(corpus))] == want
    marked = {t[a:b].lower() for t, spans in zip(corpus, want) for _, a, b in spans}
    assert {"ariadne", "writes", "clinic0", "server", "keepers"} <= marked and "lonely" not in marked and "filler1" not in marked


def test_a_hot_entity_and_very_many_words(spark):
    """A third of all rows holds one domain; one of them is long and full of its terms."""
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(400)}" for _ in range(20)) for _ in range(600)]
    texts += [f"hotline {' '.join(f'w{r.randrange(400)}' for _ in range(10))} u{i}@hot.example" for i in range(300)]
    texts += [" ".join(f"long{j}" for j in range(6000)) + f" a{i}@rare.example z" for i in range(2)]
    got = {r["doc_id"]: [tuple(s) for s in r["terms"]] for r in sn.spans(table(spark, texts)).collect()}
    want = brute_terms(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert len(want[-1]) >= 6000 and any(want[600:900])


def test_sanitised_text(spark, corpus):
    texts = [None, "", "clean as it is", "é a@b.cd +1 (555) 010-9999 z", "x +49 30 10.0.0.25 y", *corpus]
    out = {r["doc_id"]: r for r in sn.stage(spark, table(spark, texts), "").collect()}
    assert len(out) == len(texts)
    assert [out[i]["text"] for i in range(5)] == [None, "", "clean as it is", "é [EMAIL] [PHONE] z", "x [PHONE] y"]
    assert all(r["n_chars"] == len(r["text"] or "") for r in out.values())
    assert "[NAME] [WORD], [NAME] no." in out[5 + 200]["text"] and out[5 + 200]["text"].count("[EMAIL]") == 1
    assert not any(brute(r["text"]) for r in out.values())
    gone = {r["doc_id"]: r["text"] for r in sn.sanitise(table(spark, texts), sn.Settings(generalise=False)).collect()}
    assert "  , " in gone[5 + 200] and "[NAME]" not in gone[5 + 200]


def test_repeated_rows_empty_table_and_query(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a@b.cd", "", 6), (1, "a@b.cd", "", 6), (None, "c@d.ef", "", 6), (None, None, "", 0)], DOCS)
    assert sorted(r["text"] or "" for r in sn.sanitise(docs).collect()) == ["", "[EMAIL]", "[EMAIL]", "[EMAIL]"]
    assert sn.spans(docs.limit(0)).count() == 0 and sn.sanitise(docs.limit(0)).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sn.query(spark, str(tmp_path)).where("doc_id = 1").collect()
    assert len(rows) == 2 and rows[0]["n_email"] == 1 and rows[0]["spans"] == "email:0:6"
    assert rows[0]["base_sha256"] == hashlib.sha256(b"email:0:6").hexdigest()
