"""The pipeline's rows against plain code."""

import hashlib
import random
import re

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from quillspark.llm import dart_minhash as dm
from quillspark.llm import decontaminate as dc

from .test_dart_minhash import brute
from .test_sanitise import brute as base_spans

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = {"en": "the house and river with morning light stone window paper", "fr": "être où garçon français déjà forêt façade élève été mère", "de": "straße schön über mädchen größe grün füße hören könig weiß"}


def made():
    r = random.Random(3)
    say = lambda lang, n: " ".join(r.choice(WORDS[lang].split()) + r.choice(("", "", "s", "n")) for _ in range(n))
    rows = [(i, say(lang, 40), lang, "s") for i, lang in enumerate(("en", "fr", "de") * 40)]
    item = say("en", 25)
    rows += [(500, f"{say('en', 60)} {item} {say('en', 60)}", "en", "s"), (501, item.upper(), "en", "s"), (502, f"{say('fr', 30)} anna.x@mail.example {say('fr', 30)} +49 30 1234567", "fr", "s")]
    rows += [(503, None, "en", "s"), (504, "", "en", "s"), (505, "12345 67 ... 8", "de", "s"), (506, rows[0][1], "en", "s"), (None, rows[1][1], None, None), (None, say("de", 50), None, "s"), (None, say("de", 50), None, "s")]
    a, b = say("en", 50), say("en", 50)
    rows += [(1, a, "en", "s"), (1, b, "en", "s"), (600, b, "en", "s"), (601, a, "en", "s"), (601, a, "en", "s")]
    near = say("de", 200).split()
    rows += [(700 + i, " ".join([*near[:i], "x", *near[i + 1 :]]), "de", "s") for i in range(5)]
    return rows, [(1, item), (2, None), (3, "")]


def expected(rows, items):
    """Texts that are left, by plain code; language identification is held to the known languages."""
    kept = [(i, t) for i, t, *_ in rows if t and re.search("[a-z]", t)]
    shingler = dm.Shingler(5)
    sets = [shingler.elements(shingler.word_hashes(t)) for _, t in kept]
    label = [*range(len(kept))]
    for x in range(len(kept)):
        for y in range(x):
            if dm.similarity(sets[x], sets[y]) >= 0.8:
                old, new = label[x], label[y]
                label = [new if k == old else k for k in label]
    groups = {}
    for k, row in zip(label, kept):
        groups.setdefault(k, []).append(row)
    assert len(groups) == len(brute(kept))
    out = []
    for rows_ in groups.values():
        doc_id, text = min(rows_, key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5(x[1].encode()).digest()))
        spans, _ = dc.SuffixAutomaton([(str(i), dc.words(t)) for i, t in items if t], 10).scan(dc.words(text))
        if spans:
            if sum(b - a for a, b in spans) > 0.5 * len(dc.words(text)):
                continue
            text = dc.cut(text, spans)
        for kind, a, b in sorted(base_spans(text), key=lambda s: -s[1]):
            text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
        out.append((doc_id, text))
    return out


def test_run_equals_plain_code(spark, tmp_path):
    rows, items = made()
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, spans int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out)
    want = []
    for doc_id, text in expected(rows, items):
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        want.append((str(doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
