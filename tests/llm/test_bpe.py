import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
SMALL = bpe.ByteBpe(PATH, bpe.Settings(leaf=20, window=4, remembered=300))
PARTS = ["ab", "the", "'re", "'ll", " ", "  ", "\n", "\t", "1", "23", "é", "ñü", "😀", "日本", "!", "..", "'", " '", " ", " ", "\x1c", "\x85", "<|endoftext|>", "<|endof", "text|>", "\0", "é", "ing"]


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=80).map("".join))
def test_joins_equal_the_library(text):
    ids = SMALL.encode(text)
    assert ids.tolist() == library(text)
    assert SMALL.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False) == text


@settings(max_examples=600, deadline=None)
@given(st.text(max_size=120))
def test_any_text(text):
    assert SMALL.encode(text).tolist() == library(text)


def test_long_unsplit_texts():
    r = random.Random(6)
    big = bpe.ByteBpe(PATH, bpe.Settings(leaf=256))
    for letters in ("a", "ab", "abcdefghij", "0123456789", "日本語", " ", "\n ", "=-", "aé1! "):
        text = "".join(r.choices(letters, k=20000))
        assert big.encode(text).tolist() == library(text)
    assert big.encode(("ab" * 4000 + "<|endoftext|>") * 2 + " x").tolist() == library(("ab" * 4000 + "<|endoftext|>") * 2 + " x")


def test_decoding_of_ids_that_are_no_text():
    r = np.random.default_rng(2)
    coder = bpe.load(PATH)
    for _ in range(300):
        ids = r.integers(0, 50257, 12)
        assert coder.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Plain words, and  more.\n", "x"), (3, "Plain words, and  more.\n", "x"), (4, "abc " * 30000, "x"), (None, "z" * 50000, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_operators(spark, docs):
    for r in bpe.decode(bpe.encode(docs)).collect():
        assert r["ids"] == library(r["text"] or "") and r["decoded"] == (r["text"] or "")
    found = bpe.digests(docs).collect()
    assert len(found) == 6
    for r in found:
        if r["doc_id"] == 3:
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, library("Plain words, and  more.\n"))).encode()).hexdigest()
        if r["doc_id"] == 1:
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (0, *[hashlib.sha256(b"").hexdigest()] * 2)
    assert bpe.encode(docs.limit(0)).count() == 0 and bpe.digests(docs.limit(0)).count() == 0


def test_new_words_are_merged_side_by_side():
    r = random.Random(8)
    coder = bpe.ByteBpe(PATH)
    words = ["".join(r.choices("aeinrst", k=r.randint(1, 12))) + r.choice(["", "", ".", ",", "é", "42", "!!!!", "%%%", "×", "'s", "\nTh"]) for _ in range(20000)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)] + ["aaaaaaaaaaaaaaa " * 5 + "=" * 63 + " " + "=" * 200, "a \n b\n\nc\nd e\n"]
    assert [x.tolist() for x in coder.encode_many(texts)] == [library(t) for t in texts]
    coder = bpe.ByteBpe(PATH)
    plain = [" ".join(w for w in words[i : i + 100] if "'" not in w and "×" not in w) for i in range(0, len(words), 100)]
    assert [x.tolist() for x in coder.encode_many(plain)] == [library(t) for t in plain]
    assert not coder.parts and not coder.known  # no word went one by one


def test_gathered_batches_keep_every_row():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"x": list(range(i, i + 7))}) for i in range(0, 70, 7)]
    assert [b.num_rows for b in bpe.gathered(batches, rows=20)] == [21, 21, 21, 7]
    assert [x for b in bpe.gathered(batches, rows=20) for x in b.column("x").to_pylist()] == list(range(70))
