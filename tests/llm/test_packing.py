import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import packing as pk

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
LIBRARY.no_padding()
LIBRARY.no_truncation()


def plain(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


@pytest.mark.parametrize(
    "text",
    ["It's DON'T they'll, I'm x's.", "İstanbul ΣΑΣ ς", "é ́a ≠ ≠", "a\x1cb\x1d c\x85d\xa0e", "x <|endoftext|>y <|startoftext|>", "½²3 12 日本語 ​", "a\x00b\x7f c\xadd _-_ ---", "ÉÀ ǅ ß ﬁ", "", " \t\n", "word, word. (word) 'word' word's"],
)
def test_ids_are_the_librarys(text):
    coder = pk.load(pk.default_path())
    assert [*np.frombuffer(coder.encode(text), "<u4"), 1] == plain(text).tolist()
    small = pk.load(pk.default_path(), pk.Settings(remembered=1, block=5))
    assert small.encode(text * 3) == coder.encode(text * 3) == plain(text * 3)[:-1].tobytes()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(0, 400), max_size=24))
def test_patterns_hold_every_piece_once(histogram):
    found = pk.patterns(histogram, 24)
    placed = Counter()
    for count, content in found:
        assert sum(n * often for n, often in content) <= 24
        for n, often in content:
            placed[n] += count * often
    assert placed == Counter({n: c for n, c in histogram.items() if c})
    # One pack after the other, without patterns: the same number of packs.
    rooms = []
    for n in sorted(Counter(histogram).elements(), reverse=True):
        at = max(range(len(rooms)), key=rooms.__getitem__, default=None)
        if at is None or rooms[at] < n:
            rooms.append(24)
            at = len(rooms) - 1
        rooms[at] -= n
    assert sorted(rooms) == sorted(24 - sum(n * o for n, o in content) for count, content in found for _ in range(count))


def test_pack_and_sequences(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 999, n)) for n in [*rng.integers(0, 60, 80), 3000, 700, 700]]
    rows = [(i, t, "x", 5) for i, t in enumerate(texts)] + [(900, None, "x", 1), (901, "same same", None, 1), (901, "same same", None, 1), (None, "no id", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, length int").repartition(5)
    s = pk.Settings(size=256)
    packed = pk.pack(docs, s=s).cache()
    assert packed.columns == ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
    got, want = packed.collect(), Counter((i, plain(t).tobytes()) for i, t, *_ in rows)
    alone = Counter((r["doc_id"], bytes(r["ids"])) for r in got if r["length"] == r["doc_tokens"])
    for (i, raw), n in want.items():
        if len(raw) // 4 <= s.size:
            assert alone[i, raw] == n
        else:
            mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
            assert b"".join(bytes(r["ids"]) for r in mine) == raw and [r["start"] for r in mine] == [*range(0, len(raw) // 4, 256)]
    whole = {r["sequence_id"]: r for r in pk.sequences(packed, s).collect()}
    assert sorted(whole) == [*range(len(whole))]
    for r in got:
        q = whole[r["sequence_id"]]
        assert bytes(q["ids"])[4 * r["offset"] :].startswith(bytes(r["ids"])) and r["offset"] in q["starts"]
    tokens = sum(r["length"] for r in got)
    for q in whole.values():
        n, size = q["n_tokens"], len(q["ids"]) // 4
        assert size == (n if n & (n - 1) == 0 else 256) and len(set(q["starts"])) == len(q["starts"])
    padding = sum(len(q["ids"]) // 4 for q in whole.values()) - tokens
    assert sum(q["n_tokens"] for q in whole.values()) == tokens and padding < 0.05 * tokens  # few pieces fill packs less well


def test_equal_lengths_share_packs_and_tasks(spark):
    docs = spark.createDataFrame([(i, "one two three") for i in range(1000)], "doc_id long, text string").repartition(7)
    rows = pk.pack(docs, s=pk.Settings(size=64)).collect()
    places = Counter((r["sequence_id"], r["offset"]) for r in rows)
    assert len(rows) == 1000 and max(places.values()) == 1 and max(r["sequence_id"] for r in rows) == -(-1000 // 16) - 1


def test_query_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in pk.query(spark, str(tmp_path)).collect())
    assert got == [(i, 0, len(x), zlib.crc32(x.tobytes()), len(x)) for i, x in ((1, plain("a b")), (2, plain("")))]
    assert pk.pack(docs.limit(0)).count() == 0
