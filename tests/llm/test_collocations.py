import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import collocations as co


def brute(rows, s):
    """The contract in plain loops."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, s.longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    kept = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= s.least}
    scored = {}
    for (lang, p), a in kept.items():
        cuts = [(s.scale * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if not any(g == lang and len(q) > len(p) and inside(q) and 100 * b >= s.subsumed * a for (g, q), b in kept.items()):
            scored.setdefault(lang, []).append((min(cuts), a, " ".join(p)))
    out = []
    for lang, found in scored.items():
        found.sort(key=lambda x: (-x[0][0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, cut[2], cut[3], n[lang], cut[0]) for i, (cut, a, p) in enumerate(found[: s.top], 1)]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in frame.collect())


@pytest.mark.parametrize("shard_words,bits,top", [(1 << 20, 26, 2000), (40, 26, 5), (300, 6, 2000)])
def test_equals_brute_force(spark, shard_words, bits, top):
    rng = random.Random(12)
    vocabulary = ["Paß", "ein", "THE", "of", "x-y", "ä", " ", "a", "b", "c"]
    mark = lambda: rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r", "! "])
    rows = [("".join(rng.choice(vocabulary) + mark() for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "und"])) for _ in range(120)]
    rows += [("a a a a a a a a, a a", "en")] * 5 + [(None, "en"), ("", None), ("...", "fr"), ("only once here", "fr"), ("new york city is big. new york city", "en")] * 4
    s = co.Settings(least=4, shard_words=shard_words, bits=bits, top=top)
    docs = spark.createDataFrame([(i, t, g, 7) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, n int").repartition(3)
    got = rows_of(co.collocations(docs, s))
    assert got == brute(rows, s) and len(got) > min(20, 2 * top)


def test_automaton_counts_every_phrase():
    rng = np.random.default_rng(3)
    codes = rng.choice([0, 1, 2, 3, 4], 400, p=[0.1, 0.4, 0.3, 0.1, 0.1]).astype(np.int32)
    codes[100:130] = codes[10:40]
    linked = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
    a = co.Automaton(codes, linked, 4)
    want = Counter()
    for size in (2, 3, 4):
        for i in range(len(codes) - size + 1):
            if (codes[i : i + size] > 0).all():
                want[tuple(codes[i : i + size].tolist())] += 1
    got = Counter()
    for end, longest, low, n in zip(a.ends, a.longest, a.shortest, a.counts):
        for size in range(low, longest + 1):
            got[tuple(codes[end - size + 1 : end + 1].tolist())] += int(n)
    assert got == want and len(a.ends) < len(want)  # states are fewer than phrases
    text, n, keys = a.phrases(codes, pa.array(["p", "q", "r", "s"]), rng.integers(0, 1 << 32, 5, dtype=np.uint64)[codes])
    assert dict(zip(text.to_pylist(), n.tolist())) == {" ".join(" pqrs"[c] for c in k): v for k, v in want.items()} and len(set(keys.tolist())) == len(want)
    assert len(co.Automaton(codes[:0], linked[:0], 4).ends) == 0


def test_long_text_is_divided_between_pieces():
    raw = b"aa bb. " * 50 + b"c" * 100
    parts = [*co.blocks(raw, 30)]
    assert b"".join(parts) == raw and max(map(len, parts[:-1])) <= 38 and all(x.endswith(b".") for x in parts[:-1])


def test_large_products_are_exact(spark):
    """2,000,000 x a / (l + r) on numbers whose product passes 64 bits."""
    a, b = 9_000_000_000_007, 9_000_000_000_011
    got = spark.sql(f"SELECT (cast(2000000 as decimal(10,0)) * cast({a}L as decimal(20,0))) div (cast({b}L as decimal(20,0)) + cast({a}L as decimal(20,0))) AS x").first()["x"]
    assert got == 2_000_000 * a // (a + b)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    assert co.collocations(docs.limit(0)).count() == 0 and co.collocations(docs).count() == 0


def test_shards_are_row_groups_of_their_own(spark):
    from pathlib import Path

    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(f"w{n} v{n} u{n}", lang) for n in range(9) for lang in ("en", "de", "fr")], "text string, lang string").coalesce(1)
    kept, made = [], co.materialise
    co.materialise = lambda df, name, **how: (kept.append(made(df, name, **how)), kept[-1])[1] if name == "shards" else made(df, name, **how)
    release, co.release = co.release, lambda *frames: None
    try:
        co.count(docs)
    finally:
        co.materialise, co.release = made, release
    files = [pq.ParquetFile(p).metadata for p in Path(kept[0]._materialised.removeprefix("file://")).glob("*.parquet")]
    assert sum(f.num_rows for f in files) == 3 and all(f.num_rows == f.num_row_groups for f in files)
