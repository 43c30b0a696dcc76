import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quillspark.llm import ngram_trie as ng


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), "</s>"]


def q(p):
    return -ng.STEP * min(255, max(0, round(-math.log10(p) / ng.STEP)))


class Plain:
    """The same model in dictionaries."""

    def __init__(self, texts):
        lines = [["<s>", *tokens(t)] for t in texts]
        self.one = Counter(w for x in lines for w in x[1:])
        self.n, self.v, self.docs = sum(self.one.values()), len(self.one), len(lines)
        context = self.one | {"<s>": self.docs}
        two = {k: c for k, c in Counter(p for x in lines for p in zip(x, x[1:])).items() if c > 1}
        three = {k: c for k, c in Counter(p for x in lines for p in zip(x, x[1:], x[2:])).items() if c > 1}
        rest2, rest3 = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)
        for (v, _), c in two.items():
            rest2[v] -= (c - ng.DISCOUNT) / context[v]
        for (u, v, _), c in three.items():
            rest3[u, v] -= (c - ng.DISCOUNT) / two[u, v]
        self.p2 = {k: q((c - ng.DISCOUNT) / context[k[0]] + rest2[k[0]] * 10 ** self.base(k[1])) for k, c in two.items()}
        self.p3 = {k: q((c - ng.DISCOUNT) / two[k[:2]] + rest3[k[:2]] * 10 ** self.p2[k[1:]]) for k, c in three.items()}
        self.rest2, self.rest3, self.two = {k: q(x) for k, x in rest2.items()}, {k: q(x) for k, x in rest3.items()}, two

    def base(self, w):
        return math.log10((self.one[w] + 1) / (self.n + self.v + 1))

    def score(self, text):
        x, total = ["<s>", *tokens(text)], 0.0
        for i in range(1, len(x)):
            pair, triple = tuple(x[i - 1 : i + 1]), tuple(x[i - 2 : i + 1]) if i > 1 else None
            if triple in self.p3:
                total += self.p3[triple]
                continue
            total += self.p2[pair] if pair in self.p2 else self.base(x[i]) + self.rest2.get(x[i - 1], 0)
            total += self.rest3.get(triple[:2], 0) if triple else 0
        return total


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    words = [f"W{i}" if i % 3 else f"é{i}." for i in range(60)]
    texts = [" ".join(r.choices(words, [1 / (i + 1) for i in range(60)], k=r.randint(0, 40))) for _ in range(150)]
    texts += [None, "", " \t\n", "w1\x0bw2\x0cw3 x", "unseen words only " + str(r.random()), "w1 w2 " * 20000, texts[3], texts[3]]
    return [(i, t, 0.5) for i, t in enumerate([*texts, texts[5]])]


def test_scores_equal_plain_dictionaries(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(4)
    train = docs.where("doc_id % 5 <> 1")
    plain = Plain([t for i, t, _ in rows if i % 5 != 1])
    for shards in (1, 3, 16):
        model = ng.train(train, f"file://{tmp_path}/m{shards}", shards)
        assert (model.tokens, model.words, model.docs) == (plain.n, plain.v, plain.docs)
        got = {r["doc_id"]: r for r in ng.score(docs, model).collect()}
        assert len(got) == len(rows)
        for i, t, _ in rows:
            x = tokens(t)
            assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(x), sum(plain.one[w] > 0 for w in x))
            assert got[i]["base_score"] == pytest.approx(sum(map(plain.base, x)), rel=1e-9)
            # a probability halfway between two steps may fall to either
            assert got[i]["score"] == pytest.approx(plain.score(t), abs=1e-6 + 2e-3 * len(x))


def test_probabilities_of_a_context_sum_to_one(rows):
    plain = Plain([t for _, t, _ in rows if t and len(t) < 1000])
    vocabulary = list(plain.one)
    for v in vocabulary[:20]:
        total = sum(10 ** (plain.p2.get((v, w)) or plain.base(w) + plain.rest2.get(v, 0)) for w in vocabulary) + 10 ** (plain.base("?") + plain.rest2.get(v, 0))
        assert 0.85 < total < 1.15


def test_empty_tables(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows[:5], "doc_id long, text string, score double")
    model = ng.train(docs.limit(0), f"file://{tmp_path}/none", 2)
    assert ng.score(docs, model).count() == 5
    model = ng.train(docs, f"file://{tmp_path}/some", 2)
    assert ng.score(docs.limit(0), model).count() == 0


def test_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    out = ng.query(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["held_out"] for r in out} == {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in rows}
    assert {r["train_tokens"] for r in out} == {sum(len(tokens(t)) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2)}


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (1, 2**63), (5, 3), (1000, 7), (1000, 1 << 40), (5000, 1 << 64), (3000, 3000)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n + top % 1000)
    values = np.sort(np.array([int(rng.integers(0, min(top, 2**63))) * (2 if top == 1 << 64 else 1) for _ in range(n)], np.uint64))
    if n:
        access = ng.EliasFano.build(values, searched=False)
        places = rng.permutation(n)
        assert (access.access(places) == values[places]).all()
    distinct = np.unique(values)
    ef = ng.EliasFano.of(*ng.EliasFano.build(distinct, searched=True).arrays())
    asked = np.unique(np.concatenate((distinct, distinct + np.uint64(1), np.array([0, 1, 2**64 - 1], np.uint64))))
    where = {int(v): i for i, v in enumerate(distinct)}
    assert ef.find(asked).tolist() == [where.get(int(x), -1) for x in asked]


def test_files_from_a_store_that_cannot_be_mapped(tmp_path, monkeypatch):
    arrays = [np.arange(5), np.empty(0, np.uint8), np.arange(3, dtype="<u4")]
    monkeypatch.setattr(ng, "_plain", lambda folder: None)
    (tmp_path / "x").mkdir()
    ng.save(f"file://{tmp_path}/x", "a", arrays)
    got = ng.load(f"file://{tmp_path}/x", "a")
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, got))


def test_singletons_are_kept(spark, tmp_path):
    docs = spark.createDataFrame([(0, "one two three four"), (1, "one two five six")], "doc_id long, text string")
    model = ng.train(docs, f"file://{tmp_path}/all", 3, min_count=1)
    got = {r["doc_id"]: r for r in ng.score(docs, model).collect()}
    pruned = {r["doc_id"]: r for r in ng.score(docs, ng.train(docs, f"file://{tmp_path}/pruned", 3)).collect()}
    lines = [["<s>", *tokens(r["text"])] for r in docs.orderBy("doc_id").collect()]
    one = Counter(w for x in lines for w in x[1:]) + Counter({"<s>": 2})
    n, v = sum(c for w, c in one.items() if w != "<s>"), len(one) - 1
    two, three = Counter(p for x in lines for p in zip(x, x[1:])), Counter(p for x in lines for p in zip(x, x[1:], x[2:]))
    rest = lambda grams, u, below: sum(ng.DISCOUNT for k in grams if k[:-1] == u) / below

    def p2(a, b):
        return (two[a, b] - ng.DISCOUNT) / one[a] + rest(two, (a,), one[a]) * (one[b] + 1) / (n + v + 1)

    for i, x in enumerate(lines):
        want = math.log10(p2(*x[:2]))
        for k in zip(x, x[1:], x[2:]):
            want += math.log10((three[k] - ng.DISCOUNT) / two[k[:2]] + rest(three, k[:2], two[k[:2]]) * p2(*k[1:]))
        assert got[i]["score"] == pytest.approx(want, abs=ng.STEP * len(x))
        assert got[i]["score"] > pruned[i]["score"] + 0.5


def test_words_are_told_apart_in_blocks():
    texts = ["A b  c\nÉ é", None, "", " x\x0by\x1cz ", "the The THE\tthe", "\x85 \xa0 a"]
    column = pa.array(["cut off", *texts]).slice(1)
    words, sizes = ng.tokens(column)
    want = [(t or "").encode().lower().split() for t in texts]
    assert [w.encode() for w in words.to_pylist()] == [w for x in want for w in x] and sizes.tolist() == [*map(len, want)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(6)), column], names=["doc_id", "text"])] * 3
    for names, lexicon, flat, ends in ng.blocks(batches, 30):
        assert names in ([*range(6)] * 2, [*range(6)])
        hashes = [h for x in want for h in [*map(xxhash.xxh3_64_intdigest, x), ng.END]] * (len(names) // 6)
        assert lexicon.hashes[flat].tolist() == hashes and ends[-1] == len(flat) and len(set(lexicon.hashes.tolist())) == len(lexicon.hashes)
