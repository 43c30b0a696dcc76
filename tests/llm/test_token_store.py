import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import token_store as ts

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 9999, n))
    passage = word(3000)
    return [(7, word(50)), (3, f"{word(40)} {passage} {word(70)}"), (5, f"{word(300)} {passage}"), (4, None), (1, ""), (9, word(20)), (12, word(20)), (2, "x " * 40000), (8, word(50))]


def test_round_trip(spark, rows, tmp_path):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, rank int").repartition(3)
    folder = f"file://{tmp_path}/store"
    ts.write(docs, folder)
    got = sorted(ts.read(spark, folder).collect(), key=lambda r: r["rank"])
    at = 0
    for r, (i, text) in zip(got, sorted(rows)):
        ids = plain(text)
        assert (r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) == (i, at, len(ids), ids.tobytes())
        at += len(ids)
    assert len(got) == len(rows) and ts.verify(spark, folder)
    chunks, recipes = spark.read.parquet(f"{folder}/chunks"), spark.read.parquet(f"{folder}/recipes")
    assert chunks.count() == chunks.select("hash").distinct().count()
    by = {r["doc_id"]: r["chunks"] for r in recipes.collect()}
    assert len(set(map(bytes, by[3])) & set(map(bytes, by[5]))) >= 4  # the passage they share is stored once


def test_damage_is_found(spark, rows, tmp_path):
    folder, others = f"file://{tmp_path}/store", [f"file://{tmp_path}/other{i}" for i in range(4)]
    ts.write(spark.createDataFrame(rows, "doc_id long, text string"), folder)
    tables = {t: spark.read.parquet(f"{folder}/{t}") for t in ("recipes", "chunks", "manifest")}
    changed = [
        {"chunks": tables["chunks"].selectExpr("hash", "lead(payload, 1, payload) OVER (ORDER BY hash) payload")},
        {"manifest": tables["manifest"].selectExpr("level", "index", "if(level = 0 AND index = 2, unhex('00'), hash) hash")},
        {"recipes": tables["recipes"].where("rank < 8")},
        # A document altered in recipes and chunks alike, in itself in order: the manifest tells.
        {"recipes": tables["recipes"].selectExpr("rank", "doc_id", "start", "if(rank = 3, lead(n_tokens) OVER (ORDER BY rank), n_tokens) n_tokens", "if(rank = 3, lead(chunks) OVER (ORDER BY rank), chunks) chunks", "if(rank = 3, lead(root) OVER (ORDER BY rank), root) root")},
    ]
    for other, new, why in zip(others, changed, ("damaged", "manifest", "manifest", "manifest")):
        for name, df in (tables | new).items():
            (df.write.partitionBy("level") if name == "manifest" else df.write).parquet(f"{other}/{name}")
        with pytest.raises(Exception, match=why):
            ts.read(spark, other).collect()
    assert ts.verify(spark, folder) and not ts.verify(spark, others[1])


def test_cuts_and_widths():
    rng = np.random.default_rng(1)
    s = ts.Settings(mean=64, least=16, most=256)
    a, b = rng.integers(0, 50000, 9000), rng.integers(0, 50000, 500)
    ends = ts.cuts(a, s)
    assert ends[-1] == len(a) and max(np.diff([0, *ends])) <= s.most and min(np.diff([0, *ends])[:-1]) >= s.least
    moved = {e - 500 for e in ts.cuts(np.concatenate((b, a)), s)}
    assert len(moved & set(ends)) > 0.8 * len(ends)
    assert ts.cuts(np.zeros(5000, int), s)[-1] == 5000 and ts.cuts(a[:1], s) == [1]
    for ids in (a[:5], np.array([70000, 1])):
        assert ts.unpack(ts.pack(ids)).tolist() == ids.tolist()
    assert ts.pack(a[:5])[0] == 2 and ts.pack(np.array([70000]))[0] == 4


def test_repeats_empty_and_query(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    folder = f"file://{tmp_path}/repeats"
    ts.write(docs, folder)
    assert [(r["doc_id"], r["start"]) for r in ts.read(spark, folder).orderBy("rank").collect()] == [(None, 0), (1, 2), (1, 5), (2, 8)]
    ts.write(docs.limit(0), f"file://{tmp_path}/none")
    assert ts.read(spark, f"file://{tmp_path}/none").count() == 0 and ts.verify(spark, f"file://{tmp_path}/none")
    docs.where("doc_id = 2").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in ts.query(spark, str(tmp_path)).collect()] == [(2, 0, 1, zlib.crc32(b"\2\0\0\0"))]


def test_a_shared_paragraph_is_stored_once(spark, tmp_path):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 9999, n))
    rows = []
    for i in range(20):
        passage = word(250)
        rows += [(2 * i, f"{word(60)} {passage} {word(60)}"), (2 * i + 1, f"{word(80)} {passage} {word(40)}")]
    ts.write(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/store")
    by = {r["doc_id"]: set(map(bytes, r["chunks"])) for r in spark.read.parquet(f"file://{tmp_path}/store/recipes").collect()}
    assert sum(len(by[2 * i] & by[2 * i + 1]) > 0 for i in range(20)) >= 18


def test_only_chunks_that_occur_again_leave_their_document(spark, rows, tmp_path):
    folder = f"file://{tmp_path}/store"
    ts.write(spark.createDataFrame(rows, "doc_id long, text string"), folder)
    recipes = spark.read.parquet(f"{folder}/recipes")
    each = recipes.selectExpr("explode(arrays_zip(chunks, own)) c").selectExpr("c.chunks hash", "c.own IS NULL lent")
    seen = {bytes(r["hash"]): (r["n"], r["lent"]) for r in each.groupBy("hash").agg({"*": "count", "lent": "max"}).toDF("hash", "n", "lent").collect()}
    stored = {bytes(r["hash"]) for r in spark.read.parquet(f"{folder}/chunks").collect()}
    assert {h for h, (n, _) in seen.items() if n > 1} <= stored == {h for h, (_, lent) in seen.items() if lent}
    assert len(stored) < len(seen)
