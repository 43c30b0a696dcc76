"""Content-addressed store of token ids.

A document's ids, with an end id behind them, are cut where a rolling hash of the last ids says so, so that equal
passages give equal chunks wherever they stand. Format, all Parquet compressed with Zstandard, below one folder:

- ``recipes``: rank (place in ascending doc_id order), doc_id, start (ids of all documents before), n_tokens, chunks
  (hashes in order: SHA-256 of the ids as little-endian 32-bit integers), root (SHA-256 of the joined hashes), own
  (payloads in order: one byte for the width, 2 or 4, then the ids, little-endian of that width; null for those in ``chunks``).
- ``chunks``: hash, payload of every chunk that occurs more than once, and of few others; every chunk is stored once.
- ``manifest``: level, index, hash: a Merkle tree of fan-out `Settings.fan_out` over the roots by rank; the single
  hash of the top level names the whole store.

Texts are dealt by range before they are encoded, so that ids are never shuffled but those of chunks that occur again.
"""

from __future__ import annotations

import hashlib
import zlib
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import discard, lean, shared_folder, table
from .ngram_trie import load, save

SLICE = 23  # bits of a place within a file of the bitmap, as a power of two


@dataclass(frozen=True)
class Settings:
    end_id: int = 2
    mean: int = 128  # ids; a power of two
    least: int = 16
    most: int = 4096
    reach: int = 16  # ids that the rolling hash looks back
    fan_out: int = 1024


def cuts(ids: np.ndarray, s: Settings = Settings()) -> list[int]:
    """Ends of the chunks. A cut depends on the ids since the last one and the `reach` ids before it only."""
    return cuts_of(ids, [len(ids)], s)[0]


def cuts_of(flat: np.ndarray, sizes: list[int], s: Settings = Settings()) -> list[list[int]]:
    """The same of many documents that stand one behind the other in flat; ends count from each document's begin."""
    begins = np.cumsum([0, *sizes])[:-1]
    moved = np.arange(len(flat)) + np.repeat(s.reach * np.arange(len(sizes)), sizes)  # so that none looks back into another
    mixed = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    each = np.zeros(len(flat) + s.reach * len(sizes), np.uint64)
    each[moved] = mixed
    rolling, window = each.copy(), 1  # sum of each[t - j] << j for j below window
    while 2 * window <= s.reach:
        rolling[window:] += rolling[:-window] << np.uint64(window)
        window *= 2
    for j in range(window, s.reach):
        rolling[j:] += each[: len(each) - j] << np.uint64(j)
    at = np.flatnonzero((rolling[moved] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - s.mean.bit_length() + 1) == 0)
    split = np.searchsorted(at, [*begins.tolist(), len(flat)])
    return [_apart((at[a:b] + 1 - begin).tolist(), n, s) for a, b, begin, n in zip(split, split[1:], begins, sizes)]


def _apart(found: list[int], size: int, s: Settings) -> list[int]:
    out, last = [], 0
    for at in [*found, size]:
        while at - last > s.most:
            last += s.most
            out.append(last)
        if at - last >= s.least or at == size and at > last:
            out.append(at)
            last = at
    return out


def address(ids: np.ndarray) -> bytes:
    return hashlib.sha256(ids.astype("<u4").tobytes()).digest()


def pack(ids: np.ndarray) -> bytes:
    width = 2 if len(ids) == 0 or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4")


@contextmanager
def _tidy(spark: SparkSession):
    """Within this, the files of a shuffle go when the job that made them has written its table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, s: Settings = Settings()) -> None:
    """Encode docs (doc_id, text) and write the three tables below folder.

    A null text counts as empty and holds the end id alone; rows that share a doc_id follow each other, in the
    order of their texts; null ids come first. An empty table gives empty tables.
    """
    with _tidy(docs.sparkSession):
        _write_chunks(_encode(docs, folder, tokenizer, s), folder)
        discard(docs.sparkSession, f"{folder}/staged")
        _write_manifest(docs.sparkSession, folder, s)


def _encode(docs: DataFrame, folder: str, tokenizer: str | None, s: Settings) -> DataFrame:
    """Written rows in ranges of doc_id: part, place and begin (rows and ids before in the part), and the document's chunks."""
    spark = docs.sparkSession
    schema = "part int, place long, begin long, doc_id long, n_tokens long, hashes array<binary>, payloads array<binary>, root binary"

    def run(batches):
        coder, part, place, begin = bpe.load(tokenizer or bpe.default_path()), TaskContext.get().partitionId(), 0, 0
        for batch in bpe.gathered(batches):
            hashes, payloads, roots, end, at = [], [], [], np.array([s.end_id], "<u4"), 0
            coded = coder.encode_many([t or "" for t in batch.column("text").to_pylist()])
            counts = [len(ids) + 1 for ids in coded]
            flat = np.concatenate([x for ids in coded for x in (ids, end)]).astype("<u4")
            raw, short = flat.tobytes(), flat.astype("<u2").tobytes()
            wide = np.flatnonzero(flat >> 16)
            for n, ends in zip(counts, cuts_of(flat, counts, s)):
                parts = [*zip([at, *(at + x for x in ends)], [at + x for x in ends])]
                hashes.append([hashlib.sha256(raw[4 * a : 4 * b]).digest() for a, b in parts])
                payloads.append([pack(flat[a:b]) for a, b in parts] if len(wide) else [b"\2" + short[2 * a : 2 * b] for a, b in parts])
                roots.append(hashlib.sha256(b"".join(hashes[-1])).digest())
                at += n
            n, kind = np.array(counts, np.int64), pa.list_(pa.binary())
            columns = [pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(place, place + len(n))), pa.array(begin + np.cumsum(n) - n), batch.column("doc_id"), pa.array(n)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hashes, kind), pa.array(payloads, kind), pa.array(roots, pa.binary())], names=["part", "place", "begin", "doc_id", "n_tokens", "hashes", "payloads", "root"])
            place, begin = place + len(n), begin + int(n.sum())

    first = F.col("doc_id").asc_nulls_first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # encoding is slow, so bytes must not join partitions
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(tasks, first).sortWithinPartitions(first, "text")
    dealt.mapInArrow(lean(run), schema).write.option("compression", "zstd").parquet(f"{folder}/staged")
    return spark.read.schema(schema).parquet(f"{folder}/staged")


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of hashes, 32 bytes each, in a bitmap of 2^bits bits."""
    return (hashes.reshape(-1, 32)[:, :8].copy().view("<u8").reshape(-1) >> np.uint64(64 - bits)).astype(np.int64)


def _mark(coded: DataFrame, folder: str) -> int:
    """Mark the hashes that occur more than once in a bitmap, which is written in slices; how many bits it has, as a power of two."""
    each = coded.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    each.write.option("compression", "zstd").parquet(f"{folder}/repeated")
    repeated = coded.sparkSession.read.schema("hash binary").parquet(f"{folder}/repeated")
    bits = max(16, (32 * repeated.count()).bit_length())  # at most one of 32 is marked
    least = min(bits, SLICE)

    def slots(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_slots(np.frombuffer(b"".join(batch.column("hash").to_pylist()), np.uint8), bits))], names=["slot"])

    def build(group: pa.Table) -> pa.Table:
        slot = group.column("slot").to_numpy()
        marks = np.zeros(1 << least, np.uint8)
        marks[slot & ((1 << least) - 1)] = 1
        save(f"{folder}/marks", str(slot[0] >> least), [np.packbits(marks, bitorder="little")])
        return pa.table([pa.array([int(slot[0] >> least)])], names=["slice"])

    made = repeated.mapInArrow(lean(slots), "slot long").groupBy(F.shiftright("slot", least).alias("slice")).applyInArrow(build, "slice long")
    made.write.parquet(f"{folder}/slices")  # a row for each slice
    discard(coded.sparkSession, f"{folder}/repeated")
    return bits


def _write_chunks(coded: DataFrame, folder: str) -> None:
    """The chunks whose hash is marked, each once, and the recipes with all others; only the parts' sums reach the driver."""
    spark, bits = coded.sparkSession, _mark(coded, folder)
    least = min(bits, SLICE)
    written = {r["slice"] for r in spark.read.schema("slice long").parquet(f"{folder}/slices").collect()}
    before, rank, start = [], 0, 0
    for r in coded.groupBy("part").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("ids")).orderBy("part").collect():  # a row for each part
        before.append((r["part"], rank, start))
        rank, start = rank + r["rows"], start + r["ids"]
    offsets = spark.createDataFrame(before, "part int, rank0 long, start0 long")

    def marked(hashes: pa.ListArray) -> np.ndarray:
        slot = _slots(np.frombuffer(b"".join(hashes.flatten().to_pylist()), np.uint8), bits)
        found = np.zeros(len(slot), bool)
        for i in np.unique(slot >> least).tolist():
            if i in written:
                mine = np.flatnonzero(slot >> least == i)
                at = slot[mine] & ((1 << least) - 1)
                found[mine] = load(f"{folder}/marks", str(i))[0][at >> 3] >> (at & 7).astype(np.uint8) & 1
        return found

    def common(batches):
        for batch in batches:
            use = pa.array(marked(batch.column("hashes")))
            yield pa.RecordBatch.from_arrays([batch.column(c).flatten().filter(use) for c in ("hashes", "payloads")], names=["hash", "payload"])

    def apart(batches):
        for batch in batches:
            own, use = batch.column("own"), pa.array(marked(batch.column("chunks")))
            sizes = np.concatenate(([0], np.cumsum(pc.list_value_length(own).to_numpy()))).astype(np.int32)
            left = pa.ListArray.from_arrays(pa.array(sizes), pc.if_else(use, pa.scalar(None, pa.binary()), own.flatten()))
            yield pa.RecordBatch.from_arrays([left if c == "own" else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    chunks = coded.select("hashes", "payloads").mapInArrow(lean(common), "hash binary, payload binary").groupBy("hash").agg(F.first("payload").alias("payload"))
    chunks.write.option("compression", "zstd").parquet(f"{folder}/chunks")
    ranked = coded.join(F.broadcast(offsets), "part").select((F.col("rank0") + F.col("place")).alias("rank"), "doc_id", (F.col("start0") + F.col("begin")).alias("start"), "n_tokens", F.col("hashes").alias("chunks"), "root", F.col("payloads").alias("own"))
    ranked.mapInArrow(lean(apart), ranked.schema).write.option("compression", "zstd").parquet(f"{folder}/recipes")
    discard(spark, f"{folder}/marks")
    discard(spark, f"{folder}/slices")


def _write_manifest(spark: SparkSession, folder: str, s: Settings) -> None:
    level = 0
    nodes = spark.read.parquet(f"{folder}/recipes").select(F.col("rank").alias("index"), F.col("root").alias("hash"))
    while True:
        path = f"{folder}/manifest/level={level}"
        nodes.coalesce(2 * spark.sparkContext.defaultParallelism).write.parquet(path)
        nodes = spark.read.schema(nodes.schema).parquet(path)
        if nodes.limit(2).count() < 2:
            return
        up = F.floor(F.col("index") / s.fan_out).cast("long").alias("index")
        listed = F.transform(F.sort_array(F.collect_list(F.struct("index", "hash"))), lambda x: x["hash"])  # at most fan_out hashes
        nodes = nodes.groupBy(up).agg(_hash(listed).alias("hash"))
        level += 1


def read(spark: SparkSession, folder: str, s: Settings = Settings()) -> DataFrame:
    """rank, doc_id, start, n_tokens, ids (little-endian 32-bit integers, binary) from the files of folder alone.

    First the recipes are verified against the manifest; then, on the way, every chunk's hash and every document's root
    and length. A difference fails the job. A document that holds all its chunks is read as it stands; the chunks of others
    pass through one task in order and are never collected as a group of documents.
    """
    if not verify(spark, folder, s):
        raise ValueError("the recipes of the store do not follow from its manifest")
    recipes = spark.read.parquet(f"{folder}/recipes")
    chunks = spark.read.parquet(f"{folder}/chunks")
    lacks = F.exists("own", F.isnull)
    parts = recipes.where(lacks).select("rank", "doc_id", "start", "n_tokens", "root", F.posexplode(F.arrays_zip("chunks", "own")).alias("at", "c"))
    parts = parts.select("rank", "doc_id", "start", "n_tokens", "root", "at", F.col("c.chunks").alias("hash"), F.col("c.own").alias("payload"))
    lent = parts.where("payload IS NULL").drop("payload").join(chunks, "hash", "left").select(parts.columns)
    rows = parts.where("payload IS NOT NULL").union(lent).repartition("rank").sortWithinPartitions("rank", "at")

    def joined(doc_id, n, root, hashes, payloads):
        parts = [p for p in payloads if p is not None]
        if all(p[0] == 2 for p in parts):
            raw, ends = np.frombuffer(b"".join([p[1:] for p in parts]), "<u2").astype("<u4").tobytes(), [*accumulate(2 * (len(p) - 1) for p in parts)]
        else:
            wide = [unpack(p).tobytes() for p in parts]
            raw, ends = b"".join(wide), [*accumulate(map(len, wide))]
        found = [hashlib.sha256(raw[a:b]).digest() for a, b in zip([0, *ends], ends)]
        if hashlib.sha256(b"".join(hashes)).digest() != root or len(raw) != 4 * n or found != hashes:
            raise ValueError(f"document {doc_id} of the store is damaged")
        return raw

    def alone(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "root", "chunks", "own")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rank", "doc_id", "start", "n_tokens")), pa.array([joined(*r) for r in rows], pa.binary())], names=["rank", "doc_id", "start", "n_tokens", "ids"])

    def whole(batches):
        head, hashes, payloads = None, [], []

        def done():
            return [*head[:4], joined(head[1], head[3], head[4], hashes, payloads)]

        for batch in batches:
            out = []
            for *row, h, p in zip(*(batch.column(c).to_pylist() for c in ("rank", "doc_id", "start", "n_tokens", "root", "hash", "payload"))):
                if head is not None and row[0] != head[0]:
                    out.append(done())
                    hashes, payloads = [], []
                head = row
                hashes.append(h)
                payloads.append(p)
            if out:
                yield rows_of(out)
        if head is not None:
            yield rows_of([done()])

    def rows_of(out):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["rank", "doc_id", "start", "n_tokens", "ids"])

    schema = "rank long, doc_id long, start long, n_tokens long, ids binary"
    held = recipes.where(~lacks).select("rank", "doc_id", "start", "n_tokens", "root", "chunks", "own").mapInArrow(lean(alone), schema)
    return held.union(rows.select("rank", "doc_id", "start", "n_tokens", "root", "hash", "payload").mapInArrow(lean(whole), schema))


def _hash(hashes) -> Column:
    """SHA-256 of joined hashes."""
    return F.unhex(F.sha2(F.unhex(F.array_join(F.transform(hashes, F.hex), "")), 256))


def verify(spark: SparkSession, folder: str, s: Settings = Settings()) -> bool:
    """Whether each level of the manifest follows from the one below, and the lowest from the recipes' chunks, row by row."""
    nodes = spark.read.parquet(f"{folder}/manifest").select(F.col("level").cast("int").alias("level"), "index", "hash")
    recipes = spark.read.parquet(f"{folder}/recipes").select(F.lit(0).alias("level"), F.col("rank").alias("index"), _hash("chunks").alias("hash"))
    top = nodes.agg(F.max("level")).first()[0]
    if top is None:
        return recipes.isEmpty()
    below = nodes.where(F.col("level") < top).groupBy((F.col("level") + 1).alias("level"), F.floor(F.col("index") / s.fan_out).cast("long").alias("index"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("index", "hash"))), lambda x: x["hash"])  # at most fan_out hashes
    made = recipes.union(below.agg(_hash(listed).alias("hash")))
    wrong = made.withColumnRenamed("hash", "made").join(nodes, ["level", "index"], "full").where(~F.col("made").eqNullSafe(F.col("hash")))
    return wrong.isEmpty() and nodes.count() == made.count()


def query(spark, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-store")
    write(table(spark, sf_dir, "documents"), folder)

    def digest(batches):
        for batch in batches:
            crc = [zlib.crc32(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read(spark, folder).mapInArrow(lean(digest), "doc_id long, start long, n_tokens long, ids_crc32 long")
