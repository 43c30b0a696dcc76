"""Packing documents into training sequences: shortest pack first over the histogram of lengths.

Every document is encoded whole, closed with an end id and cut into pieces of `Settings.size` ids and one shorter rest.
How many pieces there are of each length (at most `size` numbers, whatever the corpus) is all that the packing sees:
lengths are placed longest first, always into the packs with the most room left, and packs that hold the same lengths
are one pattern with a count. A pattern's slots of a length take consecutive ranks among all pieces of that length, so
a piece finds its sequence and its place there from its length and rank alone.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, materialise, table

#: The tokenizer file's own pattern for what it looks up.
PART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space for Python only, not for the tokenizer.
ODD = "\x1c\x1d\x1e\x1f"


@dataclass(frozen=True)
class Settings:
    size: int = 2048
    end_id: int = 1
    remembered: int = 400_000  # units between white space, and as many parts of them
    block: int = 1 << 20  # characters of a long text encoded at once
    pad_id: int = 0


class WordBpe:
    """A lower-casing tokenizer that drops white space; ids are the library's with add_special_tokens=False.

    White space never lies within a token and nothing is composed across it, so a text's ids are those of its units one
    after the other, and units are remembered. New units of plain Latin letters are cut by the tokenizer's own pattern
    and only their parts go to its merges; all others, and texts with special tokens' strings, go through the library.
    """

    def __init__(self, path: str, settings: Settings = Settings()):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        first, second = spec["pre_tokenizer"]["pretokenizers"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or first["pattern"]["Regex"] != PART or second["type"] != "ByteLevel" or second["add_prefix_space"] or second["use_regex"]:
            raise ValueError("a tokenizer that composes, folds white space, lower-cases and cuts by words is needed")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.settings = settings
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.parts, self.units = _Parts(self), _Units(self)
        self.cut = regex.compile(PART).findall

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if any(c in text for c in ODD) or any(t in text for t in self.special):
            return self._library(text)
        out, at = [], 0
        while at < len(text):
            end = at + self.settings.block
            while end < len(text) and not text[end].isspace():
                end += 1
            for known in (self.units, self.parts):
                if len(known) > self.settings.remembered:
                    known.clear()
            out.extend(map(self.units.__getitem__, text[at:end].split()))
            at = end
        return b"".join(out)


class _Parts(dict):
    """Ids of what the tokenizer's pattern cuts out, each looked up once."""

    def __init__(self, owner: WordBpe):
        self.merge, self.char = owner.tokenizer.model.tokenize, owner.char

    def __missing__(self, part: str) -> bytes:
        shown = part if part.isascii() and part.isprintable() else "".join(map(self.char.__getitem__, part.encode()))
        self[part] = found = array("I", [t.id for t in self.merge(shown)]).tobytes()
        return found


class _Units(dict):
    """Ids of what stands between white space."""

    def __init__(self, owner: WordBpe):
        self.owner = owner

    def __missing__(self, unit: str) -> bytes:
        parts = self.owner.parts
        if not (unit.isascii() or max(unit) < "ɐ" and "İ" not in unit):
            found = self.owner._library(unit)
        elif (low := unit.lower()).isalpha():
            found = parts[low]
        elif low[:-1].isalpha() and low[-1] in ".,;:!?":
            found = parts[low[:-1]] + parts[low[-1]]
        else:
            found = b"".join(map(parts.__getitem__, self.owner.cut(low)))
        self[unit] = found
        return found


@lru_cache(maxsize=2)
def load(path: str, settings: Settings = Settings()) -> WordBpe:
    if (task := TaskContext.get()) is not None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(task.cpus()))
    return WordBpe(path, settings)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packs as (how many alike, [(length, how often in one pack), ...]) for the pieces counted by histogram.

    Lengths come longest first; each piece goes to the pack with the most room, and a new pack opens only where none
    has enough. Packs with the same content move together, so the work depends on `size`, not on the number of pieces.
    """
    packs: list[tuple[int, int, int, list[tuple[int, int]]]] = []  # a heap: -room, order, count, content
    order = 0
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left = histogram[length]
        while left:
            if packs and -packs[0][0] >= length:
                room, _, count, content = heapq.heappop(packs)
                used = min(count, left)
                if used < count:
                    heapq.heappush(packs, (room, order, count - used, content))
                    order += 1
                more = [*content[:-1], (length, content[-1][1] + 1)] if content[-1][0] == length else [*content, (length, 1)]
                heapq.heappush(packs, (room + length, order, used, more))
                left -= used
            else:
                fits = min(size // length, left)
                used = left // fits
                heapq.heappush(packs, (length * fits - size, order, used, [(length, fits)]))
                left -= used * fits
            order += 1
    return [(count, content) for _, _, count, content in sorted(packs, key=lambda x: x[1])]


def slots(found: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each length of each pattern: length, first rank, ranks, first sequence, pieces of that length in one sequence,
    offset of the first of them."""
    out, taken, sequence = [], {}, 0
    for count, content in found:
        offset = 0
        for length, often in content:
            first = taken.get(length, 0)
            out.append((length, first, count * often, sequence, often, offset))
            taken[length] = first + count * often
            offset += length * often
        sequence += count
    return out


def pieces(docs: DataFrame, path: str | None = None, s: Settings = Settings()) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (little-endian 32-bit integers), and where the row stands: part (its task)
    and place (among the rows of its length there). To be written once before it is read, as part and place belong together."""

    def run(batches):
        coder = load(path or default_path(), s)
        part, seen = TaskContext.get().partitionId(), np.zeros(s.size + 1, np.int64)
        end, width = array("I", [s.end_id]).tobytes(), 4 * s.size
        for batch in (batch.slice(at, 100) for batch in batches for at in range(0, batch.num_rows, 100)):
            rows, starts, totals, ids = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw = coder.encode(text or "") + end
                cut = [raw[at : at + width] for at in range(0, len(raw), width)]
                rows.extend([i] * len(cut))
                starts.extend(range(0, len(raw) // 4, s.size))
                totals.extend([len(raw) // 4] * len(cut))
                ids.extend(cut)
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            order = np.argsort(lengths, kind="stable")
            run_start = np.searchsorted(lengths[order], lengths[order], "left")
            places = np.empty(len(ids), np.int64)
            places[order] = np.arange(len(ids)) - run_start + seen[lengths[order]]
            seen += np.bincount(lengths, minlength=s.size + 1)
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in (starts, lengths, totals)), pa.array(ids, pa.binary()), pa.array(np.full(len(ids), part, np.int32)), pa.array(places)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "ids", "part", "place"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, start long, length long, doc_tokens long, ids binary, part int, place long")


def place(cut: DataFrame, s: Settings = Settings()) -> DataFrame:
    """cut (written rows of `pieces`, or of their columns but for ids) with sequence_id and offset instead of part and place.

    Ranks come from counts for each length and task; the driver holds `size` counts and the patterns made of them.
    """
    spark = cut.sparkSession
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("rows"))
    histogram = {r["length"]: r["total"] for r in counts.groupBy("length").agg(F.sum("rows").alias("total")).collect()}
    before = F.sum("rows").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = cut.join(counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before")), ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    found = spark.createDataFrame(slots(patterns(histogram, s.size)), "length long, first long, ranks long, sequence long, often long, offset0 long")
    inside = (ranked["length"] == found["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks"))
    at = F.col("rank") - F.col("first")
    kept = [ranked[c] for c in cut.columns if c not in ("part", "place")]
    return ranked.join(F.broadcast(found), inside).select(*kept, (F.col("sequence") + F.floor(at / F.col("often"))).alias("sequence_id"), (F.col("offset0") + at % F.col("often") * ranked["length"]).alias("offset"))


def pack(docs: DataFrame, path: str | None = None, s: Settings = Settings()) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids, sequence_id (from 0, without gaps) and offset of every piece of docs.

    A null text counts as empty and gives the end id alone. Very long texts are encoded block by block. Rows that share
    a doc_id, null ids among them, are documents of their own; other columns of docs are not read. An empty table gives
    no piece. The files behind the pieces stay in the shared folder until `discard`.
    """
    return place(materialise(pieces(docs, path, s), "packing", scan=True), s)


def sequences(packed: DataFrame, s: Settings = Settings()) -> DataFrame:
    """sequence_id, n_tokens, starts (offsets of its pieces) and ids of every sequence, padded to `size` unless n_tokens is
    a power of two. A group holds `size` ids at most."""
    one = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    gap = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(s.size - F.col("n_tokens"))
    pad = F.repeat(F.lit(np.uint32(s.pad_id).tobytes().hex()), gap.cast("int"))
    joined = F.concat(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""), pad)
    return one.select("sequence_id", "n_tokens", F.transform("p", lambda x: x["offset"]).alias("starts"), F.unhex(joined).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces with a checksum instead of their ids, which need not be written then."""
    cut = pieces(table(spark, sf_dir, "documents"))
    kept = [c for c in cut.columns if c != "ids"]
    return place(materialise(cut.select(*kept, F.crc32("ids").alias("ids_crc32")), "packing", scan=True))
