"""N-gram language model in Elias-Fano tries.

Trigram model over words and document ends, smoothed by absolute discounting with interpolation down to
add-one unigrams. N-grams of two or three words seen once are pruned after counting; what their mass leaves goes to
the lower order, so each context's probabilities sum to one but for the quantisation (8 bits, steps of
`STEP` in log10).

Level 1 holds the words in the order of their 64-bit hashes, level 2 for each word its successors, level 3 for each
bigram its successors; there a word is named by its place among the successors of the word before it
(Pibiri and Venturini 2017), which is small. Each level is a monotone sequence in Elias-Fano form (node, then
successor) and is searched by successor queries; monotone pointers give where a word's successors begin.

The corpus is counted in three scans; a count of two needs a count of two in every part, so each scan only counts
what the level below holds. Counts are added up per block before they are shuffled. Shards are ranges of the first
word's hash; one task builds a shard and writes it as one file to the shared folder, which scoring maps into memory.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, lean, shared_folder, table

U = np.uint64
END = xxhash.xxh3_64_intdigest(b" ")  # no word holds a space
STEP = 0.05
DISCOUNT = 0.75
BLOCK = 1 << 21  # tokens counted together in a task
SELECT8 = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[r] for r in range(8)] for b in range(256)], np.int64)


# -- Elias-Fano -----------------------------------------------------------------------------------------------------


class EliasFano:
    """A non-decreasing sequence of integers: low bits packed, high bits in unary, and a count of ones (for access) or
    of zeros (for find) before each word of the unary part."""

    def __init__(self, n: int, bits: int, top: int, low: np.ndarray, upper: np.ndarray, before: np.ndarray):
        self.n, self.bits, self.top, self.low, self.upper, self.before = n, bits, top, low, upper, before

    @classmethod
    def build(cls, values: np.ndarray, searched: bool) -> EliasFano:
        values = np.asarray(values, U)
        n, largest = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (largest // max(1, n)).bit_length() - 1)
        shifts = np.arange(bits, dtype=U)
        packed = [np.packbits(((values[i : i + 65536, None] >> shifts) & U(1)).astype(np.uint8).reshape(-1), bitorder="little") for i in range(0, n, 65536)] if bits else []
        high = (values >> U(bits)).astype(np.int64)
        top = int(high[-1]) if n else 0
        unary = np.zeros(-(-(n + top + 2) // 64) * 64, np.uint8)
        unary[high + np.arange(n)] = 1
        upper = np.packbits(unary, bitorder="little").view("<u8")
        low = np.concatenate([*packed, np.zeros(16, np.uint8)])
        low = low[: len(low) // 8 * 8].view("<u8")
        ones = np.bitwise_count(upper).astype(np.int64)
        each = 64 - ones if searched else ones
        return cls(n, bits, top, low, upper, np.cumsum(each) - each)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits, self.top], "<i8"), self.low, self.upper, self.before.astype("<u4")]

    @classmethod
    def of(cls, head: np.ndarray, low: np.ndarray, upper: np.ndarray, before: np.ndarray) -> EliasFano:
        return cls(*map(int, head), low, upper, before)

    def _select(self, k: np.ndarray, zero: bool) -> np.ndarray:
        word = np.searchsorted(self.before, k.astype(self.before.dtype), "right") - 1
        rest = k - self.before[word]
        x = self.upper[word]
        x = ~x if zero else x
        # Ones up to and including each byte, all eight bytes in one integer (broadword select, Vigna 2008).
        upto = x - ((x >> U(1)) & U(0x5555555555555555))
        upto = (upto & U(0x3333333333333333)) + ((upto >> U(2)) & U(0x3333333333333333))
        upto = ((upto + (upto >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * U(0x0101010101010101)
        rest = rest.astype(U)
        byte = np.bitwise_count(((rest * U(0x0101010101010101) | U(0x8080808080808080)) - upto) & U(0x8080808080808080)).astype(U)
        rest -= (upto << U(8)) >> (byte << U(3)) & U(255)
        return word * 64 + (byte << U(3)).astype(np.int64) + SELECT8[(x >> (byte << U(3))) & U(255), rest]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(U)
        value = self.low[word] >> shift
        value |= np.where(shift > 0, self.low[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return value & U((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places i; needs searched=False."""
        return ((self._select(i, zero=False) - i).astype(U) << U(self.bits)) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Places of the values x, -1 for those that are absent; needs searched=True. x ascending is fastest."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        x = np.asarray(x, U)
        high = (x >> U(self.bits)).astype(np.int64)
        may = np.flatnonzero((high <= self.top) & (high >= 0))
        high, want = high[may], x[may] & U((1 << self.bits) - 1)
        lo = np.where(high > 0, self._select(np.maximum(high - 1, 0), zero=True) - (high - 1), 0)
        hi = self._select(high, zero=True) - high
        end = hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        found = lo < end
        found[found] = self._low(lo[found]) == want[found]
        out[may[found]] = lo[found]
        return out


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-300)) / STEP), 0, 255).astype(np.uint8)


# -- files of the shared folder -------------------------------------------------------------------------------------


def _plain(folder: str) -> str | None:
    return folder.removeprefix("file://").removeprefix("file:") if folder.startswith(("file:", "/")) else None


def save(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """One file: a line of JSON with the arrays' kinds and sizes, then the arrays, each from a multiple of 64 bytes on.
    It appears under its name only when it is whole, so a task that runs again does no harm."""
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode() + b"\n"
    parts, size = [head], len(head)
    for a in arrays:
        parts.append(b"\0" * (-size % 64))
        size += len(parts[-1]) + a.nbytes
        parts.append(np.ascontiguousarray(a).tobytes())
    if (plain := _plain(folder)) is not None:
        os.makedirs(plain, exist_ok=True)
        part = f"{plain}/.{name}-{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            out.writelines(parts)
        os.replace(part, f"{plain}/{name}")
    else:
        store, path = pa.fs.FileSystem.from_uri(f"{folder}/{name}")
        part = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            for p in parts:
                out.write(p)
        store.move(part, path)


@lru_cache(maxsize=4096)
def load(folder: str, name: str) -> list[np.ndarray]:
    """The arrays of a file, mapped into memory; from a store that cannot be mapped by way of an unlinked local copy."""
    if (plain := _plain(folder)) is not None:
        raw = np.memmap(f"{plain}/{name}", np.uint8, "r")
    else:
        store, path = pa.fs.FileSystem.from_uri(f"{folder}/{name}")
        with tempfile.NamedTemporaryFile() as copy:
            with store.open_input_stream(path) as source:
                shutil.copyfileobj(source, copy, 1 << 20)
            copy.flush()
            raw = np.memmap(copy.name, np.uint8, "r")
    first = bytes(raw[: 1 << 16]).index(b"\n") + 1
    out, at = [], first
    for kind, n in json.loads(bytes(raw[: first - 1])):
        at += -at % 64
        size = n * np.dtype(kind).itemsize
        out.append(raw[at : at + size].view(kind))
        at += size
    return out


# -- tokens ---------------------------------------------------------------------------------------------------------


class Lexicon:
    """The distinct words of a block, and the end, by their hashes, each with its id and count in a model once it was looked up."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.words = self.seen = None

    def look_up(self, model: Model, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of words by their places."""
        if self.words is None:
            distinct, back = np.unique(self.hashes, return_inverse=True)
            ids, counts = model.look_up(distinct)
            self.words, self.seen = ids[back], counts[back]
        return self.words[flat], self.seen[flat]


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts one behind the other, in lower case (A to Z only) and cut at ASCII white space, and how many each has."""
    whole = pa.array([t or "" for t in texts.to_pylist()], pa.large_string())  # Arrow's ascii_lower goes wrong on slices
    split = pc.ascii_split_whitespace(pc.ascii_lower(whole))
    words, ends = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    some = pc.not_equal(pc.binary_length(words), 0)
    kept = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
    return words.filter(some), np.diff(kept[ends])


def blocks(batches, size: int = BLOCK):
    """(ids of the documents, lexicon, words as places in it, where each document ends) of about `size` tokens each; documents stay whole."""

    def done():
        coded = pa.chunked_array(held, pa.large_string()).combine_chunks().dictionary_encode()
        ends = np.cumsum(np.concatenate(sizes) + 1)
        flat, word = np.zeros(int(ends[-1]), np.int64), np.ones(int(ends[-1]), bool)
        word[ends - 1] = False
        flat[word] = coded.indices.to_numpy()
        flat[word] += 1
        hashes = [END, *map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.large_binary()).to_pylist())]
        return names, Lexicon(np.array(hashes, U)), flat, ends

    names, held, sizes, n = [], [], [], 0
    for batch in batches:
        if batch.num_rows:
            words, each = tokens(batch.column("text"))
            names += batch.column("doc_id").to_pylist()
            held.append(words)
            sizes.append(each)
            n += len(words) + len(each)
        if n >= size:
            yield done()
            names, held, sizes, n = [], [], [], 0
    if names:
        yield done()


def sums(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.empty(0, bool))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def _packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending keys as planes of bytes of their differences, which shuffles compress well; counts likewise."""
    steps = np.diff(keys, prepend=U(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps = np.ascontiguousarray(np.frombuffer(keys, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)
    return np.cumsum(steps, dtype=U), np.ascontiguousarray(np.frombuffer(counts, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


# -- the model ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    folder: str
    shards: int
    first: tuple[int, ...] = ()  # for each shard, and the end: how many words come before
    tokens: int = 0
    docs: int = 0
    fan_out: int = 1  # most successors of a word, plus one

    @property
    def words(self) -> int:
        return self.first[-1]

    @property
    def start(self) -> int:
        """The context before a document's first word."""
        return self.words

    @property
    def radix(self) -> int:
        return self.words + 2

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """log10 of the add-one probability."""
        return np.log10((count + 1) / (self.tokens + self.words + 1))

    def by_shard(self, sorted_keys: np.ndarray, edges: np.ndarray):
        cut = np.concatenate(([0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]))
        return ((s, slice(int(a), int(b))) for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a)

    def _edges(self, radix: int = 1) -> np.ndarray:
        return np.array(self.first[1:-1], U) * U(radix)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ids, `words` + 1 where unknown, and counts of ascending distinct hashes."""
        ids, counts = np.full(len(hashes), self.words + 1, np.int64), np.zeros(len(hashes), np.int64)
        for s, part in self.by_shard(hashes, hash_edges(self.shards)):
            *ef, count = load(self.folder, f"words-{s}")
            at = EliasFano.of(*ef).find(hashes[part])
            known = at >= 0
            ids[part] = np.where(known, at + self.first[s], self.words + 1)
            counts[part] = np.where(known, count[np.maximum(at, 0)] if len(count) else 0, 0)
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ascending word ids; the start counts the documents."""
        out = np.zeros(len(ids), np.int64)
        for s, part in self.by_shard(ids.astype(U), self._edges()):
            here = ids[part] - self.first[s]
            count = load(self.folder, f"words-{s}")[-1]
            inside = here < len(count)
            out[part] = np.where(inside, count[np.where(inside, here, 0)] if len(count) else 0, self.docs)
        return out

    def pairs(self, keys: np.ndarray, finished: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For ascending keys word * radix + successor: place in the shard (-1: absent), place among the word's
        successors, quantised probability, and, of a finished model, the
        quantised weight that the pair as a context leaves to lower orders."""
        at, rank = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        p, rest = np.zeros(len(keys), np.uint8), np.zeros(len(keys), np.uint8)
        for s, part in self.by_shard(keys, self._edges(self.radix)):
            level = load(self.folder, f"pairs-{s}")
            own = keys[part] - U(self.first[s]) * U(self.radix)
            here = EliasFano.of(*level[:4]).find(own)
            hit = np.flatnonzero(here >= 0)
            at[part] = here
            rank[part.start + hit] = here[hit] - EliasFano.of(*level[4:8]).access((own[hit] // U(self.radix)).astype(np.int64)).astype(np.int64)
            p[part.start + hit] = level[8][here[hit]]
            if finished:
                rest[part.start + hit] = load(self.folder, f"triples-{s}")[5][here[hit]]
        return at, rank, p, rest

    def rests(self, ids: np.ndarray) -> np.ndarray:
        """Quantised weights that ascending word ids as contexts leave to unigrams; unknown words leave all."""
        out = np.zeros(len(ids), np.uint8)
        for s, part in self.by_shard(ids.astype(U), self._edges()):
            left, here = load(self.folder, f"pairs-{s}")[9], ids[part] - self.first[s]
            inside = here < len(left)
            out[part] = np.where(inside, left[np.where(inside, here, 0)] if len(left) else 0, 0)
        return out

    def triples(self, shard_keys: list[tuple[int, slice]], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key (pair's place * fan_out + rank, ascending in each shard's slice) is there, and its quantised probability."""
        there, p = np.zeros(len(keys), bool), np.zeros(len(keys), np.uint8)
        for s, part in shard_keys:
            level = load(self.folder, f"triples-{s}")
            here = EliasFano.of(*level[:4]).find(keys[part])
            hit = here >= 0
            there[part] = hit
            p[part] = np.where(hit, level[4][np.maximum(here, 0)] if len(level[4]) else 0, 0)
        return there, p

    # Positions of a block: w with its context (u, v).

    def positions(self, lexicon: Lexicon, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word id, count, previous id and the one before for each token; the start stands before a document, twice."""
        w, c = lexicon.look_up(self, flat)
        v, u = np.empty_like(w), np.empty_like(w)
        v[1:], u[2:] = w[:-1], w[:-2]
        begins = np.concatenate(([0], ends[:-1]))
        v[begins] = self.start
        u[begins] = u[np.minimum(begins + 1, len(u) - 1)] = self.start
        return w, c, v, u

    def pair_keys(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v.astype(U) * U(self.radix) + w.astype(U)

    def shard_of(self, ids: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(np.array(self.first[1:]), ids, "right"), self.shards - 1)


def hash_edges(shards: int) -> np.ndarray:
    return np.array([(s << 64) // shards for s in range(1, shards)], U)


PARTS = "shard int, keys binary, counts binary"
DONE = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])


def _part_rows(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    rows = [(s, *_packed(k, c)) for s, k, c in found]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "keys", "counts"])


def _summed(group: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    parts = [_unpacked(k, c) for k, c in zip(group.column("keys").to_pylist(), group.column("counts").to_pylist())]
    return group.column("shard")[0].as_py(), *sums(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


def _done(shard: int, n: int, total: int) -> pa.Table:
    return pa.table([pa.array([shard], pa.int32()), pa.array([n]), pa.array([total])], schema=DONE)


def _run(docs: DataFrame, scan, build, shards: int) -> dict[int, tuple[int, int]]:
    """Scan the documents, add up each shard's keys in one task, build it; a row for each shard comes back.

    Every shard gets an empty part, so that every file exists.
    """
    spark = docs.sparkSession
    none = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(b"").alias("keys"), F.lit(b"").alias("counts"))
    parts = docs.mapInArrow(lean(scan), PARTS).union(none)
    return {r["shard"]: (r["n"], r["total"]) for r in parts.groupBy("shard").applyInArrow(build, "shard int, n long, total long").collect()}


def train(docs: DataFrame, folder: str, shards: int | None = None, min_count: int = 2) -> Model:
    """Learn from all rows of docs (doc_id, text); a null text counts as empty, so as an end alone.

    Pairs and triples that occur less than min_count times are pruned; with 1 none are, as in the query.
    """
    docs = docs.select("doc_id", "text")
    shards = shards or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    model = Model(folder, shards)

    def count_words(batches):
        for _, lexicon, flat, _ in blocks(batches):
            keys, counts = sums(lexicon.hashes, np.bincount(flat, minlength=len(lexicon.hashes)))
            yield _part_rows([(s, keys[x], counts[x]) for s, x in model.by_shard(keys, hash_edges(shards))])

    def build_words(group: pa.Table) -> pa.Table:
        s, keys, counts = _summed(group)
        save(folder, f"words-{s}", [*EliasFano.build(keys, searched=True).arrays(), counts.astype("<u4" if not len(counts) or counts.max() < 1 << 32 else "<u8")])
        return _done(s, len(keys), int(counts.sum()))

    made = _run(docs, count_words, build_words, shards)
    first = tuple(np.cumsum([0, *(made[s][0] for s in range(shards))]).tolist())
    model = replace(model, first=first, tokens=sum(t for _, t in made.values()))
    if not model.tokens:
        return model
    _, end_counts = model.look_up(np.array([END], U))
    words = replace(model, docs=int(end_counts[0]))

    def count_pairs(batches):
        for _, lexicon, flat, ends in blocks(batches):
            w, c, v, _ = words.positions(lexicon, flat, ends)
            before = np.empty_like(c)
            before[1:] = c[:-1]
            before[np.concatenate(([0], ends[:-1]))] = words.docs
            keys, counts = sums(words.pair_keys(w, v)[(c >= min_count) & (before >= min_count)])
            yield _part_rows([(s, keys[x], counts[x]) for s, x in words.by_shard(keys, words._edges(words.radix))])

    def build_pairs(group: pa.Table) -> pa.Table:
        s, keys, counts = _summed(group)
        keys, counts = keys[counts >= min_count], counts[counts >= min_count]
        size = words.first[s + 1] - words.first[s] + (s == shards - 1)  # the start is the last shard's last word
        own = keys - U(words.first[s]) * U(words.radix)
        node = (own // U(words.radix)).astype(np.int64)
        of_node = words.counts(words.first[s] + np.arange(size))
        kept = (counts - DISCOUNT) / of_node[node] if len(node) else np.empty(0)
        rest = 1 - np.bincount(node, kept, minlength=size)
        target, back = np.unique((keys % U(words.radix)).astype(np.int64), return_inverse=True)
        p = kept + rest[node] * 10 ** words.unigram(words.counts(target))[back] if len(node) else kept
        begin = np.searchsorted(node, np.arange(size + 1))
        most = int(np.diff(begin).max()) if size else 0
        save(folder, f"pairs-{s}", [*EliasFano.build(own, searched=True).arrays(), *EliasFano.build(begin, searched=False).arrays(), quantise(p), quantise(rest), counts.astype("<u4" if not len(counts) or counts.max() < 1 << 32 else "<u8")])
        return _done(s, len(keys), most)

    made = _run(docs, count_pairs, build_pairs, shards)
    pairs = replace(words, fan_out=max(m for _, m in made.values()) + 1)

    def triple_positions(lexicon, flat, ends):
        w, _, v, u = pairs.positions(lexicon, flat, ends)
        keys, back = np.unique(pairs.pair_keys(w, v), return_inverse=True)
        at, rank, _, _ = pairs.pairs(keys, finished=False)
        here, place = at[back], rank[back]
        context = np.full(len(w), -1, np.int64)  # the pair (u, v) ends one token earlier
        context[1:] = here[:-1]
        context[np.concatenate(([0], ends[:-1]))] = -1
        return u, here, place, context

    def count_triples(batches):
        for _, lexicon, flat, ends in blocks(batches):
            u, here, place, context = triple_positions(lexicon, flat, ends)
            use = (here >= 0) & (context >= 0)
            shard = pairs.shard_of(u[use])
            keys = context[use].astype(U) * U(pairs.fan_out) + place[use].astype(U)
            bits = int(keys.max()).bit_length() if len(keys) else 0
            if bits + shards.bit_length() <= 64:  # shard and key in one integer, which sorts far faster than by both
                joint, counts = sums(shard.astype(U) << U(bits) | keys)
                keys, cut = joint & U((1 << bits) - 1), np.searchsorted(joint >> U(bits), np.arange(shards + 1).astype(U))
                yield _part_rows([(s, keys[a:b], counts[a:b]) for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a])
                continue
            order = np.lexsort((keys, shard))
            keys, shard = keys[order], shard[order]
            cut = np.searchsorted(shard, np.arange(shards + 1))
            yield _part_rows([(s, *sums(keys[a:b])) for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a])

    def build_triples(group: pa.Table) -> pa.Table:
        s, keys, counts = _summed(group)
        keys, counts = keys[counts >= min_count], counts[counts >= min_count]
        level = load(folder, f"pairs-{s}")
        pair_counts = level[10].astype(np.int64)
        node = (keys // U(pairs.fan_out)).astype(np.int64)
        rank = (keys % U(pairs.fan_out)).astype(np.int64)
        kept = (counts - DISCOUNT) / pair_counts[node] if len(node) else np.empty(0)
        rest = 1 - np.bincount(node, kept, minlength=len(pair_counts))
        # The middle word of each context, then the pair (middle, last) by its rank among the middle's successors.
        middle = np.empty(len(node), np.int64)
        if len(node):
            distinct, back = np.unique(node, return_inverse=True)
            values = _values(EliasFano.of(*level[:4]), distinct)
            middle = (values % U(pairs.radix)).astype(np.int64)[back]
        lower = np.zeros(len(node), np.uint8)
        order = np.argsort(middle, kind="stable")
        for t, part in pairs.by_shard(middle[order].astype(U), pairs._edges()):
            other = load(folder, f"pairs-{t}")
            rows = order[part]
            lower[rows] = other[8][EliasFano.of(*other[4:8]).access(middle[rows] - pairs.first[t]).astype(np.int64) + rank[rows]]
        p = kept + rest[node] * 10 ** (-STEP * lower) if len(node) else kept
        save(folder, f"triples-{s}", [*EliasFano.build(keys, searched=True).arrays(), quantise(p), quantise(rest)])
        return _done(s, len(keys), 0)

    _run(docs, count_triples, build_triples, shards)
    return pairs


def _values(ef: EliasFano, places: np.ndarray) -> np.ndarray:
    """Values at places of a searched sequence, which has no count of ones: made here, where the whole level is at hand."""
    ones = np.bitwise_count(ef.upper).astype(np.int64)
    return EliasFano(ef.n, ef.bits, ef.top, ef.low, ef.upper, np.cumsum(ones) - ones).access(places)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) for each row of docs (doc_id, text).

    base_score is of the add-one unigrams, score of the trigram model. A null text counts as empty: an end alone.
    Words that training never saw have the unigram's share for a count of 0 and are no context.
    """

    def run(batches):
        for names, lexicon, flat, ends in blocks(batches, BLOCK // 2):
            starts = np.concatenate(([0], ends[:-1]))
            if not model.tokens:
                n = len(names)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ends - starts), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n)), pa.array(np.zeros(n))], names=list(columns))
                continue
            w, c, v, u = model.positions(lexicon, flat, ends)
            base = model.unigram(c)
            keys, back = np.unique(model.pair_keys(w, v), return_inverse=True)
            at, rank, p, rest = (x[back] for x in model.pairs(keys))
            contexts, where = np.unique(v, return_inverse=True)
            result = np.where(at >= 0, -STEP * p, base - STEP * model.rests(contexts)[where])
            later = np.ones(len(w), bool)
            later[starts] = False
            use = np.flatnonzero(later)
            use = use[at[use - 1] >= 0]  # the pair before is a context of level 3
            result[use] -= STEP * rest[use - 1]
            use = use[at[use] >= 0]
            shard = model.shard_of(u[use])
            keys = at[use - 1].astype(U) * U(model.fan_out) + rank[use].astype(U)
            order = np.lexsort((keys, shard))
            cut = np.searchsorted(shard[order], np.arange(model.shards + 1))
            there, p3 = model.triples([(s, slice(int(a), int(b))) for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a], keys[order])
            hit = use[order[there]]
            result[hit] = -STEP * p3[there]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(ends - starts), pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(result, starts))],
                names=list(columns),
            )

    columns = {"doc_id": "long", "n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double"}
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), ", ".join(f"{k} {t}" for k, t in columns.items()))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False))
    model = train(docs.where(~held), shared_folder(spark, "ngram-trie"), min_count=1)
    return score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
