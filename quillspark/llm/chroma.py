"""Chroma audio fingerprints, and search for recordings that align.

Sound is cut into frames; the energy of each frame's spectrum is folded into the twelve pitch classes. Filters that
compare rectangles of the pitch-class image, read off its integral image, are quantised to two Gray-coded bits each;
sixteen of them make one 32-bit integer for each frame (after Jang et al. 2009).

A query and a recording are aligned by the histogram of offsets between equal integers (landmarks, each once for a
recording); at each offset that occurs the share of differing bits decides. Queries are written in blocks to the
shared folder; all recordings stream past every block, and each task keeps for a query how many recordings match, which
of them have the query's own id, the two best, and every class of equal sound that matches. Copies are not paired one by
one: `classes` tells the class of each recording.

Rows can hold sound as 16-bit PCM in WAV (`wav`), or text, which `tones` plays: a short chord for each word.
"""

from __future__ import annotations

import io
import re
import wave
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, shared_folder, table
from .ngram_trie import load, save

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    rate: int = 8000
    frame: int = 64  # samples; for music a frame of 4096 at 11025 is usual
    hop: int = 64
    thin: int = 1  # one of so many integers is a landmark (1: all) ...
    least: int = 8  # ... and the so many with the least hash are in any case
    bit_errors: float = 0.25  # largest share of differing bits
    overlap: float = 0.5  # least share of the shorter recording ...
    shortest: int = 32  # ... and least length; below that only equal integers match
    block: int = 4_000_000  # integers in a block of queries
    pairs: int = 1_000_000  # equal integers looked at at once
    held: int = 200_000  # links that a task holds before it passes them on


#: (kind, lowest pitch class, pitch classes, frames) by a rule: each kind in turn, ever wider and higher.
FILTERS = [(i % 6, (5 * i) % 12 % (12 - h + 1), h, w) for i in range(16) for h, w in [((4, 6, 3, 8)[i % 4], (4, 8, 12, 16)[i // 4])]]
LONGEST = 16
UNIT = 1024
#: Thresholds of the two bits on the logarithm of the ratio: near the quartiles of each kind's values.
QUARTILE = (0.35, 0.25, 0.25, 0.25, 0.25, 0.25)


@lru_cache(maxsize=4)
def _pitch_classes(rate: int, frame: int) -> np.ndarray:
    """Which spectrum line adds to which pitch class, from 28 Hz to 3520 Hz."""
    f = np.fft.rfftfreq(frame, 1 / rate)
    fold = np.zeros((len(f), 12))
    use = (f >= 28) & (f <= 3520)
    fold[np.flatnonzero(use), np.round(12 * np.log2(f[use] / 440)).astype(int) % 12] = 1
    return fold


def chroma(samples: np.ndarray, s: Settings = Settings()) -> np.ndarray:
    """Frames by twelve classes as whole numbers, each frame of length `UNIT` (silence: zero), so that sums are exact
    and do not depend on what else a task computes. Less than a frame is filled up with silence."""
    if not len(samples):
        return np.zeros((0, 12), np.int64)
    if len(samples) < s.frame:
        samples = np.pad(samples, (0, s.frame - len(samples)))
    frames = np.lib.stride_tricks.sliding_window_view(samples, s.frame)[:: s.hop].astype(float)
    if s.hop < s.frame:
        frames = frames * np.hanning(s.frame)
    spectrum = np.fft.rfft(frames, axis=1)
    energy = (spectrum.real**2 + spectrum.imag**2) @ _pitch_classes(s.rate, s.frame)
    norm = np.sqrt((energy * energy).sum(1, keepdims=True))
    return np.round(np.divide(energy, norm, out=np.zeros_like(energy), where=norm > 1e-3) * UNIT).astype(np.int64)


def integers(image: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each place of the filters' window over the frames (LONGEST frames; last frames repeat no more)."""
    n = len(image) - LONGEST + 1
    total = np.zeros((13, len(image) + 1), np.int64)
    total[1:, 1:] = image.T.cumsum(1).cumsum(0)

    def area(t0, t1, c0, c1):
        return total[c1, t1 : t1 + n] - total[c1, t0 : t0 + n] - total[c0, t1 : t1 + n] + total[c0, t0 : t0 + n]

    out = np.zeros(n, np.uint32)
    for kind, c, h, w in FILTERS:
        whole, half_t, half_c, third_t, third_c = area(0, w, c, c + h), w // 2, c + h // 2, w // 3, max(1, h // 3)
        if kind == 0:  # a rectangle against the image beside it
            part, rest = whole, area(0, w, 0, 12) - whole
            rest = rest * h / max(1, 12 - h)
        else:
            if kind == 1:  # later half
                part = area(half_t, w, c, c + h)
            elif kind == 2:  # upper half
                part = area(0, w, half_c, c + h)
            elif kind == 3:  # crosswise quarters
                part = area(0, half_t, c, half_c) + area(half_t, w, half_c, c + h)
            elif kind == 4:  # middle third of the time
                part = 2 * area(third_t, 2 * third_t, c, c + h)
            else:  # middle third of the pitch
                part = 2 * area(0, w, c + third_c, c + 2 * third_c)
            rest = np.maximum(whole - part / (2 if kind > 3 else 1), 0)
        part, rest, ratio = 0.1 * UNIT + part, 0.1 * UNIT + rest, np.exp(QUARTILE[kind])
        level = (part * ratio > rest).astype(np.uint32)
        level += part > rest
        level += part > rest * ratio
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def fingerprint(samples: np.ndarray, s: Settings = Settings()) -> np.ndarray:
    """Integers of one recording; one that is shorter than the filters is filled up with silence; none for no sound."""
    image = chroma(samples, s)
    if not len(image):
        return np.empty(0, np.uint32)
    return integers(np.pad(image, ((0, max(0, LONGEST - len(image))), (0, 0))))


def fingerprints(recordings: list[np.ndarray], s: Settings = Settings()) -> list[np.ndarray]:
    """The same of many short recordings at once, their images side by side, where frames do not overlap."""
    if s.hop != s.frame:
        return [fingerprint(x, s) for x in recordings]
    frames = [-(-len(x) // s.frame) for x in recordings]
    room = [max(n, LONGEST) if n else 0 for n in frames]
    line = np.zeros(sum(room) * s.frame, np.float32)
    starts = np.cumsum([0, *room])
    for x, a in zip(recordings, starts):
        line[a * s.frame : a * s.frame + len(x)] = x
    if len(line) < LONGEST * s.frame:
        return [np.empty(0, np.uint32) for _ in recordings]
    found = integers(chroma(line, s))
    return [found[a : a + n - LONGEST + 1] if n else np.empty(0, np.uint32) for a, n in zip(starts, room)]


# -- sound from rows ------------------------------------------------------------------------------------------------


def wav(data: bytes | None) -> np.ndarray:
    """Samples of 16-bit PCM in WAV, channels averaged; null or empty data is silence of no length."""
    if not data:
        return np.empty(0, np.float32)
    with wave.open(io.BytesIO(data)) as f:
        if f.getsampwidth() != 2:
            raise ValueError("16-bit PCM is needed")
        return np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels()).mean(1).astype(np.float32)


@lru_cache(maxsize=2)
def _chords(s: Settings, many: int = 4096) -> np.ndarray:
    """Chords of three tones of the frame's own spectrum lines."""
    lines = np.arange(s.frame) * 2 * np.pi / s.frame
    top = max(4, min(s.frame // 2 - 1, int(3500 * s.frame / s.rate)))
    rng = np.random.default_rng(12)
    tones = 1 + np.argsort(rng.random((many, top - 1)), axis=1)[:, :3] % (top - 1)
    loud = rng.uniform(0.2, 1, (many, 3, 1))
    return np.round(9000 * (loud * np.sin(tones[:, :, None] * lines)).sum(1)).astype(np.float32)


class Tones:
    """Plays text: a chord of one frame for each word, chosen by the word's hash; null is silence of no length."""

    def __init__(self, s: Settings = Settings(), remembered: int = 100_000):
        self.chords, self.known, self.remembered = _chords(s), {}, remembered

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.known) > self.remembered:
            self.known.clear()
        known, words = self.known, WORD.findall((text or "").lower())
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w) % len(self.chords)
        return self.chords[[known[w] for w in words]].reshape(-1) if words else np.empty(0, np.float32)


# -- search ---------------------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


def landmarks(print_: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct integers that serve to find a recording, and where each first stands."""
    values, first = np.unique(print_, return_index=True)
    order = np.argsort(_mixed(values), kind="stable")
    keep = (_mixed(values) >> np.uint64(20)) % np.uint64(s.thin) == 0
    keep[order[: s.least]] = True
    return values[keep], first[keep]


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits where b, moved by offset, lies over a, and the length of that part."""
    low, high = max(0, offset), min(len(a), len(b) + offset)
    if high <= low:
        return 1.0, 0
    return float(np.bitwise_count(a[low:high] ^ b[low - offset : high - offset]).sum() / (32 * (high - low))), high - low


def matches(a: np.ndarray, b: np.ndarray, offset: int, s: Settings) -> float | None:
    errors, length = bit_errors(a, b, offset)
    if errors == 0 and length == len(a) == len(b):
        return errors
    return errors if length >= max(s.shortest, s.overlap * min(len(a), len(b))) and errors <= s.bit_errors else None


def admitted(a: np.ndarray, a_low, a_high, b: np.ndarray, b_low, b_high, offset: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """`matches` of many pairs of parts of a and b, given by their ends: which of them match, and their errors."""
    n_a, n_b = a_high - a_low, b_high - b_low
    low = np.maximum(0, offset)
    length = np.minimum(n_a, n_b + offset) - low
    long = length >= np.maximum(s.shortest, s.overlap * np.minimum(n_a, n_b))
    equal = (length == n_a) & (length == n_b)
    which = np.flatnonzero(long | equal)
    rates = np.empty(len(which))
    n, from_a = length[which], (a_low + low)[which].tolist()
    from_b = (b_low + low - offset)[which].tolist()
    cut = [0, *(np.flatnonzero(np.diff(np.cumsum(n) >> 17)) + 1).tolist(), len(which)]  # as much as a core's cache holds
    for i, j in zip(cut, cut[1:]) if len(which) else []:
        sizes = n[i:j].tolist()
        of_a = np.concatenate([a[x : x + size] for x, size in zip(from_a[i:j], sizes)])
        of_b = np.concatenate([b[x : x + size] for x, size in zip(from_b[i:j], sizes)])
        start = np.cumsum(n[i:j]) - n[i:j]
        rates[i:j] = np.add.reduceat(np.bitwise_count(of_a ^ of_b), start, dtype=np.int64) / (32 * n[i:j])
    good = (rates <= s.bit_errors) & long[which] | (rates == 0) & equal[which]
    return which[good], rates[good]


def _batches(batches, column: str, decoder: Callable, s: Settings):
    play = decoder()
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            yield part, fingerprints([play(x) for x in part.column(column).to_pylist()], s)


def _digest(print_: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(print_.tobytes())


def classes(recordings: DataFrame, column: str, decoder: Callable[[], Callable], s: Settings = Settings()) -> DataFrame:
    """doc_id and class (the digest of its integers, in hex) of each row of recordings that has an id and sound."""

    def run(batches):
        for part, prints in _batches(batches, column, decoder, s):
            rows = [(i, _digest(p).hex()) for i, p in zip(part.column("doc_id").to_pylist(), prints) if len(p) and i is not None]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.string())], names=["doc_id", "class"])

    return recordings.select(F.col("doc_id").cast("long"), column).mapInArrow(lean(run), "doc_id long, class string")


def search(queries: DataFrame, recordings: DataFrame, column: str, decoder: Callable[[], Callable], s: Settings = Settings()) -> DataFrame:
    """For each row of queries: doc_id, n_prints, n_links, best_doc_id, best_offset (frames), best_errors, class, links.

    queries and recordings have doc_id (long) and the column with sound; decoder makes, in a task, the function from a
    value to samples. n_links counts the rows of recordings with another id that match; the best is the one with
    the least bit errors, then the least id (null if there is none). links has every class of recordings that matches,
    in order (class, offset, errors), the query's own class among them if a recording bears it; with `classes` it gives
    all partners. Rows without sound match nothing. Equal sound is searched once; repeated rows keep their rows. Extra
    columns are ignored.
    """
    spark = queries.sparkSession

    def sketch(batches):
        for part, prints in _batches(batches, column, decoder, s):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([*map(_digest, prints)], pa.binary()), pa.array([*map(len, prints)], pa.int64()), pa.array([p.tobytes() for p in prints], pa.binary())], names=["doc_id", "digest", "n_prints", "prints"])

    asked = materialise(queries.select(F.col("doc_id").cast("long"), column).mapInArrow(lean(sketch), "doc_id long, digest binary, n_prints long, prints binary"), "queries")
    distinct = asked.where("n_prints > 0").groupBy("digest").agg(F.first("prints").alias("prints"), F.first("n_prints").alias("n"), F.collect_set("doc_id").alias("ids"))
    distinct = materialise(distinct, "prints")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    count, folder = int(total // s.block) + 1, shared_folder(spark, "blocks")

    def write(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        prints = [np.frombuffer(x, np.uint32) for x in group.column("prints").to_pylist()]
        marks = [landmarks(p, s) for p in prints]
        values, places = np.concatenate([v for v, _ in marks]), np.concatenate([p for _, p in marks])
        owner = np.repeat(np.arange(len(prints)), [len(v) for v, _ in marks])
        order = np.argsort(values, kind="stable")
        ends = np.cumsum([0, *map(len, prints)])
        names = np.frombuffer(b"".join(group.column("digest").to_pylist()), np.uint8)
        ids = group.column("ids").to_pylist()
        askers, id_ends = np.array([i for x in ids for i in x], "<i8"), np.cumsum([0, *map(len, ids)]).astype("<i8")
        save(folder, f"block-{block}", [values[order], places[order].astype("<i4"), owner[order].astype("<i4"), ends.astype("<i8"), np.concatenate(prints), names, np.array([len(v) for v, _ in marks], "<i4"), askers, id_ends])
        return pa.table([pa.array([block], pa.int32())], names=["block"])

    if total:
        distinct.withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(count)).cast("int")).groupBy("block").applyInArrow(write, "block int").collect()
    written = {r["block"] for r in distinct.select(F.pmod(F.xxhash64("digest"), F.lit(count)).cast("int").alias("block")).distinct().collect()}  # a row for each block

    kind = pa.list_(pa.struct([("errors", pa.float64()), ("doc_id", pa.int64()), ("offset", pa.int64())]))

    def passed_on(best: dict) -> pa.RecordBatch:
        names, rows = ["digest", "n", "own", "best", "links"], []
        for (block, q), (n, _, own, two, links) in best.items():
            digests = load(folder, f"block-{block}")[5]
            rows.append((bytes(digests[16 * q : 16 * q + 16]), n, own, [{"errors": e, "doc_id": d, "offset": o} for e, d, o in two], sorted(links)))
        kinds = [pa.binary(), pa.int64(), pa.list_(pa.int64()), kind, pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def compare(batches):
        best: dict[tuple[int, int], list] = {}  # of a query: rows that match, its ids, those of the rows among them, the best of two ids with their places, classes
        held = 0
        for part, prints in _batches(batches, column, decoder, s):
            alike: dict[bytes, list[int]] = {}
            ids = part.column("doc_id").to_pylist()
            for i, p in enumerate(prints):
                if len(p) and ids[i] is not None:
                    alike.setdefault(p.tobytes(), []).append(i)
            rows = [r for r in alike.values()]
            labels = [_digest(prints[r[0]]).hex() for r in rows]
            least = [sorted({ids[i] for i in r})[:2] for r in rows]
            marks = [landmarks(prints[r[0]], s) for r in rows]
            if not rows:
                continue
            values, places = np.concatenate([v for v, _ in marks]), np.concatenate([p for _, p in marks])
            owner = np.repeat(np.arange(len(rows)), [len(v) for v, _ in marks])
            flat = np.concatenate([prints[r[0]] for r in rows])
            begin = np.cumsum([0, *(len(prints[r[0]]) for r in rows)])
            for block in written:
                theirs, their_places, their_owner, ends, all_prints, _, _, askers, id_ends = load(folder, f"block-{block}")
                low, high = np.searchsorted(theirs, values, "left"), np.searchsorted(theirs, values, "right")
                # Some rows at a time, so that a common integer does not fill the memory.
                share = np.cumsum(np.bincount(owner, high - low, len(rows))).astype(np.int64) // s.pairs
                cut = np.searchsorted(owner, [0, *(np.flatnonzero(np.diff(share)) + 1), len(rows)])
                for x, y in zip(cut, cut[1:]):
                    n = high[x:y] - low[x:y]
                    mine = np.repeat(np.arange(x, y), n)
                    if not len(mine):
                        continue
                    other = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[x:y], n)
                    pair = owner[mine].astype(np.int64) * len(ends) + their_owner[other]
                    keys = np.unique((pair << 32) + their_places[other] - places[mine] + (1 << 31))
                    found_r, found_q = np.divmod(keys >> 32, len(ends))
                    offset = (keys & ((1 << 32) - 1)) - (1 << 31)
                    which, rates = admitted(all_prints, ends[found_q], ends[found_q + 1], flat, begin[found_r], begin[found_r + 1], offset, s)
                    found_r, found_q, offset = found_r[which], found_q[which], offset[which]
                    order = np.lexsort((offset, np.abs(offset), rates, found_q, found_r))
                    found_r, found_q, offset, rates = found_r[order], found_q[order], offset[order], rates[order]
                    first = np.ones(len(order), bool)
                    first[1:] = (found_r[1:] != found_r[:-1]) | (found_q[1:] != found_q[:-1])
                    for r, q, moved, errors in zip(found_r[first].tolist(), found_q[first].tolist(), offset[first].tolist(), rates[first].tolist()):
                        if (block, q) not in best:
                            best[block, q] = [0, {*askers[id_ends[q] : id_ends[q + 1]].tolist()}, [], [], set()]
                        kept = best[block, q]
                        kept[0] += len(rows[r])
                        kept[2] += [ids[i] for i in rows[r] if ids[i] in kept[1]]
                        two = {}
                        for e, d, o in sorted([*kept[3], *((errors, d, moved) for d in least[r])]):
                            two.setdefault(d, (e, d, o))
                        kept[3] = [*two.values()][:2]
                        kept[4].add(f"{labels[r]} {moved} {errors!r}")
                        held += 1
            if held >= s.held:
                yield passed_on(best)
                best, held = {}, 0
        yield passed_on(best)

    found = recordings.select(F.col("doc_id").cast("long"), column).mapInArrow(lean(compare), "digest binary, n long, own array<long>, best array<struct<errors:double,doc_id:long,offset:long>>, links array<string>")
    found = materialise(found, "found", scan=True)
    own = found.select("digest", F.explode("own").alias("doc_id")).groupBy("digest", "doc_id").agg(F.count("*").alias("n_own"))
    links = F.array_distinct(F.flatten(F.collect_list("links")))
    found = found.groupBy("digest").agg(F.sum("n").alias("n"), F.array_sort(F.flatten(F.collect_list("best"))).alias("best"), links.alias("links"))  # two for each task
    rows = asked.join(found, "digest", "left").join(own, ["digest", "doc_id"], "left")
    others = F.filter("best", lambda x: ~x["doc_id"].eqNullSafe(F.col("doc_id")))
    rows = rows.withColumn("other", F.try_element_at(others, F.lit(1)))
    split = lambda x, i: F.split_part(x, F.lit(" "), F.lit(i))
    links = F.array_sort(F.transform("links", lambda x: F.struct(split(x, 1).alias("class"), split(x, 2).cast("long").alias("offset"), split(x, 3).cast("double").alias("errors"))))
    none = F.array().cast("array<struct<class:string,offset:long,errors:double>>")
    return rows.select(
        "doc_id", "n_prints", F.coalesce(F.col("n") - F.coalesce("n_own", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.col("other.doc_id").alias("best_doc_id"), F.col("other.offset").alias("best_offset"), F.col("other.errors").alias("best_errors"),
        F.when(F.col("n_prints") > 0, F.lower(F.hex("digest"))).alias("class"), F.coalesce(links, none).alias("links"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Every document played; those whose id is divisible by 20 are searched among all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs.where("doc_id % 20 = 0"), docs, "text", Tones)


def query_classes(spark, sf_dir: str) -> DataFrame:
    """The class of every document, to which `links` of the search refer."""
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", Tones)
