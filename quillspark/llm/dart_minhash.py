"""Near-duplicate classes by DartMinHash signatures, banded candidates and exact verification.

A document is the weighted set of its five-word shingles (weight: how often the shingle occurs). Hashed
darts are thrown into the region below each element's weight; the earliest dart of each coordinate makes
the signature, so two documents agree on a coordinate with the probability of their weighted Jaccard
similarity. Documents that share a band of coordinates are candidates.

Candidates are never expanded into all pairs. Texts with equal word sequences fall into one class first.
Within a bucket each member is compared, exactly, with one pivot at a time; what is already connected is
not compared again, and since 1 - J is a metric, distances to the first pivot rule out further pairs. Members
of buckets that are still not connected after `Settings.pivots` further pivots go through an exact prefix-filter
join, so no link is lost to the pivots.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, release, runtime_filters, table

WORD = re.compile(r"\w+")
U = np.uint64
BEFORE = 64  # shingles before one, that tell whether a pair has been met already


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    bands: int = 16
    rows: int = 4
    pivots: int = 1

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Shingles of whole texts; word hashes are remembered up to a fixed number of words."""

    def __init__(self, words: int, remembered: int = 100_000):
        self.words, self.remembered, self.known = words, remembered, {}

    def word_hashes(self, text: str) -> np.ndarray:
        known, found = self.known, WORD.findall(text.lower())
        if len(known) > self.remembered:
            known.clear()
        try:
            return np.array([known[w] for w in found], U)
        except KeyError:
            for w in found:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([known[w] for w in found], U)

    def elements(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles and their weights; a text of fewer words is one shingle of all of them."""
        n = min(self.words, len(hashes))
        if not n:
            return np.empty(0, U), np.empty(0)
        value = np.full(len(hashes) - n + 1, n, U)
        for i in range(n):
            value = mix(value * U(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - n + 1 + i])
        keys, counts = np.unique(value, return_counts=True)
        return keys, counts.astype(float)


    def many(self, hashes: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """`elements` of many texts at once."""
        n, out = self.words, [self.elements(h) if len(h) < self.words else None for h in hashes]
        long = [i for i, x in enumerate(out) if x is None]
        if not long:
            return out
        flat, sizes = np.concatenate([hashes[i] for i in long]), np.array([len(hashes[i]) for i in long])
        value = np.full(len(flat) - n + 1, n, U)
        for i in range(n):
            value = mix(value * U(0x9E3779B97F4A7C15) + flat[i : len(flat) - n + 1 + i])
        owner, last = np.repeat(np.arange(len(long)), sizes), np.repeat(np.cumsum(sizes), sizes)
        whole = np.arange(len(value)) + n <= last[: len(value)]
        value, owner = value[whole], owner[: len(whole)][whole]
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))))
        counts = np.diff(np.append(first, len(value))).astype(float)
        cuts = np.searchsorted(owner[first], np.arange(len(long) + 1))
        for j, i in enumerate(long):
            out[i] = value[first[cuts[j] : cuts[j + 1]]], counts[cuts[j] : cuts[j + 1]]
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> U(11)).astype(float) + 1) * 2.0**-53


def darts(keys: np.ndarray, weights: np.ndarray, latest: float) -> tuple[np.ndarray, np.ndarray]:
    """Times and identities of the darts below the weights that land no later than `latest`.

    The weight axis is cut at 1, 2, 4, ...; in each strip of an element darts land as a Poisson process whose
    rate is the strip's height. Both depend on the element and the strip alone, so that documents share them;
    `latest` and the weights only choose among them.
    """
    times, names, low, strip = [], [], 0.0, 0
    while (over := weights > low).any():
        high = 1.0 if strip == 0 else low * 2
        k, w, clock, turn = keys[over], weights[over], np.zeros(int(over.sum())), 0
        height = high - low
        while len(k):
            block = int(min(64, max(1, latest * height)))
            name = mix(k[:, None] ^ mix(np.arange(turn, turn + block).astype(U) * U(256) + U(strip) + U(1)))
            when = np.cumsum(np.concatenate((clock[:, None], -np.log(_unit(name)) / height), axis=1), axis=1)[:, 1:]
            place = low + height * _unit(mix(name + U(0xA5A5)))
            hit = (when <= latest) & (place <= w[:, None])
            times.append(when[hit])
            names.append(name[hit])
            alive = when[:, -1] <= latest
            k, w, clock, turn = k[alive], w[alive], when[alive, -1], turn + block
        low, strip = high, strip + 1
    return np.concatenate(times), np.concatenate(names)


def signature(keys: np.ndarray, weights: np.ndarray, coordinates: int) -> np.ndarray:
    """For each coordinate the identity of the earliest dart dealt to it."""
    latest = coordinates * (np.log(coordinates) + 2) / weights.sum()
    while True:
        when, name = darts(keys, weights, latest)
        to = (mix(name ^ U(0x5BD1E995)) % U(coordinates)).astype(int)
        order = np.lexsort((name, when, to))
        first = order[np.unique(to[order], return_index=True)[1]]
        if len(first) == coordinates:
            return name[first]
        latest *= 2


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], coordinates: int, spread: int = 4) -> list[np.ndarray]:
    """`signature` of many sets at once. One dart at a time falls on every element of the sets that have enough of
    them; few elements get many darts, and sets that are left with an empty coordinate go alone."""
    out: list[np.ndarray | None] = [None] * len(sets)
    latest = np.array([coordinates * (np.log(coordinates) + 4) / max(w.sum(), 1e-9) for _, w in sets])
    many = [i for i, (k, _) in enumerate(sets) if len(k) and latest[i] <= spread]
    if many:
        sizes = [len(sets[i][0]) for i in many]
        keys, weights = np.concatenate([sets[i][0] for i in many]), np.concatenate([sets[i][1] for i in many])
        owner, until = np.repeat(np.arange(len(many)), sizes), np.repeat(latest[many], sizes)
        times, names, owners, low, strip = [], [], [], 0.0, 0
        while (over := weights > low).any():
            height = 1.0 if strip == 0 else low
            k, w, who, end, clock, turn = keys[over], weights[over], owner[over], until[over], np.zeros(int(over.sum())), 0
            while len(k):
                name = mix(k ^ mix(np.array([turn], U) * U(256) + U(strip) + U(1)))
                clock = clock + -np.log(_unit(name)) / height
                alive = clock <= end
                k, w, who, end, clock, name = k[alive], w[alive], who[alive], end[alive], clock[alive], name[alive]
                hit = low + height * _unit(mix(name + U(0xA5A5))) <= w
                times.append(clock[hit])
                names.append(name[hit])
                owners.append(who[hit])
                turn += 1
            low, strip = low + height, strip + 1
        when, name, who = np.concatenate(times), np.concatenate(names), np.concatenate(owners)
        place = who * coordinates + (mix(name ^ U(0x5BD1E995)) % U(coordinates)).astype(np.int64)
        order = np.lexsort((name, when, place))
        place, first = np.unique(place[order], return_index=True)
        found, full = name[order][first], np.bincount(place // coordinates, minlength=len(many))
        ends = np.cumsum(full)
        for j, i in enumerate(many):
            if full[j] == coordinates:
                out[i] = found[ends[j] - coordinates : ends[j]]
    return [x if x is not None else signature(*s, coordinates) if len(s[0]) else None for x, s in zip(out, sets)]


def band_keys(sig: np.ndarray, settings: Settings) -> np.ndarray:
    rows = sig.reshape(settings.bands, settings.rows)
    value = np.arange(settings.bands).astype(U)
    for i in range(settings.rows):
        value = mix(value * U(0x9E3779B97F4A7C15) + rows[:, i])
    return value.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity; two empty sets are alike."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][ia], b[1][ib]).sum()
    total = a[1].sum() + b[1].sum() - both
    return float(both / total) if total else 1.0


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null counts as empty) and digest (of the text): doc_id and digest name a row's content."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))


def sketch(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, digest, node (names the word sequence, or the text of one without words) and bands, for each row of `keyed`."""

    def run(batches):
        shingler = Shingler(settings.words)
        for batch in (b.slice(at, 128) for b in batches for at in range(0, b.num_rows, 128)):
            hashes = [shingler.word_hashes(t) for t in batch.column("text").to_pylist()]
            nodes = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else d for h, d in zip(hashes, batch.column("digest").to_pylist())]
            found = signatures(shingler.many(hashes), settings.coordinates)
            bands = [band_keys(x, settings).tolist() if x is not None else [] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "digest", "node", "bands"])

    return docs.mapInArrow(lean(run), "doc_id long, digest binary, node binary, bands array<long>")


def packed(texts: DataFrame) -> DataFrame:
    """texts (node, text) with each text compressed, as texts are shuffled several times before they are compared."""

    def run(batches):
        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([pack(x.encode("utf-8", "surrogatepass")) for x in batch.column("text").to_pylist()], pa.binary())], names=["node", "text"])

    return texts.select("node", "text").mapInArrow(lean(run), "node long, text binary")


def unpacked(text: bytes) -> str:
    return zstandard.decompress(text).decode("utf-8", "surrogatepass")


def distances(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """pairs (a, b) with distance = 1 - J of their texts; texts is `packed`."""
    sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        shingler, last = Shingler(settings.words), (None, None)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, found = batch.slice(at, 64), []
                for x, b, y in zip(*(part.column(c).to_pylist() for c in ("text_a", "b", "text_b"))):
                    if last[0] != b:
                        last = b, shingler.elements(shingler.word_hashes(unpacked(y)))
                    found.append(1 - similarity(shingler.elements(shingler.word_hashes(unpacked(x))), last[1]))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(found, pa.float64())], names=["a", "b", "distance"])

    return sides.mapInArrow(lean(run), "a long, b long, distance double")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the least node of its connected component. edges has a and b.

    Large-star and small-star steps in turn (Kiveris et al. 2014) until no edge changes; each round is written.
    Star centres send one row to each neighbour, so a hot component never meets in one task as a list.
    """
    edges = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    print_ = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    was = print_(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        floor = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(floor, "a")
        after = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(floor.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = materialise(after, "edges")
        release(edges)
        edges, before, was = after, was, print_(after)
        if was == before:
            break
    return nodes.join(edges.withColumnsRenamed({"a": "node", "b": "m"}), "node", "left").select("node", F.coalesce("m", "node").alias("label"))


def linked(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, digest and label for each row of `keyed`: rows have a common label if and only if they are of one class.

    A node stands for all rows of equal word sequence, whatever their ids, so copies are never compared. Labels are
    numbers that only tell classes apart.
    """
    found = materialise(sketch(docs, settings), "sketch", scan=True)
    # Numbers in the order of the least id, as the earliest text is most often the one that others were made from.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "digest")).alias("r")
    nodes = found.groupBy("node").agg(least, F.first("bands").alias("bands")).select(F.col("node").alias("name"), "r.*", "bands")
    nodes = nodes.repartitionByRange("none", "id", "name").sortWithinPartitions("none", "id", "name").withColumn("node", F.monotonically_increasing_id())
    nodes = materialise(nodes, "nodes")
    banded = nodes.where(F.size("bands") > 0).select("node", F.explode("bands").alias("bucket")).repartition("bucket")  # one shuffle for what follows
    shared = banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("bucket", "pivot")
    buckets = materialise(banded.join(shared, "bucket"), "buckets")
    involved = buckets.select("node").distinct()
    first = materialise(nodes.join(involved, "node").select("node", "none", "id", "digest"), "first")
    texts = docs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "digest", "text").join(first.where("node >= 0"), ["id", "none", "digest"])  # all; Spark makes filters of sides with a condition
    with runtime_filters(docs.sparkSession):
        texts = materialise(packed(texts).groupBy("node").agg(F.min("text").alias("text")), "texts")
    release(first)
    limit = 1 - settings.similarity + 1e-9

    pairs = buckets.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    known = materialise(distances(pairs, texts, settings), "distances")
    labels = materialise(components(involved, known.where(F.col("distance") <= limit)), "labels")
    for turn in range(settings.pivots + 1):
        placed = _spread(buckets, labels)
        if placed.isEmpty():
            release(placed)
            break
        last = turn == settings.pivots
        pairs = _new(_exact_pairs(placed.select("node", "label").distinct(), texts, settings), known) if last else _pivot_pairs(placed, known, limit)
        more = materialise(known.union(distances(pairs, texts, settings)), "distances")
        release(placed, labels, known)
        known = more
        labels = materialise(components(involved, known.where(F.col("distance") <= limit)), "labels")
    labelled = nodes.select("name", "node").join(labels, "node", "left").select(F.col("name").alias("node"), F.coalesce("label", "node").alias("label"))
    labelled = materialise(labelled, "labelled")
    release(nodes, buckets, texts, known, labels)
    return found.select("doc_id", "digest", "node").join(labelled, "node").select("doc_id", "digest", "label")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, class_id (an id of its class), n_class (its rows), class_key (its name).

    Classes are the connected components of similarity >= settings.similarity between whole texts. Texts without
    a word (null, empty, punctuation) are alike only if they are equal, null counting as empty. Rows that share an id
    count each by its own text. class_id is the least id of the class; should two classes have that in common, the
    least that each has alone, if any; it is null only if all ids of the class are. class_key tells classes apart in
    every case. An empty table gives an empty result. Columns other than doc_id and text are ignored.
    """
    rows = materialise(linked(keyed(docs), settings), "linked")
    classes = materialise(rows.groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_class")), "classes")
    clash = materialise(classes.where("least IS NOT NULL").groupBy("least").agg(F.count("*").alias("n")).where("n > 1").select("least"), "clash")
    if not clash.isEmpty():
        ids = rows.join(classes.join(clash, "least", "left_semi").select("label"), "label", "left_semi").select("doc_id").distinct()
        alone = rows.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("h")).where("label = h")
        own = alone.groupBy("label").agg(F.min("doc_id").alias("own"))
        again = classes.join(clash.withColumn("twice", F.lit(True)), "least", "left").join(own, "label", "left")
        classes = materialise(again.select("label", F.when(F.col("twice"), F.coalesce("own", "least")).otherwise(F.col("least")).alias("least"), "n_class"), "classes")
    return rows.join(classes, "label").select("doc_id", F.col("least").alias("class_id"), "n_class", F.col("label").cast("string").alias("class_key"))


def _spread(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets, with labels, whose bucket holds more than one label."""
    placed = materialise(buckets.join(labels, "node"), "placed")
    mixed = materialise(placed.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("bucket"), "mixed")
    out = materialise(placed.join(mixed, "bucket"), "spread")
    release(placed, mixed)
    return out


def _pivot_pairs(placed: DataFrame, known: DataFrame, limit: float) -> DataFrame:
    """A next pivot of each bucket, among the members not connected to its first one, paired with the rest.

    Pairs that are connected or compared, or that the distances to the first pivot rule out, are left out.
    """
    near = known.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "distance")
    placed = placed.join(near, ["node", "pivot"], "left").select("bucket", "node", "label", "pivot", F.when(F.col("node") == F.col("pivot"), 0.0).otherwise(F.col("distance")).alias("d"))
    home = placed.where("node = pivot").select("bucket", F.col("label").alias("home"))
    away = placed.join(home, "bucket").where("label <> home").groupBy("bucket").agg(F.min_by(F.struct("node", "label", "d"), F.xxhash64("node", "bucket")).alias("x"))
    away = away.select("bucket", *(F.col(f"x.{c}").alias(f"{c}_x") for c in ("node", "label", "d")))
    pairs = placed.join(away, "bucket").where((F.col("label") != F.col("label_x")) & (F.abs(F.col("d") - F.col("d_x")) <= limit))
    return _new(pairs.select(F.greatest("node", "node_x").alias("a"), F.least("node", "node_x").alias("b")).distinct(), known)


def _new(pairs: DataFrame, known: DataFrame) -> DataFrame:
    done = known.select("a", "b").union(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(done, ["a", "b"], "left_anti")


def _exact_pairs(rest: DataFrame, texts: DataFrame, settings: Settings, slots: int = 1 << 18) -> DataFrame:
    """Every pair of rest (node, label) with different labels that can reach the similarity.

    Prefix filtering over shingles from rare to frequent (Chaudhuri et al. 2006): two texts of similarity t share
    one of the first shingles that make up 1 - t of either weight, and at the first such shingle what follows in
    both must still be able to hold the overlap. Frequencies are counted in `slots` hashed slots, whose size does
    not grow; any order is right, the counted one is selective.
    """
    rows = texts.join(rest, "node")
    share = settings.similarity

    def count(batches):
        shingler, total = Shingler(settings.words), np.zeros(slots, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total[(shingler.elements(shingler.word_hashes(unpacked(text)))[0] % U(slots)).astype(int)] += 1
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(total[where])], names=["slot", "n"])

    often = np.ones(slots, np.int64)
    for r in rows.select("text").mapInArrow(lean(count), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toLocalIterator():  # at most `slots` rows
        often[r["slot"]] = r["n"]

    names = ["shingle", "node", "label", "norm", "at", "turn"]

    def prefix(batches):
        shingler = Shingler(settings.words)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32())

        def passed_on(out):
            columns = [np.concatenate([o[0] for o in out]), *(np.concatenate([np.full(len(o[0]), o[i]) for o in out]) for i in (1, 2, 3)), np.concatenate([o[4] for o in out]), np.concatenate([np.arange(len(o[0])) for o in out])]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            out, held = [], 0
            for node, label, text in zip(*(batch.column(c).to_pylist() for c in ("node", "label", "text"))):
                keys, weights = shingler.elements(shingler.word_hashes(unpacked(text)))
                order = np.lexsort((keys, often[(keys % U(slots)).astype(int)]))
                at = np.concatenate(([0.0], np.cumsum(weights[order])))
                n = max(1, int(np.searchsorted(at[:-1], (1 - share) * at[-1] + 1e-6, "right")))
                out.append((keys[order[:n]].view(np.int64), node, label, at[-1], at[:n]))
                held += n
                if held > 20_000:
                    yield passed_on(out)
                    out, held = [], 0
            if out:
                yield passed_on(out)

    found = materialise(rows.select("node", "label", "text").mapInArrow(lean(prefix), "shingle long, node long, label long, norm double, at double, turn int"), "prefixes")
    met = found.groupBy("shingle").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("shingle")
    lists = found.join(met, "shingle").groupBy("node", "label", "norm").agg(F.sort_array(F.collect_list(F.struct("turn", "at", "shingle"))).alias("list"))  # no longer than one text's prefix
    lists = lists.select("node", "label", "norm", "list", F.transform("list", lambda x: F.hash(x["shingle"])).alias("all"), F.posexplode("list").alias("i", "x"))
    # A pair is named where none of the last common shingles stand; of longer texts it may be named again, never missed.
    before = F.slice("all", F.greatest(F.col("i") - BEFORE + 1, F.lit(1)), F.least(F.col("i"), F.lit(BEFORE)))
    lists = materialise(lists.select(F.col("x.shingle").alias("shingle"), "node", "label", "norm", (F.col("norm") - F.col("x.at")).alias("left"), before.alias("before")), "lists")
    other = lists.select("shingle", *(F.col(c).alias(f"{c}_y") for c in lists.columns[1:]))
    needed = (F.col("norm") + F.col("norm_y")) * share / (1 + share) - 1e-6
    reach = (F.col("label") != F.col("label_y")) & (F.col("node") > F.col("node_y")) & (F.least("left", "left_y") >= needed)
    return lists.join(other, "shingle").where(reach & ~F.arrays_overlap("before", "before_y")).select(F.col("node").alias("a"), F.col("node_y").alias("b")).distinct()


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays as it is: the one with the least id (null last), of those that with the least digest
    of its text. Of rows equal in id and text any one stays. Empty tables give an empty result; extra columns are kept."""
    rows = linked(keyed(docs))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("__none"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("digest").alias("__digest")))
    kept = materialise(rows.groupBy("label").agg(least.alias("r")).select("r.*"), "kept")
    names = ["__id", "__none", "__digest"]
    digest = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    marked = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__none"), digest.alias("__digest"))
    return marked.join(kept, names).dropDuplicates(names).select(*docs.columns)
