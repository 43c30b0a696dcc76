"""Collocations: phrases of a few words that occur together more often than apart.

Texts become shards: about `Settings.shard_words` words of one language, as codes into the shard's own dictionary, with a
break (code 0) between pieces. Three steps over the shards, none of which needs a group of one phrase's occurrences:

1. Words are counted over all shards; those seen often enough are marked in a bitmap of fixed size.
2. Pairs of marked words are counted by hash, an upper bound of their true counts; a second bitmap marks hashes that reach
   the least count. The same goes for triples of two marked pairs. A phrase that occurs often enough has nothing but marked
   parts, so nothing is lost.
3. Each shard builds the generalised suffix automaton, of bounded depth, of its runs of marked pairs. Its states are the
   phrases with the same end positions, whose number counts each of them. Phrases travel by ranges of their hash, all of a
   range and shard in one row, and a task sums range after range: exact counts over all shards.

Scores and subsumption are joins among the counted phrases; a phrase's suffix link is the phrase without its first
word, and the link of the reversed text the one without its last.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, materialise, release, table

#: ASCII letters to lower case, what divides pieces to full stops, tabs to spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
SHARD = "lang string, words array<string>, counts array<int>, hashes binary, codes binary"


@dataclass(frozen=True)
class Settings:
    longest: int = 4  # words of a phrase
    least: int = 30  # occurrences
    scale: int = 2_000_000
    subsumed: int = 80  # per cent of a phrase's occurrences within one longer phrase
    top: int = 2000  # phrases of a language
    shard_words: int = 1 << 20
    bits: int = 26  # log2 of a bitmap's size, whatever the corpus
    range_keys: int = 1 << 22  # hashes that one task sums at once


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks(raw: bytes, most: int) -> Iterator[bytes]:
    """A folded text cut between pieces into parts of about `most` bytes."""
    at = 0
    while at < len(raw):
        end = raw.find(b".", at + most)
        end = len(raw) if end < 0 else end + 1
        yield raw[at:end]
        at = end


def encode(raws: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The dictionary (its first entry stands for breaks) and the codes of folded texts, with breaks between pieces."""
    codes = _Codes({b".": 0})
    words = b".".join(raws).replace(b".", b" . ").split()
    found = np.fromiter(map(codes.__getitem__, words), np.int32, len(words))
    return list(codes), found


def shards(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """lang, words, counts and codes of the shards of docs (text, lang)."""
    most = 6 * s.shard_words

    def shard(lang: str, raws: list[bytes]) -> pa.RecordBatch:
        words, codes = encode(raws)
        counts = np.bincount(codes, minlength=len(words))
        kind = pa.list_(pa.string()), pa.list_(pa.int32())
        hashes = word_hashes(lang, words[1:]).tobytes()
        columns = [pa.array([lang]), pa.array([words[1:]], kind[0]), pa.array([counts[1:].tolist()], kind[1]), *(pa.array([x], pa.binary()) for x in (hashes, codes.tobytes()))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "words", "counts", "hashes", "codes"])

    def run(batches):
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                for raw in blocks(text.encode("utf-8", "surrogatepass").translate(FOLD), most) if text else ():
                    held.setdefault(lang, []).append(raw)
                    size[lang] = size.get(lang, 0) + len(raw)
                    if size[lang] >= most:
                        yield shard(lang, held.pop(lang))
                        del size[lang]
        for lang, raws in held.items():
            yield shard(lang, raws)

    return docs.select(F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).mapInArrow(lean(run), SHARD)


# -- marks ---------------------------------------------------------------------------------------------------------


def bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """The bits named by the column slot, 64 to a row; at most 2^(bits - 6) rows reach the driver."""
    rows = slots.groupBy(F.shiftright("slot", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(max(1, 1 << bits >> 6), np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def marked(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) != 0


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = zlib.crc32(f"{lang} ".encode())
    return np.fromiter((zlib.crc32(w, seed) for w in words), np.uint32, len(words))


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit hashes of what left and right (64-bit) hash, in this order."""
    x = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + np.uint64(0x7F4A7C159E3779B9))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0x94D049BB133111EB)


class Marks:
    """What is known of frequent words, pairs and triples: bitmaps, as far as they are made."""

    def __init__(self, bits: int):
        self.bits, self.maps = bits, []

    @staticmethod
    def of(raw_hashes: bytes) -> np.ndarray:
        """Hashes by code."""
        return np.concatenate((np.zeros(1, np.uint64), np.frombuffer(raw_hashes, np.uint32).astype(np.uint64)))

    def pairs(self, raw_hashes: bytes, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places whose word and next one are marked, the hashes of the pairs, and of all words."""
        h = self.of(raw_hashes)
        good = marked(self.maps[0], h >> np.uint64(32 - self.bits))
        good[0] = False
        good, h = good[codes], h[codes]
        at = np.flatnonzero(good[:-1] & good[1:])
        return at, mixed(h[at], h[at + 1]), h

    def linked(self, raw_hashes: bytes, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of marked pairs, places of triples of two such, and the hashes of the triples."""
        at, pair, h = self.pairs(raw_hashes, codes)
        kept = marked(self.maps[1], pair >> np.uint64(64 - self.bits))
        at, pair = at[kept], pair[kept]
        next_too = np.flatnonzero(at[1:] == at[:-1] + 1)
        return at, at[next_too], mixed(pair[next_too], h[at[next_too] + 2])

    def triples(self, raw_hashes: bytes, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of marked pairs and of marked triples."""
        at, triple, hashes = self.linked(raw_hashes, codes)
        return at, triple[marked(self.maps[2], hashes >> np.uint64(64 - self.bits))]


def sum_hashes(scanned: DataFrame, hashes_of, ranges: int, s: Settings) -> DataFrame:
    """slot of every hash that reaches `least` over all shards. hashes_of takes a shard's hashes and codes.

    The hashes of a shard go out sorted, by ranges, as the byte planes of their differences: some three bytes for each. A
    task sums range after range. Counts above `least` add nothing and fit in a byte.
    """
    def deal(batches):
        for batch in batches:
            for raw, codes in zip(batch.column("hashes").to_pylist(), batch.column("codes").to_pylist()):
                keys, n = np.unique(hashes_of(raw, np.frombuffer(codes, np.int32)) >> np.uint64(32 - ranges), return_counts=True)
                own = (keys >> np.uint64(32)).astype(np.int32)
                cuts = np.searchsorted(own, np.arange((1 << ranges) + 1))
                low, n = keys.astype(np.uint32), np.minimum(n, min(s.least, 255)).astype(np.uint8)
                full = np.flatnonzero(np.diff(cuts))
                planes = [np.diff(low[a:b], prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() for a, b in zip(cuts[full], cuts[full + 1])]
                counts = [n[a:b].tobytes() for a, b in zip(cuts[full], cuts[full + 1])]
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(planes, pa.binary()), pa.array(counts, pa.binary())], names=["range", "planes", "counts"])

    def total(batches):
        now, keys, counts = None, [], []

        def done():
            low, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(inverse, np.concatenate(counts))
            whole = np.uint64(now) << np.uint64(32) | low[n >= s.least].astype(np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(np.unique(whole >> np.uint64(32 + ranges - s.bits)).astype(np.int64))], names=["slot"])

        for batch in batches:
            for at, planes, n in zip(*(batch.column(c).to_pylist() for c in ("range", "planes", "counts"))):
                if at != now and keys:
                    yield done()
                    keys, counts = [], []
                now = at
                keys.append(np.cumsum(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32))
                counts.append(np.frombuffer(n, np.uint8))
        if keys:
            yield done()

    dealt = scanned.select("hashes", "codes").mapInArrow(lean(deal), "range int, planes binary, counts binary")
    return dealt.repartition("range").sortWithinPartitions("range").mapInArrow(lean(total), "slot long")


# -- the automaton of a shard --------------------------------------------------------------------------------------


class Automaton:
    """The generalised suffix automaton, down to `depth`, of the runs that `linked` (places joined to the next) leaves. Of
    phrases of three words and more, those are left out that hold a triple not among `triples` (their first places).

    Level by level, each phrase of j words is known by its code, and a phrase and its longest proper suffix are one state
    if they have equally many end positions, as the phrase ends nowhere else. Arrays instead of nodes: `ends` holds one end
    position of each state's longest phrase, `longest` and `shortest` the words of its phrases, `counts` the end positions.
    """

    def __init__(self, codes: np.ndarray, linked: np.ndarray, depth: int, triples: np.ndarray | None = None):
        joined = np.zeros(len(codes), bool)
        joined[linked + 1] = True  # places that continue a run
        inside = joined.copy()
        inside[linked] = True
        at = np.flatnonzero(inside)
        grams = np.full(len(codes), -1, np.int64)
        used, grams[at], counts = np.unique(codes[at], return_inverse=True, return_counts=True)
        one, width = grams.copy(), len(used) + 1
        shortest, found, last = np.ones(len(counts), np.int64), [], None
        ends = at  # of phrases of this level
        for size in range(2, depth + 1):
            ends = ends[joined[ends]]
            ends = ends[grams[ends - 1] >= 0]
            if size == 3 and triples is not None:
                ends = ends[np.isin(ends, triples + 2, assume_unique=True)]
            if not len(ends):
                break
            keys, first, inverse, number = np.unique(grams[ends - 1] * width + one[ends], return_index=True, return_inverse=True, return_counts=True)
            link = grams[ends[first]]  # the phrase without its first word
            alike = number == counts[link]
            low = np.where(alike, shortest[link], size)
            if last is not None:
                last[0][link[alike]] = False  # part of a longer phrase's state
                found.append([x[last[0]] for x in last[1:]])
            last = [np.ones(len(keys), bool), ends[first], np.full(len(keys), size), np.maximum(low, 2), number]
            grams = np.full(len(codes), -1, np.int64)
            grams[ends] = inverse
            counts, shortest = number, low
        if last is not None:
            found.append([x[last[0]] for x in last[1:]])
        self.ends, self.longest, self.shortest, self.counts = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4

    def phrases(self, codes: np.ndarray, words: pa.Array, hashes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Every phrase of every state, its number of end positions and its hash, made of the words' hashes at all places."""
        text, counts, keys = [pa.array([], pa.string())], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for size in range(2, int(self.longest.max(initial=1)) + 1):
            held = (self.shortest <= size) & (size <= self.longest)
            first = self.ends[held] - size + 1
            text.append(pc.binary_join_element_wise(*(words.take(pa.array(codes[first + j] - 1)) for j in range(size)), " "))
            counts.append(self.counts[held])
            keys.append(reduce(mixed, (hashes[first + j] for j in range(size))))
        return pa.concat_arrays(text), np.concatenate(counts), np.concatenate(keys)


# -- the corpus ----------------------------------------------------------------------------------------------------


def count(docs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (lang, phrase, f), frequent phrases (lang, phrase, f) and all words of each language (lang, n)."""
    spark = docs.sparkSession
    dealt = materialise(shards(docs, s), "shards", scan=True, large=True)
    n = materialise(dealt.groupBy("lang").agg(F.sum(F.expr("aggregate(counts, 0L, (a, x) -> a + x)")).alias("n")), "words-of-languages")
    each = dealt.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("f"))
    words = materialise(each.where(F.col("f") >= s.least), "frequent-words")
    context, marks, known = spark.sparkContext, Marks(s.bits), []
    scanned = dealt.select("lang", "words", "hashes", "codes")
    ranges = max(8, (dealt.count() * s.shard_words // s.range_keys).bit_length())

    def learn(slots: DataFrame) -> None:
        marks.maps.append(bitmap(slots, s.bits))
        known.append(context.broadcast(marks))

    learn(words.select(F.shiftright(F.crc32(F.concat_ws(" ", "lang", "phrase").cast("binary")), 32 - s.bits).alias("slot")))
    by_words = known[-1]
    learn(sum_hashes(scanned, lambda raw, codes: by_words.value.pairs(raw, codes)[1], ranges, s))
    by_pairs = known[-1]
    learn(sum_hashes(scanned, lambda raw, codes: by_pairs.value.linked(raw, codes)[2], ranges, s))
    by_triples, depth = known[-1], s.longest

    def states(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                codes, raw = np.frombuffer(batch.column("codes")[i].as_py(), np.int32), batch.column("hashes")[i].as_py()
                linked, triples = by_triples.value.triples(raw, codes)
                text, n, keys = Automaton(codes, linked, depth, triples).phrases(codes, batch.column("words")[i].values, by_triples.value.of(raw)[codes])
                own = (keys >> np.uint64(64 - ranges)).astype(np.int32)
                order = np.argsort(own, kind="stable")
                own, n, text = own[order], n[order], text.take(pa.array(order))
                full, begins = np.unique(own, return_index=True)
                cuts = [*begins.tolist(), len(own)]
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), text)
                columns = [pa.array([batch.column("lang")[i].as_py()] * len(full), pa.string()), pa.array(full), pc.binary_join(lists, "\n"), pa.array([n[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "range", "phrases", "counts"])

    def summed(batches):
        now, text, counts = None, [], []

        def done():
            both = pa.table({"phrase": pa.concat_arrays(text), "f": np.concatenate(counts)}).group_by("phrase").aggregate([("f", "sum")])
            both = both.filter(pc.field("f_sum") >= least).combine_chunks()
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(both), pa.string()), *(pa.concat_arrays(both.column(c).chunks or [pa.array([], t)]) for c, t in (("phrase", pa.string()), ("f_sum", pa.int64())))], names=["lang", "phrase", "f"])

        for batch in batches:
            for i, key in enumerate(zip(batch.column("lang").to_pylist(), batch.column("range").to_pylist())):
                if key != now and text:
                    yield done()
                    text, counts = [], []
                now = key
                text.append(pc.split_pattern(batch.column("phrases").slice(i, 1), "\n").flatten())
                counts.append(np.frombuffer(batch.column("counts")[i].as_py(), np.int64))
        if text:
            yield done()

    least = s.least
    found = scanned.mapInArrow(lean(states), "lang string, range int, phrases string, counts binary").repartition("range").sortWithinPartitions("lang", "range")
    phrases = materialise(found.mapInArrow(lean(summed), "lang string, phrase string, f long"), "frequent-phrases")
    for sent in known:
        sent.unpersist()
    release(dealt)
    return words, phrases, n


def collocations(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases.

    A null text counts as empty and a null lang as `und`. Repeated rows count each time. Very long texts are divided
    between pieces. Ties are settled by a, then by the phrase's bytes. Other columns are not read; an empty table, and one
    without a frequent phrase, gives no row.
    """
    words, phrases, n = count(docs, s)
    known = words.unionByName(phrases)
    size = F.size(F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"), size.alias("size"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - size)").alias("rest"))
    side = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    scored = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    scored = scored.withColumn("score", F.expr(f"(cast({s.scale} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    shorter = F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))
    above = phrases.withColumn("size", size).where(F.col("size") > 2).select("lang", F.explode(shorter).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    own = lowest.join(above, ["lang", "phrase"], "left").where(F.col("within").isNull() | (100 * whole("within") < s.subsumed * whole("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
listed AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase FROM listed, range(1, 5) AS s(size) WHERE len(ws) >= size),
counted AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counted WHERE size > 1 AND f >= 30),
cuts AS (SELECT c.lang, c.phrase, c.a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:size], ' ') AS tail FROM cand c, range(1, 4) AS t(k) WHERE k < size),
scored AS (SELECT x.lang, x.phrase, x.a, x.k, p.f AS l, q.f AS r, (2000000::HUGEINT * x.a // (p.f::HUGEINT + q.f))::BIGINT AS score
  FROM cuts x JOIN counted p ON p.lang = x.lang AND p.phrase = x.head JOIN counted q ON q.lang = x.lang AND q.phrase = x.tail),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
inner_of AS (SELECT c.lang, array_to_string(c.ws[i:i + m - 1], ' ') AS phrase, max(c.a) AS longer FROM cand c, range(2, 4) AS t(m), range(1, 4) AS u(i) WHERE m < c.size AND i + m - 1 <= c.size GROUP BY ALL),
own AS (SELECT x.* FROM lowest x LEFT JOIN inner_of o USING (lang, phrase) WHERE nth = 1 AND (o.longer IS NULL OR 100::HUGEINT * o.longer < 80::HUGEINT * x.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM own)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
