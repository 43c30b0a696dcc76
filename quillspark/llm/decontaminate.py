"""Benchmark decontamination with a generalised suffix automaton over the items' words.

The automaton holds every run of consecutive words of the normalised test items. A document's words stream
through it once; after each word the state and the matched length say which item passages end there. Words in a
match of at least `Settings.window` words (or of a whole shorter item) are hit.

The benchmark comes in blocks of at most `Settings.block_words` words (or one longer item), each with an automaton of
its own and a pass of its own over the documents. Passes end before the next block is fetched: their hits go to the
shared folder, so that driver and tasks hold one block at a time, whatever the benchmark's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialise, table

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: ASCII letters to lower case, digits and bytes of other characters as they are, the rest to spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    window: int = 10
    block_words: int = 1_000_000
    #: A document with a larger share of hit words goes; in others the hit spans go.
    coverage: float = 0.5


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class SuffixAutomaton:
    """All runs of consecutive words of the items, each state with the items its shortest run occurs in."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.codes: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.short: dict[tuple[int, int], set[str]] = {}  # (state, words) of whole items below the window
        ends: list[tuple[int, str]] = []
        for name, item in items:
            at = 0
            for w in item:
                at = self._extend(at, self.codes.setdefault(w, len(self.codes)))
                ends.append((at, name))
        for name, item in items:  # only now, as later items may have split a state
            if 0 < len(item) < window:
                at = 0
                for w in item:
                    at = self.next[at][self.codes[w]]
                self.short.setdefault((at, len(item)), set()).add(name)
        owners: list[set[str]] = [set() for _ in self.next]
        for state, name in ends:
            owners[state].add(name)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                owners[self.link[state]] |= owners[state]
        #: For each state the items in which its last `window` words occur, and nothing for shorter ones.
        self.items: list[frozenset[str] | None] = [None] * len(self.next)
        alike: dict[frozenset[str], frozenset[str]] = {}
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[state] >= window:
                up = self.link[state]
                found = self.items[up] if self.length[up] >= window else frozenset(owners[state])
                self.items[state] = alike.setdefault(found, found)
        self.short_lengths = sorted({n for _, n in self.short})

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(after)
        return len(self.next) - 1

    def _extend(self, last: int, code: int) -> int:
        after, link, length = self.next, self.link, self.length
        if (q := after[last].get(code)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, code, q)
        new, p = self._state(length[last] + 1, 0, {}), last
        while p != -1 and code not in after[p]:
            after[p][code] = new
            p = link[p]
        if p != -1:
            q = after[p][code]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, code, q)
        return new

    def _split(self, p: int, code: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p != -1 and self.next[p].get(code) == q:
            self.next[p][code] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans of word positions (start, end), merged, and the items whose windows occur."""
        after, link, length, items, window = self.next, self.link, self.length, self.items, self.window
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        seen: set[int] = set()
        state = matched = 0

        def mark(start: int, end: int) -> None:
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, end))

        for i, code in enumerate(map(self.codes.get, text)):
            if code is None:
                state = matched = 0
                continue
            to = after[state].get(code)
            if to is None:
                while to is None and state:
                    state = link[state]
                    matched = length[state]
                    to = after[state].get(code)
                if to is None:
                    continue
            state = to
            matched += 1
            if matched >= window:
                mark(i + 1 - matched, i + 1)
                if state not in seen:
                    seen.add(state)
                    found |= items[state]
            if self.short_lengths:
                up, most = state, matched
                while up > 0:
                    for n in self.short_lengths:
                        if length[link[up]] < n <= most and (names := self.short.get((up, n))):
                            mark(i + 1 - n, i + 1)
                            found |= names
                    up = link[up]
                    most = length[up]
        return spans, found


def blocks(benchmark: DataFrame, settings: Settings) -> Iterator[list[tuple[str, str]]]:
    """The distinct items that have words, in id order, block by block."""
    out, size = [], 0
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text").distinct().orderBy("item", "text")
    for r in rows.toLocalIterator():
        n = len(words(r["text"]))
        if not n:
            continue
        if out and size + n > settings.block_words:
            yield out
            out, size = [], 0
        out.append((r["item"], r["text"]))
        size += n
    yield out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
KIND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs with n_words (long), spans (array of struct start, end in words, merged, in order) and items (array of
    the item ids as text, sorted) added; columns of docs under these names are replaced.

    Null and empty texts have no words. An item without words is ignored; items that share an id count as one;
    repeated rows are kept. An empty benchmark hits nothing. Texts of any length are taken whole.
    """
    kept = docs.drop("n_words", "spans", "items")
    each = blocks(benchmark, settings)
    result = _scan_block(kept, next(each), settings)
    hits = [materialise(_scan_block(kept.select("text"), block, settings).where(F.size("spans") > 0).select(_digest(), "spans", "items"), "hits", scan=True) for block in each]
    if not hits:
        return result
    more = reduce(DataFrame.union, hits).groupBy("__text").agg(F.flatten(F.collect_set("spans")).alias("__spans"), F.flatten(F.collect_set("items")).alias("__items"))  # no more sets than blocks
    return _merged(result.withColumn("__text", _digest()).join(more, "__text", "left").drop("__text"))


def _digest():
    """Names a text; what it holds depends on nothing else."""
    return F.md5(F.col("text").cast("binary")).alias("__text")


def _scan_block(docs: DataFrame, block: list[tuple[str, str]], settings: Settings) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, *FOUND])

    def run(batches):
        automaton = SuffixAutomaton([(name, words(text)) for name, text in block], settings.window)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, spans, items = [], [], []
                for text in part.column("text").to_pylist():
                    found = words(text)
                    hit, names = automaton.scan(found)
                    counts.append(len(found))
                    spans.append([{"start": a, "end": b} for a, b in hit])
                    items.append(sorted(names))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64()), pa.array(spans, KIND), pa.array(items, pa.list_(pa.string()))], names=schema.names)

    return docs.mapInArrow(lean(run), schema)


def _merged(rows: DataFrame) -> DataFrame:
    """Spans and items put together with those of __spans and __items."""
    names = [c for c in rows.columns if c not in ("spans", "items", "__spans", "__items")]
    schema = T.StructType([*(rows.schema[c] for c in names), *FOUND[1:]])

    def run(batches):
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in merge([(s["start"], s["end"]) for s in [*x, *(y or ())]])] for x, y in zip(batch.column("spans").to_pylist(), batch.column("__spans").to_pylist())]
            items = [sorted({*x, *(y or ())}) for x, y in zip(batch.column("items").to_pylist(), batch.column("__items").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(spans, KIND), pa.array(items, pa.list_(pa.string()))], names=schema.names)

    return rows.mapInArrow(lean(run), schema)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between them; one line break marks each gap."""
    raw = text.encode("utf-8", "surrogatepass")
    where = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : where[a][0]])
        at = where[b - 1][1]
    kept.append(raw[at:])
    return b"\n".join(x.strip() for x in kept if x.strip()).decode("utf-8", "surrogatepass")


def _without(rows: DataFrame) -> DataFrame:
    """rows with the spans cut out of text; n_chars, where it exists, follows the new text."""

    def run(batches):
        for batch in batches:
            texts = [cut(t, [(s["start"], s["end"]) for s in spans]) for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    out = rows.mapInArrow(lean(run), rows.schema)
    return out.withColumn("n_chars", F.length("text").cast(rows.schema["n_chars"].dataType)) if "n_chars" in rows.columns else out


def remove(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs without benchmark passages: hit spans are cut out, and a document whose hit share exceeds
    settings.coverage, or of which nothing is left, goes. Cutting is repeated until the joined rest has no hit.
    Documents without a hit keep their row as it is, null and empty texts and repeated rows among them; n_chars, where it
    exists, follows the new text. Of a table without rows nothing is left, and an empty benchmark leaves all."""
    found = scan(docs, benchmark, settings)
    clean = found.where(F.size("spans") == 0).select(*docs.columns)
    hit = materialise(found.where(F.size("spans") > 0), "hits", scan=True)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    hit = hit.where(covered <= F.col("n_words") * settings.coverage)
    out = clean
    while True:
        again = materialise(scan(_without(hit).select(*docs.columns), benchmark, settings), "cut")
        out = out.union(again.where((F.size("spans") == 0) & (F.col("n_words") > 0)).select(*docs.columns))
        hit = again.where(F.size("spans") > 0)
        if hit.isEmpty():
            return out


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`remove` with the table benchmark."""
    return remove(docs, table(spark, sf_dir, "benchmark"))
