"""Boxes of words, lines and redactions on a page. A box is struct(x0, y0, x1, y1) of doubles."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import fixed_values as V
from quillspark.functions import scalars as X
from quillspark.functions import spans as S

LINE_METHODS = ["field_line", "signed_name_line"]


def layout(pages: DataFrame, pitch: int = 10, height: int = 20, wrap: int = 80) -> DataFrame:
    """Words of (page, text) at fixed pitch: page, word_no, text, x0, y0, x1, y1, confidence (a hash in [0.3, 1)).

    Texts are dealt by page before they become words, which take several times their room; no word is shuffled. The number of
    parts is given, as Spark would else make few of them for what the texts, not the words, take."""
    tokens = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = pages.select("page", "text").repartition(parts, "page").select("page", F.posexplode(tokens).alias("word_no", "text"))
    before = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("page").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    words = words.withColumn("at", before)
    row, column = F.floor(F.col("at") / wrap), F.col("at") % wrap
    box = [(column * pitch).alias("x0"), (row * 2 * height).alias("y0"), ((column + F.length("text")) * pitch).alias("x1"), (row * 2 * height + height).alias("y1")]
    return words.select("page", "word_no", "text", *(b.cast("double").alias(n) for b, n in zip(box, ("x0", "y0", "x1", "y1"))), (0.3 + F.pmod(F.xxhash64("page", "word_no"), F.lit(700)) / 1000).alias("confidence"))


def dedupe_boxes(rows: DataFrame, page: str, tie: str, same: float = 0.70) -> DataFrame:
    """Boxes (kind, box, confidence, method) without doubles: line methods first, then the surest; a box goes if its IoU
    with a kept one, or with one of its kind the share of the smaller, reaches the limit. Boxless rows stay."""
    order = F.struct((~F.col("method").isin(LINE_METHODS)).cast("int").alias("a"), (-F.col("confidence")).alias("b"), F.col(tie).alias("c"))
    lists = rows.where("box IS NOT NULL").groupBy(page).agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.struct(*rows.columns).alias("row")))).alias("all"))

    def clash(k: Column, x: Column) -> Column:
        return (X.iou(k["row"]["box"], x["row"]["box"]) >= same) | ((k["row"]["kind"] == x["row"]["kind"]) & (X.cover(k["row"]["box"], x["row"]["box"]) >= same))

    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: clash(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return lists.select(F.explode(kept).alias("k")).select("k.row.*").unionByName(rows.where("box IS NULL"))


def new_boxes(candidates: DataFrame, existing: DataFrame, page: str, tie: str, same: float = 0.80) -> DataFrame:
    """Candidates that double no active box of the page and no better candidate."""
    active = existing.where("status <> 'rejected'").select(page, F.col("box").alias("__box"))
    clashing = candidates.join(active, page).where(X.iou(F.col("box"), F.col("__box")) >= same).select(page, tie).distinct()
    return dedupe_boxes(candidates.join(clashing, [page, tie], "left_anti"), page, tie, same)


def fold_pages(words: DataFrame, page: str, columns: list[str], fold: Callable[..., Iterable[tuple]], schema: pa.Schema) -> DataFrame:
    """fold(page, y centres, *columns) of every page, with its words by y centre, then x.

    Pages go through a task one after the other in sorted rows, and only the page at hand is held: no group is made of each
    page, which would cost more than its few words. Words at the same place come in the order of word_no, if there is one.
    """
    yc = ((F.col("y0") + F.col("y1")) / 2).alias("__yc")
    order = [F.asc_nulls_last(c) for c in ("__yc", "x0", *(c for c in ("word_no", "text") if c in words.columns))]
    rows = words.select(F.col(page).cast("long").alias(page), yc, *dict.fromkeys([*columns, "x0", *(c for c in ("word_no", "text") if c in words.columns)]))
    dealt = rows.repartition(page).sortWithinPartitions(page, *order).select(page, "__yc", *columns)
    types = T.StructType([T.StructField(f.name, {pa.int64(): T.LongType(), pa.int32(): T.IntegerType(), pa.string(): T.StringType(), pa.float64(): T.DoubleType()}[f.type]) for f in schema])

    def run(batches):
        held: list[list] = []
        out: list[tuple] = []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            parts = [c.to_pylist() for c in batch.columns]
            keys, at = parts[0], 0
            for i in range(len(keys) + 1):
                if i == len(keys) or keys[i] != keys[at]:
                    part = [c[at:i] for c in parts]
                    if held and part[0] and held[0][0] == part[0][0]:
                        for have, more in zip(held, part):
                            have.extend(more)
                    elif part[0]:
                        if held:
                            out.extend(fold(held[0][0], *held[1:]))
                        held = part
                    at = i
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
        if held:
            out.extend(fold(held[0][0], *held[1:]))
        if out:
            yield batch_of(out)

    return dealt.mapInArrow(run, types)


def cluster_lines(words: DataFrame, page: str, share: float = 0.7) -> DataFrame:
    """Visual lines of each page: words by y centre, a new line when the gap to the line's running mean reaches a share
    of the (upper) median height. The running mean makes it a fold, done page by page."""

    def fold(key, centres, text, x0, y0, x1, y1):
        nan = float("nan")
        number = lambda values: [nan if v is None else v for v in values]
        x0, y0, x1, y1 = number(x0), number(y0), number(x1), number(y1)
        heights = sorted(b - a for a, b in zip(y0, y1))
        limit = share * (heights[len(heights) // 2] or 20)
        groups: list[list[int]] = []
        mean = 0.0
        for i, yc in enumerate(number(centres)):
            if not groups or abs(yc - mean) >= limit:
                groups.append([])
                mean = yc
            groups[-1].append(i)
            mean += (yc - mean) / len(groups[-1])
        out = []
        for g in groups:
            g.sort(key=x0.__getitem__)
            line = " ".join(text[i] or "" for i in g)
            edge = lambda f, values: f((values[i] for i in g if values[i] == values[i]), default=nan)  # noqa: E731, B023
            out.append((line, "".join(c for c in line.lower() if c.isalnum()), edge(min, x0), edge(min, y0), edge(max, x1), edge(max, y1)))
        out.sort(key=lambda r: r[3])
        return [(key, n, *r) for n, r in enumerate(out)]

    schema = pa.schema([(page, pa.int64()), ("line", pa.int32()), ("text", pa.string()), ("norm", pa.string()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1"))])
    return fold_pages(words, page, ["text", "x0", "y0", "x1", "y1"], fold, schema)


def word_spans(words: DataFrame, page: str, order: str = "word_no") -> DataFrame:
    """words with the offsets they have in the page's text, joined by single spaces."""
    w = Window.partitionBy(page).orderBy(order)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return words.withColumn("start", start).withColumn("end", start + F.length("text"))


def side(rows: DataFrame) -> DataFrame:
    """Rows of pages for a join by page, by sorting. Words and lines come of texts that come of few bytes read, so that Spark would
    take millions of them for a small table and send all to the driver, and from there to every task."""
    return rows.hint("merge")


def span_boxes(words: DataFrame, spans: DataFrame, page: str) -> DataFrame:
    """Boxes of spans (page, span_id, start, end): words that overlap them, cut in proportion, merged line by line.

    words has start and end (word_spans). A line's box holds words whose y ranges overlap by half the taller height.
    """
    hit = spans.select(page, "span_id", F.col("start").alias("s"), F.col("end").alias("e")).join(side(words), page).where("start < e AND end > s")
    size, width = F.col("end") - F.col("start"), F.col("x1") - F.col("x0")
    low, high = F.greatest(F.col("s") - F.col("start"), F.lit(0)) / size, F.least(F.col("e") - F.col("start"), size) / size
    cut = F.struct(F.col("y0"), (F.col("x0") + F.floor(low * width)).alias("x0"), (F.col("x0") + F.floor(high * width)).alias("x1"), F.col("y1"), F.col("confidence"))
    lists = hit.groupBy(page, "span_id").agg(F.sort_array(F.collect_list(cut)).alias("parts"))
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double,confidence:double>>"

    def step(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        shared = F.least(last["y1"], p["y1"]) - F.greatest(last["y0"], p["y0"])
        same = F.coalesce(shared / F.greatest(last["y1"] - last["y0"], p["y1"] - p["y0"]) > 0.5, F.lit(False))
        merged = F.struct(*(f(last[n], p[n]).cast("double").alias(n) for f, n in ((F.least, "x0"), (F.least, "y0"), (F.greatest, "x1"), (F.greatest, "y1"), (F.least, "confidence"))))
        fresh = F.struct(*(p[n].cast("double").alias(n) for n in ("x0", "y0", "x1", "y1", "confidence")))
        return F.when(same, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(acc, F.array(fresh)))

    return lists.select(page, "span_id", F.explode(F.aggregate("parts", F.array().cast(kind), step)).alias("box"))


def regions(words: DataFrame, page: str, margin: float = 0.15, width: float | None = None, height: float | None = None) -> DataFrame:
    """Header, footer, signature and body of each page, one box for each, by its words' centres.

    Header and footer are the outer shares of the text's extent; closing words in the lower right of the page (whose size
    is the text's, unless given) are the signature as well; the body is the rest.
    """
    w = Window.partitionBy(page)
    xc, yc = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    low, high = F.min(yc).over(w), F.max(yc).over(w)
    wide, tall = F.lit(width) if width else F.max("x1").over(w), F.lit(height) if height else F.max("y1").over(w)
    kind = F.when(yc < low + margin * (high - low), "header").when(yc > high - margin * (high - low), "footer").otherwise("body")
    closing = F.lower("text").rlike("|".join(V.CLOSING_WORDS)) & (xc > 0.5 * wide) & (yc > 0.75 * tall)
    rows = words.withColumn("kinds", F.array_compact(F.array(kind, F.when(closing, "signature")))).select("*", F.explode("kinds").alias("region"))
    rows = rows.groupBy(page, "region").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return rows.withColumn("confidence", F.when(F.col("region") == "header", 0.70).when(F.col("region") == "footer", 0.65).when(F.col("region") == "signature", 0.75).otherwise(0.80))


def first_fit_lines(words: DataFrame, page: str, share: float = 0.75, least: float = 8.0) -> DataFrame:
    """Words (page, word_no, text, x0, y0, x1, y1) with a group: by y centre, then x, each joins the first group whose mean
    centre is within the tolerance, else it opens one. The state makes it a fold, done page by page; as centres only grow,
    no group but the last can take another word."""

    def fold(key, centres, word_no, y0, y1):
        heights = [b - a for a, b in zip(y0, y1) if a is not None and b is not None]
        limit = max(share * sum(heights) / len(heights), least) if heights else least
        group, total, size = -1, 0.0, 0
        for yc, word in zip(centres, word_no):
            if size == 0 or yc is None or not abs(yc - total / size) <= limit:
                group, total, size = group + 1, 0.0, 0
            total += float("nan") if yc is None else yc
            size += 1
            yield key, word, group

    schema = pa.schema([(page, pa.int64()), ("word_no", pa.int32()), ("group", pa.int32())])
    return fold_pages(words, page, ["word_no", "y0", "y1"], fold, schema)


def line_of(text: Column, offset: Column) -> Column:
    """struct(index, start, value, ordinal, filled) of the line that an offset is in: the last that starts no later.
    ordinal counts the lines with text before it (null if it has none itself), filled all lines with text."""
    return S.let(S.lines(text), lambda all_: line_among(all_, offset))


def line_among(all_: Column, offset: Column) -> Column:
    """The same of a text's lines."""
    last = F.greatest(F.size(F.filter(all_, lambda x: x["start"] <= offset)), F.lit(1))
    line = F.element_at(all_, last)
    has = lambda x: S.bare(x["value"]) != ""
    before = F.size(F.filter(F.slice(all_, F.lit(1), last - 1), has))
    return F.struct((last - 1).alias("index"), line["start"].alias("start"), line["value"].alias("value"), F.when(has(line), before).alias("ordinal"), F.size(F.filter(all_, has)).alias("filled"))


def likeness(wanted: Column, norm: Column) -> Column:
    """How alike two compact forms are; containment counts as 0.8 at least, an empty line as nothing."""
    inside = (wanted != "") & (F.contains(norm, wanted) | F.contains(wanted, norm))
    ratio = X.similarity(wanted, norm)
    return F.when(norm == "", 0.0).when(inside, F.greatest(ratio, F.lit(0.8))).otherwise(ratio)


def map_values(values: DataFrame, texts: DataFrame, lines: DataFrame, page: str, width: float, height: float, pad: float = 6.0) -> DataFrame:
    """Boxes of values that were found in a page's transcription, on the page's visual lines.

    values: page, value_id, type, start, value; texts: page, text (the transcription); lines: as of cluster_lines. Each
    value takes a line by the first rule that holds: a signature, or one of the last three lines, the last line; one of
    the first eleven, the line of that place; a telling type, the most alike line of the page from 0.55 on; else the most
    alike of the lines around the place in proportion, from 0.45 on; else the line at that place, unsure; and where the
    line of the value has no place, the most alike line at all, unsure. Values whose place is known meet that one line only;
    others meet all lines of their page, but of no other.
    """
    known = texts.select(page, S.lines(F.col("text")).alias("__lines"))  # once for each text, not for each value
    place = values.where("start >= 0 AND value <> ''").join(side(known), page).withColumn("at", line_among(F.col("__lines"), F.col("start"))).where("at.ordinal IS NOT NULL").drop("__lines")
    ordered = lines.withColumn("n", F.row_number().over(Window.partitionBy(page).orderBy("y0", "line")) - 1).withColumn("m", F.count("*").over(Window.partitionBy(page)))
    pairs = place.join(side(ordered.select(page, "n", "m", "norm", F.struct("x0", "y0", "x1", "y1").alias("box"))), page)
    ordinal, filled, m = F.col("at.ordinal"), F.greatest(F.col("at.filled"), F.lit(1)), F.col("m")
    at_end = (F.col("type") == "signature") | (ordinal >= filled - 3)
    early = (ordinal <= 10) & (ordinal < m)
    expected = F.when(filled > 1, ordinal / (filled - 1) * (m - 1))
    pairs = pairs.withColumns({"at_end": at_end, "early": early, "expected": expected})
    settled = F.when(F.col("at_end"), m - 1).when(F.col("early"), ordinal)
    pairs = pairs.where(settled.isNull() | (F.col("n") == settled))
    pairs = pairs.withColumn("like", F.when(settled.isNotNull(), 0.0).otherwise(likeness(F.when(settled.isNull(), X.compact(F.col("value"))), F.col("norm"))))
    near = F.col("n").between(F.floor("expected") - 3, F.floor("expected") + 3)
    best = lambda ok: F.max_by(F.struct("box", "like"), F.when(ok & (F.col("like") > 0), F.struct("like", -F.col("n"))))
    at_line = lambda n: F.max(F.when(F.col("n") == n, F.struct("box")))["box"]
    kept = ["type", "value", "start", "at", "expected", "m"]
    rows = pairs.groupBy(page, "value_id").agg(
        *(F.first(c).alias(c) for c in [*kept, "at_end", "early"]),
        best(F.lit(True)).alias("any"), best(near).alias("band"), at_line(F.col("m") - 1).alias("last"), at_line(F.col("at.ordinal")).alias("direct"),
        at_line(F.least(F.col("m") - 1, F.greatest(F.lit(0), F.bround("expected").cast("int")))).alias("placed"),
    )
    choice = lambda box, part, sure, unsure=False: F.struct(box.alias("box"), F.lit(part).alias("part"), F.lit(sure).alias("confidence"), F.lit(unsure).alias("needs_review"))
    found = (
        F.when(F.col("at_end"), choice(F.col("last"), False, 0.70)).when(F.col("early"), choice(F.col("direct"), True, 0.80))
        .when(F.col("type").isin(V.DISTINCTIVE_TYPES) & (F.col("any.like") >= 0.55), choice(F.col("any.box"), False, 0.72))
        .when(F.col("expected").isNotNull() & (F.col("band.like") >= 0.45), choice(F.col("band.box"), True, 0.80))
        .when(F.col("expected").isNotNull(), choice(F.col("placed"), True, 0.40, True)).otherwise(choice(F.col("any.box"), False, 0.35, True))
    )
    rows = rows.withColumn("found", found).where("found.box IS NOT NULL")
    size, wide = F.length("at.value"), F.col("found.box.x1") - F.col("found.box.x0")
    low = F.greatest(F.lit(0.0), (F.col("start") - F.col("at.start")) / size)
    high = F.least(F.lit(1.0), (F.col("start") - F.col("at.start") + F.length("value")) / size)
    left = F.col("found.box.x0") + F.when(F.col("found.part"), low * wide).otherwise(0.0)
    right = F.when(F.col("found.part"), F.col("found.box.x0") + high * wide).otherwise(F.col("found.box.x1"))
    box = F.struct(F.greatest(F.lit(0.0), left - pad).alias("x0"), F.greatest(F.lit(0.0), F.col("found.box.y0") - pad).alias("y0"), F.least(F.lit(float(width)), right + pad).alias("x1"), F.least(F.lit(float(height)), F.col("found.box.y1") + pad).alias("y1"))
    rows = rows.withColumn("box", box).where("box.x1 - box.x0 >= 4 AND box.y1 - box.y0 >= 4")
    hidden = F.col("found.needs_review") & (X.area(F.col("box")) / (width * height) > V.UNSURE_AREA)
    rounded = F.struct(*(F.round(F.col("box")[c], 2).alias(c) for c in ("x0", "y0", "x1", "y1")))
    return rows.select(page, "value_id", "type", F.left("value", F.lit(255)).alias("value"), F.when(~hidden, rounded).alias("box"), F.col("found.confidence").alias("confidence"), F.lit("geometry").alias("method"), F.col("found.needs_review").alias("needs_review"))


def lines_after(lines: DataFrame, page: str, n: int = 3) -> DataFrame:
    """For each line that closes a letter, the texts of the next lines, at most n."""
    w = Window.partitionBy(page).orderBy("line")
    nexts = F.array_compact(F.array(*(F.lead("text", i).over(w) for i in range(1, n + 1))))
    return lines.withColumn("next", nexts).where(F.lower("text").rlike(V.SIGN_OFF.replace("^", r"^\s*"))).select(page, "line", "next")


def boxes_on_lines(lines: DataFrame, items: DataFrame, page: str, slack: float = 4.0) -> DataFrame:
    """Items (page, item_id, box) that lie within a line (page, line, box) but for a few pixels; both stay on their page."""
    pairs = lines.select(page, "line", F.col("box").alias("b")).join(side(items.select(page, "item_id", F.col("box").alias("i"))), page)
    inside = (F.col("i.x0") >= F.col("b.x0") - slack) & (F.col("i.y0") >= F.col("b.y0") - slack) & (F.col("i.x1") <= F.col("b.x1") + slack) & (F.col("i.y1") <= F.col("b.y1") + slack)
    return pairs.where(inside).select(page, "line", "item_id")


def corrections(edits: DataFrame) -> DataFrame:
    """For each type, the mean shift that reviewers make (type, action, before, after: boxes)."""
    rows = edits.where(F.col("action").isin("expand", "shrink", "move"))
    width = lambda b: F.col(f"{b}.x1") - F.col(f"{b}.x0")
    height = lambda b: F.col(f"{b}.y1") - F.col(f"{b}.y0")
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.avg(F.col("after.x0") - F.col("before.x0")).alias("dx"), F.avg(F.col("after.y0") - F.col("before.y0")).alias("dy"), F.avg(width("after") - width("before")).alias("dw"), F.avg(height("after") - height("before")).alias("dh"))


def shifts(edits: DataFrame, asked: DataFrame) -> DataFrame:
    """For each type and day of asked, n and the mean dx, dy, dw, dh of all corrections made on earlier days (0 without one).

    edits: type, day, action, before and after (boxes). Corrections are summed for each type and day before they are put in
    order, so the running sums go over days, not over corrections.
    """
    width, height = (lambda b: F.col(f"{b}.x1") - F.col(f"{b}.x0")), (lambda b: F.col(f"{b}.y1") - F.col(f"{b}.y0"))
    parts = {"dx": F.col("after.x0") - F.col("before.x0"), "dy": F.col("after.y0") - F.col("before.y0"), "dw": width("after") - width("before"), "dh": height("after") - height("before")}
    made = edits.where(F.col("action").isin("expand", "shrink", "move")).groupBy("type", "day").agg(F.count("*").alias("n"), *(F.sum(v).alias(k) for k, v in parts.items()))
    days = asked.groupBy("type", "day").agg(F.lit(0).cast("long").alias("n"), *(F.lit(0.0).alias(k) for k in parts))
    both = made.unionByName(days).groupBy("type", "day").agg(*(F.sum(c).alias(c) for c in ("n", *parts)))
    earlier = Window.partitionBy("type").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    return both.select("type", "day", n.alias("n"), *(F.when(n > 0, F.sum(k).over(earlier) / n).otherwise(0.0).alias(k) for k in parts))


def corrected(boxes: DataFrame, edits: DataFrame, width: float, height: float, most: float = 40.0, least: int = 1) -> DataFrame:
    """boxes (type, day, box) with box moved and sized by what reviewers had corrected in its type before its day, and corrections (n).

    No part of a shift goes beyond most pixels, and fewer than least corrections count as none. What leaves the page is cut;
    a box that would be too small, and one that is null or has a null type or day, stays as it is.
    """
    known = shifts(edits, boxes.select("type", "day")).where(F.col("n") >= least)
    clamp = lambda c: F.greatest(F.lit(-most), F.least(F.lit(most), F.coalesce(F.col(f"s.{c}"), F.lit(0.0))))
    joined = boxes.alias("b").join(known.alias("s"), (F.col("b.type") == F.col("s.type")) & (F.col("b.day") == F.col("s.day")), "left")
    b = F.col("b.box")
    moved = F.struct((b["x0"] + clamp("dx")).alias("x0"), (b["y0"] + clamp("dy")).alias("y0"), (b["x1"] + clamp("dx") + clamp("dw")).alias("x1"), (b["y1"] + clamp("dy") + clamp("dh")).alias("y1"))
    upright = (moved["x1"] > moved["x0"]) & (moved["y1"] > moved["y0"])
    box = F.when(F.col("s.n").isNotNull() & upright, F.coalesce(normal_box(moved, F.lit(width), F.lit(height)), b)).otherwise(b)
    return joined.select(*(F.col(f"b.{c}") if c != "box" else box.alias("box") for c in boxes.columns), F.coalesce(F.col("s.n"), F.lit(0)).alias("corrections"))


def normal_box(b: Column, width: Column, height: Column, least: float = 4.0) -> Column:
    """The box in order, on the page and rounded to hundredths; null if it is too small or not finite."""
    clamp = lambda v, most: F.round(F.greatest(F.lit(0.0), F.least(v, most)), 2)
    out = F.struct(
        clamp(F.least(b["x0"], b["x1"]), width).alias("x0"), clamp(F.least(b["y0"], b["y1"]), height).alias("y0"), clamp(F.greatest(b["x0"], b["x1"]), width).alias("x1"), clamp(F.greatest(b["y0"], b["y1"]), height).alias("y1")
    )
    finite = X.all_of(*(~F.isnan(b[n]) & (F.abs(b[n]) != float("inf")) for n in ("x0", "y0", "x1", "y1")))
    return F.when(finite & (out["x1"] - out["x0"] >= least) & (out["y1"] - out["y0"] >= least), out)


def padded(b: Column, width: Column, height: Column, pad: float = 6.0, least: float = 2.0) -> Column:
    """The box made larger on all sides, on the page; null if it is too small."""
    wide = F.struct((b["x0"] - pad).alias("x0"), (b["y0"] - pad).alias("y0"), (b["x1"] + pad).alias("x1"), (b["y1"] + pad).alias("y1"))
    return normal_box(wide, width, height, least)


def label_lines(lines: DataFrame, page: str, labels: dict[str, str]) -> DataFrame:
    """Values behind labels on visual lines (page, line, text, x0..y1): the line's box from where the label ends, in
    proportion to its characters. labels are patterns in order; the first that fits wins."""
    kind, size = F.lit(None).cast("string"), F.lit(0)
    for name, pattern in reversed(labels.items()):
        hit = F.regexp_substr("text", F.lit("(?i)" + pattern))
        kind, size = F.when(hit.isNotNull(), name).otherwise(kind), F.when(hit.isNotNull(), F.regexp_instr("text", F.lit("(?i)" + pattern)) - 1 + F.length(hit)).otherwise(size)
    rows = lines.withColumn("type", kind).withColumn("__at", size).where("type IS NOT NULL")
    value = F.trim(F.substring(F.col("text"), F.col("__at") + 1, F.length("text")))
    rows = rows.withColumn("value", value).where((F.length("value") >= 2) & (~F.col("type").isin("phone", "council_ref") | F.col("value").rlike(r"\d")))
    share = F.col("__at") / F.length("text")
    return rows.select(page, "line", "type", "value", F.struct((F.col("x0") + share * (F.col("x1") - F.col("x0"))).alias("x0"), "y0", "x1", "y1").alias("box"), F.lit(0.95).alias("confidence"), F.lit("field_line").alias("method"))


def lines_for_values(values: DataFrame, lines: DataFrame, page: str, least: float = 0.45) -> DataFrame:
    """For each value (page, value_id, value), the page's line that is most like it and how much: containment counts as
    at least 0.8. A page's lines are few; pairs stay on their page."""
    pairs = values.join(side(lines.select(page, "line", "norm", F.struct("x0", "y0", "x1", "y1").alias("box"))), page)
    wanted = X.compact(F.col("value"))
    ratio = X.similarity(wanted, F.col("norm"))
    score = F.when((F.length(wanted) > 0) & (F.contains(F.col("norm"), wanted) | ((F.length("norm") > 3) & F.contains(wanted, F.col("norm")))), F.greatest(ratio, F.lit(0.8))).otherwise(ratio)
    best = pairs.withColumn("score", score).groupBy(page, "value_id").agg(F.max_by(F.struct("line", "box", "score"), F.struct("score", -F.col("line"))).alias("b"))
    return best.where(F.col("b.score") >= least).select(page, "value_id", "b.*", (F.col("b.score") < 0.55).alias("needs_review"))


def label_windows(words: DataFrame, values: DataFrame, page: str, longest: int = 18, least: float = 0.72) -> DataFrame:
    """For each value (page, value_id, value), the best run of at most `longest` words: 1 if equal in compact form, else by
    the share of the longer that their longest common part covers; with the run's box."""
    schema = f"{page} long, value_id long, first int, last int, score double, x0 double, y0 double, x1 double, y1 double"

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        left = left.sort_values("word_no")
        compact = ["".join(c for c in t.lower() if c.isascii() and c.isalnum()) for t in left.text]
        out = []
        for value_id, value in zip(right.value_id, right.value):
            wanted, best = "".join(c for c in (value or "").lower() if c.isascii() and c.isalnum()), None
            for i in range(len(compact)) if wanted else ():
                run = ""
                for j in range(i, min(i + longest, len(compact))):
                    run += compact[j]
                    if len(run) > 2 * len(wanted) + 8:
                        break
                    if not run:
                        continue
                    part = SequenceMatcher(None, wanted, run, autojunk=False).find_longest_match().size
                    score = 1.0 if run == wanted else part / max(len(run), len(wanted))
                    if best is None or score > best[0]:
                        best = (score, i, j)
            if best and best[0] >= least:
                part = left.iloc[best[1] : best[2] + 1]
                out.append((key[0], value_id, best[1], best[2], best[0], part.x0.min(), part.y0.min(), part.x1.max(), part.y1.max()))
        return pd.DataFrame(out, columns=[page, "value_id", "first", "last", "score", "x0", "y0", "x1", "y1"])

    return words.groupBy(page).cogroup(values.groupBy(page)).applyInPandas(search, schema)


def corner(ink: Column, blend: float = 0.04) -> Column:
    """The corner with the least ink, the first of equals, and whether a mark there must be blended in.

    ink is an array of shares for the corners in order of preference."""
    best = F.array_min(F.transform(ink, lambda v, i: F.struct(v.alias("ink"), i.alias("corner"))))
    return F.struct(best["corner"].alias("corner"), (best["ink"] > blend).alias("blended"))
