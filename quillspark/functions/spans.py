"""Column functions on texts and spans. Offsets count code points from 0; ends are exclusive.

A span is struct<type, start, end, value, confidence, method>. Every function is an expression of built-in
functions, so Catalyst sees plain columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.scalars import let

SPAN = "struct<type:string,start:int,end:int,value:string,confidence:double,method:string>"
SPANS = f"array<{SPAN}>"
FOUND = "array<struct<start:int,end:int,value:string>>"
#: A character that texts seldom hold.
MARK = "\x01"


def none(kind: str = SPANS) -> Column:
    return F.array().cast(kind)


def running(values: Column) -> Column:
    """Running sums of an array of int. Folding copies what it has gathered, so it goes over blocks of the square root of
    the size, then over their sums: n ** 1.5 copies, not n ** 2."""

    def fold(xs: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), none("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
        return F.aggregate(xs, first, step, lambda acc: acc["out"])

    def in_blocks(xs: Column) -> Column:
        block = F.ceil(F.sqrt(F.size(xs))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda i: fold(F.slice(xs, i * block + 1, block)))

        def joined(parts: Column) -> Column:
            ends = fold(F.transform(parts, lambda p: F.element_at(p, -1)))
            return F.flatten(F.zip_with(parts, ends, lambda p, end: F.transform(p, lambda x: x + end - F.element_at(p, -1))))

        return let(parts, joined)

    return let(values, lambda xs: F.when(F.size(xs) > 64, in_blocks(xs)).otherwise(fold(xs)))


def matches(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array of struct(start, end, value).

    With group 1 the value is that group, which must end the match. Patterns must not match the empty text.
    Gaps (split) and hits (extract) of one pattern interlock, so running lengths give the offsets; a text without a hit
    is looked through once. Splitting at a pattern compiles it for every text, replacing does not: hits become a mark, at
    which the text is split, unless the text holds the mark itself.
    """

    pattern = F.lit(pattern)

    def placed(hits: Column) -> Column:
        gaps = F.when(F.contains(text, F.lit(MARK)), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, pattern, F.lit(MARK)), MARK, -1))
        ends = running(F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.length(g) + F.length(h)))
        values = hits if group == 0 else F.regexp_extract_all(text, pattern, F.lit(group))
        return F.zip_with(ends, values, lambda end, v: F.struct((end - F.length(v)).alias("start"), end.alias("end"), v.alias("value")))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(none(FOUND)))


def span(kind: str | Column, found: Column, confidence: float, method: str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("type"), found["start"].alias("start"), found["end"].alias("end"), found["value"].alias("value"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))


def typed(kind: str, found: Column, confidence: float, method: str) -> Column:
    return F.transform(found, lambda x: span(kind, x, confidence, method))


def cut(text: Column, breaks: str) -> Column:
    """The text cut behind each match of breaks, the matches included (array of string); null for null. A mark is put behind
    each match and the text split there, as in `matches`."""
    at_breaks = F.zip_with(F.split(text, breaks, -1), F.regexp_extract_all(text, F.lit(breaks), F.lit(0)), lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit(""))))
    return F.when(F.contains(text, F.lit(MARK)), at_breaks).otherwise(F.split(F.regexp_replace(text, breaks, "$0" + MARK), MARK, -1))


def pieces(text: Column, breaks: str) -> Column:
    """The text cut behind each match of breaks: struct(start, end, value), the matches included. Values come with the cut:
    to take each out of the text by its place would read the text from its beginning for every piece."""

    def placed(values: Column) -> Column:
        ends = running(F.transform(values, F.length))
        return F.zip_with(ends, values, lambda end, v: F.struct((end - F.length(v)).alias("start"), end.alias("end"), v.alias("value")))

    return let(F.coalesce(cut(text, breaks), F.array(F.lit(None).cast("string"))), placed)


def trimmed(piece: Column) -> Column:
    """The piece without white space at its ends."""

    def of(left: Column) -> Column:
        start = piece["start"] + F.length(piece["value"]) - F.length(left)
        return let(F.regexp_replace(left, r"(?U)\s+$", ""), lambda value: F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value")))

    return let(F.regexp_replace(piece["value"], r"(?U)^\s+", ""), of)


def bare(value: Column) -> Column:
    """value without white space of any kind at its ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Lines without their break, at line feeds: struct(start, end, value)."""
    whole = pieces(text, "\n")
    line = lambda start, value: F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))
    return F.transform(whole, lambda p: let(F.regexp_replace(p["value"], "[\r\n]+$", ""), lambda value: line(p["start"], value)))


#: Behind white space that follows . ! or ?, and at line feeds.
SENTENCE_END = r"(?U)(?<=[.!?])\s+|\n"


def sentences(text: Column) -> Column:
    """Trimmed sentences: cut behind white space that follows . ! or ?, and at line feeds; empty ones left out."""
    return F.filter(F.transform(pieces(text, SENTENCE_END), trimmed), lambda s: F.length(s["value"]) > 0)


def sentence_count(text: Column) -> Column:
    """How many `sentences` a text has, without their places."""
    return F.size(F.filter(cut(text, SENTENCE_END), lambda x: x.rlike(r"(?U)\S")))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def add_free(kept: Column, candidates: Column) -> Column:
    """kept, and in their order the candidates that overlap nothing kept before them."""
    return F.aggregate(candidates, kept, lambda acc, x: F.when(F.exists(acc, lambda k: overlaps(k, x)), acc).otherwise(F.concat(acc, F.array(x))))


def by_start(spans: Column) -> Column:
    """Stable order by start."""
    numbered = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s.alias("span")))
    return F.transform(F.array_sort(numbered), lambda x: x["span"])


def by_confidence(spans: Column) -> Column:
    """Stable order by falling confidence."""
    numbered = F.transform(spans, lambda s, i: F.struct((-s["confidence"]).alias("c"), i.alias("i"), s.alias("span")))
    return F.transform(F.array_sort(numbered), lambda x: x["span"])


def redact(text: Column, spans: Column) -> Column:
    """text with each span, from the last to the first, replaced by [REDACTED-type]; spans outside what is left are skipped."""

    def splice(t: Column, s: Column) -> Column:
        inside = (s["start"] >= 0) & (s["end"] <= F.length(t)) & (s["start"] < s["end"])
        return F.when(inside, F.concat(F.substring(t, F.lit(1), s["start"]), F.lit("[REDACTED-"), s["type"], F.lit("]"), F.substring(t, s["end"] + 1, F.length(t)))).otherwise(t)

    return F.aggregate(F.reverse(by_start(spans)), text, splice)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def mask(kind: Column, value: Column) -> Column:
    """Partial masks: phone keeps four digits, e-mail two letters and the domain, address its number, a name its initial."""
    d, at = digits(value), F.split(value, "@")
    phone = F.when(F.length(d) >= 4, F.concat(F.lit("XXX-XXX-"), F.right(d, F.lit(4)))).otherwise("[REDACTED-phone]")
    local = F.when(F.length(at[0]) > 2, F.concat(F.left(at[0], F.lit(2)), F.lit("***@"), F.try_element_at(at, F.lit(2)))).otherwise(F.concat(F.lit("***@"), F.try_element_at(at, F.lit(2))))
    email = F.when(F.contains(value, F.lit("@")), local).otherwise("[REDACTED-email]")
    number = F.regexp_extract(F.trim(value), r"^(\d+\w*)\s+.+$", 1)
    address = F.when(number != "", F.concat(number, F.lit(" [REDACTED-address]"))).otherwise("[REDACTED-address]")
    words = F.split(F.regexp_replace(F.trim(value), r"\s+", " "), " ")
    name = F.when(F.size(words) >= 2, F.concat(F.upper(F.left(words[0], F.lit(1))), F.lit(". "), F.element_at(words, -1))).otherwise("[REDACTED-name]")
    return F.when(kind == "phone", phone).when(kind == "email", email).when(kind == "address", address).when(kind == "person_name", name).otherwise(F.concat(F.lit("[REDACTED-"), kind, F.lit("]")))
