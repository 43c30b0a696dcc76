"""Texts around detection: chunks, highlights, selections, model answers, comparison of two readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions import scalars as X
from quillspark.functions import spans as S


def chunks(text: Column, most: int = 400) -> Column:
    """Sentences packed greedily into chunks of at most `most` characters; a longer sentence stands alone."""
    parts = F.transform(S.sentences(text), lambda s: s["value"])

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = F.coalesce(F.length(last) + 1 + F.length(x) <= most, F.lit(False))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), x)))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def highlights(text: Column, word: str) -> Column:
    """All case-blind, non-overlapping occurrences of a word: struct(start, end, value)."""
    return S.matches(text, "(?iu)" + r"\Q" + word + r"\E")


def selection(text: Column, start: Column, end: Column) -> Column:
    """A selected span: offsets put in order, kept inside the text, white space at the ends left out."""
    low = F.greatest(F.least(start, end), F.lit(0))
    high = F.least(F.greatest(start, end), F.length(text))
    return S.trimmed(F.struct(low.alias("start"), high.alias("end"), F.substring(text, low + 1, high - low).alias("value")))


def found_selection(text: Column, wanted: Column) -> Column:
    """The first place of a text in another, without regard to case and to how white space is written; null if none."""
    words = F.filter(F.split(wanted, r"\s+"), lambda w: w != "")
    pattern = F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), r"\s+")
    at = F.regexp_instr(text, F.concat(F.lit("(?isu)"), pattern))
    value = F.regexp_substr(text, F.concat(F.lit("(?isu)"), pattern))
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(value)).alias("end"), value.alias("value")))


def repaired_json(answer: Column, schema: str, defaults: dict[str, Column]) -> Column:
    """The object in a model's answer: fences cut off, from the first brace to the last, missing fields filled."""
    bare = F.regexp_extract(F.regexp_replace(answer, r"(?s)```(?:json)?", ""), r"(?s)\{.*\}", 0)
    parsed = F.from_json(F.when(bare != "", bare), schema, {"mode": "PERMISSIVE"})
    return F.struct(*(F.coalesce(parsed[name], default).alias(name) for name, default in defaults.items()))


def field_label(line: Column) -> Column:
    """What stands before a colon, or one of the usual openings; null if there is neither."""
    opening = F.regexp_extract(line, r"(?i)^\s*(name|address|phone|email|dob|reference|signature)\b", 1)
    return F.when(F.contains(line, F.lit(":")), F.trim(F.substring_index(line, ":", 1))).otherwise(F.nullif(opening, F.lit("")))


def reading_warnings(ocr_text: Column, items: Column, critical: list[str]) -> Column:
    """For items that a second reading found (array of struct type, value, uncertain) and the first lacks, or that are
    critical or uncertain: struct(type, value, matched, severity)."""
    first = X.compact(ocr_text)
    rows = F.transform(items, lambda i: F.struct(i["type"].alias("type"), i["value"].alias("value"), F.contains(first, X.compact(i["value"])).alias("matched"), i["type"].isin(critical).alias("critical"), i["uncertain"].alias("uncertain")))
    kept = F.filter(rows, lambda r: ~r["matched"] | r["critical"] | r["uncertain"])
    return F.transform(kept, lambda r: F.struct(r["type"].alias("type"), r["value"].alias("value"), r["matched"].alias("matched"), F.when(r["critical"] & ~r["matched"], "high").when(~r["matched"], "medium").otherwise("low").alias("severity")))


def field_spans(text: Column, fields: Column, allowed: Column | None = None) -> Column:
    """Spans of transcribed fields (array of struct type, value): types put in house terms, first exact, else case-blind
    place; not tested for overlap."""
    names = F.create_map(*[F.lit(x) for pair in V.FIELD_TYPES.items() for x in pair])

    def place(f: Column) -> Column:
        value, kind = F.trim(f["value"]), F.lower(F.trim(f["type"]))
        at = F.when(F.position(value, text) > 0, F.position(value, text)).otherwise(F.position(F.lower(value), F.lower(text)))
        found = F.struct((at - 1).alias("start"), (at - 1 + F.length(value)).alias("end"), value.alias("value"))
        return S.span(F.coalesce(F.try_element_at(names, kind), kind), found, 0.78, "vlm_field")

    found = F.filter(F.transform(fields, place), lambda s: (s["start"] >= 0) & (F.length(s["value"]) >= 2))
    return found if allowed is None else F.filter(found, lambda s: F.array_contains(allowed, s["type"]))
