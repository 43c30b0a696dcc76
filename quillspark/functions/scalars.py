"""Scalar functions: normal forms, edit distances, hashes, identifiers, boxes."""

from __future__ import annotations

import difflib
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def loose(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(text), ",.", "  "), r"(?U)\s+", " "))


def distance(a: Sequence, b: Sequence) -> int:
    """Edit distance of two sequences: what they begin and end with alike goes, then a column of the table is a few operations
    on whole numbers of as many bits as the shorter one has items (Myers 1999)."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    begin, most = 0, len(b)
    while begin < most and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < most - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[begin : len(a) - end], b[begin : most - end]
    if not b:
        return len(a)
    where: dict = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    up, down, found = full, 0, len(b)
    for x in a:
        equal = where.get(x, 0)
        straight = ((equal & up) + up ^ up) | equal | down
        more, less = down | full & ~(straight | up), up & straight
        found += (more & top > 0) - (less & top > 0)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(straight | more)) & full, more & straight & full
    return found


@F.pandas_udf(T.LongType())
def _characters(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance(x, y) for x, y in zip(a, b)], dtype="int64")


@F.pandas_udf(T.LongType())
def _words(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of words between single spaces."""
    return pd.Series([distance(x.split(" ") if x else [], y.split(" ") if y else []) for x, y in zip(a, b)], dtype="int64")


def cer(truth: Column, prediction: Column) -> Column:
    """Character error rate; for an empty truth 0 or 1."""
    t, p = F.coalesce(truth, F.lit("")), F.coalesce(prediction, F.lit(""))
    return F.when(F.length(t) == 0, F.when(F.length(p) == 0, 0.0).otherwise(1.0)).otherwise(_characters(t, p) / F.length(t))


def wer(truth: Column, prediction: Column) -> Column:
    """Word error rate of the normal forms; for an empty truth 0 or 1."""
    words = lambda c: F.array_join(F.filter(F.split(normal(F.coalesce(c, F.lit(""))), " "), lambda w: w != ""), " ")
    t, p = words(truth), words(prediction)
    return F.when(t == "", F.when(p == "", 0.0).otherwise(1.0)).otherwise(_words(t, p) / F.size(F.split(t, " ")))


def token_recall(expected: Column, text: Column) -> Column:
    """struct(expected, found, missed, recall) of values, compared in normal form; recall is 1 if none is expected."""
    low = normal(F.coalesce(text, F.lit("")))
    found = F.filter(expected, lambda v: F.contains(low, normal(v)))
    return F.struct(F.size(expected).alias("expected"), F.size(found).alias("found"), F.array_except(expected, found).alias("missed"), F.when(F.size(expected) == 0, 1.0).otherwise(F.size(found) / F.size(expected)).alias("recall"))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 of a message under a constant key."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    inner, outer = bytes(b ^ 0x36 for b in key.ljust(64, b"\0")), bytes(b ^ 0x5C for b in key.ljust(64, b"\0"))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "utf-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def chain_hash(previous: Column, data: Column) -> Column:
    return F.sha2(F.concat(previous, F.lit(":"), data), 256)


def json_text(value: Column) -> Column:
    """A string as JSON in ASCII: quotes, backslashes and control characters escaped, all else beyond ASCII as \\u and hex."""

    def one(c: Column) -> Column:
        point = F.ascii(c)
        unit = lambda v: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(v)), 4, "0"))
        high, low = F.floor((point - 0x10000) / 0x400) + 0xD800, (point - 0x10000) % 0x400 + 0xDC00
        short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
        out = F.when(point > 0xFFFF, F.concat(unit(high.cast("int")), unit(low.cast("int")))).when((point > 126) | (point < 32), unit(point)).otherwise(c)
        for k, v in short.items():
            out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
        return out

    characters = F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))
    plain = value.rlike(r'^[ !#-\[\]-~]*$')
    return F.concat(F.lit('"'), F.when(plain, value).otherwise(F.array_join(F.transform(characters, one), "")), F.lit('"'))


def canonical_json(fields: dict[str, Column]) -> Column:
    """An object with sorted keys, ", " and ": " between; values are JSON already (`json_text` for strings), null is null."""
    parts = [F.concat(F.lit(f'"{name}": '), F.coalesce(fields[name].cast("string"), F.lit("null"))) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def content_hash(content: Column) -> Column:
    """SHA-256 in hex of a file's bytes."""
    return F.sha2(content, 256)


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def base32(data: Column) -> Column:
    """RFC 4648 base 32 of binary data, without padding."""
    code = F.hex(data)
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.length(data) - 1) / 5).cast("int")), lambda i: _eight(F.substring(code, i * 10 + 1, F.lit(10))))
    return F.when(F.length(data) > 0, F.left(F.array_join(groups, ""), F.ceil(F.length(data) * 8 / 5).cast("int"))).otherwise("")


def _eight(code: Column) -> Column:
    """Eight letters of up to ten hexadecimal digits: five bits are a digit to base 32, for which other letters stand."""
    return F.translate(F.lpad(F.conv(F.rpad(code, 10, "0"), 16, 32), 8, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_head(digest: Column, letters: int) -> Column:
    """The first letters of the base 32 of a digest in hexadecimal digits, of which there are enough."""
    return F.left(F.concat(*(_eight(F.substring(digest, i * 10 + 1, 10)) for i in range(-(-letters // 8)))), F.lit(letters))


def export_id(prefix: str, document_id: Column, created: Column, key: bytes) -> Column:
    """prefix-short-token-check: base 32 of digests, and four letters of an HMAC over what stands before."""
    short, token = F.sha2(document_id.cast("string"), 256), F.sha2(F.concat_ws(":", document_id.cast("string"), created.cast("string")), 256)
    body = F.concat(F.lit(prefix + "-"), base32_head(short, 6), F.lit("-"), base32_head(token, 10))
    return let(body, lambda b: F.concat(b, F.lit("-"), base32_head(hmac_sha256(b, key), 4)))


def export_id_status(value: Column, prefix: str, key: bytes) -> Column:
    """ours, foreign (another prefix) or invalid (shape or check)."""
    parts = F.split(value, "-")
    body = F.array_join(F.slice(parts, 1, 3), "-")
    good = (F.size(parts) == 4) & value.rlike(r"^[A-Z0-9]+-[A-Z2-7]{6}-[A-Z2-7]{10}-[A-Z2-7]{4}$")
    check = base32_head(hmac_sha256(body, key), 4) == F.try_element_at(parts, F.lit(4))
    return F.when(~good, "invalid").when(parts[0] != prefix, "foreign").when(check, "ours").otherwise("invalid")


def type_slug(label: Column) -> Column:
    slug = F.left(F.btrim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[^a-z0-9_]+", "_"), F.lit("_")), F.lit(40))
    return F.when(slug == "", "manual").otherwise(slug)


def safe_filename(name: Column) -> Column:
    return F.left(F.btrim(F.regexp_replace(name, r"[^A-Za-z0-9._ -]+", "_"), F.lit("._ ")), F.lit(120))


def sniffed(content: Column) -> Column:
    """File kind by its first bytes; null if unknown."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("504B0304"), "docx").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff").when(head.startswith("424D"), "bmp")


# -- boxes: x0, y0, x1, y1 ------------------------------------------------------------------------------------------


def box_of(points: Column) -> Column:
    """The upright box around an array of points (arrays x, y)."""
    axis = lambda i, f: f(F.transform(points, lambda p: p[i]))
    return F.struct(axis(0, F.array_min).alias("x0"), axis(1, F.array_min).alias("y0"), axis(0, F.array_max).alias("x1"), axis(1, F.array_max).alias("y1"))


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def common_area(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0)) * F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = common_area(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def cover(a: Column, b: Column) -> Column:
    """Common area over the smaller area."""
    small = F.least(area(a), area(b))
    return F.when(small > 0, common_area(a, b) / small).otherwise(0.0)


def union_box(boxes: Column) -> Column:
    side = lambda f, n: f(F.transform(boxes, lambda b: b[n])).alias(n)
    return F.struct(side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1"))


def yolo_label(kind: Column, b: Column, width: Column, height: Column) -> Column:
    """class, centre and size as shares of the page, six decimals."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", kind, (b["x0"] + b["x1"]) / 2 / width, (b["y0"] + b["y1"]) / 2 / height, (b["x1"] - b["x0"]) / width, (b["y1"] - b["y0"]) / height)


# -- no built-in form -----------------------------------------------------------------------------------------------


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; null counts as empty. Pairs that recur in a batch are compared once."""
    seen: dict[tuple[str, str], float] = {}
    for pair in zip(a, b):
        if pair not in seen:
            seen[pair] = difflib.SequenceMatcher(None, pair[0] or "", pair[1] or "").ratio()
    return pd.Series([seen[pair] for pair in zip(a, b)])


@F.pandas_udf(T.IntegerType())
def longest_common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common substring."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).find_longest_match().size for x, y in zip(a, b)])


def all_of(*rules: Column) -> Column:
    return reduce(lambda a, b: a & b, rules)
