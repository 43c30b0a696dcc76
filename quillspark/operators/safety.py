"""Masks for pages whose recognised text is not sure enough to map spans to words.

Seven rules look at words and at the visual lines they form, on each page by itself; each gives rectangles in whole pixels.
Their union can be had as rectangles that do not overlap. Nothing is drawn here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions import spans as S
from quillspark.operators.detect import ANY_LABEL
from quillspark.operators.geometry import first_fit_lines

#: Pages at least so sure need no masks; below the second value, forms are masked by where their fields lie.
SURE, GUESSED = 0.90, 0.50

# What the rules look for, with word boundaries and digits of all scripts.
CONTENT_STARTS = r"(?iU)\b(?:dear|to\s+the|subject|re:|i\s+am\s+writing|please|request)\b"
DATES = r"(?iU)\b(?:date|january|february|march|april|may|june|july|august|september|october|november|december)\b"
CONTACT_LABELS = r"(?iU)\b(?:phone|mobile|tel|telephone|email|date\s+of\s+birth|dob|birth|council\s+reference|case\s+(?:reference|ref))\b"
LABELLED = (
    r"(?iU)^\s*(?:requester\s+name|full\s+name|name|e-?mail|email\s+address|phone|mobile|telephone|tel|contact\s+number|postal\s+address|"
    r"home\s+address|property\s+address|address|postcode|dob|born|birth|nin|national\s+insurance|nhs|id|reference|ref|council\s+reference|"
    r"case\s+reference|signature)\b\s*[:=\-]"
)
LABEL_TYPES = {
    "name": "person_name", "email": "email", "phone": "phone", "mobile": "phone", "tel": "phone", "number": "phone", "address": "address",
    "postcode": "postcode", "dob": "dob", "born": "dob", "birth": "dob", "nin": "nin", "national": "nin", "nhs": "nhs_number", "id": "nin",
    "ref": "council_ref", "reference": "council_ref", "signature": "signature",
}
VALUES = {
    "phone": r"(?U)\b0[\d\s]{9,12}\b|\+44[\d\s]{9,12}",
    "email": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "postcode": r"(?iU)\b[A-Z]{1,2}\d[\dA-Z]?\s?\d[A-Z]{2}\b",
    "nin": r"(?iU)\b[A-Z]{2}\s*\d{6}\s*[A-D]\b",
    "nhs_number": r"(?U)\b\d{3}\s*[-\s]?\d{3}\s*[-\s]?\d{4}\b|\b\d{5,}[-\s]\d{2,}\b",
}
CLOSINGS = r"(?iU)\b(?:yours|faithfully|sincerely|regards|signed)\b"
SENSITIVE = (
    r"(?iU)\b(?:medically?|diagnosed?|allerg(?:y|ic)|symptom|breathing|asthma|as[tl]hma|health|illness|medication|prescribed|condition|disability|"
    r"abuse|vulnerable|neglect|unsafe|self.harm|violence|concern)\b"
)
SEPARATORS = ["=", ":", "-"]
#: A label where a word begins: a name may well end like one.
LABEL_WORD = ANY_LABEL.replace("(?iuU)", r"(?iuU)(?<!\w)(?:", 1) + ")"
#: The same on pages, where words that only end a value need their separator: texts are full of a plain "re".
LABEL_MARKED = r"(?iuU)(?<!\w)(?:" + "|".join([*V.LABELS.values(), *(b.replace(r"[:\-]?", r"[:\-]") for b in V.BOUNDARIES)]) + ")"
#: A start of content is whole words; "re:" ends like none, so no boundary is asked for behind it.
STARTED = CONTENT_STARTS.replace(r"(?iU)\b", r"(?iU)(?<!\w)").removesuffix(r"\b") + r"(?!\w)"


def whole(x: Column) -> Column:
    """The number without its fraction."""
    return x.cast("long")


def wanted(kind: Column | str, else_: Column | None = None) -> Column:
    """Whether the page's types (null: all) hold kind."""
    return F.coalesce(F.array_contains("allowed", F.lit(kind) if isinstance(kind, str) else kind), F.col("allowed").isNull())


def named(line: Column, label: str = LABEL_WORD) -> Column:
    """Whether a trimmed line looks like a name: up to four words with letters, no digit, no label."""
    words = F.filter(F.transform(F.split(line, r"\s+"), lambda w: F.btrim(w, F.lit(".,;:"))), lambda w: w != "")
    return (line != "") & ~line.rlike(r"(?U)\d") & ~line.rlike(label) & ~line.rlike("(?i)" + V.GENERIC_LABEL_LINE) & F.size(words).between(1, 4) & F.forall(words, lambda w: w.rlike("[A-Za-z]")) & (F.length(line) <= 45)


def rectangle(rule: str, x0: Column, y0: Column, x1: Column, y1: Column, across: int, along: int) -> Column:
    """The rectangle padded to all sides, on the page; null where hardly anything is left."""
    out = F.struct(
        F.lit(rule).alias("rule"), F.greatest(F.lit(0), whole(x0) - across).alias("x0"), F.greatest(F.lit(0), whole(y0) - along).alias("y0"),
        F.least(whole(F.col("width")), whole(x1) + across).alias("x1"), F.least(whole(F.col("height")), whole(y1) + along).alias("y1"),
    )
    return F.when((out["x1"] > out["x0"] + 4) & (out["y1"] > out["y0"] + 4), out)


def visual_lines(words: DataFrame, page: str) -> DataFrame:
    """page, line, text, box and what the rules ask of separators, of words (with width, height, sureness, allowed and line)."""
    held = [F.first(c).alias(c) for c in ("width", "height", "sureness", "allowed", "tall")]
    ordered = F.sort_array(F.collect_list(F.struct("x0", "word_no", "text")))
    apart = F.trim("text").isin(SEPARATORS)
    lines = words.groupBy(page, F.col("group").alias("line")).agg(*held, ordered.alias("parts"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max(F.when(apart, F.col("x1"))).alias("behind"))
    return lines.withColumn("text", F.array_join(F.transform("parts", lambda p: p["text"]), " ")).drop("parts").withColumn("bare", S.bare(F.col("text")))


def headers(lines: DataFrame, page: str) -> tuple[DataFrame, Column]:
    """What stands above a letter's content: sender lines before the first contact label, names, addresses."""
    every, n = Window.partitionBy(page), F.col("line")
    pattern = lambda kind: F.col("text").rlike(V.STRUCTURED[kind][0])
    upper = lambda c: F.when(n < 14, c).otherwise(False)  # noqa: E731  no rule looks at names, places and dates further down
    start = F.min(F.when(upper(F.col("bare").rlike(STARTED)), n)).over(every)
    lines = lines.withColumn("dated", upper(F.col("text").rlike(DATES))).withColumn("limit", F.coalesce(start, F.least(F.lit(8), F.max(n).over(every) + 1)))
    lines = lines.withColumn("name_like", upper(named(F.col("bare"), LABEL_MARKED)))
    lines = lines.withColumn("contact", upper(pattern("email") | pattern("phone") | pattern("postcode") | F.col("text").rlike("(?iU)" + V.ADDRESS_LINE)))
    lines = lines.withColumn("label", F.min(F.when((n < F.col("limit")) & upper(F.col("text").rlike(CONTACT_LABELS)), n)).over(every))
    lines = lines.withColumn("before", F.coalesce((F.col("label") <= 10) & (n < F.col("label")) & (F.col("bare") != "") & ~F.col("dated"), F.lit(False)))
    shaped = (F.sum(F.col("before").cast("int")).over(every) >= 2) & F.max(F.col("before") & (F.col("contact") | F.col("name_like"))).over(every)
    lines = lines.withColumn("sender", F.col("before") & shaped & (F.length("bare") <= 70) & wanted("address"))
    kind = F.when(pattern("email"), "email").when(pattern("phone"), "phone").when(pattern("postcode"), "postcode").otherwise("address")
    masked = F.when(F.col("sender"), True).when((n <= 1) & F.col("name_like"), wanted("person_name")).when(F.col("contact"), wanted(kind) | wanted("address"))
    held = (n < F.col("limit")) & (F.col("bare") != "") & ~F.col("dated") & masked
    return lines, F.array(F.when(held, rectangle("header", F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 4, 1)))


def label_rows(words: DataFrame, page: str) -> DataFrame:
    """What follows a label: the rest of its line, or of its own block behind the separator."""
    keys = F.create_map(*(F.lit(x) for pair in LABEL_TYPES.items() for x in pair))
    tokens = F.transform(F.split(F.lower("text"), r"[\s:,=\-]+"), lambda t: F.try_element_at(keys, t))
    kind = F.try_element_at(F.filter(tokens, lambda t: t.isNotNull()), F.lit(1))
    labels = words.where(F.col("text").rlike(LABELLED)).withColumn("kind", kind).where(F.col("kind").isNotNull() & (wanted(F.col("kind")) | (F.size("allowed") == 0)))
    centre = lambda t: (F.col(f"{t}.y0") + F.col(f"{t}.y1")) / 2
    near = labels.alias("a").join(words.select(page, "x1", "y0", "y1").alias("b"), page).where(F.abs(centre("a") - centre("b")) <= F.greatest(F.col("a.tall") * 0.7, F.lit(8.0)))
    one = near.groupBy(page, F.col("a.word_no").alias("word_no")).agg(*(F.first(f"a.{c}").alias(c) for c in ("text", "x0", "x1", "width", "height")), F.max("b.x1").alias("right"), F.min("b.y0").alias("top"), F.max("b.y1").alias("low"))
    top, low = F.greatest(F.lit(0), whole(F.col("top")) - 3), F.least(whole(F.col("height")), whole(F.col("low")) + 3)
    edge = lambda x: F.least(F.col("width"), x + 5)
    share = F.regexp_instr("text", F.lit(r"[=:\-]")) / F.greatest(F.length("text"), F.lit(1))
    inside = whole(F.col("x0") + share * (F.col("x1") - F.col("x0")))
    apart = rectangle("label", whole(F.col("x1")), top, edge(whole(F.col("right"))), low, 1, 0)
    same = F.when((share > 0) & (F.col("x1") > inside + 4), rectangle("label", inside, top, edge(F.col("x1")), low, 1, 0))
    return one.select(page, F.when(F.col("right") > F.col("x1") + 5, apart).otherwise(same).alias("r"))


def forms(lines: DataFrame, page: str) -> tuple[DataFrame, Column]:
    """On hardly readable pages, the value side of the first fields and what stands under an address-like heading."""
    w, h, n, every = F.col("width"), F.col("height"), F.col("line"), Window.partitionBy(page)
    digit, mail = F.col("text").rlike(r"(?U)\d"), F.col("text").rlike(V.STRUCTURED["email"][0])
    read = (F.col("sureness") < GUESSED) & (n < 8) & ~F.col("dated")
    heading = read & (n >= 3) & (F.col("x0") < w * 0.28) & (F.col("x1") - F.col("x0") < w * 0.35) & (F.col("y0") < h * 0.70) & ~digit & ~mail
    lines = lines.withColumn("heading", heading).withColumn("first", F.min(F.when(F.col("heading"), n)).over(every))
    lines = lines.withColumn("under", F.coalesce((n > F.col("first")) & (n <= F.col("first") + 3), F.lit(False)))
    lines = lines.withColumn("ended", F.min(F.when(F.col("under") & (F.col("y0") > h * 0.78), n)).over(every))
    long = F.length(F.regexp_replace(F.lower("text"), r"(?U)\W+", "")) > 8
    field = read & ~F.col("heading") & (n < 4) & (F.col("y0") < h * 0.55) & (digit | mail | F.col("behind").isNotNull() | long)
    start = whole(F.coalesce(F.col("behind") + 3, whole(F.col("x0") + 0.45 * (F.col("x1") - F.col("x0"))).cast("double")))
    top, low, right = F.greatest(F.lit(0), whole(F.col("y0")) - 5), F.least(whole(h), whole(F.col("y1")) + 5), F.least(whole(w), whole(F.col("x1")) + 8)
    part = lambda left: F.when(right > left + 10, rectangle("form", left, top, right, low, 0, 0))
    below = F.col("under") & (F.col("ended").isNull() | (n < F.col("ended")))
    return lines, F.array(F.when(field, part(F.greatest(F.lit(0), F.least(whole(w), start)))), F.when(below, part(F.greatest(F.lit(0), whole(F.col("x0")) - 8))))


def value_boxes(words: DataFrame) -> Column:
    """The first value of each kind within a block, in proportion to its characters."""
    wide, size = F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)), F.greatest(F.length("text"), F.lit(1))

    def one(kind: str, pattern: str) -> Column:
        at, found = F.regexp_instr("text", F.lit(pattern)) - 1, F.regexp_substr("text", F.lit(pattern))
        start, end = whole(F.col("x0") + at / size * wide), whole(F.col("x0") + (at + F.length(found)) / size * wide)
        fits = found.isNotNull() & (end > start + 2) & (wanted(kind) | (F.size("allowed") == 0))
        return F.when(fits, rectangle("value", start, F.col("y0"), end, F.col("y1"), 2, 2))

    return F.when(F.col("text").rlike("[0-9@]"), F.array(*(one(*x) for x in VALUES.items())))


def sensitive_boxes(words: DataFrame) -> Column:
    return F.array(F.when(wanted("medical_details") & F.col("text").rlike(SENSITIVE), rectangle("sensitive", F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 4, 3)))


def dependents(lines: DataFrame, page: str) -> tuple[DataFrame, Column]:
    """The names of children and other dependents."""
    wide, size = F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)), F.greatest(F.length("text"), F.lit(1))

    def one(m: Column) -> Column:
        value = F.btrim(m["value"], F.lit(" ,.;:-_=|"))
        words = F.split(value, r"\s+")
        stopped = F.exists(words, lambda x: F.lower(F.btrim(x, F.lit(".,;:-_=|"))).isin(V.DEPENDENT_STOP))
        start, end = whole(F.col("x0") + m["start"] / size * wide), whole(F.col("x0") + (m["start"] + F.length(value)) / size * wide)
        return F.when((F.size(words) >= 2) & ~stopped & (end > start + 6), rectangle("dependent", start, F.col("y0"), end, F.col("y1"), 3, 3))

    found = F.when(wanted("person_name") & F.col("text").rlike("(?iU)" + V.RELATION), S.matches(F.col("text"), V.DEPENDENT_NAME, 1))
    return lines, F.transform(found, one)


def closings(lines: DataFrame, page: str) -> tuple[DataFrame, Column]:
    """Up to three lines below a closing that look like a signature, as long as they follow closely."""
    w = Window.partitionBy(page).orderBy("line")
    nexts = F.array_compact(F.array(*(F.lead(F.struct("x0", "y0", "x1", "y1", "bare"), i).over(w) for i in (1, 2, 3))))
    lines = lines.withColumn("next", F.when((wanted("signature") | wanted("person_name")) & F.col("text").rlike(CLOSINGS), nexts))
    gap = F.greatest(F.col("tall") * 4, F.lit(80.0))
    close = F.filter("next", lambda x, i: F.forall(F.slice("next", F.lit(1), i + 1), lambda y: y["y0"] - F.col("y1") <= gap))
    signed = F.filter(close, lambda x: (x["x1"] - x["x0"] < F.col("width") * 0.45) | named(x["bare"], LABEL_MARKED))
    return lines, F.transform(signed, lambda x: rectangle("closing", x["x0"], x["y0"], x["x1"], x["y1"], 6, 4))


def safety_masks(words: DataFrame, pages: DataFrame, page: str) -> DataFrame:
    """page, rule and x0, y0, x1, y1 (long) of every mask.

    words: page (long), word_no, text, x0, y0, x1, y1. pages: page, width, height, sureness (mean confidence) and allowed (types,
    null for all). Pages at least `SURE` and pages without words have no mask; the work of a page is bounded by its words.
    """
    known = pages.where(F.col("sureness") < SURE).select(page, "width", "height", "sureness", "allowed")
    tall = F.avg(F.col("y1") - F.col("y0")).over(Window.partitionBy(page))
    held = words.join(known, page).select(page, "word_no", "text", "x0", "y0", "x1", "y1", "width", "height", "sureness", "allowed", tall.alias("tall"))
    groups = first_fit_lines(held.select(page, "word_no", "x0", "y0", "x1", "y1"), page, 0.7)
    lines = visual_lines(held.join(groups, [page, "word_no"]), page)
    found = []
    for rule in (headers, forms, dependents, closings):
        lines, boxes = rule(lines, page)
        found.append(boxes)
    # of a plain explode Spark would make a filter, and look for all boxes again for it
    joined = lambda parts: F.explode_outer(F.flatten(F.array(*(F.coalesce(x, F.array()) for x in parts)))).alias("r")
    out = lines.select(page, joined(found)).unionByName(held.select(page, joined([value_boxes(held), sensitive_boxes(held)]))).unionByName(label_rows(held, page))
    return out.where("r IS NOT NULL").select(page, "r.rule", "r.x0", "r.y0", "r.x1", "r.y1")


def disjoint(boxes: DataFrame, page: str) -> DataFrame:
    """page and x0, y0, x1, y1 of rectangles that cover what boxes cover and do not overlap.

    A sweep over x cuts a page into strips between neighbouring edges. In a strip, boxes whose y ranges meet become one
    run; runs of the same y range in touching strips are put together. Boxes of a page only meet each other.
    """
    boxes = boxes.where("x1 > x0 AND y1 > y0").groupBy(page).agg(F.collect_set(F.struct("x0", "y0", "x1", "y1")).alias("all"))  # once: boxes are dear
    edges = F.array_sort(F.array_distinct(F.flatten(F.transform("all", lambda b: F.array(b["x0"], b["x1"])))))
    strips = boxes.withColumn("edges", edges).select(page, "all", "edges", F.posexplode_outer("edges").alias("at", "left")).where("at < size(edges) - 1")
    strips = strips.select(page, "left", F.expr("edges[at + 1]").alias("right"), "all")
    cut = strips.select(page, "left", "right", F.explode_outer(F.filter("all", lambda b: (b["x0"] < F.col("right")) & (b["x1"] > F.col("left")))).alias("b")).where("b IS NOT NULL").select(page, "left", "right", "b.y0", "b.y1")
    down = Window.partitionBy(page, "left").orderBy("y0", "y1")
    reached = F.max("y1").over(down.rowsBetween(Window.unboundedPreceding, -1))
    cut = cut.withColumn("run", F.coalesce((F.col("y0") > reached).cast("int"), F.lit(1)))
    cut = cut.withColumn("run", F.sum("run").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    runs = cut.groupBy(page, "left", "right", "run").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    across = Window.partitionBy(page, "y0", "y1").orderBy("left")
    runs = runs.withColumn("part", F.coalesce((F.col("left") > F.lag("right").over(across)).cast("int"), F.lit(1)))
    runs = runs.withColumn("part", F.sum("part").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(page, "y0", "y1", "part").agg(F.min("left").alias("x0"), F.max("right").alias("x1")).select(page, "x0", "y0", "x1", "y1")
