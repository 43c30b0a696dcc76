"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base spans (e-mail addresses, IP addresses, card numbers, phone numbers) are the protected data. Single values are
mostly unique, so what a text discloses is asked at three levels: the value itself, the part of it that people or places
share (an address's owner and domain, a network, a card's issuer, a phone's area), and the kind of data. These are the
protected entities of a text.

Corpus co-occurrence tells how strongly a term reveals an entity. Of the n texts, a term is in t, an entity in e and
both in b: the chance of the entity, p = e / n, becomes q = (b + prior * p) / (t + prior) where the term is seen; the
term discloses log2(q / p) of the log2(1 / p) bits that the entity holds (pointwise mutual information over information
content, smoothed): 0 if independent, towards 1 if the term occurs only with the entity. Terms at or above
`Settings.disclosure` that occur with the entity in at least two different texts are spans too, of kind `term`,
wherever they stand in the texts that hold the entity. Counts cover all documents and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.spans import matches

from .common import materialise, release, table

#: The four kinds in the order of listing. Quantifiers are possessive where what follows cannot
#: match what they took, and a match starts where a run of its characters starts or the last match ended; both
#: keep the matches and make long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Texts without a match of these have no span of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
WORD = r"(?U)\w{3,}+"
SPANS = "array<struct<start:int,end:int,value:string>>"
TAGGED = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Settings:
    disclosure: float = 0.8
    prior: float = 1.0  # texts that the chance of an entity weighs against what is seen
    #: A term becomes NAME, NUMBER or WORD in brackets, by its shape; if false it goes without a trace.
    generalise: bool = True


BROADCAST = 200_000  # rows of two short strings that may go to every task


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: F.coalesce(part.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    return F.when(text.rlike(HINTS[kind]), found).otherwise(F.array().cast(SPANS))


def find(docs: DataFrame, mark: str = "") -> DataFrame:
    """docs with one column of spans (start, end, value; code points, end exclusive) for each kind, named mark and kind.

    A null text counts as empty; texts of any length are taken whole. Columns under these names are replaced.
    """
    kept = docs.drop(*(mark + kind for kind in PATTERNS))
    text = F.coalesce(kept["text"], F.lit(""))
    return kept.select("*", *(_spans(text, kind).alias(mark + kind) for kind in PATTERNS))


def _entities(mark: str) -> Column:
    """The entities of a text, each once: of every span its value, what the value shares with others, and its kind."""

    def of(kind: str) -> Column:
        def names(s: Column) -> Column:
            v = F.lower(s["value"]) if kind == "email" else s["value"] if kind == "ip" else _digits(s["value"])
            parts = {
                "email": [("owner", F.regexp_extract(v, "^[a-z]{3,}", 0)), ("domain", F.substring_index(v, "@", -1))],
                "ip": [("network", F.substring_index(v, ".", 2))],
                "card": [("issuer", F.left(v, F.lit(6)))],
                "phone": [("area", F.left(v, F.lit(4)))],
            }[kind]
            return F.array(F.concat(F.lit(f"{kind}:"), v), F.lit(f"kind:{kind}"), *(F.concat(F.lit(f"{name}:"), part) for name, part in parts))

        return F.flatten(F.transform(mark + kind, names))

    return F.filter(F.array_distinct(F.concat(*map(of, PATTERNS))), lambda x: x != "owner:")


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def _disclosure(both: Column, of_term: Column, of_entity: Column, total: int, settings: Settings) -> Column:
    """How much of an entity's information a term discloses, from the numbers of texts that hold both, the term, the entity."""
    p = of_entity / F.lit(float(total))
    q = (both + settings.prior * p) / (of_term + settings.prior)
    return F.log2(q / p) / -F.log2(p)


def _tagged(kind: str) -> Column:
    return F.transform(f"__{kind}", lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _looked_through(docs: DataFrame, whole: bool, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """docs with __digest (of the text), __base (spans) and __entities, written to the shared folder, texts without a base
    span only if whole; and __digest, __terms of the texts that have disclosing terms. Copies of a text are one text."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    base = F.concat(*map(_tagged, PATTERNS))
    first = find(docs, "__").select(*names, F.unhex(F.md5(F.col("text").cast("binary"))).alias("__digest"), base.alias("__base"), F.when(F.size(base) > 0, _entities("__")).alias("__entities"))
    first = first if whole else first.withColumn("text", F.when(F.size("__base") > 0, F.col("text")))
    first = materialise(first, "base", scan=True)
    held = first.where(F.size("__base") > 0).select(F.col("__digest").alias("digest"), "text", F.col("__base").alias("base"), F.col("__entities").alias("entities"))
    texts = held.groupBy("digest").agg(F.first("text").alias("text"), F.first("base").alias("base"), F.first("entities").alias("entities"), F.count("*").alias("rows"))
    texts = materialise(texts, "texts")
    terms = materialise(_terms(texts, docs, first.count(), settings), "terms")
    release(texts)
    return first, terms.select(F.col("digest").alias("__digest"), F.col("terms").alias("__terms"))


def spans(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, base and terms: one row for each row of docs (doc_id, text), by way of the shared folder.

    base lists the kinds' spans, terms the disclosing terms' spans that overlap no base span, both as arrays of
    (kind, start, end) in order. Null texts count as empty; repeated rows count each and get equal spans. An empty table
    gives an empty result. Other columns of docs are ignored.
    """
    first, terms = _looked_through(docs.select("doc_id", "text"), False, settings)
    plain = first.where(F.size("__base") == 0).select("doc_id", F.col("__base").alias("base"), F.array().cast(TAGGED).alias("terms"))
    held = first.where(F.size("__base") > 0).join(terms, "__digest", "left")
    return plain.union(held.select("doc_id", "__base", F.coalesce("__terms", F.array().cast(TAGGED))))


def _terms(texts: DataFrame, docs: DataFrame, total: int, settings: Settings) -> DataFrame:
    """digest, terms: the disclosing terms' spans in whole texts, for the texts (digest, text, base, entities, rows) that
    have some. Words inside base spans count as words of the text, but are not marked."""
    each = texts.select("digest", "rows", "entities", _words(F.col("text")).alias("words"))
    often = docs.where("text IS NOT NULL").select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("of_term")).where("of_term > 1")
    words = materialise(each.select("digest", F.explode("words").alias("term")).join(often, "term"), "words")
    entities = each.select("rows", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("rows").alias("of_entity"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("of_entity") < total))
    held = materialise(each.select("digest", "rows", F.explode("entities").alias("entity")).join(entities.drop("n"), "entity"), "entities")
    # A term is with an entity no more often than the entity is at all, which rules out most pairs before they are made.
    pairs = held.join(words, "digest").where(_disclosure(F.col("of_entity"), F.col("of_term"), F.col("of_entity"), total, settings) >= settings.disclosure)
    pairs = materialise(pairs.select("digest", "rows", "entity", "of_entity", "term", "of_term"), "pairs")
    found = pairs.groupBy("entity", "term", "of_entity", "of_term").agg(F.sum("rows").alias("both"), F.count("*").alias("n")).where("n > 1")
    chosen = materialise(found.where(_disclosure(F.col("both"), F.col("of_term"), F.col("of_entity"), total, settings) >= settings.disclosure).select("entity", "term"), "chosen")
    release(words, held)
    few = chosen.limit(BROADCAST + 1).count() <= BROADCAST
    marked = pairs.select("digest", "entity", "term").join(F.broadcast(chosen) if few else chosen, ["entity", "term"])
    marked = marked.groupBy("digest").agg(F.array_sort(F.collect_set("term")).alias("found")).join(texts.select("digest", "text", "base"), "digest")  # words of one text
    words = F.filter(matches(F.col("text"), WORD), lambda w: F.array_contains("found", F.lower(w["value"])))
    tagged = F.transform(words, lambda w: F.struct(F.lit("term").alias("kind"), w["start"].alias("start"), w["end"].alias("end")))
    free = F.filter(tagged, lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (b["end"] > w["start"])))
    return marked.select("digest", free.alias("terms")).where(F.size("terms") > 0)


def sanitise(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs with every base span in text replaced by its kind in brackets, overlapping ones as one, named after the first,
    and every disclosing term generalised or removed (see Settings.generalise).

    Rows without a span stay as they are, null texts and repeated rows among them; n_chars, where it exists, follows the
    new text; an empty table gives an empty result.
    """
    first, terms = _looked_through(docs, True, settings)
    held = first.where(F.size("__base") > 0).join(terms, "__digest", "left")
    every = F.concat("__base", F.coalesce("__terms", F.array().cast(TAGGED)))
    held = held.withColumn("__spans", F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    ordered = F.col("__spans")

    def join(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["end"]), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    touching = F.exists(F.arrays_zip(ordered.alias("x"), F.slice(ordered, F.lit(2), F.size(ordered)).alias("y")), lambda z: z["y"]["start"] < z["x"]["end"])
    merged = F.when(touching, F.aggregate(ordered, none, join)).otherwise(ordered)  # most texts have none that overlap
    both = held.withColumn("__spans", merged)
    shape = lambda w: F.when(w.rlike(r"^\d+$"), "[NUMBER]").when(w.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    shown = shape if settings.generalise else lambda w: F.lit("")
    before = lambda i: F.when(i > 0, F.try_element_at("__spans", i)["end"]).otherwise(0)  # noqa: E731  element_at counts from 1
    parts = F.transform("__spans", lambda s, i: F.concat(F.substring(F.col("text"), before(i) + 1, s["start"] - before(i)), F.when(s["kind"] == "term", shown(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))))
    rest = F.substring(F.col("text"), F.element_at("__spans", -1)["end"] + 1, F.length("text"))
    out = both.withColumn("text", F.concat(F.array_join(parts, ""), rest))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return first.where(F.size("__base") == 0).select(*docs.columns).union(out.select(*docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, PATTERNS), F.sha2(text("base"), 256).alias("base_sha256"), text(F.concat("base", "terms")).alias("spans"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`sanitise` with the documents of the stage as the corpus."""
    return sanitise(docs)
