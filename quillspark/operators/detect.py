"""Tiered detection of sensitive text, and the second detector of identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions import spans as S

#: Labels compare without regard to case, in all alphabets.
ANY_LABEL = "(?iuU)" + "|".join([*V.LABELS.values(), *V.BOUNDARIES])


#: Cheap patterns without which a type cannot occur; most texts fail them.
GATES = {"email": "@", "phone": "[1-9]", "postcode": "[0-9]", "dob": "[0-9][/-][0-9]", "nin": "[0-9]{6}", "bank_account": "[0-9]{8}", "vehicle_reg": "[0-9]", "council_ref": "[0-9]{5}"}
#: The same for labels, in `folded` text: what each label must hold.
LABEL_GATES = {
    "person_name": "name|nombre|reported|contact|carer|parent|applicant", "dob": r"d\.?o\.?b|birth|born", "address": "address|direcci", "phone": "phone|tel|mobile|contact", "email": "email",
    "nin": r"(?<!\w)n\.?i\.?[n\s:=-]|national", "nhs_number": r"(?<!\w)n(?:\.?h\.?|\s*[hm]\s*)s", "bank_details": "account|sort", "pcn": "pcn", "vehicle_reg": "vehicle|vrm|registration",
    "council_ref": r"ref(?:erence)?\s*[:=-]", "school": "school", "signature": "signature", "notes": "notes",
}
#: The same of any label, as words that `folded` text must hold, or a pattern with a word that it needs (none: a part of `n`).
ANY_GATE_WORDS = "name|nombre|reported|contact|carer|parent|applicant|dob|d.ob|do.b|d.o.b|birth|born|address|direcci|phone|tel|mobile|email|national|account|sort|pcn|vehicle|vrm|registration|school|signature|notes".split("|")
ANY_GATE_PATTERNS = {"ref": r"ref(?:erence)?\s*[:=-]", "n": r"n(?<!\wn)(?:\.?i\.?[n\s:=-]|(?:\.?h\.?|\s*[hm]\s*)s)"}


#: What may be left of a label behind its first letters: a few words, and white space of any length.
LABEL_REST = r"(?sU)^(?:\S{0,60}+\s++){0,8}+\S{0,60}+"


def _ci(pattern: str) -> str:
    return "(?iuU)" + pattern


def _any_of(patterns: list[str], before: str = r"(?<!\w)") -> str:
    """A pattern that is found where one of patterns is; what many begin with is looked at once."""
    apart = [p for p in patterns if not p.startswith(before)]
    return "|".join([before + "(?:" + "|".join(p[len(before) :] for p in patterns if p.startswith(before)) + ")", *apart])


def _may_hold_label(low: Column) -> Column:
    """Whether any of `LABEL_GATES` is found. Words are looked for as bytes, which is far cheaper than one pattern of all."""
    words = [F.contains(low, F.lit(w)) for w in ANY_GATE_WORDS]
    return reduce(lambda a, b: a | b, [*words, *(F.contains(low, F.lit(w)) & low.rlike("(?U)" + p) for w, p in ANY_GATE_PATTERNS.items())])


def folded(text: Column) -> Column:
    """text in small letters, the four letters that equal ASCII ones without regard to case among them."""
    return F.lower(F.when(text.rlike("[\u0130\u0131\u017f\u212a]"), F.translate(text, "\u0130\u0131\u017f\u212a", "iisk")).otherwise(text))


def field_labels(text: Column, labels: dict[str, str] = V.LABELS, any_label: str = ANY_LABEL) -> Column:
    """Values behind labels, up to a length, the next label and, but for addresses and notes, the line's end."""

    gates = LABEL_GATES if labels is V.LABELS else {kind: "" for kind in labels}  # an empty one lets all texts pass
    spec = lambda kind: F.struct(
        F.lit(kind).alias("kind"), F.lit(_ci(labels[kind])).alias("pattern"), F.lit(V.LABEL_VALUE_MAX.get(kind, V.LABEL_VALUE_DEFAULT_MAX)).alias("most")
    )

    def value(k: Column, m: Column, starts: Column) -> Column:
        at, size = m["end"], F.length(text)
        stop = F.least(at + k["most"], size, F.coalesce(F.array_min(F.filter(starts, lambda s: s > at)), size))
        raw = F.substring(text, at + 1, stop - at)
        raw = F.when(k["kind"].isin("address", "notes"), raw).otherwise(F.substring_index(raw, "\n", 1))

        def kept(raw: Column, left: Column) -> Column:
            inner = F.regexp_replace(left, r"(?U)[\s,;|]+$", "")
            start = at + F.length(raw) - F.length(left)
            return F.struct(start.alias("start"), (start + F.length(inner)).alias("end"), inner.alias("value"))

        return S.let(raw, lambda raw: S.let(F.regexp_replace(raw, r"(?U)^\s+", ""), lambda left: kept(raw, left)))

    def of(hit: Column, starts: Column) -> Column:
        k = hit["k"]
        found = F.filter(F.transform(hit["found"], lambda m: value(k, m, starts)), lambda v: F.length(v["value"]) >= 2)
        return F.transform(found, lambda v: S.span(k["kind"], v, 0.95, "field_label"))

    def reach(hits: Column) -> Column:
        """The text as far as any value may go, and so much on that a label which begins there is whole."""
        last = F.array_max(F.flatten(F.transform(hits, lambda h: F.transform(h["found"], lambda m: m["end"] + h["k"]["most"]))))
        return F.concat(F.substring(text, F.lit(1), last), F.regexp_extract(F.substring(text, last + 1, F.length(text)), LABEL_REST, 0))

    def found(low: Column) -> Column:
        kinds = F.array_compact(F.array(*(F.when(low.rlike("(?U)" + gates[kind]), spec(kind)) for kind in labels)))  # constant patterns are compiled once
        hits = F.filter(F.transform(kinds, lambda k: F.struct(k.alias("k"), S.matches(text, k["pattern"]).alias("found"))), lambda h: F.size(h["found"]) > 0)
        starts = lambda hits: F.transform(S.matches(reach(hits), any_label), lambda m: m["start"])  # noqa: E731  the dearest pattern: no further than needed
        ends = lambda hits: S.let(starts(hits), lambda starts: F.flatten(F.transform(hits, lambda h: of(h, starts))))
        return S.let(hits, lambda hits: F.when(F.size(hits) > 0, ends(hits)).otherwise(S.none()))

    may = _may_hold_label if labels is V.LABELS else lambda low: low.rlike("(?U)" + "|".join(gates.values()))
    return S.let(folded(text), lambda low: F.when(may(low) & text.rlike(_ci(_any_of([*labels.values()]))), found(low)).otherwise(S.none()))


def address_phrases(text: Column) -> Column:
    found = F.filter(S.matches(text, _ci(V.ADDRESS_PHRASE), 1), lambda m: F.length(S.bare(m["value"])) >= 6)
    return S.typed("address", found, 0.82, "address_phrase")


def contact_header(text: Column) -> Column:
    """Name and address lines at the top of a letter, if anything there shows that it is a contact block."""
    top = F.regexp_extract(text, r"^(?:\s*+\S[^\n]*+(?:\n|$)){1,8}", 0)  # the first eight lines that are not blank
    stripped = F.transform(S.lines(top), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), S.bare(x["value"]).alias("bare")))
    filled = F.filter(stripped, lambda x: F.length(x["bare"]) > 0)
    line = lambda x: x["bare"]

    def head_of(top: Column) -> Column:
        stop = F.array_position(F.transform(top, lambda x: line(x).rlike(_ci(V.HEADER_STOP))), F.lit(True))
        return F.when(stop > 0, F.slice(top, F.lit(1), (stop - 1).cast("int"))).otherwise(top)

    def block_of(head: Column) -> Column:
        signal = F.exists(head, lambda x: (F.contains(line(x), F.lit("@")) & line(x).rlike(V.STRUCTURED["email"][0])) | line(x).rlike(V.STRUCTURED["phone"][0]) | line(x).rlike(V.STRUCTURED["postcode"][0]) | line(x).rlike(_ci(V.ADDRESS_LINE)))
        words = F.size(F.split(F.regexp_replace(line(head[0]), r"(?U)\s+", " "), " "))
        named = words.between(2, 4) & ~line(head[0]).rlike(r"\d") & ~F.contains(line(head[0]), F.lit(":")) & ~line(head[0]).rlike(ANY_LABEL)
        name = F.when(named, S.typed("person_name", F.slice(head, 1, 1), 0.78, "contact_header")).otherwise(S.none())
        place = lambda x: (line(x).rlike(_ci(V.ADDRESS_LINE)) | line(x).rlike(V.STRUCTURED["postcode"][0])) & ~line(x).rlike(_ci(V.CONTACT_LINE)) & ~line(x).rlike(ANY_LABEL)  # the dearest pattern last
        places = S.typed("address", F.filter(F.slice(head, F.lit(2), F.lit(8)), place), 0.80, "contact_header")
        return F.when((F.size(head) >= 2) & signal, F.concat(name, places)).otherwise(S.none())

    return F.concat(S.let(S.let(F.slice(filled, 1, 8), head_of), block_of), address_phrases(text))


def medical_content(text: Column) -> Column:
    found = F.filter(F.when(text.rlike(_ci(V.PATIENT_REFERENCE)) & text.rlike(_ci(V.MEDICAL_TERMS)), S.sentences(text)).otherwise(S.none(S.FOUND)), lambda s: (F.length(s["value"]) >= 20) & s["value"].rlike(_ci(V.PATIENT_REFERENCE)) & s["value"].rlike(_ci(V.MEDICAL_TERMS)))
    return S.typed("medical_details", found, 0.88, "medical_content")


def context_notes(text: Column) -> Column:
    found = F.filter(F.when(text.rlike(_ci(V.HARDSHIP)), S.sentences(text)).otherwise(S.none(S.FOUND)), lambda s: (F.length(s["value"]) >= 10) & s["value"].rlike(_ci(V.HARDSHIP)))
    return S.typed("notes", found, 0.82, "context_notes")


def titled_names(text: Column) -> Column:
    before = lambda m: F.trim(F.substring_index(F.substring(text, F.lit(1), m["start"]), "\n", -1))
    found = F.filter(S.matches(text, V.TITLED_NAME), lambda m: before(m).rlike(_ci(V.TITLE_CONTEXT)))
    return S.typed("person_name", found, 0.85, "titled_name")


def dependent_names(text: Column) -> Column:
    words = lambda m: F.split(m["value"], r"\s+")
    stop = F.array(*map(F.lit, V.DEPENDENT_STOP))
    found = F.filter(S.matches(text, V.DEPENDENT_NAME, 1), lambda m: ~F.arrays_overlap(F.transform(words(m), lambda w: F.lower(F.btrim(w, F.lit(".,;:-_=|")))), stop))
    return S.typed("person_name", found, 0.84, "dependent_name")


def dependent_ages(text: Column) -> Column:
    return S.typed("child_age", F.filter(S.matches(text, V.DEPENDENT_AGE, 1), lambda m: F.length(m["value"]) >= 4), 0.84, "dependent_age")


def standalone_names(text: Column) -> Column:
    """A line of capitalised words right below a sign-off."""
    filled = F.filter(F.transform(S.lines(text), S.trimmed), lambda x: F.length(x["value"]) > 0)
    above = lambda f: F.concat(F.array(F.lit(None).cast("string")), F.transform(F.slice(f, F.lit(1), F.greatest(F.size(f) - 1, F.lit(0))), lambda x: x["value"]))
    pairs = S.let(filled, lambda f: F.zip_with(f, F.when(F.size(f) > 0, above(f)).otherwise(F.array().cast("array<string>")), lambda x, y: F.struct(x.alias("line"), y.alias("above"))))

    def is_name(p: Column) -> Column:
        line, words = p["line"]["value"], F.split(p["line"]["value"], r"(?U)\s+")
        return (
            p["above"].rlike(_ci(V.SIGN_OFF)) & ~line.rlike(r"(?U)\d") & ~line.rlike(ANY_LABEL) & ~line.rlike(_ci(V.GENERIC_LABEL_LINE)) & F.length(line).between(4, 40)
            & F.size(words).between(2, 4) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}") & (F.length(w) >= 2)) & ~F.arrays_overlap(words, F.array(*map(F.lit, V.NOT_NAMES)))
        )

    found = F.transform(F.filter(pairs, lambda p: F.coalesce(is_name(p), F.lit(False))), lambda p: p["line"])
    found = F.when(text.rlike("(?m)" + _ci(r"^\s*" + V.SIGN_OFF[1:])), found).otherwise(S.none(S.FOUND))
    return S.typed("person_name", found, 0.72, "standalone_name")


def near_dob_label(text: Column, start: Column) -> Column:
    """Whether a date may be a birth date: right behind such a label, or not behind a bare date label."""
    behind = F.exists(S.matches(text, _ci(V.LABELS["dob"])), lambda m: (start - m["end"]).between(0, 5))
    low = F.greatest(start - 35, F.lit(0))
    return behind | ~F.substring(text, low + 1, start - low).rlike(r"(?iuU)(?<!\w)Date\s*[:\-]?\s+$")


def structured(text: Column, patterns: dict[str, tuple[str, float]] = V.STRUCTURED, guards: bool = True) -> Column:
    """Pattern hits, type by type, with the guards on dates, plates, phones and references."""

    def of(kind: str) -> Column:
        pattern, confidence = patterns[kind]
        ok = {
            "dob": lambda m: near_dob_label(text, m["start"]),
            "vehicle_reg": lambda m: ~m["value"].rlike(V.MONTH),
            "phone": lambda m: F.length(S.digits(m["value"])) >= 10,
            "council_ref": lambda m: F.length(S.digits(m["value"])) >= 4,
        }.get(kind) if guards else None
        found = S.matches(text, pattern)
        found = S.typed(kind, F.filter(found, ok) if ok else found, confidence, "regex")
        gate = GATES.get(kind) if patterns is V.STRUCTURED else None
        return F.when(text.rlike(gate), found).otherwise(S.none()) if gate else found

    found = F.concat(*map(of, patterns))
    return F.when(text.rlike("[0-9@]"), found).otherwise(S.none()) if patterns is V.STRUCTURED else found


def detect(docs: DataFrame, allowed: Column | None = None, extra: Column | None = None, text: str = "text") -> DataFrame:
    """docs with spans added: labels and header first, then each tier where it is free, then the profile's types.

    allowed (array of types; null or empty: all) filters last, so a span that is dropped still shadows others; only the
    sentence tiers are skipped when it lacks their type. extra holds spans of an injected model (lower tier than names).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    gate = lambda kind, found: found if allowed is None else F.when(allowed.isNull() | F.array_contains(allowed, kind), found).otherwise(S.none())
    tiers = [gate("medical_details", medical_content(t)), gate("notes", context_notes(t)), titled_names(t), dependent_names(t), dependent_ages(t), standalone_names(t)]
    tiers += [extra] if extra is not None else []
    first = docs.withColumn("spans", F.concat(field_labels(t), contact_header(t)))
    for tier in [*tiers, structured(t)]:
        first = first.withColumn("spans", S.add_free(F.col("spans"), tier))
    kept = F.col("spans")
    if allowed is not None:
        kept = F.when(F.size(F.coalesce(allowed, F.array())) > 0, F.filter(kept, lambda s: F.array_contains(allowed, s["type"]))).otherwise(kept)
    return first.withColumn("spans", S.by_start(kept))


def entity_fallback(text: Column, entities: Column, model_available: bool = False) -> Column:
    """Entities of an injected recogniser (array of struct label, start, end, value) as spans, for longer texts where no
    language model is at hand: people, places and organisations of four letters or more."""
    sure = F.create_map(*[F.lit(x) for pair in V.FALLBACK_ENTITIES.items() for x in pair])
    kept = F.filter(entities, lambda e: F.map_contains_key(sure, e["label"]) & (F.length(S.bare(e["value"])) >= 4))
    found = F.transform(kept, lambda e: S.span(F.lower(e["label"]), e, 0.0, "ner").withField("confidence", F.try_element_at(sure, e["label"])))
    return S.none() if model_available else F.when(F.length(text) > 100, found).otherwise(S.none())


def model_labels(entities: Column) -> Column:
    """Entities of a token classifier (array of struct label, start, end, value, score) as spans, labels in house terms."""
    names = F.create_map(*[F.lit(x) for pair in V.MODEL_LABELS.items() for x in pair])
    return F.transform(entities, lambda e: S.span(F.coalesce(F.try_element_at(names, e["label"]), F.lower(e["label"])), e, 0.0, "bert").withField("confidence", e["score"]))


def without_label(value: Column) -> Column:
    """value without the first label in it; as it was if nothing else is left."""
    rest = S.bare(F.regexp_replace(value, "(?s)^(.*?)(?:" + ANY_LABEL + ")(.*)$", "$1$2"))
    return F.when(rest == "", value).otherwise(rest)


def redact_again(docs: DataFrame, translated: str = "translated") -> DataFrame:
    """docs with redacted_translation: a translation is redacted anew, for all types."""
    found = detect(docs, text=translated)
    return found.withColumn("redacted_translation", S.redact(F.col(translated), F.col("spans"))).drop("spans")


def model_spans(text: Column, items: Column, confidence: float = 0.82, method: str = "llm") -> Column:
    """Spans of values that a model names (array of struct type, value): first exact, else first case-blind occurrence."""

    def place(x: Column) -> Column:
        def found(value: Column, exact: Column) -> Column:
            at = F.when(exact > 0, exact).otherwise(F.position(F.lower(value), F.lower(text)))
            return S.let(at, lambda at: S.span(x["type"], F.struct((at - 1).alias("start"), (at - 1 + F.length(value)).alias("end"), value.alias("value")), confidence, method))

        return S.let(without_label(x["value"]), lambda value: S.let(F.position(value, text), lambda exact: found(value, exact)))

    return F.filter(F.transform(items, place), lambda s: (s["start"] >= 0) & (F.length(s["value"]) >= 2))


def identifiers(text: Column, addresses: Column | None = None) -> Column:
    """The second detector: national identifiers with their checks, postcodes outside addresses; best confidence wins.

    addresses (array of struct start, end) are those that another detector found."""

    def of(kind: str) -> Column:
        found = S.matches(text, V.IDENTIFIERS[kind])
        check = {"nhs_number": nhs_valid, "nin": nin_valid}.get(kind)
        return S.typed(kind, F.filter(found, lambda m: check(m["value"])) if check else found, 0.90, "regex")

    postcodes = S.matches(text, V.IDENTIFIER_POSTCODE)
    if addresses is not None:
        postcodes = F.filter(postcodes, lambda m: ~F.exists(addresses, lambda a: (a["start"] <= m["start"]) & (m["end"] <= a["end"])))
    every = F.concat(*map(of, V.IDENTIFIERS), S.typed("postcode", postcodes, 0.95, "regex"))
    kept = F.filter(S.add_free(S.none(), S.by_confidence(every)), lambda s: (F.length(F.trim(s["value"])) >= 2) & (s["confidence"] >= 0.3))
    return S.by_start(kept)


def boosted(spans: Column, category: Column) -> Column:
    """Contact types are five hundredths surer in social care."""
    contact = F.array(*map(F.lit, ("person_name", "address", "phone", "email")))
    up = lambda s: s.withField("confidence", F.when(F.array_contains(contact, s["type"]), F.least(F.lit(1.0), s["confidence"] + 0.05)).otherwise(s["confidence"]))
    return F.when(category.isin("children_safeguarding", "adult_social_care"), F.transform(spans, up)).otherwise(spans)


def nhs_valid(value: Column) -> Column:
    """Ten digits, the last the modulus-11 check of the others."""
    d = S.digits(value)
    total = reduce(lambda a, b: a + b, [F.substring(d, i + 1, 1).try_cast("int") * (10 - i) for i in range(9)])
    check = 11 - total % 11
    return F.coalesce((F.length(d) == 10) & (F.when(check == 11, 0).otherwise(check) == F.substring(d, 10, 1).try_cast("int")), F.lit(False))


def nin_valid(value: Column) -> Column:
    v = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    return v.rlike(f"^[{V.NIN_FIRST}][{V.NIN_SECOND}][0-9]{{6}}[{V.NIN_LAST}]$") & ~F.left(v, F.lit(2)).isin(V.NIN_BANNED)


def plausible(s: Column) -> Column:
    """Whether a span may become a box."""
    kind, value = F.lower(s["type"]), s["value"]
    compact = F.regexp_replace(value, r"(?U)\s+", "")
    return (
        F.when(kind == "email", value.rlike(r"@[^@]*\.[^@]*$"))
        .when(kind == "phone", F.length(S.digits(value)) >= 10)
        .when(kind.isin("postcode", "postal_code"), value.rlike(r"(?i)\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b"))
        .when(kind.isin("council_ref", "reference", "case_ref"), value.rlike(r"\d") & (F.contains(value, F.lit("-")) | (F.length(compact) >= 6)))
        .otherwise(F.lit(True))
    )


def visible(role: str, kind: Column, value: Column) -> Column:
    """What a role sees of a value; unknown roles see what the default role sees."""
    policy = V.ROLES.get(role, V.ROLES[V.DEFAULT_ROLE])
    mode = F.lit(policy["default"])
    for t, m in policy.items():
        mode = F.when(kind == t, m).otherwise(mode) if t != "default" else mode
    return F.when(mode == "none", value).when(mode == "partial", S.mask(kind, value)).otherwise(F.concat(F.lit("[REDACTED-"), kind, F.lit("]")))
