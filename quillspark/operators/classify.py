"""Categories, departments, sentiment, urgency, profiles and review routing, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions.scalars import let


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once, however often later steps name them: a generator stands between."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def lookup(key: Column, table: dict, default) -> Column:
    """A constant table as an expression, with a default for null and unknown keys."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.lit(default))


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a word in a text, by what is left when they are taken out."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(word), F.lit("")))) / len(word.encode())).cast("int")


def present(text: Column, words: list[str]) -> Column:
    """How many of the words occur in the text."""
    return sum((F.contains(text, F.lit(w.lower())).cast("int") for w in words[1:]), F.contains(text, F.lit(words[0].lower())).cast("int"))


def scores(text: Column, categories: dict[str, list[str]] = V.CATEGORIES) -> Column:
    """For each category in order, occurrences weighted by the keyword's number of words."""
    return let(F.lower(text), lambda low: F.array(*(sum((occurrences(low, k.lower()) * len(k.split()) for k in words), F.lit(0)) for words in categories.values())))


def category(text: Column, categories: dict[str, list[str]] = V.CATEGORIES) -> Column:
    """struct(category, confidence): the first of the highest scores and its share; unknown and 0 if all are zero."""
    found = F.transform(F.array(scores(F.coalesce(text, F.lit("")), categories)), lambda s: F.struct(s.alias("s"), F.array_max(s).alias("top"), F.aggregate(s, F.lit(0), lambda a, x: a + x).alias("all")))[0]
    best = F.element_at(_array(categories), F.array_position(found["s"], found["top"]).cast("int"))
    return F.struct(
        F.when(found["top"] > 0, best).otherwise("unknown").alias("category"),
        F.when(found["top"] > 0, F.round(found["top"] / found["all"], 4)).otherwise(0.0).alias("confidence"),
    )


def keyword_estimate(text: Column, categories: dict[str, list[str]] = V.CATEGORIES) -> Column:
    """The first category with the most different keywords present; unknown if there is none."""
    counts = let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.array(*(present(low, words) for words in categories.values())))
    return F.transform(F.array(counts), lambda c: F.when(F.array_max(c) > 0, F.element_at(_array(categories), F.array_position(c, F.array_max(c)).cast("int"))).otherwise("unknown"))[0]


def effective_category(selected: Column, guessed: Column, text: Column) -> Column:
    """What was selected, else a known guess, else the estimate; empty counts as missing."""
    known = F.when(guessed.isin(*V.CATEGORIES), guessed)
    return F.coalesce(F.nullif(selected, F.lit("")), known, keyword_estimate(text))


def department(category_: Column) -> Column:
    return lookup(category_, V.DEPARTMENTS, V.DEPARTMENTS["unknown"])


def risk_flags(text: Column, keywords: dict[str, list[str]] = V.RISK_KEYWORDS) -> Column:
    """Names of the flags of which any keyword is a part of the text."""
    held = lambda low: F.array_compact(F.array(*(F.when(present(low, words) > 0, name) for name, words in keywords.items())))
    return let(F.lower(F.coalesce(text, F.lit(""))), held)


def sentiment(text: Column) -> Column:
    def mood(low: Column) -> Column:
        bad, good = present(low, V.NEGATIVE_WORDS), present(low, V.POSITIVE_WORDS)
        return F.when(present(low, V.DISTRESS_WORDS) > 0, "distressed").when(present(low, V.ANGRY_WORDS) > 0, "angry").when(bad > good, "negative").when(good > bad, "positive").otherwise("neutral")

    return let(F.lower(F.coalesce(text, F.lit(""))), mood)


def urgency(category_: Column, flags: Column, mood: Column) -> Column:
    base = lookup(category_, V.URGENCY_BASE, 0.2)
    return F.round(F.least(F.lit(1.0), base + 0.2 * F.size(flags) + F.when(mood.isin("angry", "distressed"), 0.1).otherwise(0.0)), 4)


def analysis_confidence(flags: Column) -> Column:
    return F.when(F.size(flags) > 0, 0.75).otherwise(0.60)


def profiles(category_: Column) -> Column:
    table = F.create_map(*[x for k, v in V.CATEGORY_PROFILES.items() for x in (F.lit(k), _array(v))])
    return F.coalesce(F.try_element_at(table, F.coalesce(F.nullif(category_, F.lit("")), F.lit("unknown"))), _array(["general_pii"]))


def allowed_types(profiles_: Column) -> Column:
    """All types of the profiles, each once, sorted; unknown profiles add none."""
    table = F.create_map(*[x for k, v in V.PROFILES.items() for x in (F.lit(k), _array(v))])
    return F.array_sort(F.array_distinct(F.flatten(F.transform(profiles_, lambda p: F.coalesce(F.try_element_at(table, p), F.array().cast("array<string>"))))))


def requires_review(category_: Column, profiles_: Column) -> Column:
    return category_.isin(V.REVIEW_CATEGORIES) | F.arrays_overlap(profiles_, _array(V.REVIEW_PROFILES))


def review_reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, each once, the first eight, joined; rules in order of importance."""
    return F.array_join(F.slice(F.array_distinct(F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))), 1, 8), "; ")


def final_status(flagged: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), "failed").when(flagged, "needs_review").otherwise("complete")


def language(text: Column, detected: Column) -> Column:
    """Short texts count as English, as do texts no detector can tell."""
    return F.when(F.length(F.trim(text)) < 20, "en").otherwise(F.coalesce(detected, F.lit("en")))


def status_percent(status: Column) -> Column:
    return lookup(status, V.STATUS_PERCENT, 0)


def confidence_band(confidence: Column, high: float = 0.8, middle: float = 0.6) -> Column:
    return F.when(confidence >= high, "high").when(confidence >= middle, "medium").otherwise("low")


def priority(urgency_: Column, wanted: str) -> Column:
    """urgent from 0.8, high from 0.5 (urgent included), normal below; null belongs to none."""
    return {"urgent": urgency_ >= 0.8, "high": urgency_ >= 0.5, "normal": urgency_ < 0.5}[wanted]


def priority_bucket(urgency_: Column) -> Column:
    return F.when(urgency_ >= 0.8, "urgent").when(urgency_ >= 0.5, "high").when(urgency_ < 0.5, "normal")


def with_model(keyword: Column, urgency_: Column, model: Column) -> Column:
    """struct(category, urgency): a model's answer (struct category, urgency) goes before the keywords' where it has one."""
    return F.struct(F.coalesce(F.nullif(model["category"], F.lit("")), keyword).alias("category"), F.coalesce(model["urgency"], urgency_).alias("urgency"))


def translated(text: Column, lang: Column, translate, pairs: list[str], enabled: bool = True) -> Column:
    """The text in English: translate (a function of columns text, lang) for the languages in pairs, else as it is."""
    return F.when(lang.isin(*pairs) & (lang != "en"), F.coalesce(translate(text, lang), text)).otherwise(text) if enabled else text
