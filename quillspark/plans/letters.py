"""Queries over letters made of the customers' rows: each tier of detection, with the SQL that tells what must be found."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import detect as D
from quillspark.plans.registry import dealt, query, table

#: Written once for both engines: SQL that Spark and DuckDB read alike.
NAME = "'Anna ' || chr(CAST(65 + c_custkey % 26 AS INT)) || 'illow'"
SUR = "chr(CAST(65 + c_custkey % 26 AS INT)) || 'illow'"
DAY = "'0' || (c_custkey % 9 + 1) || '/11/1980'"

#: tier: (expression of the operator, text, [(type, value, condition)])
LETTERS = {
    "field_labels": (
        D.field_labels,
        f"'Full Name: ' || c_name || chr(10) || 'Date of Birth: ' || {DAY} || chr(10) || 'Reference: AB-' || c_custkey || ', ' || chr(10) || 'Notes: paid ' || c_custkey || ' twice'",
        [("person_name", "c_name", "true"), ("dob", DAY, "true"), ("council_ref", "'AB-' || c_custkey", "true"), ("notes", "'paid ' || c_custkey || ' twice'", "true")],
    ),
    "contact_header": (
        D.contact_header,
        f"{NAME} || chr(10) || chr(9) || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN 'hello world' ELSE c_custkey || ' High Street' END || chr(10) || 'Dear all' || chr(10) || '9 Low Road'",
        [("person_name", NAME, "c_custkey % 3 <> 0"), ("address", "c_custkey || ' High Street'", "c_custkey % 3 <> 0")],
    ),
    "address_phrases": (D.address_phrases, "'Hello. I live at ' || CASE WHEN c_custkey % 4 = 0 THEN 'sea' ELSE c_custkey || ' Oak Road' END || '. Bye.'", [("address", "c_custkey || ' Oak Road'", "c_custkey % 4 <> 0")]),
    "medical_content": (D.medical_content, "'Good day. The patient has asthma, no. ' || c_custkey || ' of many! It rains on asthma ' || c_custkey || '.'", [("medical_details", "'The patient has asthma, no.'", "true")]),
    "context_notes": (D.context_notes, "'Hi there. We cannot afford bill ' || c_custkey || '. Bye.' || chr(10) || 'All is well.'", [("notes", "'We cannot afford bill ' || c_custkey || '.'", "true")]),
    "titled_names": (D.titled_names, f"'Dear Mr ' || {SUR} || chr(10) || 'I met Mrs Nobody in town.' || chr(10) || 'Patient: Dr ' || {SUR}", [("person_name", f"'Mr ' || {SUR}", "true"), ("person_name", f"'Dr ' || {SUR}", "true")]),
    "dependent_names": (D.dependent_names, f"'Well, my son Tom ' || {SUR} || ', who is ' || c_custkey || '. The child Has Asthma, too.'", [("person_name", f"'Tom ' || {SUR}", "true")]),
    "dependent_ages": (D.dependent_ages, "'So my daughter is aged ' || (c_custkey % 18) || ' now, and he is aged 40.'", [("child_age", "'aged ' || (c_custkey % 18)", "true")]),
    "standalone_names": (D.standalone_names, f"'All the best.' || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN 'Yours sincerely,' ELSE 'So long' END || chr(10) || chr(10) || '  ' || {NAME} || ' ' || chr(10) || 'PS: none'", [("person_name", NAME, "c_custkey % 2 = 0")]),
    "second_identifiers": (
        D.identifiers,
        "'Notice PCN ' || (1000000 + c_custkey) || ', account CT' || (20000000 + c_custkey) || ' in UB8 1AB today'",
        [("pcn_number", "'PCN ' || (1000000 + c_custkey)", "true"), ("council_tax_ref", "'CT' || (20000000 + c_custkey)", "true"), ("postcode", "'UB8 1AB'", "true")],
    ),
    "whole_letter": (
        lambda t: None,
        f"'Email: u' || c_custkey || '@mail.example' || chr(10) || 'Seen at REF' || (10000 + c_custkey) || '.' || chr(10) || 'Kind regards' || chr(10) || {NAME}",
        [("email", "'u' || c_custkey || '@mail.example'", "true"), ("council_ref", "'REF' || (10000 + c_custkey)", "true"), ("person_name", NAME, "true")],
    ),
}
#: Structured types, each in a sentence of its own, some with a near miss beside it.
STRUCTURED = {
    "nin": ("'No. AB ' || (100000 + c_custkey) || ' C and no more'", "'AB ' || (100000 + c_custkey) || ' C'"),
    "council_ref": ("'see ref-' || (10000 + c_custkey) || ', not xref-12'", "'ref-' || (10000 + c_custkey)"),
    "dob": ("'it was 0' || (c_custkey % 9 + 1) || '/11/1980 then, and the Date: 01/02/2020 too'", "'0' || (c_custkey % 9 + 1) || '/11/1980'"),
    "bank_account": ("'pay into ' || (20000000 + c_custkey) || ', please'", "'' || (20000000 + c_custkey)"),
    "vehicle_reg": ("'car AB12 CDE; born May 12 a'", "'AB12 CDE'"),
    "phone": ("'call 2' || (1000000000 + c_custkey) || ', or 12 345 67'", "'2' || (1000000000 + c_custkey)"),
}


def _sql(text: str, wanted: list[tuple[str, str, str]]) -> str:
    rows = " UNION ALL ".join(f"SELECT c_custkey, text, '{kind}' AS type, {value} AS value FROM t WHERE {when}" for kind, value, when in wanted)
    return f"WITH t AS (SELECT *, {text} AS text FROM customer), w AS ({rows}) SELECT c_custkey, type, (strpos(text, value) - 1)::BIGINT AS start_at, (strpos(text, value) - 1 + length(value))::BIGINT AS end_at, value FROM w"


def _found(spans):
    cols = ["c_custkey", "s.type", F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"), "s.value"]
    return each(spans, "spans").select(*cols)


def each(rows, found):
    """A row for each span of found, as s. Of a plain explode Spark would make a filter, and find all spans once more for it."""
    return rows.select("c_custkey", F.explode_outer(found).alias("s")).where("s IS NOT NULL")


def _customers(spark, sf_dir):
    """Keys and names of the customers, dealt out: few bytes are read, but much is done for each row."""
    return dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))


def _letters(spark, sf_dir, text: str):
    return _customers(spark, sf_dir).select("c_custkey", F.expr(text).alias("text"))


def _tier(tier: str):
    find, text, _ = LETTERS[tier]

    def run(spark, sf_dir):
        rows = _letters(spark, sf_dir, text)
        return _found(D.detect(rows) if tier == "whole_letter" else rows.withColumn("spans", find(F.col("text"))))

    return run


def _structured(kind: str):
    def run(spark, sf_dir):
        rows = _letters(spark, sf_dir, STRUCTURED[kind][0])
        return _found(rows.withColumn("spans", F.filter(D.structured(F.col("text")), lambda s: s["type"] == kind)))

    return run


for _name, (_, _text, _wanted) in LETTERS.items():
    query(f"letters_{_name}", _sql(_text, _wanted))(_tier(_name))
for _name, (_text, _value) in STRUCTURED.items():
    query(f"letters_{_name}", _sql(_text, [(_name, _value, "true")]))(_structured(_name))


@query(
    "letters_redacted",
    f"SELECT c_custkey, 'Email: [REDACTED-email]' || chr(10) || 'Seen at [REDACTED-council_ref].' || chr(10) || 'Kind regards' || chr(10) || '[REDACTED-person_name]' AS redacted_translation FROM customer",
)
def letters_redacted(spark, sf_dir):
    rows = _letters(spark, sf_dir, LETTERS["whole_letter"][1]).withColumnRenamed("text", "translated")
    return D.redact_again(rows).select("c_custkey", "redacted_translation")


@query("letters_fallback", f"SELECT c_custkey, lower(l) AS type, CASE l WHEN 'PERSON' THEN 0.70 ELSE 0.65 END::DOUBLE AS confidence FROM (SELECT c_custkey, unnest(['PERSON', 'ORG']) AS l FROM customer) WHERE c_custkey % 2 = 0")
def letters_fallback(spark, sf_dir):
    entity = lambda label, value: F.struct(F.lit(label).alias("label"), F.lit(0).alias("start"), F.lit(len(value)).alias("end"), F.lit(value).alias("value"))
    text = F.rpad(F.lit("Anna Billow"), F.when(F.col("c_custkey") % 2 == 0, 101).otherwise(100), "x")
    entities = F.array(entity("PERSON", "Anna"), entity("DATE", "1980"), entity("ORG", "Acme"), entity("LOC", " UK "))
    rows = each(_customers(spark, sf_dir), D.entity_fallback(text, entities))
    return rows.select("c_custkey", "s.type", "s.confidence")


@query("letters_model_labels", "SELECT c_custkey, unnest(['person_name', 'date']) AS type, unnest(['Anna', '1980']) AS value FROM customer")
def letters_model_labels(spark, sf_dir):
    entity = lambda label, value: F.struct(F.lit(label).alias("label"), F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit(value).alias("value"), F.lit(0.9).alias("score"))
    rows = each(_customers(spark, sf_dir), D.model_labels(F.array(entity("PER", "Anna"), entity("DATE", "1980"))))
    return rows.select("c_custkey", "s.type", "s.value")


@query("letters_bare_value", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Name: ' ELSE c_name END AS value FROM customer")
def letters_bare_value(spark, sf_dir):
    value = F.concat(F.lit("Name: "), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", D.without_label(value).alias("value"))


@query("letters_plausible", "SELECT c_custkey, kind, value IN ('a@b.cd', '0123 456 789', 'UB8 1AB', 'REF-1') AS ok FROM (SELECT c_custkey, unnest(['email', 'email', 'phone', 'phone', 'postcode', 'postcode', 'council_ref', 'council_ref']) AS kind, unnest(['a@b.cd', 'a@bcd', '0123 456 789', '0123', 'UB8 1AB', 'UB', 'REF-1', 'R1']) AS value FROM customer)")
def letters_plausible(spark, sf_dir):
    cases = [("email", "a@b.cd"), ("email", "a@bcd"), ("phone", "0123 456 789"), ("phone", "0123"), ("postcode", "UB8 1AB"), ("postcode", "UB"), ("council_ref", "REF-1"), ("council_ref", "R1")]
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*(F.struct(F.lit(k).alias("type"), F.lit(v).alias("value")) for k, v in cases))).alias("s"))
    return rows.select("c_custkey", F.col("s.type").alias("kind"), D.plausible(F.col("s")).alias("ok"))


@query("letters_boosted", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN least(1.0, c + 0.05) ELSE c END::DOUBLE AS confidence FROM (SELECT c_custkey, unnest([0.7, 0.98]) AS c FROM customer)")
def letters_boosted(spark, sf_dir):
    spans = F.array(*(F.struct(F.lit("phone").alias("type"), F.lit(c).cast("double").alias("confidence")) for c in (0.7, 0.98)))
    category = F.when(F.col("c_custkey") % 2 == 0, "adult_social_care").otherwise("parking")
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(D.boosted(spans, category)["confidence"]).alias("confidence"))


@query("letters_model_spans", "SELECT c_custkey, (strpos(lower(t), lower(v)) - 1)::BIGINT AS start_at, v AS value FROM (SELECT c_custkey, 'Dear ' || c_name || ', hello' AS t, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'Dear ' || c_name || ', hello', 'HELLO' FROM customer)")
def letters_model_spans(spark, sf_dir):
    item = lambda v: F.struct(F.lit("person_name").alias("type"), v.alias("value"))
    text = F.concat(F.lit("Dear "), F.col("c_name"), F.lit(", hello"))
    found = D.model_spans(text, F.array(item(F.concat(F.lit("Name: "), F.col("c_name"))), item(F.lit("HELLO")), item(F.lit("absent"))))
    return each(_customers(spark, sf_dir), found).select("c_custkey", F.col("s.start").cast("long").alias("start_at"), "s.value")
