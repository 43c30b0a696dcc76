import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions import spans as S
from quillspark.operators import classify as C
from quillspark.operators import detect as D
from quillspark.operators import evaluate as E

# case, category, text, gone, labels kept, values kept, types
CASES = [
    ("label", "housing_repairs", "Full Name: Orla Quint\nIssue: damp in the boiler room", ["Orla Quint"], ["Full Name", "Issue"], ["damp"], ["person_name"]),
    ("address", "housing_repairs", "Home Address: 9 Birch Row\nLeeds\nPhone: 07700 900456\nStatus: open", ["9 Birch Row\nLeeds", "07700 900456"], ["Phone", "Status"], ["open"], ["address", "phone"]),
    ("date", "complaint", "Date: 03/04/2021\nDOB: 05/06/1987", ["05/06/1987"], ["Date", "DOB"], ["03/04/2021"], ["dob"]),
    ("bare_date", "complaint", "Date: 03/04/2021 we met", [], ["Date"], ["03/04/2021"], []),
    ("reference", "council_tax", "see REF4455667 about arrears", ["REF4455667"], [], ["arrears"], ["council_ref"]),
    ("child", "children_safeguarding", "My daughter Ina Moss, age 7, is unwell.", ["Ina Moss", "age 7"], [], ["unwell"], ["person_name", "child_age"]),
    ("medical", "adult_social_care", "The patient has chronic asthma and takes medication. The bus was late.", ["chronic asthma"], [], ["The bus was late."], ["medical_details"]),
    ("hardship", "council_tax", "We are homeless and cold. Thank you for reading this.", ["homeless"], [], ["Thank you"], ["notes"]),
    ("hardship_not_in_profile", "waste", "We are homeless and cold. Thank you for reading this.", [], [], ["homeless"], []),
    ("vehicle", "parking", "my van LM12 QRS was towed on 12 May 2020", ["LM12 QRS"], [], ["12 May 2020"], ["vehicle_reg"]),
    ("signature", "complaint", "It is cold.\nKind regards\nTeo Van Brand", ["Teo Van Brand"], ["Kind regards"], ["cold"], ["person_name"]),
    ("email", "waste", "write to t.b+x@mail.example.org soon", ["t.b+x@mail.example.org"], [], ["soon"], ["email"]),
    ("header", "complaint", "Ada Birch\n14 Mill Lane\nDear Sir,\nThe Mill is loud", ["Ada Birch", "14 Mill Lane"], ["Dear Sir"], ["The Mill"], ["person_name", "address"]),
    ("safe", "waste", "The bins on the corner were not emptied again.", [], [], ["bins on the corner"], []),
    ("spanish", "translation", "Nombre: Luz Vega\nFecha: ayer", ["Luz Vega"], ["Nombre", "Fecha"], ["ayer"], ["person_name"]),
    ("phrase", "complaint", "I live at 77 Cove View near the sea. It is loud.", ["77 Cove View"], [], ["It is loud."], ["address"]),
    ("titled", "complaint", "Dear Mrs Olive Hart\nthank you", ["Mrs Olive Hart"], ["Dear"], ["thank you"], ["person_name"]),
]


@pytest.fixture(scope="module")
def found(spark):
    cases = spark.createDataFrame(CASES, "case_id string, category string, input_text string, expected_redacted_values array<string>, expected_unredacted_labels array<string>, expected_not_redacted_values array<string>, expected_redaction_types array<string>")
    profiles = C.profiles(F.col("category"))
    rows = D.detect(cases, C.allowed_types(profiles), text="input_text")
    rows = rows.withColumn("redacted", S.redact(F.col("input_text"), F.col("spans"))).withColumn("types", F.transform("spans", lambda s: s["type"]))
    return rows.withColumn("needs_review", C.requires_review(F.col("category"), profiles)).withColumn("expected_needs_review", F.col("needs_review")).cache()


def test_golden_cases(found):
    results = E.case_results(found)
    failed = [(r["case_id"], r["redacted"], r["leaked"], r["lost_values"], r["missing_types"]) for r in results.where("NOT passed").collect()]
    assert not failed
    assert E.case_summary(results).first()["accepted"]


def test_spans_are_sorted_and_hold_their_text(found):
    for r in found.collect():
        starts = [s["start"] for s in r["spans"]]
        assert starts == sorted(starts)
        assert all(r["input_text"][s["start"] : s["end"]] == s["value"] for s in r["spans"] if s["method"] != "address_phrase")


def test_matches_equal_the_regex_module(spark):
    texts = ["", "a@b.cc x 😀 é q@r.st", "AB1 2CD,ab12cd", "REF-12345 ref123456", "x" * 5000 + " z@y.xw"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for kind in ("email", "postcode", "council_ref", "vehicle_reg", "phone"):
        pattern = V.STRUCTURED[kind][0]
        got = {r["i"]: [(m["start"], m["end"], m["value"]) for m in r["m"]] for r in rows.select("i", S.matches(F.col("t"), pattern).alias("m")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t)]


def test_masks_and_roles(spark):
    rows = spark.createDataFrame([("phone", "+44 7700 900123"), ("email", "jo@x.org"), ("email", "joan@x.org"), ("person_name", "ada may birch"), ("address", "12b Low Road"), ("nin", "AB123456C"), ("phone", "12")], "k string, v string")
    masks = [r[0] for r in rows.select(S.mask(F.col("k"), F.col("v"))).collect()]
    assert masks == ["XXX-XXX-0123", "***@x.org", "jo***@x.org", "A. birch", "12b [REDACTED-address]", "[REDACTED-nin]", "[REDACTED-phone]"]
    assert [r[0] for r in rows.select(D.visible("auditor", F.col("k"), F.col("v"))).collect()] == [r["v"] for r in rows.collect()]
    assert {r[0] for r in rows.select(D.visible("nobody", F.col("k"), F.col("v"))).collect()} == {"[REDACTED-phone]", "[REDACTED-email]", "[REDACTED-person_name]", "[REDACTED-address]", "[REDACTED-nin]"}
    assert [r[0] for r in rows.limit(4).select(D.visible("caseworker", F.col("k"), F.col("v"))).collect()][3] == "ada may birch"


def test_identifiers_and_folds(spark):
    rows = spark.createDataFrame([("NHS 943 476 5919, AB123456C and BG123456A at N1 2AB, CT1234567",)], "t string")
    spans = [(s["type"], s["value"]) for s in rows.select(D.identifiers(F.col("t")).alias("s")).first()["s"]]
    assert spans == [("nhs_number", "943 476 5919"), ("nin", "AB123456C"), ("postcode", "N1 2AB"), ("council_tax_ref", "CT1234567")]


def test_model_spans(spark):
    rows = spark.createDataFrame([("see Jane doe", [("person_name", "Full Name: jane Doe"), ("x", "absent")])], "t string, items array<struct<type:string,value:string>>")
    assert [(s["start"], s["end"]) for s in rows.select(D.model_spans(F.col("t"), F.col("items")).alias("s")).first()["s"]] == [(4, 12)]


#: Every way to spell each label.
SPELLED = {
    "person_name": ["Requester Name:", "Full Name=", "Patient Name:", "Child's Name:", "Child Name-", "Applicant:", "Applicant Name:", "Nombre:", "Reported by:", "Emergency Contact:", "Carer:", "Carer Name:", "Parent:", "NAME :"],
    "dob": ["DOB:", "D.O.B. ", "Date of Birth=", "Born "],
    "address": ["Address:", "Home Address:", "Property Address -", "Contact Address ", "Dirección:", "Direccion "],
    "phone": ["Emergency Phone:", "Emergency Tel:", "Emergency Telephone ", "Mobile:", "Telephone=", "Telefono:", "Teléfono ", "Contact Number:", "Phone Number:", "PhoneNumber:", "Phone "],
    "email": ["Email:", "Email Address=", "EMAIL -"],
    "nin": ["NI:", "N.I. ", "NI Number:", "NINumber:", "NIN=", "National Insurance:", "National Insurance Number ", "National ID:"],
    "nhs_number": ["NHS:", "N.H.S. ", "NHS Number=", "N M S:", "NMS "],
    "bank_details": ["Bank Account ", "Account Number: ", "Sort Code- "],
    "pcn": ["PCN: ", "PCN "],
    "vehicle_reg": ["Vehicle Reg: ", "Vehicle Registration ", "VRM- ", "Registration "],
    "council_ref": ["Council Reference:", "Council Ref=", "Case Reference-", "Case Ref:", "Reference:", "Ref:", "Counc!reference:"],
    "school": ["School: ", "School "],
    "signature": ["Signature: ", "Signature "],
    "notes": ["Notes: ", "Notes "],
}


def test_every_label_spelled_alone(spark):
    """Quick looks that rule texts out must let every spelling of every label pass."""
    rows = [(kind, f"{form[i]}Qx Zz7") for kind, form in SPELLED.items() for i in range(len(form))]
    rows += [(kind, text.lower()) for kind, text in rows] + [(kind, text.upper()) for kind, text in rows]
    found = spark.createDataFrame(rows, "kind string, text string").select("kind", "text", D.field_labels(F.col("text")).alias("s")).collect()
    stands = lambda kind, text: (m := re.search(V.LABELS[kind], text, re.IGNORECASE)) is not None and text[m.end() :].lower() == "qx zz7"
    missed = [r["text"] for r in found if stands(r["kind"], r["text"]) and not any(s["type"] == r["kind"] and s["value"].lower() == "qx zz7" for s in r["s"])]
    assert SPELLED.keys() == V.LABELS.keys() and missed == [] and sum(stands(*x) for x in rows) > 0.9 * len(rows)


def test_values_end_at_labels_that_lie_just_within_reach(spark):
    from pyspark.sql import functions as F

    from quillspark.operators import detect as D

    tails = ["x" * n + " Full" + " " * 90 + "Name: Bo" for n in range(40, 56)] + ["Email: a b " + "word " * 90 + "\nRe: z", "Name: Bo", "Notes: " + "n" * 290 + " Date: 1", "Notes: a\n" + "b " * 300 + "Phone: 12"]
    rows = spark.createDataFrame([("Name: Anna " + t,) for t in tails] + [("Note name and no label",)], "t string")
    whole, D.LABEL_REST = D.LABEL_REST, "(?s)^.*"  # the whole text
    try:
        want = [r.s for r in rows.select(D.field_labels(F.col("t")).alias("s")).collect()]
    finally:
        D.LABEL_REST = whole
    frame = rows.select(D.field_labels(F.col("t")).alias("s"))
    assert [r.s for r in frame.collect()] == want and want[0][0].value.startswith("Anna x") and want[-1] == []
    text = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "S{0,60}" in text  # labels that end values are not looked for in all of the text
