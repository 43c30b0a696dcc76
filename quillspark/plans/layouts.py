"""Queries over pages that are laid out from the documents' whole texts, each line in blocks of sixty characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import safety
from quillspark.plans.registry import query, table

#: Written once for both engines. A third of the documents have a letter's head, a third a labelled line, all a closing.
NAME = "'Anna ' || chr(CAST(65 + doc_id % 26 AS INT)) || 'illow'"
HEAD = f"{NAME} || chr(10) || doc_id || ' High Street' || chr(10) || 'Phone: 0' || (7000000000 + doc_id) || chr(10) || 'Dear all' || chr(10)"
TEXT = (
    f"CASE doc_id % 3 WHEN 0 THEN {HEAD} WHEN 1 THEN 'Email: u' || doc_id || '@mail.example' || chr(10) ELSE '' END || text || chr(10) || "
    f"'My son Tom ' || chr(CAST(65 + doc_id % 26 AS INT)) || 'illow, who is ' || doc_id % 17 || ', has asthma' || chr(10) || 'Yours sincerely' || chr(10) || {NAME}"
)
SURENESS = "0.35 + (doc_id * 37 % 60) / 100.0"
ALLOWED = "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN {a}'phone', 'email'{b} WHEN 2 THEN CAST({a}{b} AS {t}) ELSE {a}'person_name', 'address', 'medical_details', 'signature'{b} END"
WIDTH = 1000


def pages_and_words(spark, sf_dir: str):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").selectExpr("doc_id AS page", f"split({TEXT}, '\\n') AS lines", f"CAST({SURENESS} AS double) AS sureness", f"{ALLOWED.format(a='array(', b=')', t='array<string>')} AS allowed")
    pages = docs.select("page", F.lit(float(WIDTH)).alias("width"), (40.0 * F.size("lines") + 100).alias("height"), "sureness", "allowed")
    lines = docs.select("page", F.posexplode_outer("lines").alias("row", "line")).where("length(line) > 0")  # of a plain one Spark would make a filter, and cut all lines again
    blocks = lines.select("page", "row", F.posexplode_outer(F.regexp_extract_all("line", F.lit("(?s).{1,60}"), F.lit(0))).alias("j", "text")).where(F.col("text").rlike(r"\S"))
    x0, y0 = 610.0 * F.col("j"), 40.0 * F.col("row")
    words = blocks.select("page", (F.col("row") * 10000 + F.col("j")).alias("word_no"), "text", x0.alias("x0"), y0.alias("y0"), (x0 + 10 * F.length("text")).alias("x1"), (y0 + 20).alias("y1"))
    return words, pages




def _words(pattern: str) -> str:
    """The words of a pattern with boundaries of all scripts, for an engine whose own know ASCII only."""
    inner = pattern.removeprefix("(?iU)").removeprefix(r"\b").removesuffix(r"\b")
    return rf"(?i)(^|[^\pL\pM\pN_]){inner}($|[^\pL\pM\pN_])"


_BLOCKS = f"""
d AS (SELECT doc_id AS page, string_split({TEXT}, chr(10)) AS lines, ({SURENESS})::DOUBLE AS sureness, {ALLOWED.format(a="[", b="]", t="VARCHAR[]")} AS allowed FROM documents WHERE text IS NOT NULL),
p AS (SELECT page, {WIDTH} AS w, 40 * len(lines) + 100 AS h, sureness, allowed FROM d WHERE sureness < 0.90),
r AS (SELECT page, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS row FROM d SEMI JOIN p USING (page)),
c AS (SELECT page, row, line, unnest(range(0, (length(line) + 59) // 60)) AS j FROM r WHERE length(line) > 0),
b AS (SELECT page, row, j, substring(line, 60 * j + 1, 60) AS text, 610 * j AS x0, 610 * j + length(substring(line, 60 * j + 1, 60)) * 10 AS x1, 40 * row AS y0, 40 * row + 20 AS y1, w, h, sureness, allowed
      FROM c JOIN p USING (page) WHERE regexp_matches(substring(line, 60 * j + 1, 60), '\\S')),
l0 AS (SELECT page, row, any_value(w) AS w, any_value(h) AS h, any_value(sureness) AS sureness, any_value(allowed) AS allowed, string_agg(text, ' ' ORDER BY j) AS text, min(x0) AS x0, max(x1) AS x1, any_value(y0) AS y0, any_value(y1) AS y1,
       max(CASE WHEN trim(text) IN ('=', ':', '-') THEN x1 END) AS behind FROM b GROUP BY page, row),
l1 AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY row) - 1 AS n, count(*) OVER (PARTITION BY page) AS all_, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS bare, regexp_matches(text, '{_words(safety.DATES)}') AS dated,
       regexp_matches(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z|a-z]{{2,}}') AS mail,
       regexp_matches(text, '(\\+44\\s?\\(?0\\)?[\\s\\-]?)?(\\(0\\)[\\s\\-]?)?[1-9][0-9]{{0,4}}[\\s\\-]?[0-9\\s\\-]{{6,10}}([^0-9]|$)') AS tel, regexp_matches(text, '(?i)[A-Z]{{1,2}}[0-9][A-Z0-9]?\\s*[0-9][A-Z]{{2}}') AS post FROM l0),
l2 AS (SELECT *, mail OR tel OR post OR regexp_matches(text, '{_words(safety.V.ADDRESS_LINE)}') AS contact,
       len(list_filter(regexp_split_to_array(bare, '\\s+'), lambda x: trim(x, '.,;:') <> '')) BETWEEN 1 AND 4 AND length(bare) <= 45 AND NOT regexp_matches(bare, '\\d')
         AND len(list_filter(regexp_split_to_array(bare, '\\s+'), lambda x: trim(x, '.,;:') <> '' AND NOT regexp_matches(x, '[A-Za-z]'))) = 0 AND NOT regexp_matches(bare, '(?i)(sincerely\\s|dear\\s|born\\s|email:|phone:)') AS name_like,
       coalesce(min(CASE WHEN n < 14 AND regexp_matches(bare, '{_words(safety.CONTENT_STARTS)}') THEN n END) OVER (PARTITION BY page), least(8, all_)) AS lim FROM l1),
l3 AS (SELECT *, min(CASE WHEN n < lim AND regexp_matches(text, '{_words(safety.CONTACT_LABELS)}') THEN n END) OVER (PARTITION BY page) AS label FROM l2),
l4 AS (SELECT *, coalesce(label <= 10 AND n < label AND bare <> '' AND NOT dated, false) AS before FROM l3),
l5 AS (SELECT *, before AND length(bare) <= 70 AND (allowed IS NULL OR list_contains(allowed, 'address')) AND sum(before::INT) OVER (PARTITION BY page) >= 2 AND bool_or(before AND (contact OR name_like)) OVER (PARTITION BY page) AS sender,
       sureness < 0.5 AND n < 8 AND NOT dated AND n >= 3 AND NOT regexp_matches(text, '\\d') AND NOT mail AND x0 < w * 0.28 AND x1 - x0 < w * 0.35 AND y0 < h * 0.70 AS heading FROM l4),
l6 AS (SELECT *, min(CASE WHEN heading THEN n END) OVER (PARTITION BY page) AS head FROM l5),
l7 AS (SELECT *, coalesce(n > head AND n <= head + 3, false) AS under FROM l6),
l AS (SELECT *, min(CASE WHEN under AND y0 > h * 0.78 THEN n END) OVER (PARTITION BY page) AS ended FROM l7),
"""
_HAS = "(allowed IS NULL OR list_contains(allowed, '{}'))"
_ANY = "(allowed IS NULL OR len(allowed) = 0 OR list_contains(allowed, {}))"
_VALUES = " UNION ALL ".join(
    f"SELECT page, w, h, 'value' AS rule, x0 + (strpos(text, m) - 1) / length(text) * (x1 - x0) AS a, y0 AS t, x0 + (strpos(text, m) - 1 + length(m)) / length(text) * (x1 - x0) AS z, y1 AS u, 2 AS px, 2 AS py, 2 AS least "
    f"FROM (SELECT *, regexp_extract(text, '{pattern.replace('(?iU)', '(?i)').replace('(?U)', '')}') AS m FROM b) WHERE m <> '' AND {_ANY.format(repr(kind))}"
    for kind, pattern in safety.VALUES.items()
)
#: rule, then what the rectangle is made of: a, t, z, u (left, top, right, bottom), padding, and how wide a to z is at least.
SAFETY_SQL = f"""
WITH {_BLOCKS}
named AS (SELECT *, CASE WHEN mail THEN 'email' WHEN tel THEN 'phone' WHEN post THEN 'postcode' ELSE 'address' END AS kind FROM l),
head_ AS (SELECT page, w, h, 'header' AS rule, x0 AS a, y0 AS t, x1 AS z, y1 AS u, 4 AS px, 1 AS py, -9 AS least FROM named WHERE n < lim AND bare <> '' AND NOT dated AND
  CASE WHEN sender THEN true WHEN n <= 1 AND name_like THEN {_HAS.format("person_name")} WHEN contact THEN allowed IS NULL OR list_contains(allowed, kind) OR list_contains(allowed, 'address') ELSE false END),
trig AS (SELECT *, list_filter(list_transform(regexp_split_to_array(lower(text), '[\\s:,=\\-]+'), lambda x: map({list(safety.LABEL_TYPES)}, {list(safety.LABEL_TYPES.values())})[x]), lambda x: x IS NOT NULL)[1] AS kind,
  strpos(text, regexp_extract(text, '[=:\\-]')) / length(text) AS share FROM b WHERE regexp_matches(text, '{safety.LABELLED.replace('(?iU)', '(?i)')}')),
trig2 AS (SELECT t.*, x.x1 AS far FROM trig t JOIN l0 x USING (page, row) WHERE kind IS NOT NULL AND {_ANY.replace("allowed", "t.allowed").format("kind")}),
label_ AS (SELECT page, w, h, 'label' AS rule, CASE WHEN far > x1 + 5 THEN x1 ELSE x0 + share * (x1 - x0) END AS a, greatest(0, y0 - 3) AS t, CASE WHEN far > x1 + 5 THEN least(w, far + 5) ELSE least(w, x1 + 5) END AS z, least(h, y1 + 3) AS u, 1 AS px, 0 AS py,
  CASE WHEN far > x1 + 5 THEN -9 ELSE CASE WHEN x1 > floor(x0 + share * (x1 - x0)) + 4 THEN -9 ELSE 999999 END END AS least FROM trig2),
form_ AS (SELECT page, w, h, 'form' AS rule, greatest(0, least(w, coalesce(behind + 3, floor(x0 + 0.45 * (x1 - x0))))) AS a, greatest(0, y0 - 5) AS t, least(w, x1 + 8) AS z, least(h, y1 + 5) AS u, 0 AS px, 0 AS py, 10 AS least FROM l
    WHERE sureness < 0.5 AND n < 4 AND NOT dated AND NOT heading AND y0 < h * 0.55 AND (regexp_matches(text, '\\d') OR mail OR behind IS NOT NULL OR length(regexp_replace(lower(text), '[^\\pL\\pM\\pN_]+', '', 'g')) > 8)
  UNION ALL SELECT page, w, h, 'form', greatest(0, x0 - 8), greatest(0, y0 - 5), least(w, x1 + 8), least(h, y1 + 5), 0, 0, 10 FROM l WHERE under AND (ended IS NULL OR n < ended)),
dep AS (SELECT *, regexp_extract(text, '\\b(?i:(my|our|the)\\s+(son|daughter|child|children|stepson|stepdaughter|foster\\s+child|grandson|granddaughter)\\s*,?\\s+)[A-Z][a-zA-Z''-]{{1,24}}(\\s+[A-Z][a-zA-Z''-]{{1,24}}){{1,2}}') AS m FROM l),
dep2 AS (SELECT *, regexp_extract(m, '[A-Z][a-zA-Z''-]{{1,24}}(\\s+[A-Z][a-zA-Z''-]{{1,24}}){{1,2}}$') AS v FROM dep WHERE m <> '' AND {_HAS.format("person_name")}),
dep_ AS (SELECT page, w, h, 'dependent' AS rule, x0 + (strpos(text, m) - 1 + length(m) - length(v)) / length(text) * (x1 - x0) AS a, y0 AS t, x0 + (strpos(text, m) - 1 + length(m)) / length(text) * (x1 - x0) AS z, y1 AS u, 3 AS px, 3 AS py, 6 AS least
  FROM dep2 WHERE NOT regexp_matches(v, '(?i)\\b({"|".join(safety.V.DEPENDENT_STOP)})\\b')),
close_ AS (SELECT f.page, f.w, f.h, 'closing' AS rule, f.x0 AS a, f.y0 AS t, f.x1 AS z, f.y1 AS u, 6 AS px, 4 AS py, -9 AS least FROM l c JOIN l f ON f.page = c.page AND f.n BETWEEN c.n + 1 AND c.n + 3
  WHERE regexp_matches(c.text, '{_words(safety.CLOSINGS)}') AND (c.allowed IS NULL OR list_contains(c.allowed, 'signature') OR list_contains(c.allowed, 'person_name')) AND f.y0 - c.y1 <= 80 AND (f.name_like OR f.x1 - f.x0 < f.w * 0.45)),
sens_ AS (SELECT page, w, h, 'sensitive' AS rule, x0 AS a, y0 AS t, x1 AS z, y1 AS u, 4 AS px, 3 AS py, -9 AS least FROM b WHERE {_HAS.format("medical_details")} AND regexp_matches(text, '{_words(safety.SENSITIVE)}')),
parts AS (SELECT * FROM head_ UNION ALL SELECT * FROM label_ UNION ALL SELECT * FROM form_ UNION ALL {_VALUES} UNION ALL SELECT * FROM dep_ UNION ALL SELECT * FROM close_ UNION ALL SELECT * FROM sens_),
boxes AS (SELECT page, rule, greatest(0, floor(a) - px)::BIGINT AS x0, greatest(0, t - py)::BIGINT AS y0, least(w, floor(z) + px)::BIGINT AS x1, least(h, u + py)::BIGINT AS y1 FROM parts WHERE floor(z) > floor(a) + least)
"""
_KEPT = "x1 > x0 + 4 AND y1 > y0 + 4"


@query("safety_masks", f"{SAFETY_SQL} SELECT page, rule, x0, y0, x1, y1 FROM boxes WHERE {_KEPT}")
def safety_masks(spark, sf_dir):
    """The masks of every page by rule."""
    return safety.safety_masks(*pages_and_words(spark, sf_dir), "page")


#: The masked area by counting the cells of a grid of all edges, which needs no sweep.
AREA_SQL = f"""{SAFETY_SQL}, k AS (SELECT DISTINCT page, x0, y0, x1, y1 FROM boxes WHERE {_KEPT}),
xs AS (SELECT page, x AS x0, lead(x) OVER (PARTITION BY page ORDER BY x) AS x1 FROM (SELECT page, x0 AS x FROM k UNION SELECT page, x1 FROM k)),
ys AS (SELECT page, y AS y0, lead(y) OVER (PARTITION BY page ORDER BY y) AS y1 FROM (SELECT page, y0 AS y FROM k UNION SELECT page, y1 FROM k)),
cells AS (SELECT DISTINCT k.page, xs.x0, xs.x1, ys.y0, ys.y1 FROM k JOIN ys ON ys.page = k.page AND ys.y0 >= k.y0 AND ys.y1 <= k.y1 JOIN xs ON xs.page = k.page AND xs.x0 >= k.x0 AND xs.x1 <= k.x1)
SELECT page, sum((x1 - x0) * (y1 - y0))::BIGINT AS area FROM cells GROUP BY page"""


@query("safety_area", AREA_SQL)
def safety_area(spark, sf_dir):
    """How much of each page is masked, by rectangles that do not overlap."""
    found = safety.disjoint(safety.safety_masks(*pages_and_words(spark, sf_dir), "page"), "page")
    return found.groupBy("page").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
