"""Queries of identity cases: orders are documents of a customer's case, and say who the customer is, each a little differently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossier.functions import text as fn
from dossier.operators import contradictions
from dossier.plans.catalogue import register
from dossier.storage import read_table


def _pick(values: list[str], key: str) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_FIRST, _LAST = ["Mohammad", "Ramesh", "Seema", "Shweta", "Vikram", "Lakshmi"], ["Agarwal", "Sharma", "Verma", "Khan", "Gupta"]
_NAME = f"""CASE o_orderkey % 9 WHEN 1 THEN concat('Mr. ', f, ' ', l) WHEN 2 THEN concat(l, ' ', f) WHEN 3 THEN concat(substr(f, 1, 1), ' ', l) WHEN 4 THEN concat(f, ' Kumar ', l) WHEN 5 THEN f
WHEN 6 THEN concat(f, ' ', replace(replace(l, 'Agarwal', 'Agrawal'), 'Verma', 'Varma')) WHEN 7 THEN concat({_pick(_FIRST[1:] + _FIRST[:1], "o_custkey")}, ' ', l) WHEN 8 THEN concat(replace(replace(f, 'Mohammad', 'Mohd'), 'Shweta', 'Sweta'), ' ', l) ELSE concat(f, ' ', l) END"""
_BIRTH = "CASE o_orderkey % 5 WHEN 2 THEN concat('1980-', lpad(CAST(d AS STRING), 2, '0'), '-', lpad(CAST(m AS STRING), 2, '0')) WHEN 3 THEN concat('1981-', lpad(CAST(m AS STRING), 2, '0'), '-', lpad(CAST(d AS STRING), 2, '0')) WHEN 4 THEN concat('1980-', lpad(CAST(m AS STRING), 2, '0'), '-', lpad(CAST(d + o_orderkey % 7 AS STRING), 2, '0')) ELSE concat('1980-', lpad(CAST(m AS STRING), 2, '0'), '-', lpad(CAST(d AS STRING), 2, '0')) END"
_INCOME = "CASE o_orderkey % 6 WHEN 1 THEN CAST(base + 3 AS STRING) WHEN 2 THEN CAST(base + base DIV_BY 10 AS STRING) WHEN 3 THEN CAST(base + base DIV_BY 2 AS STRING) WHEN 4 THEN CAST(base * 3 AS STRING) WHEN 5 THEN NULL ELSE CAST(base AS STRING) END"
_NUMBER = "CASE WHEN o_orderkey % 4 = 0 THEN concat('XXXX-XX', right(digits, 2)) WHEN o_orderkey % 7 = 0 THEN concat(substr(digits, 1, 4), ' 99', right(digits, 2)) ELSE concat(substr(digits, 1, 4), ' ', substr(digits, 5)) END"
_SAID = f"""WITH base AS (SELECT o_orderkey, o_custkey, o_orderpriority, {_pick(_FIRST, "o_custkey")} AS f, {_pick(_LAST, "o_custkey")} AS l, o_custkey % 11 + 1 AS m, o_custkey % 12 + 1 AS d, 10000 + o_custkey * 10 AS base, lpad(CAST(o_custkey * 7919 + 10000000 AS STRING), 8, '0') AS digits FROM orders),
said AS (SELECT o_custkey AS case_id, o_orderkey AS document_id, o_orderpriority AS document_type, CAST(NULL AS STRING) AS currency, o_orderkey % 17 = 0 AS uncertain, 'full_name' AS field, {_NAME} AS value FROM base
UNION ALL SELECT o_custkey, o_orderkey, o_orderpriority, NULL, o_orderkey % 17 = 0, 'date_of_birth', {_BIRTH} FROM base
UNION ALL SELECT o_custkey, o_orderkey, o_orderpriority, NULL, o_orderkey % 17 = 0, 'gender', CASE WHEN (o_custkey % 2 = 0) = (o_orderkey % 11 = 0) THEN 'male' ELSE 'female' END FROM base
UNION ALL SELECT o_custkey, o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 13 = 0 THEN 'USD' WHEN o_orderkey % 13 < 9 THEN 'INR' END, o_orderkey % 17 = 0, 'annual_income', {_INCOME} FROM base
UNION ALL SELECT o_custkey, o_orderkey, o_orderpriority, NULL, o_orderkey % 17 = 0, 'id_number', {_NUMBER} FROM base)"""

_FULL = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fn.SHORT_FORMS.items()) + " ELSE t END"
_KEY = "CASE u " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fn.SAME_NAMES.items()) + " ELSE u END"
for _group, _letter in fn.SOUNDS:
    _KEY = f"replace({_KEY}, '{_group}', '{_letter}')"
_NO_DOUBLES = "array_to_string(list_filter(string_split(regexp_replace(k, 'y$', 'i'), ''), lambda c, i: i = 1 OR c <> string_split(regexp_replace(k, 'y$', 'i'), '')[i - 1]), '')"
#: Pairs of name parts, strongest relation first, are taken one at a time by recursion; all else is a case by case table.
_JUDGED = f"""classes AS (SELECT case_id, field, CASE WHEN field = 'id_number' THEN document_type ELSE '' END AS type, value, coalesce(currency, '') AS currency, uncertain, count(DISTINCT document_id) AS n, min(document_id) AS document FROM said WHERE value <> '' GROUP BY ALL),
met AS (SELECT a.case_id, a.field, a.value AS value_a, b.value AS value_b, a.currency AS currency_a, b.currency AS currency_b, a.uncertain OR b.uncertain AS uncertain, a.n AS n_a, b.n AS n_b, a.document AS document_a, b.document AS document_b
  FROM classes a JOIN classes b ON a.case_id = b.case_id AND a.field = b.field AND a.type = b.type AND a.value < b.value),
names AS (SELECT DISTINCT value_a, value_b, list_filter(regexp_extract_all(lower(value_a), '[a-z]+'), lambda x: x <> 'mr') AS ta, list_filter(regexp_extract_all(lower(value_b), '[a-z]+'), lambda x: x <> 'mr') AS tb FROM met WHERE field = 'full_name'),
parts AS (SELECT t, f, {_NO_DOUBLES} AS s FROM (SELECT t, u AS f, {_KEY} AS k FROM (SELECT t, {_FULL} AS u FROM (SELECT DISTINCT unnest(ta || tb) AS t FROM names)))),
own AS (SELECT t, {_NO_DOUBLES} AS o FROM (SELECT t, {_KEY.replace(" u ", " t ").replace("ELSE u", "ELSE t")} AS k FROM (SELECT DISTINCT t FROM parts))),
cells AS (SELECT value_a, value_b, x.i AS i, y.j AS j, x.t AS a, y.t AS b FROM (SELECT value_a, value_b, unnest(ta) AS t, generate_subscripts(ta, 1) AS i FROM names) x JOIN (SELECT value_a, value_b, unnest(tb) AS t, generate_subscripts(tb, 1) AS j FROM names) y USING (value_a, value_b)),
slips AS (SELECT DISTINCT a, b, least(length(a), length(b)) >= 5 AND oa.o[1] = ob.o[1] AND (CASE WHEN length(oa.o) <> length(ob.o) THEN levenshtein(oa.o, ob.o) = 1
   WHEN hamming(oa.o, ob.o) = 1 THEN len(list_filter(range(1, length(oa.o) + 1), lambda p: oa.o[p] <> ob.o[p] AND NOT (oa.o[p] IN ('a', 'e', 'i', 'o', 'u') AND ob.o[p] IN ('a', 'e', 'i', 'o', 'u')))) = 0
   ELSE hamming(oa.o, ob.o) = 2 AND damerau_levenshtein(oa.o, ob.o) = 1 END) AS slip FROM (SELECT DISTINCT a, b FROM cells) JOIN own oa ON oa.t = a JOIN own ob ON ob.t = b WHERE length(oa.o) > 0 AND length(ob.o) > 0),
related AS (SELECT value_a, value_b, {{'level': CASE WHEN a = b THEN 0 WHEN pa.s = pb.s THEN CASE WHEN pa.f <> a OR pb.f <> b THEN 1 ELSE 2 END WHEN length(a) = 1 OR length(b) = 1 THEN CASE WHEN starts_with(a, b) OR starts_with(b, a) THEN 3 END WHEN slip THEN 4 END, 'i': i, 'j': j}} AS p
  FROM cells JOIN parts pa ON pa.t = a JOIN parts pb ON pb.t = b JOIN slips USING (a, b)),
steps AS (SELECT value_a, value_b, list(p ORDER BY p) FILTER (WHERE p.level IS NOT NULL) AS rest, CAST([] AS INT[]) AS levels FROM related GROUP BY 1, 2
  UNION ALL SELECT value_a, value_b, list_filter(rest, lambda q: q.i <> rest[1].i AND q.j <> rest[1].j), list_append(levels, rest[1].level) FROM steps WHERE len(rest) > 0),
matched AS (SELECT value_a, value_b, levels, len(ta) - len(levels) AS ea, len(tb) - len(levels) AS eb FROM steps JOIN names USING (value_a, value_b) WHERE rest IS NULL OR len(rest) = 0),
named AS (SELECT value_a, value_b, CASE WHEN ea > 0 AND eb > 0 THEN 'conflict:different_name:critical' WHEN 4 IN levels THEN 'conflict:possible_spelling_error:medium' WHEN ea + eb > 0 AND len(levels) < 2 THEN 'conflict:partial_name:low'
  WHEN 3 IN levels THEN 'harmless:initials:info' WHEN 1 IN levels THEN 'harmless:abbreviation:info' WHEN ea + eb > 0 THEN 'harmless:extra_middle_name:info' WHEN 2 IN levels THEN 'harmless:spelling_variant:info' ELSE 'harmless:honorific_or_word_order:info' END AS v FROM matched),
judged AS (SELECT met.*, CASE field WHEN 'full_name' THEN v WHEN 'gender' THEN 'conflict:gender_difference:high'
  WHEN 'date_of_birth' THEN CASE WHEN value_a[1:4] <> value_b[1:4] THEN 'conflict:date_year_difference:high' WHEN value_a[6:7] = value_b[9:10] AND value_b[6:7] = value_a[9:10] THEN 'conflict:date_day_month_swapped:low' WHEN hamming(value_a, value_b) = 1 THEN 'conflict:date_minor_difference:medium' ELSE 'conflict:date_difference:high' END
  WHEN 'annual_income' THEN CASE WHEN currency_a <> '' AND currency_b <> '' AND currency_a <> currency_b THEN NULL ELSE (SELECT CASE WHEN r <= 1.01::DOUBLE THEN NULL WHEN r >= 2 THEN 'conflict:income_difference:critical' WHEN r >= 1.25::DOUBLE THEN 'conflict:income_difference:high' ELSE 'conflict:income_difference:medium' END
    FROM (SELECT greatest(TRY_CAST(value_a AS DOUBLE), TRY_CAST(value_b AS DOUBLE)) / least(TRY_CAST(value_a AS DOUBLE), TRY_CAST(value_b AS DOUBLE)) AS r)) END
  WHEN 'id_number' THEN CASE WHEN len(list_filter(range(1, 9), lambda p: regexp_replace(value_a, '[ -]', '', 'g')[p] <> regexp_replace(value_b, '[ -]', '', 'g')[p] AND regexp_replace(value_a, '[ -]', '', 'g')[p] <> 'X' AND regexp_replace(value_b, '[ -]', '', 'g')[p] <> 'X')) > 0 THEN 'conflict:id_number_difference:high' END END AS v
  FROM met LEFT JOIN named USING (value_a, value_b))"""


@register(
    f"""{_SAID.replace("WITH base", "WITH RECURSIVE base").replace("AS STRING", "AS VARCHAR").replace("DIV_BY", "//")}, {_JUDGED}
SELECT case_id, field, value_a, value_b, uncertain, n_a, n_b, document_a, document_b, split_part(v, ':', 1) AS classification, CASE WHEN uncertain AND split_part(v, ':', 3) IN ('high', 'critical') THEN 'unclear_reading' ELSE split_part(v, ':', 2) END AS reason,
CASE WHEN uncertain AND split_part(v, ':', 3) IN ('high', 'critical') THEN 'medium' ELSE split_part(v, ':', 3) END AS severity, CASE WHEN uncertain AND split_part(v, ':', 3) IN ('high', 'critical') THEN split_part(v, ':', 2) END AS was_reason,
CASE WHEN uncertain AND split_part(v, ':', 3) IN ('high', 'critical') THEN split_part(v, ':', 3) END AS was_severity FROM judged WHERE v IS NOT NULL"""
)
def identity_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_table(spark, sf_dir, "orders").createOrReplaceTempView("identity_orders")
    said = spark.sql(_SAID.replace("FROM orders", "FROM identity_orders").replace("DIV_BY", "DIV") + " SELECT * FROM said")
    return contradictions.identity_contradictions(said)
