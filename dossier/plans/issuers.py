"""Queries of fuzzy names, issuers and stamps: parts are documents and registry entries, their names are issuers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import fuzzy
from dossier.operators import issuers
from dossier.plans.catalogue import register
from dossier.storage import read_table

_ISSUER = """CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN concat(upper(p_name), ' (R)') WHEN 2 THEN concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1))
WHEN 3 THEN concat(p_name, ' tradingO llc') WHEN 4 THEN replace(p_name, 'e', '') WHEN 6 THEN concat('unknown house ', CAST(p_size AS STRING)) WHEN 7 THEN concat(p_name, '-', p_type, ', ', p_brand) END"""
_TYPE = "CASE p_type WHEN 'ECONOMY' THEN 'vendor_invoice' WHEN 'SMALL' THEN 'school_document' END"
_COUNTRY = "CASE p_size % 4 WHEN 0 THEN 'AE' WHEN 1 THEN 'SA' END"
_KIND = "CASE p_partkey % 5 WHEN 0 THEN 'vendor' WHEN 1 THEN 'school' ELSE 'other' END"
_STAMP = "CASE p_partkey % 6 WHEN 0 THEN concat(upper(p_name), ' P.O. Box Dubai') WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN '' WHEN 3 THEN concat('intl ', p_name) WHEN 4 THEN 'Abu Dhabi 123' ELSE concat(p_brand, ' ', p_type) END"


def _sql(expression: str) -> str:
    return expression.replace("AS STRING", "AS VARCHAR")


def _lcs(a: str, b: str) -> str:
    """Longest common subsequence: a fold over the places of b's characters in a, as bits."""
    masks = f"list_transform(string_split({b}, ''), lambda c: list_sum(list_transform(range(length({a})), lambda i: CASE WHEN substr({a}, CAST(i AS INT) + 1, 1) = c THEN 1::BIGINT << CAST(i AS INT) ELSE 0::BIGINT END))::BIGINT)"
    full = f"((1::BIGINT << length({a})) - 1)"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count(list_reduce({masks}, lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full}, {full})) END"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * ({_lcs(a, b)}) / (length({a}) + length({b})) END"


def _partial(short: str, long: str) -> str:
    window = f"substr({long}, CAST(greatest(w, 0) AS INT) + 1, CAST(length({short}) + least(w, 0) AS INT))"
    return f"CASE WHEN {short} = '' THEN 0.0::DOUBLE ELSE list_max(list_transform(range(1 - length({short}), length({long})), lambda w: {_ratio(short, window)})) END"


def scores_sql(pairs: str) -> str:
    """CTEs ending in ``scored`` (x, y, rx, ry, token_set, weighted and more) of the distinct texts x and y of ``pairs``."""
    clean = lambda c: f"trim(lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g')))"
    words = lambda c: f"list_filter(string_split({c}, ' '), lambda t: t <> '')"
    join = lambda w: f"array_to_string({w}, ' ')"
    either = lambda f, a, b: f"CASE WHEN length({a}) < length({b}) THEN {f(a, b)} WHEN length({a}) > length({b}) THEN {f(b, a)} ELSE greatest({f(a, b)}, {f(b, a)}) END"
    return f"""given AS ({pairs}),
plain AS (SELECT DISTINCT x AS rx, y AS ry, {clean("x")} AS x, {clean("y")} AS y FROM given),
worded AS (SELECT *, {words("x")} AS wx, {words("y")} AS wy FROM plain),
sets AS (SELECT rx, ry, x, y, {join("list_sort(wx)")} AS sx, {join("list_sort(wy)")} AS sy, {join("list_sort(list_distinct(list_intersect(wx, wy)))")} AS both_words,
  {join("list_sort(list_distinct(list_filter(wx, lambda t: NOT list_contains(wy, t))))")} AS ox, {join("list_sort(list_distinct(list_filter(wy, lambda t: NOT list_contains(wx, t))))")} AS oy FROM worded),
parts AS (SELECT *, {_ratio("x", "y")} AS ratio, {_ratio("sx", "sy")} AS token_sort, {either(_partial, "x", "y")} AS partial,
  CASE WHEN both_words <> '' THEN 100.0::DOUBLE ELSE greatest({either(_partial, "sx", "sy")}, {either(_partial, "ox", "oy")}) END AS partial_token,
  length(both_words) AS s, CASE WHEN both_words = '' THEN 0 ELSE 1 END AS gap, length(ox) AS lx, length(oy) AS ly, {_lcs("ox", "oy")} AS lc,
  greatest(length(x), length(y)) / greatest(least(length(x), length(y)), 1)::DOUBLE AS longer FROM sets),
setted AS (SELECT *, CASE WHEN sx = '' OR sy = '' THEN 0.0::DOUBLE WHEN gap = 1 AND (lx = 0 OR ly = 0) THEN 100.0::DOUBLE ELSE greatest(100.0::DOUBLE - 100.0::DOUBLE * (lx + ly - 2 * lc) / (2 * (s + gap) + lx + ly),
  CASE WHEN gap = 1 THEN greatest(100.0::DOUBLE - 100.0::DOUBLE * (1 + lx) / (2 * s + 1 + lx), 100.0::DOUBLE - 100.0::DOUBLE * (1 + ly) / (2 * s + 1 + ly)) ELSE 0.0::DOUBLE END) END AS token_set FROM parts),
scored AS (SELECT rx, ry, ratio, partial, token_set, CASE WHEN x = '' OR y = '' THEN 0.0::DOUBLE WHEN longer < 1.5 THEN greatest(ratio, 0.95::DOUBLE * greatest(token_sort, token_set))
  ELSE greatest(ratio, CASE WHEN longer <= 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END * greatest(partial, 0.95::DOUBLE * partial_token)) END AS weighted FROM setted)"""


@register(f"WITH {scores_sql('SELECT p_name AS x, p_type AS y FROM part UNION SELECT p_name, p_brand FROM part UNION SELECT concat(p_type, p_name), p_name FROM part')} SELECT rx AS a, ry AS b, round(ratio, 6) AS ratio, round(partial, 6) AS partial, round(token_set, 6) AS token_set, round(weighted, 6) AS weighted FROM scored")
def fn_fuzzy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four scores of every pair of texts that a part shows."""
    part = read_table(spark, sf_dir, "part")
    pairs = part.select(F.explode(F.array(F.struct(F.col("p_name").alias("a"), F.col("p_type").alias("b")), F.struct(F.col("p_name").alias("a"), F.col("p_brand").alias("b")), F.struct(F.concat("p_type", "p_name").alias("a"), F.col("p_name").alias("b")))).alias("p")).select("p.*").distinct()
    score = lambda kind: F.round(fuzzy.score_column(kind, F.col("a"), F.col("b")), 6)
    return pairs.select("a", "b", score("ratio").alias("ratio"), score("partial").alias("partial"), score("token_set").alias("token_set"), score("weighted").alias("weighted"))


_VARIANTS = "list_distinct([trim(issuer), trim(regexp_replace(regexp_replace(regexp_replace(issuer, '\\((R|TM|C)\\)', ' ', 'g'), '(^|\\s)(trading)O(\\s|$)', '\\1\\2\\3', 'g'), '\\s+', ' ', 'g'))])"
_MET = f"""docs AS (SELECT p_partkey AS document_id, p_size % 5 AS company_id, {_sql(_ISSUER)} AS issuer, {_TYPE} AS document_type, {_COUNTRY} AS country FROM part),
registry AS (SELECT p_size % 5 AS company_id, p_name AS name, {_KIND} AS kind, {_COUNTRY} AS country FROM part WHERE p_partkey % 3 = 0 AND p_size % 5 <> 4 AND p_retailprice < 1000),
variants AS (SELECT company_id, issuer, unnest({_VARIANTS}) AS x FROM (SELECT DISTINCT company_id, issuer FROM docs WHERE issuer IS NOT NULL)),
met AS (SELECT DISTINCT v.company_id, issuer, x, name AS y FROM variants v JOIN registry r USING (company_id))"""


@register(
    f"""WITH {_MET}, {scores_sql("SELECT DISTINCT x, y FROM met")},
best AS (SELECT company_id, issuer, ry AS name, weighted AS score FROM met JOIN scored ON x = rx AND y = ry QUALIFY row_number() OVER (PARTITION BY company_id, issuer ORDER BY round(weighted, 7) DESC, ry) = 1),
known AS (SELECT DISTINCT document_id FROM docs d JOIN registry r USING (company_id) WHERE (document_type IS NULL OR kind IN ('other', split_part(document_type, '_', 1))) AND (d.country IS NULL OR r.country IS NULL OR d.country = r.country))
SELECT document_id, CASE WHEN score >= 85 THEN 'pass' WHEN document_id IN (SELECT document_id FROM known) THEN 'flag' ELSE 'not_checked' END AS result, name AS matched_name, round(score, 2) AS score
FROM docs LEFT JOIN best USING (company_id, issuer)"""
)
def issuer_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed issuers, with the slips that recognition makes, against the registries of five companies, one of them empty."""
    part = read_table(spark, sf_dir, "part")
    documents = part.select(F.col("p_partkey").alias("document_id"), (F.col("p_size") % 5).alias("company_id"), F.expr(_ISSUER).alias("issuer"), F.expr(_TYPE).alias("document_type"), F.expr(_COUNTRY).alias("country"))
    registry = part.filter("p_partkey % 3 = 0 AND p_size % 5 <> 4").select((F.col("p_size") % 5).alias("company_id"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("name_arabic"), F.expr(_KIND).alias("kind"), F.expr(_COUNTRY).alias("country"), (F.col("p_retailprice") < 1000).alias("is_active"))
    return issuers.issuer_verification(documents, registry)


_STAMP_WORDS = "array_to_string(list_filter(list_transform(regexp_extract_all(lower({}), '[a-z]+(\\.[a-z]+)*'), lambda w: CASE w WHEN 'intl' THEN 'international' ELSE w END), lambda w: length(w) > 1 AND w NOT IN ('po', 'box', 'dubai', 'abu', 'dhabi', 'llc')), ' ')"


@register(
    f"""WITH docs AS (SELECT p_partkey AS document_id, {_sql(_ISSUER)} AS issuer, {_STAMP} AS stamp FROM part),
texts AS (SELECT document_id, stamp, {_STAMP_WORDS.format("stamp")} AS x, {_STAMP_WORDS.format("issuer")} AS y FROM docs WHERE stamp <> '' AND issuer <> ''),
{scores_sql("SELECT DISTINCT x, y FROM texts WHERE x <> '' AND y <> ''")}
SELECT document_id, CASE WHEN token_set IS NULL THEN 'skipped' WHEN token_set >= 80 THEN 'pass' ELSE 'flag' END AS status, CASE WHEN token_set IS NOT NULL THEN stamp END AS stamp, round(token_set, 1) AS score
FROM docs LEFT JOIN (SELECT document_id, token_set FROM texts JOIN scored ON x = rx AND y = ry) USING (document_id)"""
)
def chk_stamp_issuer(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    documents = part.select(F.col("p_partkey").alias("document_id"), F.expr(_ISSUER).alias("issuer"))
    return issuers.stamp_issuer(part.select(F.col("p_partkey").alias("document_id"), F.expr(_STAMP).alias("text")), documents)
