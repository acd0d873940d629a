"""Queries of type on pages: lines of orders are spans of text, and texts of documents get the footers of forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import fonts
from dossier.plans.catalogue import register
from dossier.storage import read_table

_SPANS = """SELECT DISTINCT l_orderkey AS document_id, CAST(l_suppkey % 2 + 1 AS INT) AS page, l_partkey * 10 + l_linenumber AS span_no,
CASE l_partkey % 4 WHEN 0 THEN concat(CAST(CAST(floor(l_quantity) AS INT) AS STRING), '.50') WHEN 1 THEN concat('Fee ', CAST(l_linenumber AS STRING)) WHEN 2 THEN '1,234' ELSE '...' END AS text,
CASE l_partkey % 7 WHEN 0 THEN 'ABCDEF+Arial-BoldMT' WHEN 1 THEN 'GHIJKL+Arial-Bold' WHEN 2 THEN 'MNOPQR+ArialMT' WHEN 3 THEN 'Arial' WHEN 4 THEN 'STUVWX+Arial-BoldMT' WHEN 5 THEN 'GHIJKL+Helvetica' ELSE 'Comic Sans MS-Bold-6003' END AS font,
CAST(9 + l_partkey % 3 AS DOUBLE) AS size, l_suppkey % 8 * CAST(50 AS DOUBLE) + l_linenumber AS x0, l_suppkey % 8 * CAST(50 AS DOUBLE) + l_linenumber + 40 AS x1,
l_partkey % 6 * CAST(11 AS DOUBLE) + l_linenumber AS y0, l_partkey % 6 * CAST(11 AS DOUBLE) + l_linenumber + 10 AS y1, l_partkey % 6 * CAST(11 AS DOUBLE) + l_linenumber + 8 AS baseline FROM lineitem"""
_ONE = "one AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY document_id, page, span_no ORDER BY x0, y0, font) = 1)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by document, page and number; of repeated numbers the first from the left."""
    read_table(spark, sf_dir, "lineitem").createOrReplaceTempView("font_lines")
    rows = spark.sql(_SPANS.replace("FROM lineitem", "FROM font_lines"))
    first = rows.groupBy("document_id", "page", "span_no").agg(F.min(F.struct("x0", "y0", "font", "text", "size", "x1", "y1", "baseline")).alias("s"))
    return first.select("document_id", "page", "span_no", "s.*")


_DUCK = f"spans AS ({_SPANS.replace('AS STRING', 'AS VARCHAR')}), {_ONE}"


@register(
    f"""WITH {_DUCK},
told AS (SELECT *, font[1:6] AS tag, font LIKE '%Bold%' AS bold FROM one WHERE font LIKE '%+%' AND text <> '...'),
copies AS (SELECT document_id, page, bold, tag, sum(length(text)) AS chars, bool_and(NOT regexp_matches(text, '[A-Za-z]')) AS digits_only FROM told GROUP BY ALL),
mains AS (SELECT document_id, page, bold, tag AS main_tag FROM copies QUALIFY count(*) OVER (PARTITION BY document_id, page, bold) > 1 AND row_number() OVER (PARTITION BY document_id, page, bold ORDER BY chars DESC, tag) = 1),
sides AS (SELECT t.*, main_tag, digits_only FROM told t JOIN mains USING (document_id, page, bold) JOIN copies USING (document_id, page, bold, tag)),
pairs AS (SELECT a.document_id, a.page, a.span_no, b.span_no AS o_no, b.text AS o_text, least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 5 AS same_row,
  regexp_matches(a.text, '^[0-9]+\\.[0-9]{{2}}$|^1,234$') AND regexp_matches(b.text, '^[0-9]+\\.[0-9]{{2}}$|^1,234$') AND (abs(a.x0 - b.x0) <= 2 OR abs(a.x1 - b.x1) <= 2) AS same_column
  FROM sides a JOIN sides b USING (document_id, page, bold) WHERE a.tag <> a.main_tag AND b.tag = b.main_tag),
met AS (SELECT document_id, page, span_no, arg_min(o_text, o_no) FILTER (WHERE same_row) AS row_text, arg_min(o_text, o_no) FILTER (WHERE same_column AND NOT same_row) AS column_text FROM pairs GROUP BY ALL)
SELECT document_id, page, span_no, text, tag AS subset, main_tag AS main_subset, digits_only, row_text, column_text FROM sides LEFT JOIN met USING (document_id, page, span_no)
WHERE tag <> main_tag AND (row_text IS NOT NULL OR column_text IS NOT NULL OR (digits_only AND text NOT LIKE 'Fee%'))"""
)
def font_subset_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fonts.font_subset_split(_spans(spark, sf_dir))


@register(
    f"""WITH {_DUCK},
gaps AS (SELECT *, CASE WHEN baseline - lag(baseline) OVER (PARTITION BY document_id, page ORDER BY baseline, span_no) > 2 THEN 1 ELSE 0 END AS fresh FROM one),
placed AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id, page ORDER BY baseline, span_no ROWS UNBOUNDED PRECEDING) AS row_no, font LIKE '%-6003' AS converted FROM gaps),
near AS (SELECT a.document_id, a.page, a.span_no, a.text, a.font, b.span_no AS peer_no, b.font AS peer_font FROM placed a JOIN placed b USING (document_id, page, row_no) WHERE NOT a.converted AND b.converted AND greatest(a.size, b.size) / least(a.size, b.size) <= 1.15::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY a.document_id, a.page, a.span_no ORDER BY least(abs(b.x0 - a.x1), abs(a.x0 - b.x1)), b.baseline, b.span_no) = 1)
SELECT *, count(*) OVER (PARTITION BY document_id, page, font) AS words_in_this_font FROM near"""
)
def converted_scan_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fonts.converted_scan_runs(_spans(spark, sf_dir))


_LINE = "concat('No. ', CAST(o_orderkey * 37 AS STRING), ' total ', CAST(CAST(floor(o_totalprice) AS INT) AS STRING), ',00 x', CAST(o_custkey AS STRING))"


@register(
    f"""WITH chars AS (SELECT o_orderkey AS document_id, unnest(string_split({_LINE.replace("STRING", "VARCHAR")}, '')) AS ch, unnest(range(length({_LINE.replace("STRING", "VARCHAR")}))) AS char_no FROM orders),
sized AS (SELECT *, 10 + (CASE WHEN (char_no * 7 + document_id) % 23 = 0 THEN 0.2 ELSE 0 END)::DOUBLE AS size FROM chars),
cut AS (SELECT *, sum(CASE WHEN ch = ' ' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY char_no) AS token FROM sized),
tokens AS (SELECT document_id, min(char_no) AS first_char, string_agg(ch, '' ORDER BY char_no) AS text, min(size) AS smallest, max(size) AS largest FROM cut WHERE ch <> ' ' GROUP BY document_id, token)
SELECT document_id, CAST(1 AS INT) AS page, CAST(1 AS INT) AS line_no, CAST(first_char AS INT) AS first_char, text, smallest, largest FROM tokens WHERE regexp_full_match(text, '[0-9][0-9.,/:-]*[0-9]|[0-9]') AND largest > smallest"""
)
def number_size_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of each order, some of whose characters are a fifth of a point larger."""
    line = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.posexplode(F.split(F.expr(_LINE), "")).alias("char_no", "ch")).filter("ch <> ''")
    size = 10 + F.when((F.col("char_no") * 7 + F.col("document_id")) % 23 == 0, 0.2).otherwise(0.0)
    return fonts.number_size_steps(line.select("document_id", F.lit(1).alias("page"), F.lit(1).alias("line_no"), "char_no", "ch", size.alias("size")))


_FOOTER = """concat(CASE doc_id % 4 WHEN 0 THEN 'REV. NO 3 ' WHEN 1 THEN 'Issue No 2 form AB-12 ' ELSE '' END, substr(coalesce(text, ''), 1, CAST(doc_id % 5 * 90 AS INT)), ' Date of Issue - ', CAST(doc_id % 31 + 1 AS STRING), '.', CAST(doc_id % 13 + 1 AS STRING), '.', CASE WHEN doc_id % 2 = 0 THEN '2021' ELSE '21' END,
' ', substr(coalesce(text, ''), 1, CAST(doc_id % 7 * 50 AS INT)), CASE doc_id % 3 WHEN 0 THEN ' Document # 7' WHEN 1 THEN ' REVISION' ELSE '' END, ' ', coalesce(text, ''))"""


@register(
    f"""WITH t AS (SELECT doc_id AS document_id, {_FOOTER.replace("STRING", "VARCHAR")} AS t FROM documents),
p AS (SELECT *, strpos(t, 'Date of Issue - ') AS pos, regexp_extract(t, 'Date of Issue - ([0-9]+\\.[0-9]+\\.[0-9]+)', 1) AS raw FROM t),
w AS (SELECT *, substr(t, greatest(pos - 200, 1), CAST(pos - greatest(pos - 200, 1) + 16 + length(raw) + 200 AS BIGINT)) AS w FROM p),
d AS (SELECT document_id, pos - 1 AS place, raw AS raw_text, CASE WHEN regexp_matches(w, '(?i)\\brev(ision)?\\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(w, '(?i)\\bissue\\s*no\\b') THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(w, '(?i)\\b(doc(ument)?|form)\\s*(no\\b|#|[a-z]{{1,4}}\\s*-)') THEN 1 ELSE 0 END AS kinds, string_split(raw, '.') AS f FROM w)
SELECT document_id, place, CAST(TRY_CAST((CASE WHEN length(f[3]) = 2 THEN '20' ELSE '' END) || f[3] || '-' || lpad(f[2], 2, '0') || '-' || lpad(f[1], 2, '0') AS DATE) AS VARCHAR) AS value, raw_text FROM d
WHERE kinds >= 2 AND TRY_CAST((CASE WHEN length(f[3]) = 2 THEN '20' ELSE '' END) || f[3] || '-' || lpad(f[2], 2, '0') || '-' || lpad(f[1], 2, '0') AS DATE) IS NOT NULL"""
)
def fn_template_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts with the footer of a form in front, whose markers are near the date or far from it."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.expr(_FOOTER).alias("text"))
    return fonts.template_dates(docs)
