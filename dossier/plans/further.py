"""Registered queries of the built-in rules, profiles, repeated submissions, votes and further field checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import evidence, field_checks, profiles, rule_pack as pack
from dossier.plans.catalogue import register
from dossier.plans.rules import owned_documents
from dossier.plans.tables import documents, plain_lines
from dossier.storage import read_table


def _sql_list(values: list | None) -> str:
    return "NULL" if values is None else f"[{', '.join(repr(v) for v in values)}]"


_FINDINGS = sorted({(c, n) for _, c, names, _, _ in pack.FINDING_RULES for n in names})
_PACK = ", ".join(f"('{r}', '{k}', {'NULL' if c is None else repr(c)}, {_sql_list(n)}, {_sql_list(s)}, {w})" for r, k, c, n, s, w, _ in pack.rule_rows())
_FIELDS = [n for _, n, _ in pack.FIELD_RULES]
_CONFLICTS = sorted({f for _, f, _, _ in pack.CONFLICT_RULES})
_SIGNED = [v for _, v, _ in pack.SIGNATURE_RULES]
_SEVERITIES = ["low", "medium", "high", "critical"]


@register(
    f"""WITH rules(rule_id, kind, check_type, names, severities, weight) AS (VALUES {_PACK}),
d AS (SELECT c_nationkey AS company_id, c_custkey AS case_id, o_orderkey AS document_id, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey),
li AS (SELECT d.*, l_partkey, l_suppkey, l_linenumber FROM lineitem JOIN d ON document_id = l_orderkey),
e AS (
  SELECT company_id, case_id, document_id, 'finding' AS kind, {_sql_list([c for c, _ in _FINDINGS])}[1 + l_partkey % {len(_FINDINGS)}] AS check_type,
    {_sql_list([n for _, n in _FINDINGS])}[1 + l_partkey % {len(_FINDINGS)}] AS name, {_sql_list(_SEVERITIES)}[1 + l_suppkey % 4] AS severity FROM li
  UNION ALL SELECT company_id, case_id, document_id, 'sub_check', 'field_validation', {_sql_list(_FIELDS)}[1 + l_partkey % {len(_FIELDS)}], 'flag' FROM li WHERE l_suppkey % 2 = 0
  UNION ALL SELECT company_id, case_id, document_id, 'check_result', CASE WHEN document_id % 2 = 0 THEN 'issuer_verification' ELSE 'signature_stamp_detection' END, CASE WHEN o_orderstatus = 'O' THEN 'flag' ELSE 'pass' END, NULL FROM d
  UNION ALL SELECT company_id, case_id, NULL, 'cross_document', NULL, {_sql_list(_CONFLICTS)}[1 + document_id % {len(_CONFLICTS)}], {_sql_list(_SEVERITIES)}[1 + document_id % 4] FROM d
  UNION ALL SELECT company_id, case_id, document_id, 'signature_match', NULL, {_sql_list(_SIGNED)}[1 + document_id % {len(_SIGNED)}], NULL FROM d)
SELECT company_id, case_id, rule_id, weight::DOUBLE AS weight, greatest(count(DISTINCT document_id), 1) AS n_documents FROM e JOIN rules r
ON e.kind = r.kind AND (r.check_type IS NULL OR e.check_type = r.check_type) AND list_contains(names, name) AND (severities IS NULL OR list_contains(severities, severity)) GROUP BY ALL"""
)
def rule_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All built-in rules over evidence of all five kinds, whose names are dealt by the keys of lines and orders."""
    docs, li = owned_documents(spark, sf_dir), read_table(spark, sf_dir, "lineitem")
    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (1 + key % len(values)).cast("int"))
    of_line, part, supplier, doc = F.col("l_orderkey").alias("document_id"), F.col("l_partkey"), F.col("l_suppkey"), F.col("document_id")
    found = evidence.gather_evidence(
        docs,
        finding=li.select(of_line, pick([c for c, _ in _FINDINGS], part).alias("check_type"), pick([n for _, n in _FINDINGS], part).alias("name"), pick(_SEVERITIES, supplier).alias("severity")),
        sub_check=li.filter(supplier % 2 == 0).select(of_line, F.lit("field_validation").alias("check_type"), pick(_FIELDS, part).alias("name"), F.lit("flag").alias("severity")),
        check_result=docs.select("document_id", F.when(doc % 2 == 0, "issuer_verification").otherwise("signature_stamp_detection").alias("check_type"), F.when(F.col("status") == "O", "flag").otherwise("pass").alias("name")),
        cross_document=docs.select("company_id", "case_id", pick(_CONFLICTS, doc).alias("name"), pick(_SEVERITIES, doc).alias("severity"), F.lit("conflict").alias("classification"), F.lit("pending").alias("review_status")),
        signature_match=docs.select("document_id", pick(_SIGNED, doc).alias("name")),
    )
    return evidence.active_hits(evidence.hits_by_document(found, pack.rule_pack(spark)))


_PROFILE_VALUES = """v AS (SELECT o_custkey AS case_id, 'state' AS field, o_orderkey AS document_id, nullif(o_orderstatus, 'P') AS value FROM orders
  UNION ALL SELECT o_custkey, 'year', o_orderkey, CAST(year(o_orderdate) AS VARCHAR) FROM orders)"""


def profile_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    state = docs.select("case_id", F.lit("state").alias("field"), "document_id", F.nullif(F.col("status"), F.lit("P")).alias("value"))
    year = docs.select("case_id", F.lit("year"), "document_id", F.year("document_date").cast("string"))
    return state.union(year).withColumns({"agrees_as": F.col("value"), "priority": F.col("document_id") % 3})


@register(
    f"""WITH {_PROFILE_VALUES}, g AS (SELECT case_id, field, value, count(*) AS n, min(document_id % 3) AS p FROM v WHERE value IS NOT NULL GROUP BY ALL),
b AS (SELECT g.*, (SELECT min(document_id) FROM v WHERE v.case_id = g.case_id AND v.field = g.field AND v.value = g.value AND document_id % 3 = g.p) AS document_id FROM g),
t AS (SELECT *, sum(n) OVER w AS total, count(*) OVER w AS k, row_number() OVER (PARTITION BY case_id, field ORDER BY n DESC, p, document_id, value) AS place FROM b WINDOW w AS (PARTITION BY case_id, field)),
c AS (SELECT DISTINCT case_id, field FROM v)
SELECT c.case_id, c.field, CASE WHEN k IS NULL THEN 'missing' WHEN k = 1 THEN 'agreed' ELSE 'conflict' END AS status, CASE WHEN k = 1 THEN value END AS value, CASE WHEN k = 1 THEN document_id END AS document_id,
  coalesce(total, 0)::BIGINT AS n_documents, coalesce(k, 0) AS n_candidates, CASE WHEN k > 1 AND 2 * n > total THEN document_id END AS suggested, (CASE WHEN k > 1 AND 2 * n > total THEN total - n ELSE 0 END)::BIGINT AS n_to_correct
FROM c LEFT JOIN t ON t.case_id = c.case_id AND t.field = c.field AND place = 1"""
)
def profile_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.profile_groups(profile_values(spark, sf_dir))


@register(
    f"""WITH {_PROFILE_VALUES}, g AS (SELECT case_id, field, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY case_id, field) AS total FROM v WHERE value IS NOT NULL GROUP BY case_id, field, value)
SELECT v.case_id, v.field, v.document_id, v.value FROM v JOIN g ON g.case_id = v.case_id AND g.field = v.field AND 2 * g.n > g.total WHERE v.value <> g.value"""
)
def profile_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.profile_corrections(profile_values(spark, sf_dir))


@register(
    """WITH f AS (SELECT o_custkey, o_orderkey AS document_id, o_orderpriority AS number, CAST(date_trunc('year', o_orderdate) AS DATE) AS date, CASE WHEN o_orderkey % 4 = 0 THEN round(o_totalprice / 200000) END AS amount FROM orders),
m AS (SELECT document_id, lag(document_id) OVER (PARTITION BY o_custkey ORDER BY document_id) AS matched_document_id FROM f),
j AS (SELECT m.document_id, matched_document_id, a.number = b.number AS x, a.date = b.date AS y, abs(a.amount - b.amount) < 0.01 AS z FROM m JOIN f a ON a.document_id = m.document_id JOIN f b ON b.document_id = matched_document_id),
k AS (SELECT *, (x IS NOT NULL)::INT + (y IS NOT NULL)::INT + (z IS NOT NULL)::INT AS n_compared, coalesce(NOT x, false)::INT + coalesce(NOT y, false)::INT + coalesce(NOT z, false)::INT AS n_differ FROM j)
SELECT document_id, matched_document_id, n_compared, n_differ, CASE WHEN n_differ > 0 THEN 'same_template' WHEN n_compared >= 2 THEN 'resubmission' ELSE 'unchanged' END AS verdict,
  CASE WHEN n_differ > 0 THEN 'low' WHEN n_compared >= 2 THEN 'high' END AS severity FROM k"""
)
def duplicate_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order against the one before of the same customer."""
    from pyspark.sql import Window

    docs = documents(spark, sf_dir)
    matches = docs.select("document_id", F.lag("document_id").over(Window.partitionBy("case_id").orderBy("document_id")).alias("matched_document_id")).filter("matched_document_id IS NOT NULL")
    fields = docs.select(
        "document_id", F.col("document_type").alias("reference_number"), F.trunc("document_date", "year").alias("date"),
        F.when(F.col("document_id") % 4 == 0, F.round(F.col("total_amount") / 200000)).alias("amount"), F.lit(None).cast("string").alias("person"),
    )
    return profiles.duplicate_refine(matches, fields)


@register(
    r"""WITH w AS (SELECT conv_id AS item_id, turn AS run, unnest(string_split_regex(text, '[\x20\t\r\n]+')) AS word FROM conversations),
n AS (SELECT item_id, run, regexp_replace(lower(word), '^[ .:;,-]+|[ .:;,-]+$', '', 'g') AS word FROM w)
SELECT item_id, word, count(DISTINCT run) AS n_runs FROM n WHERE regexp_matches(word, '[\p{L}\p{N}]') GROUP BY 1, 2 HAVING count(DISTINCT run) >= 2"""
)
def vote_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as answers about it."""
    turns = read_table(spark, sf_dir, "conversations")
    return profiles.vote_words(turns.select(F.col("conv_id").alias("item_id"), F.col("turn").alias("run"), F.split("text", r"[\x20\t\r\n]+").alias("words")))


@register(
    """WITH f AS (SELECT o_custkey AS folder_id, count(*) FILTER (WHERE o_orderstatus <> 'P') AS a, count(*) FILTER (WHERE o_orderstatus = 'P') AS r FROM orders GROUP BY 1)
SELECT c_nationkey AS bulk_id, count(*) FILTER (WHERE c_acctbal >= 0) AS cases_created, count(*) FILTER (WHERE c_acctbal < 0) AS cases_failed, coalesce(sum(a), 0)::BIGINT AS documents_accepted, coalesce(sum(r), 0)::BIGINT AS documents_rejected
FROM customer LEFT JOIN f ON folder_id = c_custkey GROUP BY 1"""
)
def bulk_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    folders = c.select(F.col("c_nationkey").alias("bulk_id"), F.col("c_custkey").alias("folder_id"), F.when(F.col("c_acctbal") >= 0, "created").otherwise("failed").alias("status"))
    files = documents(spark, sf_dir).select(F.col("case_id").alias("folder_id"), F.when(F.col("status") == "P", "rejected").otherwise("accepted").alias("status"))
    return profiles.bulk_tally(folders, files)


@register(
    """WITH m AS (SELECT c_custkey AS member_id, c_custkey = min(c_custkey) OVER (PARTITION BY c_nationkey) AS is_head FROM customer),
c AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS member_id, o_custkey AS submitted_by, o_orderdate AS created_at FROM orders),
own AS (SELECT m.member_id, case_id, created_at FROM m JOIN c ON c.member_id = m.member_id OR (c.member_id IS NULL AND is_head AND submitted_by = m.member_id))
SELECT m.member_id, count(case_id) AS n_cases, arg_max(case_id, struct_pack(a := created_at, b := case_id)) AS latest_case FROM m LEFT JOIN own ON own.member_id = m.member_id GROUP BY 1"""
)
def member_latest_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are the members of their nation's family, whose first one heads it; each fifth order names no member."""
    c = read_table(spark, sf_dir, "customer")
    heads = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("head"))
    members = c.join(heads, "c_nationkey").select(F.col("c_custkey").alias("member_id"), F.col("c_nationkey").alias("family_id"), (F.col("c_custkey") == F.col("head")).alias("is_head"), F.col("c_custkey").alias("user_id"))
    found = documents(spark, sf_dir).select(F.col("document_id").alias("case_id"), F.when(F.col("document_id") % 5 > 0, F.col("case_id")).alias("member_id"), F.col("case_id").alias("submitted_by"), F.col("document_date").alias("created_at"))
    return profiles.member_latest_case(members, found)


def _sql_kind(text: str, table: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({text}), {w!r})' for w in words)} THEN '{kind}'" for kind, words in table) + " END"


@register(f"SELECT page_id, coalesce({_sql_kind('title', profiles.LABEL_WORDS)}, {_sql_kind('url', profiles.FILE_WORDS)}, '{profiles.OTHERWISE}') AS kind FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages)")
def infer_document_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages as labels, their urls as file names."""
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", profiles.infer_document_type(F.regexp_extract("html", "<title>([^<]*)", 1), F.col("url")).alias("kind"))


_TAXED = """t AS (SELECT l_orderkey AS document_id, 100 * max(l_tax) AS rate, round(CAST(sum(CAST(l_extendedprice * l_tax AS DECIMAL(18,4))) AS DOUBLE), 2) AS tax,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS subtotal, list(l_extendedprice) AS totals, count(*) AS n FROM lineitem GROUP BY 1)"""


@register(
    f"""WITH {_TAXED}, f AS (SELECT *, subtotal * rate / 100 AS expected FROM t),
j AS (SELECT *, CASE WHEN abs(expected - tax) <= 0.02 + 1e-9 THEN 'pass' WHEN rate > 0 AND abs(tax) < 0.005 AND subtotal > 0 THEN 'flag' END AS first FROM f),
m AS (SELECT document_id, rate, tax, totals, unnest(range(1, 1 << n)) AS mask FROM j WHERE first IS NULL AND n <= 20),
s AS (SELECT DISTINCT document_id FROM m WHERE rate > 0 AND abs(list_sum(list_transform(range(1, len(totals) + 1), lambda i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN totals[i] ELSE 0 END)) * rate / 100 - tax) <= 0.01 * bit_count(mask) + 1e-9)
SELECT document_id, round(expected, 4) AS expected, coalesce(first, CASE WHEN s.document_id IS NOT NULL THEN 'pass' ELSE 'flag' END) AS status FROM j LEFT JOIN s USING (document_id)"""
)
def chk_tax_rate_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest rate of an order's lines as the printed one: orders of several rates have taxed and untaxed lines."""
    li = plain_lines(spark, sf_dir)
    exact = lambda c: F.sum(c.cast("decimal(18,4)")).cast("double")
    docs = li.groupBy("document_id").agg((100 * F.max("tax_rate")).alias("tax_rate"), F.round(exact(F.col("total") * F.col("tax_rate")), 2).alias("tax"), exact(F.col("total")).alias("subtotal"), F.lit(None).cast("double").alias("total_amount"))
    return field_checks.chk_tax_rate_consistency(docs, li)


@register(
    """WITH c AS (SELECT l_orderkey AS document_id, 'net' AS role, l_extendedprice AS amount FROM lineitem UNION ALL SELECT l_orderkey, 'tax', l_extendedprice * l_tax FROM lineitem),
s AS (SELECT document_id, role, CAST(sum(CAST(amount AS DECIMAL(18,4))) AS DOUBLE) AS column_sum, count(amount) AS n FROM c GROUP BY 1, 2)
SELECT document_id, role, column_sum, CASE WHEN role = 'tax' OR o_totalprice IS NULL THEN 'skipped' WHEN abs(column_sum - o_totalprice) > 0.01 * greatest(n, 1) + 1e-9 THEN 'flag' ELSE 'pass' END AS status FROM s LEFT JOIN orders ON o_orderkey = document_id"""
)
def chk_column_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = plain_lines(spark, sf_dir)
    columns = li.select("document_id", F.lit("net").alias("role"), F.col("total").alias("amount")).union(li.select("document_id", F.lit("tax"), F.col("total") * F.col("tax_rate")))
    return field_checks.chk_column_sums(columns, documents(spark, sf_dir).select("document_id", F.lit("net").alias("role"), F.col("total_amount").alias("total")))


@register(
    """SELECT o_orderkey AS document_id, CASE WHEN o_orderstatus = 'O' THEN 'skipped' WHEN o_orderkey % 4 IN (0, 1) THEN 'pass' ELSE 'flag' END AS status FROM orders"""
)
def chk_tax_invoice_trn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed texts of orders: with a number of 15 digits, a labelled one of 12, a labelled one too short, or none."""
    docs, key = documents(spark, sf_dir), F.col("document_id")
    title = F.when(F.col("status") == "O", "Invoice").otherwise("TAX  INVOICE")
    number = (
        F.when(key % 4 == 0, F.concat(F.lit("\nNumber 100"), F.lpad(key.cast("string"), 12, "0")))
        .when(key % 4 == 1, F.concat(F.lit("\nVAT no: "), F.lpad(key.cast("string"), 12, "2")))
        .when(key % 4 == 2, F.concat(F.lit("\nTRN "), F.lpad(key.cast("string"), 9, "2")))
        .otherwise("")
    )
    return field_checks.chk_tax_invoice_trn(docs.select("document_id", F.concat(title, number, F.lit("\nTotal AED")).alias("text")))


@register(
    """WITH f AS (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS created, max(CAST(l_shipdate AS DATE)) AS modified FROM lineitem GROUP BY 1),
d AS (SELECT o_orderkey AS document_id, CAST(CAST(o_orderdate AS DATE) + INTERVAL 12 YEAR AS DATE) AS printed, CAST(created + INTERVAL 12 YEAR AS DATE) AS created, CAST(modified + INTERVAL 12 YEAR AS DATE) AS modified FROM orders LEFT JOIN f ON l_orderkey = o_orderkey)
SELECT document_id, CAST(printed - created AS INTEGER) AS days_before, CASE WHEN printed IS NULL OR created IS NULL OR created <= DATE '2000-01-01' THEN 'skipped' WHEN printed - created > 1 AND modified + 1 >= printed THEN 'flag' ELSE 'pass' END AS status FROM d"""
)
def chk_date_vs_file_creation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last line dates as those of the file, all twelve years later, as older clocks count as unset."""
    li = plain_lines(spark, sf_dir).groupBy("document_id").agg(F.min("line_date").alias("created"), F.max("line_date").alias("modified"))
    later = lambda c: F.add_months(F.to_date(c), 144)
    docs = documents(spark, sf_dir).join(li, "document_id", "left")
    return field_checks.chk_date_vs_file_creation(docs.select("document_id", later("document_date").alias("printed"), later("created").alias("created"), later("modified").alias("modified")))
