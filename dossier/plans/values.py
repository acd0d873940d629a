"""Registered queries of column functions and of the record sources, over printed values of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import text as fn
from dossier.operators import access, validation
from dossier.plans.catalogue import register
from dossier.plans.tables import documents
from dossier.sources import records
from dossier.storage import read_table


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer")


@register(
    """SELECT 'event' AS kind, event_id AS id, CAST(json_extract(props, '$.k') AS DOUBLE) AS number FROM events WHERE props IS NOT NULL
UNION ALL SELECT 'brand', p_partkey, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS DOUBLE) FROM part
UNION ALL SELECT 'amount', o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) FROM orders"""
)
def fn_parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in event properties and brand names, and amounts printed in three conventions."""
    events, part = read_table(spark, sf_dir, "events"), read_table(spark, sf_dir, "part")
    point = F.format_number("total_amount", 2)
    printed = F.when(F.col("document_id") % 3 == 0, point).when(F.col("document_id") % 3 == 1, F.translate(point, ".,", ",.")).otherwise(F.concat(F.lit("AED "), F.translate(point, ",", " ")))
    texts = (
        events.filter("props IS NOT NULL").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("props").alias("t"))
        .union(part.select(F.lit("brand"), "p_partkey", "p_brand"))
        .union(documents(spark, sf_dir).select(F.lit("amount"), "document_id", printed))
    )
    return texts.select("kind", "id", fn.parse_number(F.col("t")).alias("number"))


@register("SELECT o_orderkey AS document_id, CAST(o_orderdate AS DATE) AS printed, CAST(o_orderdate AS DATE) AS pdf, CAST(o_orderdate AS DATE) AS xmp FROM orders")
def fn_parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in every printed form, as PDF dates in three zones and as XMP dates, read back."""
    d, key = F.col("document_date"), F.col("document_id")
    form = F.coalesce(*(F.when(key % len(fn.DATE_FORMATS) == i, F.date_format(d, f)) for i, f in enumerate(fn.DATE_FORMATS)))
    pdf = F.concat(F.lit("D:"), F.date_format(d, "yyyyMMdd"), F.when(key % 3 == 0, "").when(key % 3 == 1, "120000Z").otherwise("103000+02'00'"))
    xmp = F.concat(F.date_format(d, "yyyy-MM-dd"), F.when(key % 3 == 0, "").when(key % 3 == 1, "T12:00:00").otherwise("T12:00:00+02:00"))
    return documents(spark, sf_dir).select("document_id", fn.parse_date(form).alias("printed"), F.to_date(fn.pdf_date(pdf)).alias("pdf"), F.to_date(fn.xmp_date(xmp)).alias("xmp"))


_IBAN_BODY = "lpad(CAST(c_custkey AS VARCHAR), 18, '0')"


@register(
    f"""SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'bad_length' WHEN c_custkey % 10 = 4 THEN 'bad_shape'
WHEN CAST({_IBAN_BODY} || '1314' || lpad(CAST(c_custkey % 97 AS VARCHAR), 2, '0') AS HUGEINT) % 97 = 1 THEN 'valid' ELSE 'bad_checksum' END AS iban,
CASE WHEN c_custkey % 7 = 0 THEN 'bad_length' WHEN c_custkey % 2 = 0 THEN 'valid' ELSE 'bad_start' END AS trn FROM customer"""
)
def fn_iban_trn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account and tax numbers made of customer numbers, some of them too long or of a wrong shape."""
    key = F.col("c_custkey")
    return customers(spark, sf_dir).select("c_custkey", fn.iban_status(_iban(key)).alias("iban"), fn.trn_status(_trn(key)).alias("trn"))


def _iban(key):  # noqa: ANN001, ANN202
    digits = F.lpad(key.cast("string"), 18, "0")
    start = F.concat(F.when(key % 10 == 4, "D").otherwise("DE"), F.lpad((key % 97).cast("string"), 2, "0"))
    return F.concat(start, F.lit(" "), digits, F.when(key % 10 == 3, "0").otherwise(""))


def _trn(key):  # noqa: ANN001, ANN202
    return F.concat(F.when(key % 2 == 0, "100").otherwise("200"), F.lpad(key.cast("string"), 12, "0"), F.when(key % 7 == 0, "0").otherwise(""))


@register(
    f"""WITH v AS (SELECT c_nationkey, CASE WHEN c_custkey % 10 = 3 THEN 'bad_length' WHEN c_custkey % 10 = 4 THEN 'bad_shape'
WHEN CAST({_IBAN_BODY} || '1314' || lpad(CAST(c_custkey % 97 AS VARCHAR), 2, '0') AS HUGEINT) % 97 = 1 THEN 'valid' ELSE 'bad_checksum' END AS verdict FROM customer
UNION ALL SELECT c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN 'bad_length' WHEN c_custkey % 2 = 0 THEN 'valid' ELSE 'bad_start' END FROM customer)
SELECT c_nationkey AS document_id, count(verdict) AS n, count(*) FILTER (WHERE verdict <> 'valid') AS n_bad, CASE WHEN n_bad > 0 THEN 'flag' ELSE 'pass' END AS status FROM v GROUP BY 1"""
)
def chk_iban_trn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as documents that print the numbers of their customers."""
    key, c = F.col("c_custkey"), customers(spark, sf_dir)
    both = c.select(F.col("c_nationkey").alias("document_id"), F.explode(F.array(fn.iban_status(_iban(key)), fn.trn_status(_trn(key)))).alias("verdict"))
    return validation.chk_identifiers(both)


@register(
    """WITH p AS (SELECT l_orderkey AS document_id, count(*) FILTER (WHERE l_returnflag = 'R') AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,4)) END) AS DOUBLE) AS split, max(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS largest FROM lineitem GROUP BY 1),
o AS (SELECT document_id, min(CASE WHEN abs(l_extendedprice - split) <= 0.01 * greatest(n, 1) + 1e-9 THEN l_extendedprice END) AS exact, max(l_extendedprice) AS other FROM p JOIN lineitem ON l_orderkey = document_id WHERE l_returnflag <> 'R' AND n >= 2 GROUP BY 1),
j AS (SELECT document_id, split, exact, other, coalesce(other >= largest AND abs(other - split) <= 0.2 * other, false) AS near FROM p LEFT JOIN o USING (document_id))
SELECT document_id, split, coalesce(exact, CASE WHEN near THEN other END) AS parent, CASE WHEN exact IS NOT NULL THEN 'pass' WHEN near THEN 'flag' ELSE 'skipped' END AS status FROM j"""
)
def chk_installments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines as instalments."""
    li = read_table(spark, sf_dir, "lineitem")
    return validation.chk_installments(li.select(F.col("l_orderkey").alias("document_id"), F.col("l_extendedprice").alias("total"), (F.col("l_returnflag") == "R").alias("is_part")))


@register(
    """WITH l AS (SELECT l_orderkey AS document_id, l_quantity, list_filter(regexp_extract_all(lower(strftime(l_shipdate, '%B') || CASE WHEN l_returnflag = 'A' THEN ' to ' || strftime(l_shipdate + INTERVAL 1 MONTH, '%b') ELSE '' END), '[a-z]+'), lambda x: length(x) > 2) AS m, l_linestatus FROM lineitem)
SELECT document_id, count(*) FILTER (WHERE l_linestatus = 'O') AS n_checked, count(*) FILTER (WHERE l_linestatus = 'O' AND abs(l_quantity - len(m)) >= 1e-9) AS n_wrong,
CASE WHEN n_checked = 0 THEN 'skipped' WHEN n_wrong > 0 THEN 'flag' ELSE 'pass' END AS status FROM l GROUP BY 1"""
)
def chk_period_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open lines list the month of their shipping date, or it and the next, as due."""
    li = read_table(spark, sf_dir, "lineitem")
    listed = F.concat(F.date_format("l_shipdate", "MMMM"), F.when(F.col("l_returnflag") == "A", F.concat(F.lit(" to "), F.date_format(F.add_months("l_shipdate", 1), "MMM"))).otherwise(""))
    due = F.when(F.col("l_linestatus") == "O", F.size(fn.months_in_text(listed))).otherwise(0)
    return validation.chk_period_quantity(li.select(F.col("l_orderkey").alias("document_id"), F.col("l_quantity").alias("quantity"), due.alias("n_due")))


@register(
    """SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN length(regexp_extract(text, '^(?s:.*?)[.!?](?:\\s|$)')) > 0 THEN rtrim(regexp_extract(text, '^(?s:.*?)[.!?](?:\\s|$)'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE text END AS first_sentence,
upper(substr(trim(regexp_replace(source, '[_. ]+', ' ', 'g')), 1, 1)) || lower(substr(trim(regexp_replace(source, '[_. ]+', ' ', 'g')), 2)) AS source FROM documents"""
)
def fn_first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", fn.first_sentence(F.col("text")).alias("first_sentence"), fn.humanize(F.col("source")).alias("source"))


@register(
    """SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(lower(p_name), '[a-z]+'), lambda x: x NOT IN ('late', 'master', 'dr', 'mr')), ' ') AS tokens FROM part"""
)
def fn_name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", F.array_join(fn.name_tokens(F.col("p_name")), " ").alias("tokens"))


@register(
    """WITH d AS (SELECT o_orderkey AS document_id, CAST(o_orderdate AS DATE) AS born, DATE '2024-02-28' AS today FROM orders)
SELECT document_id, CAST(year(today) - year(born) - CASE WHEN strftime(today, '%m%d') < strftime(born, '%m%d') THEN 1 ELSE 0 END AS INTEGER) AS age FROM d"""
)
def fn_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("document_id", fn.age_in_years(F.to_date("document_date"), F.lit("2024-02-28").cast("date")).alias("age"))


@register(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'match' WHEN c_custkey % 3 = 1 THEN 'match' ELSE 'high' END AS id_number,
CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_custkey % 3 = 0 THEN 'match' WHEN c_custkey % 5 = 0 THEN 'medium' ELSE 'high' END AS gender FROM customer"""
)
def fn_compare_id_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's name as number against itself with separators, with masked places, and with another last digit; genders
    that differ for two customers of three, some of them read unsurely, some missing."""
    key, name = F.col("c_custkey"), F.col("c_name")
    last = F.concat(F.expr("substring(c_name, 1, length(c_name) - 1)"), ((F.expr("right(c_name, 1)").cast("int") + 1) % 10).cast("string"))
    other = F.when(key % 3 == 0, F.concat_ws("-", F.substring(name, 1, 5), F.expr("substring(c_name, 6)"))).when(key % 3 == 1, F.concat(F.substring(name, 1, 9), F.lit("XXXX"), F.expr("substring(c_name, 14)"))).otherwise(last)
    a, b = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise("female"), F.when(key % 3 == 0, "female").otherwise("male")
    return customers(spark, sf_dir).select("c_custkey", fn.compare_id_numbers(name, other).alias("id_number"), fn.doubt(fn.compare_gender(a, b), key % 5 == 0, F.lit(None).cast("boolean")).alias("gender"))


@register(
    """SELECT c_custkey, lpad(CAST(100000 + c_custkey % 899999 AS VARCHAR), 6, '0') AS code,
CASE WHEN c_custkey % 5 = 0 THEN 'match' WHEN c_custkey % 5 = 1 THEN 'harmless' WHEN c_custkey % 5 = 2 THEN 'low' WHEN c_custkey % 5 = 3 THEN 'medium' ELSE 'harmless' END AS verdict FROM customer"""
)
def fn_compare_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made of customer columns: the same, with short forms, with another house number, with another postal
    code, with more detail. House numbers have seven digits or more: six that stand alone would be a postal code."""
    key = F.col("c_custkey")
    code = (100000 + key % 899999).cast("string")
    at = lambda house, road, code: F.concat_ws(" ", F.lpad(house.cast("string"), F.greatest(F.length(house.cast("string")), F.lit(7)), F.lit("0")), F.col("c_mktsegment"), F.lit(road), code)
    a = at(key, "Road", code)
    b = (
        F.when(key % 5 == 0, a)
        .when(key % 5 == 1, at(key, "Rd.,", code))
        .when(key % 5 == 2, at(key + 1, "Road", code))
        .when(key % 5 == 3, at(key, "Road", (100001 + key % 899999).cast("string")))
        .otherwise(F.concat(F.lit("Tower Alpha, "), a))
    )
    return customers(spark, sf_dir).select("c_custkey", fn.postal_code(a).alias("code"), fn.compare_addresses(a, b).alias("verdict"))


_TURNED = "substr(w, 1, k - 1) || substr(w, k + 1, 1) || substr(w, k, 1) || substr(w, k + 2)"


@register(
    f"""WITH p AS (SELECT DISTINCT p_name AS a, p_type AS b FROM part), w AS (SELECT DISTINCT unnest(string_split(a, ' ')) AS w FROM p),
v AS (SELECT w, length(w) // 2 AS k FROM w WHERE length(w) >= 4)
SELECT w AS word, true AS turned, levenshtein(w, lower(w || 's')) <= 1 AS longer, levenshtein(w, reverse(w)) <= 1
 OR list_bool_or(list_transform(range(1, length(w)), lambda k: {_TURNED} = reverse(w))) AS reversed FROM v"""
)
def fn_osa_le1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names against themselves with two middle letters exchanged, with one letter more, and backwards."""
    words = read_table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct().filter("length(word) >= 4")
    w, k = F.col("word"), F.floor(F.length("word") / 2).cast("int")
    turned = F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.lit(1)), F.substring(w, k, F.lit(1)), F.substring(w, k + 2, F.length(w)))
    return words.select("word", fn.within_one_edit(w, turned).alias("turned"), fn.within_one_edit(w, F.lower(F.concat(w, F.lit("s")))).alias("longer"), fn.within_one_edit(w, F.reverse(w)).alias("reversed"))


@register(
    """WITH b AS (SELECT p_partkey, p_size / 100.0 AS x, p_partkey % 10 / 10.0 AS y, 0.4 AS w, 0.3 AS h FROM part),
g AS (SELECT *, greatest(0.0, x - 0.05) AS gx, greatest(0.0, y - 0.05) AS gy, least(1.0, x + w + 0.05) - greatest(0.0, x - 0.05) AS gw, least(1.0, y + h + 0.05) - greatest(0.0, y - 0.05) AS gh FROM b),
i AS (SELECT *, greatest(0.0, least(x + w, 0.7) - greatest(x, 0.3)) * greatest(0.0, least(y + h, 0.7) - greatest(y, 0.3)) AS shared FROM g)
SELECT p_partkey, round(CAST(w * h AS DOUBLE), 6) AS area, round(CAST(gw * gh AS DOUBLE), 6) AS grown, round(CAST(shared AS DOUBLE), 6) AS shared, round(CAST(shared AS DOUBLE) / (CAST(w * h AS DOUBLE) + 0.16 - CAST(shared AS DOUBLE)), 6) AS iou,
round(CAST(least(w, 1.0 - least(x, 1.0)) AS DOUBLE), 4) AS valid_width FROM i"""
)
def fn_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes and numbers as places of boxes on a page, against one box in its middle."""
    box = F.struct(F.lit(1).alias("page"), (F.col("p_size") / 100.0).alias("x"), (F.col("p_partkey") % 10 / 10.0).alias("y"), F.lit(0.4).alias("width"), F.lit(0.3).alias("height"))
    middle = F.struct(*(F.lit(v).alias(n) for n, v in (("x", 0.3), ("y", 0.3), ("width", 0.4), ("height", 0.4))))
    b = read_table(spark, sf_dir, "part").select("p_partkey", box.alias("b")).withColumn("m", middle)
    r = lambda c, n: F.round(c, 6).alias(n)
    grown = fn.box_area(fn.box_grow(F.col("b"), 0.05))
    return b.select("p_partkey", r(fn.box_area(F.col("b")), "area"), r(grown, "grown"), r(fn.box_intersection(F.col("b"), F.col("m")), "shared"), r(fn.box_iou(F.col("b"), F.col("m")), "iou"), fn.box_valid(F.col("b"))["width"].alias("valid_width"))


@register("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS similarity FROM embeddings")
def fn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against itself backwards."""
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.round(fn.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("similarity"))


@register("SELECT l_orderkey AS document_id, l_linenumber AS line_no, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM lineitem")
def fn_cell_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line totals as cells of a table, some with O for 0, some with a comma for the point."""
    point = F.format_number("l_extendedprice", 2)
    cell = F.when(F.col("l_linenumber") % 3 == 0, F.translate(point, "0", "O")).when(F.col("l_linenumber") % 3 == 1, F.translate(point, ".", ",")).otherwise(point)
    return read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("line_no"), "l_partkey", fn.cell_amount(cell).alias("amount"))


@register("SELECT page_id, array_to_string(list_filter(string_split(replace(url, chr(92), '/'), '/'), lambda p: p <> '' AND p <> '.'), ' ') AS parts FROM pages")
def fn_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", F.array_join(fn.path_parts(F.col("url")), " ").alias("parts"))


@register("SELECT doc_id, translate(text, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789') AS text, lang, source, n_chars FROM documents")
def strip_null_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a NUL put before each text, and without any after; their digits are ASCII then."""
    dirty = read_table(spark, sf_dir, "documents").withColumn("text", F.concat(F.lit("\u0000"), F.col("text")))
    return records.strip_null_bytes(dirty).withColumn("text", fn.decode_digits(F.col("text")))


@register(
    """WITH f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a.pdf' WHEN 1 THEN 'b.jpeg' WHEN 2 THEN 'c.png' ELSE 'd.txt' END AS name, n_chars AS size, CASE WHEN doc_id % 3 = 0 THEN 'pdf' WHEN doc_id % 3 = 1 THEN 'jpeg' END AS kind FROM documents),
c AS (SELECT *, CASE WHEN size = 0 THEN 'empty' WHEN size > 4000 THEN 'too_large' WHEN kind IS NULL THEN 'unknown_type' WHEN NOT ends_with(name, kind) THEN 'extension_mismatch' END AS code FROM f)
SELECT doc_id, code, code IS NULL AS accepted, name = 'a.pdf' AS is_pdf, CASE doc_id % 4 WHEN 0 THEN 'claim' WHEN 1 THEN 'evidence' WHEN 2 THEN 'other' ELSE 'pending' END AS role FROM c"""
)
def file_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploaded files whose first bytes and names follow from their ids."""
    key = F.col("doc_id")
    name = F.when(key % 4 == 0, "a.pdf").when(key % 4 == 1, "b.jpeg").when(key % 4 == 2, "c.png").otherwise("d.txt")
    head = F.when(key % 3 == 0, "255044462D31").when(key % 3 == 1, "FFD8FFE0").otherwise("00010203")
    kind = F.when(key % 4 == 0, "invoice").when(key % 4 == 1, "payment_evidence").when(key % 4 == 2, "other")
    files = read_table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), F.col("n_chars").alias("size"), head.alias("head"), access.document_role(kind).alias("role"))
    found = records.file_acceptance(files, 4000)
    return found.select("doc_id", "code", "accepted", access.is_pdf(F.lit(None).cast("string"), F.col("name")).alias("is_pdf"), "role")


@register(
    """WITH e AS (SELECT c_nationkey AS bulk_id, c_custkey AS folder, o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS size, CASE WHEN c_custkey % 19 = 0 AND o_orderkey % 2 = 0 THEN 3 ELSE 2 END AS depth FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT bulk_id, 'case-' || folder AS folder, count(*) AS n_files, count(*) FILTER (WHERE size > 400 OR size = 0) AS n_rejected, CASE WHEN max(depth) > 2 THEN 'nested_folder' WHEN n_files = n_rejected THEN 'no_documents' ELSE 'ok' END AS status FROM e GROUP BY bulk_id, folder"""
)
def bulk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files in a folder of their customer, in an archive of its nation with one wrapping folder, in either
    separator, beside hidden files."""
    c = customers(spark, sf_dir).select(F.col("c_custkey").alias("case_id"), F.col("c_nationkey").alias("bulk_id"))
    d = documents(spark, sf_dir).join(c, "case_id")
    slash = F.when(F.col("document_id") % 2 == 0, "\\").otherwise("/")
    deep = F.when((F.col("case_id") % 19 == 0) & (F.col("document_id") % 2 == 0), F.concat(F.lit("more"), slash)).otherwise("")
    folder = F.concat(F.lit("./upload"), slash, F.lit("case-"), F.col("case_id").cast("string"), slash)
    entry = F.array(F.concat(folder, deep, F.col("document_id").cast("string"), F.lit(".pdf")), F.concat(folder, F.lit(".hidden")))
    entries = d.select("bulk_id", F.explode(entry).alias("path"), F.floor(F.col("total_amount") / 1000).alias("size"))
    return records.bulk_plan(entries, 400)
