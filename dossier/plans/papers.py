"""Queries of signatures, stamps, messages, forms and schemes: orders are documents of customers' cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import messages, prefill, signatures
from dossier.plans.catalogue import register
from dossier.plans.issuers import scores_sql
from dossier.plans.layout import _WORDS, page_words
from dossier.storage import read_table



def _sign(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Words, some of them tall and handwritten, and two detections on each document."""
    tall = (F.col("word_no") * 13 + F.col("document_id")) % 17 == 0
    words = page_words(spark, sf_dir).withColumn("handwritten", tall).withColumn("height", F.when(tall & (F.col("word_no") % 2 == 0), 0.05).otherwise(F.col("height")))
    ids = words.select("document_id").distinct()
    at = lambda n, kind: ids.select("document_id", F.lit(None if n == 1 else 1).cast("int").alias("page"), F.lit(kind).cast("string").alias("kind"), (F.col("document_id") * n % 9 / 10).alias("x"), (F.col("document_id") * n % 7 / 10).alias("y"), F.lit(0.2).alias("width"), F.lit(0.05).alias("height"))
    return words, at(1, None).union(at(3, "signature")).union(at(5, "stamp"))


_SIGN = f"""{_WORDS},
tall AS (SELECT document_id, page, word_no, text, x, y, width, CASE WHEN (word_no * 13 + document_id) % 17 = 0 AND word_no % 2 = 0 THEN 0.05::DOUBLE ELSE height END AS height, (word_no * 13 + document_id) % 17 = 0 AS handwritten FROM words),
regions AS (SELECT document_id, document_id * n % 9 / 10.0::DOUBLE AS rx, document_id * n % 7 / 10.0::DOUBLE AS ry FROM (SELECT DISTINCT document_id FROM words), (SELECT unnest([1, 3]) AS n)),
medians AS (SELECT document_id, page, quantile_cont(height, 0.5) AS m FROM tall GROUP BY 1, 2),
ink AS (SELECT DISTINCT t.document_id, t.page, word_no, text, x, y FROM tall t JOIN medians USING (document_id, page) LEFT JOIN regions r ON r.document_id = t.document_id AND page = 1 AND greatest(least(x + width, rx + 0.2::DOUBLE) - greatest(x, rx), 0) * greatest(least(y + height, ry + 0.05::DOUBLE) - greatest(y, ry), 0) / (width * height) >= 0.5
  WHERE r.rx IS NOT NULL OR (handwritten AND height >= 1.8::DOUBLE * m))"""


@register(f"WITH {_SIGN} SELECT document_id, CAST(page AS INT) AS page, word_no, text FROM ink")
def signature_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.signature_words(*_sign(spark, sf_dir)).select("document_id", "page", "word_no", "text")


@register(
    f"""WITH {_SIGN}, fields AS (SELECT document_id, unnest(['prepared_by', 'remarks', 'approved_by']) AS field, ws FROM split_words WHERE len(ws) > 0),
valued AS (SELECT document_id, field, array_to_string(ws[1:CASE field WHEN 'prepared_by' THEN 3 ELSE 8 END], ' ') AS value, ws[1:CASE field WHEN 'prepared_by' THEN 3 ELSE 8 END] AS ts FROM fields),
inked AS (SELECT document_id, list(DISTINCT lower(text)) AS ink FROM ink GROUP BY 1),
cut AS (SELECT v.*, list_filter(ts, lambda t: NOT list_contains(coalesce(ink, []), trim(lower(t), '.,:;'))) AS rest FROM valued v LEFT JOIN inked USING (document_id))
SELECT document_id, field, CASE WHEN field = 'remarks' OR len(rest) = len(ts) THEN value WHEN len(rest) > 0 THEN array_to_string(rest, ' ') END AS value, CASE WHEN field <> 'remarks' AND len(rest) < len(ts) THEN value END AS value_as_read FROM cut"""
)
def strip_signature_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fields of the first words of each document, two of which name a person."""
    words, found = _sign(spark, sf_dir)
    first = words.filter("word_no < 8").groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"]).alias("ws"))
    value = lambda f, n: F.struct(F.lit(f).alias("field"), F.array_join(F.slice("ws", 1, n), " ").alias("value"))
    fields = first.select("document_id", F.explode(F.array(value("prepared_by", 3), value("remarks", 8), value("approved_by", 8))).alias("f")).select("document_id", "f.*")
    none = "struct<x:double,y:double,width:double,height:double>"
    return signatures.strip_signature_text(fields.withColumns({"page": F.lit(None).cast("int"), "box": F.lit(None).cast(none)}), signatures.signature_words(words, found))


@register(
    """WITH docs AS (SELECT o_custkey AS case_id, o_orderkey AS document_id FROM orders), refs AS (SELECT case_id, min(document_id) AS reference_id FROM docs GROUP BY 1),
signs AS (SELECT vec_id * 2 + n AS document_id, embedding AS v FROM embeddings, (SELECT unnest([0, 1, 2]) AS n) WHERE vec_id % 3 > 0),
scored AS (SELECT d.case_id, d.document_id, max(list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[])) AS s FROM docs d JOIN refs USING (case_id) JOIN signs a ON a.document_id = reference_id JOIN signs b ON b.document_id = d.document_id WHERE d.document_id <> reference_id GROUP BY 1, 2)
SELECT d.case_id, d.document_id, CASE WHEN s IS NULL THEN 'signature_absent' WHEN s >= 0.55 THEN 'signature_match' WHEN s >= 0.4 THEN 'signature_uncertain' ELSE 'signature_mismatch' END AS reason, CASE WHEN s IS NULL OR s >= 0.55 THEN 'info' WHEN s >= 0.4 THEN 'medium' ELSE 'high' END AS severity, round(s, 6) AS similarity
FROM docs d JOIN refs USING (case_id) LEFT JOIN scored USING (case_id, document_id) WHERE d.document_id <> reference_id AND reference_id IN (SELECT document_id FROM signs)"""
)
def reference_signature_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as signatures of documents, each on three of them; a case's first document is its reference."""
    docs = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("document_id"))
    vectors = read_table(spark, sf_dir, "embeddings").filter("vec_id % 3 > 0").select(F.explode(F.array(*(F.col("vec_id") * 2 + n for n in range(3)))).alias("document_id"), F.col("embedding").alias("vector"))
    return signatures.reference_signature_compare(vectors, docs.groupBy("case_id").agg(F.min("document_id").alias("document_id")), docs)


@register(
    f"""WITH s AS (SELECT p_partkey AS document_id, p_size / 50.0::DOUBLE AS similarity, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_brand ELSE p_name END AS x, CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN p_type END AS y FROM part),
{scores_sql("SELECT DISTINCT x, y FROM s WHERE x <> '' AND y <> ''")}
SELECT document_id, CASE WHEN similarity < 0.93::DOUBLE THEN NULL WHEN token_set < 60 THEN 'reused_different_signer' ELSE 'identical_reuse' END AS verdict FROM s LEFT JOIN scored ON x = rx AND y = ry"""
)
def signature_reuse_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_brand ELSE p_name END")
    reference = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ' ', p_type) WHEN 1 THEN p_type END")
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document_id"), signatures.signature_reuse_verdict(F.col("p_size") / 50, label, reference).alias("verdict"))


@register("""SELECT l_orderkey AS document_id, arg_max(l_partkey, (l_discount, -l_linenumber * 1000000 - l_partkey)) AS x, max(l_discount) AS confidence FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1""")
def signature_pick_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    found = li.select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page"), F.when(F.col("l_returnflag") == "A", "signature").otherwise("stamp").alias("kind"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("region_no"), F.col("l_discount").alias("confidence"), F.col("l_partkey").alias("x"), *(F.lit(0.1).alias(c) for c in ("y", "width", "height")))
    return signatures.signature_pick_region(found).select("document_id", F.col("box.x").alias("x"), "confidence")


_MATERIAL = "CASE l_partkey % 9 WHEN 0 THEN 'text' WHEN 1 THEN 'vector' WHEN 2 THEN NULL ELSE 'image' END"


@register(
    f"""WITH made AS (SELECT l_orderkey AS document_id, list({_MATERIAL}) AS m FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
all_ AS (SELECT o_orderkey AS document_id, o_orderstatus <> 'P' AND m IS NOT NULL AS known, list_contains(m, 'text') OR list_contains(m, 'vector') AS typed, len(list_filter(m, lambda x: x IS NOT NULL)) AS told, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AS signed FROM orders LEFT JOIN made ON document_id = o_orderkey)
SELECT document_id, CASE WHEN NOT known OR told = 0 THEN 'skipped' WHEN typed THEN 'flag' ELSE 'pass' END AS authenticity, CASE WHEN NOT known OR NOT coalesce(typed, false) THEN 'skipped' WHEN signed THEN 'pass' ELSE 'flag' END AS unsigned FROM all_"""
)
def chk_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chk_stamp_authenticity and chk_synthetic_stamp_unsigned: lines are stamps and signatures of orders."""
    li, o = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders")
    stamps = li.filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("document_id"), F.expr(_MATERIAL).alias("material"))
    return signatures.stamp_checks(o.select(F.col("o_orderkey").alias("document_id"), (F.col("o_orderstatus") != "P").alias("detected")), stamps, li.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("document_id")))


_SCAN_TEXT = "CASE doc_id % 4 WHEN 0 THEN concat(text, ' Scanned with CamScanner') WHEN 1 THEN concat('adobe  scan ', text) ELSE text END"
_PRODUCER = "CASE doc_id % 5 WHEN 0 THEN 'RICOH MP 301' WHEN 1 THEN 'sharpener' WHEN 2 THEN 'KONICA MINOLTA bizhub' END"


@register(
    f"""WITH d AS (SELECT doc_id AS document_id, {_PRODUCER} AS p, CASE WHEN doc_id % 7 > 0 THEN 'Writer' END AS c, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 3 - 1 END AS n, doc_id % 4 < 2 AND text IS NOT NULL AS mark FROM documents)
SELECT document_id, CASE WHEN p IS NULL AND c IS NULL THEN 'skipped' WHEN mark AND p IN ('RICOH MP 301', 'KONICA MINOLTA bizhub') THEN 'flag' ELSE 'pass' END AS rescan, CASE WHEN NOT mark OR n IS NULL THEN 'skipped' WHEN n = 0 THEN 'flag' ELSE 'pass' END AS fake_scan FROM d"""
)
def chk_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chk_rescan_conflict and chk_fake_scan_watermark on the documents' texts."""
    docs = read_table(spark, sf_dir, "documents")
    rescan, fake = signatures.scan_checks(F.expr(_SCAN_TEXT), F.expr(_PRODUCER), F.expr("CASE WHEN doc_id % 7 > 0 THEN 'Writer' END"), F.expr("CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 3 - 1 END"))
    return docs.select(F.col("doc_id").alias("document_id"), rescan.alias("rescan"), fake.alias("fake_scan"))


_TEMPLATE = "CASE c_custkey % 3 WHEN 0 THEN 'Amount {amount} of {name}{missing}.' WHEN 1 THEN ' {name}' ELSE 'Nothing {0 to fill' END"


@register(
    f"""WITH m AS (SELECT c_custkey AS id, CASE c_custkey % 2 WHEN 0 THEN 'de' ELSE 'en' END AS language, {_TEMPLATE} AS template, c_name AS name, CAST(c_nationkey AS VARCHAR) AS amount FROM customer),
t AS (SELECT *, CASE WHEN language = 'de' AND template LIKE 'Amount%' THEN 'Betrag {{amount}} von {{name}}.' ELSE template END AS t FROM m)
SELECT id, language, trim(replace(replace(replace(t, '{{amount}}', amount), '{{name}}', '{{' || name || '}}x'), '{{missing}}', '')) AS text FROM t"""
)
def translate_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of three templates, one of which German has; values that look like placeholders stay as they are."""
    customers = read_table(spark, sf_dir, "customer")
    context = F.create_map(F.lit("name"), F.concat(F.lit("{"), "c_name", F.lit("}x")), F.lit("amount"), F.col("c_nationkey").cast("string"))
    rows = customers.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "de").otherwise("en").alias("language"), F.expr(_TEMPLATE).alias("template"), context.alias("context"))
    dictionary = spark.createDataFrame([("Amount {amount} of {name}{missing}.", "de", "Betrag {amount} von {name}."), (" {name}", "de", "")], "template string, language string, translation string")
    return messages.translate_messages(rows, dictionary).select("id", "language", "text")


@register(
    """SELECT o_orderkey AS document_id, CASE o_orderkey % 4 WHEN 0 THEN regexp_replace(printf('%.6f', o_totalprice % 17), '\\.?0+$', '') || '%' WHEN 1 THEN format('{:,.2f}', o_totalprice) || ' AED' WHEN 2 THEN format('{:,.2f}', o_totalprice) ELSE CASE WHEN o_orderstatus = 'P' THEN 'not found' ELSE o_orderpriority END END AS value,
CASE o_orderkey % 3 WHEN 0 THEN CAST(day(o_orderdate) AS VARCHAR) || strftime(o_orderdate, ' %B %Y') WHEN 1 THEN 'INR ' || format('{:,}', o_custkey * 1000) ELSE upper(o_orderpriority[1]) || lower(o_orderpriority[2:]) END AS display,
list_distinct([strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%d/%m/%Y'), strftime(o_orderdate, '%m/%d/%Y'), strftime(o_orderdate, '%d-%m-%Y'), strftime(o_orderdate, '%B %d, %Y'), strftime(o_orderdate, '%d %B %Y'), strftime(o_orderdate, '%b %d, %Y'), strftime(o_orderdate, '%d %b %Y'),
  strftime(o_orderdate, '%B ') || day(o_orderdate) || strftime(o_orderdate, ', %Y'), day(o_orderdate) || strftime(o_orderdate, ' %B %Y')]).len() AS n_forms FROM orders"""
)
def fn_readable_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_format_value, fn_display_value and fn_date_renderings over the orders."""
    o = read_table(spark, sf_dir, "orders")
    field = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'tax_rate' ELSE 'amount' END")
    number = F.expr("CASE o_orderkey % 4 WHEN 0 THEN o_totalprice % 17 WHEN 3 THEN NULL ELSE o_totalprice END")
    value = messages.format_value(field, F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END"), number, F.expr("CASE o_orderkey % 4 WHEN 1 THEN 'AED' END"))
    shown = messages.display_value(F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'date_of_birth' WHEN 1 THEN 'annual_income' ELSE 'gender' END"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN CAST(o_custkey * 1000 AS STRING) ELSE o_orderpriority END"), F.lit(None).cast("string"), F.lit("INR"))
    return o.select(F.col("o_orderkey").alias("document_id"), value.alias("value"), shown.alias("display"), F.size(messages.date_renderings(F.col("o_orderdate"))).cast("long").alias("n_forms"))


@register(
    """SELECT o_orderkey AS document_id, CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN a = b AND a <= 12 THEN 1 ELSE (CASE WHEN a <= 12 THEN 1 ELSE 0 END) + (CASE WHEN b <= 12 THEN 1 ELSE 0 END) END ELSE CASE o_orderkey % 5 WHEN 1 THEN CASE WHEN a = b AND a <= 12 THEN 1 ELSE (CASE WHEN a <= 12 THEN 1 ELSE 0 END) + (CASE WHEN b <= 12 THEN 1 ELSE 0 END) END ELSE 0 END END AS n,
CASE WHEN o_orderkey % 5 > 1 THEN NULL WHEN a <= 12 THEN make_date(2023, a, b) WHEN b <= 12 THEN make_date(2023, b, a) END AS first FROM (SELECT o_orderkey, CAST(o_orderkey % 28 + 1 AS INT) AS a, CAST(o_custkey % 28 + 1 AS INT) AS b FROM orders)"""
)
def fn_print_header_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "CASE o_orderkey % 5 WHEN 0 THEN concat(o_orderkey % 28 + 1, '/', o_custkey % 28 + 1, '/23, 1:05 PM page') WHEN 1 THEN concat(char(10), 'head', char(10), ' ', o_orderkey % 28 + 1, '/', o_custkey % 28 + 1, '/2023 11:59') WHEN 2 THEN concat('a', char(10), 'b', char(10), '1/2/23, 1:05 PM') WHEN 3 THEN concat('on ', o_orderkey % 28 + 1, '/1/23, 1:05') END"
    dates = messages.print_header_dates(F.expr(text))
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.coalesce(F.size(dates), F.lit(0)).cast("int").alias("n"), F.get(dates, F.lit(0)).alias("first"))


_FORMS = [("address", "BUILDING", 1, "name", "full_name"), ("address", "BUILDING", 2, "age", "age"), ("address", "BUILDING", 3, "pin", "postal_code"), ("address", "BUILDING", 4, "mobile", None), ("joining", "MACHINERY", 1, "name", "full_name"), ("joining", "MACHINERY", 2, "born", "date_of_birth")]
_PROFILE = """SELECT c_custkey AS case_id, field, CASE (c_custkey + n) % 5 WHEN 0 THEN 'conflict' WHEN 1 THEN 'missing' ELSE 'agreed' END AS status, CASE WHEN (c_custkey + n) % 5 = 1 THEN NULL WHEN field = 'full_name' THEN c_name WHEN field = 'address' THEN CASE WHEN c_custkey % 2 = 0 THEN concat('12 road 4000', CAST(10 + c_nationkey AS STRING)) ELSE 'no code 1234567' END ELSE concat('19', CAST(60 + c_nationkey AS STRING), '-03-', CASE WHEN c_custkey % 3 = 0 THEN '02' ELSE '20' END) END AS value, c_custkey * 10 + n AS document_id"""


@register(
    f"""WITH p AS ({_PROFILE.replace("STRING", "VARCHAR")} FROM customer, (SELECT unnest(['full_name', 'date_of_birth', 'address']) AS field, unnest([0, 1, 2]) AS n)),
f AS (SELECT * FROM (VALUES {", ".join(str(x).replace("None", "NULL") for x in _FORMS)}) AS t(form_id, case_type, position, key, source)),
s AS (SELECT case_id, field AS source, status, value, document_id FROM p UNION ALL SELECT case_id, 'age', status, CAST(2024 - CAST(value[1:4] AS INT) - CASE WHEN '03-10' < value[6:10] THEN 1 ELSE 0 END AS VARCHAR), document_id FROM p WHERE field = 'date_of_birth'
  UNION ALL SELECT case_id, 'postal_code', status, CASE WHEN value LIKE '12 road%' THEN value[9:14] END, document_id FROM p WHERE field = 'address')
SELECT c_custkey AS case_id, form_id, CAST(position AS INT) AS position, key, CASE WHEN status = 'conflict' THEN 'needs_attention' WHEN value IS NOT NULL THEN 'filled' ELSE 'to_fill' END AS status, CASE WHEN status <> 'conflict' THEN value END AS value, CASE WHEN status <> 'conflict' AND value IS NOT NULL THEN document_id END AS source_document_id
FROM customer JOIN f ON case_type = c_mktsegment LEFT JOIN s ON s.case_id = c_custkey AND s.source = f.source"""
)
def form_prefill(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read_table(spark, sf_dir, "customer")
    customers.select("*", F.posexplode(F.array(*map(F.lit, ("full_name", "date_of_birth", "address")))).alias("n", "field")).createOrReplaceTempView("paper_profiles")
    profiles = spark.sql(_PROFILE + " FROM paper_profiles")
    forms = spark.createDataFrame(_FORMS, "form_id string, case_type string, position int, key string, source string")
    return prefill.form_prefill(customers.select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("case_type")), profiles, forms, "2024-03-10")


_SCHEMES = [("housing", "HIGH", [300000, 600000]), ("scholarship", None, [250000]), ("farmers", None, []), ("health", "URGENT", [])]


@register(
    """WITH d AS (SELECT o_custkey AS case_id, o_orderkey AS document_id, o_orderpriority AS document_type, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 END AS income FROM orders),
c AS (SELECT case_id, arg_max(income, document_id) FILTER (WHERE income IS NOT NULL) AS income, bool_or(document_type LIKE '%HIGH%') AS high, bool_or(document_type LIKE '%URGENT%') AS urgent, case_id % 6 = 0 AS conflict FROM d GROUP BY case_id),
e AS (SELECT case_id, income, conflict, unnest(['housing', 'scholarship', 'farmers', 'health']) AS scheme, unnest([high, true, true, urgent]) AS there, unnest([CASE WHEN income <= 300000 THEN 1 WHEN income <= 600000 THEN 2 END, CASE WHEN income <= 250000 THEN 1 END, NULL, NULL]) AS band, unnest([true, true, false, false]) AS asks FROM c)
SELECT case_id, scheme, CASE WHEN NOT there THEN 'missing_document' WHEN conflict THEN 'conflict' WHEN asks AND income IS NULL THEN 'income_unknown' WHEN asks AND band IS NULL THEN 'income_above' ELSE 'ready' END AS status, CAST(band AS INT) AS band FROM e"""
)
def scheme_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("document_type"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") * 2).alias("income"))
    schemes = spark.createDataFrame(_SCHEMES, "scheme string, requires string, bands array<long>")
    return prefill.scheme_readiness(docs, schemes, docs.filter("case_id % 6 = 0"))
