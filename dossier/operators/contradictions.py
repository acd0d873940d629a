"""Contradictions between the documents of an identity case, by classes of equal values.

Documents that say the same of a field are one class with a count and one document that stands for it, so classes meet,
not documents; and values that differ in many cases are compared once for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import text as fn
from dossier.operators.identity import name_part, part_relation
from dossier.storage import broadcast_if_small, materialize

#: Relations of name parts, the strongest first.
RELATIONS = ("exact", "abbreviation", "spelling", "initial", "typo")
#: Documents whose numbers name a person; numbers are compared within a type.
NAMES, DATES = ("full_name", "parent_or_spouse_name"), ("date_of_birth",)
VERDICT = "struct<classification:string,reason:string,severity:string>"


def _verdict(classification: str, reason: str, severity: str = "info") -> Column:
    return F.struct(F.lit(classification).alias("classification"), F.lit(reason).alias("reason"), F.lit(severity).alias("severity"))


def _conflict(reason: str, severity: str) -> Column:
    return _verdict("conflict", reason, severity)


def _harmless(reason: str) -> Column:
    return _verdict("harmless", reason)



def aligned(a: Column, b: Column) -> Column:
    """The parts of two names (arrays of ``name_part``) matched one to one, as structs (level, i, j); level is the relation's place in RELATIONS.

    All related parts are sorted, the strongest relation first, then by place, and each is taken if both its parts are free.
    """
    level = lambda t, u: F.array_position(F.array(*map(F.lit, RELATIONS)), part_relation(t, u)).cast("int") - 1
    every = F.flatten(F.transform(a, lambda t, i: F.transform(b, lambda u, j: F.struct(level(t, u).alias("level"), i.alias("i"), j.alias("j")))))
    related = F.array_sort(F.filter(every, lambda p: p["level"] >= 0))
    taken = lambda acc, p: F.exists(acc, lambda q: (q["i"] == p["i"]) | (q["j"] == p["j"]))
    return F.aggregate(related, F.array().cast("array<struct<level:int,i:int,j:int>>"), lambda acc, p: F.when(taken(acc, p), acc).otherwise(F.concat(acc, F.array(p))))


def name_verdicts(pairs: DataFrame, a: str = "value_a", b: str = "value_b") -> DataFrame:
    """``pairs`` with the column verdict (classification, reason, severity); null if the names match or one has no letters.

    Parts left over on both sides make another name, a slip of the pen a possible error, parts left over on one side a
    partial name or, with two matched, a name in full; other differences are harmless.
    """
    plain = lambda c: F.regexp_extract_all(F.translate(F.lower(c), fn.ACCENTED, fn.PLAIN), F.lit(r"(\p{L}+)"), F.lit(1))
    split = pairs.withColumn("__a", F.transform(fn.name_tokens(F.col(a)), name_part)).withColumn("__b", F.transform(fn.name_tokens(F.col(b)), name_part))
    met = split.withColumn("__m", aligned(F.col("__a"), F.col("__b")))
    extra_a, extra_b = (F.size(c) > F.size("__m") for c in ("__a", "__b"))
    has = lambda r: F.exists("__m", lambda p: p["level"] == RELATIONS.index(r))
    harmless = F.when(has("initial"), _harmless("initials")).when(has("abbreviation"), _harmless("abbreviation"))
    verdict = (
        F.when((F.size("__a") == 0) | (F.size("__b") == 0) | F.col(a).isNull() | F.col(b).isNull() | (plain(F.col(a)) == plain(F.col(b))), F.lit(None).cast(VERDICT))
        .when(extra_a & extra_b, _conflict("different_name", "critical"))
        .when(has("typo"), _conflict("possible_spelling_error", "medium"))
        .when((extra_a | extra_b) & (F.size("__m") < 2), _conflict("partial_name", "low"))
        .when(extra_a | extra_b, F.coalesce(harmless, _harmless("extra_middle_name")))
        .otherwise(F.coalesce(harmless, F.when(has("spelling"), _harmless("spelling_variant")), _harmless("honorific_or_word_order")))
    )
    return met.withColumn("verdict", verdict).drop("__a", "__b", "__m")


def _dates(a: Column, b: Column) -> Column:
    x, y = a.try_cast("date"), b.try_cast("date")
    apart = lambda f: F.aggregate(F.zip_with(F.split(F.date_format(x, f), ""), F.split(F.date_format(y, f), ""), lambda p, q: (p != q).cast("int")), F.lit(0), lambda s, v: s + v)
    return (
        F.when(x.isNull() | y.isNull() | (x == y), F.lit(None).cast(VERDICT))
        .when(F.year(x) != F.year(y), _conflict("date_year_difference", "high"))
        .when((F.month(x) == F.day(y)) & (F.day(x) == F.month(y)), _conflict("date_day_month_swapped", "low"))
        .when(apart("ddMM") == 1, _conflict("date_minor_difference", "medium"))
        .otherwise(_conflict("date_difference", "high"))
    )


def _income(a: Column, b: Column, currency_a: Column, currency_b: Column) -> Column:
    found = F.when(F.coalesce(currency_a == currency_b, F.lit(True)), fn.compare_income(a.try_cast("double"), b.try_cast("double")))
    severity = F.when(found != "match", found)
    return F.when(severity.isNotNull(), F.struct(F.lit("conflict").alias("classification"), F.lit("income_difference").alias("reason"), severity.alias("severity")))


def _address(a: Column, b: Column) -> Column:
    found = fn.compare_addresses(a, b)
    return F.when(found == "harmless", _harmless("address_variant")).when(found.isin("low", "medium"), F.struct(F.lit("conflict").alias("classification"), F.lit("address_difference").alias("reason"), found.alias("severity")))


def value_verdict() -> Column:
    """The verdict on (field, value_a, value_b, currency_a, currency_b) of a field that is no name and no address; null if they agree
    or can't be compared."""
    a, b = F.col("value_a"), F.col("value_b")
    return (
        F.when(F.col("field").isin(*DATES), _dates(a, b))
        .when(F.col("field") == "gender", F.when(fn.compare_gender(a, b) == "high", _conflict("gender_difference", "high")))
        .when(F.col("field") == "annual_income", _income(a, b, F.col("currency_a"), F.col("currency_b")))
        .when(F.col("field") == "id_number", F.when(fn.compare_id_numbers(a, b) == "high", _conflict("id_number_difference", "high")))
    )


def text_verdicts(pairs: DataFrame) -> DataFrame:
    """``pairs`` (field, value_a, value_b) of names and addresses with their verdict; null if they agree or can't be compared."""
    is_name = F.col("field").isin(*NAMES)
    return name_verdicts(pairs.filter(is_name)).unionByName(pairs.filter(~is_name).withColumn("verdict", _address(F.col("value_a"), F.col("value_b"))))


def identity_contradictions(fields: DataFrame) -> DataFrame:
    """Rows (case_id, field, value_a, value_b, uncertain, n_a, n_b, document_a, document_b, classification, reason, severity, was_reason,
    was_severity) of the rows (case_id, document_id, document_type, field, value, currency, uncertain).

    One row for each two classes of a case and field whose values differ: n documents in each, the smallest of which stands
    for it, value_a before value_b. A class has one value, currency and certainty, for identity numbers also one type of
    document, as numbers of different types aren't compared. A conflict of high or critical severity that rests on an
    uncertain value is unclear_reading, medium, with what it was. Null and empty values say nothing; repeated rows of a
    document count once.
    """
    typed = F.when(F.col("field") == "id_number", F.coalesce("document_type", F.lit(""))).otherwise(F.lit(""))
    said = fields.filter("value IS NOT NULL AND value <> ''").withColumn("type", typed)
    keys = ["case_id", "field", "type"]
    classes = said.groupBy(*keys, "value", F.coalesce("currency", F.lit("")).alias("currency"), F.coalesce("uncertain", F.lit(False)).alias("uncertain"))
    classes = materialize(classes.agg(F.countDistinct("document_id").alias("n"), F.min("document_id").alias("document")), "classes")
    text = F.col("field").isin(*NAMES, "address")

    def met(some: DataFrame) -> DataFrame:
        a, b = (some.select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in ("value", "currency", "uncertain", "n", "document"))) for s in "ab")
        return a.join(b, keys).filter("value_a < value_b")

    # names and addresses are compared once for all cases; the rest costs less to compare than to look up
    texts, values = met(classes.filter(text)), ["field", "value_a", "value_b"]
    judged = materialize(text_verdicts(texts.select(*values).distinct()), "judged").filter("verdict IS NOT NULL")
    told = texts.join(broadcast_if_small(judged), values)
    plain = met(classes.filter(~text)).withColumns({c: F.nullif(c, F.lit("")) for c in ("currency_a", "currency_b")})
    # as a generator a verdict is worked out once; the planner would repeat a projected column in the filters that it pushes down
    plain = plain.select("*", F.explode_outer(F.array(value_verdict())).alias("verdict")).filter("verdict IS NOT NULL")
    found = told.unionByName(plain)
    unsure = F.col("uncertain_a") | F.col("uncertain_b")
    doubted = unsure & F.col("verdict.severity").isin("high", "critical")
    return found.select(
        "case_id", "field", "value_a", "value_b", unsure.alias("uncertain"), "n_a", "n_b", "document_a", "document_b",
        "verdict.classification",
        F.when(doubted, "unclear_reading").otherwise(F.col("verdict.reason")).alias("reason"),
        fn.doubt(F.col("verdict.severity"), F.col("uncertain_a"), F.col("uncertain_b")).alias("severity"),
        F.when(doubted, F.col("verdict.reason")).alias("was_reason"),
        F.when(doubted, F.col("verdict.severity")).alias("was_severity"),
    )
