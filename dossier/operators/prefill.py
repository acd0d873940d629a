"""Forms filled from profiles, and bundles held against what a scheme asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import age_in_years
from dossier.storage import broadcast_if_small


def profile_sources(profiles: DataFrame, today: str) -> DataFrame:
    """Rows (case_id, source, status, value, document_id): what ``profiles`` (case_id, field, status, value, document_id) can give a form.

    Beside the fields themselves these are age, from the date of birth, and postal_code, from the address: in conflict
    where that is, missing where it has none. A value that is empty is missing."""
    said = profiles.select("case_id", F.col("field").alias("source"), "status", F.nullif("value", F.lit("")).alias("value"), "document_id")
    born = said.filter("source = 'date_of_birth'").withColumn("value", age_in_years(F.col("value").try_cast("date"), F.lit(today).cast("date")).cast("string")).withColumn("source", F.lit("age"))
    code = said.filter("source = 'address'").withColumn("value", F.nullif(F.regexp_extract("value", r"(?<![0-9])[0-9]{6}(?![0-9])", 0), F.lit(""))).withColumn("source", F.lit("postal_code"))
    every = said.unionByName(born).unionByName(code)
    return every.withColumn("status", F.when(F.col("status") == "conflict", "conflict").when(F.col("value").isNull(), "missing").otherwise(F.col("status")))


def form_prefill(cases: DataFrame, profiles: DataFrame, forms: DataFrame, today: str) -> DataFrame:
    """Rows (case_id, form_id, position, key, status, value, source_document_id) of every field of the forms (form_id, case_type,
    position, key, source) of a case's type (case_id, case_type).

    filled with the profile's value and document, needs_attention where the profile is in conflict, else to_fill. Fields
    without a source are for a person to fill. Forms are definitions, few; cases are many."""
    wanted = cases.join(broadcast_if_small(forms), "case_type")
    known = profile_sources(profiles, today)
    met = wanted.join(known, ["case_id", "source"], "left")
    status = F.when(F.col("status") == "conflict", "needs_attention").when(F.col("value").isNotNull(), "filled").otherwise("to_fill")
    full = status == "filled"
    return met.select("case_id", "form_id", "position", "key", status.alias("status"), F.when(full, F.col("value")).alias("value"), F.when(full, F.col("document_id")).alias("source_document_id"))


def form_counts(prefilled: DataFrame) -> DataFrame:
    """Rows (case_id, form_id, filled, needs_attention, to_fill, ready): a form is ready when nothing needs attention."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    found = prefilled.groupBy("case_id", "form_id").agg(count("filled"), count("needs_attention"), count("to_fill"))
    return found.withColumn("ready", F.col("needs_attention") == 0)


def scheme_readiness(documents: DataFrame, schemes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Rows (case_id, scheme, status, band) of each case of ``documents`` (case_id, document_id, document_type, income) and each scheme
    (scheme, requires, bands: the largest incomes of its bands, in order).

    status is missing_document without a document whose type holds what is required, conflict if the case has any (case_id),
    income_unknown or income_above where the income has no band, else ready. The income is that of the latest document
    that tells one. band counts from 1, null without one."""
    told = documents.groupBy("case_id").agg(F.collect_set("document_type").alias("types"), F.max_by("income", F.when(F.col("income").isNotNull(), F.col("document_id"))).alias("income"))
    marked = told.join(conflicts.select("case_id").distinct().withColumn("conflict", F.lit(True)), "case_id", "left")
    every = F.array(*(F.struct(F.lit(s["scheme"]).alias("scheme"), F.lit(s["requires"]).alias("requires"), F.array(*(F.lit(float(b)) for b in s["bands"])).cast("array<double>").alias("bands")) for s in schemes.collect()))  # schemes are few
    each = marked.select("case_id", "types", "income", "conflict", F.explode(every).alias("s"))
    there = F.col("s.requires").isNull() | F.exists("types", lambda t: F.contains(t, F.col("s.requires")))
    band = F.nullif(F.array_position(F.transform("s.bands", lambda b: F.col("income") <= b), F.lit(True)), F.lit(0))
    asks = F.size("s.bands") > 0
    status = F.when(~there, "missing_document").when(F.col("conflict"), "conflict").when(asks & F.col("income").isNull(), "income_unknown").when(asks & band.isNull(), "income_above").otherwise("ready")
    return each.select("case_id", "s.scheme", status.alias("status"), F.when(asks, band).cast("int").alias("band"))
