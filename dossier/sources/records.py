"""Record tables: typed JSON, long finding tables, upserts without MERGE, append-only sinks, tenant scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tenant_scope(table: DataFrame, company_id: object, column: str = "company_id") -> DataFrame:
    """The rows of one company; without a company it raises, so no query reads all tenants by mistake."""
    if company_id is None:
        raise ValueError("a tenant table is read for one company")
    return table.filter(F.col(column) == F.lit(company_id))


def parse_json(table: DataFrame, column: str, schema: str) -> DataFrame:
    """``column`` as a typed struct; text that isn't an object of the schema becomes null fields, the row stays."""
    return table.withColumn(column, F.from_json(column, schema, {"mode": "PERMISSIVE"}))


def explode_findings(checks: DataFrame) -> DataFrame:
    """Rows (keys, check_type, idx, finding, severity) of checks with ``details``, an array of structs; idx from 0."""
    keys = [c for c in checks.columns if c != "details"]
    return checks.select(*keys, F.posexplode("details").alias("idx", "d")).select(*keys, "idx", "d.*")


def explode_sub_checks(checks: DataFrame) -> DataFrame:
    """Rows (keys, sub_check, status) of checks with ``sub_checks``, a map."""
    keys = [c for c in checks.columns if c != "sub_checks"]
    return checks.select(*keys, F.explode("sub_checks").alias("sub_check", "status"))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """One row for each key, that with the largest ``newest``; of equals one from ``new``."""
    cols = stored.columns
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.select(*cols).withColumn("__new", F.lit(1)))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(newest, "__new")).alias("last_row"))
    return last.select(*(F.col("last_row").getField(c).alias(c) for c in cols))


def insert_ignore(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key is not stored, one for each key."""
    return new.join(stored.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def add_counters(stored: DataFrame, deltas: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    return stored.select(*keys, *counters).unionByName(deltas.select(*keys, *counters)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counters))


def append_by_day(events: DataFrame, path: str, time: str = "ts") -> None:
    """Append to a table that is partitioned by UTC day, so searches by time read only their days."""
    events.withColumn("day", F.to_date(time)).write.mode("append").partitionBy("day").parquet(path)


def rule_new_version(current: DataFrame, edits: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """New immutable rows, version + 1, of the edits that change anything; an edit without a current rule is version 1."""
    old = current.select(*keys, F.col("version").alias("__version"), F.struct(*content).alias("__old"))
    joined = edits.select(*keys, *content).join(old, keys, "left")
    changed = joined.filter(~F.struct(*content).eqNullSafe(F.col("__old")))
    return changed.select(*keys, (F.coalesce("__version", F.lit(0)) + 1).alias("version"), *content)


def seed_rules(templates: DataFrame, companies: DataFrame, existing: DataFrame) -> DataFrame:
    """Active templates for each company, without the rules that it has. Every company gets every template: companies
    carry the template list as one small array, which is exploded."""
    packed = templates.filter("is_active").agg(F.collect_list(F.struct(*templates.columns)).alias("t")).select("t").scalar()
    each = companies.select("company_id", packed.alias("t")).select("company_id", F.explode("t").alias("t")).select("company_id", "t.*")
    return each.join(existing.select("company_id", "rule_id"), ["company_id", "rule_id"], "left_anti")


def without_nulls(column: Column, kind: T.DataType) -> Column:
    """NUL characters removed from every string of a nested value."""
    if isinstance(kind, T.StringType):
        return F.replace(column, F.lit("\u0000"), F.lit(""))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: without_nulls(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: without_nulls(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*(without_nulls(column.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))
    return column


def strip_null_bytes(table: DataFrame) -> DataFrame:
    return table.select(*(without_nulls(F.col(f.name), f.dataType).alias(f.name) for f in table.schema.fields))


def file_acceptance(files: DataFrame, limit_bytes: int) -> DataFrame:
    """Files (name, size, head: first bytes as hex) with the first rule that they break, null if none."""
    suffix = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(F.col("head").startswith("255044462D"), "pdf").when(F.col("head").startswith("FFD8FF"), "jpg").when(F.col("head").startswith("89504E47"), "png").when(F.col("head").startswith("504B0304"), "zip")
    same = (suffix == kind) | ((suffix == "jpeg") & (kind == "jpg"))
    code = F.when(F.col("size") == 0, "empty").when(F.col("size") > limit_bytes, "too_large").when(kind.isNull(), "unknown_type").when(~same, "extension_mismatch")
    return files.withColumn("code", code).withColumn("accepted", code.isNull())


def bulk_plan(entries: DataFrame, limit_bytes: int) -> DataFrame:
    """Rows (bulk_id, folder, n_files, n_rejected, status) of archive entries (bulk_id, path, size).

    Separators become "/" and empty parts go; hidden and system entries are junk. If all entries stand in one folder
    that has folders, that wrapper is stripped once. A deeper folder inside a case's folder makes the case an error.
    """
    parts = F.filter(F.split(F.translate("path", "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    clean = entries.select("bulk_id", "size", parts.alias("p")).filter((F.size("p") > 0) & ~F.exists("p", lambda x: x.startswith(".") | (x == "__MACOSX") | (x == "Thumbs.db")))
    tops = clean.groupBy("bulk_id").agg(F.countDistinct(F.get("p", F.lit(0))).alias("n_tops"), F.min(F.size("p")).alias("least"))
    wrapped = clean.join(tops, "bulk_id").withColumn("p", F.when((F.col("n_tops") == 1) & (F.col("least") > 2), F.slice("p", 2, 1000)).otherwise(F.col("p")))
    rejected = F.count_if((F.col("size") > limit_bytes) | (F.col("size") == 0))
    plan = wrapped.filter(F.size("p") > 1).groupBy("bulk_id", F.get("p", F.lit(0)).alias("folder")).agg(F.count("*").alias("n_files"), rejected.alias("n_rejected"), F.max(F.size("p")).alias("depth"))
    status = F.when(F.col("depth") > 2, "nested_folder").when(F.col("n_files") == F.col("n_rejected"), "no_documents").otherwise("ok")
    return plan.select("bulk_id", "folder", "n_files", "n_rejected", status.alias("status"))
