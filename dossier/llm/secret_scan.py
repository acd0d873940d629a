"""Secret scans over a history of texts with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger keeps one row for each blob and rule
version that was ever scanned, with what was found, so a scan reads only blobs that are new to this rule version, and
each once however many paths and versions hold it. Findings are joined back to all of them by address.

All of it is DataFrame functions. Positions come from the texts between matches: their lengths and those of the matches
add up to each match's start in code points.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.storage import broadcast_if_small, materialize, new_path, read_table, scratch_name


@dataclass(frozen=True)
class Rule:
    """A Java pattern; a match is dropped, and not tried again, if its group ``group`` is shorter than ``least``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a run of the class is taken whole, so a least length in the pattern drops the same matches
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,2}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # begins a run of its class, so a run is read once; one that begins within a longer run is none
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
)
RULES = BASE_RULES + ADDED_RULES
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: Matches that an inner fold takes. What was found is copied once for so many and not for each, which would take time
#: with the square of a text's matches.
AT_ONCE = 256


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    """A name that changes with any rule."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is worked out once however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _blocks(items: Column) -> Column:
    """The array ``items`` as an array of arrays of at most AT_ONCE of them."""
    return _let(items, lambda all_: F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(AT_ONCE)), lambda i: F.slice(all_, i + 1, F.lit(AT_ONCE))))


def _spans_of(text: Column, rule: Rule, rank: int) -> Column:
    pattern = F.lit(rule.pattern)
    pieces = F.zip_with(F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, match: F.struct(F.char_length(gap).alias("gap"), match.alias("match")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.char_length(x["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        good = x["match"].isNotNull()
        if rule.least:
            good &= F.char_length(F.regexp_extract(x["match"], rule.pattern, rule.group)) >= rule.least
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    def block(acc: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(acc["at"].alias("at"), F.array().cast(SPANS).alias("found")), step)
        return _let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["found"], r["found"]).alias("found")))

    found = F.aggregate(_blocks(pieces), F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found")), block, lambda acc: acc["found"])
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(SPANS))


def spans_column(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans (start, rank, end, kind) of ``text`` in code points, end exclusive, by start and then rule order."""
    return F.sort_array(F.concat(*(_spans_of(text, r, i) for i, r in enumerate(rules))))


class BlobLedger:
    """Scanned blobs under a folder that all executors share: one subfolder for each rule version, one table a scan.

    A scan that fails leaves no committed rows, so a later one does its work again; two scans at a time may both scan a
    blob, and the reader keeps one of the equal rows.
    """

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES) -> None:
        self.spark, self.rules, self.folder = spark, rules, f"{path.rstrip('/')}/{rule_version(rules)}"

    def read(self) -> DataFrame | None:
        """Rows (blob, spans) of this rule version, or None before the first scan."""
        try:
            return self.spark.read.schema(f"blob string, spans {SPANS}").parquet(f"{self.folder}/scan-*")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition()):
                raise
            return None

    def scan(self, addressed: DataFrame) -> int:
        """Scan the blobs of ``addressed`` (blob, text) that this rule version has not seen; returns how many."""
        unseen = addressed.filter(F.col("blob").isNotNull())
        if (seen := self.read()) is not None:
            unseen = unseen.join(seen.select("blob"), "blob", "left_anti")
        # copies are put together before the shuffle, so a text with very many copies is no hot key
        blobs = unseen.groupBy("blob").agg(F.first("text").alias("text"))
        path = f"{self.folder}/scan-{uuid.uuid4().hex}"
        blobs.select("blob", spans_column(F.col("text"), self.rules).alias("spans")).write.parquet(path)
        return self.spark.read.parquet(path).count()

    def findings(self) -> DataFrame:
        """Rows (blob, spans), one for each blob in which something was found."""
        return self.read().filter(F.size("spans") > 0).dropDuplicates(["blob"])


def scan_history(versions: DataFrame, ledger: BlobLedger, text_col: str = "text") -> DataFrame:
    """``versions`` (any columns; one row for each version of a path) without its text, with blob and spans.

    A null text is an empty one. Rows without findings have an empty array of spans, repeated rows stay repeated, an
    empty table gives no rows. A clashing column of the name blob or spans is replaced.
    """
    address = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    ledger.scan(versions.select(address.alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    rest = [c for c in versions.columns if c.lower() not in {text_col.lower(), "blob", "spans"}]
    found = materialize(ledger.findings(), "findings")
    joined = versions.select(*rest, address.alias("blob")).join(found, "blob", "left")
    return joined.select(*rest, "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def _redacted(text: Column, spans: Column) -> Column:
    """``text`` with its ``spans`` replaced by their kinds. A block of spans looks only at its own part of the text."""

    def block(acc: Column, some: Column) -> Column:
        base = acc["at"]
        upto = F.greatest(base, F.array_max(F.transform(some, lambda s: s["end"])))

        def inner(part: Column) -> Column:
            def step(own: Column, s: Column) -> Column:
                gap = F.substring(part, own["at"] - base + 1, s["start"] - own["at"])
                out = F.when(s["start"] >= own["at"], F.concat(own["out"], gap, F.lit("<"), s["kind"], F.lit(">"))).otherwise(own["out"])
                return F.struct(F.greatest(own["at"], s["end"]).alias("at"), out.alias("out"))

            return F.aggregate(some, F.struct(base.alias("at"), F.lit("").alias("out")), step)

        return _let(_let(F.substring(text, base + 1, upto - base), inner), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], r["out"]).alias("out")))

    return F.aggregate(_blocks(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), block, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))


def redact_secrets(docs: DataFrame, ledger: BlobLedger, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret replaced by its kind in angle brackets; overlapping ones become one.

    No row goes and no other column changes, except that ``length_col``, where ``docs`` has it, holds the length of a
    changed text. Null texts stay null, repeated rows stay repeated, an empty table gives no rows.
    """
    blob, spans = scratch_name(docs, "blob"), scratch_name(docs, "spans")
    address = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    ledger.scan(docs.select(address.alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    found = broadcast_if_small(materialize(ledger.findings(), "findings")).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    joined = docs.withColumn(blob, address).join(found, blob, "left")
    joined = joined.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(_redacted(F.col(text_col), F.col(spans))))
    if length_col and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        joined = joined.withColumn(length_col, F.when(F.col(spans).isNull(), F.col(length_col)).otherwise(F.char_length(text_col).cast(kind)))
    return joined.select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """The columns that the query op6 returns."""

    def text_of(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    return found.select("doc_id", *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)), F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a history of one version each, with a ledger that begins empty."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(scan_history(docs, BlobLedger(spark, new_path(spark, "ledger"))))
