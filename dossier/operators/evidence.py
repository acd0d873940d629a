"""Evidence of five kinds in one long table, rules as data over it, and the hits of each rule on each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.storage import broadcast_if_small

#: Columns of evidence. ``idx`` is an item's place in its check, ``note`` what a reason says of it.
EVIDENCE = ("company_id", "case_id", "document_id", "kind", "check_type", "name", "severity", "idx", "note")
KINDS = ("finding", "sub_check", "check_result", "cross_document", "signature_match")


def gather_evidence(documents: DataFrame, **tables: DataFrame) -> DataFrame:
    """One row (``EVIDENCE``) for each item that a rule can speak of.

    ``documents`` (company_id, case_id, document_id) says whose a document is. ``tables`` by kind: finding (document_id,
    check_type, name, severity, idx, note), sub_check (document_id, check_type, name, severity: its status, note) of which
    only flagged ones count, check_result (document_id, check_type, name, note), signature_match (document_id, name,
    note), and cross_document (company_id, case_id, name, severity, note, classification, review_status), which speaks of a case;
    a conflict that a reviewer dismissed is none. A missing column is null, a kind without a table has no rows.
    """
    if unknown := set(tables) - set(KINDS):
        raise ValueError(f"no kind of evidence: {', '.join(sorted(unknown))}")
    types = {"company_id": "bigint", "case_id": "bigint", "document_id": "bigint", "idx": "int"}
    owners = documents.select("company_id", "case_id", "document_id")
    own = None
    for kind, table in tables.items():
        if kind == "sub_check":
            table = table.filter("severity = 'flag'")
        if kind == "cross_document":
            table = table.filter("NOT coalesce(classification = 'conflict' AND review_status = 'dismissed', false)")
        table = table.withColumn("kind", F.lit(kind))
        rows = table.select(*(F.col(c).cast(types.get(c, "string")).alias(c) if c in table.columns else F.lit(None).cast(types.get(c, "string")).alias(c) for c in EVIDENCE))
        if kind != "cross_document":
            rows = rows.drop("company_id", "case_id").join(owners, "document_id").select(*EVIDENCE)
        own = rows if own is None else own.unionByName(rows)
    return own


def hits_by_document(evidence: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (company_id, case_id, rule_id, weight, is_active, document_id, n, first_note): each rule on each document.

    ``rules``: rule_id, kind, check_type (null: any), names and severities (arrays, null: any), weight, is_active. Inactive
    rules match too, so that ``uncovered`` doesn't speak of what they cover; ``active_hits`` leaves them out. The note is
    that of the first item by its place, of equal places the smaller one. Rules are few, so the join sends them and leaves the evidence where it is.
    """
    r = broadcast_if_small(rules).alias("r")
    e = evidence.alias("e")
    fits = (
        (F.col("e.kind") == F.col("r.kind"))
        & (F.col("r.check_type").isNull() | (F.col("e.check_type") == F.col("r.check_type")))
        & (F.col("r.names").isNull() | F.array_contains("r.names", F.col("e.name")))
        & (F.col("r.severities").isNull() | F.array_contains("r.severities", F.col("e.severity")))
    )
    keys = ("company_id", "case_id", "rule_id", "weight", "is_active", "document_id")
    found = e.join(r, fits).select("e.*", "r.rule_id", "r.weight", "r.is_active")
    return found.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("note", F.struct(F.coalesce("idx", F.lit(0)), F.coalesce("note", F.lit("")))).alias("first_note"))


def active_hits(hits: DataFrame) -> DataFrame:
    """Rows (company_id, case_id, rule_id, weight, n_documents) as ``risk_score`` takes them; a case counts as one."""
    n = F.greatest(F.countDistinct("document_id"), F.lit(1))
    return hits.filter("is_active").groupBy("company_id", "case_id", "rule_id", "weight").agg(n.alias("n_documents"))


def uncovered(evidence: DataFrame, rules: DataFrame, material: tuple[str, ...] = ("critical", "high", "medium")) -> DataFrame:
    """Rows (check_type, name, severity, n) of the material findings that no rule, active or not, speaks of.

    Findings are counted by what rules look at before they meet the rules, so the join is of kinds, not of items.
    """
    n = evidence.filter((F.col("kind") == "finding") & F.col("severity").isin(*material)).groupBy("check_type", "name", "severity").agg(F.count("*").alias("n"))
    r = broadcast_if_small(rules.filter("kind = 'finding'")).alias("r")
    covered = (
        (F.col("r.check_type").isNull() | (F.col("n.check_type") == F.col("r.check_type")))
        & (F.col("r.names").isNull() | F.array_contains("r.names", F.col("n.name")))
        & (F.col("r.severities").isNull() | F.array_contains("r.severities", F.col("n.severity")))
    )
    return n.alias("n").join(r, covered, "left_anti")


def document_fingerprint(cases: DataFrame, documents: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows (case_id, fingerprint): one hash of the documents of a case and of its active hits with their counts.

    Documents and hits come as 64-bit hashes that are summed, so that a case of any size is a few numbers and no list.
    """
    of_documents = documents.groupBy("case_id").agg(F.count("*").alias("n_documents"), F.sum(F.xxhash64("document_id").cast("decimal(38,0)")).alias("documents"))
    of_hits = hits.filter("is_active").groupBy("case_id").agg(F.count("*").alias("n_hits"), F.sum(F.xxhash64("rule_id", "document_id", "n").cast("decimal(38,0)")).alias("hits"))
    joined = cases.select("case_id").join(of_documents, "case_id", "left").join(of_hits, "case_id", "left")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("n_documents", "documents", "n_hits", "hits")]
    return joined.select("case_id", F.sha2(F.concat_ws(":", *parts), 256).alias("fingerprint"))


def latest_assessment(assessments: DataFrame) -> DataFrame:
    """The newest assessment of each case by ``computed_at``; of equally new ones that of the larger fingerprint."""
    last = assessments.groupBy("case_id").agg(F.max_by(F.struct(*assessments.columns), F.struct("computed_at", "fingerprint")).alias("last_row"))
    return last.select(*(F.col("last_row").getField(c).alias(c) for c in assessments.columns))


def finding_counts(findings: DataFrame) -> DataFrame:
    """Rows (case_id, n_open, n_confirmed, n_no_issue) of findings (case_id, resolution)."""
    n = lambda value: F.count_if(F.col("resolution") == value)
    return findings.groupBy("case_id").agg(n("open").alias("n_open"), n("conflict_confirmed").alias("n_confirmed"), n("no_issue").alias("n_no_issue"))


def comparison_summary(comparisons: DataFrame, findings: DataFrame) -> DataFrame:
    """Comparisons with n_conflicts and n_open of their findings (comparison_id, classification, review_status)."""
    conflict = F.col("classification") == "conflict"
    n = findings.groupBy("comparison_id").agg(F.count_if(conflict).alias("n_conflicts"), F.count_if(conflict & ~F.coalesce(F.col("review_status").isin("accepted", "dismissed"), F.lit(False))).alias("n_open"))
    return comparisons.join(n, "comparison_id", "left").fillna(0, ["n_conflicts", "n_open"])
