"""Who sees and who may act on a case, what a submitter is shown, and the order of the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles from the least to the most, and the least role that acts on a case of each tier.
RANKS = {"user": 0, "reviewer_l1": 1, "reviewer_l2": 2, "admin": 3}
TIERS = {"l1": "reviewer_l1", "l2": "reviewer_l2"}
DECIDED = ("approved", "rejected", "closed")


def _rank(role: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair)), role)


def case_visibility(cases: DataFrame, families: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (user_id, case_id): the cases that each submitter may see.

    These are the cases (case_id, submitted_by, family_id, member_id) that they submitted, those of a family
    (family_id, head_user_id) that they head, directly or through a member (member_id, family_id, user_id), and those
    about them. Each way is an equality join, so a user with very many cases is one long list of rows and no loop.
    """
    own = cases.select(F.col("submitted_by").alias("user_id"), "case_id")
    with_family = cases.join(members.select("member_id", F.col("family_id").alias("__of_member"), F.col("user_id").alias("__person")), "member_id", "left")
    about = with_family.select(F.col("__person").alias("user_id"), "case_id")
    both = with_family.select("case_id", F.explode(F.array_distinct(F.array("family_id", "__of_member"))).alias("family_id"))
    headed = both.join(families, "family_id").select(F.col("head_user_id").alias("user_id"), "case_id")
    return own.union(about).union(headed).filter("user_id IS NOT NULL").distinct()


def can_act(role: Column, user_company: Column, case_company: Column, tier: Column, platform_admin: Column) -> Column:
    """May a user approve, reject or escalate a case: of the own company, and of a rank that its tier asks for."""
    least = F.element_at(F.create_map(*(F.lit(x) for t, r in TIERS.items() for x in (t, RANKS[r]))), tier)
    return ~platform_admin & F.coalesce((user_company == case_company) & (_rank(role) >= least), F.lit(False))


def mask_flags(flags: DataFrame, role: str) -> DataFrame:
    """Flags (case_id, tier, score, flags) as ``role`` is shown them: submitters learn only that a case is in review."""
    if role != "user":
        return flags
    return flags.withColumns({"tier": F.lit("pending"), "score": F.lit(None).cast(flags.schema["score"].dataType), "flags": F.lit("In review")})


def queue_order(cases: DataFrame) -> DataFrame:
    """Cases (tier, status, created_at, case_id) with open ones of the second tier first, then the newest."""
    escalated = (F.col("tier") == "l2") & ~F.col("status").isin(*DECIDED)
    return cases.withColumn("__late", F.when(escalated, 0).otherwise(1)).orderBy("__late", F.col("created_at").desc_nulls_last(), "case_id").drop("__late")


def document_role(document_type: Column) -> Column:
    """claim, evidence, other, or pending where there is no type yet."""
    return F.when(document_type.isNull(), "pending").when(document_type == "payment_evidence", "evidence").when(document_type == "other", "other").otherwise("claim")


def is_pdf(content_type: Column, name: Column) -> Column:
    return F.coalesce(content_type == "application/pdf", F.lit(False)) | F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False))


def usage_period(period: str, today: Column) -> tuple[Column, Column]:
    """First and last day (UTC) of a named period; nulls for all_time."""
    none = F.lit(None).cast("date")
    first = F.trunc(today, "month")
    periods = {
        "this_month": (first, today),
        "last_month": (F.add_months(first, -1), F.date_sub(first, 1)),
        "last_30_days": (F.date_sub(today, 29), today),
        "this_year": (F.trunc(today, "year"), today),
        "all_time": (none, none),
    }
    if period not in periods:
        raise ValueError(f"no period {period!r}")
    return periods[period]


def bulk_status(folders: DataFrame, documents: DataFrame, scores: DataFrame) -> DataFrame:
    """Folders (bulk_id, folder, case_id, error) with ``live``: failed, validating, queued, processing, flagged or done.

    Documents (case_id, status) count as finished when they are completed or failed; scores (case_id, tier) flag.
    """
    n = documents.groupBy("case_id").agg(F.count("*").alias("__n"), F.count_if(F.col("status").isin("completed", "failed")).alias("__done"), F.count_if(F.col("status") == "pending").alias("__waiting"))
    joined = folders.join(n, "case_id", "left").join(scores.select("case_id", F.col("tier").alias("__tier")), "case_id", "left")
    live = (
        F.when(F.col("error").isNotNull(), "failed")
        .when(F.col("case_id").isNull(), "validating")
        .when(F.coalesce("__n", F.lit(0)) == F.coalesce("__waiting", F.lit(0)), "queued")
        .when(F.col("__done") < F.col("__n"), "processing")
        .when(F.col("__tier").isin("medium", "high"), "flagged")
        .otherwise("done")
    )
    return joined.select(*folders.columns, live.alias("live"))
