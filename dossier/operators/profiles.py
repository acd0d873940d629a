"""What the documents of a person agree on, which to correct, repeated submissions, votes of several answers, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that two documents must share at least to be one submitted again.
LEAST_COMPARED = 2
#: Words of a type label and the kind of document that they tell; the first that fits wins.
LABEL_WORDS = (
    ("tax_id_card", ("pan", "tax", "permanent account")),
    ("national_id_card", ("aadhaar", "national", "uidai", "aadhar")),
    ("income_certificate", ("income", "aay")),
    ("voter_id_card", ("voter", "epic", "election")),
    ("address_proof", ("address", "bill", "electricity", "water", "gas")),
    ("ration_card", ("ration",)),
    ("marksheet", ("marksheet", "school", "board", "degree", "certificate", "matric")),
)
#: The same for names of files, and what a name without any of them is taken for.
FILE_WORDS = (
    ("national_id_card", ("aadhaar", "national")),
    ("tax_id_card", ("pan", "tax")),
    ("income_certificate", ("income", "aay")),
    ("voter_id_card", ("voter", "epic", "election")),
    ("address_proof", ("address", "bill", "electricity", "water", "gas")),
    ("ration_card", ("ration",)),
    ("marksheet", ("marksheet", "matric", "10th", "12th")),
    ("driving_license", ("driving", "dl", "license")),
    ("passport", ("passport",)),
)
OTHERWISE = "national_id_card"


def infer_document_type(label: Column, file_name: Column) -> Column:
    """The kind of an identity document by its label, else by its file's name; nulls count as empty."""

    def by(text: Column, table: tuple) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        found = [F.when(F.greatest(F.lit(False), *(F.contains(low, F.lit(w)) for w in words)), kind) for kind, words in table]
        return F.coalesce(*found)

    return F.coalesce(by(label, LABEL_WORDS), by(file_name, FILE_WORDS), F.lit(OTHERWISE))


def profile_groups(values: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Rows (case_id, field, status, value, document_id, n_documents, n_candidates, suggested, n_to_correct).

    ``values`` (case_id, field, document_id, value, agrees_as, priority): documents whose values agree have one
    ``agrees_as``; null values are missing. Status is missing, chosen (a row of ``chosen`` (case_id, field, document_id)
    names a document that has a value), agreed (one group) or conflict. A group is shown by its document of least
    priority, of equals the least id. If more than half of the documents are in one group, its document is suggested and
    the others are to be corrected. Two aggregations, the first by group, so that a case of any size is a few numbers.
    """
    key = ["case_id", "field"]
    has = F.col("value").isNotNull()
    best = F.min(F.when(has, F.struct("priority", "document_id", "value")))
    groups = values.groupBy(*key, F.when(has, F.col("agrees_as")).alias("agrees_as")).agg(F.count_if(has).alias("n"), best.alias("best"))
    first = F.min(F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("less"), "best")))
    per = groups.groupBy(*key).agg(F.sum("n").alias("n_documents"), F.count_if(F.col("n") > 0).alias("n_candidates"), first.alias("top"))
    if chosen is not None:
        named = chosen.join(values.filter(has).select(*key, "document_id", F.col("value").alias("__value")), [*key, "document_id"])
        named = named.groupBy(*key).agg(F.min(F.struct(F.col("document_id"), F.col("__value").alias("value"))).alias("pick"))
        per = per.join(named, key, "left")
    else:
        per = per.withColumn("pick", F.lit(None).cast(f"struct<document_id:{values.schema['document_id'].dataType.simpleString()},value:{values.schema['value'].dataType.simpleString()}>"))
    conflict = (F.col("n_candidates") > 1) & F.col("pick").isNull()
    agreed = (F.col("n_candidates") == 1) & F.col("pick").isNull()
    status = F.when(F.col("n_documents") == 0, "missing").when(F.col("pick").isNotNull(), "chosen").when(conflict, "conflict").otherwise("agreed")
    most = -F.col("top.less")
    majority = conflict & (2 * most > F.col("n_documents"))
    shown = lambda name: F.coalesce(F.col(f"pick.{name}"), F.when(agreed, F.col(f"top.best.{name}")))
    return per.select(
        *key, status.alias("status"), shown("value").alias("value"), shown("document_id").alias("document_id"), "n_documents", "n_candidates",
        F.when(majority, F.col("top.best.document_id")).alias("suggested"), F.when(majority, F.col("n_documents") - most).otherwise(0).alias("n_to_correct"),
    )


def profile_corrections(values: DataFrame) -> DataFrame:
    """Rows (case_id, field, document_id, value) of the documents to be corrected: those outside the group that more
    than half of the documents of the case are in."""
    key = ["case_id", "field"]
    held = values.filter("value IS NOT NULL")
    n = held.groupBy(*key, "agrees_as").agg(F.count("*").alias("n"))
    major = n.groupBy(*key).agg(F.sum("n").alias("all"), F.max_by("agrees_as", "n").alias("most_as"), F.max("n").alias("most")).filter("2 * most > all AND most < all")
    return held.join(major, key).filter("agrees_as <> most_as").select(*key, "document_id", "value")


def duplicate_refine(matches: DataFrame, fields: DataFrame) -> DataFrame:
    """Matches (document_id, matched_document_id) with n_compared, n_differ, verdict and severity.

    ``fields`` (document_id, reference_number, date, amount, person), one row a document. Fields that both have are
    compared: numbers by their letters and digits, amounts to a cent. All equal, at least two: resubmission, high; one
    that differs: same_template, low; else unchanged, and the severity stays null.
    """
    theirs = fields.select(F.col("document_id").alias("matched_document_id"), *(F.col(c).alias(f"__{c}") for c in ("reference_number", "date", "amount", "person")))
    both = matches.join(fields, "document_id", "left").join(theirs, "matched_document_id", "left")
    plain = lambda c: F.regexp_replace(F.upper(F.col(c)), "[^0-9A-Z]", "")
    words = lambda c: F.array_sort(F.array_distinct(F.split(F.trim(F.lower(F.col(c))), r"\s+")))
    same = F.array(
        plain("reference_number") == plain("__reference_number"),
        F.col("date") == F.col("__date"),
        F.abs(F.col("amount") - F.col("__amount")) < 0.01,
        words("person") == words("__person"),
    )
    judged = both.withColumn("__same", F.filter(same, lambda s: s.isNotNull()))
    compared, differ = F.size("__same"), F.size(F.filter("__same", lambda s: ~s))
    verdict = F.when(differ > 0, "same_template").when(compared >= LEAST_COMPARED, "resubmission").otherwise("unchanged")
    severity = F.when(differ > 0, "low").when(compared >= LEAST_COMPARED, "high")
    return judged.select(*matches.columns, compared.alias("n_compared"), differ.alias("n_differ"), verdict.alias("verdict"), severity.alias("severity"))


def vote_words(answers: DataFrame, least: int = 2) -> DataFrame:
    """Rows (item_id, word, n_runs): words that at least ``least`` runs of an item give.

    ``answers`` (item_id, run, words: array). Case, marks at the ends and white space don't tell words apart; words
    without a letter or digit don't count.
    """
    word = F.regexp_replace(F.regexp_replace(F.lower("word"), r"^[\x20.:;,-]+|[\x20.:;,-]+$", ""), r"[\x20\t\r\n]+", " ")
    said = answers.select("item_id", "run", F.explode("words").alias("word")).select("item_id", "run", word.alias("word")).filter(F.col("word").rlike(r"[\p{L}\p{N}]"))
    return said.groupBy("item_id", "word").agg(F.countDistinct("run").alias("n_runs")).filter(F.col("n_runs") >= least)


def bulk_tally(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (bulk_id, cases_created, cases_failed, documents_accepted, documents_rejected) of folders (bulk_id,
    folder_id, status) and their files (folder_id, status); each side is summed before they meet."""
    n = lambda value: F.count_if(F.col("status") == value)
    per_folder = files.groupBy("folder_id").agg(n("accepted").alias("a"), n("rejected").alias("r"))
    joined = folders.join(per_folder, "folder_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return joined.groupBy("bulk_id").agg(n("created").alias("cases_created"), n("failed").alias("cases_failed"), total("a").alias("documents_accepted"), total("r").alias("documents_rejected"))


def member_latest_case(members: DataFrame, cases: DataFrame) -> DataFrame:
    """Rows (member_id, n_cases, latest_case): the newest case of each member, of equally new ones the larger id.

    ``members`` (member_id, family_id, is_head, user_id), ``cases`` (case_id, member_id, submitted_by, created_at). A case
    without a member is the head's if the head submitted it. Members without a case have 0 and null.
    """
    named = cases.filter("member_id IS NOT NULL").select("member_id", "case_id", "created_at")
    heads = members.filter("is_head").select("member_id", F.col("user_id").alias("submitted_by"))
    alone = cases.filter("member_id IS NULL").drop("member_id").join(heads, "submitted_by").select("member_id", "case_id", "created_at")
    n = named.union(alone).groupBy("member_id").agg(F.count("*").alias("n_cases"), F.max_by("case_id", F.struct("created_at", "case_id")).alias("latest_case"))
    return members.select("member_id").join(n, "member_id", "left").fillna(0, ["n_cases"])
