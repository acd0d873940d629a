"""Signatures and stamps: ink read as words, signatures against a reference, reuse, and stamps that were typed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import fuzzy
from dossier.functions.text import cosine
from dossier.operators.regions import BOX, area, overlapping, shared_area

#: Share of a word inside a signature, and how many times the usual height large handwriting has.
INK_SHARE, LARGE = 0.5, 1.8
#: Similarities of one signer and of two, of one image used again, and below which printed names are two.
MATCH, DIFFERENT, REUSE, OTHER_LABEL = 0.55, 0.40, 0.93, 60.0
# Fields that name a person, and what a typed stamp is made of.
PERSON_ROLE = "(?i)prepared|signed|signator|signature|authori[sz]ed|approved|issued_by|received_by|checked|verified|cashier|accountant|principal|manager|director|officer|registrar"
TYPED = ("text", "vector", "text_and_vector")
# Apps of phones and makers of office scanners.
PHONE_SCANNER = r"(?i)\b(?:camscanner|adobe\s+scan|microsoft\s+lens|office\s+lens|genius\s+scan|tap\s?scanner)\b"
OFFICE_SCANNER = r"(?i)konica|minolta|bizhub|\bdevelop\b|\bineo\b|\bcanon\b|imagerunner|\bricoh\b|\bxerox\b|\bhp\b|hewlett|\bkyocera\b|taskalfa|\bsharp\b|\bbrother\b|\bepson\b|\bmfp[0-9]*\b"


def signature_words(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows (document_id, page, word_no, text, box) of the words that are signature ink: at least INK_SHARE of them lies in one detected
    signature (document_id, page, kind, box; a null kind is a signature), or they are handwritten and LARGE times as high as the
    median word of their page. Words are (document_id, page, word_no, text, box, handwritten). The median is exact: heights
    are counted first, so a page of any size is a row for each height."""
    boxed = words.filter("trim(text) <> ''").withColumn("box", F.struct(*BOX))
    heights = boxed.groupBy("document_id", "page", "height").agg(F.count("*").alias("n"))
    median = heights.groupBy("document_id", "page").agg(F.expr("percentile(height, 0.5, n)").alias("median"))
    large = boxed.filter("handwritten").join(median, ["document_id", "page"]).filter((F.col("median") > 0) & (F.col("height") >= LARGE * F.col("median")))
    signed = regions.filter(F.coalesce("kind", F.lit("signature")) == "signature").select("document_id", F.coalesce("page", F.lit(1)).alias("page"), F.struct(*BOX).alias("region"))
    keys = ["document_id", "page"]
    inside = overlapping(boxed.select(*keys, "word_no", "text", "box"), signed, keys, "box", "region", shared_area(F.col("box"), F.col("region")) / area(F.col("box")) >= INK_SHARE)
    columns = [*keys, "word_no", F.trim("text").alias("text"), "box"]
    return inside.select(*columns).union(large.select(*columns)).dropDuplicates([*keys, "word_no"])


def strip_signature_text(fields: DataFrame, ink: DataFrame) -> DataFrame:
    """Rows (document_id, field, value, value_as_read) of ``fields`` (document_id, field, value, page, box): words that were read from
    signature ink (see signature_words) are left out of fields that name a person; value_as_read is what was there, null
    where nothing went. A field with a box loses only ink that meets it, one without a box any ink word of its text. A value
    of ink alone becomes null. Fields are told by (document_id, field)."""
    person = fields.filter(F.col("field").rlike(PERSON_ROLE) & F.col("value").isNotNull())
    bare = lambda t: F.trim(F.lower(t), F.lit(".,:;"))
    tokens = person.select("document_id", "field", F.col("page").alias("f_page"), F.col("box").alias("f_box"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("at", "token"))
    met = tokens.join(ink.select("document_id", "page", F.col("box").alias("i_box"), F.lower("text").alias("ink")), (tokens["document_id"] == ink["document_id"]) & (bare(F.col("token")) == F.col("ink"))).drop(ink["document_id"])
    touches = F.col("f_box").isNull() | ((F.coalesce("f_page", F.lit(1)) == F.col("page")) & (shared_area(F.col("f_box"), F.col("i_box")) > 0))
    gone = met.filter(touches).select("document_id", "field", bare(F.col("token")).alias("word")).distinct()
    kept = tokens.withColumn("word", bare(F.col("token"))).join(gone, ["document_id", "field", "word"], "left_anti")
    rebuilt = kept.groupBy("document_id", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), " ").alias("rest"))
    changed = gone.select("document_id", "field").distinct().withColumn("changed", F.lit(True))
    out = fields.join(changed, ["document_id", "field"], "left").join(rebuilt, ["document_id", "field"], "left")
    return out.select("document_id", "field", F.when(F.col("changed"), F.col("rest")).otherwise(F.col("value")).alias("value"), F.when(F.col("changed"), F.col("value")).alias("value_as_read"))


def reference_signature_compare(signatures: DataFrame, references: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (case_id, document_id, reason, severity, similarity) of every other document of a case (case_id, document_id) with the
    reference document (case_id, document_id) of that case: the best cosine of any of their signatures (document_id, vector).

    A star, never all pairs: a document meets the signatures of one reference. Without a signature it is signature_absent,
    harmless; cases whose reference has no signature have no rows."""
    star = references.select("case_id", F.col("document_id").alias("reference_id")).join(signatures.select(F.col("document_id").alias("reference_id"), F.col("vector").alias("r")), "reference_id")
    others = documents.join(star.select("case_id", "reference_id").distinct(), "case_id").filter("document_id <> reference_id")
    scored = others.join(star, ["case_id", "reference_id"]).join(signatures, "document_id").groupBy("case_id", "document_id").agg(F.max(cosine(F.col("r"), F.col("vector"))).alias("similarity"))
    found = others.select("case_id", "document_id").join(scored, ["case_id", "document_id"], "left")
    s = F.col("similarity")
    reason = F.when(s.isNull(), "signature_absent").when(s >= MATCH, "signature_match").when(s >= DIFFERENT, "signature_uncertain").otherwise("signature_mismatch")
    severity = F.when(s.isNull() | (s >= MATCH), "info").when(s >= DIFFERENT, "medium").otherwise("high")
    return found.select("case_id", "document_id", reason.alias("reason"), severity.alias("severity"), F.round("similarity", 6).alias("similarity"))


def signature_reuse_verdict(similarity: Column, label: Column, reference_label: Column) -> Column:
    """identical_reuse, or reused_different_signer where the names printed below both are two; null below the bound."""
    read = (F.coalesce(label, F.lit("")) != "") & (F.coalesce(reference_label, F.lit("")) != "")
    other = read & (fuzzy.score_column("token_set", label, reference_label) < OTHER_LABEL)
    return F.when(similarity >= REUSE, F.when(other, "reused_different_signer").otherwise("identical_reuse"))


def signature_pick_region(regions: DataFrame, kind: str = "signature") -> DataFrame:
    """Rows (document_id, page, box, confidence): the most confident region of ``kind`` of each document; of equals the first by number."""
    one = regions.filter(F.col("kind") == kind).groupBy("document_id").agg(F.min_by(F.struct("page", F.struct(*BOX).alias("box"), "confidence"), F.struct(-F.coalesce("confidence", F.lit(0.0)), "region_no")).alias("r"))
    return one.select("document_id", "r.page", "r.box", "r.confidence")


def stamp_checks(documents: DataFrame, stamps: DataFrame, signatures: DataFrame) -> DataFrame:
    """Rows (document_id, authenticity, unsigned) of ``documents`` (document_id, detected): is a stamp (document_id, material) typed into the
    file, and is there no signature (document_id) beside such a stamp? skipped while nothing was detected, without stamps,
    or where no material was recorded."""
    made = stamps.groupBy("document_id").agg(F.bool_or(F.col("material").isin(*TYPED)).alias("typed"), F.count("material").alias("told"), F.count("*").alias("stamps"))
    signed = signatures.groupBy("document_id").agg(F.count("*").alias("signed"))
    all_ = documents.join(made, "document_id", "left").join(signed, "document_id", "left")
    known = F.col("detected") & (F.coalesce("stamps", F.lit(0)) > 0)
    typed = F.coalesce("typed", F.lit(False))
    authenticity = F.when(~known | (F.col("told") == 0), "skipped").when(typed, "flag").otherwise("pass")
    unsigned = F.when(~known | ~typed, "skipped").when(F.coalesce("signed", F.lit(0)) > 0, "pass").otherwise("flag")
    return all_.select("document_id", F.coalesce(authenticity, F.lit("skipped")).alias("authenticity"), F.coalesce(unsigned, F.lit("skipped")).alias("unsigned"))


def scan_checks(text: Column, producer: Column, creator: Column, images: Column) -> tuple[Column, Column]:
    """(rescan, fake_scan) of a document's text, producer and creator (both null: unknown) and number of images (null: not counted).

    rescan: a phone's watermark in a file that an office scanner made. fake_scan: a watermark in a file without any image."""
    mark = F.coalesce(text.rlike(PHONE_SCANNER), F.lit(False))
    device = F.concat_ws(" / ", producer, creator)
    rescan = F.when(producer.isNull() & creator.isNull(), "skipped").when(mark & device.rlike(OFFICE_SCANNER), "flag").otherwise("pass")
    return rescan, F.when(~mark | images.isNull(), "skipped").when(images == 0, "flag").otherwise("pass")
