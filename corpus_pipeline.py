"""A corpus-preparation pipeline of five operators: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of ``documents``. Between stages the rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossier.llm import decontaminate, packing, quality, secret_scan, simhash
from dossier.storage import Scratch, measured_broadcasts, new_path, read_table


#: A session setting: the folder of a blob ledger that several runs share. Where it is unset, each run has its own.
LEDGER_SETTING = "spark.dossier.ledger"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant rejects go; it is fitted on the labelled rows of ``docs``.

    Null and empty texts are scored as texts without words, repeated rows alike. Without labels nothing is rejected.
    """
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id.

    Texts without words are no copies of each other; see ``deduplicate`` for null ids and repeated rows.
    """
    return simhash.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and empty texts contain none, and none go without a benchmark."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; all documents stay.

    With a shared ledger (``LEDGER_SETTING``) only texts that no earlier run has seen are scanned; the result is the same.
    """
    ledger = spark.conf.get(LEDGER_SETTING, None) or new_path(spark, "ledger")
    return secret_scan.redact_secrets(docs, secret_scan.BlobLedger(spark, ledger))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset) of the packed pieces of all documents; an empty
    text is its end token alone. ``pack_documents`` gives the token ids too with ``keep_ids``."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: Fingerprints, discriminant and packing are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark)
    with measured_broadcasts(spark):
        for i, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i + 1 < len(STAGES):
                docs = scratch.table(docs, f"stage{i}")
                scratch.drop(f"stage{i - 1}")
    return docs
