"""Shared-folder tables and size-checked broadcasts, used by every multi-pass operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The largest table that is ever sent to every executor, in rows.
BROADCAST_ROWS = 200_000
#: The largest, in bytes of its values.
BROADCAST_BYTES = 32 << 20


#: With it the shuffle files of a finished write go at once.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes of one Arrow batch of a written computation: a task holds a batch several times, in Spark and in Python.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def settings(spark: SparkSession, asked: dict[str, str]) -> Iterator[None]:
    """The session settings ``asked``, for what is planned and run inside; then those of before hold again."""
    before = {k: spark.conf.get(k, None) for k in asked}
    for k, v in asked.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """No table is broadcast for its guessed size inside: a guess knows neither how many rows an explode makes of one nor how
    far a file is compressed. What ``broadcast_if_small`` has measured is, and what a shuffle turns out to be small."""
    guessed, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    with settings(spark, {guessed: "-1", adaptive: spark.conf.get(adaptive, None) or spark.conf.get(guessed)}):
        yield


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and all its tasks run on this machine a folder of this machine is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="dossier-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    return Scratch(df.sparkSession).table(df, label)


class Scratch:
    """Written tables of one computation, each of which is deleted when it has been used.

    With ``clean`` the shuffle files of each write go when it ends, for computations of many large shuffles. What is
    written must be planned afresh then: no RDD, and nothing that another action has begun to work out.
    """

    def __init__(self, spark: SparkSession, clean: bool = False):
        self.spark, self.clean = spark, clean
        self.paths: dict[str, list[str]] = {}

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """``df``, written to the shared folder under ``label`` and read back."""
        path = new_path(self.spark, label)
        self.paths.setdefault(label, []).append(path)
        asked = BATCHES | ({CLEAN_SHUFFLES: "true"} if self.clean else {})
        with settings(self.spark, asked):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """Delete the tables of ``labels``; what has been derived from them must be written by now."""
        for label in labels:
            for path in self.paths.pop(label, ()):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when it has at most ``max_rows`` rows and its values at most about ``max_bytes`` bytes;
    otherwise the join shuffles.

    Give it a materialized or otherwise cheap table: up to ``max_rows`` + 1 of its rows are counted and measured.
    """
    wide = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType | T.BooleanType | T.DatetimeType)]
    size = F.lit(8 * len(df.columns)).cast("long")
    for name in wide:
        size += F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))).cast("long"), F.lit(0).cast("long"))
    n, many = df.select(size.alias("size")).limit(max_rows + 1).agg(F.count("*"), F.sum("size")).first()
    return F.broadcast(df) if n <= max_rows and (many or 0) <= max_bytes else df


def scratch_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    name, n = f"__{stem}", 0
    while name.lower() in taken:
        n += 1
        name = f"__{stem}_{n}"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
