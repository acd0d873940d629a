"""Duplicate and similarity search: exact content, 64-bit page hashes, embedding vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.storage import materialize

DISTANCE = 5


def content_sha256(files: DataFrame, content: str, key: str) -> DataFrame:
    return files.select(key, F.sha2(F.col(content), 256).alias("sha256"))


def exact_duplicates(files: DataFrame, content: str, key: str) -> DataFrame:
    """Rows (key, sha256, first, copies) of files whose content another one has; ``first`` is the smallest key."""
    hashed = content_sha256(files, content, key)
    groups = hashed.groupBy("sha256").agg(F.min(key).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    return hashed.join(groups, "sha256").select(key, "sha256", "first", "copies")


def shingle_hashes(docs: DataFrame, key: str, text: str, words: int = 3) -> DataFrame:
    """Rows (key, hashes): 64-bit hashes of a text's lower-case word shingles as signed longs, of which ``vote`` makes a
    page hash. Each is the first 64 bits of the shingle's MD5; a shorter text is one shingle."""
    cut = docs.select(key, F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), "").alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - words + 1, F.lit(1)))

    def hashed(i: Column) -> Column:
        shingle = F.array_join(F.slice("w", i, words), " ") if words != 3 else F.concat_ws(" ", F.get("w", i - 1), F.get("w", i), F.get("w", i + 1))
        return F.conv(F.substring(F.md5(shingle.cast("binary")), 1, 16), 16, -10).cast("long")

    return cut.select(key, F.transform(starts, hashed).alias("hashes"))


def vote(hashes: DataFrame, key: str, column: str) -> DataFrame:
    """Rows (key, phash) of the arrays of 64-bit hashes in ``column``."""
    out = T.StructType([hashes.schema[key], T.StructField("phash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column(1):
                h = np.asarray(x.values, dtype=np.int64).astype(">i8")
                ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                found.append(int(np.packbits(ones * 2 > len(h)).view(">i8")[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=out.names)

    return hashes.select(key, column).mapInArrow(run, out)


def _without_one_bit(part: Column, width: int) -> Column:
    """``part`` with one of its lowest ``width`` bits cleared, for each that is set."""
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.call_function("getbit", part, k) == 1)
    return F.transform(set_bits, lambda k: part.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))


def near_duplicates(hashes: DataFrame, key: str = "document_id", distance: int = DISTANCE) -> DataFrame:
    """Rows (phash_a, first_a, phash_b, first_b, distance): for each hash the nearest earlier one within ``distance`` bits.

    Copies of a hash are one row; ``first`` is the smallest key that has it, and earlier is that of a smaller one. Of
    equally near hashes the earliest is told. Hashes are cut into so few segments that one of them differs in at most one
    bit: then the one that has the bit, without it, equals the other's segment. The join tests the distance, and the
    nearest is kept before the shuffle, so there is one row a hash, however many are near.
    """
    distinct = materialize(hashes.groupBy("phash").agg(F.min(key).alias("first")), "hashes")
    n = max(2, distance // 2 + 1)
    plain, reached = [], []
    for i in range(n):
        low, width = 64 * i // n, 64 * (i + 1) // n - 64 * i // n
        part = F.shiftrightunsigned("phash", low).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(i << 32))
        plain.append(part)
        reached.append(F.concat(F.array(part), _without_one_bit(part, width)))
    left = distinct.select(F.explode(F.array(*plain)).alias("slot"), F.struct("first", "phash").alias("x"))
    right = distinct.select(F.explode(F.concat(*reached)).alias("slot"), F.struct("first", "phash").alias("y"))
    apart = F.bit_count(F.col("x.phash").bitwiseXOR(F.col("y.phash")))
    near = left.hint("merge").join(right, (left["slot"] == right["slot"]) & (F.col("x.phash") != F.col("y.phash")) & (apart <= distance))
    ordered = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), apart.cast("int").alias("distance"))
    best = ordered.groupBy("b").agg(F.min(F.struct("distance", "a")).alias("m"))
    return best.select(F.col("m.a.phash").alias("phash_a"), F.col("m.a.first").alias("first_a"), F.col("b.phash").alias("phash_b"), F.col("b.first").alias("first_b"), F.col("m.distance").alias("distance"))


def vector_search(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", queries_at_once: int = 4096) -> DataFrame:
    """Rows (query, match, similarity): the ``k`` most similar other rows of each query by cosine; of equals the
    smallest key. Queries are a stated set, taken in blocks that go to the tasks; each task keeps k for each query of a
    block, and those are merged by an aggregation of k for each task."""
    spark = rows.sparkSession
    out = T.StructType([T.StructField("query", T.LongType()), T.StructField("match", T.LongType()), T.StructField("similarity", T.DoubleType())])
    best = spark.createDataFrame([], out)
    block: list = []

    def search(block: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(([r[0] for r in block], unit(np.array([r[1] for r in block], np.float64))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            top: list[list[tuple[float, int]]] = [[] for _ in ids]
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column(0).to_pylist()
                near = q @ unit(np.stack([np.asarray(v.values, dtype=np.float64) for v in batch.column(1)])).T
                for i, own in enumerate(ids):
                    some = np.argpartition(-near[i], min(k, len(keys) - 1))[: k + 1]
                    level = near[i][some].min()
                    some = np.flatnonzero(near[i] >= level)  # ties at the edge too
                    top[i] = sorted([*top[i], *((-near[i][j], keys[j]) for j in some if keys[j] != own)])[:k]
            rows_ = [(own, m, -s) for own, t in zip(ids, top, strict=True) for s, m in t]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows_], pa.float64() if c == 2 else pa.int64()) for c in range(3)], names=out.names)

        return rows.select(key, vector).mapInArrow(run, out)

    for row in queries.select(key, vector).toLocalIterator():
        block.append(row)
        if len(block) == queries_at_once:
            best, block = best.union(search(block)), []
    if block:
        best = best.union(search(block))
    ranked = F.slice(F.sort_array(F.collect_list(F.struct((-F.round("similarity", 9)).alias("s"), "match"))), 1, k)
    merged = best.groupBy("query").agg(ranked.alias("top")).select("query", F.explode("top").alias("t"))
    return merged.select("query", F.col("t.match").alias("match"), (-F.col("t.s")).alias("similarity"))


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)
