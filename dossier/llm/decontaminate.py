"""Benchmark decontamination by SimHash of item-sized windows.

Benchmark items are a query set: they are taken in blocks of bounded size, and each block's index goes to the tasks that
read the documents. For an item of n words every window of n words of a document is a candidate place. Windows without
any shingle of the block can't be similar and are passed over by a set lookup; the others get a 64-bit SimHash from
running sums. The items' fingerprints are cut into blocks of 8 bits, and each block's values within two bits are
indexed, so every fingerprint within a radius of 23 bits shares a slot (24 differing bits or more are needed for three
in each of the eight blocks). Candidates within the radius are then held to the exact similarity: the Jaccard
similarity of the multisets of five-word shingles.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.storage import broadcast_if_small, materialize, read_table, scratch_name

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCK_BITS = 8
#: Words of benchmark text whose index is sent to the tasks at a time.
WORDS_PER_BLOCK = 500_000
#: Windows that are fingerprinted at a time.
WINDOWS_AT_ONCE = 8_192

_PUNCTUATION = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
_LOWER = bytes(range(256)).lower()


def normal_words(text: str | None) -> list[bytes]:
    """Words without ASCII punctuation, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER, _PUNCTUATION).split()


def shingles(words: list[bytes], size: int = SHINGLE_WORDS) -> list[bytes]:
    return [b" ".join(s) for s in zip(*(words[i:] for i in range(size)), strict=False)]


def hashes(found: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s) for s in found], np.uint64)


def window_prints(h: np.ndarray, width: int) -> np.ndarray:
    """SimHash of each run of ``width`` hashes: a bit is 1 if over half of them have it."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    sums = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    ones = sums[width:] - sums[:-width]
    return np.packbits(ones * 2 > width, axis=1).view(">u8").ravel().astype(np.uint64)


def similarity(a: Counter, b: Counter) -> float:
    """Jaccard similarity of two multisets."""
    shared = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


@dataclass
class Index:
    """The items of one block; ``slots`` has for each size of item, block number and block value the items there."""

    radius: int = RADIUS
    least: float = SIMILARITY
    ids: list[Any] = field(default_factory=list)
    bags: list[Counter] = field(default_factory=list)
    prints: list[int] = field(default_factory=list)
    sizes_of: dict[bytes, set[int]] = field(default_factory=lambda: defaultdict(set))
    slots: dict[tuple[int, int], dict[int, list[int]]] = field(default_factory=dict)
    whole: dict[bytes, list[int]] = field(default_factory=lambda: defaultdict(list))

    def add(self, item_id: Any, words: list[bytes]) -> None:
        number = len(self.ids)
        self.ids.append(item_id)
        found = shingles(words)
        self.bags.append(Counter(found))
        if not found:
            self.prints.append(0)
            if words:
                self.whole[b" ".join(words)].append(number)
            return
        print_ = int(window_prints(hashes(found), len(found))[0])
        self.prints.append(print_)
        for s in found:
            self.sizes_of[s].add(len(found))
        flips = [sum(1 << i for i in some) for n in range(self.radius // (64 // BLOCK_BITS) + 1) for some in combinations(range(BLOCK_BITS), n)]
        for block in range(64 // BLOCK_BITS):
            slot = self.slots.setdefault((len(found), block), defaultdict(list))
            value = print_ >> (BLOCK_BITS * block) & 0xFF
            for f in flips:
                slot[value ^ f].append(number)

    def near(self, size: int, prints: np.ndarray) -> list[tuple[int, list[int]]]:
        """For each fingerprint the items of ``size`` within the radius, found in the slots of its blocks."""
        at: dict[int, set[int]] = defaultdict(set)
        for block in range(64 // BLOCK_BITS):
            slot = self.slots[(size, block)]
            for i, v in enumerate((prints >> np.uint64(BLOCK_BITS * block) & np.uint64(0xFF)).tolist()):
                if v in slot:
                    at[i].update(slot[v])
        return [(i, good) for i, items in at.items() if (good := [k for k in items if (int(prints[i]) ^ self.prints[k]).bit_count() <= self.radius])]

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item number, best similarity, first such window's start, its words) of the items that a text contains."""
        words = normal_words(text)
        if len(words) < SHINGLE_WORDS:
            return [(k, 1.0, 0, len(words)) for k in self.whole.get(b" ".join(words), [])]
        found = shingles(words)
        hits: dict[int, list[int]] = defaultdict(list)
        for i, s in enumerate(found):
            if s in self.sizes_of:
                for size in self.sizes_of[s]:
                    hits[size].append(i)
        best: dict[int, tuple[float, int, int]] = {}
        for size, places in hits.items():
            width = min(size, len(found))  # a text shorter than the item is one window
            first, at = 0, []
            for i in places:  # windows that hold one of the hits, in order and once
                first = max(first, i - width + 1)
                last = min(i, len(found) - width)
                at += range(first, last + 1)
                first = max(first, last + 1)
            for run in _runs(at):
                prints = window_prints(hashes(found[run[0] : run[-1] + width]), width)
                for i, items in self.near(size, prints):
                    start = run[0] + i
                    bag = Counter(found[start : start + width])
                    for k in items:
                        if (s := similarity(bag, self.bags[k])) >= self.least and (k not in best or s > best[k][0]):
                            best[k] = (s, start, width + SHINGLE_WORDS - 1)
        return sorted((k, *v) for k, v in best.items())


def _runs(numbers: list[int]) -> Iterator[list[int]]:
    """Consecutive numbers together, at most WINDOWS_AT_ONCE in one."""
    run: list[int] = []
    for n in numbers:
        if run and (n != run[-1] + 1 or len(run) == WINDOWS_AT_ONCE):
            yield run
            run = []
        run.append(n)
    if run:
        yield run


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, words_per_block: int, radius: int, least: float) -> Iterator[Index]:
    """Indexes of the benchmark's items, block by block; the driver holds one partition and one block at a time."""
    index, words = Index(radius, least), 0
    for row in benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).toLocalIterator():
        item = normal_words(row["text"])
        index.add(row["item_id"], item)
        words += len(item)
        if words >= words_per_block:
            yield index
            index, words = Index(radius, least), 0
    if index.ids:
        yield index


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    radius: int = RADIUS,
    least: float = SIMILARITY,
    words_per_block: int = WORDS_PER_BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Rows (doc_id, item_id, similarity, start_word, window_words) of the items that documents contain.

    One row for each row of ``docs`` and item of which some item-sized window is similar enough: the best one, and of
    equals the first. Items and texts without words match nothing. An item of under five words matches only a document
    of the same words and no others. Repeated rows and items each have rows of their own; null ids are kept. Other
    columns are not read; an empty table on either side gives no rows.
    """
    out = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("item_id", benchmark.schema[item_id_col].dataType),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("start_word", T.IntegerType()),
            T.StructField("window_words", T.IntegerType()),
        ]
    )
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    result = spark.createDataFrame([], out)
    for index in item_blocks(benchmark, item_id_col, item_text_col, words_per_block, radius, least):
        result = result.union(plain.mapInArrow(_finder(spark, index, out), out))
    return result


def _finder(spark: SparkSession, index: Index, out: T.StructType):  # noqa: ANN202
    sent = spark.sparkContext.broadcast(index)  # bounded by words_per_block
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(out["item_id"].dataType)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            rows = [(i, *m) for i, t in enumerate(batch.column(1)) for m in index.matches(t.as_py())]
            arrays = [
                batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                pa.array([index.ids[r[1]] for r in rows], item_type),
                pa.array([r[2] for r in rows], pa.float64()),
                *(pa.array([r[k] for r in rows], pa.int32()) for k in (3, 4)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return find


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns.

    A row is told by its id and a hash of its text, so that of rows with equal or null ids only those go that contain
    an item. Null and empty texts contain none and stay, as all rows do if the benchmark is empty; an empty table gives
    no rows. A similarity of just the threshold is enough.
    """
    row, rid = scratch_name(docs, "row"), scratch_name(docs, "rid")
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"))
    keyed = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"))
    bad = materialize(contaminated(keyed, benchmark, **how).select("doc_id").distinct(), "contaminated")
    bad = broadcast_if_small(bad.select(F.col("doc_id.id").alias(rid), F.col("doc_id.row").alias(row)))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(rid)) & (F.xxhash64(text_col) == F.col(row)), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
