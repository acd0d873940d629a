"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into so few segments that two fingerprints within the radius have one segment that differs by at
most one bit (radius 2: two segments of 32 bits). Two segments differ in bit i alone exactly if they have the same
one-wildcard variant at i. Such a variant is written with its wildcard bit cleared: the segment that has the bit clear
is then the variant itself, so one side of the join indexes plain segments and the other the variants in which a set
bit is cleared. Every pair that differs in one bit meets once, equal segments meet in the plain one. The equality join
verifies the whole distance inside the join, so it emits links, never all pairs of a bucket.

Equal fingerprints are one row before any join, so thousands of copies cost as much as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.components import connected_components
from dossier.storage import Scratch, broadcast_if_small, materialize, measured_broadcasts, read_table, scratch_name

SEED = 42
#: Shingles hashed at a time; bounds a task's memory for very long texts.
HASHES_AT_ONCE = 65_536
#: Odd constants that spread one shingle hash over further fingerprint words.
SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

#: The stage: fingerprints that have a plain segment are represented by so many of them in the first join, and
#: those that have a prefix shingle by so many.
LEADERS, STARS = 4, 2
#: The exact join of the stage: words of a text's bitmap, shingles that are carried to make a pair once, one text in so
#: many is read for the frequent shingles, and how many of those are kept. None of them changes which pairs are found.
BITMAP_WORDS, HEAD, SAMPLE, FREQUENT, FREQUENT_MOST = 8, 8, 8, 3, 200_000
#: Texts of up to so many distinct shingles carry all of them into that join, so it makes no pair of them that is no link.
WHOLE = 256
#: Stage defaults: the largest radius of which two segments guarantee one that differs in at most one bit; the similarity.
STAGE_RADIUS, STAGE_SIMILARITY = 3, 0.8


def text_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int) -> Iterator[bytes]:
    """Space-joined runs of ``size`` words, repeats included; a shorter text is one shingle, an empty one none."""
    if len(words) <= size:
        yield from [b" ".join(words)] if words else []
    else:
        yield from map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))


def simhash(words: list[bytes], size: int, n_words: int = 1) -> list[int]:
    """Fingerprint as ``n_words`` unsigned 64-bit numbers; a bit is 1 if over half of the hashes have it."""
    rest = shingles(words, size)

    def blocks() -> Iterator[np.ndarray]:
        while True:
            yield np.array([xxhash.xxh64_intdigest(s, SEED) for s in islice(rest, HASHES_AT_ONCE)], np.uint64)

    return print_of(blocks(), n_words)


def print_of(blocks: Iterator[np.ndarray], n_words: int) -> list[int]:
    """The fingerprint of the hashes of ``blocks``, up to the first empty block."""
    ones, total = np.zeros((n_words, 64), np.int64), 0
    for h in blocks:
        if not len(h):
            break
        total += len(h)
        for k in range(n_words):
            if k:
                h = h * np.uint64(SPREAD[(k - 1) % len(SPREAD)])
                h ^= h >> np.uint64(29)
            bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones[k] += bits.sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(ones[k] * 2 > total).tobytes(), "big") for k in range(n_words)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle_words: int = 3, n_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, f0, f1, ...) of every row of ``docs``; a fingerprint word is a signed long with the same bits."""
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(f"f{k}", T.LongType()) for k in range(n_words))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(text_words(t.as_py()), shingle_words, n_words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([signed(f[k]) for f in found], pa.int64()) for k in range(n_words))], names=out.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def segments_of(n_words: int, segment_bits: int) -> list[tuple[int, int, int]]:
    """(first bit, width, number) of the segments that cover the fingerprint, as equal as can be."""
    n = -(-64 * n_words // segment_bits)
    cuts = [64 * n_words * i // n for i in range(n + 1)]
    return [(a, b - a, i) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def _segment(first: int, width: int, side: str = "") -> Column:
    """The bits first .. first + width of the words f0, f1, ... (bit 0 is the lowest of f0) as a long."""
    word, shift = divmod(first, 64)
    low = F.shiftrightunsigned(F.col(f"{side}f{word}"), shift)
    if shift + width > 64:
        low = low.bitwiseOR(F.shiftleft(F.col(f"{side}f{word + 1}"), 64 - shift))
    return low.bitwiseAND(F.lit((1 << width) - 1))


def _cleared(segment: Column, width: int, number: int) -> Column:
    """The variants of a segment in which one set bit is cleared, as (slot, whole) structs."""

    def is_set(i: Column) -> Column:
        return F.call_function("getbit", segment, i) == 1

    def variant(i: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), i)
        return F.struct(segment.bitwiseXOR(bit).bitwiseOR(F.lit(number << 32)).alias("slot"), F.lit(False).alias("whole"))

    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(width - 1)), is_set), variant)


def links(distinct: DataFrame, n_words: int, segment_bits: int, radius: int) -> DataFrame:
    """Rows (a, b) of ``distinct`` (key, f0, ...; one row for each fingerprint) within ``radius`` of each other.

    Segments have 32 bits at most. With more than radius / 2 segments no pair is lost. With fewer or shorter segments than
    that a pair is found if any segment differs by at most one bit.
    """
    cols = ["key", *(f"f{k}" for k in range(n_words))]
    plain, variants = [], []
    for first, width, number in segments_of(n_words, segment_bits):
        seg, tag = _segment(first, width), F.lit(number << 32)
        plain.append(F.struct(seg.bitwiseOR(tag).alias("slot"), F.lit(True).alias("whole")))
        cleared = _cleared(seg, width, number)
        variants.append(F.concat(F.array(plain[-1]), cleared))
    left = distinct.select(*cols, F.explode(F.array(*plain)).alias("s")).select(F.col("s.slot").alias("slot"), *(F.col(c).alias(f"l_{c}") for c in cols))
    right = distinct.select(*cols, F.explode(F.concat(*variants)).alias("s")).select(F.col("s.slot").alias("slot"), F.col("s.whole").alias("whole"), *(F.col(c).alias(f"r_{c}") for c in cols))
    apart = sum((F.bit_count(F.col(f"l_f{k}").bitwiseXOR(F.col(f"r_f{k}"))) for k in range(n_words)), F.lit(0))
    new = F.lit(True)
    for first, width, number in segments_of(n_words, segment_bits)[:-1]:  # a pair is made in the first of its segments only
        differ = _segment(first, width, "l_").bitwiseXOR(_segment(first, width, "r_"))
        new &= (left["slot"] < F.lit(number + 1 << 32)) | (F.bit_count(differ) > 1)
    found = left.hint("merge").join(right, (left["slot"] == right["slot"]) & (~F.col("whole") | (F.col("l_key") < F.col("r_key"))) & (apart <= radius) & new)
    return found.select(F.col("l_key").alias("a"), F.col("r_key").alias("b"))


def stars(distinct: DataFrame, radius: int, leaders: int = LEADERS) -> DataFrame:
    """Rows (a, b) within ``radius`` bits: every fingerprint of ``distinct`` (f0) with a few of those that one of its plain
    or one-wildcard segments reaches.

    Of the fingerprints that have a plain segment the ``leaders`` with the least hashes stand for all of them, so there are
    at most a few rows for each fingerprint however many share a segment. The distance is tested inside the join.
    """
    plain, variants = [], []
    for first, width, number in segments_of(1, 64 // max(2, radius // 2 + 1)):
        plain.append(_segment(first, width).bitwiseOR(F.lit(number << 32)))
        variants.append(F.concat(F.array(plain[-1]), F.transform(_cleared(_segment(first, width), width, number), lambda v: v["slot"])))
    chosen = distinct.select("f0", F.explode(F.array(*plain)).alias("slot")).groupBy("slot").agg(*(F.min_by("f0", F.xxhash64("f0", F.lit(i))).alias(f"m{i}") for i in range(leaders)))
    chosen = chosen.select("slot", F.array_distinct(F.array(*(f"m{i}" for i in range(leaders)))).alias("m"))
    probes = distinct.select("f0", F.explode(F.concat(*variants)).alias("slot"))
    near = F.filter("m", lambda x: (x != F.col("f0")) & (F.bit_count(x.bitwiseXOR(F.col("f0"))) <= radius))
    met = probes.join(chosen, "slot").select("f0", near.alias("near")).filter(F.size("near") > 0)
    return met.select(F.col("f0").alias("x"), F.explode("near").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def simhash_components(docs: DataFrame, shingle_words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of ``docs``.

    Fingerprints within ``radius`` bits are linked, and component_id is the smallest doc_id that links reach. Null and
    empty texts have fingerprint zero and are linked like any other. A null doc_id keeps its row and never is the
    smallest, unless a component has no other: then component_id is null. An empty table gives no rows.
    """
    with measured_broadcasts(docs.sparkSession):
        prints, classes = _classes(docs, shingle_words, radius, id_col, text_col)
    return prints.join(classes, "f0").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(docs: DataFrame, shingle_words: int, radius: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, f0) of every row of ``docs``, and rows (f0, component_id) of its fingerprints."""
    prints = materialize(fingerprints(docs, shingle_words, 1, id_col, text_col), "fingerprints")
    distinct = materialize(prints.groupBy("f0").agg(F.min("id").alias("least")), "distinct")
    pairs = links(distinct.select(F.col("f0").alias("key"), "f0"), 1, 64 // max(2, radius // 2 + 1), radius)
    roots = connected_components(pairs)
    joined = distinct.join(roots, F.col("f0") == F.col("node"), "left").select("f0", "least", F.coalesce("root", "f0").alias("root"))
    joined = materialize(joined, "roots")
    best = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, materialize(joined.join(best, "root").select("f0", "component_id"), "classes")


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted, as signed longs."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(words, size)], np.uint64).view(np.int64))


def frequent_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, and counts, of the most frequent shingles of one in SAMPLE of the rows (id, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text_words(t.as_py()), size))], names=["hash"])

    found = docs.filter(F.pmod("row", F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "hash long")
    most = found.groupBy("hash").count().filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "hash").limit(FREQUENT_MOST)
    rows = most.toArrow()  # FREQUENT_MOST at most; as columns they take a few MB of the driver
    hashes, counts = (rows.column(c).to_numpy() for c in ("hash", "count"))
    order = np.argsort(hashes)
    return hashes[order].astype(np.int64), counts[order].astype(np.int64)


def prefix_of(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first of ``hashes``, the rarest first: so many that sets of a Jaccard similarity of ``least`` share one.

    Any order will do that is the same for all texts; that of rising frequency keeps common passages out.
    """
    known, counts = frequent
    times = np.zeros(len(hashes), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        times = np.where(known[at] == hashes, counts[at], 0)
    n = len(hashes) - int(np.ceil(least * len(hashes) - 1e-9)) + 1
    return hashes[np.lexsort((hashes, times))][:n]


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """BITMAP_WORDS longs with the bits that the lowest bits of ``hashes`` name."""
    bits = np.zeros(64 * BITMAP_WORDS, np.uint8)
    bits[hashes & (64 * BITMAP_WORDS - 1)] = 1
    return np.packbits(bits).view(np.int64)


def _text_prints(docs: DataFrame, verify_words: int, n_words: int, least: float) -> DataFrame:
    """Rows (id, row, key, f0, ..., size, prefix, bits, whole) of the rows (id, row, text) that have words; key is a hash of
    all the words. The others are of the text's set of distinct shingles; a task gives a text's prefix, bits and whole
    once, then null. whole is null for texts of more than WHOLE shingles, else the lower 32 bits of each one's hash."""
    longs = T.ArrayType(T.LongType())
    made = [T.StructField(c, T.LongType()) for c in ("key", *(f"f{k}" for k in range(n_words)))]
    out = T.StructType([docs.schema["id"], docs.schema["row"], *made, T.StructField("size", T.IntegerType()), T.StructField("prefix", longs), T.StructField("bits", longs), T.StructField("whole", T.ArrayType(T.IntegerType()))])
    sent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, verify_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = sent.value, set()
        for batch in batches:
            rows, found, sizes, prefixes, bits, wholes = [], [], [], [], [], []
            for i, t in enumerate(batch.column(2)):
                if words := text_words(t.as_py()):
                    rows.append(i)
                    key = signed(xxhash.xxh64_intdigest(b" ".join(words)))
                    hashes = shingle_set(words, verify_words)
                    blocks = (hashes[i : i + HASHES_AT_ONCE].view(np.uint64) for i in range(0, len(hashes), HASHES_AT_ONCE))
                    found.append([key, *(signed(x) for x in print_of(blocks, n_words))])
                    again = key in seen
                    seen.add(key)
                    sizes.append(len(hashes))
                    prefixes.append(None if again else prefix_of(hashes, frequent, least))
                    bits.append(None if again else bitmap(hashes))
                    wholes.append(None if again or len(hashes) > WHOLE else hashes.astype(np.int32))
            at = pa.array(rows, pa.int64())
            arrays = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array([f[k] for f in found], pa.int64()) for k in range(n_words + 1))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sizes, pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in (prefixes, bits)), pa.array(wholes, pa.list_(pa.int32()))], names=out.names)

    return docs.mapInArrow(run, out)


def prefix_slots(prints: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (slot, key, pos) of the prefix shingles that several texts have, and rows (key, size, head, whole, b0, ...) of these texts."""
    told = prints.filter("prefix IS NOT NULL")
    each = told.select("key", F.posexplode("prefix").alias("pos", "slot"))
    shared = scratch.table(each.groupBy("slot").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low != high").select("slot"), "shared")
    met = scratch.table(each.join(broadcast_if_small(shared), "slot", "left_semi").dropDuplicates(["slot", "key"]), "met")
    sets = told.join(broadcast_if_small(scratch.table(met.select("key").distinct(), "involved")), "key", "left_semi")
    sets = sets.select("key", "size", F.slice("prefix", 1, HEAD).alias("head"), "whole", *(F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(BITMAP_WORDS))).dropDuplicates(["key"])
    sets = scratch.table(sets, "sets")
    scratch.drop("shared", "involved")
    return met, sets


def _large_enough(least: float) -> tuple[Column, Column]:
    """How many shingles the sets l and r of a pair must share, and whether their bitmaps allow for it: each bit that only
    one of them has is a shingle that is not shared."""
    need = (F.col("l_size") + F.col("r_size")) * (least / (1 + least)) - 1e-6
    fits = F.lit(True)
    for one, other in ("lr", "rl"):
        alone = sum((F.bit_count(F.col(f"{one}_b{i}").bitwiseAND(F.bitwise_not(F.col(f"{other}_b{i}")))) for i in range(BITMAP_WORDS)), F.lit(0))
        fits &= F.col(f"{one}_size") - alone >= need
    return need, fits


def _jaccard_of(x: str, y: str, least: float) -> Column:
    """Whether two sets of hashes have a Jaccard similarity of ``least`` or more."""
    shared = F.size(F.array_intersect(x, y))
    return shared >= least * (F.size(x) + F.size(y) - shared)


def _side(df: DataFrame, side: str, *same: str) -> DataFrame:
    return df.select(*same, *(F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in same))


def prefix_stars(met: DataFrame, sets: DataFrame, least: float, salt: int) -> DataFrame:
    """Rows (a, b), some of the candidates: every text with the one of each of its slots that has the least hash, so a
    linear number. The same few texts lead most slots of a group of near copies."""
    lead = met.groupBy("slot").agg(F.min_by("key", F.xxhash64("key", F.lit(salt))).alias("l_key"))
    pairs = met.join(lead, "slot").filter("l_key != key").select("l_key", F.col("key").alias("r_key")).distinct()
    for side in "lr":
        pairs = pairs.join(_side(sets.drop("head", "whole"), side), f"{side}_key")
    return pairs.filter(_large_enough(least)[1]).select(F.col("l_key").alias("a"), F.col("r_key").alias("b"))


def prefix_links(met: DataFrame, sets: DataFrame, split: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Rows (a, b), the candidates among the texts of ``split`` (key, part): every pair of different parts whose sets of
    shingles have a Jaccard similarity of ``least`` or more is among them. ``met`` and ``sets`` are those of prefix_slots.

    Such sets share a shingle of their prefixes. At the first that they share, none of either set before it is shared,
    so the rest of each must be large enough. Of texts that carry their whole sets only pairs of that similarity are made.
    """
    parted = scratch.table(met.join(split, "key"), "parted")
    several = parted.groupBy("slot").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low != high")
    parted = parted.join(broadcast_if_small(scratch.table(several.select("slot"), "several")), "slot", "left_semi")
    wide = scratch.table(parted.join(sets, "key"), "wide")
    need, fits = _large_enough(least)
    fits &= (F.col("l_key") < F.col("r_key")) & (F.col("l_part") != F.col("r_part")) & (F.least(F.col("l_size") - F.col("l_pos"), F.col("r_size") - F.col("r_pos")) >= need)
    # a pair is made at the first shingle that it shares, as far as the heads tell
    fits &= F.size(F.array_intersect(F.slice("l_head", F.lit(1), F.least("l_pos", F.lit(HEAD))), F.col("r_head"))) == 0
    fits &= F.col("l_whole").isNull() | F.col("r_whole").isNull() | _jaccard_of("l_whole", "r_whole", least)
    left, right = _side(wide, "l", "slot"), _side(wide, "r", "slot")
    return left.hint("merge").join(right, (left["slot"] == right["slot"]) & fits).select(F.col("l_key").alias("a"), F.col("r_key").alias("b"))


def _shingle_hashes(texts: DataFrame, size: int) -> DataFrame:
    """Rows (key, hashes) of the rows (key, text): the distinct hashes of a text's shingles, the lower 32 bits of each.

    32 bits halve what a pair moves. Of two texts of n shingles some 2 n^2 / 2^32 happen to share one more: under one
    for n up to 40,000, and never more than n / 2^32 of a text's shingles.
    """
    out = T.StructType([T.StructField("key", T.LongType()), T.StructField("hashes", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(text_words(t.as_py()), size).astype(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=out.names)

    return texts.mapInArrow(run, out)


def _shingle_sets(narrow: DataFrame, texts: DataFrame, pairs: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """Rows (key, hashes) of those of ``texts`` that ``pairs`` name; ``narrow`` has the rows (id, row, text)."""
    involved = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = scratch.table(texts.join(involved, "key", "left_semi").select("key", F.col("best.id").alias("w_id"), F.col("best.row").alias("w_row")), "wanted")
    found = narrow.join(broadcast_if_small(wanted), F.col("id").eqNullSafe(F.col("w_id")) & (F.col("row") == F.col("w_row")))
    return scratch.table(_shingle_hashes(found.select("key", "text"), size).dropDuplicates(["key"]), "shingles")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose shingle sets have a Jaccard similarity of ``least`` or more."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b")
    return both.filter(_jaccard_of("x", "y", least)).select("a", "b")


def deduplicate(
    docs: DataFrame,
    similarity: float = STAGE_SIMILARITY,
    verify_words: int = 5,
    radius: int = STAGE_RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest doc_id stays.

    Texts are linked if their sets of ``verify_words``-word shingles have a Jaccard similarity of ``similarity`` or more;
    every such pair is found. The 64-bit fingerprints of these sets are joined by one-wildcard segment variants within
    ``radius``, each with a few leaders of a segment; prefixes of the shingle sets then give the candidates among texts
    that are not together yet, so that no pair is lost and a large group's own pairs are never made. Every candidate's
    similarity is that of all its shingles, told apart by 32 bits of their hashes (see ``_shingle_hashes``). Texts with the same words (case of A-Z and white space apart) always are copies. Rows
    without words (null, empty or blank text) are no copies of each other and stay. Rows with a null doc_id stay only if
    no other row of their group has one; of rows that repeat both doc_id and text one stays. Of equal smallest ids with
    different texts the row with the smaller hash of its text stays. All columns are kept, whatever their names; an empty
    table gives no rows. A very long text costs memory in proportion to its distinct shingles.
    """
    with measured_broadcasts(docs.sparkSession):
        return _deduplicated(docs, similarity, verify_words, radius, id_col, text_col)


def _deduplicated(docs: DataFrame, similarity: float, verify_words: int, radius: int, id_col: str, text_col: str) -> DataFrame:
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession, clean=True)
    prints = scratch.table(_text_prints(narrow, verify_words, 1, similarity), "prints")
    rows = scratch.table(prints.groupBy("id", "row", "key", "f0").agg(F.count("*").alias("n")), "rows")
    texts = scratch.table(rows.groupBy("key", "f0").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")), "texts")
    # one row for each fingerprint, that of its first text; the others that happen to have it meet that one here
    leads = scratch.table(texts.groupBy("f0").agg(F.min("key").alias("key")), "leads")
    same = texts.select("key", "f0").join(leads.withColumnRenamed("key", "lead"), "f0").filter("key != lead").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    near = stars(leads.select("f0"), radius)
    for side in "ab":
        near = near.join(leads.select(F.col("f0").alias(side), F.col("key").alias(f"key_{side}")), side)
    near = near.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).union(same)
    # first a linear number of candidates, which put the close copies of a large group together ...
    met, carried = prefix_slots(prints, scratch)
    scratch.drop("prints")
    for salt in range(STARS):
        near = near.union(prefix_stars(met, carried, similarity, salt))
    nearest = scratch.table(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "nearest")
    sets = _shingle_sets(narrow, texts, nearest, verify_words, scratch)
    linked = scratch.table(_similar(nearest, sets, similarity), "linked")
    parts = connected_components(linked)
    # ... then all texts that may be similar and are not together yet, so a large group's own pairs are never made
    split = scratch.table(texts.join(parts, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("part")), "parts")
    others = scratch.table(prefix_links(met, carried, split, similarity, scratch).distinct(), "others")
    scratch.drop("met", "parted", "several", "wide", "sets", "nearest", "wanted", "leads", "linked")
    sets = sets.union(_shingle_sets(narrow, texts.join(sets, "key", "left_anti"), others, verify_words, scratch))
    ends = [split.select(F.col("key").alias(c), F.col("part").alias(f"part_{c}")) for c in "ab"]
    between = _similar(others, sets, similarity).join(ends[0], "a").join(ends[1], "b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))
    roots = connected_components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")).union(between))
    grouped = texts.join(roots, F.col("key") == F.col("node"), "left").select("key", "best", F.coalesce("root", "key").alias("root"))
    keep = scratch.table(grouped.groupBy("root").agg(F.min(F.struct("best", "key")).alias("first")).select("first.key", "first.best.id", "first.best.row"), "keep")
    # a row is told by doc_id and a hash of its text: those that go, and those that stay but are there more than once
    marked = rows.join(keep.select("key", F.col("id").alias("k_id"), F.col("row").alias("k_row")), "key", "left")
    marked = marked.select("id", "row", (F.col("k_row").isNotNull() & F.col("id").eqNullSafe(F.col("k_id")) & (F.col("row") == F.col("k_row"))).alias("stays"), "n")
    out = scratch.table(marked.filter("NOT stays OR n > 1"), "out")
    scratch.drop("rows", "texts", "parts", "others", "wanted", "shingles", "keep")
    row, rid = scratch_name(docs, "row"), scratch_name(docs, "rid")
    tagged = docs.withColumn(row, F.xxhash64(text_col))

    def matched(side: DataFrame, how: str) -> DataFrame:
        small = broadcast_if_small(side.select(F.col("id").alias(rid), F.col("row").alias(row + "_")))
        return tagged.join(small, F.col(id_col).eqNullSafe(F.col(rid)) & (F.col(row) == F.col(row + "_")), how)

    kept = matched(out, "left_anti").select(*docs.columns)
    again = out.filter("stays")
    return kept.unionByName(matched(again, "left_semi").dropDuplicates([id_col, row]).select(*docs.columns)) if again.limit(1).count() else kept


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))
