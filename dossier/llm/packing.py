"""Best-two-fit packing of tokenized documents into fixed-length training sequences.

Two Spark steps. ``tokenize_pieces`` turns every document into pieces of at most ``max_tokens`` tokens inside Arrow
batches, so only ids and lengths leave the task. ``pack_pieces`` deals the pieces that are shorter than a sequence
into shards of a fixed number of pieces and packs each shard by best-two-fit. A shard holds ids and lengths, never
texts, and at most one of its sequences is left badly filled, so sharding costs under one sequence in some thousands.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.storage import materialize, read_table

MAX_TOKENS = 1024
END_OF_DOCUMENT = 2
#: Pieces a shard holds on average; a shard of lengths takes a few MB.
PIECES_PER_SHARD = 16_384
#: Characters of a text that are tokenized at a time; bounds a task's memory for very long texts.
CHARS_AT_ONCE = 200_000

#: The byte-level pre-tokenizer never joins a non-space character to a single space or line end that follows, so the
#: tokens before and after such a place are the same alone as within the text.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Any character outside blocks of Latin, Greek, Cyrillic, Kana, Han, Hangul and common punctuation, in which every
#: library draws the same line between letters, numbers, white space and the rest.
_UNUSUAL = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\xac\\xae-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u2010-\u2027\u2030-\u205e\u20ac\u3001-\u3003\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e]")
SPECIAL = "<|endoftext|>"

_encoders: dict[tuple[str, str | None], Encoder] = {}


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    ``tokenizer_path`` defines the ids. ``ranks_path``, if given, is a rank file of the same vocabulary: texts of usual
    characters take it, as it is read by a faster library; all others, and texts with a special token's name, don't.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None) -> None:
        self.tokenizer_path = tokenizer_path
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def exact(self):
        """Read when first asked for: a worker that meets usual texts alone never holds these tables."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.tokenizer_path)

    def part(self, text: str) -> bytes:
        if self.fast is None or _UNUSUAL.search(text) or SPECIAL in text:
            return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def encode(self, text: str) -> bytes:
        if len(text) <= CHARS_AT_ONCE:
            return self.part(text)
        parts, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + CHARS_AT_ONCE) if at + CHARS_AT_ONCE < len(text) else None
            end = cut.start() if cut else len(text)
            parts.append(self.part(text[at:end]))
            at = end
        return b"".join(parts)


def _encoder(tokenizer_path: str, ranks_path: str | None) -> Encoder:
    """One for each worker process; its tables take some tens of MB."""
    key = (tokenizer_path, ranks_path)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def cut_lengths(n: int, max_tokens: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens: full pieces, of which the first may be shorter."""
    first = n % max_tokens
    return ([first] if first else []) + [max_tokens] * (n // max_tokens)


def tokenize_pieces(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    ranks_path: str | None = None,
    max_tokens: int = MAX_TOKENS,
    end_id: int = END_OF_DOCUMENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]) of every document.

    Ids are those of the file ``tokenizer_path``; see ``Encoder``. Null and empty texts have the end token alone; a repeated row is a document of its own; other columns are ignored.
    """
    paths = (tokenizer_path, ranks_path) if tokenizer_path else (default_tokenizer_path(), default_ranks_path())
    id_type = docs.schema[id_col].dataType
    fields = [
        T.StructField("doc_id", id_type),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ] + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else [])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(*paths), np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            at = 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size < 1_000_000):  # very long texts go alone
                    size += sizes[upto]
                    upto += 1
                rows, n, start, length, crc, kept = [], [], [], [], [], []
                for i, text in enumerate(texts.slice(at, upto - at).to_pylist()):
                    raw = encoder.encode(text or "") + end
                    done = 0
                    for k, take in enumerate(cut_lengths(len(raw) // 4, max_tokens)):
                        part = raw[4 * done : 4 * (done + take)]
                        rows.append(at + i)
                        n.append(k)
                        start.append(done)
                        length.append(take)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            kept.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                        done += take
                arrays = [ids.take(pa.array(rows)), pa.array(n, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                if keep_ids:
                    arrays.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])
                at = upto

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, T.StructType(fields))


def best_two_fit(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length.

    A sequence is filled greedily, each time with the longest piece that fits. Then, while a gap is left, its smallest
    piece is put back and two unpacked pieces take its place if together they fill the expanded gap more tightly.
    Equal lengths are interchangeable, so the unpacked pieces are stacks by length and one bit for each length.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        stacks[lengths[i]].append(i)
    there = mirror = 0  # bit n: a piece of length n is unpacked; mirror has it at capacity - n
    for n in range(1, capacity + 1):
        if stacks[n]:
            there |= 1 << n
            mirror |= 1 << (capacity - n)

    def take(n: int) -> int:
        nonlocal there, mirror
        i = stacks[n].pop()
        if not stacks[n]:
            there &= ~(1 << n)
            mirror &= ~(1 << (capacity - n))
        return i

    def put(n: int, i: int) -> None:
        nonlocal there, mirror
        stacks[n].append(i)
        there |= 1 << n
        mirror |= 1 << (capacity - n)

    def pair(most: int, over: int) -> tuple[int, int] | None:
        for total in range(most, over, -1):
            both = there & (mirror >> (capacity - total))  # n and total - n are both there
            while both:
                a = (both & -both).bit_length() - 1
                if 2 * a > total:
                    break
                if 2 * a != total or len(stacks[a]) > 1:
                    return a, total - a
                both &= both - 1
        return None

    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    while there:
        gap, inside = capacity, []
        while fits := there & ((2 << gap) - 1):
            n = fits.bit_length() - 1
            inside.append((n, take(n)))
            gap -= n
        if gap and there:
            smallest = min(inside)
            if two := pair(gap + smallest[0], smallest[0]):
                inside.remove(smallest)
                inside += [(n, take(n)) for n in two]
                put(*smallest)
        at = 0
        for n, i in inside:
            sequence[i], offset[i] = number, at
            at += n
        number += 1
    return sequence, offset


def pack_pieces(pieces: DataFrame, max_tokens: int = MAX_TOKENS, pieces_per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """Add sequence_id and offset to every piece; a full piece is a sequence of its own and is not shuffled.

    ``pieces`` must be a stored table (see ``materialize``): it is read twice, and a piece's shard comes from its place
    in the table, so that no repeated key can fill one shard. The number of shards follows the number of pieces.
    """
    short = pieces.filter(F.col("length") < max_tokens)
    shards = max(1, -(-short.count() // pieces_per_shard))
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(table: pa.Table) -> pa.Table:
        sequence, offset = best_two_fit(table.column("length").to_pylist(), max_tokens)
        shard = table.column("__shard")[0].as_py()
        return table.drop_columns(["__shard"]).append_column("sequence_id", pa.array(sequence + (shard << 36))).append_column("offset", pa.array(offset))

    packed = short.withColumn("__shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))).groupBy("__shard").applyInArrow(pack, out)
    full = pieces.filter(F.col("length") == max_tokens).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, ranks_path: str | None = None, max_tokens: int = MAX_TOKENS, **columns) -> DataFrame:
    """Tokenize and pack: one row for each piece with its sequence and offset; an empty table gives no rows."""
    pieces = materialize(tokenize_pieces(docs, tokenizer_path, ranks_path, max_tokens, **columns), "pieces")
    return pack_pieces(pieces, max_tokens)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
