"""Personal data by anchor expansion.

An Aho-Corasick automaton walks each whole text once and stops at anchors only: at-signs, digits, plus signs, URL
schemes and identifier cues. At each anchor a small deterministic parser expands to the left or right, finds the
boundaries and validates. Parsers keep the end of their last match, so matches of a kind never overlap, and skip a run
that failed once, so a text costs time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.storage import read_table

#: Order of kinds in the base digest; the kinds after them are what the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("credentials", "iban", "ssn")
KINDS = BASE_KINDS + ADDED_KINDS

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CREDENTIALS = re.compile(r"[^\s/:@?#]+:([^\s/@?#]+)@")
IBAN = re.compile(r"[:# ]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)(?![A-Za-z0-9])")
SSN = re.compile(r"[:# ]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")

SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "redis://", "amqp://")
CUES = {"IBAN": "iban", "iban": "iban", "SSN": "ssn", "ssn": "ssn"}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    for s in SCHEMES:
        a.add_word(s, ("credentials", len(s)))
    for c, kind in CUES.items():
        a.add_word(c, (kind, len(c)))
    a.make_automaton()
    return a


_AUTOMATON: list[ahocorasick.Automaton] = []


def find_spans(text: str) -> list[Span]:
    """All (kind, start, end) of a text in code points, by start, then kind as listed."""
    if not _AUTOMATON:
        _AUTOMATON.append(_automaton())
    spans: list[Span] = []
    done = dict.fromkeys(KINDS, 0)

    def add(kind: str, start: int, end: int) -> None:
        spans.append((kind, start, end))

    for last, (what, length) in _AUTOMATON[0].iter(text):
        if what == "digit":
            if last >= done["ip"]:
                if m := ADDRESS.match(text, last):
                    done["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                        add("ip", last, m.end())
                else:
                    done["ip"] = DIGITS.match(text, last).end()
            if last >= done["card"]:
                if m := CARD.match(text, last):
                    done["card"] = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        add("card", last, m.end())
                else:
                    done["card"] = last + 1
        elif what == "email":
            start = last
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := DOMAIN.match(text, last + 1)):
                add("email", start, m.end())
                done["email"] = m.end()
            else:
                done["email"] = max(done["email"], last + 1)
        elif what == "phone":
            if last >= done["phone"] and (m := PHONE.match(text, last)):
                done["phone"] = m.end()
                if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                    add("phone", last, m.end())
        elif what == "credentials":
            if last >= done["credentials"] and (m := CREDENTIALS.match(text, last + 1)):
                done["credentials"] = m.end()
                add("credentials", last + 1, m.end() - 1)
        elif last >= done[what]:
            m = (IBAN if what == "iban" else SSN).match(text, last + 1)
            before = text[last - length : last - length + 1] if last >= length else ""
            if m and not before.isalnum() and (what == "ssn" or iban_valid(m.group(1))):
                done[what] = m.end()
                add(what, m.start(1), m.end(1))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, spans array of (kind, start, end)) of every row of ``docs``, repeated rows included.

    Spans are in code points, end exclusive, by start and then kind. Null and empty texts have none. Other columns are
    not read; an empty table gives no rows.
    """
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("spans", T.ArrayType(SPAN))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=out.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text): every span of a text replaced by its kind in angle brackets; overlapping spans as one."""
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def one(text: str | None) -> str | None:
        if not text:
            return text
        parts, at = [], 0
        for kind, a, b in find_spans(text):
            if a >= at:
                parts += [text[at:a], f"<{kind}>"]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(t.as_py()) for t in batch.column(1)], pa.string())], names=out.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def digest(found: DataFrame) -> DataFrame:
    """The columns that the query op10 returns, from the rows of ``scan``."""

    def text_of(spans):  # noqa: ANN001, ANN202
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    base = text_of(F.concat(*(F.filter("spans", _is(k)) for k in BASE_KINDS)))
    listed = text_of(F.concat(*(F.filter("spans", _is(k)) for k in KINDS)))
    return found.select("doc_id", *count, F.sha2(base, 256).alias("base_sha256"), listed.alias("spans"))


def _is(kind: str):  # noqa: ANN202
    return lambda s: s["kind"] == kind


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(read_table(spark, sf_dir, "documents")))
