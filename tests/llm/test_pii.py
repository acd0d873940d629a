from __future__ import annotations

import hashlib
import random
import re

from dossier.llm import pii


def brute(text):
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_parsers_against_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        alphabet = rng.choice(["ab@.-1+", "12. +-()9@.", "0123456789 -", "@a.", "+1 ()-", "é1.@a "])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 45)))
        assert sorted(s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS) == sorted(brute(text)), text


def test_added_kinds():
    text = "IBAN: GB82 WEST 1234 5698 7654 32, ssn 123-45-6789 http://me:pw1@h.com/x IBAN: GB83 WEST 1234 5698 7654 32"
    assert [s[0] for s in pii.find_spans(text)] == ["iban", "ssn", "credentials", "email"]


def test_long_digit_runs_are_linear():
    assert pii.find_spans("1" * 200_000 + "." * 10 + "1." * 50_000 + "@" * 1000 + "a" * 100_000) is not None


def test_scan_digest_and_edges(spark, edge_docs, clashing, empty_docs):
    rows = [(1, "é me@x.org and 10.0.0.1, 4111 1111 1111 1111 or +1 (555) 010-9999"), (2, None), (3, ""), (3, "")]
    out = pii.digest(pii.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    want = brute(rows[0][1])
    assert (out[0]["n_email"], out[0]["n_ip"], out[0]["n_card"], out[0]["n_phone"]) == (1, 1, 1, 1)
    assert out[0]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    assert out[1]["spans"] == "" and len(out) == 4
    assert pii.scan(edge_docs).count() == 12 and pii.scan(clashing).count() == 12 and pii.scan(empty_docs).count() == 0
    red = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows[:3], "doc_id long, text string")).collect()}
    assert red == {1: "é <email> and <ip>, <card> or <phone>", 2: None, 3: ""}
