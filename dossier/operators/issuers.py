"""Issuers of documents against a company's registry, and the stamps on them against their issuers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import fuzzy
from dossier.storage import broadcast_if_small, materialize

MATCH, STAMP_MATCH = 85.0, 80.0
#: Registry names of a company that are scored at a time.
NAMES_AT_ONCE = 256

# Words of organisations after which a misread trademark sign is taken off.
ORGANISATION_WORDS = "ACADEMY SCHOOL SCHOOLS NURSERY COLLEGE UNIVERSITY INSTITUTE CENTER CENTRE COMPANY LLC INC LTD LIMITED GROUP TRADING HOSPITAL CLINIC EST CORP CORPORATION SERVICES SOLUTIONS INTERNATIONAL BANK"
# Arabic letters and their presentation forms.
ARABIC = "؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿"
# Words of places, addresses and legal forms, short forms of names, and words of any organisation.
NOISE_WORDS = "po p o box pob tel fax br branch llc l c fze fzc fz co est ltd inc uae u a e abu dhabi dubai sharjah ajman fujairah ras khaimah umm quwain ain al the of and ص ب ص.ب هاتف فاكس ذ.م.م ش.ذ.م.م أبوظبي ابوظبي دبي الشارقة عجمان العين"
GENERIC_WORDS = "school schools campus llc branch pvt private"
ABBREVIATIONS = {"mbz": "mohamed bin zayed", "mbr": "mohammed bin rashid", "intl": "international", "int'l": "international", "sch": "school", "acad": "academy", "univ": "university", "pvt": "private", "est": "establishment"}
# The kind of registry entry that can issue a type of document, and the country of a currency.
KIND_OF_TYPE = {"school_document": "school", "vendor_invoice": "vendor", "commercial_invoice": "vendor", "procurement_documentation": "vendor", "travel_invoice": "vendor"}
COUNTRY_OF_CURRENCY = {"AED": "AE", "SAR": "SA", "QAR": "QA", "KWD": "KW", "BHD": "BH", "OMR": "OM", "EGP": "EG", "JOD": "JO", "INR": "IN", "PKR": "PK", "GBP": "GB"}


def issuer_variants(name: Column) -> Column:
    """The name as printed, without trademark signs and their misreadings, and its Arabic and Latin parts where it has both."""
    tidy = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    signs = F.regexp_replace(name, r"(?i)[®™©℗]|\((?:R|TM|C)\)", " ")
    misread = f"(?<!\\S)(?i)({'|'.join(sorted(ORGANISATION_WORDS.split(), key=len, reverse=True))})[O0][.,;:]*(?!\\S)"
    clean = tidy(F.regexp_replace(signs, misread, "$1"))
    run = f"[{ARABIC}][{ARABIC}\\s-]*"
    arabic = F.array_join(F.transform(F.regexp_extract_all(clean, F.lit(f"({run})"), F.lit(1)), lambda x: F.trim(x)), " ")
    latin = tidy(F.regexp_replace(clean, run, " "))
    parts = F.when((arabic != "") & latin.rlike("[A-Za-z]{3}"), F.array(arabic, latin)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(F.array(F.trim(name), clean), parts), lambda x: x != ""))


def issuer_candidates(registry: DataFrame, company: str = "company_id") -> DataFrame:
    """Rows (company, candidate) of the active rows (company, name, name_arabic, is_active): each distinct name of either script."""
    names = registry.filter("is_active").select(company, F.explode(F.array("name", "name_arabic")).alias("candidate"))
    return names.filter("candidate IS NOT NULL AND candidate <> ''").distinct()


def best_matches(named: DataFrame, candidates: DataFrame, company: str = "company_id", names_at_once: int = NAMES_AT_ONCE) -> DataFrame:
    """Rows (company, issuer, best_name, score) of the distinct (company, issuer) of ``named``: the candidate of the company with
    the best weighted score of any variant; of equals the smallest. Without candidates both are null.

    A company's names are dealt into blocks, so a row meets a block, not a name: no pairs are made. Inside a batch lengths,
    letters and words bound a score, and only names that can still be the best are aligned. A company with very many
    issuers is split by Spark's skew handling, as the blocks are one row each.
    """
    issuers = materialize(named.select(company, F.col("issuer")).filter("issuer IS NOT NULL AND trim(issuer) <> ''").distinct().withColumn("variants", issuer_variants(F.col("issuer"))), "issuers")
    sizes = candidates.groupBy(company).agg(F.ceil(F.count("*") / names_at_once).alias("blocks"))
    blocks = candidates.join(sizes, company).withColumn("block", F.pmod(F.xxhash64("candidate"), F.col("blocks")))
    blocks = materialize(blocks.groupBy(company, "block").agg(F.sort_array(F.collect_list("candidate")).alias("names")), "registry")  # some names_at_once each
    met = issuers.join(broadcast_if_small(blocks), company).select(company, "issuer", "variants", "names")
    kind = met.schema[company].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best_names, scores = [], []
            for variants, names in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found = best_of([fuzzy.processed(v) for v in variants], names)
                best_names.append(found[1])
                scores.append(found[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best_names, pa.string()), pa.array(scores, pa.float64())], names=[company, "issuer", "best_name", "score"])

    scored = met.mapInArrow(run, f"{company} {kind}, issuer string, best_name string, score double")
    best = scored.groupBy(company, "issuer").agg(F.min_by(F.struct("best_name", "score"), F.struct(-F.col("score"), F.col("best_name"))).alias("b"))
    return issuers.select(company, "issuer").join(best, [company, "issuer"], "left").select(company, "issuer", "b.best_name", "b.score")


def best_of(variants: list[str], names: list[str]) -> tuple[float, str | None]:
    """The best score of any of ``variants`` (processed) with one of ``names``, and that name; of equals the smallest."""
    best: tuple[float, str | None] = (-1.0, None)
    letters = [Counter(v) for v in variants]
    for name in sorted(names):
        plain = fuzzy.processed(name)
        own = Counter(plain)
        for variant, theirs in zip(variants, letters, strict=True):
            if fuzzy.most_weighted(variant, plain, theirs, own) > best[0] + 1e-9 and (score := fuzzy.weighted_ratio(variant, plain)) > best[0] + 1e-9:
                best = (score, name)
    return best


def _one_of(column: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def document_country(iban: Column, currency: Column) -> Column:
    """That of a printed bank account number, or else of the currency."""
    account = F.upper(F.regexp_replace(iban, r"\s", ""))
    return F.coalesce(F.when(account.rlike("^[A-Z]{2}[0-9]{2}"), F.substring(account, 1, 2)), _one_of(F.upper(currency), COUNTRY_OF_CURRENCY))


def issuer_verification(documents: DataFrame, registry: DataFrame, least: float = MATCH, company: str = "company_id") -> DataFrame:
    """Rows (document_id, result, matched_name, score) of the rows (company, document_id, issuer, document_type, country).

    pass: the best score with an active name of the company's registry (company, name, name_arabic, kind, country, is_active)
    reaches ``least``. Otherwise flag if the registry has an active entry that could be the issuer: of the kind of the
    document's type or "other", of its country or none; any type or country does where the document has none. Else not_checked.
    Documents without an issuer match nothing.
    """
    wanted = _one_of(F.col("document_type"), KIND_OF_TYPE)
    typed = documents.withColumn("wanted", wanted)
    best = best_matches(typed, issuer_candidates(registry, company), company)
    kinds = registry.filter("is_active").groupBy(company).agg(F.collect_set(F.struct(F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce(F.upper("country"), F.lit("")).alias("country"))).alias("entries"))  # kinds and countries, not rows
    some = typed.join(broadcast_if_small(materialize(kinds, "kinds")), company, "left")
    fits = F.exists("entries", lambda e: (F.col("wanted").isNull() | e["kind"].isin("other") | (e["kind"] == F.col("wanted"))) & (F.col("country").isNull() | (e["country"] == "") | (e["country"] == F.col("country"))))
    matched = some.join(best, [company, "issuer"], "left")
    score = F.round("score", 2)
    result = F.when(F.col("score") >= least, "pass").when(F.coalesce(fits, F.lit(False)), "flag").otherwise("not_checked")
    return matched.select("document_id", result.alias("result"), F.col("best_name").alias("matched_name"), score.alias("score"))


def name_words(text: Column, script: str) -> Column:
    """Words of an organisation's name in ``script`` (arabic or latin), joined: short forms written out, words of places,
    addresses, legal forms and kinds of organisations left out."""
    words = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{M}]+(?:\.[\p{L}\p{M}]+)*)"), F.lit(1))
    parts = F.flatten(F.transform(words, lambda w: F.split(F.coalesce(_one_of(F.lower(w), ABBREVIATIONS), F.lower(w)), " ")))
    dropped = {*NOISE_WORDS.split(), *GENERIC_WORDS.split()}
    arabic = lambda p: p.rlike(f"[{ARABIC[:3]}]")
    kept = F.filter(parts, lambda p: ~p.isin(*sorted(dropped)) & (F.char_length(p) > 1) & (arabic(p) if script == "arabic" else ~arabic(p)))
    return F.nullif(F.array_join(kept, " "), F.lit(""))


def stamp_issuer(stamps: DataFrame, documents: DataFrame, least: float = STAMP_MATCH) -> DataFrame:
    """Rows (document_id, status, stamp, score), one for each row of ``documents`` (document_id, issuer).

    pass if a stamp (document_id, text) names the issuer: the best token-set score in a script that both have reaches
    ``least``; else flag, with the best stamp (of equals the largest text). skipped without stamp text, issuer or a script in common.
    """
    read = stamps.filter("trim(text) <> ''").select("document_id", "text").distinct()
    met = read.join(documents.filter("issuer <> ''").select("document_id", "issuer"), "document_id")
    # a text is worked over once however many documents have it
    pairs = materialize(met.select("text", "issuer").distinct(), "stamps")
    scored = pairs.select("text", "issuer", F.greatest(*(_words_score(F.col("text"), F.col("issuer"), s) for s in ("latin", "arabic"))).alias("score")).filter("score IS NOT NULL")
    best = met.join(scored, ["text", "issuer"]).groupBy("document_id").agg(F.max(F.struct("score", "text")).alias("b"))
    status = F.when(F.col("b").isNull(), "skipped").when(F.col("b.score") >= least, "pass").otherwise("flag")
    return documents.select("document_id").join(best, "document_id", "left").select("document_id", status.alias("status"), F.col("b.text").alias("stamp"), F.round("b.score", 1).alias("score"))


def _words_score(a: Column, b: Column, script: str) -> Column:
    return fuzzy.score_column("token_set", name_words(a, script), name_words(b, script))
