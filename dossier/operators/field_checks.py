"""Further checks of printed fields: tax at its rate, column totals, tax numbers of tax invoices, dates against the file's."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.text import decode_digits
from dossier.operators.validation import SLACK, rounding_allowance, status

#: Lines beyond which no set of taxed lines is looked for.
MOST_TAXED_LINES = 20
#: Clocks that were never set write dates up to this one; a file's date may be off by so many days.
UNSET_CLOCK, DAYS_OFF = "2000-01-01", 1
#: The title of a tax invoice, and a tax number as printed with its label or alone.
TAX_INVOICE = r"(?i)\btax\s+invoice\b|فاتورة\s+ضريبية"
LABELLED_TRN = (
    r"(?i)(?:\bTRN\b|T\.R\.N|tax\s+registration(?:\s+(?:no|number))?|\bVAT\s+(?:no|number|reg(?:istration)?)\b"
    r"|الرقم\s+الضريبي|رقم\s+التسجيل\s+الضريبي)[^0-9\n]{0,30}([0-9][0-9\s-]{8,22}[0-9])"
)
LONE_TRN = "(?<![0-9])100[0-9]{12}(?![0-9])"


@F.pandas_udf(T.BooleanType())
def _some_lines_taxed(totals: pd.Series, rate: pd.Series, tax: pd.Series) -> pd.Series:
    """Is there a set of lines of which the rate gives the tax, to a cent a line? At most 2^20 sums for a document."""

    def one(values: np.ndarray, percent: float, wanted: float) -> bool:
        if values is None or percent is None or wanted is None or percent <= 0 or not 0 < len(values) <= MOST_TAXED_LINES:
            return False
        sums, sizes = np.zeros(1), np.zeros(1, np.int8)
        for v in values:
            sums, sizes = np.concatenate([sums, sums + v]), np.concatenate([sizes, sizes + 1])
        off = np.abs(sums * percent / 100 - wanted)
        return bool(np.any((sizes > 0) & (off <= 0.01 * sizes + SLACK)))

    return pd.Series([one(*x) for x in zip(totals, rate, tax, strict=True)])


def chk_tax_rate_consistency(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows (document_id, expected, status): is the tax that rate of its base, or of some of the lines?

    ``documents`` (document_id, tax_rate in per cent, tax, subtotal, total_amount); the base is the subtotal, else the
    total less the tax. A rate with a tax of nothing on a positive base is flagged. Only documents that fail so far meet
    their lines (document_id, total), and one of more than ``MOST_TAXED_LINES`` is flagged without a search. Skipped
    without rate, tax or base.
    """
    base = F.coalesce(F.col("subtotal"), F.col("total_amount") - F.col("tax"))
    expected = base * F.col("tax_rate") / 100
    known = expected.isNotNull() & F.col("tax").isNotNull()
    fits = F.abs(expected - F.col("tax")) <= 0.02 + SLACK
    nothing = (F.col("tax_rate") > 0) & (F.abs("tax") < 0.005) & (base > 0)
    first = F.when(~known, "skipped").when(fits, "pass").when(nothing, "flag")
    judged = documents.select("document_id", "tax_rate", "tax", F.round(expected, 4).alias("expected"), first.alias("status"))
    open_ones = judged.filter("status IS NULL").select("document_id", "tax_rate", "tax")
    # a line beyond the bound decides that no set is looked for, so no document needs more of its lines than that
    numbered = lines.filter("total IS NOT NULL").join(open_ones.select("document_id"), "document_id", "left_semi")
    counts = numbered.groupBy("document_id").agg(F.count("*").alias("n")).filter(F.col("n") <= MOST_TAXED_LINES)
    held = numbered.join(counts, "document_id").groupBy("document_id").agg(F.sort_array(F.collect_list("total")).alias("totals"))
    searched = open_ones.join(held, "document_id").select("document_id", _some_lines_taxed("totals", "tax_rate", "tax").alias("some"))
    joined = judged.join(searched, "document_id", "left")
    return joined.select("document_id", "expected", F.coalesce("status", F.when(F.col("some"), "pass").otherwise("flag")).alias("status"))


def chk_column_sums(columns: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows (document_id, role, column_sum, status): each amount column against the printed total of the same column.

    ``columns`` (document_id, role, amount) and ``totals`` (document_id, role, total); a column without a total is skipped.
    """
    sums = columns.groupBy("document_id", "role").agg(F.sum(F.col("amount").cast("decimal(18,4)")).cast("double").alias("column_sum"), F.count("amount").alias("n"))
    off = F.abs(F.col("column_sum") - F.col("total"))
    return sums.join(totals, ["document_id", "role"], "left").select("document_id", "role", "column_sum", status(off > rounding_allowance(F.col("n")), off.isNotNull()).alias("status"))


def chk_tax_invoice_trn(documents: DataFrame) -> DataFrame:
    """Rows (document_id, status): a text titled tax invoice needs a labelled number of 10 to 17 digits, or one of 15
    that begins with 100. Texts without the title, and nulls, are skipped."""
    text = decode_digits(F.col("text"))
    numbers = F.regexp_extract_all(text, F.lit(LABELLED_TRN), F.lit(1))
    labelled = F.exists(numbers, lambda n: F.length(F.regexp_replace(n, "[^0-9]", "")).between(10, 17))
    alone = F.regexp_replace(text, r"[\s-]", "").rlike(LONE_TRN)
    return documents.select("document_id", status(~(labelled | alone), F.coalesce(F.col("text").rlike(TAX_INVOICE), F.lit(False))).alias("status"))


def chk_date_vs_file_creation(documents: DataFrame) -> DataFrame:
    """Rows (document_id, days_before, status) of documents (document_id, printed, created, modified; dates).

    A file made over a day before its printed date and changed on or after that date (or the day before) is flagged;
    skipped without a printed date or a creation date, and for clocks that were never set.
    """
    gap = F.datediff("printed", "created")
    known = F.col("printed").isNotNull() & (F.col("created") > F.lit(UNSET_CLOCK).cast("date"))
    late = F.coalesce(F.date_add("modified", DAYS_OFF) >= F.col("printed"), F.lit(False))
    return documents.select("document_id", gap.alias("days_before"), status((gap > DAYS_OFF) & late, F.coalesce(known, F.lit(False))).alias("status"))
