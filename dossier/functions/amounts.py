"""Amounts written in English words, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words.
UNITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
SCALES = {"thousand": 1_000, "lakh": 100_000, "million": 1_000_000, "crore": 10_000_000, "billion": 1_000_000_000}
SILENT = ("and", "only", "aed", "usd", "eur", "inr", "dirhams", "dirham", "dollars", "dollar", "euros", "rupees")


def _map(items: dict[str, int]) -> Column:
    return F.create_map(*(x for k, v in items.items() for x in (F.lit(k), F.lit(v).cast("long"))))


def amount_in_words(text: Column) -> Column:
    """The whole number that words name, null for any other word, a digit, or no word at all.

    Words below a hundred add up, "hundred" multiplies what came since the last scale, a scale closes it.
    """
    small = _map({w: i for i, w in enumerate(UNITS)} | {w: 10 * (i + 2) for i, w in enumerate(TENS)})
    scales = _map(SCALES)
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1)), lambda w: ~w.isin(*SILENT))

    def step(acc: Column, w: Column) -> Column:
        n, s = F.element_at(small, w), F.element_at(scales, w)
        total = F.when(s.isNotNull(), acc["total"] + F.greatest(acc["part"], F.lit(1).cast("long")) * s).otherwise(acc["total"])
        part = F.when(s.isNotNull(), F.lit(0).cast("long")).when(w == "hundred", F.greatest(acc["part"], F.lit(1).cast("long")) * 100).otherwise(acc["part"] + F.coalesce(n, F.lit(0).cast("long")))
        known = acc["known"] & (n.isNotNull() | s.isNotNull() | (w == "hundred"))
        return F.struct(total.alias("total"), part.alias("part"), known.alias("known"))

    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("part"), F.lit(True).alias("known"))
    return F.when(F.size(words) > 0, F.aggregate(words, zero, step, lambda a: F.when(a["known"], a["total"] + a["part"])))


def words_of_amount(n: Column) -> Column:
    """English words of a whole number from 0 to 999,999,999."""
    units, tens = F.array(*map(F.lit, UNITS)), F.array(*map(F.lit, TENS))

    def below_thousand(x: Column) -> Column:
        rest, hundreds = x % 100, F.floor(x / 100)
        low = F.when(rest == 0, F.lit(None).cast("string")).when(rest < 20, F.get(units, rest.cast("int"))).otherwise(F.concat_ws(" ", F.get(tens, (F.floor(rest / 10) - 2).cast("int")), F.when(rest % 10 > 0, F.get(units, (rest % 10).cast("int")))))
        return F.concat_ws(" ", F.when(hundreds > 0, F.concat(F.get(units, hundreds.cast("int")), F.lit(" hundred"))), low)

    parts = [(F.floor(n / 1_000_000), " million"), (F.floor(n / 1000) % 1000, " thousand"), (n % 1000, "")]
    return F.when(n == 0, "zero").otherwise(F.concat_ws(" ", *(F.when(x > 0, F.concat(below_thousand(x), F.lit(name))) for x, name in parts)))
