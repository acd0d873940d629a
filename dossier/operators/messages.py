"""Values, reasons and findings as a person would read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.storage import broadcast_if_small, materialize

# Printed forms of a date, those tried first in front.
DATE_FORMS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "MMMM dd, yyyy", "dd MMMM yyyy", "MMM dd, yyyy", "dd MMM yyyy", "MMMM d, yyyy", "d MMMM yyyy")
PRINT_HEADER = r"(?i)^\s*([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2}),?\s+[0-9]{1,2}:[0-9]{2}(?:\s*[AP]M)?\b"


def render_reason(template: Column, context: Column) -> Column:
    """``template`` with each {name} replaced by its value in the map ``context``; names without a value become nothing.

    The template is cut at its placeholders, so a value that holds one itself is left as it is."""
    names = F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1))
    texts = F.split(template, r"\{\w+\}", -1)
    filled = F.zip_with(texts, names, lambda t, n: F.concat(t, F.when(n.isNull(), "").otherwise(F.coalesce(F.try_element_at(context, F.coalesce(n, F.lit(""))), F.lit("")))))
    return F.trim(F.array_join(filled, ""))


def grouped_number(number: Column, places: int = 2) -> Column:
    """1234.5 as 1,234.50."""
    return F.format_number(number, places)


def format_value(field: Column, text: Column, number: Column, currency: Column) -> Column:
    """A field's value: rates in percent, other numbers with two places and their currency, else its text; "not found" without any."""
    rate = F.concat(F.regexp_replace(F.regexp_replace(F.format_number(number, 6), ",", ""), r"\.?0+$", ""), F.lit("%"))
    amount = F.concat_ws(" ", grouped_number(number), F.nullif(currency, F.lit("")))
    return F.when(number.isNotNull(), F.when(field == "tax_rate", rate).otherwise(amount)).otherwise(F.coalesce(F.nullif(text, F.lit("")), F.lit("not found")))


def display_value(field: Column, value: Column, raw: Column, currency: Column) -> Column:
    """An identity value: dates written out, incomes as printed or grouped with their currency, genders with a capital."""
    day = F.date_format(value.try_cast("date"), "d MMMM yyyy")
    income = F.coalesce(F.nullif(raw, F.lit("")), F.concat_ws(" ", F.nullif(currency, F.lit("")), F.format_number(value.try_cast("double"), 0)))
    return (
        F.when(F.coalesce(value, F.lit("")) == "", "")
        .when(field == "date_of_birth", F.coalesce(day, F.nullif(raw, F.lit("")), value))
        .when(field == "annual_income", F.coalesce(F.nullif(income, F.lit("")), value))
        .when(field == "gender", F.concat(F.upper(F.substring(value, 1, 1)), F.lower(F.substr(value, F.lit(2)))))
        .otherwise(value)
    )


def date_renderings(day: Column) -> Column:
    """Every printed form of a date, each once, those tried first in front; null for null."""
    return F.when(day.isNotNull(), F.array_distinct(F.array(*(F.date_format(day, f) for f in DATE_FORMS))))


def print_header_dates(text: Column) -> Column:
    """The readings of the date in a browser's print header, on one of the first two lines: month first, then day first; those
    of no calendar are left out. An empty array without a header."""
    lines = F.slice(F.split(F.regexp_replace(text, r"^\s+", ""), r"\R"), 1, 2)
    head = F.get(F.filter(lines, lambda x: x.rlike(PRINT_HEADER)), F.lit(0))
    part = lambda g: F.regexp_extract(head, PRINT_HEADER, g)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    reading = lambda m, d: F.to_date(F.try_to_timestamp(F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")))
    dates = F.array_distinct(F.filter(F.array(reading(part(1), part(2)), reading(part(2), part(1))), lambda x: x.isNotNull()))
    return F.when(head.isNotNull(), dates).otherwise(F.array().cast("array<date>"))


def translate_messages(messages: DataFrame, dictionary: DataFrame, language: str = "language") -> DataFrame:
    """``messages`` (template, language, context, more) with text: the template in its language, filled; in its own where the
    dictionary (template, language, translation) lacks it or has an empty one. Of several entries the first by name counts."""
    one = dictionary.filter("translation <> ''").groupBy("template", F.col("language").alias(language)).agg(F.min("translation").alias("translation"))
    joined = messages.join(broadcast_if_small(materialize(one, "dictionary")), ["template", language], "left")
    return joined.withColumn("text", render_reason(F.coalesce("translation", "template"), F.col("context"))).drop("translation")


def describe_findings(findings: DataFrame, templates: DataFrame) -> DataFrame:
    """``findings`` (classification, reason, context, more) with description: the sentence of its (classification, reason), filled;
    that of the classification alone (a null reason) where its own is missing, else the reason in words."""
    own = templates.filter("reason IS NOT NULL").select("classification", "reason", F.col("template").alias("own"))
    common = templates.filter("reason IS NULL").select("classification", F.col("template").alias("common"))
    joined = findings.join(broadcast_if_small(materialize(own, "own")), ["classification", "reason"], "left").join(broadcast_if_small(materialize(common, "common")), "classification", "left")
    template = F.coalesce("own", "common", F.concat(F.replace("reason", F.lit("_"), F.lit(" ")), F.lit(".")))
    return joined.withColumn("description", render_reason(template, F.col("context"))).drop("own", "common")
