"""Identity comparison and case linking: names, shared identifiers, family checks, review carry-over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions.text import full_form, name_tokens, sound_key


#: Shorter tokens are never taken for one another by a slip.
SLIP_LENGTH = 5


def name_part(token: Column) -> Column:
    """What comparing a name token takes, worked out once: the token, its full form, and the sounds of both."""
    return F.struct(token.alias("token"), full_form(token).alias("full"), sound_key(full_form(token)).alias("sound"), sound_key(token).alias("own"))


def one_slip(a: Column, b: Column) -> Column:
    """Name parts whose sounds begin alike and differ by a letter more, a changed vowel or two neighbours exchanged."""
    x, y = a["own"], b["own"]
    pairs = F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    apart = F.filter(F.transform(pairs, lambda v, i: F.struct(i.alias("i"), v["p"].alias("p"), v["q"].alias("q"))), lambda v: v["p"] != v["q"])
    one, two = F.get(apart, F.lit(0)), F.get(apart, F.lit(1))
    vowel = (F.size(apart) == 1) & one["p"].isin(*"aeiou") & one["q"].isin(*"aeiou")
    swapped = (F.size(apart) == 2) & (two["i"] == one["i"] + 1) & (one["p"] == two["q"]) & (one["q"] == two["p"])
    alike = F.when(F.length(x) == F.length(y), vowel | swapped).otherwise(F.levenshtein(x, y) == 1)
    return (F.least(F.length(a["token"]), F.length(b["token"])) >= SLIP_LENGTH) & (F.substring(x, 1, 1) == F.substring(y, 1, 1)) & alike


def part_relation(a: Column, b: Column) -> Column:
    """exact, abbreviation, spelling (one sound), initial or typo of two name parts (see ``name_part``), the strongest; null if none."""
    s, t = a["token"], b["token"]
    short = (a["full"] != s) | (b["full"] != t)
    initial = ((F.length(s) == 1) & t.startswith(s)) | ((F.length(t) == 1) & s.startswith(t))
    return (
        F.when(s == t, "exact")
        .when(a["sound"] == b["sound"], F.when(short, "abbreviation").otherwise("spelling"))
        .when((F.length(s) == 1) | (F.length(t) == 1), F.when(initial, "initial"))
        .when(one_slip(a, b), "typo")
    )


def token_relation(a: Column, b: Column) -> Column:
    return part_relation(name_part(a), name_part(b))


def compare_names(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``verdict``: match, harmless, possible_spelling_error, partial_name or different_name; null if a
    side has no letters. Tokens are matched by the best relation that any token of the other name gives; a token
    without one makes a difference if both names have such tokens, and a partial name if one has."""
    split = pairs.withColumn("__a", name_tokens(F.col(a))).withColumn("__b", name_tokens(F.col(b)))

    def related(x: str, y: str) -> Column:
        order = F.create_map(*(F.lit(v) for v in ("exact", 0, "abbreviation", 1, "initial", 1, "spelling", 1, "typo", 2)))
        return F.transform(x, lambda t: F.array_min(F.transform(y, lambda u: F.coalesce(F.element_at(order, token_relation(t, u)), F.lit(3)))))

    rated = split.withColumn("__ra", related("__a", "__b")).withColumn("__rb", related("__b", "__a"))
    lone_a, lone_b = (F.exists(c, lambda r: r == 3) for c in ("__ra", "__rb"))
    worst = F.greatest(F.array_max(F.filter("__ra", lambda r: r < 3)), F.array_max(F.filter("__rb", lambda r: r < 3)))
    verdict = (
        F.when((F.size("__a") == 0) | (F.size("__b") == 0) | F.col(a).isNull() | F.col(b).isNull(), F.lit(None).cast("string"))
        .when(lone_a & lone_b, "different_name")
        .when(lone_a | lone_b, "partial_name")
        .when(worst == 2, "possible_spelling_error")
        .when(F.col("__a") == F.col("__b"), "match")
        .otherwise("harmless")
    )
    return rated.withColumn("verdict", verdict).drop("__a", "__b", "__ra", "__rb")


def linked_cases(signals: DataFrame, most: int = 50) -> DataFrame:
    """Rows (signal, value, case_id, first_case, n_cases) of the cases (signal, value, case_id) that share a value.

    A link goes from each case to the first that has the value, so a value that very many share makes no pairs. Values
    of more than ``most`` cases are reported with all of their cases too; ``common`` marks them as weak evidence.
    """
    distinct = signals.filter("value IS NOT NULL AND value <> ''").select("signal", "value", "case_id").distinct()
    groups = distinct.groupBy("signal", "value").agg(F.min("case_id").alias("first_case"), F.count("*").alias("n_cases")).filter("n_cases > 1")
    return distinct.join(groups, ["signal", "value"]).withColumn("common", F.col("n_cases") > most)


def carry_review_decisions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New findings with the review status of the same finding before; others are pending."""
    kept = old.select(*keys, "review_status").dropDuplicates(keys)
    return new.join(kept, keys, "left").withColumn("review_status", F.coalesce("review_status", F.lit("pending")))


def stored_minus_current(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti")


def sync_findings(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of either side with what to do: insert, keep or delete."""
    o, n = old.select(*keys, F.lit(True).alias("__o")).distinct(), new.select(*keys, F.lit(True).alias("__n")).distinct()
    action = F.when(F.col("__o").isNull(), "insert").when(F.col("__n").isNull(), "delete").otherwise("keep")
    return o.join(n, keys, "full").select(*keys, action.alias("action"))


def finding_resolution(classification: Column, review: Column) -> Column:
    return F.when(review == "dismissed", "no_issue").when((classification == "conflict") & (review == "accepted"), "conflict_confirmed").when(classification == "conflict", "open").otherwise("no_issue")


def finding_severity_score(severity: Column) -> Column:
    return F.when(severity == "critical", 95).when(severity == "high", 75).when(severity == "medium", 50).when(severity == "low", 25).otherwise(0)


def issuer_match(names: DataFrame, registry: DataFrame, least: float = 0.8) -> DataFrame:
    """Rows (name, issuer, score): for each distinct name the best registry entry by shared three-letter pieces (Dice),
    of equals the first by name; null below ``least``.

    Two sets that are similar enough share one of each side's rarest pieces, as many as may be missing and one more. So
    only those few pieces are indexed and joined, and no candidate is lost; very common pieces are hardly ever among
    them. Candidates are then scored on all of their pieces.
    """

    def grams(c: Column) -> Column:
        plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(plain) - 2, F.lit(1))), lambda i: F.substring(plain, i, F.lit(3))))

    left = names.select("name").filter("name IS NOT NULL").distinct().withColumn("g", grams(F.col("name")))
    right = registry.select(F.col("issuer").alias("name")).filter("name IS NOT NULL").distinct().withColumn("g", grams(F.col("name")))
    counts = right.select(F.explode("g").alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))

    def rarest(side: DataFrame) -> DataFrame:
        ranked = side.select("name", F.explode("g").alias("piece")).join(counts, "piece", "left").groupBy("name").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece"))).alias("r"))
        needed = F.ceil(F.size("r") * (least / (2 - least)) - 1e-9).cast("int")
        return ranked.select("name", F.explode(F.slice("r", 1, F.size("r") - needed + 1)).alias("r")).select("name", F.col("r.piece").alias("piece"))

    pairs = rarest(left).join(rarest(right).withColumnRenamed("name", "issuer"), "piece").select("name", "issuer").distinct()
    both = pairs.join(left, "name").join(right.select(F.col("name").alias("issuer"), F.col("g").alias("h")), "issuer")
    score = F.round(2.0 * F.size(F.array_intersect("g", "h")) / (F.size("g") + F.size("h")), 6)
    best = both.withColumn("score", score).filter(F.col("score") >= least).groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "issuer")).alias("b"))
    return left.select("name").join(best, "name", "left").select("name", "b.issuer", (-F.col("b.s")).alias("score"))


def birth_order(members: DataFrame) -> DataFrame:
    """Members (family_id, member_id, born) with their place by age; equal dates share a place."""
    return members.withColumn("place", F.dense_rank().over(W.partitionBy("family_id").orderBy(F.col("born").asc_nulls_last())))
