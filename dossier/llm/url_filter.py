"""URL filters: fixed host and path rules first, then association rules that FP-growth mines from labels.

Every URL becomes a set of typed tokens: scheme, host labels and suffixes, all path segments and their words, extension,
depth of the path, all query keys, fragment. All tokens of a labelled URL go into the mining that enough bad URLs have;
tokens that the very same labelled URLs have are one item, and items that can be in no rule of several are left to
rules by themselves. Spark's FP-growth finds the combinations that go with the label "bad"; rules below the support or
confidence bounds are pruned, as is every rule that a shorter one makes needless. Rules are matched against all tokens
of every URL.

Matching is an inverted index: each rule is filed under the one of its tokens that the fewest URLs have, distinct token
sets look their tokens up by an equality join, and the tokens of the few rules found are held against the set.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.storage import broadcast_if_small, materialize, read_table

#: A token or rule needs so many labelled URLs, whatever their number, and this share of them.
MIN_CASES = 15
MIN_SUPPORT = 1e-5
#: Labels of a host's longest suffix that is a token.
SUFFIX_LABELS = 5
MIN_CONFIDENCE = 0.6
#: Standard errors by which a rule's confidence must be above the bound (Wilson's interval): few URLs prove little.
SURE = 3.0
BAD = "label=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed rules of the query op2: verdict, host, path.
FIXED_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The sorted distinct tokens of a URL; a url without a host has its other tokens, a null one none."""
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    words = F.filter(F.split(F.translate(path, UPPER, LOWER), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    keys = F.filter(F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    extension = F.regexp_extract(F.coalesce(F.get(segments, F.size(segments) - 1), F.lit("")), r"\.([A-Za-z0-9]{1,8})$", 1)
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    many = F.size(labels)
    lengths = F.when(many > 1, F.sequence(F.lit(2), F.greatest(F.least(many, F.lit(SUFFIX_LABELS)), F.lit(2)))).otherwise(F.array().cast("array<int>"))
    suffixes = F.transform(lengths, lambda k: F.array_join(F.slice(labels, -k, k), "."))

    def one(name: str, value: Column, there: Column) -> Column:
        return F.when(there, F.array(F.concat(F.lit(name + "="), value.cast("string")))).otherwise(F.array().cast("array<string>"))

    def all_of(name: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.concat(F.lit(name + "="), x))

    found = F.concat(
        one("scheme", F.lower(scheme), scheme != ""),
        one("top", F.get(labels, many - 1), host != ""),
        all_of("suffix", suffixes),
        all_of("host", F.filter(labels, lambda x: x != "")),
        all_of("segment", segments),
        all_of("word", words),
        one("extension", F.lower(extension), extension != ""),
        one("depth", F.least(F.size(segments), F.lit(5)), F.size(segments) > 0),
        all_of("query", keys),
        one("fragment", F.lit("yes"), F.instr(url, "#") > 0),
    )
    return F.when(url.isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(found)))


def fixed_verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (page, rule, verdict): for each row of ``pages`` (page, host, path) the longest of ``rules`` (verdict,
    host, path) that fits. Hosts are looked up by each of their suffixes, so no page meets a rule of another host."""
    labels = F.split("host", r"\.")
    deepest = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(1))).first()[0]  # longer suffixes can't be a rule's host
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    looked = pages.filter("host != ''").select("page", "path", F.explode(suffixes).alias("suffix"))
    named = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "verdict", F.concat("host", "path").alias("rule"))
    fits = looked.join(broadcast_if_small(named), "suffix").filter(F.col("path").startswith(F.col("start")))
    best = F.max(F.struct(F.length("rule").alias("n"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict")))
    return fits.groupBy("page").agg(best.alias("b")).select("page", "b.rule", "b.verdict")


def surely(confidence: Column, n: Column, z: float = SURE) -> Column:
    """Lower end of Wilson's interval for a share ``confidence`` of ``n`` cases."""
    spread = z * F.sqrt(confidence * (1 - confidence) / n + z * z / (4 * n * n))
    return (confidence + z * z / (2 * n) - spread) / (1 + z * z / n)


def items_of(labelled: DataFrame, min_support: float, min_cases: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Rows (n, tokens, bad) of those of ``labelled`` (tokens, bad) that have tokens, rows (token, item, cases, bads), the
    number of the former and the bad URLs that a rule needs.

    Tokens of fewer bad URLs than that are in no rule and have no row. Tokens that the very same URLs have are one item,
    named by the first of them: a rule of several is as confident as that of one, and any of them will do to match.
    """
    numbered = materialize(labelled.filter(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("n"), "tokens", "bad"), "labelled")
    many = numbered.count()
    need = max(min_cases, math.ceil(min_support * many), 1)
    who = [F.bit_xor(F.xxhash64("n", F.lit(i))).alias(f"who{i}") for i in range(2)]  # 128 bits of the set of URLs
    singles = numbered.select("n", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("cases"), F.count_if("bad").alias("bads"), *who)
    singles = materialize(singles.filter(F.col("bads") >= need), "singles")
    same = ["cases", "bads", "who0", "who1"]
    named = singles.groupBy(*same).agg(F.min("token").alias("item"))
    return numbered, materialize(singles.join(named, same).select("token", "item", "cases", "bads"), "items"), many, need


def baskets_of(numbered: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (items) of those of ``numbered`` that have any of ``items`` (token, item): all that they have, and the label."""
    named = items.filter("token = item").select("token")
    each = numbered.select("n", "bad", F.explode("tokens").alias("token")).join(broadcast_if_small(named), "token")
    chosen = each.groupBy("n").agg(F.collect_list("token").alias("tokens"), F.bool_or("bad").alias("bad"))
    return chosen.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_cases: int = MIN_CASES) -> tuple[DataFrame, DataFrame]:
    """Rows (rule_id, tokens, confidence, support) mined from ``labelled`` (tokens, bad boolean), whose tokens stand for
    their items, and rows (token, item) of all tokens of these items. No rows, no rules.

    Every combination of tokens that meets the bounds is found, but for those that a shorter one makes needless.
    """
    numbered, items, many, need = items_of(labelled, min_support, min_cases)
    of_all = F.col("bads") / F.col("cases")

    def sure(found: DataFrame) -> DataFrame:  # (tokens, cases, bads)
        kept = found.filter((of_all >= min_confidence) & (surely(of_all, F.col("cases")) >= min_confidence))
        return kept.select(F.array_join("tokens", "&").alias("rule_id"), "tokens", of_all.alias("confidence"), (F.col("bads") / many).alias("support"))

    # an item that makes every rule with it needless is a rule by itself or none: a sure one of bad URLs alone, since no
    # rule is more confident, and one that all URLs have, since it tells nothing beside others
    alone = ((F.col("bads") == F.col("cases")) & (surely(F.lit(1.0), F.col("cases")) >= min_confidence)) | (F.col("cases") == many)
    found = sure(items.filter((F.col("token") == F.col("item")) & alone).select(F.array("item").alias("tokens"), "cases", "bads"))
    baskets = materialize(baskets_of(numbered, items.filter(~alone)), "baskets")  # read in several passes
    if n := baskets.count():
        sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (need - 0.5) / n)).fit(baskets).freqItemsets
        sets = materialize(sets.select(F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.array_contains("items", BAD).alias("bad"), "freq"), "frequent")
        bads = sets.filter("bad AND size(tokens) > 0").select("tokens", F.col("freq").alias("bads"))
        found = found.union(sure(sets.filter("NOT bad").select("tokens", F.col("freq").alias("cases")).join(bads, "tokens")))
    rules = materialize(found, "rules")
    # a rule is needless if a shorter one within it is as confident; one that is not needless itself then is, too
    kept = rules.limit(0)
    for (size,) in rules.select(F.size("tokens")).distinct().orderBy(F.size("tokens")).collect():
        level = rules.filter(F.size("tokens") == size)
        if size > 1:
            within = match_rules(level.select(F.col("rule_id").alias("key"), "tokens"), kept).select(F.col("key").alias("rule_id"), F.col("confidence").alias("other"))
            level = level.join(within, "rule_id", "left").filter("other IS NULL OR other < confidence").drop("other")
        kept = materialize(kept.union(level.select(*kept.columns)), "kept")
    used = kept.select(F.explode("tokens").alias("item")).distinct()
    return kept, materialize(items.join(used, "item").select("token", "item"), "used")


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (key, mined, confidence): for each row of ``sets`` (key, tokens; distinct) the most confident rule within
    its tokens; of equals the shortest, then the first by name."""
    counts = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    each = rules.select("rule_id", "confidence", F.col("tokens").alias("needs"), F.explode("tokens").alias("token"))
    index = each.join(counts, "token", "left").groupBy("rule_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token").alias("token"))).alias("rarest"), F.first("confidence").alias("confidence"), F.first("needs").alias("needs")
    )
    index = broadcast_if_small(materialize(index.select("rule_id", "confidence", "needs", F.col("rarest.token").alias("token")), "index"))
    found = sets.select("key", "tokens", F.explode("tokens").alias("token")).join(index, "token").filter(F.size(F.array_except("needs", "tokens")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), F.size("needs").alias("n"), F.col("rule_id").alias("rule_id")))
    return found.groupBy("key").agg(best.alias("b")).select("key", F.col("b.rule_id").alias("mined"), (-F.col("b.c")).alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", **bounds) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, mined, confidence), one for each row of ``pages``.

    A fixed rule that fits decides; else a page is blocked if a mined rule matches and allowed if none does. Labels are
    joined by the page's id: bad is quality 0 or toxic 1 in any label row of the id. A null url, or one without "://",
    has empty host and path and is allowed unless a mined rule of its other tokens matches. Of rules that fit equally
    well the shortest, then the first by name is told; of tokens that the very same labelled URLs have, the first by name
    stands for all of them. Repeated rows stay repeated; without labels nothing is mined; an
    empty table gives no rows; a very long url has as many tokens as parts. Other columns are not read.
    """
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    tokens = tokens_of(F.col("url"), F.col("host"), F.col("path"))
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    mined, names = mine_rules(parsed.join(marks, "page_id").select(tokens.alias("tokens"), "bad"), **bounds)
    # urls, and hosts with paths, that many pages share are judged once
    urls = parsed.filter("url IS NOT NULL").select("url", "host", "path").distinct().select(F.col("url").alias("key"), tokens.alias("tokens"))
    known = urls.select("key", F.explode("tokens").alias("token")).join(broadcast_if_small(names), "token")
    urls = materialize(known.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("tokens")), "known")
    matched = materialize(match_rules(urls, mined).withColumnRenamed("key", "url"), "matched")
    places = parsed.select(F.struct("host", "path").alias("page"), "host", "path").distinct()
    fixed = materialize(fixed_verdicts(places, rules).select(F.col("page.host").alias("host"), F.col("page.path").alias("path"), "rule", "verdict"), "fixed")
    joined = parsed.join(broadcast_if_small(matched), "url", "left").join(broadcast_if_small(fixed), ["host", "path"], "left")
    verdict = F.coalesce("verdict", F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mined", "confidence")


def fixed_rules(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = FIXED_RULES) -> DataFrame:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules(verdict, host, path)")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"), fixed_rules(spark))
