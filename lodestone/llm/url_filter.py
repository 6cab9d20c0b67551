"""URL filters: a blocked Bloom filter first, then an exact hash join.

A list holds rules (host, path, verdict: a host with all its subdomains, and a start
of the path) and canonical URLs that are blocked. A URL's keys are its canonical
form, its site's canonical form, and each ending of its host with each start of its
path that is as long as some rule's. Keys that the filter passes go into a join with
the list by their text, which removes false positives. The longest rule decides; a
URL without one is blocked if it or its site is listed, else allowed.

All of it is DataFrame functions. Only keys that the filter passes are shuffled.

Defined results: a null URL, or one without '://', has an empty host and path, no rule
and the verdict allow. Repeated rows and null keys keep their rows. Of rules of equal
length the alphabetically last wins. An empty list allows all. Extra columns pass
through; host, path, rule and verdict get other names where `pages` has those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import ascii_lower, fresh, number_rows

#: The rules that every judgement uses.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Sites whose canonical URLs are blocked.
SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED = tuple(f"{name}.example.{top}" for name in SITES for top in ("com", "net", "org"))
#: Parameters that don't change what a URL shows.
TRACKING = r"(utm_[^=]*|ref|fbclid|gclid|mc_cid|mc_eid|sessionid)(=.*)?"


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def canonical_site(host: Column) -> Column:
    """A host without user, default port and leading www."""
    return F.regexp_replace(F.regexp_replace(host, r"^[^@]*@|:(80|443)?$", ""), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """Site, path without closing slashes, and sorted parameters but for tracking ones."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(f"^{TRACKING}$"))))
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.concat(canonical_site(host_of(url)), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def default_list(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The fixed rules and the listed canonical URLs, as tables of literals."""
    rules = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES))
    return spark.range(1).select(F.inline(rules)), spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED))).alias("url"))


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """`pages` with host, path, the rule that decides and the verdict."""
    known = rules.select(F.concat("host", "path").alias("rule"), "host", "path", F.lower("verdict").alias("verdict")).distinct()
    lengths = [r["n"] for r in known.select(F.length("path").alias("n")).distinct().orderBy("n").collect()]
    entries = known.select(F.concat(F.lit("r "), "rule").alias("_key"), "rule", "verdict").unionByName(
        listed.select(F.concat(F.lit("u "), "url").alias("_key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict")).distinct()
    )
    known_keys = bloom.build(entries, "_key")
    row, host, path = fresh(pages, "_row"), fresh(pages, "host"), fresh(pages, "path")
    rule, verdict = fresh(pages, "rule"), fresh(pages, "verdict")
    numbered = number_rows(pages, row).withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))})
    labels = F.split(F.col(host), r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length(path))
    of_rules = F.flatten(F.transform(endings, lambda h: F.transform(starts, lambda n: F.concat(F.lit("r "), h, F.substring(F.col(path), F.lit(1), n)))))
    own = F.array(F.concat(F.lit("u "), canonical_url(F.col(url))), F.concat(F.lit("u "), canonical_site(F.col(host))))
    keys = F.when(F.col(host) != "", F.array_distinct(F.concat(of_rules, own)))
    thin = numbered.select(F.col(row).alias("_row"), keys.alias("_keys"))
    passed = thin.select("_row", F.explode(F.filter("_keys", lambda k: known_keys.may_contain(k))).alias("_key"))
    exact = passed.join(entries, "_key")
    best = exact.groupBy("_row").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "verdict"))).alias("_best"),
        F.bool_or(F.col("rule").isNull()).alias("_listed"),
    )
    at, chosen, known_bad = (fresh(pages, n) for n in ("_at", "_best", "_listed"))
    best = best.select(F.col("_row").alias(at), F.col("_best").alias(chosen), F.col("_listed").alias(known_bad))
    joined = numbered.join(best, F.col(row) == F.col(at), "left")
    decided = F.coalesce(F.col(chosen)["verdict"], F.when(F.col(known_bad), "block"), F.lit("allow"))
    return joined.withColumns({rule: F.col(chosen)["rule"], verdict: decided}).drop(row, at, chosen, known_bad)
