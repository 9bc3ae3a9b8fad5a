"""URL filter: rules first, else an empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host, registered domain and suffix. Each level's beta prior has the mean of the
level above and a strength fitted by moments to the spread of its groups; a host without labels inherits its domain's
posterior, a domain its suffix's. A url is blocked when even the upper posterior bound of its host's rate of good pages
is below the threshold. DataFrame functions only; the tables that meet the pages have one row per host.

A null url or one without :// has an empty host and path, fits no rule and is allowed. Repeated rows are judged alike.
A page with several labels counts each; null outcomes do not count. Without any label every host is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): fits the host and its subdomains where the url's path starts with the rule's.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: A host is blocked when mean + Z * deviation of its posterior is below THRESHOLD.
Z, THRESHOLD = 1.645, 0.5
#: Second-level labels below which countries register domains (no public suffix list is at hand).
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")
TWO_LEVELS = rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$"
#: The prior's strength (pseudo pages) stays within these bounds.
LEAST, MOST = 1.0, 1000.0


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, null if none fits."""
    text, verdict = None, None
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return text, verdict


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where the first of them is one of SECOND_LEVEL below a country's code."""
    return F.when(host.rlike(TWO_LEVELS), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and the label before it."""
    return F.when(host.rlike(TWO_LEVELS), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def shrunk(counts: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(key, parent_key, n, good) and the parents' (key, mean) to (key, n, good, mean, strength, alpha, beta).

    The strength is fitted per call by moments over all groups of the level: with the rates' spread around the parents'
    means in excess of binomial noise, strength = (1 - rho) / rho, rho the excess over mean * (1 - mean)."""
    with_prior = counts.join(parent.select(F.col("key").alias(parent_key), F.col("mean").alias("prior")), parent_key)
    p, n = F.col("prior"), F.col("n")
    moments = with_prior.filter(n > 1).agg(
        F.sum(n * F.pow(F.col("good") / n - p, 2)).alias("spread"), F.sum(p * (1 - p)).alias("noise"), F.sum((n - 1) * p * (1 - p)).alias("room")
    )
    rho = F.greatest(F.lit(1e-9), (F.col("spread") - F.col("noise")) / F.col("room"))
    strength = F.when(F.col("room") > 0, F.least(F.lit(MOST), F.greatest(F.lit(LEAST), (1 - rho) / rho))).otherwise(F.lit(MOST))
    fitted = moments.select(strength.alias("strength"))
    a, b = F.col("good") + F.col("strength") * p, n - F.col("good") + F.col("strength") * (1 - p)
    return with_prior.crossJoin(F.broadcast(fitted)).select(F.col(key).alias("key"), "n", "good", "prior", "strength", a.alias("alpha"), b.alias("beta"), (a / (a + b)).alias("mean"))


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per host: host, n, good, mean, deviation. pages: (page_id, host); outcomes: (page_id, good 0/1).

    The labels are counted per host before any level meets another, so a hot host is one row from there on. Each level is a
    stored table with a row per group, as the next one reads it twice."""
    marks = outcomes.filter(F.col("good").isNotNull()).groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"))
    counted = pages.join(marks, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    counted = stored(counted, "hosts")
    counted = counted.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = counted.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("root", F.lit(""))
    root = suffixes.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).select(F.lit("").alias("key"), ((F.coalesce("good", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 2)).alias("mean"))
    by_suffix = stored(shrunk(suffixes, "suffix", root, "root"), "suffixes")
    by_domain = stored(shrunk(domains, "domain", by_suffix, "suffix"), "domains")
    by_host = stored(shrunk(counted, "host", by_domain, "domain"), "hosts")
    a, b = F.col("alpha"), F.col("beta")
    return by_host.select(F.col("key").alias("host"), "n", "good", "mean", F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("deviation"))


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, z: float = Z, threshold: float = THRESHOLD) -> DataFrame:
    """id, host, path, rule, verdict, host_labels, host_rate, host_bound for every row of pages."""
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    named = outcomes.select(F.col(outcomes.columns[0]).alias("page_id"), F.col(outcomes.columns[1]).alias("good"))
    rep = reputations(base.select("page_id", "host"), named).withColumn("bound", F.col("mean") + z * F.col("deviation"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("host") != "") & (F.col("bound") < threshold), "block").otherwise("allow")
    out = base.join(rep, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("n").alias("host_labels"),
        F.round("mean", 6).alias("host_rate"), F.round("bound", 6).alias("host_bound"),
    )
    return out.withColumnRenamed("page_id", id_col)
