"""URL verdicts from rules and empirical-Bayes host reputation; DataFrame functions only.

Labelled page outcomes (good or bad) are counted by host, registered domain and public suffix. Rates
of the suffixes are drawn from a beta distribution around the rate of the whole table, those of a
suffix's domains around the suffix's, those of a domain's hosts around the domain's. The spread of
each of these three levels (rho, the share of the variance between the members; the prior's strength
in pseudo-counts is 1 / rho - 1) is fitted to the counts of the whole table by moments, within
1/1001 and 1/2, and is 1/21 where no member has two outcomes.

From the top down every suffix, domain and host gets its posterior mean and variance. One without
outcomes has the mean of the level above, and the variance of that level plus its own spread. So an
unlabelled host inherits what is known of its domain, else of its suffix, the less surely the farther
that is. A host is blocked when the lower bound of its bad rate (mean minus `z` standard deviations)
exceeds `max_bad`.

Rules (verdict, pattern) win over reputation: a rule fits its host and all subdomains when the
url's path starts with the rule's; the longest pattern wins.

A null url, or one without ://, has an empty host and path, and is judged like any host without
outcomes. Null labels, ids and repeated rows: a label counts once for each page row it joins; pages
without a label count nothing; null ids join nothing. Every page row gives one row, of an empty table
none; without any outcomes all unruled hosts are allowed. Other columns are not looked at, whatever
their names; urls may be of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _shared

#: Second-level suffixes under which names are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From there up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, with the one before where names are registered below that (co.uk)."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    last, before = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    two = (n >= 3) & (F.length(last) == 2) & before.isin(*SECOND_LEVEL)
    return F.when(two, F.concat_ws(".", before, last)).otherwise(last)


def domain_of(host: Column) -> Column:
    """The suffix and one label more."""
    parts = F.split(host, r"\.")
    keep = F.size(F.split(suffix_of(host), r"\.")) + 1
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - keep + 1, F.lit(1)), keep), ".")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    out = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, pattern in reversed(ordered):
        name, slash, rest = pattern.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(pattern).alias("rule"))).otherwise(out)
    return out


def _spread(members: DataFrame) -> DataFrame:
    """One row (rho) for members(n, b, m): the share of variance between members, by moments.

    The square of b - n m has the mean n m (1 - m) (1 + (n - 1) rho)."""
    noise = F.col("n") * F.col("m") * (1 - F.col("m"))
    over = F.sum((F.col("b") - F.col("n") * F.col("m")) * (F.col("b") - F.col("n") * F.col("m")) - noise)
    room = F.sum((F.col("n") - 1) * noise)
    fitted = F.when(room > 0, F.least(F.greatest(over / room, F.lit(1 / 1001)), F.lit(0.5)))
    return members.where("n > 0").agg(F.coalesce(fitted, F.lit(1 / 21)).alias("rho"))


def _posterior(members: DataFrame) -> DataFrame:
    """members(.., n, b, m, v), m and v the mean and variance of the level above, with their own `mean` and `var`."""
    some = members.crossJoin(F.broadcast(_spread(members)))  # one row
    strength = 1 / F.col("rho") - 1
    mean = (F.col("b") + strength * F.col("m")) / (F.col("n") + strength)
    known = mean * (1 - mean) / (F.col("n") + strength + 1)
    unknown = F.col("rho") * F.col("m") * (1 - F.col("m")) + (1 - F.col("rho")) * F.col("v")
    return some.withColumns({"mean": mean, "var": F.when(F.col("n") > 0, known).otherwise(unknown)})


def reputation(hosts: DataFrame, outcomes: DataFrame, z: float = 1.0) -> DataFrame:
    """(host, n, bad, mean, bound) for every host of hosts(host), from outcomes(host, bad 0/1): posterior mean
    and lower bound of the bad rate. Hosts of outcomes are among `hosts`."""
    counted = outcomes.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("b"))
    by_host = hosts.groupBy("host").agg(F.lit(0.0).alias("n"), F.lit(0.0).alias("b")).unionByName(counted).groupBy("host").agg(
        F.sum("n").alias("n"), F.sum("b").alias("b"))
    # a table of the hosts alone: the levels read it several times
    by_host = _shared.cut(by_host.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "op5-hosts")
    by_domain = by_host.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.first("suffix").alias("suffix"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    whole = by_suffix.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("an"), F.coalesce(F.sum("b"), F.lit(0.0)).alias("ab"))
    base = (F.col("ab") + 1) / (F.col("an") + 2)
    top = whole.select(base.alias("m"), (base * (1 - base) / (F.col("an") + 3)).alias("v"))  # one row
    above = lambda level, name: level.select(name, F.col("mean").alias("m"), F.col("var").alias("v"))
    suffixes = _posterior(by_suffix.crossJoin(F.broadcast(top)))
    domains = _shared.cut(_posterior(by_domain.join(above(suffixes, "suffix"), "suffix")).select("domain", "mean", "var"), "op5-domains")
    found = _posterior(by_host.join(above(domains, "domain"), "domain"))
    return found.select("host", "n", F.col("b").alias("bad"), "mean", (F.col("mean") - z * F.sqrt("var")).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], z: float = 1.0, max_bad: float = 0.3) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_bound) for every row of pages(page_id, url);
    outcomes(page_id, bad) are the labelled pages."""
    pages = _shared.columns(pages, "page_id", "url")
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = split.select("page_id", "host").join(
        outcomes.where("page_id is not null and bad is not null").select("page_id", "bad"), "page_id").select("host", "bad")
    found = reputation(split.select("host"), known, z).select("host", F.col("bound").alias("bad_bound"))
    ruled = split.join(found, "host", "left").withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "bad_bound")
