"""URL filters: path rules first, then the empirical-Bayes reputation of the host. DataFrame functions only.

Labelled page outcomes (bad or not) are counted by host. A beta-binomial prior is handed down from
all hosts to the suffix (last label of the host), from there to the registered domain (last two
labels) and to the host; at each level the prior's strength comes from how much the groups of that
level scatter around their parents (method of moments). A host is blocked when the lower bound of
its posterior bad rate is above ``most_bad``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Share of bad pages that counts as one outcome before any is seen.
PRIOR_BAD = 0.1

#: (host, path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and the path; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _shrunk(groups: DataFrame, parent: str, weakest: float = 0.001) -> DataFrame:
    """``strength`` and posterior ``mean`` of each group ``(n, bad, <parent>)`` around its parent's mean."""
    m, n, x = F.col(parent), F.col("n"), F.col("bad")
    spread = groups.agg(
        F.sum((x - n * m) * (x - n * m) - n * m * (1 - m)).alias("over"),
        F.sum(n * (n - 1) * m * (1 - m)).alias("scale"),
    ).select(F.when(F.col("scale") > 0, F.col("over") / F.col("scale")).otherwise(0.0).alias("rho"))
    rho = F.coalesce(spread.scalar(), F.lit(0.0))
    return groups.withColumn("strength", 1 / F.least(F.greatest(rho, F.lit(weakest)), F.lit(1 - weakest)) - 1).withColumn(
        "mean", (F.col("strength") * m + x) / (F.col("strength") + n)
    )


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """``(host, n, bad, low)`` for hosts of ``outcomes (host, bad)``; bad is 0, 1 or null (not labelled)."""
    bare = F.regexp_replace("host", r":[0-9]*$", "")
    hosts = (
        outcomes.groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumn("domain", F.regexp_extract(bare, r"([^.]*\.)?[^.]*$", 0))
        .withColumn("suffix", F.regexp_extract(bare, r"[^.]*$", 0))
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = suffixes.agg(((F.sum("bad") + F.lit(PRIOR_BAD).cast("double")) / (F.sum("n") + 1)).alias("m")).scalar()
    by_suffix = _shrunk(suffixes.withColumn("m", overall), "m").select("suffix", F.col("mean").alias("m"))
    by_domain = _shrunk(domains.join(by_suffix, "suffix"), "m").select("domain", F.col("mean").alias("m"))
    shrunk = _shrunk(hosts.join(by_domain, "domain"), "m")
    a = F.col("strength") * F.col("m") + F.col("bad")
    b = F.col("strength") * (1 - F.col("m")) + F.col("n") - F.col("bad")
    low = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return shrunk.select("host", "n", "bad", low.alias("low"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, most_bad: float = 0.3, z: float = 1.645
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages (page_id, url)``.

    ``outcomes (document, bad)`` are labelled outcomes of the documents that urls name by the first
    number of their path; several outcomes of a document count as bad if one is. Null urls have
    empty host and path; hosts without labels have their domain's posterior; without any outcome
    every host has the prior's bad rate, ``PRIOR_BAD``. Repeated rows stay; an empty table gives an
    empty result.
    """
    host, path = host_and_path(F.col("url"))
    # Pages are many and hosts few: the url is read once to count by host, once to judge.
    parts = need(pages, ["page_id", "url"]).select("page_id", host.alias("host"), path.alias("path"))
    known = need(outcomes, ["document", "bad"]).groupBy("document").agg(F.max("bad").cast("int").alias("bad"))
    counted = (
        parts.select("host", F.expr(r"try_cast(regexp_extract(path, '[0-9]+', 0) AS bigint)").alias("document"))
        .join(known, "document", "left")
        .select("host", "bad")
    )
    reputation = host_reputation(counted, z).select("host", F.when(F.col("low") > most_bad, "block").otherwise("allow").alias("by_host"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return parts.join(reputation, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "by_host").alias("verdict"))


ORACLE = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), halves AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut
), parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM halves
), known AS (
  SELECT doc_id AS document, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), counted AS (
  SELECT host, known.bad FROM parts LEFT JOIN known ON try_cast(regexp_extract(path, '[0-9]+') AS bigint) = known.document
), hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
    regexp_extract(regexp_replace(host, ':[0-9]*$', ''), '([^.]*\.)?[^.]*$') AS domain,
    regexp_extract(regexp_replace(host, ':[0-9]*$', ''), '[^.]*$') AS suffix
  FROM counted GROUP BY host
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix
), suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix
), overall AS (SELECT (sum(bad) + cast(0.1 AS double)) / (sum(n) + 1) AS m FROM suffixes
), s1 AS (SELECT s.*, m FROM suffixes s, overall
), r1 AS (SELECT coalesce(CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0 THEN sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) END, 0) AS rho FROM s1
), m1 AS (SELECT suffix, ((1 / least(greatest(rho, 0.001), 0.999) - 1) * m + bad) / ((1 / least(greatest(rho, 0.001), 0.999) - 1) + n) AS m FROM s1, r1
), s2 AS (SELECT d.domain, d.n, d.bad, m1.m FROM domains d JOIN m1 USING (suffix)
), r2 AS (SELECT coalesce(CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0 THEN sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) END, 0) AS rho FROM s2
), m2 AS (SELECT domain, ((1 / least(greatest(rho, 0.001), 0.999) - 1) * m + bad) / ((1 / least(greatest(rho, 0.001), 0.999) - 1) + n) AS m FROM s2, r2
), s3 AS (SELECT h.host, h.n, h.bad, m2.m FROM hosts h JOIN m2 USING (domain)
), r3 AS (SELECT coalesce(CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0 THEN sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) END, 0) AS rho FROM s3
), ab AS (SELECT host, (1 / least(greatest(rho, 0.001), 0.999) - 1) * m + bad AS a, (1 / least(greatest(rho, 0.001), 0.999) - 1) * (1 - m) + n - bad AS b FROM s3, r3
), low AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM ab
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM parts
)
SELECT page_id, ruled.host AS host, path, rule,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN low > 0.3 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN low ON ruled.host = low.host
"""
