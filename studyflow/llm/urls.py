"""URL filters: explicit rules, and empirical-Bayes reputation of hosts for all other urls.

Rules.  A rule ``host/path`` fits the host and all its subdomains where the url's path starts with the rule's path; the
longest rule that fits wins (of equal length the one that sorts first).  A few rules (a dict) reach the tasks as one
literal map.  Blocklists of any size come as a table (rule, verdict): each url's host and the domains above it join the
rules' hosts, both sides exchanged for the join alone, and the longest fitting rule is taken by an aggregate.

Reputation.  Labelled pages are counted by host.  Hosts' good outcomes are taken as binomial, with rates drawn from a
beta prior of their registered domain, domains' rates from a prior of their suffix, and suffixes' from one of all
pages.  Priors are the parent's posterior mean with a strength (equivalent number of labels) estimated from all
children of the level by moments: mean m and between-children variance v give m(1-m)/v - 1, held within bounds.  So a
host with few labels shrinks to its domain, and an unlabelled one takes its domain's or suffix's mean.  A host is
blocked when even the upper bound (mean + ``Z`` posterior standard deviations) of its good rate is below ``MIN_GOOD``.
The registered domain is the suffix and one label more; suffixes of several labels are a parameter, a few of them as
a tuple or a whole list as a table (suffix).

Counting is aggregated before the shuffle; the host table is written once, and only one row of sums a level comes to
the driver.  It joins the pages by host, which Spark splits where a host is hot (both sides are exchanged for the join
alone).

Defined results: a null url, or one without ``://``, has empty host and path and no rule, and is judged as the host "";
repeated rows count as often as they occur; a page with several labels counts each; null labels count not at all; a null
rule or suffix fits nothing; empty tables have empty results; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .shared import written

#: Fixed values of the contract.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
MIN_GOOD, Z = 0.5, 1.64
#: Bounds of a prior's strength.
LEAST, MOST = 2.0, 1000.0
#: Suffixes of several labels under which domains are registered, where none are given (fixed values).
DEEP_SUFFIXES = ("co.uk", "org.uk", "com.au", "co.jp", "com.br", "co.nz")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def parents(host: Column) -> Column:
    """The host and all domains above it, the longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def with_domains(hosts: DataFrame, suffixes: tuple[str, ...] | DataFrame = DEEP_SUFFIXES) -> DataFrame:
    """Adds suffix and domain to a table with each host once: the longest of ``suffixes`` that the host ends with (or is), else its last label."""
    last = F.substring_index("host", ".", -1)
    if isinstance(suffixes, tuple):
        fitting = F.get(F.filter(parents(F.col("host")), lambda p: p.isin(*suffixes)), 0) if suffixes else F.lit(None).cast("string")
        found = hosts.withColumn("suffix", F.coalesce(fitting, last))
    else:
        known = suffixes.select(F.col("suffix").alias("s")).where("s IS NOT NULL").distinct()
        ends = hosts.select("host", F.explode(parents(F.col("host"))).alias("s")).join(known, "s")
        longest = ends.groupBy("host").agg(F.max_by("s", F.length("s")).alias("suffix"))
        found = hosts.join(longest, "host", "left").withColumn("suffix", F.coalesce("suffix", last))
    n = F.size(F.split("suffix", r"\."))
    return found.withColumn("domain", F.array_join(F.slice(F.reverse(F.split("host", r"\.")), F.lit(1), n + 1), ".")).withColumn("domain", F.array_join(F.reverse(F.split("domain", r"\.")), "."))


def _rule_path(rule: Column) -> Column:
    return F.when(F.contains(rule, F.lit("/")), F.concat(F.lit("/"), F.regexp_extract(rule, "(?s)^[^/]*/(.*)$", 1))).otherwise("")


def best_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of a few rules that fits, else null."""
    if not rules:
        return F.lit(None).cast("string")
    by_host: dict[str, list[str]] = {}
    for rule in sorted(rules):
        by_host.setdefault(rule.split("/", 1)[0], []).append("/" + rule.split("/", 1)[1] if "/" in rule else "")
    table = F.create_map(*(x for h, paths in by_host.items() for x in (F.lit(h), F.array(*map(F.lit, paths)))))
    fitting = F.flatten(F.transform(parents(host), lambda h: F.transform(F.filter(F.coalesce(F.try_element_at(table, h), F.array().cast("array<string>")), lambda p: path.startswith(p)), lambda p: F.concat(h, p))))
    found = F.array_sort(fitting, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.get(found, 0)


def rules_by_join(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, by_rule) of the distinct hosts and paths that a rule of the table (rule, verdict) fits: the longest, then the first."""
    table = rules.where("rule IS NOT NULL").groupBy("rule").agg(F.min("verdict").alias("by_rule"))
    table = table.select("rule", "by_rule", F.split_part("rule", F.lit("/"), F.lit(1)).alias("r_host"), _rule_path(F.col("rule")).alias("r_path"))
    urls = rows.select("host", "path").distinct()
    fitting = urls.withColumn("r_host", F.explode(parents(F.col("host")))).join(table, "r_host").where(F.startswith("path", "r_path"))
    best = F.min(F.struct((-F.length("rule")).alias("n"), "rule", "by_rule")).alias("b")
    return fitting.groupBy("host", "path").agg(best).select("host", "path", "b.rule", "b.by_rule")


def _strength(sums: Row | None) -> float:
    """How many labels a prior of this level is worth, by moments over the children with labels (n, good): from their number c, and the sums of n, good, and good squared by n."""
    if sums is None or not sums.n:
        return float(MOST)
    mean = sums.good / sums.n
    between = sums.square / sums.n - mean * mean
    # Of the spread of rates, what the binomial draws alone would give is taken away.
    apart = (sums.c - 1) / sums.n
    v = (between - mean * (1 - mean) * apart) / max(1 - apart, 1e-6)
    return float(MOST) if sums.c < 2 or v <= 0 else float(min(max(mean * (1 - mean) / v - 1, LEAST), MOST))


def host_reputation(pages: DataFrame, outcomes: DataFrame, min_good: float = MIN_GOOD, z: float = Z, suffixes: tuple[str, ...] | DataFrame = DEEP_SUFFIXES) -> DataFrame:
    """(host, n, good, mean, bound, verdict) of every host of ``pages`` (id, host), from ``outcomes`` (id, good: 0 or 1)."""
    seen = pages.join(outcomes.where("good is not null").select(F.col("id").alias("o_id"), "good"), F.col("id") == F.col("o_id"), "left")
    hosts = written(with_domains(seen.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")), suffixes))
    # All levels hang on the one table of hosts, and their sums come from one job.
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    ends = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    level = lambda df, k: df.where("n > 0").select(F.lit(k).alias("level"), "n", "good")
    square = F.sum(F.col("good") * F.col("good") / F.col("n")).alias("square")
    found = level(ends, 1).union(level(domains, 2)).union(level(hosts, 3)).groupBy("level").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.sum("good").alias("good"), square).collect()
    sums = {r.level: r for r in found}
    w1, w2, w3 = (_strength(sums.get(k)) for k in (1, 2, 3))
    good, n = (sums[3].good, sums[3].n) if 3 in sums else (0, 0)
    shrunk = lambda mean, weight: (F.lit(weight) * mean + F.col("good")) / (F.lit(weight) + F.col("n"))
    s = ends.select("suffix", shrunk(F.lit((good + 1) / (n + 2)), w1).alias("mean1"))
    d = domains.join(s, "suffix").select("domain", "suffix", shrunk(F.col("mean1"), w2).alias("mean2"))
    h = hosts.join(d, ["domain", "suffix"])
    a = w3 * F.col("mean2") + F.col("good")
    total = w3 + F.col("n")
    h = h.select("host", "n", "good", (a / total).alias("mean"), F.sqrt(a * (total - a) / (total * total * (total + 1))).alias("sd"))
    return h.select("host", "n", "good", "mean", (F.col("mean") + z * F.col("sd")).alias("bound")).withColumn("verdict", F.when(F.col("bound") < min_good, "block").otherwise("allow"))


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url", rules: dict[str, str] | DataFrame | None = None, min_good: float = MIN_GOOD, z: float = Z,
    suffixes: tuple[str, ...] | DataFrame = DEEP_SUFFIXES,
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, bound (null where a rule decides)."""
    rules = RULES if rules is None else rules
    rows = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    hosts = host_reputation(rows.select(F.col("page_id").alias("id"), "host"), outcomes, min_good, z, suffixes)
    if isinstance(rules, dict):
        ruled = rows.withColumn("rule", best_rule(F.col("host"), F.col("path"), rules))
        by_rule = F.try_element_at(F.create_map(*(F.lit(x) for kv in rules.items() for x in kv)), F.col("rule")) if rules else F.lit(None).cast("string")
        ruled = ruled.withColumn("by_rule", by_rule)
    else:
        ruled = rows.join(rules_by_join(rows, rules), ["host", "path"], "left")
    judged = ruled.join(hosts.select("host", "verdict", "bound"), "host", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "verdict").alias("verdict"), F.when(F.col("rule").isNull(), F.col("bound")).alias("bound"))


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    """Contract query: verdict of every page; a labelled page is good if its quality is 1 and it is not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.select(F.col("doc_id").alias("id"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0).alias("good"))
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), outcomes).drop("bound")


OP6_SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (SELECT doc_id AS id, CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS good FROM labels),
h0 AS (SELECT host, count(o.good) AS n, coalesce(sum(o.good), 0) AS good, array_to_string(string_split(host, '.')[-2:], '.') IN ('co.uk', 'org.uk', 'com.au', 'co.jp', 'com.br', 'co.nz') AS deep
  FROM p LEFT JOIN o ON o.id = p.page_id GROUP BY host),
h AS (SELECT host, n, good, CASE WHEN deep THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE string_split(host, '.')[-1] END AS suffix,
  CASE WHEN deep THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain FROM h0),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),
m AS (SELECT 'w1' AS w, n, good FROM s UNION ALL SELECT 'w2', n, good FROM d UNION ALL SELECT 'w3', n, good FROM h),
q AS (SELECT w, sum(n)::DOUBLE AS n, sum(good)::DOUBLE / sum(n) AS mean, count(*)::DOUBLE AS c, sum(n * (good::DOUBLE / n) * (good::DOUBLE / n)) / sum(n) AS s FROM m WHERE n > 0 GROUP BY w),
v AS (SELECT w, mean, c, ((s - mean * mean) - mean * (1 - mean) * (c - 1) / n) / greatest(1 - (c - 1) / n, 1e-6::DOUBLE) AS v FROM q),
k AS (SELECT w, CASE WHEN c < 2 OR v <= 0 THEN 1000.0::DOUBLE ELSE least(greatest(mean * (1 - mean) / v - 1, 2.0::DOUBLE), 1000.0::DOUBLE) END AS worth FROM v),
a AS (SELECT (sum(good) + 1)::DOUBLE / (sum(n) + 2) AS mean0, (SELECT worth FROM k WHERE w = 'w1') AS w1, (SELECT worth FROM k WHERE w = 'w2') AS w2, (SELECT worth FROM k WHERE w = 'w3') AS w3 FROM s),
s1 AS (SELECT suffix, (w1 * mean0 + good) / (w1 + n) AS mean1, w2, w3 FROM s, a),
d1 AS (SELECT domain, suffix, (w2 * mean1 + good) / (w2 + n) AS mean2, w3 FROM d JOIN s1 USING (suffix)),
h1 AS (SELECT host, w3 * mean2 + good AS a, w3 + n AS t FROM h JOIN d1 USING (domain, suffix)),
h2 AS (SELECT host, CASE WHEN a / t + 1.64::DOUBLE * sqrt(a * (t - a) / (t * t * (t + 1))) < 0.5::DOUBLE THEN 'block' ELSE 'allow' END AS verdict FROM h1),
r(rhost, rpath, rule, act) AS (VALUES ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'),
  ('www.example.com', '/en/', 'www.example.com/en/', 'allow'), ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')),
u AS (SELECT DISTINCT host, path FROM p),
b AS (SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(act, length(rule)) AS act FROM u JOIN r
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.act, h2.verdict) AS verdict
FROM p LEFT JOIN b ON p.host = b.host AND p.path = b.path LEFT JOIN h2 ON p.host = h2.host
"""
