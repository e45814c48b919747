"""URL verdicts: explicit rules, else empirical-Bayes host reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize

#: (verdict, host, path prefix)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A public suffix is the last label; before a country's (two letters) it includes a label of this list.
GENERIC = "ac co com edu gen go gob gouv gov gv id info int ltd me mil mod muni ne net nhs nic nom or org plc police sch web".split()
_TWO = r"^(" + "|".join(GENERIC) + r")\.[a-z][a-z]$"
#: A host is blocked if the share of bad pages is above MAX_BAD with this probability; the posterior is summed at so many places.
SURE = 0.95
MAX_BAD = 0.5
PLACES = 512
MIN_STRENGTH, MAX_STRENGTH = 1, 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From after the first :// to the next /, ? or #, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain, and a path that starts with its path."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column) -> Column:
    """Registered domain: the suffix and one label more; the host itself if it has no more labels."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.rlike(_TWO), F.substring_index(host, ".", -3)).otherwise(two)


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.rlike(_TWO), two).otherwise(F.substring_index(host, ".", -1))


def strength(groups: DataFrame, rate: float) -> int:
    """Prior strength of a level by the method of moments: how many pages a prior is worth, from how groups vary around the rate."""
    r = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum((F.col("bad") - F.col("n") * rate) * (F.col("bad") - F.col("n") * rate) / F.col("n")).alias("q"), F.count("*").alias("g")).first()
    if not r["g"] or r["g"] < 2 or not 0 < rate < 1:
        return MAX_STRENGTH
    spread = (r["q"] / (rate * (1 - rate)) - (r["g"] - 1)) / max(r["n"] - r["n2"] / r["n"], 1.0)
    return MAX_STRENGTH if spread <= 0 else int(min(MAX_STRENGTH, max(MIN_STRENGTH, round(1 / min(spread, 1.0) - 1))))


def reputations(outcomes: DataFrame) -> DataFrame:
    """Per host of (host, n labelled pages, bad pages): alpha and beta of the posterior share of bad pages.

    A beta-binomial prior passes from all pages to the suffix, to the registered
    domain, to the host; each level's strength comes from the data.
    """
    hosts = outcomes.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = total["bad"] / total["n"] if total["n"] else 0.0
    k = [strength(level.filter("n > 0"), rate) for level in (suffixes, domains, hosts)]
    by_suffix = suffixes.select("suffix", ((F.col("bad") + k[0] * F.lit(rate)) / (F.col("n") + k[0])).alias("suffix_rate"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", ((F.col("bad") + k[1] * F.col("suffix_rate")) / (F.col("n") + k[1])).alias("domain_rate"))
    return hosts.join(by_domain, "domain").select(
        "host", (F.col("bad") + k[2] * F.col("domain_rate")).alias("alpha"), (F.col("n") - F.col("bad") + k[2] * (1 - F.col("domain_rate"))).alias("beta")
    )


def bad_chance(limit: float = MAX_BAD) -> Column:
    """The posterior's probability that the share of bad pages is above limit, from the density of Beta(alpha, beta) at PLACES midpoints.

    Densities are relative to that at the mean, which keeps them in range.
    """
    a, b = F.col("alpha"), F.col("beta")
    mean = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), a / (a + b)))
    places = F.array(*[F.lit((k + 0.5) / PLACES) for k in range(PLACES)])
    density = lambda x: F.exp((a - 1) * (F.ln(x) - F.ln(mean)) + (b - 1) * (F.ln(1 - x) - F.ln(1 - mean)))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + density(x))
    return total(F.filter(places, lambda x: x > limit)) / total(places)


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block), bad_chance.

    outcomes has (page_id, bad 0 or 1) of labelled pages; rows with a null in
    either are no outcomes, and a page labelled more than once counts each time.
    Without a fitting rule a page is blocked if its host's posterior share of
    bad pages is above MAX_BAD with a probability of SURE, that is if its lower
    credible bound is; hosts without labelled pages have their domain's prior. Null urls and urls without :// have an empty host
    and path, and the reputation of the empty host. Null ids, repeated rows and
    empty tables keep their rows; extra columns are ignored.
    """
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = outcomes.select(F.col("page_id").alias("labelled"), F.col("bad").cast("long").alias("bad")).dropna()
    labelled = parsed.select("page_id", "host").join(known, F.col("page_id") == F.col("labelled"), "left")
    counts = materialize(labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "hosts")
    bounds = materialize(reputations(counts).select("host", bad_chance().alias("bad_chance")), "bounds")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parsed.join(bounds, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad_chance") > SURE, "block").otherwise("allow")).alias("verdict"), "bad_chance"
    )


ORACLE_SQL = r"""
WITH parsed AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
hosts0 AS (
  SELECT host, count(quality) AS n, coalesce(sum(CASE WHEN quality = 0 THEN 1 WHEN quality = 1 THEN 0 END), 0) AS bad
  FROM parsed LEFT JOIN (SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL) l ON page_id = doc_id GROUP BY host),
hosts AS (
  SELECT *, string_split(host, '.') AS parts,
         array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS two
  FROM hosts0),
named AS (
  SELECT host, n, bad,
         CASE WHEN regexp_matches(two, '{two}') THEN array_to_string(list_slice(parts, -3, -1), '.') ELSE two END AS domain,
         CASE WHEN regexp_matches(two, '{two}') THEN two ELSE parts[-1] END AS suffix
  FROM hosts),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
total AS (SELECT CASE WHEN sum(n) > 0 THEN sum(bad)::DOUBLE / sum(n)::DOUBLE ELSE 0 END AS rate FROM suffixes),
level AS (
  SELECT 0 AS l, n, bad FROM suffixes WHERE n > 0 UNION ALL
  SELECT 1, n, bad FROM domains WHERE n > 0 UNION ALL
  SELECT 2, n, bad FROM named WHERE n > 0),
sums AS (
  SELECT l, any_value(rate) AS rate, sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS n2, count(*) AS g,
         sum((bad - n * rate) * (bad - n * rate) / n) AS q
  FROM level, total GROUP BY l),
spreads AS (
  SELECT l, g, rate, CASE WHEN g >= 2 AND rate > 0 AND rate < 1 THEN (q / (rate * (1 - rate)) - (g - 1)) / greatest(n - n2 / n, 1.0) ELSE 0 END AS spread FROM sums),
strengths AS (
  SELECT l, CASE WHEN spread <= 0 THEN {max} ELSE least({max}, greatest({min}, round_even(1 / least(spread, 1.0) - 1, 0))) END AS k FROM spreads),
k AS (SELECT coalesce(max(k) FILTER (l = 0), {max}) AS k0, coalesce(max(k) FILTER (l = 1), {max}) AS k1, coalesce(max(k) FILTER (l = 2), {max}) AS k2 FROM strengths),
s AS (SELECT suffix, (bad + k0 * rate) / (n + k0) AS r FROM suffixes, k, total),
d AS (SELECT domain, (bad + k1 * r) / (n + k1) AS r FROM domains JOIN s USING (suffix), k),
post AS (SELECT host, bad + k2 * r AS a, n - bad + k2 * (1 - r) AS b FROM named JOIN d USING (domain), k),
places AS (SELECT (k + 0.5::DOUBLE) / {places} AS x FROM range({places}) r(k)),
means AS (SELECT host, a, b, greatest(1e-9, least(1 - 1e-9, a / (a + b))) AS m FROM post),
densities AS (SELECT host, x, exp((a - 1) * (ln(x) - ln(m)) + (b - 1) * (ln(1 - x) - ln(1 - m))) AS d FROM means, places),
bounds AS (SELECT host, coalesce(sum(d) FILTER (x > {bad}), 0) / sum(d) AS bad_chance FROM densities GROUP BY host),
ruled AS (SELECT page_id, host, path, bad_chance, {rule} AS rule FROM parsed JOIN bounds USING (host))
SELECT page_id, host, path, rule,
       CASE {verdicts} ELSE CASE WHEN bad_chance > {sure} THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled
"""


def oracle_sql(rules=RULES) -> str:
    longest = sorted(rules, key=lambda r: (len(r[1] + r[2]), r), reverse=True)
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in longest)
    return ORACLE_SQL.format(
        two=_TWO, max=MAX_STRENGTH, min=MIN_STRENGTH, places=PLACES, sure=SURE, bad=MAX_BAD,
        rule=f"CASE {cases} ELSE NULL END", verdicts=" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in rules),
    )
