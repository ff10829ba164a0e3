"""URL filters: empirical-Bayes host reputation behind longest-match allow and block rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored

#: Below a country code (a last label of two letters) these labels are part of the suffix, as in co.uk.
SECOND_LEVELS = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "go", "mil", "ne", "net", "nom", "or", "org", "sch")
#: Hosts that are addresses have no domain.
ADDRESS = r"^([0-9]+\.){3}[0-9]+$|^\["


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def site(name: Column) -> Column:
    """A host without user information and port."""
    return F.regexp_replace(F.regexp_replace(name, r"^(?s:.*)@", ""), r":[0-9]*$", "")


def suffix(name: Column) -> Column:
    """Of a site: the last label, or the last two where SECOND_LEVELS says so. An address of numbers is its own suffix."""
    parts = F.split(name, r"\.")
    last, second = F.element_at(parts, -1), F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))
    two = (F.length(last) == 2) & second.isin(*SECOND_LEVELS) & (F.size(parts) > 1)
    return F.when(name.rlike(ADDRESS), name).when(two, F.concat(second, F.lit("."), last)).otherwise(last)


def domain(name: Column) -> Column:
    """Of a site: its registered domain, which is the suffix and one label more, or the whole where there is none."""
    parts, own = F.split(name, r"\."), suffix(name)
    keep = F.size(F.split(own, r"\.")) + 1
    return F.when(name.rlike(ADDRESS) | (F.size(parts) <= keep), name).otherwise(F.array_join(F.slice(parts, F.size(parts) - keep + 1, keep), "."))


def _strength(stats: DataFrame, least: float, most: float) -> float:
    """The strength of a level's prior, by moments.

    With p the prior mean and n a key's labelled pages, the beta-binomial gives E[(k - n p)^2] = n p (1 - p) (1 + (n - 1)
    rho); summed over keys this is solved for rho, and the strength is 1 / rho - 1, held between least and most.
    """
    gap = F.sum(F.pow(F.col("k") - F.col("n") * F.col("prior"), 2) - F.col("n") * F.col("prior") * (1 - F.col("prior")))
    room = F.sum(F.col("n") * (F.col("n") - 1) * F.col("prior") * (1 - F.col("prior")))
    got = stats.agg(gap.alias("gap"), room.alias("room")).first()
    if not got.room or got.room <= 0 or got.gap / got.room <= 1 / (most + 1):
        return most
    return max(least, got.room / got.gap - 1)


def _level(stats: DataFrame, key: str, least: float, most: float) -> DataFrame:
    """Posterior (alpha, beta) of each key, from the prior that its parent's posterior mean centres."""
    m, prior = _strength(stats, least, most), F.col("prior")
    return stats.select(key, (prior * m + F.col("k")).alias("alpha"), ((1 - prior) * m + F.col("n") - F.col("k")).alias("beta"))


def reputation(votes: DataFrame, least: float = 2.0, most: float = 1000.0) -> tuple[DataFrame, float]:
    """((host, alpha, beta) for every host of votes(host, good 0/1 or null), the share of good pages in all).

    A row is a page; its outcome is null where it has none. Without any outcome every mean is 1/2. Counts go up the
    levels as sums of sums, so a host with a third of all pages is one row after the partial aggregation. The driver
    gets one row of sums a level.
    """
    hosts = votes.groupBy("host").agg(F.count("good").cast("double").alias("n"), F.coalesce(F.sum(F.col("good").cast("double")), F.lit(0.0)).alias("k"))
    hosts = hosts.withColumn("site", site(F.col("host")))
    hosts = stored(hosts.select("host", domain(F.col("site")).alias("domain"), suffix(F.col("site")).alias("suffix"), "n", "k"), "hosts")
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = suffixes.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    share = ((whole.k or 0.0) + 0.5) / ((whole.n or 0.0) + 1)
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    at_suffix = _level(suffixes.withColumn("prior", F.lit(share)), "suffix", least, most)
    at_domain = _level(domains.join(at_suffix.select("suffix", mean.alias("prior")), "suffix"), "domain", least, most)
    known = _level(hosts.join(at_domain.select("domain", mean.alias("prior")), "domain"), "host", least, most)
    return known, share


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], outcomes: DataFrame | None = None, floor: float | None = None, z: float = 1.645) -> DataFrame:
    """Each row of pages(page_id, url) with host, path, rule, verdict, the host's posterior mean and upper bound, and floor.

    rules are (action, "host/path"); a rule fits its host and all subdomains if the path starts with the rule's, and
    the longest rule that fits decides. Elsewhere the host's posterior does: block if even its upper bound (mean and z
    standard deviations, at most 1) is below floor.

    A page's outcome is that of outcomes(page_id, good 0/1): a page with several counts once, good if their mean is 1/2
    or more; null ids and null outcomes are left out. Without that table the rules label the pages that they fit: good
    if allowed. floor is the share of good pages in all unless it is given, so a host goes if it is worse than the
    corpus with some certainty. Rows repeat as they do in pages; other columns of pages are left out. An empty or null
    url has host and path "", and is judged as the host "".
    """
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name in sorted(rules, key=lambda r: len(r[1])):
        at, _, rest = name.partition("/")
        fits = ((F.col("host") == at) | F.col("host").endswith("." + at)) & F.col("path").startswith("/" + rest)
        rule, action = F.when(fits, name).otherwise(rule), F.when(fits, what).otherwise(action)
    out = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    out = out.withColumn("rule", rule).withColumn("action", action)
    if outcomes is None:
        votes = out.select("host", (F.col("action") == "allow").cast("double").alias("good"))
    else:
        given = outcomes.filter("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg((F.avg("good") >= 0.5).cast("double").alias("good"))
        votes = out.select("page_id", "host").join(given, "page_id", "left").select("host", "good")
    known, share = reputation(votes)
    least = share if floor is None else floor
    n = F.col("alpha") + F.col("beta")
    mean = F.col("alpha") / n
    known = known.select("host", mean.alias("mean"), F.least(F.lit(1.0), mean + z * F.sqrt(mean * (1 - mean) / (n + 1))).alias("upper"))
    verdict = F.coalesce("action", F.when(F.col("upper") < least, "block").otherwise("allow"))
    return out.join(known, "host").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mean", "upper", F.lit(least).alias("floor"))
