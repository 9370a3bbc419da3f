"""URL filters by host reputation, shrunk from host to registered domain to suffix.

Rules decide first. Other urls are judged by an empirical-Bayes estimate of how often pages of their host are good: labelled outcomes
of a host are shrunk towards its registered domain, those of a domain towards its suffix, those of a suffix towards all. The strength
of each prior is the beta-binomial's, by moments over all groups of that level. A url is allowed if the lower bound of its host's
posterior is high enough. A host without labels gets the mean of its domain or suffix, and a variance that adds up on the way down:
that of the level's own posterior, then that of each lower level's prior, so that a domain of hosts that differ says little about a new one.

Reputation goes by site: the host without user, port and trailing dots. A suffix is the last label, or the last two where a
country's label follows one of `SECOND_LEVEL`, as in co.uk, or where `suffixes` names them; a registered domain has one label more. An
address (digits and dots, or brackets) is a site and domain of its own, its suffix is "address".

Edge cases: a null url or one without ``://`` has empty host and path and is judged by the prior over all unless empty hosts have labels.
Page ids may repeat or be null; each row gets its own row. Urls of any length are taken whole. Without any labels every host has the
mean 0.5 of a flat prior. Null outcomes don't count. Of rules of equal length that fit, one that blocks wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = ("suffix", "domain", "host")
# Labels under which countries register domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "gv", "ltd", "mil", "ne", "net", "nhs", "nic", "nom", "or", "org", "plc", "sch")
USER, PORT, DOTS, ADDRESS = "^.*@", ":[0-9]*$", "[.]+$", r"^([0-9]+([.][0-9]+)*|\[.*)$"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of the rules (verdict, host/path) that fits, as a struct (rule, verdict); null if none does. Block wins a tie."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ranked = sorted(((r.partition("/")[0].translate(str.maketrans(UPPER, LOWER)), "/" + r.partition("/")[2], r, v) for v, r in rules), key=lambda x: (-len(x[2]), x[3] != "block", x[2]))
    known = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for h, p, r, v in ranked])
    fits = F.filter(known, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    first = F.get(fits, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))


def levels_of(host: Column, suffixes: Sequence[str] = ()) -> dict[str, Column]:
    """The site, registered domain and suffix of a host, by level."""
    site = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, USER, ""), PORT, ""), DOTS, "")
    labels = F.split(site, "[.]")
    country = (F.char_length(F.substring_index(site, ".", -1)) == 2) & F.get(labels, F.size(labels) - 2).isin(*SECOND_LEVEL)
    two = F.coalesce(country | F.substring_index(site, ".", -2).isin(*suffixes), F.lit(False))
    address = F.rlike(site, F.lit(ADDRESS))
    last = lambda n: F.when(two, F.substring_index(site, ".", -n - 1)).otherwise(F.substring_index(site, ".", -n))
    return {"host": site, "domain": F.when(address, site).otherwise(last(2)), "suffix": F.when(address, "address").otherwise(last(1))}


def strength(groups: DataFrame, prior: str) -> float:
    """The weight of the prior in observations, from the spread of the groups' rates about it; between 1 and 1000."""
    rate = F.col("good") / F.col("n")
    sums = groups.where("n > 0").agg(
        F.count("*").alias("k"), F.sum("n").alias("all_n"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * (rate - F.col(prior)) * (rate - F.col(prior))).alias("s"), F.sum(F.col("n") * F.col(prior) * (1 - F.col(prior))).alias("pq"),
    )
    v = F.col("pq") / F.col("all_n")
    left = F.col("all_n") - F.col("nn") / F.col("all_n") - F.col("k") + 1
    rho = (F.col("s") - v * (F.col("k") - 1)) / (v * left)
    found = F.when((v > 0) & (left > 0) & (rho > 0), F.least(F.greatest(1 / rho - 1, F.lit(1.0)), F.lit(1000.0))).otherwise(1000.0)
    return sums.select(F.when(F.col("k") > 1, found).otherwise(1.0).alias("m")).first()["m"]


def reputation(outcomes: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    """From labelled outcomes (host, good boolean) a row for each site, domain and suffix and one for all: level, key, n, good, m, alpha, beta, sure.

    alpha and beta are the posterior's; sure is 1 less the share of mean * (1 - mean) that is the variance of a host of that level's rate.
    Counts are summed before the shuffle. The strengths are single rows; tables of a level are joined by its key.
    """
    counted = outcomes.where(F.col("good").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"))
    names = levels_of(F.col("host"), suffixes)
    hosts = counted.select("n", "good", *[names[x].alias(x) for x in LEVELS]).groupBy(*LEVELS).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    hosts = keep(hosts, "hosts")
    n, good = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    p_all = (good + 1) / (n + 2)
    tables, strengths, above = [], [], None
    for i, level in enumerate(LEVELS):
        keys = list(LEVELS[: i + 1])
        groups = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        groups = keep(groups.join(above, keys[:-1]) if i else groups.withColumn("prior", F.lit(p_all)), level)
        strengths.append(strength(groups, "prior"))
        m = F.lit(strengths[-1])
        a, b = F.col("good") + m * F.col("prior"), F.col("n") - F.col("good") + m * (1 - F.col("prior"))
        shrunk = groups.select(*keys, "n", "good", m.alias("m"), a.alias("alpha"), b.alias("beta"))
        above = shrunk.select(*keys, (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("prior"))
        tables.append(shrunk.select(F.lit(level).alias("level"), F.col(level).alias("key"), "n", "good", "m", "alpha", "beta"))
    flat = hosts.sparkSession.createDataFrame([("all", "", n, good, 2.0, good + 1.0, n - good + 1.0)], "level string, key string, n long, good long, m double, alpha double, beta double")
    out, below = None, 1.0
    for table, m in zip([*reversed(tables), flat], [*reversed(strengths), 0.0]):
        weight = F.col("alpha") + F.col("beta")
        rows = table.withColumn("sure", weight / (weight + 1) * F.lit(below))
        out = rows if out is None else out.unionByName(rows)
        below *= m / (m + 1)
    return keep(out, "reputation")


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), least: float = 0.5, z: float = 1.645, url: str = "url", suffixes: Sequence[str] = ()) -> DataFrame:
    """Adds host, path, rule, verdict, level, mean and bound to pages; columns of these names are replaced, and those
    used inside (_fits, _all, _host, _domain, _suffix and the same with _key) dropped.

    outcomes: rows (host, good). least: the share of good pages that a host must have at the lower bound, z standard deviations below
    the mean. Rows are looked up by site, else by domain, else by suffix, else take the prior over all; a level of one more join each,
    which Spark broadcasts if the table is small and otherwise splits where a host is frequent.
    """
    table = reputation(outcomes, suffixes)
    added = ("host", "path", "rule", "verdict", "level", "mean", "bound")
    inside = ("_fits", "_all", *[f"_{x}" for x in LEVELS], *[f"_{x}_key" for x in LEVELS])
    found = pages.drop(*added, *inside).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    found = found.withColumns({"_fits": rule_for(F.col("host"), F.col("path"), rules)} | {f"_{x}_key": c for x, c in levels_of(F.col("host"), suffixes).items()})
    for level in LEVELS:
        posterior = table.where(F.col("level") == level).select(F.col("key").alias(f"_{level}_key"), F.struct("level", "alpha", "beta", "sure").alias(f"_{level}"))
        found = found.join(posterior, f"_{level}_key", "left")
    flat = table.where("level = 'all'").select("level", "alpha", "beta", "sure").first()
    found = found.withColumn("_all", F.struct(*[F.lit(v).alias(k) for k, v in flat.asDict().items()]))
    best = F.coalesce(F.col("_host"), F.col("_domain"), F.col("_suffix"), F.col("_all"))
    mean = best["alpha"] / (best["alpha"] + best["beta"])
    bound = mean - F.lit(z) * F.sqrt(mean * (1 - mean) * (1 - best["sure"]))
    found = found.withColumns({"level": best["level"], "mean": mean, "bound": bound})
    found = found.withColumns({"rule": F.col("_fits")["rule"], "verdict": F.coalesce(F.col("_fits")["verdict"], F.when(F.col("bound") >= least, "allow").otherwise("block"))})
    return found.drop(*inside)
