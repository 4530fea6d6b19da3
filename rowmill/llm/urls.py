"""URL filters: block and allow rules, and else an empirical-Bayes reputation of the host. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from rowmill.llm.staging import stage

#: Keys that hold more than this share of the rows (1 / FREQUENT, so fewer than FREQUENT keys) are joined by broadcast.
FREQUENT = 1024
#: Bounds of the correlation of outcomes under one parent, and the one assumed where no parent has two children.
LEAST_RHO, MOST_RHO, USUAL_RHO = 1e-4, 0.5, 0.05
#: Some public suffixes of two labels.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn",
                      "com.tr", "com.mx", "co.in", "co.kr", "co.za")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path of an address; both empty for a null or one without ``://``."""
    def part(n):
        return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit(""))

    host = part(1)
    low = F.when(F.length(host) == F.octet_length(host), F.lower(host)).otherwise(F.translate(host, string.ascii_uppercase, string.ascii_lowercase))
    return low, part(2)


def site(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port; an address of numbers is its own domain, under the suffix ``#``."""
    name = F.regexp_replace(host, r"(?s)^.*@|:[0-9]*$", "")
    numbers = name.rlike(r"^[0-9.]+$") | name.startswith("[")
    two = F.substring_index(name, ".", -2)
    long = two.isin(*TWO_LABEL_SUFFIXES)
    domain = F.when(numbers, name).when(long, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, F.when(numbers, F.lit("#")).when(long, two).otherwise(F.substring_index(name, ".", -1))


def _rules_of(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host_key and the rules that fit a host or one that it is a subdomain of, the longest first.

    A host is cut into as many suffixes as the longest rule has labels, and these meet the rules in a join.
    """
    rules = rules.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict"))
    deepest = rules.agg(F.max(F.size(F.split("_host", "\\.")))).first()[0]
    if deepest is None:
        return hosts.limit(0).select("host_key", F.lit(None).cast("array<struct<path: string, rule: string, verdict: string>>").alias("rules"))
    ends = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(deepest)), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k)))
    name = F.concat("_host", "_path")
    fit = hosts.select("host_key", F.explode(ends).alias("_end")).join(rules, F.col("_end") == F.col("_host"))
    rule = F.struct((-F.length(name)).alias("a"), (-F.length("_host")).alias("b"), F.col("_path").alias("path"), name.alias("rule"),
                    F.col("_verdict").alias("verdict"))
    return fit.groupBy("host_key").agg(F.transform(F.array_sort(F.collect_set(rule)), lambda r: F.struct(
        r["path"].alias("path"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))).alias("rules"))


def strength(children: DataFrame, parent: str | None) -> float:
    """How many outcomes the prior of a child is worth: alpha + beta of the beta-binomial, by the method of moments.

    The spread of the children's shares around their parent's share is compared with what chance alone gives, summed
    over all parents; one row of sums comes to the driver.
    """
    seen = children.where("n > 0")
    seen = seen.groupBy(F.col(parent) if parent else F.lit("all"))
    sums = seen.agg(F.sum("n").cast("double").alias("n"), F.sum("k").cast("double").alias("k"), F.count(F.lit(1)).alias("m"),
                    F.sum(F.col("k").cast("double") * F.col("k") / F.col("n")).alias("q"),
                    F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"))
    chance = F.col("k") / F.col("n") * (1 - F.col("k") / F.col("n"))
    row = sums.agg(F.sum(F.col("q") - F.col("k") * F.col("k") / F.col("n") - chance * (F.col("m") - 1)).alias("spread"),
                   F.sum(chance * (F.col("n") - F.col("nn") / F.col("n") - (F.col("m") - 1))).alias("room")).first()
    rho = row["spread"] / row["room"] if row["room"] and row["room"] > 1e-9 else USUAL_RHO
    return 1 / min(max(rho, LEAST_RHO), MOST_RHO) - 1


def _lookup(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join with a table that has every key once and the number of rows of each: frequent keys by broadcast."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * FREQUENT > total
    often = F.broadcast(table.where(heavy))
    rest = rows.join(F.broadcast(table.where(heavy).select(key)), key, "left_anti")
    return rows.join(often, key).unionByName(rest.join(table.where(~heavy), key))


def reputations(urls: DataFrame, outcomes: DataFrame, z: float) -> DataFrame:
    """One row per host: host_key, host, pages, n (labelled pages), k (bad ones), bad_share and bad_bound.

    The share of bad pages of a suffix is shrunk towards that of all pages, a registered domain's towards its
    suffix's, a host's towards its domain's, by the strength of each level. ``bad_bound`` is the lower bound of the
    host's beta posterior: its mean less ``z`` standard deviations, not below 0.
    """
    known = outcomes.where("id is not null and bad is not null").groupBy("id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    labelled = urls.where("id is not null").select("id", "host_key").join(known, "id").groupBy("host_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bad").alias("k"))
    domain, suffix = site(F.col("host"))
    hosts = urls.groupBy("host_key").agg(F.first("host").alias("host"), F.count(F.lit(1)).alias("pages")).join(labelled, "host_key", "left")
    hosts = stage(hosts.select("host_key", "host", "pages", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"),
                               F.md5(domain).alias("domain"), F.md5(suffix).alias("suffix")), "hosts")
    domains = stage(hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.count(F.lit(1)).alias("hosts"),
                                                F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = stage(domains.groupBy("suffix").agg(F.count(F.lit(1)).alias("domains"), F.sum("n").alias("n"), F.sum("k").alias("k")), "suffixes")
    all_n, all_k = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()

    def shrunk(above, worth):
        return (F.col("k") + F.lit(worth) * above) / (F.col("n") + F.lit(worth))

    top = F.lit((all_k + 0.5) / (all_n + 1))
    suffixes = suffixes.select("suffix", "domains", shrunk(top, strength(suffixes, None)).alias("above"))
    domains = _lookup(domains, suffixes, "suffix", "domains").select(
        "domain", "hosts", shrunk(F.col("above"), strength(domains, "suffix")).alias("above"))
    worth = strength(hosts, "domain")
    a = F.col("k") + F.lit(worth) * F.col("above")
    b = F.col("n") - F.col("k") + F.lit(worth) * (1 - F.col("above"))
    found = _lookup(hosts, domains, "domain", "hosts").withColumns({"a": a, "b": b}).withColumn("bad_share", F.col("a") / (F.col("a") + F.col("b")))
    spread = F.sqrt(F.col("bad_share") * (1 - F.col("bad_share")) / (F.col("a") + F.col("b") + 1))
    return found.select("host_key", "host", "pages", "n", "k", "bad_share",
                        F.greatest(F.col("bad_share") - F.lit(z) * spread, F.lit(0.0)).alias("bad_bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               most_bad: float = 0.3, z: float = 1.2816) -> DataFrame:
    """Columns id, host, path, rule, verdict, n_labelled, bad_share, bad_bound of every row.

    ``rules`` has host, path and verdict (allow or block): a rule fits its host and all subdomains where the path
    begins with the rule's; the longest wins (of equal lengths the one of the longer host). Where none fits, a page is
    blocked if at least ``most_bad`` of its host's pages are bad with the confidence of ``z`` (90 %), by the posterior
    of ``reputations``. ``outcomes`` has id and bad (boolean) of labelled pages; an id with several is bad if one is.

    Counts are added up per host before they are shuffled; a host or domain that holds many rows is joined by
    broadcast, of which there can be fewer than FREQUENT. A null url, or one without ``://``, has an empty host and
    path, which are judged like others. A null id has no outcome; rows that repeat an id or are equal are pages of
    their own. Without outcomes, shares are one half, and their bound is what the prior's strength makes of it. Rules
    with a null fit nothing. Empty tables give empty results. Columns of the tables beside those named have no effect.
    """
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("host_key", F.md5("host"))
    known = stage(reputations(urls, outcomes.select("id", "bad"), z), "reputations")
    known = stage(known.join(_rules_of(known, rules), "host_key", "left").withColumnRenamed("host", "_host"), "judged")
    out = _lookup(urls, known, "host_key", "pages")
    found = F.get(F.filter(F.coalesce("rules", F.array().cast("array<struct<path: string, rule: string, verdict: string>>")),
                           lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    out = out.withColumn("found", found)
    own = F.when(F.col("bad_bound") >= most_bad, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"),
                      F.col("n").alias("n_labelled"), "bad_share", "bad_bound")
