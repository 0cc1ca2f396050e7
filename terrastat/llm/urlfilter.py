"""URL filters: fixed rules first, then empirical-Bayes host reputation, in
DataFrame operations only.

Reputation: the share of bad outcomes among labelled pages, by host, shrunk in
steps through beta-binomial priors: the suffix towards all pages, the registered
domain towards its suffix, the host towards its domain. A level's prior strength
``s`` is its concentration by moments: with binomial outcomes, the variance
between members that sampling does not explain (pooled over the level) gives
``s = m(1-m)/var - 1``, held to ``[1, 10 000]``. A member's posterior mean is
``(bad + s * parent) / (n + s)``, and the host's verdict is ``block`` when the
lower posterior bound ``mean - z * sd`` reaches ``max_bad``.

Counts are aggregated by host first (combined before the shuffle), so a host
with most pages is one row afterwards; the page table is only joined back with
a frame of one row a host.

Defined cases: a null url or one without ``://`` has empty host and path and
no rule; it belongs to the empty host. The suffix is the host's last label,
or two when among ``suffixes``; the registered domain has one label more. A
null outcome is unlabelled; an unlabelled host takes its parents' means. With no
labels at all nothing is blocked by reputation. Repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The contract's rules (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# Common two-label public suffixes.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz",
            "co.jp", "ne.jp", "or.jp", "com.br", "com.mx", "com.ar", "co.in", "co.za", "com.cn")
MAX_BAD = 0.5
Z = 1.64
STRENGTH = (1.0, 10_000.0)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path), both empty for a null url or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(
        url, F.instr(url, "://") + F.lit(3), F.char_length(url)))
    host = lower_ascii(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def domains(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; a host of one label is both.
    ``suffixes`` lists the public suffixes of two labels."""
    two = F.substring_index(host, ".", -2)
    listed = two.isin(*suffixes)
    return (F.when(listed, F.substring_index(host, ".", -3)).otherwise(two),
            F.when(listed, two).otherwise(F.substring_index(host, ".", -1)))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == F.lit(h)) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
                      ).otherwise(best)
    return best


def _level(members: DataFrame, key: str, parent: str | None) -> tuple[DataFrame, DataFrame]:
    """(members with their prior strength ``s``, counts of the parent level)."""
    m = F.sum("bad") / F.sum("n")
    # method of moments over members with labels: between-member variance left
    # after sampling noise, pooled with weights n
    stats = members.where("n > 0").agg(
        m.alias("m"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n"), F.lit(2.0))).alias("q"),
        F.sum(F.pow(F.col("n").cast("double"), F.lit(2.0))).alias("nn"))
    noise = F.col("m") * (1 - F.col("m"))
    free = F.col("n") - F.col("nn") / F.col("n")
    between = ((F.col("q") - F.col("n") * F.pow("m", F.lit(2.0)))
               - (F.col("k") - 1) * noise) / free
    s = F.when((noise > 0) & (free > 0) & (between > 0), F.least(F.greatest(
        noise / between - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))).otherwise(F.lit(STRENGTH[1]))
    strength = stats.select(F.coalesce(s, F.lit(STRENGTH[1])).alias("s")).scalar()
    up = None if parent is None else members.groupBy(parent).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    return members.withColumn(f"s_{key}", strength), up


def reputation(pages: DataFrame, bad: Column, *, host_col: str = "host",
               max_bad: float = MAX_BAD, z: float = Z,
               suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """One row a host: host, n, bad, mean (posterior), bound (lower), blocked. The
    bound is a normal approximation: with one or two outcomes it is wide and rough,
    and the prior decides."""
    domain, suffix = domains(F.col("host"), suffixes)
    hosts = (pages.groupBy(F.col(host_col).alias("host"))
             .agg(F.count(bad).alias("n"), F.coalesce(F.sum(bad.cast("bigint")), F.lit(0))
                  .alias("bad"))
             .withColumn("domain", domain).withColumn("suffix", suffix))
    by_host, _ = _level(hosts, "h", None)
    d = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("d_n"), F.sum("bad").alias("d_bad"))
    by_domain, _ = _level(d.select(F.col("domain"), F.col("suffix"), F.col("d_n").alias("n"),
                                   F.col("d_bad").alias("bad")), "d", None)
    sfx = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix, _ = _level(sfx, "x", None)
    everything = hosts.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0))
                           ).scalar()
    top = by_suffix.select(F.col("suffix").alias("x_suffix"), (
        (F.col("bad") + F.col("s_x") * everything) / (F.col("n") + F.col("s_x"))).alias("x_mean"))
    mid = (by_domain.join(top, F.col("suffix") == F.col("x_suffix"))
           .select(F.col("domain").alias("d_domain"), (
               (F.col("bad") + F.col("s_d") * F.col("x_mean")) / (F.col("n") + F.col("s_d"))
               ).alias("d_mean")))
    total = F.col("n") + F.col("s_h")
    mean = (F.col("bad") + F.col("s_h") * F.col("d_mean")) / total
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1))
    return (by_host.join(mid, F.col("domain") == F.col("d_domain"))
            .withColumn("mean", mean)
            .withColumn("bound", F.greatest(F.lit(0.0), F.col("mean") - F.lit(z) * sd))
            .select("host", "domain", "suffix", "n", "bad", "mean", "bound",
                    (F.col("bound") >= F.lit(max_bad)).alias("blocked")))


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
                bad: Column | None = None, rules=RULES, max_bad: float = MAX_BAD,
                z: float = Z, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's posterior (mean, bound).
    ``suffixes``: the public suffixes of two labels to go by, such as the whole
    public list; the default holds common ones."""
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"),
                        (F.lit(None).cast("boolean") if bad is None else bad).alias("bad"))
    seen = reputation(rows, F.col("bad"), max_bad=max_bad, z=z, suffixes=suffixes).select(
        F.col("host").alias("r_host"), "mean", "bound", "blocked")
    return (rows.withColumn("found", matched_rule(F.col("host"), F.col("path"), rules))
            .join(seen, F.col("host") == F.col("r_host"))
            .select("page_id", "host", "path", F.col("found.rule").alias("rule"),
                    F.coalesce("found.verdict", F.when(F.col("blocked"), F.lit("block"))
                               .otherwise(F.lit("allow"))).alias("verdict"),
                    "mean", "bound"))
