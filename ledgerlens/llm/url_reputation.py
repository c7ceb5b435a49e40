"""URL filter: rules first, then empirical-Bayes host reputation.

Labelled page outcomes (0/1) are counted per host and shrunk level by level
through beta-binomial priors: suffix towards the whole corpus, registered domain
towards its suffix, host towards its domain. Each level's prior strength is the
moment (ANOVA) estimate of the intra-class correlation over all groups of that
level. A host is blocked when the upper bound of its posterior mean (mean plus
``z`` standard deviations) lies below ``min_quality``.

Defined cases: a null url, or one without ``://``, has empty host and path and
shares the reputation of the empty host; a host without labels takes its
domain's posterior; repeated pages count once per row; repeated labels take
their majority; with no labels at all nothing is blocked. Numeric hosts (IPv4)
are their own domain. Extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, majority_labels, written

#: Suffixes of two labels under which names are registered; every other suffix is the last label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
Z = 1.645
MIN_QUALITY = 0.7
MAX_STRENGTH = 1000.0
MIN_STRENGTH = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = ascii_lower(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def registered_domain(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host, ports left out."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    wide = two.isin(*TWO_LABEL_SUFFIXES)
    numeric = name.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    suffix = F.when(numeric, F.lit("#ip")).when(wide, two).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(numeric, name).when(wide, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, suffix


def rule_column(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. ``rules`` are
    (verdict, host, path); of equally long ones the longer host wins, then ``block``."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    picked = None
    for verdict, rule_host, rule_path in order:
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        picked = F.when(fits, value) if picked is None else picked.when(fits, value)
    return picked if picked is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strength(children: DataFrame, parent: str) -> Column | float:
    """Prior strength of one level: children (n, s) under their parents; one row to the driver."""
    kids = children.where("n > 0").withColumn("p", F.col("s") / F.col("n"))
    groups = kids.groupBy(parent).agg(
        F.sum("n").alias("N"), F.sum("s").alias("S"), F.count("*").alias("k"),
        F.sum(F.col("n") * F.col("p") * F.col("p")).alias("npp"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    row = groups.agg(
        F.sum(F.col("npp") - F.col("S") * F.col("S") / F.col("N")).alias("between"),
        F.sum(F.col("S") - F.col("npp")).alias("within"),
        F.sum(F.col("k") - 1).alias("df_between"), F.sum(F.col("N") - F.col("k")).alias("df_within"),
        F.sum(F.col("N") - F.col("nn") / F.col("N")).alias("spread")).first()
    if not row["df_between"] or not row["df_within"]:
        return MAX_STRENGTH
    msb, msw = max(row["between"], 0.0) / row["df_between"], row["within"] / row["df_within"]
    n0 = row["spread"] / row["df_between"]
    total = msb + (n0 - 1) * msw
    rho = (msb - msw) / total if total > 0 else 0.0
    return min(MAX_STRENGTH, max(MIN_STRENGTH, 1 / rho - 1)) if rho > 0 else MAX_STRENGTH


def host_reputation(outcomes: DataFrame, z: float = Z, min_quality: float = MIN_QUALITY) -> DataFrame:
    """``outcomes``: one row per page with ``host`` and ``label`` (null: not labelled).
    Returns per host: ``n``, ``s`` (labelled, good), ``a``, ``b`` (posterior), ``upper``, ``blocked``."""
    domain, suffix = registered_domain(F.col("host"))
    hosts = written(outcomes.groupBy("host").agg(F.count("label").alias("n"),
                                                 F.coalesce(F.sum("label"), F.lit(0)).alias("s"))
                    .select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "s"), "url-hosts")
    add = (F.sum("n").alias("n"), F.sum("s").alias("s"))
    domains = written(hosts.groupBy("domain", "suffix").agg(*add), "url-domains")
    suffixes = domains.groupBy("suffix").agg(*add).withColumn("all", F.lit(1))
    total = suffixes.agg(*add).first()
    if not total["n"]:
        return hosts.select("host", "n", "s", F.lit(None).cast("double").alias("a"),
                            F.lit(None).cast("double").alias("b"), F.lit(1.0).alias("upper"),
                            F.lit(False).alias("blocked"))
    overall = (total["s"] + 0.5) / (total["n"] + 1.0)
    k_suffix, k_domain, k_host = (_strength(suffixes, "all"), _strength(domains, "suffix"), _strength(hosts, "domain"))

    def posterior(prior: Column, strength: float) -> Column:
        return (F.col("s") + F.lit(strength) * prior) / (F.col("n") + F.lit(strength))

    top = suffixes.select("suffix", posterior(F.lit(overall), k_suffix).alias("suffix_mean"))
    mid = domains.join(top, "suffix").select("domain", "suffix", posterior(F.col("suffix_mean"), k_domain).alias("mean"))
    a = F.col("s") + F.lit(k_host) * F.col("mean")
    b = F.col("n") - F.col("s") + F.lit(k_host) * (1 - F.col("mean"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    upper = mean + F.lit(z) * F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    return (hosts.join(mid, ["domain", "suffix"]).select("host", "n", "s", a.alias("a"), b.alias("b"))
            .withColumn("upper", upper).withColumn("blocked", F.col("upper") < min_quality))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], z: float = Z,
                min_quality: float = MIN_QUALITY) -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict``, the host's labelled and good counts.
    ``labels``: (label_id, label) of labelled pages. A hot host's rows meet its one
    score row in a join that AQE splits."""
    host, path = host_and_path(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"))
    outcomes = own.join(labels, own["page_id"] == labels["label_id"], "left").select("host", "label")
    scores = host_reputation(outcomes, z, min_quality).select("host", "n", "s", "blocked")
    rule = rule_column(F.col("host"), F.col("path"), rules)
    return (own.join(scores, "host", "left").withColumn("__rule", rule)
            .select("page_id", "host", "path", F.col("__rule.rule").alias("rule"),
                    F.coalesce(F.col("__rule.verdict"), F.when(F.col("blocked"), F.lit("block"))
                               .otherwise(F.lit("allow"))).alias("verdict"),
                    F.col("n").alias("host_labelled"), F.col("s").alias("host_good")))


def page_labels(labels: DataFrame) -> DataFrame:
    """The ``labels`` table read as outcomes of the pages with the same id."""
    return majority_labels(labels, "quality")
