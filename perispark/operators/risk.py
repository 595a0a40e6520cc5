"""Sector classes, risk flags and score, benchmarks, sovereignty, service inventory."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perispark.functions import rules
from perispark.functions import scalars as S
from perispark.operators.merge import merge_replace
from perispark.operators.work import unclassified


def classify(domains: DataFrame, key: str = "domain") -> DataFrame:
    """(key, sector, subsector, confidence) of the domains that a rule names. As a generator's rows, so that the rules
    are gone through once for each domain, not again for the filter and for each column."""
    return domains.select(key, F.inline(F.array_compact(F.array(S.sector(F.col("domain"), F.col("title"))))))


def classify_incremental(domains: DataFrame, classes: DataFrame, key: str = "domain") -> DataFrame:
    return merge_replace(classes, classify(unclassified(domains, classes, key), key).select(*classes.columns), [key])


def sector_counts(classes: DataFrame) -> DataFrame:
    return classes.groupBy("sector").agg(F.count("*").alias("n"))


def risk_flags(tables: dict[str, DataFrame], as_of: str, key: str = "domain") -> DataFrame:
    """The sixteen flags for each domain; null where no side decides.

    Tables: domains (status_code, sovereignty_score), and satellites headers, dns (caa as
    JSON list), tls, whois, email, ports, matches. One-to-many satellites are summed up
    before the joins, so each domain stays one row.
    """
    exists = lambda c: F.max(F.when(c, 1).otherwise(0)) == 1
    port = F.col("port")
    ports = tables["ports"].groupBy(key).agg(
        exists(port.isin(*rules.DB_PORTS)).alias("db"), exists(port.isin(*rules.RISKY_PORTS)).alias("risky"),
        exists(port == 21).alias("ftp"), exists(port == 2375).alias("docker"),
    )
    matches = tables["matches"].groupBy(key).agg(exists(F.col("severity") == "CRITICAL").alias("critical"))
    no = F.lit(False)
    # what the joins sort are flags and dates, not texts
    headers = tables["headers"].select(key, F.col("hsts").isNotNull().alias("hsts"), F.col("csp").isNotNull().alias("csp"))
    dns = tables["dns"].select(key, (F.size(S.parse_json_array(F.col("caa"))) == 0).alias("no_caa"), "dnssec_signed", F.col("txt_dmarc").isNotNull().alias("dmarc"))
    tls = tables["tls"].select(key, F.replace("tls_version", F.lit("_"), F.lit(".")).isin("TLSv1.0", "TLSv1.1").alias("old_tls"), "valid_to")
    email = tables["email"].select(key, "spf_too_permissive", "dkim_found", (F.coalesce(F.col("dmarc_policy") == "none", no)
        | ~F.coalesce("dmarc_present", no)).alias("weak_policy"))
    df = tables["domains"].select(key, "status_code", "sovereignty_score")
    for t in (headers, dns, tls, tables["whois"].select(key, "expires_at"), email, ports, matches):
        # every side has about a row for each domain: the size of well packed files is no reason to collect it in the driver
        df = df.join(t.hint("merge"), key, "left")
    day, code = F.lit(as_of).cast("date"), F.col("status_code")
    left = F.datediff("valid_to", day)
    without = lambda c: ~F.coalesce(c, no)
    return df.select(
        key, F.coalesce("sovereignty_score", F.lit(0)).alias("sovereignty_score"),
        (without("hsts") & (code == 200)).alias("missing_hsts"), (without("csp") & (code == 200)).alias("missing_csp"),
        F.coalesce("no_caa", F.lit(True)).alias("missing_caa"),
        (F.col("old_tls") | (F.col("valid_to") < day)).alias("weak_tls"),
        (F.col("valid_to") < day).alias("cert_expired"), left.between(0, 29).alias("cert_expiring"),
        without("dnssec_signed").alias("no_dnssec"), F.coalesce(F.col("weak_policy"), without("dmarc")).alias("dmarc_weak"),
        (F.col("expires_at") < F.date_add(day, 30)).alias("domain_expiring"),
        F.coalesce("db", no).alias("exposed_db_port"), F.coalesce("risky", no).alias("exposed_risky_port"),
            F.coalesce("ftp", no).alias("exposed_ftp"),
        F.coalesce("docker", no).alias("exposed_docker_api"), F.coalesce("critical", no).alias("has_critical_cve"),
        F.coalesce("spf_too_permissive", no).alias("spf_permissive"), (~F.coalesce("dkim_found", no)).alias("no_dkim"),
    )


def sovereignty_penalty(c: Column) -> Column:
    return F.when(c == 3, 5).when(c == 2, 3).when(c == 1, 1).otherwise(0)


def risk_score(flags: DataFrame) -> DataFrame:
    """flags with score: 100 less the weights of the set flags and the sovereignty penalty, 0 at least."""
    lost = reduce(lambda a, b: a + b, [F.when(F.col(f), w).otherwise(0) for f, w in rules.WEIGHTS.items()])
    return flags.withColumn("score", F.greatest(F.lit(0), F.lit(100) - lost - sovereignty_penalty(F.col("sovereignty_score"))))


METRICS = {"risk_score": ("score", 1.0), "hsts_adoption": ("has_hsts", 100.0), "dnssec_adoption": ("has_dnssec", 100.0),
    "dmarc_weak_pct": ("weak_dmarc", 100.0)}


def benchmark(df: DataFrame, by: str, metric: str, value: str, quantiles: str = "exact") -> DataFrame:
    """Count, mean, median, quartiles and extremes of a number by sector. quantiles: exact, approx,
    or mean_compat (the mean in their places)."""
    q = (
        {"exact": lambda p: F.percentile(value, p), "approx": lambda p: F.approx_percentile(value, F.lit(p)).cast("double"),
        "mean_compat": lambda p: F.avg(value)}[quantiles])
    return df.filter(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(by).agg(
        F.lit(metric).alias("metric"), F.count("*").alias("domain_count"), F.avg(value).alias("mean"), q(0.5).alias("median"),
            q(0.25).alias("p25"), q(0.75).alias("p75"),
        F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"),
    )


def benchmark_pct(df: DataFrame, by: str, metric: str, flag: str, quantiles: str = "exact") -> DataFrame:
    return benchmark(df.withColumn("_v", F.when(F.col(flag), 100.0).otherwise(0.0)), by, metric, "_v", quantiles)


def sector_benchmarks(scores: DataFrame, classes: DataFrame, key: str = "domain", quantiles: str = "exact") -> DataFrame:
    """The four metrics by sector in one pass; a null flag counts as 0."""
    flag = lambda c: F.when(c, 100.0).otherwise(0.0)
    v = scores.join(classes.select(key, "sector"), key).select(
        "sector", F.col("score").cast("double").alias("risk_score"), flag(~F.col("missing_hsts")).alias("hsts_adoption"),
        flag(~F.col("no_dnssec")).alias("dnssec_adoption"), flag(F.col("dmarc_weak")).alias("dmarc_weak_pct"),
    )
    # few values occur in a sector, so they are counted first and the quantiles taken over counts
    long = v.groupBy(*v.columns).agg(F.count("*").alias("n")).unpivot(["sector", "n"], list(METRICS), "metric", "value")
    counts = long.filter("sector IS NOT NULL").groupBy("sector", "metric", "value").agg(F.sum("n").alias("n"))
    mean = F.sum(F.col("value") * F.col("n")) / F.sum("n")
    q = {"exact": lambda p: F.percentile("value", p, F.col("n")), "mean_compat": lambda p: mean}
    if quantiles == "approx":
        return _metric_stats(v.unpivot(["sector"], list(METRICS), "metric", "value").filter("sector IS NOT NULL"), F.count("*"), F.avg("value"),
            lambda p: F.approx_percentile("value", F.lit(p)))
    return _metric_stats(counts, F.sum("n"), mean, q[quantiles])


def _metric_stats(values: DataFrame, n: Column, mean: Column, q: Callable[[float], Column]) -> DataFrame:
    return values.groupBy("sector", "metric").agg(
        n.alias("domain_count"), mean.alias("mean"), q(0.5).alias("median"), q(0.25).alias("p25"), q(0.75).alias("p75"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )


def benchmark_summary(b: DataFrame) -> DataFrame:
    return b.orderBy("sector", "metric")


def score_ranks(scored: DataFrame) -> DataFrame:
    """(sector, score, percentile, sector_median) for each score that occurs in a sector.

    Scores are whole numbers from 0 to 100, so a sector is a table of 101 counts at most: ranks and
    medians are read off the counts, and no task sorts all domains of a sector.
    """
    counts = scored.groupBy("sector", "score").agg(F.count("*").alias("n"))
    by_score = Window.partitionBy("sector").orderBy("score")
    up_to, every = F.sum("n").over(by_score), F.sum("n").over(Window.partitionBy("sector"))
    placed = counts.select("sector", "score", (up_to - F.col("n")).alias("before"), up_to.alias("upto"), every.alias("all"))
    at = lambda p: F.min(F.when(F.col("upto") > p, F.col("score"))).over(Window.partitionBy("sector"))
    middle = (F.col("all") - 1) / 2
    median = (at(F.floor(middle)) + at(F.ceil(middle))) / 2
    rank = F.when(F.col("all") > 1, F.col("before") / (F.col("all") - 1)).otherwise(0.0)
    return placed.select("sector", "score", rank.alias("percentile"), median.alias("sector_median"))


def domain_percentile(scores: DataFrame, classes: DataFrame, key: str = "domain") -> DataFrame:
    """Each domain's percent rank among its sector's scores, and the sector's median."""
    scored = scores.select(key, "score").join(classes.select(key, "sector"), key)
    ranks = score_ranks(scored)
    return scored.join(ranks, ["sector", "score"]).select(key, "sector", "score", "percentile", "sector_median")


def sovereignty_score(domains: DataFrame, staging: DataFrame, operators: DataFrame, key: str = "domain") -> DataFrame:
    """domains with sovereignty_score: US 3, OTHER 2, EU 1, else 0; the worst of a domain's operators.
    An operator that the table lacks counts as OTHER."""
    where = F.coalesce("jurisdiction", F.lit("OTHER"))
    points = F.when(where == "US", 3).when(where == "OTHER", 2).when(where == "EU", 1).otherwise(0)
    placed = staging.join(operators.select("operator", "jurisdiction"), "operator", "left")
    worst = placed.groupBy(key).agg(F.max(points).alias("sovereignty_score"))
    return domains.drop("sovereignty_score").join(worst, key, "left")


def jurisdiction_distribution(domains: DataFrame, staging: DataFrame, operators: DataFrame, key: str = "domain") -> DataFrame:
    total = domains.agg(F.count("*").alias("total"))
    n = staging.join(operators, "operator").groupBy("jurisdiction").agg(F.countDistinct(key).alias("domains"))
    return n.crossJoin(F.broadcast(total)).select("jurisdiction", "domains", F.expr("domains * 100 DIV total").alias("percent"))


def top_operators(staging: DataFrame, n: int = 20, key: str = "domain") -> DataFrame:
    return staging.groupBy("operator").agg(F.countDistinct(key).alias("domains")).orderBy(F.col("domains").desc(), "operator").limit(n)


def sovereignty_histogram(scored: DataFrame) -> DataFrame:
    return scored.groupBy("sovereignty_score").agg(F.count("*").alias("n"))


def ns_concentration(staging: DataFrame, domains: DataFrame, key: str = "domain") -> DataFrame:
    total = domains.filter("status = 'ok'").agg(F.count("*").alias("total"))
    n = staging.groupBy("operator").agg(F.countDistinct(key).alias("domains"))
    return n.crossJoin(F.broadcast(total)).select("operator", "domains",
        F.round(F.col("domains") * 100.0 / F.col("total").cast("double"), 4).alias("percent"))


def list_services(ports: DataFrame, key: str = "domain") -> DataFrame:
    tech = S.banner_technology(F.col("port"), F.col("banner"))
    each = ports.select(key, "port", tech.alias("technology"), S.extract_version(F.col("banner"), tech).alias("version"))
    return each.groupBy("port", "technology").agg(F.countDistinct(key).alias("domains"),
        F.array_join(F.sort_array(F.collect_set("version")), ",").alias("versions"))


def error_rate_guard(results: DataFrame, threshold: float = 0.5, min_samples: int = 100) -> DataFrame:
    n = results.groupBy("module").agg(F.count("*").alias("completed"), F.count("error_kind").alias("errors"))
    return n.filter((F.col("completed") >= min_samples) & (F.col("errors") / F.col("completed").cast("double") > threshold))
