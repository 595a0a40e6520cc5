"""Population statistics over the observation tables.

Tables are a dict of DataFrames with a common key column (``key``): domains, headers,
dns, tls, ports, whois, email, subdomains, classes, matches, catalog, staging, operators,
flags, shown. Shares are percentages rounded to one decimal, computed in double.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perispark.functions import scalars as S
from perispark.operators.matching import counted_matches, keys_of
from perispark.operators.ordering import numbered
from perispark.operators.risk import ns_concentration

Tables = dict[str, DataFrame]
KEY = "k"

RISK_PORTS = {445: "critical", 3389: "critical", 23: "critical", 2375: "critical", 3306: "high", 5432: "high", 6379: "high", 9200: "high",
    27017: "high", 11211: "high", 1433: "high", 21: "medium", 5900: "high"}
WEAK_COUNTRIES = ("RU", "BY", "IR", "CN", "SY")
CONTINENTS = {"CH": "Europe", "DE": "Europe", "FR": "Europe", "GB": "Europe", "AT": "Europe", "IT": "Europe", "NL": "Europe",
    "RU": "Europe", "US": "North America", "CA": "North America", "SG": "Asia", "CN": "Asia", "JP": "Asia", "AU": "Oceania",
    "BR": "South America", "ZA": "Africa"}
#: Titles, in lower case, of pages that nobody has written; callers name their own.
GENERIC_TITLES = ("index of /", "home", "domain parking", "coming soon", "under construction", "default web page", "welcome")
CLOUD_MARKS = (("cloudflare", "cloudflare"), ("microsoft", "microsoft"), ("pepyaka", "wix"), ("awselb", "aws"), ("google", "google"))


def pct(n: Column, total: Column) -> Column:
    return F.round(n.cast("double") * 100.0 / total.cast("double"), 1)


def shares(df: DataFrame, *by: str) -> DataFrame:
    """Rows, and their share of all, for each value of the columns."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    return n.select(*by, "n", pct(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"))


def flags(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows fulfil each condition, among n."""
    return df.agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def top(df: DataFrame, n: int, *by: str, value: str = "n") -> DataFrame:
    return df.orderBy(F.col(value).desc(), *by).limit(n)


def first_of(c: Column, marks: tuple[tuple[str, str], ...], other: str) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    out = None
    for mark, name in marks:
        out = (F if out is None else out).when(F.contains(low, F.lit(mark)), F.lit(name))
    return out.otherwise(F.lit(other))


SERVERS = (("apache", "apache"), ("nginx", "nginx"), ("openresty", "nginx"), ("cloudflare", "cloudflare"), ("pepyaka", "pepyaka"),
    ("litespeed", "litespeed"), ("squarespace", "squarespace"), ("iis", "iis"), ("vercel", "vercel"))
ISSUERS = (("let's encrypt", "letsencrypt"), ("digicert", "digicert"), ("sectigo", "sectigo"), ("swisssign", "swisssign"),
    ("globalsign", "globalsign"))

live = lambda t: t["domains"].filter("status = 'ok'")
sectored = lambda t, name="domains": t[name].join(t["classes"].select(KEY, "sector"), KEY)
empty_list = lambda c: F.size(S.parse_json_array(F.col(c))) == 0


def g0(t: Tables) -> DataFrame:
    """Each domain's state in the four scans, a row for each scan."""
    d = t["domains"]
    ports = t["ports"].groupBy(KEY).agg(
        F.array_join(F.transform(F.sort_array(F.collect_set("port")), lambda p: p.cast("string")), ",").alias("detail"))
    return (
        d.filter("status IS NOT NULL").select(KEY, F.lit("http").alias("scan"),
            F.coalesce(F.col("status_code").cast("string"), "error_kind").alias("detail"))
        .unionByName(
            t["dns"].select(KEY, F.lit("dns").alias("scan"), F.size(S.parse_json_array(F.col("ns"))).cast("string").alias("detail")))
        .unionByName(t["tls"].select(KEY, F.lit("tls").alias("scan"), F.col("tls_version").alias("detail")))
        .unionByName(ports.select(KEY, F.lit("ports").alias("scan"), "detail"))
    )


def g6(t: Tables, n: int = 10) -> DataFrame:
    """(kind, value, n): PHP by branch with their total, and the n most frequent versions."""
    p = F.col("powered_by")
    major, minor = F.regexp_extract(p, r"PHP/(\d+)", 1).try_cast("int"), F.regexp_extract(p, r"PHP/\d+\.(\d+)", 1).try_cast("int")
    branch = (
        F.when(major == 5, "5.x").when((major == 7) & (minor <= 3), "7.0-7.3").when((major == 7) & (minor == 4), "7.4").when(major == 8,
        "8.x"))
    php = t["domains"].select(branch.alias("branch")).filter("branch IS NOT NULL")
    branches = php.rollup("branch").agg(F.count("*").alias("n"))
    versions = top(t["domains"].filter("powered_by IS NOT NULL").groupBy("powered_by").agg(F.count("*").alias("n")), n, "powered_by")
    return branches.select(F.lit("branch").alias("kind"), F.coalesce("branch", F.lit("total")).alias("value"), "n").unionByName(
        versions.select(F.lit("version").alias("kind"), F.col("powered_by").alias("value"), "n")
    )


def g7(t: Tables) -> DataFrame:
    e = live(t).agg(F.percentile("elapsed_ms", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.95, 0.99)))).alias("q"),
        F.min("elapsed_ms").alias("min"), F.max("elapsed_ms").alias("max"), F.avg("elapsed_ms").alias("mean"))
    return e.select("min", "max", F.round("mean", 4).alias("mean"),
        *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75", "p95", "p99"))])


def g8(t: Tables) -> DataFrame:
    host = F.regexp_replace(F.regexp_extract("final_url", r"^https?://([^/]*)", 1), r"^www\.", "")
    return flags(live(t), cross_domain=host != F.col("domain"))


def g9(t: Tables, titles: tuple[str, ...] = GENERIC_TITLES) -> DataFrame:
    return flags(live(t), no_title=c("title").isNull(), generic=F.lower("title").isin(*titles))


def g11(t: Tables) -> DataFrame:
    n = live(t).filter("ip IS NOT NULL").groupBy("ip").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    best = top(n, 10, "ip").crossJoin(F.broadcast(total))
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("n").desc(), "ip").rowsBetween(Window.unboundedPreceding, 0)
    return best.select("ip", "n", pct(F.sum("n").over(w), F.col("total")).alias("cumulative"))


def g12(t: Tables, n: int = 10) -> DataFrame:
    """(kind, title, n): how many pages have a hash or none, how many bodies they are, and the n largest
    groups of one body with the least of their titles."""
    groups = live(t).groupBy("body_hash").agg(F.count("*").alias("n"), F.min("title").alias("title"))
    known, one = F.col("body_hash").isNotNull(), F.col("n") == 1
    many, rows = known & ~one, lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    sums = groups.agg(
        rows(known).alias("with_hash"), rows(~known).alias("no_hash"), F.count_if(known).alias("distinct_bodies"),
        F.count_if(known & one).alias("singletons"), rows(many).alias("sharing"), F.count_if(many).alias("groups"),
    )
    long = sums.unpivot([], sums.columns, "kind", "n").select("kind", F.lit(None).cast("string").alias("title"), "n")
    largest = top(groups.filter(many), n, "body_hash").select(F.lit("group").alias("kind"), "title", "n")
    return long.unionByName(largest)


def g14(t: Tables) -> DataFrame:
    s = shares(live(t).filter("country_code IS NOT NULL"), "country_code")
    return s.groupBy(F.when(F.col("share") < 0.4, "other").otherwise(F.col("country_code")).alias("country")).agg(F.sum("n").alias("n"))


def g20(t: Tables) -> DataFrame:
    m = F.create_map(*[x for k, v in CONTINENTS.items() for x in (F.lit(k), F.lit(v))])
    c = live(t).filter("country_code IS NOT NULL").select("country_code",
        F.coalesce(F.try_element_at(m, F.col("country_code")), F.lit("Other")).alias("continent"))
    return c.rollup("continent", "country_code").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def g29(t: Tables, n: int = 10) -> DataFrame:
    """(kind, name, n, parents): subdomains by source, those that zone transfers leak, and the n parents that leak most."""
    s, leaked = t["subdomains"], F.col("source") == "axfr"
    parents = F.countDistinct(KEY).alias("parents")
    by_source = s.groupBy("source").agg(F.count("*").alias("n"), parents).select(F.lit("source").alias("kind"),
        F.col("source").alias("name"), "n", "parents")
    leaks = s.filter(leaked).agg(F.count("*").alias("n"), parents).select(F.lit("leaking").alias("kind"), F.lit("axfr").alias("name"),
        "n", "parents")
    most = top(s.filter(leaked).groupBy(KEY).agg(F.countDistinct("subdomain").alias("n")), n, KEY)
    one = most.select(F.lit("leak").alias("kind"), F.col(KEY).cast("string").alias("name"), "n", F.lit(1).cast("long").alias("parents"))
    return by_source.unionByName(leaks).unionByName(one)


def g31(t: Tables) -> DataFrame:
    """WordPress by currency of its version."""
    key = S.version_key(F.col("cms_version"))
    at = lambda s: S.version_key(F.lit(s))
    band = F.when(key >= at("6.8"), "current").when(key >= at("6.0"), "older").otherwise("outdated")
    return shares(live(t).filter("cms = 'WordPress' AND cms_version IS NOT NULL").select(band.alias("band")), "band")


def by_technology(m: DataFrame, **cves: Column) -> DataFrame:
    """(technology, domains, *cves) of counted_matches(): keys, and the different values of the columns cves."""
    ids = m.select("technology", "cve_id", "severity").distinct().groupBy("technology").agg(*[F.countDistinct(c).alias(n) for n, c in cves.items()])
    return keys_of(m, "technology").join(ids, "technology")


def g32(t: Tables) -> DataFrame:
    of = lambda s: F.when(F.col("severity") == s, F.col("cve_id"))
    return by_technology(counted_matches(t["shown"], t["catalog"]), critical=of("CRITICAL"), high=of("HIGH"))


def g34(t: Tables) -> DataFrame:
    """Operators by domains, with the cumulative share. Operators of one count are numbered in order of their
    names, so the long tail of operators of a single domain isn't one task's."""
    n = t["staging"].groupBy("operator").agg(F.count("*").alias("pairs"))
    counts = n.groupBy("pairs").agg(F.count("*").alias("operators"))
    more = Window.partitionBy(F.lit(1)).orderBy(F.col("pairs").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = F.sum(F.col("pairs") * F.col("operators"))
    before = counts.select("pairs", F.coalesce(sums.over(more), F.lit(0)).alias("before"),
        sums.over(Window.partitionBy(F.lit(1))).alias("total"))
    placed = numbered(n, "operator", ["pairs"]).join(before, "pairs")
    up_to = F.col("before") + (F.col("idx") + 1) * F.col("pairs")
    return placed.select("operator", "pairs", pct(up_to, F.col("total")).alias("cumulative"))


def g35(t: Tables) -> DataFrame:
    away = t["staging"].join(t["operators"].filter("jurisdiction IN ('US', 'OTHER')"), "operator").select(KEY).distinct()
    return live(t).filter("country_code != 'CH'").join(away, KEY, "left_semi").agg(F.count("*").alias("n"))


def sector_share(df: DataFrame, **conditions: Column) -> DataFrame:
    """For each sector its rows and the share of each condition (null counts as not met)."""
    return df.groupBy("sector").agg(F.count("*").alias("n"),
        *[F.round(F.avg(F.when(c, 100.0).otherwise(0.0)), 1).alias(k) for k, c in conditions.items()])


def g38(t: Tables) -> DataFrame:
    wanted = (3306, 5432, 6379, 9200, 27017, 11211)
    p = sectored(t, "ports").filter(F.col("port").isin(*wanted))
    return (
        p.groupBy("sector").pivot("port", list(wanted)).agg(F.countDistinct(KEY)).na.fill(0).select("sector",
        *[F.col(str(x)).alias(f"p{x}") for x in wanted]))


def g40(t: Tables) -> DataFrame:
    kev = counted_matches(t["shown"], t["catalog"]).filter("in_kev")
    total = keys_of(kev).select(F.lit("total").alias("technology"), F.coalesce("domains", F.lit(0).cast("long")).alias("domains"))
    return keys_of(kev, "technology").unionByName(total)


def g42(t: Tables) -> DataFrame:
    items = sectored(t, "shown").filter("sector IN ('finance', 'healthcare')")
    return keys_of(counted_matches(items, t["catalog"], "sector").filter("severity = 'CRITICAL'"), "sector", "technology")


def g43(t: Tables) -> DataFrame:
    """The keys with the most matches. Only the lists that have as many are looked for among the keys."""
    n = counted_matches(t["shown"], t["catalog"]).groupBy("_set").agg(F.count("*").alias("n"))
    most = n.join(F.broadcast(n.agg(F.max("n").alias("n"))), "n").withColumnRenamed("_set", "items")
    return t["shown"].join(most, "items").select(KEY, "n")


def g45(t: Tables) -> DataFrame:
    names = ["missing_hsts", "missing_csp", "weak_tls", "no_dnssec", "dmarc_weak", "exposed_db_port"]
    f = sectored(t, "flags").filter("sector IN ('government', 'retail')").select("sector",
        *[F.when(F.col(c), 100.0).otherwise(0.0).alias(c) for c in names])
    long = f.unpivot(["sector"], names, "flag", "v")
    return long.groupBy("flag").pivot("sector", ["government", "retail"]).agg(F.round(F.avg("v"), 1))


def g47(t: Tables) -> DataFrame:
    n = sectored(t).filter("cms IS NOT NULL").groupBy("sector", "cms").agg(F.count("*").alias("n"))
    w = Window.partitionBy("sector").orderBy(F.col("n").desc(), "cms")
    return n.withColumn("rank", F.row_number().over(w)).filter("rank <= 2")


def g49(t: Tables) -> DataFrame:
    j = t["tls"].filter("status = 'ok'").select(KEY).join(t["dns"].select(KEY, "caa"), KEY, "left")
    return flags(j, with_caa=~empty_list("caa"), without_caa=empty_list("caa"))


def weak_email(t: Tables) -> DataFrame:
    c = F.col
    no = F.lit(False)
    spf, dmarc = F.coalesce("spf_present", no), F.coalesce("dmarc_present", no)
    spoofable = (~spf | c("spf_too_permissive")) & (~dmarc | F.coalesce(c("dmarc_policy") == "none", no))
    over = t["dns"].agg(F.count_if(S.parse_spf(c("txt_spf"))["over_limit"]).alias("over_limit"))
    return flags(t["email"], neither=~spf & ~dmarc, spoofable=spoofable).crossJoin(over)  # one row each


c = F.col
has = lambda x: F.col(x).isNotNull()
FINDINGS: dict[str, Callable[[Tables], DataFrame]] = {
    "g0_scan_summary": g0,
    "g1_status": lambda t: shares(t["domains"].withColumn("status", F.coalesce("status", F.lit("pending"))), "status"),
    "g2_error_kinds": lambda t: shares(t["domains"].filter("status = 'error'"), "error_kind"),
    "g3_status_codes": lambda t: shares(live(t), "status_code"),
    "g4_servers": lambda t: shares(live(t).withColumn("family", first_of(c("server"), SERVERS, "other")), "family"),
    "g5_cms": lambda t: shares(live(t).filter("cms IS NOT NULL AND lower(cms) NOT IN ('apache', 'nginx', 'php')"), "cms"),
    "g6_php_branches": g6,
    "g7_response_times": g7,
    "g8_cross_domain": g8,
    "g9_parked": g9,
    "g10_addresses": lambda t: live(t).agg(F.countDistinct("ip").alias("ips"), F.count("ip").alias("domains"),
        F.round(F.count("ip") / F.countDistinct("ip").cast("double"), 4).alias("per_ip")),
    "g11_top_ips": g11,
    "g12_clones": g12,
    "g13_schemes": lambda t: flags(live(t), https=F.startswith("final_url", F.lit("https://")),
        http=F.startswith("final_url", F.lit("http://"))),
    "g14_countries": g14,
    "g15_headers": lambda t: flags(t["headers"], hsts=has("hsts"), csp=has("csp"), frame=has("x_frame_options"),
        sniff=has("x_content_type_options"), none=~(has("hsts") | has("csp") | has("x_frame_options") | has("x_content_type_options"))),
    "g16_tls": lambda t: t["tls"].groupBy("tls_version",
        first_of(c("cert_issuer"), ISSUERS, "other").alias("issuer")).agg(F.count("*").alias("n"),
        F.count_if(F.datediff("valid_to", t["as_of"]).between(0, 29)).alias("expiring")),
    "g17_email": lambda t: t["email"].groupBy("dmarc_policy").agg(F.count("*").alias("n"), F.count_if("spf_present").alias("spf"),
        F.count_if("dmarc_present").alias("dmarc"), F.count_if("dkim_found").alias("dkim")),
    "g18_risky_ports": lambda t: t["ports"].filter(c("port").isin(*RISK_PORTS)).groupBy("port").agg(
        F.countDistinct(KEY).alias("domains")).withColumn("risk",
        F.create_map(*[x for k, v in RISK_PORTS.items() for x in (F.lit(k), F.lit(v))])[c("port")]),
    "g19_dnssec": lambda t: flags(t["dns"], signed=c("dnssec_signed"), unknown=c("dnssec_signed").isNull()),
    "g20_continents": g20,
    "g21_domestic_ips": lambda t: top(live(t).filter("country_code = 'CH' AND ip IS NOT NULL").groupBy("ip").agg(F.count("*").alias("n")),
        10, "ip"),
    "g22_foreign_ips": lambda t: top(
        live(t).filter("country_code != 'CH' AND ip IS NOT NULL").groupBy("ip", "country_code").agg(F.count("*").alias("n")), 10, "ip",
        "country_code"),
    "g23_weak_countries": lambda t: live(t).filter(c("country_code").isin(*WEAK_COUNTRIES)).rollup("country_code").agg(
        F.count("*").alias("n")).select(F.coalesce("country_code", F.lit("total")).alias("country"), "n"),
    "g24_clouds": lambda t: live(t).withColumn("cloud",
        first_of(c("server"), CLOUD_MARKS, "none")).filter("cloud != 'none'").rollup("cloud").agg(F.count("*").alias("n")).select(
        F.coalesce("cloud", F.lit("total")).alias("cloud"), "n"),
    "g25_keys": lambda t: t["tls"].groupBy("key_oid", "key_size").agg(F.count("*").alias("n"),
        F.count_if(F.datediff("valid_to", t["as_of"]).between(0, 6)).alias("within_week")),
    "g26_spoofable": weak_email,
    "g27_open_cors": lambda t: flags(t["headers"], open=c("cors_origin") == "*"),
    "g28_dns_hygiene": lambda t: flags(t["dns"], wildcard=c("wildcard"), no_caa=empty_list("caa"),
        spf_without_mx=has("txt_spf") & empty_list("mx")),
    "g29_subdomains": g29,
    "g30_other_ports": lambda t: t["ports"].filter("port NOT IN (80, 443)").groupBy("port").agg(F.count("*").alias("n")),
    "g31_version_bands": g31,
    "g32_exposure": g32,
    "g33_sector_metrics": lambda t: t["bench"].groupBy("sector").pivot("metric",
        ["dmarc_weak_pct", "dnssec_adoption", "hsts_adoption", "risk_score"]).agg(F.round(F.max("mean"), 2)),
    "g34_operator_pairs": g34,
    "g35_offshored": g35,
    "g36_hosting_by_sector": lambda t: sector_share(sectored(t), ch=c("country_code") == "CH", us=c("country_code") == "US"),
    "g37_cloud_by_sector": lambda t: sectored(t).filter("sector IN ('government', 'healthcare', 'finance')").groupBy("sector").agg(
        *[F.count_if(first_of(c("server"), CLOUD_MARKS, "none") == n).alias(n) for n in ("cloudflare", "microsoft", "wix")]),
    "g38_db_ports_by_sector": g38,
    "g39_email_by_sector": lambda t: sector_share(sectored(t, "email"), spf=c("spf_present"), dmarc=c("dmarc_present"),
        dkim=c("dkim_found")),
    "g40_kev": g40,
    "g41_cve_exposure": lambda t: by_technology(counted_matches(t["shown"], t["catalog"]), cves=c("cve_id")),
    "g42_critical_by_sector": g42,
    "g43_most_cves": g43,
    "g44_low_scores": lambda t: sector_share(sectored(t, "flags"), low=c("score") < 50),
    "g45_two_sectors": g45,
    "g46_headers_by_sector": lambda t: sector_share(sectored(t, "headers"), hsts=has("hsts"), csp=has("csp"),
        frame=has("x_frame_options")),
    "g47_cms_by_sector": g47,
    "g48_key_inventory": lambda t: t["tls"].groupBy("key_size").agg(F.count("*").alias("n"),
        F.count_if((c("key_oid") == "1.2.840.113549.1.1.1") & (c("key_size") < 2048)).alias("weak_rsa")),
    "g49_caa": g49,
    "g50_kev_critical": lambda t: t["matches"].filter("in_kev AND severity = 'CRITICAL'").select(KEY, "cve_id", "technology"),
    "g51_permissive_spf": lambda t: t["email"].filter("spf_too_permissive").select(KEY),
    "g52_weak_dmarc": lambda t: t["email"].filter("dmarc_policy = 'none' OR NOT dmarc_present").select(KEY, "dmarc_policy"),
    "g53_spf_over_limit": lambda t: t["dns"].select(KEY, S.parse_spf(c("txt_spf")).alias("s")).filter("s.over_limit").select(KEY,
        "s.dns_lookups"),
    "g54_sectors": lambda t: shares(t["classes"], "sector"),
    "g55_risk_by_sector": lambda t: t["bench"].filter("metric = 'risk_score'").select("sector", F.round("mean", 4).alias("mean"),
        "median"),
    "g56_large_operators": lambda t: ns_concentration(t["staging"], t["domains"], KEY).filter("percent > 10"),
    "g57_non_domestic": lambda t: t["sovereign"].agg(F.count("sovereignty_score").alias("n"),
        pct(F.count_if(c("sovereignty_score") > 0), F.count("sovereignty_score")).alias("share")),
}
