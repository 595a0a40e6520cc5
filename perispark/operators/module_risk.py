"""Module risk models: capped sums of points for terms that the tables can answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perispark.functions import scalars as S

KEY = "k"
c = F.col


def points(*terms: tuple[Column, int | Column], base: int, cap: int) -> Column:
    """The base and each term's points where it holds (null doesn't), between 0 and the cap."""
    total = reduce(lambda a, t: a + F.when(t[0], t[1]).otherwise(0), terms, F.lit(base))
    return F.greatest(F.lit(0), F.least(F.lit(cap), total))


def tls_risk(tls: DataFrame, as_of: str) -> DataFrame:
    left = F.datediff("valid_to", F.lit(as_of).cast("date"))
    version, rsa = F.replace("tls_version", F.lit("_"), F.lit(".")), c("key_oid") == "1.2.840.113549.1.1.1"
    weak = F.upper("cipher").rlike("DES|RC4|NULL")
    return tls.select(KEY, points(
        (left < 7, 30), (left.between(7, 29), 15), (left.between(30, 89), 5), (rsa & (c("key_size") < 2048), 20),
            ((rsa & (c("key_size") >= 4096)) | ~rsa, -5),
        (version.isin("TLSv1.0", "TLSv1.1"), 25), (version == "TLSv1.3", -10), (~c("ct_logged"), 10),
            (c("cert_issuer") == c("cert_subject"), 25),
        (F.startswith(F.upper("signature"), F.lit("SHA1")), 20), (~c("stapled"), 5), (weak, 20), base=10, cap=100,
    ).alias("points"))


def dns_risk(dns: DataFrame, orphans: DataFrame) -> DataFrame:
    """orphans: a row for each alias of a key whose target is gone."""
    caa, ns = F.size(S.parse_json_array(c("caa"))), F.size(S.parse_json_array(c("ns")))
    lost = orphans.groupBy(KEY).agg((F.count("*") * 15).cast("int").alias("lost"))
    signed = F.coalesce("dnssec_signed", F.lit(False))
    return dns.join(lost, KEY, "left").select(KEY, points(
        (~signed, 25), (signed & ~c("dnssec_valid"), 35), (caa == 0, 15), (caa > 1, 8), (caa == 1, -5), (c("axfr_open"), 20),
            (ns < 2, 10),
        (c("wildcard"), 12), (c("lost").isNotNull(), c("lost")), (c("ttl") < 300, 5), (c("ttl") > 86400, 3), base=15, cap=100,
    ).alias("points"))


def csp_directives(csp: Column) -> Column:
    """map of directive to its sources; a directive's first place counts."""
    parts = F.filter(F.transform(F.split(csp, ";"), lambda p: F.trim(p)), lambda p: p != "")
    pair = (
        lambda p: F.struct(F.lower(F.split_part(p, F.lit(" "), F.lit(1))).alias("key"),
        F.trim(F.regexp_replace(p, r"^\S+", "")).alias("value")))
    entries = F.transform(parts, pair)
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["key"]), e["key"]) == i + 1)
    return F.map_from_entries(first)


def hsts_parts(hsts: Column) -> Column:
    """struct(max_age, subdomains, preload)."""
    low = F.lower(hsts)
    return F.struct(F.nullif(F.regexp_extract(low, r"max-age\s*=\s*\"?(\d+)", 1), F.lit("")).try_cast("bigint").alias("max_age"),
        F.contains(low, F.lit("includesubdomains")).alias("subdomains"), F.contains(low, F.lit("preload")).alias("preload"))


def header_risk(headers: DataFrame) -> DataFrame:
    h = hsts_parts(c("hsts"))
    star = F.coalesce(c("csp").rlike(r"(^|[\s;])\*([\s;]|$)"), F.lit(False))
    return headers.select(KEY, points(
        (c("hsts").isNull(), 20), (h["max_age"] < 15768000, 10), (h["subdomains"], -3), (h["preload"], -5), (c("csp").isNull(), 15),
            (F.contains("csp", F.lit("unsafe-inline")), 12),
        (F.contains("csp", F.lit("unsafe-eval")), 10), (star, 8), (c("x_frame_options").isNull(), 12),
            (F.upper("x_frame_options") == "SAMEORIGIN", 5), (c("x_content_type_options").isNull(), 8),
        (c("referrer_policy").isNull(), 5), (F.lower("referrer_policy") == "unsafe-url", 8), (c("permissions_policy").isNull(), 3),
            base=10, cap=75,
    ).alias("points"))


def port_class(port: Column) -> Column:
    return (
        F.when(port.isin(23, 445, 3389, 2375, 6379, 9200, 27017, 11211), "CRITICAL").when(port.isin(21, 22, 3306, 5432, 1433, 5900),
        "HIGH").when(port.isin(80, 443), "LOW").otherwise("MEDIUM"))


def port_risk(ports: DataFrame, critical: DataFrame) -> DataFrame:
    """critical: the keys that have a critical match."""
    p = c("port")
    each = (
        F.when(p.isin(3306, 5432, 6379, 9200, 27017, 11211, 1433), 30).when(p.isin(22, 3389, 445, 23), 30).when(p == 21,
        25).when((p == 8080) | p.between(8081, 8099) | p.between(9000, 9999), 15).otherwise(0))
    open_ = ports.groupBy(KEY).agg(F.sum(each).alias("open"))
    critical = critical.select(KEY).distinct().withColumn("critical", F.lit(10))
    return open_.join(critical, KEY, "left").select(KEY,
        F.least(F.lit(150), 25 + c("open") + F.coalesce("critical", F.lit(0))).cast("int").alias("points"))


def email_risk(dns: DataFrame, email: DataFrame) -> DataFrame:
    spf, dmarc = S.parse_spf(c("txt_spf")), S.parse_dmarc(c("txt_dmarc"))
    parsed = dns.select(KEY, "mx", spf.alias("s"), dmarc.alias("d")).join(email.select(KEY, "dkim_found"), KEY, "left")
    return parsed.select(KEY, points(
        (~F.coalesce("dkim_found", F.lit(False)), 15),
        (~c("s.present"), 20), (c("s.policy") == "~all", 8), (~c("d.present"), 20), (c("d.policy") == "none", 15),
            (c("d.policy") == "quarantine", 5),
        (c("d.subdomain_policy") == "none", 8), (c("d.has_reporting"), -2), (F.size(S.parse_json_array(c("mx"))) == 0, 10), base=25,
            cap=100,
    ).alias("points"))


def technology_risk(matches: DataFrame, supported: DataFrame, key: str = KEY) -> DataFrame:
    """supported: (technology, least), the least version that still gets fixes; older ones count as ended."""
    s, n = F.col("cvss_score"), lambda when, k: F.when(when, k).otherwise(0)
    band = F.when(s >= 9, 30).when(s >= 7, 20).when(s >= 4, 10).when(s.isNotNull(), 3).otherwise(0)
    ended = S.version_key(c("version")) < S.version_key(c("least"))
    each = band + n(c("in_kev"), 20) + n(c("version").isNotNull(), 5) + n(ended, 10)
    known = matches.join(supported.select("technology", "least"), "technology", "left")
    return known.groupBy(key).agg(F.least(F.lit(150), 10 + F.sum(each)).cast("int").alias("points"))


def domain_risk(whois: DataFrame, as_of: str, orphans: DataFrame, lookalikes: DataFrame) -> DataFrame:
    """orphans: a row for each alias of a key whose target is gone; lookalikes: keys whose name another one imitates."""
    left = F.datediff("expires_at", F.lit(as_of).cast("date"))
    lost = orphans.groupBy(KEY).agg(F.least(F.lit(30), F.count("*") * 12).cast("int").alias("lost"))
    like = lookalikes.select(KEY).distinct().withColumn("like", F.lit(True))
    return whois.join(lost, KEY, "left").join(like, KEY, "left").select(KEY, points(
        (left.between(0, 6), 25), (left.between(7, 29), 15), (left.between(30, 89), 5), (left.between(-30, -1), 20), (left < -30, 35),
        (c("lost").isNotNull(), c("lost")), (c("like"), 15), base=12, cap=100,
    ).alias("points"))


def overall(parts: dict[str, DataFrame], domains: DataFrame) -> DataFrame:
    """Sum over the models a domain has, and its band."""
    total = None
    for df in parts.values():
        total = df if total is None else total.unionByName(df)
    n = (
        domains.select(KEY).join(total.groupBy(KEY).agg(F.sum("points").alias("points")), KEY, "left").select(KEY,
        F.coalesce("points", F.lit(0)).cast("long").alias("points")))
    return n.withColumn("band",
        F.when(c("points") < 100, "green").when(c("points") < 250, "yellow").when(c("points") < 400, "orange").otherwise("red"))


def email_issues(dns: DataFrame) -> DataFrame:
    """(key, issue, severity), a row for each issue."""
    s, d = S.parse_spf(c("txt_spf")), S.parse_dmarc(c("txt_dmarc"))
    entry = lambda when, what, how: F.when(when, F.struct(F.lit(what).alias("issue"), F.lit(how).alias("severity")))
    found = F.array(entry(~s["present"], "no_spf", "high"), entry(s["too_permissive"], "permissive_spf", "high"),
        entry(s["over_limit"], "spf_over_limit", "medium"), entry(~d["present"], "no_dmarc", "high"),
        entry(d["policy"] == "none", "dmarc_none", "medium"), entry(d["present"] & ~d["has_reporting"], "no_reporting", "low"))
    return dns.select(KEY, F.inline(F.array_compact(found)))


def expiry_level(whois: DataFrame, as_of: str) -> DataFrame:
    left = F.datediff("expires_at", F.lit(as_of).cast("date"))
    return whois.select(KEY, F.when(left < 7, "7").when(left < 30, "30").when(left < 90, "90").alias("level")).filter("level IS NOT NULL")


#: regime -> flags that must not be set
CONTROLS = {"data_protection": ("weak_tls", "missing_hsts", "cert_expired"),
    "network_security": ("exposed_db_port", "exposed_risky_port", "has_critical_cve", "no_dnssec"),
    "resilience": ("has_critical_cve", "domain_expiring", "exposed_docker_api")}


def compliance(flags: DataFrame) -> DataFrame:
    """(key, regime, passed): none of the regime's flags is set."""
    rows = [F.struct(F.lit(r).alias("regime"), (~reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in fs])).alias("passed"))
        for r, fs in CONTROLS.items()]
    return flags.select(KEY, F.inline(F.array(*rows)))
