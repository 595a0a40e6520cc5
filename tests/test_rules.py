"""Literal cases of the scalar rules."""

from pyspark.sql import functions as F

from perispark.functions import rules
from perispark.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_domains(spark):
    assert one(spark, S.sanitize_domain(F.lit(" https://example.com/path "))) == "example.com"
    assert one(spark, S.sanitize_domain(F.lit("a b.ch"))) is None
    assert one(spark, S.should_try_www(F.lit("127.0.0.1"))) is False
    assert one(spark, S.candidate_urls(F.lit("example.com")))[0] == "https://example.com"
    assert len(one(spark, S.candidate_urls(F.lit("example.com")))) == 4
    names = F.array(*map(F.lit, ["ns2.example.com.", "ns1.example.com", "", "ns1.example.com"]))
    assert one(spark, S.dedupe_sorted(names)) == ["ns1.example.com", "ns2.example.com"]


def test_spf_and_dmarc(spark):
    spf = lambda t: one(spark, S.parse_spf(F.lit(t)))
    assert spf("v=spf1 +all").too_permissive and not spf("v=spf1 ~all").too_permissive
    assert spf("v=spf1 include:a include:b mx -all").dns_lookups == 3
    assert spf("v=spf1 " + "include:x " * 11 + "-all").over_limit and not spf("").present
    dmarc = lambda t: one(spark, S.parse_dmarc(F.lit(t)))
    d = dmarc("v=DMARC1; p=quarantine; sp=reject; pct=50")
    assert (d.policy, d.subdomain_policy, d.pct) == ("quarantine", "reject", 50)
    assert dmarc("v=DMARC1; p=none").pct is None and not dmarc("").present


def test_versions(spark):
    v = lambda b, t: one(spark, S.extract_version(F.lit(b), F.lit(t)))
    assert v("MySQL 5.5.5-10.6.20-MariaDB-log", "mysql") == "10.6.20"
    assert v("SSH-2.0-OpenSSH_9.3p1 Ubuntu", "openssh") == "9.3"
    assert v("220 (vsFTPd 3.0.5)", "vsftpd") == "3.0.5"
    assert v("MSSQL 15.0 build 2000", "mssql") == "15.0.2000"
    inside = lambda x, a, b: one(spark, S.version_in_range(F.lit(x), F.lit(a), F.lit(b)))
    assert inside("5.7.15", "0", "5.7.15") and not inside("5.7.16", "0", "5.7.15")
    assert inside("unknown", "1", "2") and inside("1.0", None, None) and inside("9.3", "9.3p1", "9.3p1")


def test_operators_classes_dates(spark):
    op = lambda h: one(spark, S.ns_operator(F.lit(h)))
    assert op("ns-123.awsdns-45.com") == "AWS Route53" and op("ns1.example.net.") == "example.net" and op("localhost") == "localhost"
    assert one(spark, S.jurisdiction(F.lit(""))) == "OTHER" and one(spark, S.parse_json_array(F.lit(""))) == []
    sector = lambda d, t=None: one(spark, S.sector(F.lit(d), F.lit(t).cast("string")))
    assert sector("kantonalbank.ch").confidence == 0.9 and sector("x.ch", "Spital Bern").sector == "healthcare"
    assert sector("www.admin.ch").confidence == 0.95 and sector("zh.ch").sector == "government" and sector("randomsite.ch") is None
    assert [str(one(spark, S.asn1_date(F.lit(e)))) for e in (0, 1700000000, -86400)] == ["1970-01-01", "2023-11-14", "1969-12-31"]
    w = one(spark, S.parse_whois(F.lit("Registrar:\nABC\nFirst registration date: before 1999-01-01\nDNSSEC:Y")))
    assert (w.registrar, str(w.created), w.dnssec_delegated, w.status) == ("ABC", "1999-01-01", True, None)
    assert one(spark, S.detect_cms(F.lit(None).cast("string"), F.lit("x /wp-content/"), F.lit(None).cast("string"))) == "WordPress"


def test_operator_rules(spark):
    """The one pattern names the operator that the rules, tried in order, name."""
    suffixes = [s for s, _ in rules.OPERATORS]
    hosts = [p + s + d for s in suffixes for p in ("", "ns1.", "x", "NS.") for d in ("", ".", "..")]
    hosts += [a + "." + b for a in suffixes for b in suffixes] + ["ns.awsdns-07.org", "a.b.example.ch", "solo", ""]
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", S.ns_operator(F.col("h")).alias("o")).collect()
    for r in got:
        h = r.h.rstrip(".").lower()
        name = next((n for s, n in rules.OPERATORS if h.endswith(s)), None)
        assert r.o == (name or ("AWS Route53" if "awsdns" in h else ".".join(r.h.rstrip(".").split(".")[-2:]))), r.h
