"""The registered queries of the library: each operator over derived tables, with its SQL twin."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perispark.functions import scalars as S
from perispark.functions.catalogue import SEED
from perispark.functions.rules import BANNER_PORTS, KEV_VENDORS, LOOKUP_WORDS, SCT_OID, SERVICES, SIGNATURE_OIDS, TLS_FEATURE_OID, TLS_WORDS
from perispark.operators import findings, graph, matching, merge, module_risk, research, risk, sketches, work
from perispark.operators.dealing import dealt, parts
from perispark.plans.fixtures import AS_OF, FIXTURES, derived, fixture
from perispark.plans.views import JURISDICTION, KEY_OF, LIST, with_views
from perispark.sources import tables as sources
from perispark.sources import versions
from perispark.sources.scratch import shared_folder, written
from perispark.streaming import results as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
K = "k"
c = F.col


class Tables(dict):
    """The derived tables of one folder by short names, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        fx = lambda n: fixture(self.spark, self.sf_dir, f"fx_{n}")
        make = {
            "headers": lambda: fx("http_headers"), "dns": lambda: fx("dns_info"), "tls": lambda: fx("tls_info"),
                "ports": lambda: fx("ports_info"),
            "whois": lambda: fx("whois_info"), "email": lambda: fx("email_security"), "catalog": lambda: fx("cve_catalog"),
            "as_of": lambda: F.lit(AS_OF).cast("date"),
            "classes": lambda: risk.classify(self["domains"], K), "staging": lambda: matching.ns_staging(self["dns"], K),
            "operators": lambda: matching.operator_samples(self["dns"], K).select("operator").join(fx("operator_country"), "operator",
                "left").withColumn("jurisdiction", S.jurisdiction(F.coalesce("country_code", F.lit("")))),
            "sovereign": lambda: risk.sovereignty_score(dealt(self["domains"], K, parts(self["domains"])), self["staging"],
                fx("operator_country").withColumn("jurisdiction", S.jurisdiction(F.coalesce("country_code", F.lit("")))), K),
            "matches": lambda: matching.match_cves(self["domains"], self["ports"], self["catalog"], K),
            # a key's technologies; every query over counts of matches reads them more than once
            "shown": lambda: written(matching.shown(self["domains"], self["ports"], self["catalog"], K), "shown"),
            "critical": lambda: matching.over_matches(self["shown"], self["catalog"], lambda m: m.filter("severity = 'CRITICAL'").select(
                "_set", "severity").distinct()),
            "raw_flags": lambda: risk.risk_flags(
                {"domains": self["sovereign"], "headers": self["headers"], "dns": self["dns"], "tls": self["tls"], "whois": self["whois"],
                "email": self["email"], "ports": self["ports"], "matches": self["critical"]}, AS_OF, K),
            "orphans": lambda: research.orphans(self["dns"], derived(self.spark, self.sf_dir, NAMES)),
            "lookalikes": lambda: self["names"].join(research.with_lookalike(self["names"].select("name").distinct()), "name", "left_semi"),
            "flags": lambda: risk.risk_score(self["raw_flags"]),
                "bench": lambda: risk.sector_benchmarks(self["flags"], self["classes"], K),
            "pairs": lambda: self["dns"].join(self["domains"].select(K, "domain"),
                K).join(matching.ns_hosts(self["dns"], K).select(K, "host"), K, "left").select("domain", "host"),
            "edges": lambda: graph.ns_edges(self["pairs"]), "nodes": lambda: graph.ns_nodes(self["edges"]),
            "index": lambda: graph.index_nodes(self["nodes"]), "indexed": lambda: graph.index_edges(self["edges"], self["index"]),
        }
        self[name] = make[name]() if name in make else fx(name)
        return self[name]


def register(name: str, run: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(Tables(spark, sf_dir))
    if sql:
        ORACLE[name] = with_views(sql)


def on(source: str, name: str, make: Callable[[], list], sql: str) -> None:
    """A scalar rule over a source: a derived table, or SQL over the given tables. sql: select list."""
    end = ")" * (sql.count("FROM (SELECT") - sql.count("FROM (SELECT DISTINCT"))
    if source in FIXTURES:
        register(name, lambda t: t[source[3:]].select(*make()), f"SELECT {sql} FROM {source}{end}")
    else:
        register(name, lambda t: derived(t.spark, t.sf_dir, source).select(*make()), f"SELECT {sql} FROM ({source}){end}")


# ---- D: scalar rules
LINES = ("SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN ' https://a' || o_orderkey || '.ch/path ' WHEN 1 THEN 'http://b.ch.' "
    "WHEN 2 THEN '  ' WHEN 3 THEN 'bad domain.ch' WHEN 4 THEN '..x' || o_orderkey || '.ch..' WHEN 5 THEN 'a,b' WHEN 6 THEN 'www.c' || "
    "o_orderkey || '.ch' ELSE repeat('a', 200 + CAST(o_orderkey % 100 AS INT)) END AS line FROM orders")
on(LINES, "d1_sanitize", lambda: [K, S.sanitize_domain(c("line")).alias("domain")], "k, CASE WHEN h <> '' AND strlen(h) <= 253 AND NOT "
    "regexp_matches(h, '[\\x00-\\x20,\"'']') THEN h END AS domain FROM (SELECT k, "
    "trim(trim(trim(regexp_replace(regexp_replace(trim(line), '^https?://', ''), '/.*$', '')), '.')) AS h")
HOSTS = ("SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'WWW.x.ch' WHEN 1 THEN '127.0.0.' || (o_orderkey % 9) ELSE 'site' || "
    "o_orderkey || '.ch' END AS host FROM orders")
_www = "NOT (starts_with(lower(host), 'www.') OR regexp_matches(host, '^[0-9.]*$'))"
on(HOSTS, "d2_try_www", lambda: [K, S.should_try_www(c("host")).alias("www")], f"k, {_www} AS www")
on(HOSTS, "d3_candidate_urls", lambda: [K, F.array_join(S.candidate_urls(c("host")), " ").alias("urls")], f"k, CASE WHEN {_www} THEN "
    f"'https://' || host || ' https://www.' || host || ' http://' || host || ' http://www.' || host ELSE 'https://' || host || ' "
    f"http://' || host END AS urls")
on("fx_dns_info", "d4_dedupe_sorted",
    lambda: [K, F.array_join(S.dedupe_sorted(F.concat(S.parse_json_array(c("ns")), S.parse_json_array(c("mx")))), " ").alias("hosts")],
    f"k, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat({LIST.format('ns')}, {LIST.format('mx')}), "
    f"lambda x: trim(regexp_replace(trim(x), '\\.+$', ''))), lambda x: x <> ''))), ' ') AS hosts")
_title = "regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')"
on("fx_pages", "d5_title", lambda: ["page_id", S.extract_title(c("html")).alias("title")], "page_id, "
    "nullif(trim(replace(replace(replace(replace(replace(replace(" + _title + ", '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', "
    "'\"'), '&#39;', ''''), '&apos;', '''')), '') AS title")
on("fx_pages", "d6_body_hash", lambda: ["page_id", S.body_hash(c("html")).alias("hash")],
    "page_id, CASE WHEN html <> '' THEN md5(html) END AS hash")
PAGES = ("SELECT page_id, html, CASE page_id % 5 WHEN 0 THEN 'PHP/8.2' WHEN 1 THEN 'Drupal 9' END AS powered_by, CASE page_id % 3 WHEN 0 "
    "THEN 'Apache/2.4' WHEN 1 THEN 'nginx' END AS server FROM (" + FIXTURES["fx_pages"].strip() + ") p")
on(PAGES, "d7_cms", lambda: ["page_id", S.detect_cms(c("powered_by"), c("html"), c("server")).alias("cms")], "page_id, CASE WHEN "
    "contains(pb, 'drupal') THEN 'Drupal' WHEN starts_with(pb, 'php') THEN 'php' WHEN contains(b, 'wp-content/') THEN 'WordPress' WHEN "
    "contains(b, 'typo3conf/') THEN 'TYPO3' WHEN contains(s, 'apache') THEN 'apache' WHEN contains(s, 'nginx') THEN 'nginx' END AS cms "
    "FROM (SELECT page_id, lower(html) AS b, lower(coalesce(powered_by, '')) AS pb, lower(coalesce(server, '')) AS s")
on("fx_dns_info", "d8_pick_spf",
    lambda: [K, S.pick_spf(F.array(F.lit("other"), c("txt_dmarc"), F.upper("txt_spf"), c("txt_spf"))).alias("spf")], "k, "
    "list_filter(['other', txt_dmarc, upper(txt_spf), txt_spf], lambda x: starts_with(lower(x), 'v=spf1'))[1] AS spf")
_tok = "list_filter(regexp_split_to_array(lower(coalesce(txt_spf, '')), '\\s+'), lambda x: x <> '')"
_all = f"list_filter({_tok}, lambda x: regexp_replace(x, '^[+?~-]', '') = 'all')[-1]"
_look = f"len(list_filter({_tok}, lambda x: regexp_matches(x, '^(include:.*|redirect=.*|exists:.*|[+?~-]?(a|mx)([:/].*)?)$')))"
on("fx_dns_info", "d9_d10_spf", lambda: [K, F.inline(F.array(S.parse_spf(c("txt_spf"))))], f"k, coalesce(txt_spf, '') <> '' AS present, "
    f"{_all} AS policy, coalesce(regexp_extract({_all}, '^[+?~-]?') IN ('+', '?', ''), false) AS too_permissive, CAST({_look} AS INT) AS "
    f"dns_lookups, {_look} > 10 AS over_limit")
_tag = lambda n: f"nullif(regexp_extract(';' || replace(coalesce(txt_dmarc, ''), ' ', ''), '(?i);{n}=([^;]*)', 1), '')"
_dm = "starts_with(lower(coalesce(txt_dmarc, '')), 'v=dmarc1')"
on("fx_dns_info", "d11_dmarc", lambda: [K, F.inline(F.array(S.parse_dmarc(c("txt_dmarc"))))], f"k, {_dm} AS present, CASE WHEN {_dm} "
    f"THEN {_tag('p')} END AS policy, CASE WHEN {_dm} THEN {_tag('sp')} END AS subdomain_policy, {_dm} AND contains(lower(txt_dmarc), "
    f"'rua=') AS has_reporting, CASE WHEN {_dm} THEN TRY_CAST({_tag('pct')} AS INT) END AS pct")


def duck(sql: str) -> str:
    """SQL with arrays of strings and of (oid, value) structs, as DuckDB writes them."""
    sql = re.sub(r"named_struct\('oid', ('[^']*'), 'value', ('[^']*')\)", r"{'oid': \1, 'value': \2}", sql)
    return sql.replace("array(", "list_value(")


KEYS = """SELECT o_orderkey AS k,
 CASE o_orderkey % 6 WHEN 0 THEN array('v=DKIM1; k=rsa') WHEN 1 THEN array('x') WHEN 2 THEN array('p=1', 'v=DKIM1;p=2') WHEN 3 THEN NULL
 WHEN 4 THEN array('v=dkim1') ELSE array('a', 'b v=DKIM1') END AS a,
 CASE o_orderkey % 5 WHEN 0 THEN array('p=1', 'v=DKIM1') WHEN 1 THEN array('') WHEN 2 THEN array('v=DKIM2') END AS b FROM orders"""
_dkim = "coalesce(len(list_filter({0}, lambda x: contains(x, 'v=DKIM1'))) > 0, false)"
register(
    "d12_dkim", lambda t: derived(t.spark, t.sf_dir, KEYS).select(K, F.inline(F.array(S.dkim_flags(c("a"), c("b"))))),
    f"""SELECT k, {_dkim.format("a")} AS dkim_default, {_dkim.format("b")} AS dkim_google, {_dkim.format("a")}
 OR {_dkim.format("b")} AS dkim_found
 FROM ({duck(KEYS)})""",
)
_line = r"nullif(trim(regexp_extract(text, '(?im)^[ \t]*(?:{0})\s*([^\r\n]*)', 1)), '')"
_day = "CAST(coalesce(try_strptime({0}, '%Y-%m-%d'), try_strptime(substr({0}, 1, 10), '%Y-%m-%d')) AS DATE)"
_expires, _created = _line.format("expiration date:|expires:|expiry date:"), _line.format("first registration date:")
_signed = f"lower({_line.format('dnssec:')})"
register(
    "d13_whois", lambda t: t["whois_raw"].select(K, F.inline(F.array(S.parse_whois(c("text"))))),
    f"""SELECT k, {_line.format("registrar:")} AS registrar, {_day.format(f"trim(regexp_replace({_created}, '^(before)+', ''))")} AS created,
 {_day.format(_expires)} AS expires, {_line.format("state:|status:")} AS status,
 {_signed} = 'y' OR starts_with({_signed}, 'yes') OR starts_with({_signed}, 'signed') AS dnssec_delegated FROM fx_whois_raw""",
)
on("fx_tls_info", "d14_cert_status",
    lambda: [K, F.inline(F.array(S.cert_status(c("valid_to"), c("cert_issuer"), c("cert_subject"), F.lit(AS_OF).cast("date"))))], f"k, "
    f"CAST(valid_to - DATE '{AS_OF}' AS INT) AS days_remaining, valid_to < DATE '{AS_OF}' AS expired, cert_issuer = cert_subject AS "
    f"self_signed")
CURVE = "CASE WHEN k % 20 = 0 THEN '1.3.132.0.34' ELSE '1.2.840.10045.3.1.7' END"
on("fx_tls_info", "d15_key_alg", lambda: [K, F.inline(F.array(S.key_alg(c("key_oid"), F.expr(CURVE), c("key_size"))))], "k, CASE key_oid "
    "WHEN '1.2.840.113549.1.1.1' THEN 'RSA' WHEN '1.3.101.112' THEN 'Ed25519' ELSE CASE WHEN k % 20 = 0 THEN 'P-384' ELSE 'P-256' END "
    "END AS algorithm, CASE key_oid WHEN '1.2.840.113549.1.1.1' THEN key_size WHEN '1.3.101.112' THEN 256 ELSE CASE WHEN k % 20 = 0 THEN "
    "384 ELSE 256 END END AS size")
_oids = (*SIGNATURE_OIDS, "1.2.3", "", "1.2.840.113549.1.1.5")
SIGS = (f"SELECT o_orderkey AS k, CASE o_orderkey % {len(_oids) + 1} " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(_oids))
    + " END AS oid FROM orders")
_names = " ".join(f"WHEN '{o}' THEN '{n}'" for o, n in SIGNATURE_OIDS.items())
on(SIGS, "d16_sig_alg", lambda: [K, S.sig_alg(c("oid")).alias("name")], f"k, CASE oid {_names} ELSE oid END AS name")
EXTS = """SELECT o_orderkey AS k, CASE o_orderkey % 6
 WHEN 0 THEN array(named_struct('oid', '1.3.6.1.4.1.11129.2.4.2', 'value', '00'), named_struct('oid', '1.3.6.1.5.5.7.1.24', 'value', '3003020105'))
 WHEN 1 THEN array(named_struct('oid', '1.3.6.1.5.5.7.1.24', 'value', '3003020106'))
 WHEN 2 THEN array(named_struct('oid', '2.5', 'value', ''))
 WHEN 3 THEN array(named_struct('oid', '2.5', 'value', '020105'), named_struct('oid', '1.3.6.1.4.1.11129.2.4.2', 'value', ''))
 WHEN 4 THEN array(named_struct('oid', '1.3.6.1.5.5.7.1.24', 'value', '3006020105020111'), named_struct('oid', '1.3', 'value', '1'))
 ELSE array(named_struct('oid', '1.3.6.1.5.5.7.1.24', 'value', '')) END AS exts FROM orders"""
register(
    "d17_cert_exts", lambda t: derived(t.spark, t.sf_dir, EXTS).select(K, F.inline(F.array(S.cert_ext_flags(c("exts"))))),
    f"""SELECT k, len(list_filter(exts, lambda e: e.oid = '{SCT_OID}')) > 0 AS ct_logged,
 CASE WHEN len(f) > 0 THEN contains(lower(f[1].value), '020105') END AS must_staple
 FROM (SELECT k, exts, list_filter(exts, lambda e: e.oid = '{TLS_FEATURE_OID}') AS f FROM ({duck(EXTS)}))""",
)
EPOCHS = "SELECT o_orderkey AS k, (o_orderkey - 500) * 86400 + 7 AS epoch FROM orders"
on(EPOCHS, "d18_asn1_date", lambda: [K, S.asn1_date(c("epoch")).alias("day")], "k, DATE '1970-01-01' + CAST(k - 500 AS INT) AS day")
on("fx_ports_info", "d19_service", lambda: [K, "port", S.service_name(c("port")).alias("service")],
    "k, port, CASE port " + " ".join(f"WHEN {p} THEN '{s}'" for p, s in SERVICES.items()) + " ELSE 'unknown' END AS service")
IPS = """SELECT o_orderkey AS k, CASE o_orderkey % 12 WHEN 0 THEN '10.1.2.3'
 WHEN 1 THEN '172.' || CAST(o_orderkey % 40 AS STRING) || '.0.1'
 WHEN 2 THEN '192.' || CAST(160 + o_orderkey % 10 AS STRING) || '.0.1' WHEN 3 THEN '::1' WHEN 4 THEN '2001:db8::1' WHEN 5 THEN 'nope'
 WHEN 6 THEN '169.' || CAST(250 + o_orderkey % 5 AS STRING) || '.1.1' WHEN 7 THEN '255.255.255.255' WHEN 8 THEN '::'
 WHEN 9 THEN '300.1.1.1'
 ELSE CAST(o_orderkey % 256 AS STRING) || '.' || CAST(o_orderkey * 7 % 256 AS STRING) || '.8.' || CAST(o_orderkey % 250 AS STRING) END AS ip
 FROM orders"""
_octet = lambda i: f"CAST(split_part(ip, '.', {i}) AS INT)"
_dotted = "regexp_matches(ip, '^[0-9]{1,3}([.][0-9]{1,3}){3}$')"
_inner = f"""{_octet(1)} IN (0, 10, 127) OR ({_octet(1)} = 172 AND {_octet(2)} BETWEEN 16 AND 31) OR ({_octet(1)} = 192
 AND {_octet(2)} = 168)
 OR ({_octet(1)} = 169 AND {_octet(2)} = 254) OR ip = '255.255.255.255'"""
on(
    IPS, "d20_public_ip", lambda: [K, S.is_public_ip(c("ip")).alias("public")],
    f"""k, CASE WHEN {_dotted} THEN CASE WHEN {" OR ".join(f"{_octet(i)} > 255" for i in (1, 2, 3, 4))} THEN false ELSE NOT ({_inner}) END
 WHEN contains(ip, ':') THEN ip NOT IN ('::', '::1') ELSE false END AS public""",
)
_said = ("TLS Handshake failed", "dns error: No such host", "Connection refused", "operation timed out", "invalid DNS name",
    "broken pipe", "SSL")
_said += ("name or service not known", "failed to lookup address", "read timeout", "Bad Certificate", "REFUSED by peer", "",
    "server said dns")
ERRORS = (
    f"SELECT o_orderkey AS k, CASE o_orderkey % {len(_said)} " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_said))
    + " END AS msg, o_orderkey % 11 = 0 AS is_timeout, o_orderkey % 4 < 2 AS is_connect FROM orders"
)
_says = lambda words: "(" + " OR ".join(f"contains(lower(msg), '{w}')" for w in words) + ")"
on(
    ERRORS, "d21_http_error", lambda: [K, S.classify_http_error(c("msg"), c("is_timeout"), c("is_connect")).alias("kind")],
    f"""k, CASE WHEN is_timeout THEN 'timeout' WHEN {_says(TLS_WORDS)} THEN 'tls_failed' WHEN is_connect
 AND {_says(("dns", *LOOKUP_WORDS))} THEN 'dns'
 WHEN is_connect AND {_says(("refused",))} THEN 'refused' ELSE 'other' END AS kind""",
)
_io = lambda: F.when(c("k") % 5 == 0, "timed_out").when(c("k") % 5 == 1, "connection_refused").otherwise("")
on(
    ERRORS, "d22_dns_io_error",
    lambda: [K, S.classify_dns_error(c("msg"), c("is_timeout")).alias("dns"), S.classify_io_error(c("msg"), _io()).alias("io")],
    f"""k, CASE WHEN is_timeout THEN 'not_found' WHEN {_says(("timed out", "timeout"))} THEN 'timeout'
 WHEN {_says(("refused",))} THEN 'refused'
 ELSE 'dns' END AS dns, CASE k % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'refused' ELSE CASE WHEN {_says(LOOKUP_WORDS)} THEN 'dns'
 ELSE 'other' END END AS io""",
)
LOOKUPS = """SELECT o_orderkey AS k, array(CASE WHEN o_orderkey % 2 = 0 THEN 'timeout' WHEN o_orderkey % 7 = 0 THEN 'refused' END,
 CASE WHEN o_orderkey % 3 = 0 THEN 'dns' END, CASE WHEN o_orderkey % 5 < 4 THEN 'dns' END, 'refused') AS errors FROM orders"""
_failed = "len(list_filter(errors, lambda e: e IS NULL)) = 0"
register(
    "d23_dns_status", lambda t: derived(t.spark, t.sf_dir, LOOKUPS).select(K, F.inline(F.array(S.dns_status(c("errors"))))),
    f"SELECT k, CASE WHEN {_failed} THEN 'error' ELSE 'ok' END AS status, CASE WHEN {_failed} THEN errors[1] END AS error_kind FROM "
        f"({duck(LOOKUPS)})",
)
on("fx_domains", "d24_http_error_kind", lambda: [K, S.http_error_kind(c("status_code"), c("error_kind")).alias("kind")], "k, CASE WHEN "
    "status_code >= 400 THEN 'http_status' ELSE error_kind END AS kind")
on("fx_domains", "d25_redirects",
    lambda: [K, F.array_join(S.redirect_chain(F.concat(F.lit("https://"), c("domain"), F.lit("/")), c("final_url")), " ").alias("chain")],
    "k, CASE WHEN 'https://' || domain || '/' <> final_url THEN 'https://' || domain || '/' ELSE '' END AS chain")
register("d26_extract_version",
    lambda t: t["ports"].select(K, "port", S.extract_version(c("banner"), S.banner_technology(c("port"), c("banner"))).alias("version")),
    "SELECT k, port, version FROM v_services")
on("fx_domains", "d27_server_version", lambda: [K, S.server_version(c("server"), F.lit("apache")).alias("version")], "k, CASE WHEN "
    "strpos(lower(server), 'apache/') > 0 THEN split_part(substr(lower(server), strpos(lower(server), 'apache/') + 7), ' ', 1) END AS "
    "version")
VERS = ("SELECT o_orderkey AS k, CAST(o_orderkey % 12 AS STRING) || '.' || CAST(o_orderkey % 7 AS STRING) || CASE o_orderkey % 3 WHEN 0 "
    "THEN 'p1' WHEN 1 THEN '.' || CAST(o_orderkey % 30 AS STRING) ELSE '' END AS v FROM orders")
on(VERS, "d28_version_key", lambda: [K, F.array_join(S.version_key(c("v")).cast("array<string>"), " ").alias("key")],
    f"k, array_to_string({KEY_OF.format('v')}, ' ') AS key")
on(VERS, "d29_version_range", lambda: [K, S.version_in_range(c("v"), F.lit("3.2"), F.when(c("k") % 2 == 0, "8.5.1")).alias("inside")],
    f"k, {KEY_OF.format('v')} >= {KEY_OF.format(chr(39) + '3.2' + chr(39))} AND (k % 2 <> 0 OR {KEY_OF.format('v')} <= "
    f"{KEY_OF.format(chr(39) + '8.5.1' + chr(39))}) AS inside")
register("d30_ns_operator", lambda t: matching.ns_hosts(t["dns"], K), "SELECT k, host, operator FROM v_hosts")
on("fx_domains", "d31_jurisdiction", lambda: [K, S.jurisdiction(F.coalesce("country_code", F.lit(""))).alias("jurisdiction")], f"k, "
    f"{JURISDICTION} AS jurisdiction FROM (SELECT k, country_code AS cc")
on("fx_dns_info", "d32_json_array",
    lambda: [K, F.size(S.parse_json_array(F.when(c("k") % 17 == 0, "no json").otherwise(c("ns")))).alias("n")], "k, CASE WHEN k % 17 = 0 "
    "OR ns = '[]' THEN 0 ELSE 2 END AS n")
register("d33_registrable",
    lambda t: matching.ns_hosts(t["dns"], K).select(K, "host", S.registrable_domain(c("host")).alias("registrable")), "SELECT k, host, "
    "array_to_string(string_split(regexp_replace(host, '\\.+$', ''), '.')[-2:], '.') AS registrable FROM v_hosts")
register("d33_public_suffix",
    lambda t: matching.registrable(t["domains"].select(K, F.concat(F.lit("a.b."), F.col("domain"), F.lit(".")).alias("host")), "host",
    t["suffixes"]).select(K, "registrable"), "SELECT k, domain AS registrable FROM fx_domains")
register("d33_suffix_rules", lambda t: matching.registrable(t["rule_hosts"], "host", t["suffix_rules"]).select(K, "registrable"), r"""
WITH h AS (SELECT DISTINCT host, lower(rtrim(host, '.')) AS low FROM fx_rule_hosts WHERE host IS NOT NULL),
m AS (SELECT host, low, suffix LIKE '!%' AS exception, len(string_split(suffix, '.')) - CAST(suffix LIKE '!%' AS INT) AS n
  FROM h JOIN fx_suffix_rules ON regexp_matches(low, '(^|\.)' || replace(replace(replace(suffix, '!', ''), '.', '\.'), '*', '[^.]+') || '$')),
b AS (SELECT host, max({'e': exception, 'n': n}) AS best FROM m GROUP BY host),
r AS (SELECT host, string_split(low, '.') AS labels, best['n'] AS n FROM h LEFT JOIN b USING (host))
SELECT k, array_to_string(CASE WHEN len(labels) > n THEN labels[-(n + 1):] ELSE labels[-2:] END, '.') AS registrable
FROM fx_rule_hosts LEFT JOIN r USING (host)""")
register("d34_technology", lambda t: t["ports"].select(K, "port", S.banner_technology(c("port"), c("banner")).alias("technology")),
    "SELECT k, port, technology FROM v_services")
OWN = ("SELECT 'op' || CAST(o_orderkey % 37 AS STRING) || '.net' AS domain, '[\"ns1.op' || CAST(o_orderkey % 37 AS STRING) || "
    "'.net.\",\"ns2.hostpoint.ch\"]' AS ns, '[\"MX.op' || CAST(o_orderkey % 37 AS STRING) || '.net\"]' AS mx FROM orders")
register("d35_harvest", lambda t: matching.harvest_subdomains(derived(t.spark, t.sf_dir, OWN)), "SELECT DISTINCT 'op' || CAST(o_orderkey "
    "% 37 AS STRING) || '.net' AS domain, unnest(['ns1.op' || CAST(o_orderkey % 37 AS STRING) || '.net', 'mx.op' || CAST(o_orderkey % 37 "
    "AS STRING) || '.net']) AS subdomain, 'mx_ns' AS source FROM orders")
register("d36_combine",
    lambda t: (
    lambda s: matching.combine_subdomains(s.filter("k % 3 = 0").withColumn("source", F.lit("ct")),
    s.filter("k % 2 = 0").withColumn("source", F.lit("axfr")), s.withColumn("source", F.lit("mx_ns"))))(
    t["subdomains"].select(K, c(K).cast("string").alias("domain"), "subdomain")), "SELECT CAST(k AS STRING) AS domain, subdomain, CASE "
    "WHEN k % 3 = 0 THEN 'ct' WHEN k % 2 = 0 THEN 'axfr' ELSE 'mx_ns' END AS source FROM fx_subdomains")

# ---- B: pending work
register("b1_pending_http", lambda t: work.pending_http(t["domains"]).select(K, "domain"),
    "SELECT k, domain FROM fx_domains WHERE updated_at IS NULL")
register("b2_pending_dns",
    lambda t: work.pending(t["domains"], t["dns"].withColumn("resolved_at", F.when(c(K) % 10 > 0, c("resolved_at"))), "resolved_at",
    K).select(K), "SELECT k FROM fx_domains WHERE k NOT IN (SELECT k FROM fx_dns_info WHERE k % 10 > 0)")
register("b3_retry", lambda t: work.retry_targets(t["domains"], "timeout").select(K),
    "SELECT k FROM fx_domains WHERE error_kind = 'timeout'")
register("b4_pending_whois", lambda t: work.pending(t["domains"], t["whois"], None, K).select(K), "SELECT k FROM fx_domains WHERE k NOT "
    "IN (SELECT k FROM fx_whois_info)")
register("b5_pending_subdomains", lambda t: work.pending(t["domains"], t["subdomains"], None, K).select(K), "SELECT k FROM fx_domains d "
    "WHERE NOT EXISTS (SELECT 1 FROM fx_subdomains s WHERE s.k = d.k)")
_scanned = (
    lambda t: t["domains"].withColumns(
    {"ports_scanned_at": F.when(c(K) % 3 > 0, c("updated_at")), "ports_targeted_at": F.when(c(K) % 5 > 1, c("updated_at"))}))
register("b6_pending_ports", lambda t: work.pending_ports(_scanned(t)).select(K), "SELECT k FROM fx_domains WHERE k % 3 = 0 OR "
    "updated_at IS NULL")
register("b6_pending_targeted", lambda t: work.pending_ports(_scanned(t), targeted=True).select(K), "SELECT k FROM fx_domains WHERE k % "
    "5 <= 1 OR updated_at IS NULL")
register("b7_banner_backlog",
    lambda t: work.banner_backlog(t["ports"], K).select(K,
    F.array_join(F.transform("targets", lambda x: F.concat_ws("@", x["port"].cast("string"), x["ip"])), ",").alias("targets")), f"SELECT "
    f"k, string_agg(port || '@' || ip, ',' ORDER BY port, ip) AS targets FROM fx_ports_info WHERE banner IS NULL AND ip <> '127.0.0.1' "
    f"AND port IN {BANNER_PORTS} GROUP BY k")
register("b8_unclassified", lambda t: work.unclassified(t["domains"], t["classes"], K).select(K), "SELECT k FROM fx_domains WHERE k NOT "
    "IN (SELECT k FROM v_classes)")
register("b9_geocode_backlog", lambda t: work.geocode_backlog(t["domains"]).select(K), "SELECT k FROM fx_domains WHERE ip IS NOT NULL "
    "AND country_code IS NULL")
register("b10_unresolved", lambda t: work.unresolved_operators(matching.operator_samples(t["dns"], K), t["operator_country"]), "SELECT "
    "operator, min(host) AS sample_ns FROM v_hosts WHERE operator NOT IN (SELECT operator FROM fx_operator_country) GROUP BY operator")

# ---- C: merges
_cur = lambda t: t["domains"].select(K, "status", "server")
register("c1_replace", lambda t: merge.merge_replace(_cur(t), t["snapshot_2"], [K]), "SELECT k, status, server FROM fx_snapshot_2 UNION "
    "ALL SELECT k, status, server FROM fx_domains WHERE k NOT IN (SELECT k FROM fx_snapshot_2)")


def _bucketed(t: Tables) -> DataFrame:
    """The merge into a table of hash buckets, its first version being the current rows."""
    table = versions.BucketTable(t.spark, f"{shared_folder(t.spark)}/c1-{uuid.uuid4().hex}", [K], buckets=16)
    table.merge(_cur(t))
    table.merge(t["snapshot_2"].select("k", "status", "server"))
    return table.read()


register("c1_bucketed", _bucketed, "SELECT k, status, server FROM fx_snapshot_2 UNION "
    "ALL SELECT k, status, server FROM fx_domains WHERE k NOT IN (SELECT k FROM fx_snapshot_2)")
register("c2_coalesce", lambda t: merge.merge_coalesce(_cur(t), t["snapshot_2"], [K], ["server"]), "SELECT coalesce(n.k, c.k) AS k, CASE "
    "WHEN n.k IS NOT NULL THEN n.status ELSE c.status END AS status, coalesce(n.server, c.server) AS server FROM fx_domains c FULL JOIN "
    "fx_snapshot_2 n ON n.k = c.k")
register("c3_ignore", lambda t: merge.merge_ignore(_cur(t), t["snapshot_2"], [K]), "SELECT k, status, server FROM fx_domains UNION ALL "
    "SELECT k, status, server FROM fx_snapshot_2 WHERE k NOT IN (SELECT k FROM fx_domains)")
register("c4_update", lambda t: merge.merge_update(_cur(t), t["snapshot_2"], K, ["status", "server"]), "SELECT c.k, CASE WHEN n.k IS "
    "NULL THEN c.status ELSE n.status END AS status, CASE WHEN n.k IS NULL THEN c.server ELSE n.server END AS server FROM fx_domains c "
    "LEFT JOIN fx_snapshot_2 n ON n.k = c.k")
register("c5_backfill_ip", lambda t: merge.backfill_port_ip(t["ports"], t["domains"], K).select(K, "port", "ip"), "SELECT p.k, p.port, "
    "CASE WHEN (p.ip IS NULL OR p.ip = '127.0.0.1') AND d.ip IS NOT NULL AND d.ip <> '127.0.0.1' THEN d.ip ELSE p.ip END AS ip FROM "
    "fx_ports_info p LEFT JOIN fx_domains d USING (k)")
register("c6_unpivot", lambda t: merge.unpivot_ports(t["ports_legacy"], K), "SELECT k, 80 AS port, 'http' AS service FROM "
    "fx_ports_legacy WHERE p80 = 1 UNION ALL SELECT k, 443, 'https' FROM fx_ports_legacy WHERE p443 = 1 UNION ALL SELECT k, 22, 'ssh' "
    "FROM fx_ports_legacy WHERE p22 = 1 UNION ALL SELECT k, 21, 'ftp' FROM fx_ports_legacy WHERE p21 = 1")
register("c7_backfill_scanned",
    lambda t: merge.backfill_ports_scanned(t["domains"].select(K),
    t["ports"].withColumn("scanned_at", F.date_add(F.lit(AS_OF).cast("date"), (c("port") % 100).cast("int"))), K), f"SELECT k, max(DATE "
    f"'{AS_OF}' + CAST(port % 100 AS INT)) AS ports_scanned_at FROM fx_domains LEFT JOIN fx_ports_info USING (k) GROUP BY k")
register("c8_open_only", lambda t: merge.open_only(t["ports"].withColumn("open", F.when(c(K) % 7 > 0, c(K) % 2))).select(K, "port"),
    "SELECT k, port FROM fx_ports_info WHERE k % 7 > 0 AND k % 2 = 1")
register("c9_denormalise", lambda t: merge.denormalise_whois(t["domains"], t["whois"], K).select(K, "whois_registrar", "whois_created"),
    "SELECT k, registrar AS whois_registrar, whois_created FROM fx_domains LEFT JOIN fx_whois_info USING (k)")

# ---- A: sources that SQL can state
def _imported(t: Tables, on_conflict: str) -> DataFrame:
    """Every second order with another status, and the orders file imported over it."""
    old = t.spark.read.parquet(f"{t.sf_dir}/orders.parquet").filter("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("old"))
    now = sources.import_tables(t.spark, t.sf_dir, {"orders": old, "nothing": old}, {"orders": ["o_orderkey"]}, (), on_conflict)
    return now["orders"].select("o_orderkey", "o_orderstatus", "o_custkey")


register("a3_import", lambda t: _imported(t, "replace"), "SELECT o_orderkey, o_orderstatus, o_custkey FROM orders")
register("a3_import_ignore", lambda t: _imported(t, "ignore"), "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE "
    "o_orderstatus END AS o_orderstatus, o_custkey FROM orders")
FEED = """SELECT array(named_struct('cveID', CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'CVE-' || CAST(o_orderkey AS STRING) END,
 'vendorProject', CASE o_orderkey % 6 WHEN 0 THEN 'Microsoft' WHEN 1 THEN 'Apache' WHEN 2 THEN NULL WHEN 3 THEN 'Nobody'
 WHEN 4 THEN 'Craft CMS' ELSE 'Oracle' END,
 'product', CASE o_orderkey % 4 WHEN 0 THEN 'SQL Server' WHEN 1 THEN 'Tomcat' WHEN 2 THEN 'MySQL' ELSE NULL END,
 'shortDescription', 'text ' || CAST(o_orderkey AS STRING), 'dateAdded', '2021-01-02')) AS vulnerabilities FROM orders"""
_kev_tech = " ".join(f"WHEN contains(b, '{n}') THEN '{'mssql' if n == 'sql server' else n}'" for n in KEV_VENDORS)
register(
    "a4_kev_feed", lambda t: sources.ingest_kev(derived(t.spark, t.sf_dir, FEED)),
    f"""SELECT * FROM (SELECT cve_id,
 CASE {_kev_tech} END AS technology, 'CRITICAL' AS severity, true AS in_kev, summary, '2021-01-02' AS published_at FROM (
 SELECT CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'CVE-' || o_orderkey END AS cve_id, 'text ' || o_orderkey AS summary,
 lower(coalesce(CASE o_orderkey % 6 WHEN 0 THEN 'Microsoft' WHEN 1 THEN 'Apache' WHEN 3 THEN 'Nobody' WHEN 4 THEN 'Craft CMS'
 WHEN 5 THEN 'Oracle' END, '') || ' '
 || coalesce(CASE o_orderkey % 4 WHEN 0 THEN 'SQL Server' WHEN 1 THEN 'Tomcat' WHEN 2 THEN 'MySQL' END, '')) AS b FROM orders))
 WHERE technology IS NOT NULL AND cve_id <> ''""",
)
LOG = ("SELECT 'op' || CAST(o_orderkey % 37 AS STRING) || '.net' AS apex, ' A' || CAST(o_orderkey AS STRING) || '.op' || CAST(o_orderkey "
    "% 37 AS STRING) || '.net' || chr(10) || '*.OP' || CAST(o_orderkey % 37 AS STRING) || '.net ' || chr(10) || 'op' || CAST(o_orderkey "
    "% 37 AS STRING) || '.net' || chr(10) || 'x.other.net' AS name_value FROM orders")
register("a5_certificate_log", lambda t: sources.ingest_ct(derived(t.spark, t.sf_dir, LOG)), "SELECT DISTINCT 'op' || o_orderkey % 37 || "
    "'.net' AS domain, unnest(['a' || o_orderkey || '.op' || o_orderkey % 37 || '.net', '*.op' || o_orderkey % 37 || '.net']) AS "
    "subdomain, 'ct' AS source FROM orders")
HAVE = ("SELECT c.technology, c.cve_id, 'LOW' AS severity, 1.0D AS cvss_score, '0' AS affected_from, '1' AS affected_to, 'old' AS "
    "summary, true AS in_kev, '2020-02-02' AS published_at FROM (SELECT DISTINCT CAST(o_orderkey % 90 AS INT) AS i FROM orders) o JOIN "
    "(SELECT technology, cve_id, row_number() OVER (ORDER BY cve_id, technology) AS i FROM (" + FIXTURES["fx_cve_catalog"].strip() + ") "
    "x WHERE cvss_score IS NOT NULL) c ON c.i = o.i AND c.i % 2 = 0 UNION ALL SELECT 'own', 'OWN-' || CAST(o_orderkey AS STRING), 'LOW', "
    "1.0D, '0', '1', 'own', false, NULL FROM orders")
_seed = (
    ", ".join("("
    + ", ".join("NULL" if v is None else str(v) if isinstance(v, float) else "'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r
    in SEED))
register("a7_seed_catalog", lambda t: sources.seed_catalog(t.spark, derived(t.spark, t.sf_dir, HAVE)), f"""
WITH have AS ({HAVE.replace("1.0D", "CAST(1 AS DOUBLE)")}), seed(technology, cve_id, severity, cvss_score, affected_from, affected_to, summary) AS (VALUES {_seed})
SELECT s.technology, s.cve_id, s.severity, CAST(s.cvss_score AS DOUBLE) AS cvss_score, s.affected_from, s.affected_to, s.summary, coalesce(h.in_kev, false) AS in_kev, h.published_at
FROM seed s LEFT JOIN have h USING (cve_id)
 UNION ALL SELECT technology, cve_id, severity, cvss_score, affected_from, affected_to, summary, in_kev, published_at FROM have
 WHERE cve_id NOT IN (SELECT cve_id FROM seed)""")
SHOWN = ("domains", "headers", "dns", "tls", "ports", "whois", "email", "subdomains", "classes", "scores")


def _shown(t: Tables) -> DataFrame:
    """How many rows each of the ten tables has of one domain."""
    names = t["domains"].select(K, F.col("domain"))
    tables = {n: t["flags" if n == "scores" else n].drop("domain").join(names, K) for n in SHOWN}
    out = None
    for name, df in sources.show_domain(tables, "kantonalbank-12.ch").items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_k12 = "(SELECT k FROM fx_domains WHERE domain = 'kantonalbank-12.ch')"
_of = {"domains": "fx_domains", "headers": "fx_http_headers", "dns": "fx_dns_info", "tls": "fx_tls_info", "ports": "fx_ports_info",
    "whois": "fx_whois_info", "email": "fx_email_security", "subdomains": "fx_subdomains", "classes": "v_classes", "scores": "v_flags"}
register("a8_show", _shown,
    " UNION ALL ".join(f"SELECT '{n}' AS table, count(*) AS n FROM {v} WHERE k IN {_k12}" for n, v in _of.items()))
register("a10_markdown", lambda t: sources.pages_to_markdown(t["pages"]))
PLAIN = """SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 5 = 0 THEN 404 ELSE 200 END AS status_code, CASE WHEN o_orderkey % 11 > 0 THEN
 '<html><head><title>t</title></head><body><h2>Order ' || CAST(o_orderkey AS STRING) || ' &amp; more</h2><p>Status  ' || chr(10)
 || o_orderstatus || ', <a href="/o/' || CAST(o_orderkey AS STRING) || '">its page</a>.</p><script>no()</script><ul><li>one</li><li>two</li></ul></body></html>'
 ELSE '' END AS html FROM orders"""
register("a10_plain", lambda t: (lambda pages: sources.pages_to_markdown(pages, pages.filter("page_id % 7 = 0")))(derived(t.spark, t.sf_dir, PLAIN)),
    "SELECT o_orderkey AS page_id, '## Order ' || o_orderkey || ' & more' || repeat(chr(10), 2) || 'Status ' || o_orderstatus || ', [its page](/o/' "
    "|| o_orderkey || ').' || repeat(chr(10), 2) || '- one' || chr(10) || '- two' AS markdown FROM orders WHERE o_orderkey % 5 > 0 AND "
    "o_orderkey % 7 > 0 AND o_orderkey % 11 > 0")


def _place(t: Tables, label: str) -> str:
    return f"{shared_folder(t.spark)}/{label}-{uuid.uuid4().hex}"


def _listed(t: Tables) -> DataFrame:
    """The lines written as a text file and loaded as a domain list."""
    path = _place(t, "list")
    derived(t.spark, t.sf_dir, LINES).select("line").filter("line IS NOT NULL").write.text(path)
    return sources.load_domain_list(t.spark, path)


EXPORTED = ("domains", "dns", "ports")


def _exported(t: Tables) -> DataFrame:
    """Rows and keys of the tables that an export wrote, one of them excluded."""
    folder, out = _place(t, "export"), None
    for name in sources.export_tables({n: t[n] for n in (*EXPORTED, "tls")}, folder, ("tls",)):
        one = t.spark.read.parquet(f"{folder}/{name}.parquet").agg(F.count("*").alias("n"), F.sum(F.col(K).cast("long")).alias("keys"))
        one = one.select(F.lit(name).alias("table"), "n", "keys")
        out = one if out is None else out.unionByName(one)
    return out


CELLS = """SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'Dominio,ns' WHEN o_orderkey % 3 = 0 THEN 'd' || CAST(o_orderkey AS STRING) || '.ch,'
 WHEN o_orderkey % 3 = 1 THEN '"d' || CAST(o_orderkey AS STRING) || ', x.ch","n""s' || CAST(o_orderkey % 7 AS STRING) || '"'
 ELSE 'd' || CAST(o_orderkey AS STRING) || '.ch,ns' || CAST(o_orderkey % 7 AS STRING) || '.net' END AS value FROM orders"""


def _cells(t: Tables) -> DataFrame:
    """Lines with and without quotes, hosts and headers, written as a file and read as nameserver CSV."""
    path = _place(t, "cells")
    derived(t.spark, t.sf_dir, CELLS).write.text(path)
    return sources.read_ns_csv(t.spark, path)


def _graph_file(t: Tables, name: str) -> DataFrame:
    folder = _place(t, "graph")
    sources.write_graph(t["nodes"], t["edges"], folder)
    return t.spark.read.parquet(f"{folder}/{name}.parquet")


register("a1_domain_list", _listed, f"SELECT DISTINCT domain FROM ({ORACLE['d1_sanitize']}) WHERE domain IS NOT NULL")
register("a2_export", _exported, " UNION ALL ".join(f"SELECT '{n}' AS table, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM {v}"
    for n, v in zip(EXPORTED, ("fx_domains", "fx_dns_info", "fx_ports_info"), strict=True)))
register("a6_ns_csv", _cells, "SELECT CASE o_orderkey % 3 WHEN 1 THEN 'd' || o_orderkey || ', x.ch' ELSE 'd' || o_orderkey || '.ch' END AS domain, "
    "CASE o_orderkey % 3 WHEN 1 THEN 'n\"s' || o_orderkey % 7 WHEN 2 THEN 'ns' || o_orderkey % 7 || '.net' END AS host FROM orders WHERE o_orderkey % 50 > 0")
register("a9_graph_nodes", lambda t: _graph_file(t, "nodes"), "SELECT * FROM v_nodes")
register("a9_graph_edges", lambda t: _graph_file(t, "edges"), "SELECT * FROM v_edges")

# ---- E: matching
_geo = "LEFT JOIN fx_ip_ranges r ON CAST(split_part(ip, '.', 1) AS INT) BETWEEN lo_octet AND hi_octet"
register("e1_geocode", lambda t: matching.geocode(t["domains"].select(K, "ip", "country_code"), matching.octet_ranges(t["ip_ranges"])),
    f"SELECT d.k, d.ip, r.country_code FROM fx_domains d {_geo}")
register("e2_asn", lambda t: matching.asn_lookup(t["domains"].select(K, "ip"), matching.octet_ranges(t["ip_ranges"])), f"SELECT d.k, "
    f"d.ip, 'AS' || r.asn AS asn, r.asn_org FROM fx_domains d {_geo}")
_networks = (lambda t: t["networks"].withColumnRenamed("stop", "end"))
# ranges nest, so of those around an address the one that starts last is the innermost
_inside = "FROM fx_addresses a LEFT JOIN fx_networks r ON a.ip_key BETWEEN r.start_key AND r.stop_key GROUP BY a.k"
register("e1_networks", lambda t: matching.geocode(t["addresses"].select(K, "ip"), _networks(t)).select(K, "country_code"),
    f"SELECT a.k, arg_max(r.country_code, r.start_key) AS country_code {_inside}")
register("e2_networks", lambda t: matching.asn_lookup(t["addresses"].select(K, "ip"), _networks(t)).select(K, "asn", "asn_org"),
    f"SELECT a.k, 'AS' || arg_max(r.asn, r.start_key) AS asn, arg_max(r.asn_org, r.start_key) AS asn_org {_inside}")
register("e3_http_matches", lambda t: matching.match_cves_http(t["domains"], t["catalog"], K), "SELECT * FROM v_http_matches")
register("e4_port_matches", lambda t: matching.match_cves_ports(t["ports"], t["catalog"], K), "SELECT * FROM v_port_matches")
register("e5_combined", lambda t: matching.combined_matches(t["domains"], t["ports"], t["catalog"], K), "SELECT * FROM v_combined")
register("e6_port_versions",
    lambda t: matching.apply_port_versions(matching.match_cves_ports(t["ports"], t["catalog"], K), t["ports"], K), "SELECT k, "
    "technology, coalesce(found, version) AS version, cve_id, severity, cvss_score, in_kev FROM v_port_matches LEFT JOIN v_port_versions "
    "USING (k, technology)")
register("e7_in_range", lambda t: matching.filter_versions(matching.match_cves_http(t["domains"], t["catalog"], K), t["catalog"]),
    f"SELECT m.* FROM v_http_matches m JOIN fx_cve_catalog USING (cve_id) WHERE version IS NULL OR NOT regexp_matches(version, '[0-9]') "
    f"OR (coalesce({KEY_OF.format('version')} >= {KEY_OF.format('affected_from')}, true) AND coalesce({KEY_OF.format('version')} <= "
    f"{KEY_OF.format('affected_to')}, true))")
register("e8_matches", lambda t: t["matches"], "SELECT * FROM v_matches")
KEV = ("SELECT 'CVE-' || CAST(o_orderkey AS STRING) AS cve_id, 'php' AS technology, 'CRITICAL' AS severity, true AS in_kev, 'kev' AS "
    "summary, '2001-01-01' AS published_at FROM orders WHERE o_orderkey % 2 = 0")
CAT = ("SELECT 'CVE-' || CAST(o_orderkey AS STRING) AS cve_id, 'nginx' AS technology, '1.0' AS affected_from, '2.0' AS affected_to, "
    "'LOW' AS severity, 5.5D AS cvss_score, false AS in_kev, 'seed' AS summary, NULL AS published_at FROM orders WHERE o_orderkey % 3 = 0")
register("e9_merge_kev", lambda t: matching.merge_kev(derived(t.spark, t.sf_dir, CAT), derived(t.spark, t.sf_dir, KEV)), "SELECT 'CVE-' "
    "|| o_orderkey AS cve_id, CASE WHEN s THEN 'nginx' ELSE 'php' END AS technology, CASE WHEN s THEN '1.0' END AS affected_from, CASE "
    "WHEN s THEN '2.0' END AS affected_to, CASE WHEN x THEN 'CRITICAL' ELSE 'LOW' END AS severity, CASE WHEN s THEN CAST(5.5 AS DOUBLE) "
    "END AS cvss_score, x AS in_kev, CASE WHEN x THEN 'kev' ELSE 'seed' END AS summary, CASE WHEN x THEN '2001-01-01' END AS "
    "published_at FROM (SELECT o_orderkey, o_orderkey % 3 = 0 AS s, o_orderkey % 2 = 0 AS x FROM orders WHERE o_orderkey % 3 = 0 OR "
    "o_orderkey % 2 = 0)")
register("e10_staging", lambda t: t["staging"], "SELECT * FROM v_staging")
register("e11_samples", lambda t: matching.operator_samples(t["dns"], K), "SELECT operator, min(host) AS sample_ns FROM v_hosts GROUP BY "
    "operator")
def _enriched(t: Tables) -> DataFrame:
    samples = matching.operator_samples(t["dns"], K)
    ips = (
        samples.select(F.col("sample_ns").alias("host"),
        F.concat((F.length("operator") * 9 + 5).cast("string"), F.lit(".0.0.1")).alias("ip")))
    return matching.enrich_operators(samples, ips, matching.octet_ranges(t["ip_ranges"]))


_enrich = (f"SELECT operator, sample_ns, ip AS resolved_ip, 'AS' || asn AS asn, asn_org, country_code, "
    f"{JURISDICTION.replace('cc', 'country_code')} AS jurisdiction FROM (SELECT operator, min(host) AS sample_ns, (length(operator) * 9 "
    f"+ 5) || '.0.0.1' AS ip FROM v_hosts GROUP BY operator) LEFT JOIN fx_ip_ranges ON CAST(split_part(ip, '.', 1) AS INT) BETWEEN "
    f"lo_octet AND hi_octet")
register("e12_enrich", _enriched, _enrich)
OLD_OPERATORS = ("SELECT operator, 'old' AS sample_ns, NULL AS resolved_ip, NULL AS asn, NULL AS asn_org, country_code, 'CH' AS "
    "jurisdiction FROM (SELECT DISTINCT 'Hostpoint' AS operator, 'CH' AS country_code FROM orders UNION ALL SELECT DISTINCT 'gone' || "
    "CAST(o_custkey AS STRING), NULL FROM orders) o")
register("e12_upsert",
    lambda t: matching.upsert_operators(
    derived(t.spark, t.sf_dir, OLD_OPERATORS).withColumns({n: c(n).cast("string") for n in ("resolved_ip", "asn", "asn_org")}),
    _enriched(t)), f"WITH e AS ({_enrich}) SELECT * FROM e UNION ALL SELECT operator, sample_ns, resolved_ip, asn, asn_org, "
    f"country_code, jurisdiction FROM ({OLD_OPERATORS}) WHERE operator NOT IN (SELECT operator FROM e)")

# ---- F: classes, risk, benchmarks, sovereignty
register("f1_classify", lambda t: t["classes"], "SELECT * FROM v_classes")
register("f2_incremental", lambda t: risk.sector_counts(risk.classify_incremental(t["domains"], t["classes"].filter("k % 2 = 0"), K)),
    "SELECT sector, count(*) AS n FROM v_classes GROUP BY sector")
register("f3_risk_flags", lambda t: t["raw_flags"], "SELECT * FROM v_raw_flags")
SATELLITES = ("headers", "dns", "tls", "whois", "email", "ports", "matches")


def _over_buckets(t: Tables) -> DataFrame:
    """The score over tables that were saved in buckets of the key, so that the seven joins need no shuffle."""
    tables = {n: t[n] for n in SATELLITES if n != "matches"} | {"domains": t["sovereign"], "matches": t["critical"]}
    saved = versions.save_bucketed(tables, K, parts(t["domains"]), f"satellites_{uuid.uuid4().hex}", shared_folder(t.spark))
    return risk.risk_score(risk.risk_flags(saved, AS_OF, K)).select(K, "score")


register("f4_bucketed", _over_buckets, "SELECT k, score FROM v_flags")
register("f4_risk_score", lambda t: t["flags"].select(K, "score"), "SELECT k, score FROM v_flags")
register("f5_penalty", lambda t: t["sovereign"].select(K, risk.sovereignty_penalty(c("sovereignty_score")).alias("penalty")), "SELECT k, "
    "CASE sovereignty_score WHEN 3 THEN 5 WHEN 2 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS penalty FROM v_sovereign")
_q = ("count(*) AS domain_count, avg(v) AS mean, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) "
    "AS p75, min(v) AS min, max(v) AS max")
register("f6_benchmark", lambda t: risk.benchmark(t["domains"].join(t["classes"], K), "sector", "elapsed", "elapsed_ms"), f"SELECT "
    f"sector, 'elapsed' AS metric, {_q} FROM (SELECT sector, CAST(elapsed_ms AS DOUBLE) AS v FROM fx_domains JOIN v_classes USING (k)) "
    f"GROUP BY sector")
register("f7_benchmark_pct", lambda t: risk.benchmark_pct(t["email"].join(t["classes"], K), "sector", "dkim", "dkim_found"), f"SELECT "
    f"sector, 'dkim' AS metric, {_q} FROM (SELECT sector, CASE WHEN dkim_found THEN CAST(100 AS DOUBLE) ELSE 0 END AS v FROM "
    f"fx_email_security JOIN v_classes USING (k)) GROUP BY sector")
register("f8_sector_benchmarks", lambda t: t["bench"], "SELECT * FROM v_bench")
register("f9_summary", lambda t: risk.benchmark_summary(t["bench"]).select("sector", "metric", "domain_count"),
    "SELECT sector, metric, domain_count FROM v_bench")
register("f10_percentile", lambda t: risk.domain_percentile(t["flags"], t["classes"], K), "SELECT k, sector, score, percent_rank() OVER "
    "(PARTITION BY sector ORDER BY score NULLS FIRST) AS percentile, median AS sector_median FROM v_flags JOIN v_classes USING (k) JOIN "
    "(SELECT sector, median FROM v_bench WHERE metric = 'risk_score') USING (sector)")
register("f11_sovereignty", lambda t: t["sovereign"].select(K, "sovereignty_score"), "SELECT k, sovereignty_score FROM v_sovereign")
register("f12_jurisdictions", lambda t: risk.jurisdiction_distribution(t["domains"], t["staging"], t["operators"], K), "SELECT "
    "jurisdiction, count(DISTINCT k) AS domains, count(DISTINCT k) * 100 // (SELECT count(*) FROM fx_domains) AS percent FROM v_staging "
    "JOIN v_operators USING (operator) GROUP BY jurisdiction")
register("f13_top_operators", lambda t: risk.top_operators(t["staging"], 20, K), "SELECT operator, count(DISTINCT k) AS domains FROM "
    "v_staging GROUP BY operator ORDER BY domains DESC, operator LIMIT 20")
register("f14_histogram", lambda t: risk.sovereignty_histogram(t["sovereign"]), "SELECT sovereignty_score, count(*) AS n FROM "
    "v_sovereign GROUP BY ALL")
_conc = ("SELECT operator, count(DISTINCT k) AS domains, round(count(DISTINCT k) * 100.0 / CAST((SELECT count(*) FROM fx_domains WHERE "
    "status = 'ok') AS DOUBLE), 4) AS percent FROM v_staging GROUP BY operator")
register("f15_concentration", lambda t: risk.ns_concentration(t["staging"], t["domains"], K), _conc)
register("f16_services", lambda t: risk.list_services(t["ports"], K), "SELECT port, technology, count(DISTINCT k) AS domains, "
    "coalesce(string_agg(DISTINCT version, ',' ORDER BY version), '') AS versions FROM v_services GROUP BY ALL")
register("f17_error_guard", lambda t: risk.error_rate_guard(t["scan_results"]), "SELECT module, count(*) AS completed, count(error_kind) "
    "AS errors FROM fx_scan_results GROUP BY module HAVING count(*) >= 100 AND count(error_kind) / CAST(count(*) AS DOUBLE) > 0.5")

# ---- G: findings
for _name, _f in findings.FINDINGS.items():
    register(_name, _f)
TITLES = (*findings.GENERIC_TITLES, "willkommen 0", "spital portal")
register("g9_parked", lambda t: findings.g9(t, TITLES))
LIVE = "(SELECT * FROM fx_domains WHERE status = 'ok')"
_share = (lambda by, source, where="true": f"SELECT {by}, count(*) AS n, round(count(*) * 100.0 / CAST(sum(count(*)) OVER () AS DOUBLE), "
    f"1) AS share FROM {source} WHERE {where} GROUP BY ALL")  # noqa: E731
_case = (lambda col, marks, other: f"CASE "
    f"{' '.join(f'WHEN contains(lower(coalesce({col}, {chr(39)}{chr(39)})), {chr(39)}{m.replace(chr(39), chr(39) * 2)}{chr(39)}) THEN {chr(39)}{n}{chr(39)}' for m, n in marks)} "
    f"ELSE '{other}' END")  # noqa: E731
_flags = (lambda source, **kw: f"SELECT count(*) AS n, {', '.join(f'count(*) FILTER (WHERE {e}) AS {k}' for k, e in kw.items())} FROM "
    f"{source}")  # noqa: E731
_avg = (lambda source, **kw: f"SELECT sector, count(*) AS n, "
    f"{', '.join(f'round(avg(CASE WHEN {e} THEN 100.0 ELSE 0.0 END), 1) AS {k}' for k, e in kw.items())} FROM {source} JOIN v_classes "
    f"USING (k) GROUP BY sector")  # noqa: E731
_cloud = _case("server", findings.CLOUD_MARKS, "none")
_wanted = (3306, 5432, 6379, 9200, 27017, 11211)
_pf = (lambda f: f"SELECT '{f}' AS flag, round(avg(CASE WHEN {f} THEN 100.0 ELSE 0 END) FILTER (WHERE sector = 'government'), 1) AS "
    f"government, round(avg(CASE WHEN {f} THEN 100.0 ELSE 0 END) FILTER (WHERE sector = 'retail'), 1) AS retail FROM v_flags JOIN "
    f"v_classes USING (k)")  # noqa: E731
_caa0 = f"len({LIST.format('caa')}) = 0"
_cont = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in findings.CONTINENTS.items())
_gsql = {
    "g0_scan_summary": f"SELECT k, 'http' AS scan, coalesce(CAST(status_code AS VARCHAR), error_kind) AS detail FROM fx_domains WHERE "
        f"status IS NOT NULL UNION ALL SELECT k, 'dns', CAST(len({LIST.format('ns')}) AS VARCHAR) FROM fx_dns_info UNION ALL SELECT k, "
        f"'tls', tls_version FROM fx_tls_info UNION ALL SELECT k, 'ports', string_agg(DISTINCT CAST(port AS VARCHAR), ',' ORDER BY port) "
        f"FROM (SELECT DISTINCT k, port FROM fx_ports_info) GROUP BY k".replace("string_agg(DISTINCT CAST(port AS VARCHAR)",
        "string_agg(CAST(port AS VARCHAR)"),
    "g1_status": _share("coalesce(status, 'pending') AS status", "fx_domains"),
    "g2_error_kinds": _share("error_kind", "fx_domains", "status = 'error'"),
    "g3_status_codes": _share("status_code", LIVE),
    "g4_servers": _share(_case("server", findings.SERVERS, "other") + " AS family", LIVE),
    "g5_cms": _share("cms", LIVE, "cms IS NOT NULL AND lower(cms) NOT IN ('apache', 'nginx', 'php')"),
    "g6_php_branches": "SELECT 'branch' AS kind, coalesce(branch, 'total') AS value, count(*) AS n FROM (SELECT CASE powered_by WHEN "
        "'PHP/7.4.33' THEN '7.4' WHEN 'PHP/8.2.30' THEN '8.x' WHEN 'PHP/5.6.40' THEN '5.x' END AS branch FROM fx_domains) WHERE branch "
        "IS NOT NULL GROUP BY ROLLUP (branch) UNION ALL SELECT * FROM (SELECT 'version', powered_by, count(*) AS n FROM fx_domains WHERE "
        "powered_by IS NOT NULL GROUP BY powered_by ORDER BY n DESC, powered_by LIMIT 10)",
    "g7_response_times": f"SELECT min(elapsed_ms) AS min, max(elapsed_ms) AS max, round(avg(elapsed_ms), 4) AS mean, "
        f"{', '.join(f'quantile_cont(CAST(elapsed_ms AS DOUBLE), {q}) AS {n}' for q, n in ((0.25, 'p25'), (0.5, 'p50'), (0.75, 'p75'), (0.95, 'p95'), (0.99, 'p99')))} "
        f"FROM {LIVE}",
    "g8_cross_domain": _flags(LIVE, cross_domain="regexp_replace(regexp_extract(final_url, '^https?://([^/]*)', 1), '^www\\.', '') <> "
        "domain"),
    "g9_parked": _flags(LIVE, no_title="title IS NULL", generic=f"lower(title) IN {TITLES}"),
    "g10_addresses": f"SELECT count(DISTINCT ip) AS ips, count(ip) AS domains, round(count(ip) / CAST(count(DISTINCT ip) AS DOUBLE), 4) "
        f"AS per_ip FROM {LIVE}",
    "g11_top_ips": f"SELECT ip, n, round(sum(n) OVER (ORDER BY n DESC, ip) * 100.0 / CAST(total AS DOUBLE), 1) AS cumulative FROM "
        f"(SELECT ip, count(*) AS n, sum(count(*)) OVER () AS total FROM {LIVE} WHERE ip IS NOT NULL GROUP BY ip ORDER BY n DESC, ip "
        f"LIMIT 10)",
    "g12_clones": f"WITH g AS (SELECT body_hash, count(*) AS n, min(title) AS title FROM {LIVE} GROUP BY body_hash) SELECT kind, NULL AS "
        f"title, n FROM (SELECT unnest([{{'kind': 'with_hash', 'n': coalesce(sum(n) FILTER (WHERE body_hash IS NOT NULL), 0)}}, "
        f"{{'kind': 'no_hash', 'n': coalesce(sum(n) FILTER (WHERE body_hash IS NULL), 0)}}, {{'kind': 'distinct_bodies', 'n': "
        f"count(body_hash)}}, {{'kind': 'singletons', 'n': count(body_hash) FILTER (WHERE n = 1)}}, {{'kind': 'sharing', 'n': "
        f"coalesce(sum(n) FILTER (WHERE n > 1 AND body_hash IS NOT NULL), 0)}}, {{'kind': 'groups', 'n': count(body_hash) FILTER (WHERE "
        f"n > 1)}}], recursive := true) FROM g) UNION ALL SELECT * FROM (SELECT 'group', title, n FROM g WHERE n > 1 AND body_hash IS "
        f"NOT NULL ORDER BY n DESC, body_hash LIMIT 10)",
    "g13_schemes": _flags(LIVE, https="starts_with(final_url, 'https://')", http="starts_with(final_url, 'http://')"),
    "g14_countries": f"SELECT CASE WHEN share < 0.4 THEN 'other' ELSE country_code END AS country, CAST(sum(n) AS BIGINT) AS n FROM "
        f"({_share('country_code', LIVE, 'country_code IS NOT NULL')}) GROUP BY 1",
    "g15_headers": _flags("fx_http_headers", hsts="hsts IS NOT NULL", csp="csp IS NOT NULL", frame="x_frame_options IS NOT NULL",
        sniff="x_content_type_options IS NOT NULL", none="coalesce(hsts, csp, x_frame_options, x_content_type_options) IS NULL"),
    "g16_tls": f"SELECT tls_version, {_case('cert_issuer', findings.ISSUERS, 'other')} AS issuer, count(*) AS n, count(*) FILTER (WHERE "
        f"valid_to - DATE '{AS_OF}' BETWEEN 0 AND 29) AS expiring FROM fx_tls_info GROUP BY 1, 2",
    "g17_email": "SELECT dmarc_policy, count(*) AS n, count(*) FILTER (WHERE spf_present) AS spf, count(*) FILTER (WHERE dmarc_present) "
        "AS dmarc, count(*) FILTER (WHERE dkim_found) AS dkim FROM fx_email_security GROUP BY 1",
    "g18_risky_ports": f"SELECT port, count(DISTINCT k) AS domains, CASE port "
        f"{' '.join(f'WHEN {p} THEN {chr(39)}{r}{chr(39)}' for p, r in findings.RISK_PORTS.items())} END AS risk FROM fx_ports_info "
        f"WHERE port IN {tuple(findings.RISK_PORTS)} GROUP BY port",
    "g19_dnssec": _flags("fx_dns_info", signed="dnssec_signed", unknown="dnssec_signed IS NULL"),
    "g20_continents": f"SELECT continent, country_code, count(*) AS n, grouping_id(continent, country_code) AS level FROM (SELECT "
        f"country_code, CASE country_code {_cont} ELSE 'Other' END AS continent FROM {LIVE} WHERE country_code IS NOT NULL) GROUP BY "
        f"ROLLUP (continent, country_code)",
    "g21_domestic_ips": f"SELECT ip, count(*) AS n FROM {LIVE} WHERE country_code = 'CH' AND ip IS NOT NULL GROUP BY ip ORDER BY n DESC, "
        f"ip LIMIT 10",
    "g22_foreign_ips": f"SELECT ip, country_code, count(*) AS n FROM {LIVE} WHERE country_code <> 'CH' AND ip IS NOT NULL GROUP BY ip, "
        f"country_code ORDER BY n DESC, ip, country_code LIMIT 10",
    "g23_weak_countries": f"SELECT coalesce(country_code, 'total') AS country, count(*) AS n FROM {LIVE} WHERE country_code IN "
        f"{findings.WEAK_COUNTRIES} GROUP BY ROLLUP (country_code)",
    "g24_clouds": f"SELECT coalesce(cloud, 'total') AS cloud, count(*) AS n FROM (SELECT {_cloud} AS cloud FROM {LIVE}) WHERE cloud <> "
        f"'none' GROUP BY ROLLUP (cloud)",
    "g25_keys": f"SELECT key_oid, key_size, count(*) AS n, count(*) FILTER (WHERE valid_to - DATE '{AS_OF}' BETWEEN 0 AND 6) AS "
        f"within_week FROM fx_tls_info GROUP BY 1, 2",
    "g26_spoofable": f"SELECT * FROM "
        f"({_flags("fx_email_security", neither="NOT spf_present AND NOT dmarc_present", spoofable="(NOT spf_present OR spf_too_permissive) AND (NOT dmarc_present OR coalesce(dmarc_policy = 'none', false))")}) "
        f"CROSS JOIN (SELECT count(*) FILTER (WHERE {_look} > 10) AS over_limit FROM fx_dns_info)",
    "g27_open_cors": _flags("fx_http_headers", open="cors_origin = '*'"),
    "g28_dns_hygiene": _flags("fx_dns_info", wildcard="wildcard", no_caa=_caa0,
        spf_without_mx=f"txt_spf IS NOT NULL AND len({LIST.format('mx')}) = 0"),
    "g29_subdomains": "SELECT 'source' AS kind, source AS name, count(*) AS n, count(DISTINCT k) AS parents FROM fx_subdomains GROUP BY "
        "source UNION ALL SELECT 'leaking', 'axfr', count(*), count(DISTINCT k) FROM fx_subdomains WHERE source = 'axfr' UNION ALL "
        "SELECT * FROM (SELECT 'leak', CAST(k AS VARCHAR), count(DISTINCT subdomain) AS n, 1 FROM fx_subdomains WHERE source = 'axfr' "
        "GROUP BY k ORDER BY n DESC, k LIMIT 10)",
    "g30_other_ports": "SELECT port, count(*) AS n FROM fx_ports_info WHERE port NOT IN (80, 443) GROUP BY port",
    "g31_version_bands": _share(
        "CASE WHEN a > 6 OR (a = 6 AND b >= 8) THEN 'current' WHEN a = 6 THEN 'older' ELSE 'outdated' END AS band", f"(SELECT "
        f"CAST(split_part(cms_version, '.', 1) AS INT) AS a, CAST(split_part(cms_version, '.', 2) AS INT) AS b FROM {LIVE} WHERE cms = "
        f"'WordPress' AND cms_version IS NOT NULL)"),
    "g32_exposure": "SELECT technology, count(DISTINCT k) AS domains, count(DISTINCT cve_id) FILTER (WHERE severity = 'CRITICAL') AS "
        "critical, count(DISTINCT cve_id) FILTER (WHERE severity = 'HIGH') AS high FROM v_matches GROUP BY 1",
    "g33_sector_metrics": "SELECT sector, "
        + ", ".join(f"round(max(mean) FILTER (WHERE metric = '{m}'), 2) AS {m}" for m
        in ("dmarc_weak_pct", "dnssec_adoption", "hsts_adoption", "risk_score")) + " FROM v_bench GROUP BY sector",
    "g34_operator_pairs": "SELECT operator, n AS pairs, round(sum(n) OVER (ORDER BY n DESC, operator) * 100.0 / CAST(sum(n) OVER () AS "
        "DOUBLE), 1) AS cumulative FROM (SELECT operator, count(*) AS n FROM v_staging GROUP BY operator)",
    "g35_offshored": f"SELECT count(*) AS n FROM {LIVE} WHERE country_code <> 'CH' AND k IN (SELECT k FROM v_staging JOIN v_operators "
        f"USING (operator) WHERE jurisdiction IN ('US', 'OTHER'))",
    "g36_hosting_by_sector": _avg("fx_domains", ch="country_code = 'CH'", us="country_code = 'US'"),
    "g37_cloud_by_sector": f"SELECT sector, "
        + ", ".join(f"count(*) FILTER (WHERE cloud = '{n}') AS {n}" for n in ("cloudflare", "microsoft", "wix")) + f" FROM (SELECT k, "
        f"{_cloud} AS cloud FROM fx_domains) JOIN v_classes USING (k) WHERE sector IN ('government', 'healthcare', 'finance') GROUP BY "
        f"sector",
    "g38_db_ports_by_sector": "SELECT sector, " + ", ".join(f"count(DISTINCT k) FILTER (WHERE port = {p}) AS p{p}" for p in _wanted) +
        f" FROM fx_ports_info JOIN v_classes USING (k) WHERE port IN {_wanted} GROUP BY sector",
    "g39_email_by_sector": _avg("fx_email_security", spf="spf_present", dmarc="dmarc_present", dkim="dkim_found"),
    "g40_kev": "SELECT technology, count(DISTINCT k) AS domains FROM v_matches WHERE in_kev GROUP BY 1 UNION ALL SELECT 'total', "
        "count(DISTINCT k) FROM v_matches WHERE in_kev",
    "g41_cve_exposure": "SELECT technology, count(DISTINCT k) AS domains, count(DISTINCT cve_id) AS cves FROM v_matches GROUP BY 1",
    "g42_critical_by_sector": "SELECT sector, technology, count(DISTINCT k) AS domains FROM v_matches JOIN v_classes USING (k) WHERE "
        "severity = 'CRITICAL' AND sector IN ('finance', 'healthcare') GROUP BY 1, 2",
    "g43_most_cves": "SELECT k, n FROM (SELECT k, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM v_matches GROUP BY k) "
        "WHERE r = 1",
    "g44_low_scores": _avg("v_flags", low="score < 50"),
    "g45_two_sectors": " UNION ALL ".join(
        map(_pf, ("missing_hsts", "missing_csp", "weak_tls", "no_dnssec", "dmarc_weak", "exposed_db_port"))),
    "g46_headers_by_sector": _avg("fx_http_headers", hsts="hsts IS NOT NULL", csp="csp IS NOT NULL", frame="x_frame_options IS NOT NULL"),
    "g47_cms_by_sector": "SELECT sector, cms, n, CAST(rank AS INT) AS rank FROM (SELECT sector, cms, count(*) AS n, row_number() OVER "
        "(PARTITION BY sector ORDER BY count(*) DESC, cms) AS rank FROM fx_domains JOIN v_classes USING (k) WHERE cms IS NOT NULL GROUP "
        "BY 1, 2) WHERE rank <= 2",
    "g48_key_inventory": "SELECT key_size, count(*) AS n, count(*) FILTER (WHERE key_oid = '1.2.840.113549.1.1.1' AND key_size < 2048) "
        "AS weak_rsa FROM fx_tls_info GROUP BY 1",
    "g49_caa": _flags("fx_tls_info LEFT JOIN fx_dns_info USING (k)", with_caa=f"NOT ({_caa0})", without_caa=_caa0),
    "g50_kev_critical": "SELECT k, cve_id, technology FROM v_matches WHERE in_kev AND severity = 'CRITICAL'",
    "g51_permissive_spf": "SELECT k FROM fx_email_security WHERE spf_too_permissive",
    "g52_weak_dmarc": "SELECT k, dmarc_policy FROM fx_email_security WHERE dmarc_policy = 'none' OR NOT dmarc_present",
    "g53_spf_over_limit": f"SELECT k, CAST({_look} AS INT) AS dns_lookups FROM fx_dns_info WHERE {_look} > 10",
    "g54_sectors": _share("sector", "v_classes"),
    "g55_risk_by_sector": "SELECT sector, round(mean, 4) AS mean, median FROM v_bench WHERE metric = 'risk_score'",
    "g56_large_operators": f"SELECT * FROM ({_conc}) WHERE percent > 10",
    "g57_non_domestic": "SELECT count(sovereignty_score) AS n, round(count(*) FILTER (WHERE sovereignty_score > 0) * 100.0 / "
        "CAST(count(sovereignty_score) AS DOUBLE), 1) AS share FROM v_sovereign",
}
ORACLE |= {n: with_views(s) for n, s in _gsql.items()}

# ---- H: research
_left = f"(expires_at - DATE '{AS_OF}')"
register("h1_expiring", lambda t: research.expiring(t["whois"], AS_OF), f"SELECT count(*) FILTER (WHERE {_left} BETWEEN 0 AND 30) AS "
    f"within_30, count(*) FILTER (WHERE {_left} BETWEEN 0 AND 90) AS within_90 FROM fx_whois_info")
register("h2_registrars", lambda t: research.registrars_expiring(t["whois"], AS_OF), f"SELECT registrar, count(*) AS n FROM "
    f"fx_whois_info WHERE {_left} BETWEEN 0 AND 90 GROUP BY 1 ORDER BY n DESC, registrar LIMIT 10")
register("h3_valuable", lambda t: research.valuable_expiring(t["whois"], t["subdomains"], t["classes"], AS_OF), f"SELECT w.k, "
    f"expires_at, s.n AS subdomains, sector FROM fx_whois_info w JOIN (SELECT k, count(DISTINCT subdomain) AS n FROM fx_subdomains GROUP "
    f"BY k) s USING (k) LEFT JOIN v_classes USING (k) WHERE {_left} BETWEEN 0 AND 90")
register("h4_age", lambda t: research.registrar_age(t["whois"], AS_OF), f"SELECT registrar, round(avg(DATE '{AS_OF}' - whois_created), "
    f"4) AS mean_days FROM fx_whois_info GROUP BY 1")
register("h5_share", lambda t: research.registrar_share(t["whois"]), _share("registrar", "fx_whois_info"))
register("h6_posture", lambda t: research.registrar_posture(t["whois"], t["flags"]), "SELECT registrar, count(*) AS n, round(avg(score), "
    "4) AS mean_score, round(corr(CAST(score AS DOUBLE), CAST(CAST(dnssec_delegated AS INT) AS DOUBLE)), 4) AS corr FROM fx_whois_info "
    "JOIN v_flags USING (k) GROUP BY 1")
register("h7_dnssec", lambda t: research.registrar_dnssec(t["whois"]), "SELECT registrar, count(*) AS n, count(*) FILTER (WHERE "
    "dnssec_delegated) AS delegated FROM fx_whois_info GROUP BY 1")
NAMES = "SELECT DISTINCT 'old' || CAST(o_orderkey % 40 AS STRING) || '.app.example.com' AS name FROM orders"
register("h8_orphans", lambda t: t["orphans"].select(K, "cname"), "SELECT k, cname FROM v_orphans")
# every step's sets of operators still up are rows; the next step takes the operator that is the last one of most domains
_removals = """
WITH RECURSIVE sets AS (SELECT operators, count(*) AS n FROM (SELECT k, list_sort(list(DISTINCT operator)) AS operators FROM v_staging GROUP BY k) GROUP BY 1),
total AS (SELECT sum(n) AS total FROM sets),
r(step, operator, up, n) AS (SELECT 0, CAST(NULL AS VARCHAR), operators, n FROM sets UNION ALL
  SELECT step + 1, b.operator, list_filter(up, lambda x: x <> b.operator), n FROM r, (
    SELECT operator FROM (SELECT unnest(up) AS operator, n, len(up) = 1 AS last FROM r) GROUP BY operator
    ORDER BY sum(CASE WHEN last THEN n ELSE 0 END) DESC, sum(n) DESC, operator LIMIT 1) b
  WHERE step < 50 AND (SELECT coalesce(sum(n) FILTER (WHERE len(up) = 0), 0) FROM r) < 0.5 * (SELECT total FROM total))
SELECT step, operator, fallen, CASE WHEN fallen >= 0.5 * total THEN 0.5::DOUBLE WHEN fallen >= 0.25 * total THEN 0.25::DOUBLE
  WHEN fallen >= 0.1 * total THEN 0.1::DOUBLE END AS share
FROM (SELECT step, any_value(operator) AS operator, coalesce(sum(n) FILTER (WHERE len(up) = 0), 0) AS fallen FROM r WHERE step > 0 GROUP BY step), total"""
register("h9_hub_removal", lambda t: research.hub_removals(t["staging"]).drop("least"), _removals)
_down = "('Hostpoint', 'Cloudflare', 'UltraDNS')"
register("h10_cascade",
    lambda t: research.cascade(t["staging"], t["staging"].filter(f"operator IN {_down}").select("operator").distinct(), t["classes"]),
    f"SELECT sector, count(*) AS n FROM (SELECT k FROM v_staging GROUP BY k HAVING bool_and(operator IN {_down})) LEFT JOIN v_classes "
    f"USING (k) GROUP BY sector")
_log = ("SELECT coalesce(o.k, n.k) AS k, unnest(list_filter([CASE WHEN o.k IS NULL THEN {'change': 'added', 'column': NULL, 'before': "
    "NULL, 'after': NULL} END, CASE WHEN n.k IS NULL THEN {'change': 'removed', 'column': NULL, 'before': NULL, 'after': NULL} END, CASE "
    "WHEN o.k = n.k AND o.status IS DISTINCT FROM n.status THEN {'change': 'changed', 'column': 'status', 'before': o.status, 'after': "
    "n.status} END, CASE WHEN o.k = n.k AND o.server IS DISTINCT FROM n.server THEN {'change': 'changed', 'column': 'server', 'before': "
    "o.server, 'after': n.server} END], lambda x: x IS NOT NULL)) AS e FROM fx_domains o FULL JOIN fx_snapshot_2 n ON o.k = n.k")
_severity = ("CASE WHEN e.change = 'removed' OR (e.column = 'status' AND e.after = 'error') THEN 'high' WHEN e.column = 'status' THEN "
    "'medium' ELSE 'low' END AS severity")
register("h11_change_log", lambda t: research.change_log(_cur(t), t["snapshot_2"], ["status", "server"]), f"SELECT k, e.change, "
    f"e.column, e.before, e.after, {_severity} FROM ({_log})")
register("h12_alerts", lambda t: research.alerts(research.change_log(_cur(t), t["snapshot_2"], ["status", "server"])), f"SELECT * FROM "
    f"(SELECT k, e.change AS change, {_severity} FROM ({_log})) WHERE severity <> 'low'")
SNAPS = "SELECT o_custkey AS k, o_orderkey AS seen, o_orderkey * 7919 % 101 AS score FROM orders"
register("h13_trend", lambda t: research.trend(derived(t.spark, t.sf_dir, SNAPS)), f"SELECT k, seen, score, score - lag(score) OVER "
    f"(PARTITION BY k ORDER BY seen) AS change, round(avg(score) OVER (PARTITION BY k ORDER BY seen ROWS BETWEEN 2 PRECEDING AND CURRENT "
    f"ROW), 4) AS moving FROM ({SNAPS})")
register("h12_risk_alerts", lambda t: research.risk_alerts(derived(t.spark, t.sf_dir, SNAPS)), f"SELECT k, seen, before, score, CASE "
    f"WHEN before - score >= 20 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT k, seen, score, lag(score) OVER (PARTITION BY k "
    f"ORDER BY seen) AS before FROM ({SNAPS})) WHERE score < before")
register("h14_typosquats", lambda t: research.typosquats(t["names"].select("name").distinct()), "SELECT a, b FROM v_squats")
register("h15_homoglyphs", lambda t: research.homoglyphs(t["glyphs"]), f"SELECT name, skeleton, min(name) OVER s AS like, count(*) OVER "
    f"s AS members FROM (SELECT DISTINCT name, translate(name, '{research.CONFUSABLE[0]}', '{research.CONFUSABLE[1]}') AS skeleton FROM "
    f"fx_glyphs) WINDOW s AS (PARTITION BY skeleton) QUALIFY members > 1")
register("h16_blocklist", lambda t: research.blocklisted(t["domains"], t["blocklist"]).select(K, "domain"), "SELECT k, domain FROM "
    "fx_domains WHERE k IN (SELECT k FROM fx_blocklist)")

# ---- I: module models
_sum = (lambda base, cap, *terms: f"CAST(greatest(0, least({cap}, {base} + "
    f"{' + '.join(f'CASE WHEN {w} THEN {p} ELSE 0 END' for w, p in terms)})) AS INT) AS points")  # noqa: E731
_rsa = "key_oid = '1.2.840.113549.1.1.1'"
_d = f"(valid_to - DATE '{AS_OF}')"
_isql = {
    "i1": "SELECT k, "
        + _sum(10, 100, (f"{_d} < 7", 30), (f"{_d} BETWEEN 7 AND 29", 15), (f"{_d} BETWEEN 30 AND 89", 5),
        (f"{_rsa} AND key_size < 2048", 20), (f"NOT {_rsa} OR key_size >= 4096", -5), ("tls_version IN ('TLSv1.0', 'TLSv1.1')", 25),
        ("tls_version = 'TLSv1_3'", -10), ("NOT ct_logged", 10), ("cert_issuer = cert_subject", 25), ("signature LIKE 'SHA1%'", 20),
        ("NOT stapled", 5), ("regexp_matches(cipher, 'DES|RC4|NULL')", 20)) + " FROM fx_tls_info",
    "i2": "SELECT k, "
        + _sum(15, 100, ("NOT coalesce(dnssec_signed, false)", 25), (_caa0, 15), (f"len({LIST.format('caa')}) = 1", -5),
        (f"len({LIST.format('ns')}) < 2", 10), ("wildcard", 12), ("coalesce(dnssec_signed, false) AND NOT dnssec_valid", 35),
        ("axfr_open", 20), ("k IN (SELECT k FROM v_orphans)", 15), ("ttl < 300", 5), ("ttl > 86400", 3)) + " FROM fx_dns_info",
    "i3": "SELECT k, "
        + _sum(10, 75, ("hsts IS NULL", 20), ("hsts = 'max-age=3600'", 10), ("contains(hsts, 'includeSub')", -3),
        ("contains(hsts, 'preload')", -5), ("csp IS NULL", 15), ("contains(csp, 'unsafe-inline')", 12), ("csp = 'script-src *'", 8),
        ("x_frame_options IS NULL", 12), ("x_frame_options = 'SAMEORIGIN'", 5), ("x_content_type_options IS NULL", 8),
        ("referrer_policy IS NULL", 5), ("referrer_policy = 'unsafe-url'", 8), ("permissions_policy IS NULL", 3))
        + " FROM fx_http_headers",
    "i4": "SELECT p.k, CAST(least(150, 25 + p.n + CASE WHEN critical THEN 10 ELSE 0 END) AS INT) AS points FROM (SELECT k, sum(CASE WHEN "
        "port IN (3306, 5432, 6379, 9200, 27017, 11211, 1433, 22, 3389, 445, 23) THEN 30 WHEN port = 21 THEN 25 WHEN port = 8080 THEN 15 "
        "ELSE 0 END) AS n FROM fx_ports_info GROUP BY k) p LEFT JOIN v_critical c USING (k)",
    "i5": "SELECT k, "
        + _sum(25, 100, ("txt_spf IS NULL", 20), ("txt_spf LIKE '%~all'", 8), ("coalesce(txt_dmarc, '') NOT LIKE 'v=DMARC1%'", 20),
        ("txt_dmarc = 'v=DMARC1; p=none'", 15), ("txt_dmarc LIKE '%p=quarantine%'", 5), ("txt_dmarc LIKE '%rua=%'", -2),
        (f"len({LIST.format('mx')}) = 0", 10), ("k NOT IN (SELECT k FROM fx_email_security WHERE dkim_found)", 15)) + " FROM fx_dns_info",
    "i6": "SELECT k, CAST(least(150, 10 + sum(CASE WHEN cvss_score >= 9 THEN 30 WHEN cvss_score >= 7 THEN 20 WHEN cvss_score >= 4 THEN "
        "10 WHEN cvss_score IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN in_kev THEN 20 ELSE 0 END + CASE WHEN version IS NOT NULL THEN 5 "
        "ELSE 0 END + CASE WHEN " + KEY_OF.format("version") + " < " + KEY_OF.format("least") + " THEN 10 ELSE 0 END)) AS INT) AS points "
        "FROM v_matches LEFT JOIN fx_supported USING (technology) GROUP BY k",
    "i7": "SELECT k, "
        + _sum(12, 100, (f"{_left} BETWEEN 0 AND 6", 25), (f"{_left} BETWEEN 7 AND 29", 15), (f"{_left} BETWEEN 30 AND 89", 5),
        (f"{_left} BETWEEN -30 AND -1", 20), (f"{_left} < -30", 35), ("k IN (SELECT k FROM v_orphans)", 12),
        ("k IN (SELECT k FROM v_lookalikes)", 15)) + " FROM fx_whois_info",
}
_models = {
    "i1": lambda t: module_risk.tls_risk(t["tls"], AS_OF), "i2": lambda t: module_risk.dns_risk(t["dns"], t["orphans"]),
        "i3": lambda t: module_risk.header_risk(t["headers"]),
    "i4": lambda t: module_risk.port_risk(t["ports"], t["critical"]), "i5": lambda t: module_risk.email_risk(t["dns"], t["email"]),
    "i6": lambda t: matching.over_matches(t["shown"], t["catalog"], lambda m: module_risk.technology_risk(m, t["supported"], "_set")),
        "i7": lambda t: module_risk.domain_risk(t["whois"], AS_OF, t["orphans"], t["lookalikes"]),
}
for _n, _label in (("i1", "tls"), ("i2", "dns"), ("i3", "headers"), ("i4", "ports"), ("i5", "email"), ("i6", "technology"),
    ("i7", "domain")):
    register(f"{_n}_{_label}_risk", _models[_n], _isql[_n])
register("i8_overall", lambda t: module_risk.overall({n: f(t) for n, f in _models.items()}, t["domains"]), "SELECT k, points, CASE WHEN "
    "points < 100 THEN 'green' WHEN points < 250 THEN 'yellow' WHEN points < 400 THEN 'orange' ELSE 'red' END AS band FROM (SELECT k, "
    "CAST(coalesce(sum(points), 0) AS BIGINT) AS points FROM fx_domains LEFT JOIN (" + " UNION ALL ".join(_isql.values())
    + ") USING (k) GROUP BY k)")
register("i9_csp",
    lambda t: t["headers"].filter("csp IS NOT NULL").select(K,
    F.array_join(F.array_sort(F.map_keys(module_risk.csp_directives(c("csp")))), ",").alias("directives"),
    F.element_at(F.map_values(module_risk.csp_directives(c("csp"))), 1).alias("sources")), "SELECT k, split_part(csp, ' ', 1) AS "
    "directives, substr(csp, strpos(csp, ' ') + 1) AS sources FROM fx_http_headers WHERE csp IS NOT NULL")
register("i10_hsts", lambda t: t["headers"].filter("hsts IS NOT NULL").select(K, F.inline(F.array(module_risk.hsts_parts(c("hsts"))))),
    "SELECT k, CAST(regexp_extract(hsts, 'max-age=(\\d+)', 1) AS BIGINT) AS max_age, contains(hsts, 'includeSub') AS subdomains, "
    "contains(hsts, 'preload') AS preload FROM fx_http_headers WHERE hsts IS NOT NULL")
register("i11_email_issues", lambda t: module_risk.email_issues(t["dns"]), f"SELECT k, unnest(list_filter([CASE WHEN txt_spf IS NULL "
    f"THEN 'no_spf' END, CASE WHEN txt_spf IN ('v=spf1 +all', 'v=spf1 ?all') THEN 'permissive_spf' END, CASE WHEN {_look} > 10 THEN "
    f"'spf_over_limit' END, CASE WHEN NOT {_dm} THEN 'no_dmarc' END, CASE WHEN txt_dmarc = 'v=DMARC1; p=none' THEN 'dmarc_none' END, "
    f"CASE WHEN {_dm} AND NOT contains(txt_dmarc, 'rua=') THEN 'no_reporting' END], lambda x: x IS NOT NULL)) AS issue FROM fx_dns_info")
ORACLE["i11_email_issues"] = (with_views("SELECT k, issue, CASE WHEN issue IN ('no_spf', 'permissive_spf', 'no_dmarc') THEN 'high' WHEN "
    "issue = 'no_reporting' THEN 'low' ELSE 'medium' END AS severity FROM (" + f"SELECT k, unnest(list_filter([CASE WHEN txt_spf IS NULL "
    f"THEN 'no_spf' END, CASE WHEN txt_spf IN ('v=spf1 +all', 'v=spf1 ?all') THEN 'permissive_spf' END, CASE WHEN {_look} > 10 THEN "
    f"'spf_over_limit' END, CASE WHEN NOT {_dm} THEN 'no_dmarc' END, CASE WHEN txt_dmarc = 'v=DMARC1; p=none' THEN 'dmarc_none' END, "
    f"CASE WHEN {_dm} AND NOT contains(txt_dmarc, 'rua=') THEN 'no_reporting' END], lambda x: x IS NOT NULL)) AS issue FROM fx_dns_info)"))
register("i12_port_class", lambda t: t["ports"].select(K, "port", module_risk.port_class(c("port")).alias("class")), "SELECT k, port, "
    "CASE WHEN port IN (23, 445, 3389, 2375, 6379, 9200, 27017, 11211) THEN 'CRITICAL' WHEN port IN (21, 22, 3306, 5432, 1433, 5900) "
    "THEN 'HIGH' WHEN port IN (80, 443) THEN 'LOW' ELSE 'MEDIUM' END AS class FROM fx_ports_info")
register("i13_expiry_level", lambda t: module_risk.expiry_level(t["whois"], AS_OF), f"SELECT k, CASE WHEN {_left} < 7 THEN '7' WHEN "
    f"{_left} < 30 THEN '30' ELSE '90' END AS level FROM fx_whois_info WHERE {_left} < 90")
register("i14_compliance", lambda t: module_risk.compliance(t["raw_flags"]), " UNION ALL ".join(f"SELECT k, '{r}' AS regime, NOT "
    f"({' OR '.join(f'coalesce({f}, false)' for f in fs)}) AS passed FROM v_raw_flags" for r, fs in module_risk.CONTROLS.items()))

# ---- J: graph
register("j1_edges", lambda t: t["edges"], "SELECT * FROM v_edges")
register("j2_nodes", lambda t: t["nodes"], "SELECT * FROM v_nodes")
register("j3_index", lambda t: t["indexed"], "SELECT * FROM v_indexed")
register("j3_dropped", lambda t: graph.dropped_edges(t["edges"], t["nodes"].filter("length(id) % 5 > 0")), "SELECT count(*) AS dropped "
    "FROM v_edges WHERE len(source) % 5 = 0 OR len(target) % 5 = 0")
register("j4_cap", lambda t: graph.cap_graph(t["index"], t["indexed"], 5000)[1], "SELECT * FROM v_indexed WHERE greatest(sourceidx, "
    "targetidx) < 5000")
register("j5_degrees", lambda t: graph.degrees(t["index"], t["indexed"]), "SELECT idx, n AS degree, CASE WHEN n > 100 THEN 2 WHEN n > 2 "
    "THEN 1 ELSE 0 END AS hub FROM (SELECT i.idx, count(e.x) AS n FROM v_index i LEFT JOIN (SELECT unnest([sourceidx, targetidx]) AS x "
    "FROM v_indexed) e ON e.x = i.idx GROUP BY i.idx)")
register("j6_neighbours", lambda t: graph.neighbours(t["indexed"], 3), "SELECT DISTINCT CASE WHEN sourceidx = 3 THEN targetidx ELSE "
    "sourceidx END AS idx FROM v_indexed WHERE sourceidx = 3 OR targetidx = 3")

# ---- sketches of each day, merged; what they estimate is held against exact values here
_marks = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def _days(t: Tables) -> DataFrame:
    """The stored form: a row a day of live domains, with a sketch of addresses and one of response times."""
    day = F.to_date("updated_at").alias("day")
    return written(sketches.sketched(findings.live(t).select(day, "ip", "elapsed_ms"), ["day"], {"ips": "ip"}, {"elapsed": "elapsed_ms"}), "days")


def _g10_sketched(t: Tables) -> DataFrame:
    days = _days(t)
    whole = sketches.estimates(sketches.merged(days).select("n", "ips_hll")).crossJoin(days.agg(F.count("*").alias("days")))  # a row each
    exact = findings.live(t).agg(F.countDistinct("ip").alias("exact"))
    near = F.abs(F.col("ips") - F.col("exact")) <= sketches.COUNT_ERROR * F.col("exact") + 1
    return whole.crossJoin(exact).select("days", "n", "exact", near.alias("near"))


def _g7_sketched(t: Tables) -> DataFrame:
    whole = sketches.estimates(sketches.merged(_days(t)).select("elapsed_kll"), _marks)
    rows = findings.live(t).filter("elapsed_ms IS NOT NULL").select("elapsed_ms").crossJoin(F.broadcast(whole))  # whole is one row
    share = lambda c: F.count_if(c) / F.count("*")
    marks = [F.struct(F.lit(n).alias("mark"), (share(F.col("elapsed_ms") < F.col(f"elapsed_{n}")) - sketches.RANK_ERROR <= q).alias("low"),
        (share(F.col("elapsed_ms") <= F.col(f"elapsed_{n}")) + sketches.RANK_ERROR >= q).alias("high")) for n, q in _marks.items()]
    return rows.agg(F.array(*marks).alias("m"), F.count("*").alias("n")).select("n", F.inline("m")).select("n", "mark", (F.col("low") & F.col("high")).alias("near"))


register("g10_sketched", _g10_sketched, f"SELECT count(DISTINCT updated_at) AS days, count(*) AS n, count(DISTINCT ip) AS exact, true AS near FROM {LIVE}")
register("g7_sketched", _g7_sketched, f"SELECT n, unnest({list(_marks)}) AS mark, true AS near FROM (SELECT count(elapsed_ms) AS n FROM {LIVE})")

# ---- K: batch twins of the streams
register("k2_progress", lambda t: streams.progress(t["scan_results"]), "SELECT date_trunc('hour', ts) AS start, count(*) AS completed, "
    "count(*) FILTER (WHERE error_kind IS NULL) AS ok, round(count(*) / 3600.0, 4) AS rate, count(error_kind) AS errors, round(avg(elapsed), 4) AS mean_elapsed FROM fx_scan_results GROUP BY 1")
register("k3_guard_batch", lambda t: risk.error_rate_guard(t["scan_results"], 0.3, 50), "SELECT module, count(*) AS completed, "
    "count(error_kind) AS errors FROM fx_scan_results GROUP BY module HAVING count(*) >= 50 AND count(error_kind) / CAST(count(*) AS "
    "DOUBLE) > 0.3")


def _resent(t: Tables) -> DataFrame:
    """Results sent twice, in files that a stream reads one after another, each once."""
    source, out, state = (_place(t, x) for x in ("sent", "once", "once-state"))
    results = t["scan_results"].select("target", "module", F.col("ts").cast("timestamp").alias("ts")).filter("ts IS NOT NULL")
    results.repartition(4).write.parquet(source)
    results.repartition(2).write.mode("append").parquet(source)
    stream = t.spark.readStream.schema(results.schema).option("maxFilesPerTrigger", 3).parquet(source)
    once = streams.stream_dedupe(stream, ["target", "module", "ts"], "36500 days")  # files come in any order
    once.writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return t.spark.read.schema(results.schema).parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


register("k5_dedupe_stream", _resent, "SELECT DISTINCT target, module, ts FROM fx_scan_results WHERE ts IS NOT NULL")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean risk score by sector."""
    t = Tables(spark, sf_dir)
    return (
        t["flags"].join(t["classes"].select(K, "sector"), K).groupBy("sector").agg(F.count("*").alias("domains"),
        F.avg("score").alias("mean_score")))
_lagged = ", ".join(f"lag({x}) OVER w AS b_{x}" for x in ("ts", "module", "error_kind"))
_changed = ", ".join(f"CASE WHEN {x} IS DISTINCT FROM b_{x} THEN {{'change': 'changed', 'column': '{x}', 'before': b_{x}, 'after': {x}}} END"
    for x in ("module", "error_kind"))
register("k4_changelog_batch", lambda t: streams.changelog(t["scan_results"], "target", ["module", "error_kind"], forget=86400), f"""
SELECT key, e.change, e.column, e.before, e.after FROM (SELECT target AS key, unnest(CASE WHEN b_ts IS NULL OR ts - b_ts > INTERVAL 86400 SECONDS
  THEN [{{'change': 'added', 'column': CAST(NULL AS VARCHAR), 'before': CAST(NULL AS VARCHAR), 'after': CAST(NULL AS VARCHAR)}}]
  ELSE list_filter([{_changed}], lambda x: x IS NOT NULL) END) AS e FROM (SELECT *, {_lagged} FROM fx_scan_results WHERE target IS NOT NULL
  WINDOW w AS (PARTITION BY target ORDER BY ts, module NULLS FIRST, error_kind NULLS FIRST)))""")
