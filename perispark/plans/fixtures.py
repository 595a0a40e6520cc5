"""Derived input tables: expressions over the given tables, the same text for Spark and for the SQL oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from perispark.functions import catalogue
from perispark.operators.dealing import parts

AS_OF = "2001-08-01"


def _quoted(v: str | float | None) -> str:
    if v is None:
        return "NULL"
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def _catalogue_rows() -> str:
    """The built-in catalogue as SQL rows; ids that end in an odd digit stand for known exploited ones. One row
    has no range and no score."""
    rows = [(cve, t, low, high, sev, cvss) for t, cve, sev, cvss, low, high, _ in catalogue.SEED]
    rows.append(("CVE-0000-0001", "apache", None, None, "CRITICAL", None))
    return ", ".join(f"({', '.join(map(_quoted, r))}, {'true' if int(r[0][-1]) % 2 else 'false'})" for r in rows)


FIXTURES = {
    "fx_domains": r"""
SELECT d.*, CASE WHEN k % 4 = 0 THEN 'http://' ELSE 'https://' END || CASE WHEN k % 5 = 0 THEN 'parking.example.net'
  WHEN k % 2 = 0 THEN 'www.' || domain ELSE domain END || '/' AS final_url FROM (
SELECT o_orderkey AS k,
 CASE o_orderkey % 12 WHEN 0 THEN 'kantonalbank' WHEN 1 THEN 'klinik' WHEN 2 THEN 'schule' WHEN 3 THEN 'shop' WHEN 4 THEN 'news'
  WHEN 5 THEN 'anwalt' WHEN 6 THEN 'pharma' WHEN 7 THEN 'gemeinde' ELSE 'site' END || '-' || CAST(o_orderkey AS STRING) || CASE
  WHEN o_orderkey % 97 = 0 THEN '.admin.ch' WHEN o_orderkey % 89 = 0 THEN '.zh.ch' ELSE '.ch' END AS domain,
 CASE WHEN o_orderkey % 23 = 22 THEN NULL WHEN o_orderkey % 17 IN (0,5,9,13) THEN 'error' ELSE 'ok' END AS status,
 CASE WHEN o_orderkey % 23 = 22 OR o_orderkey % 17 IN (0,5,9,13) THEN NULL WHEN o_orderkey % 7 < 4 THEN 200
  WHEN o_orderkey % 7 < 6 THEN 206 ELSE 403 END AS status_code,
 CASE WHEN o_orderkey % 23 <> 22 AND o_orderkey % 17 IN (0,5,9,13) THEN CASE o_orderkey % 5 WHEN 0 THEN 'timeout'
  WHEN 1 THEN 'tls_failed' WHEN 2 THEN 'refused' ELSE 'dns' END END AS error_kind,
 CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'Spital Portal'
  ELSE 'Willkommen ' || CAST(o_orderkey % 40 AS STRING) END AS title,
 CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE md5(CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 50 ELSE o_orderkey
  END AS STRING)) END AS body_hash,
 100 + (o_orderkey * 7919) % 9000 AS elapsed_ms,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL
  ELSE CAST(11 + o_orderkey % 180 AS STRING) || '.' || CAST(o_orderkey % 7 AS STRING) || '.0.' || CAST(1 + o_orderkey % 3 AS STRING)
  END AS ip,
 CASE o_orderkey % 6 WHEN 0 THEN 'Apache/2.4.' || CAST(o_orderkey % 60 AS STRING) || ' (Unix)'
  WHEN 1 THEN 'nginx/1.' || CAST(o_orderkey % 27 AS STRING) || '.0' WHEN 2 THEN 'cloudflare' WHEN 3 THEN 'Pepyaka'
  WHEN 4 THEN 'Microsoft-IIS/' || CAST(6 + o_orderkey % 5 AS STRING) || '.0' END AS server,
 CASE o_orderkey % 10 WHEN 0 THEN 'PHP/7.4.33' WHEN 1 THEN 'PHP/8.2.30' WHEN 2 THEN 'PHP/5.6.40' WHEN 3 THEN 'ASP.NET' END AS powered_by,
 CASE o_orderkey % 8 WHEN 0 THEN 'WordPress' WHEN 1 THEN 'TYPO3' WHEN 2 THEN 'Joomla' WHEN 3 THEN 'Drupal' WHEN 4 THEN 'apache'
  END AS cms,
 CASE WHEN o_orderkey % 8 = 0 AND o_orderkey % 7 <> 3 THEN CASE o_orderkey % 3
  WHEN 0 THEN '6.' || CAST(o_orderkey % 11 AS STRING) || '.1' WHEN 1 THEN '5.9' ELSE '6.8' END END AS cms_version,
 CASE o_orderkey % 20 WHEN 0 THEN 'US' WHEN 1 THEN 'US' WHEN 2 THEN 'DE' WHEN 3 THEN 'DE' WHEN 4 THEN 'FR' WHEN 5 THEN 'RU'
  WHEN 6 THEN 'SG' WHEN 7 THEN NULL ELSE 'CH' END AS country_code,
 CASE WHEN o_orderkey % 23 = 22 THEN NULL ELSE o_orderdate END AS updated_at
FROM orders) d
""",
    "fx_http_headers": r"""
SELECT o_orderkey AS k,
 CASE o_orderkey % 4 WHEN 0 THEN 'max-age=31536000; includeSubDomains; preload' WHEN 1 THEN 'max-age=3600' END AS hsts,
 CASE o_orderkey % 9 WHEN 0 THEN 'default-src ''self''' WHEN 1 THEN 'default-src ''self'' ''unsafe-inline'''
  WHEN 2 THEN 'script-src *' END AS csp,
 CASE o_orderkey % 5 WHEN 0 THEN 'DENY' WHEN 1 THEN 'SAMEORIGIN' END AS x_frame_options,
 CASE WHEN o_orderkey % 3 = 0 THEN 'nosniff' END AS x_content_type_options,
 CASE WHEN o_orderkey % 41 = 0 THEN '*' END AS cors_origin,
 CASE o_orderkey % 6 WHEN 0 THEN 'no-referrer' WHEN 1 THEN 'unsafe-url' END AS referrer_policy,
 CASE WHEN o_orderkey % 15 = 0 THEN 'geolocation=()' END AS permissions_policy
FROM orders WHERE o_orderkey % 7 < 4
""",
    "fx_dns_info": r"""
SELECT o_orderkey AS k,
 CASE WHEN o_orderkey % 29 = 0 THEN '[]' ELSE '["ns1.' || CASE o_orderkey % 9 WHEN 0 THEN 'hostpoint.ch' WHEN 1 THEN 'infomaniak.ch'
  WHEN 2 THEN 'cloudflare.com' WHEN 3 THEN 'domaincontrol.com' WHEN 4 THEN 'awsdns-07.org' WHEN 5 THEN 'hetzner.com'
  ELSE 'op' || CAST(o_orderkey % 37 AS STRING) || '.net' END || '","ns2.' || CASE WHEN o_orderkey % 10 = 0 THEN 'ultradns.net'
  ELSE 'hostpoint.ch' END || '."]' END AS ns,
 CASE WHEN o_orderkey % 3 = 0 THEN '[]' ELSE '["mx.mail' || CAST(o_orderkey % 5 AS STRING) || '.ch"]' END AS mx,
 CASE WHEN o_orderkey % 60 = 0 THEN '["0 issue letsencrypt.org"]' WHEN o_orderkey % 2 = 0 THEN '[]' END AS caa,
 CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'v=spf1 include:a.ch include:b.ch mx -all' WHEN 2 THEN 'v=spf1 +all'
  WHEN 3 THEN 'v=spf1 a ~all' WHEN 4 THEN 'v=spf1 ?all'
  ELSE 'v=spf1 include:a include:b include:c include:d include:e include:f include:g include:h include:i include:j include:k -all'
  END AS txt_spf,
 CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'v=DMARC1; p=none' WHEN 2 THEN 'v=DMARC1; p=reject; rua=mailto:x@y.ch'
  WHEN 3 THEN 'v=DMARC1; p=quarantine; sp=reject; pct=50' ELSE 'not a policy' END AS txt_dmarc,
 CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderkey % 12 < 5 END AS dnssec_signed,
 o_orderkey % 13 <> 0 AS dnssec_valid,
 CASE WHEN o_orderkey % 46 = 0 THEN NULL ELSE o_orderkey % 47 = 0 END AS axfr_open,
 CASE o_orderkey % 8 WHEN 0 THEN 60 WHEN 1 THEN 172800 WHEN 2 THEN NULL ELSE 3600 END AS ttl,
 o_orderkey % 10 < 3 AS wildcard,
 CASE WHEN o_orderkey % 33 = 0 THEN 'old' || CAST(o_orderkey % 50 AS STRING) || '.app.example.com' END AS cname,
 o_orderdate AS resolved_at
FROM orders WHERE o_orderkey % 11 <> 10
""",
    "fx_tls_info": r"""
SELECT o_orderkey AS k, 'ok' AS status,
 CASE o_orderkey % 9 WHEN 0 THEN 'CN=DigiCert' WHEN 1 THEN 'CN=Sectigo' WHEN 2 THEN 'CN=SwissSign' ELSE 'CN=R3, O=Let''s Encrypt'
  END AS cert_issuer,
 CASE WHEN o_orderkey % 9 = 2 AND o_orderkey % 4 = 0 THEN 'CN=SwissSign' ELSE 'CN=site' END AS cert_subject,
 DATE '2001-08-01' + CAST(o_orderkey % 400 - 20 AS INT) AS valid_to,
 CASE o_orderkey % 14 WHEN 0 THEN 'TLSv1_2' WHEN 1 THEN 'TLSv1.1' ELSE 'TLSv1_3' END AS tls_version,
 CASE o_orderkey % 10 WHEN 0 THEN '1.2.840.10045.2.1' WHEN 1 THEN '1.3.101.112' ELSE '1.2.840.113549.1.1.1' END AS key_oid,
 CASE o_orderkey % 10 WHEN 0 THEN 256 WHEN 1 THEN 256 WHEN 2 THEN 4096 WHEN 3 THEN 1024 ELSE 2048 END AS key_size,
 CASE o_orderkey % 15 WHEN 0 THEN 'SHA1withRSA' WHEN 1 THEN 'SHA384withECDSA' ELSE 'SHA256withRSA' END AS signature,
 CASE WHEN o_orderkey % 25 <> 0 THEN o_orderkey % 4 <> 0 END AS stapled,
 CASE o_orderkey % 18 WHEN 0 THEN 'TLS_RSA_WITH_RC4_128_SHA' WHEN 1 THEN 'TLS_RSA_WITH_3DES_EDE_CBC_SHA' WHEN 2 THEN NULL
  ELSE 'TLS_AES_128_GCM_SHA256' END AS cipher,
 o_orderkey % 6 <> 0 AS ct_logged
FROM orders WHERE o_orderkey % 5 < 3
""",
    "fx_ports_info": r"""
SELECT k, port,
 CASE port WHEN 3306 THEN CASE k % 3 WHEN 0 THEN 'MySQL 8.0.30' WHEN 1 THEN 'MySQL 8.0.42' ELSE 'MySQL 5.5.5-5.5.60-MariaDB-log' END
  WHEN 22 THEN CASE k % 2 WHEN 0 THEN 'SSH-2.0-OpenSSH_9.3p1 U' ELSE 'SSH-2.0-OpenSSH_9.8p1 U' END WHEN 21 THEN CASE k % 3
  WHEN 0 THEN '220 ProFTPD 1.3.5 Server' WHEN 1 THEN '220 (vsFTPd 2.3.4)' ELSE NULL END
  WHEN 6379 THEN 'Redis 6.2.' || CAST(k % 9 AS STRING) WHEN 9200 THEN 'Elasticsearch 7.13.3' WHEN 11211 THEN 'VERSION 1.6.9'
  WHEN 1433 THEN 'MSSQL 15.0 build 2000' END AS banner,
 CASE WHEN k % 8 = 0 THEN '127.0.0.1' WHEN k % 8 = 1 THEN NULL ELSE '198.51.0.' || CAST(k % 200 AS STRING) END AS ip
FROM (SELECT DISTINCT l_orderkey AS k, CASE (l_partkey + l_linenumber) % 14 WHEN 0 THEN 3306 WHEN 1 THEN 21 WHEN 2 THEN 22
  WHEN 3 THEN 445 WHEN 4 THEN 3389 WHEN 5 THEN 6379 WHEN 6 THEN 9200 WHEN 7 THEN 27017 WHEN 8 THEN 2375 WHEN 9 THEN 5432
  WHEN 10 THEN 11211 WHEN 11 THEN 1433 WHEN 12 THEN 8080 ELSE 443 END AS port FROM lineitem) p
""",
    "fx_whois_info": r"""
SELECT o_orderkey AS k, 'Registrar ' || CAST(o_orderkey % 25 AS STRING) AS registrar,
 CAST(o_orderdate AS DATE) AS whois_created,
 CASE WHEN o_orderkey % 21 = 0 THEN NULL ELSE DATE '2001-08-01' + CAST(o_orderkey % 700 - 60 AS INT) END AS expires_at,
 'Active' AS status, o_orderkey % 9 < 4 AS dnssec_delegated
FROM orders WHERE o_orderkey % 5 <> 4
""",
    "fx_whois_raw": r"""
SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 'REGISTRAR:' WHEN 1 THEN '  Registrar:' ELSE 'Registrar:' END
 || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) WHEN o_orderkey % 13 = 0 THEN chr(10) || chr(10) ELSE ' ' END
 || CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE 'Registrar ' || CAST(o_orderkey % 25 AS STRING) END || chr(10)
 || 'First registration date: ' || CASE WHEN o_orderkey % 10 = 0 THEN 'before '
 ELSE '' END || CAST(CAST(o_orderdate AS DATE) AS STRING) || chr(10)
 || CASE o_orderkey % 4 WHEN 0 THEN 'Expires: ' WHEN 1 THEN 'Expiry date: ' WHEN 2 THEN 'Expiration date: ' ELSE 'Ends: ' END
 || CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 300 AS INT) AS STRING) || CASE o_orderkey % 6 WHEN 0 THEN ' 12:00:00 UTC'
 ELSE '' END || chr(10)
 || CASE o_orderkey % 3 WHEN 0 THEN 'State: Active' WHEN 1 THEN 'Status: ok' || chr(10) || 'State: Late'
 ELSE 'Comment: none' END || chr(10)
 || CASE o_orderkey % 6 WHEN 0 THEN 'DNSSEC:Y' WHEN 1 THEN 'DNSSEC:N' WHEN 2 THEN 'DNSSEC: Signed delegation'
 WHEN 3 THEN 'dnssec: yes, all'
 WHEN 4 THEN 'DNSSEC: unsigned' ELSE '' END AS text
FROM orders WHERE o_orderkey % 5 <> 4
""",
    "fx_email_security": r"""
SELECT o_orderkey AS k, o_orderkey % 6 <> 0 AS spf_present, o_orderkey % 6 IN (2,4) AS spf_too_permissive,
 o_orderkey % 5 IN (1,2,3) AS dmarc_present, CASE o_orderkey % 5 WHEN 1 THEN 'none' WHEN 2 THEN 'reject' WHEN 3 THEN 'quarantine'
  END AS dmarc_policy,
 o_orderkey % 14 = 0 AS dkim_found
FROM orders WHERE o_orderkey % 11 <> 10
""",
    "fx_subdomains": r"""
SELECT DISTINCT l_orderkey AS k, 'h' || CAST(l_linenumber AS STRING) || '.site-' || CAST(l_orderkey AS STRING) || '.ch' AS subdomain,
 CASE l_orderkey % 10 WHEN 0 THEN 'axfr' WHEN 1 THEN 'ct' ELSE 'mx_ns' END AS source
FROM lineitem
""",
    "fx_cve_catalog": f"""
SELECT cve_id, technology, affected_from, affected_to, severity, CAST(cvss_score AS DOUBLE) AS cvss_score, in_kev
FROM (VALUES {_catalogue_rows()}) AS t(cve_id, technology, affected_from, affected_to, severity, cvss_score, in_kev)
""",
    "fx_supported": r"""
SELECT * FROM (VALUES ('php', '8.1'), ('apache', '2.4.50'), ('nginx', '1.20'), ('mysql', '8.0.0'), ('openssh', '9.0'),
  ('iis', '10.0')) AS t(technology, least)
""",
    "fx_suffixes": r"""
SELECT * FROM (VALUES ('ch'), ('net'), ('com'), ('admin.ch'), ('zh.ch')) AS t(suffix)
""",
    "fx_ip_ranges": r"""
SELECT * FROM (VALUES (11,40,'CH',65001,'Org A'), (41,80,'DE',65002,'Org B'), (81,110,'US',65003,'Org C'),
  (111,140,'FR',65004,'Org D'), (141,160,'GB',65005,'Org E'),
  (161,185,'CH',65006,'Org F')) AS t(lo_octet, hi_octet, country_code, asn, asn_org)
""",
    "fx_suffix_rules": r"""
SELECT * FROM (VALUES ('ch'), ('uk'), ('co.uk'), ('ck'), ('*.ck'), ('!www.ck'), ('jp'), ('*.kawasaki.jp'), ('!city.kawasaki.jp')) AS t(suffix)
""",
    "fx_rule_hosts": r"""
SELECT o_orderkey AS k, CASE o_orderkey % 11 WHEN 0 THEN 'A' || CAST(o_orderkey AS STRING) || '.b.ck' WHEN 1 THEN 'x.www.ck' WHEN 2 THEN 'www.ck'
  WHEN 3 THEN 'b.ck' WHEN 4 THEN 'a.s' || CAST(o_orderkey AS STRING) || '.co.uk.' WHEN 5 THEN 'co.uk' WHEN 6 THEN 'l.m.n.kawasaki.jp'
  WHEN 7 THEN 'q.City.kawasaki.jp' WHEN 8 THEN 'solo' WHEN 9 THEN NULL ELSE 'p.q' || CAST(o_orderkey % 50 AS STRING) || '.test' END AS host FROM orders
""",
    # address ranges that nest but never cross: wide ones, one inside each 512 addresses, a few addresses inside that
    "fx_slots": r"""
SELECT (l_orderkey * 8 + l_linenumber) % 8388608 AS slot, min(l_partkey) AS p FROM lineitem GROUP BY 1
""",
    "fx_network_numbers": r"""
SELECT 4 AS family, slot AS place, slot * 512 + 1 + p % 100 AS low, slot * 512 + 300 + p % 200 AS high, p FROM fx_slots
UNION ALL SELECT 4, slot, slot * 512 + 150 + p % 100, slot * 512 + 150 + p % 100 + p % 4, p + 1 FROM fx_slots
UNION ALL SELECT 4, min(slot), (slot >> 9) * 262144, (slot >> 9) * 262144 + 262143, (slot >> 9) + 2 FROM fx_slots GROUP BY slot >> 9
UNION ALL SELECT 6, slot, 1 + p % 100, 65000 + p % 500, p + 3 FROM fx_slots
UNION ALL SELECT 6, slot, 200 + p % 100, 200 + p % 100 + p % 4, p + 4 FROM fx_slots
""",
    "fx_networks": r"""
SELECT CASE family WHEN 4 THEN CAST(low >> 24 AS STRING) || '.' || CAST((low >> 16) & 255 AS STRING) || '.' || CAST((low >> 8) & 255 AS STRING)
   || '.' || CAST(low & 255 AS STRING) ELSE '2001:DB8:' || hex(place >> 16) || ':' || hex(place & 65535) || '::' || hex(low) END AS start,
 CASE family WHEN 4 THEN CAST(high >> 24 AS STRING) || '.' || CAST((high >> 16) & 255 AS STRING) || '.' || CAST((high >> 8) & 255 AS STRING)
   || '.' || CAST(high & 255 AS STRING) ELSE '2001:db8:' || hex(place >> 16) || ':' || hex(place & 65535) || ':0:0:0:' || hex(high) END AS stop,
 CASE family WHEN 4 THEN '4' || lpad(hex(low), 8, '0') ELSE '6' || lpad(hex(place), 12, '0') || lpad(hex(low), 4, '0') END AS start_key,
 CASE family WHEN 4 THEN '4' || lpad(hex(high), 8, '0') ELSE '6' || lpad(hex(place), 12, '0') || lpad(hex(high), 4, '0') END AS stop_key,
 CASE p % 5 WHEN 0 THEN 'CH' WHEN 1 THEN 'US' WHEN 2 THEN 'DE' WHEN 3 THEN 'FR' ELSE 'JP' END AS country_code,
 64512 + p % 1000 AS asn, 'Org ' || CAST(p % 1000 AS STRING) AS asn_org
FROM fx_network_numbers
""",
    "fx_addresses": r"""
SELECT k, CASE k % 6 WHEN 1 THEN '2001:DB8:' || hex(slot >> 16) || ':' || hex(slot & 65535) || '::' || hex(off)
  WHEN 2 THEN '2001:0db8:' || hex(slot >> 16) || ':' || lpad(hex(slot & 65535), 4, '0') || ':0:0:0:' || hex(off)
  WHEN 3 THEN '::ffff:' || v4 WHEN 4 THEN '2001:db8:' || hex(slot >> 16) || ':' || hex(slot & 65535) || '::0.0.' || CAST(off >> 8 AS STRING)
   || '.' || CAST(off & 255 AS STRING)
  WHEN 5 THEN CASE k % 4 WHEN 0 THEN '300.1.1.1' WHEN 1 THEN 'none' WHEN 2 THEN '1::2::3' END ELSE v4 END AS ip,
 CASE k % 6 WHEN 5 THEN NULL WHEN 0 THEN '4' || lpad(hex(n), 8, '0') WHEN 3 THEN '4' || lpad(hex(n), 8, '0')
  ELSE '6' || lpad(hex(slot), 12, '0') || lpad(hex(off), 4, '0') END AS ip_key
FROM (SELECT *, CAST(n >> 24 AS STRING) || '.' || CAST((n >> 16) & 255 AS STRING) || '.' || CAST((n >> 8) & 255 AS STRING) || '.'
  || CAST(n & 255 AS STRING) AS v4 FROM (SELECT *, slot * 512 + off AS n FROM (
  SELECT o_orderkey AS k, (o_orderkey * 8 + 1 + o_orderkey % 7) % 8388608 AS slot, (o_orderkey * 37) % 512 AS off FROM orders)))
""",
    "fx_operator_country": r"""
SELECT * FROM (VALUES ('Hostpoint','CH'), ('Infomaniak','CH'), ('Cloudflare','US'), ('GoDaddy','US'), ('AWS Route53','US'),
  ('Hetzner','DE')) AS t(operator, country_code)
""",
    "fx_ports_legacy": r"""
SELECT o_orderkey AS k, CAST(o_orderkey % 2 AS INT) AS p80, 1 AS p443, CAST(o_orderkey % 5 AS INT) AS p22, CASE
  WHEN o_orderkey % 9 = 0 THEN 1 END AS p21 FROM orders
""",
    "fx_snapshot_2": r"""
SELECT o_orderkey + 500 AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'error' ELSE 'ok' END AS status, CASE
  WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'srv' || CAST(o_orderkey % 3 AS STRING) END AS server FROM orders WHERE o_orderkey % 20 <> 19
""",
    "fx_names": r"""
SELECT o_orderkey AS k, substr(md5(CAST(o_custkey AS STRING)), 1, 7) || CASE o_orderkey % 6 WHEN 0 THEN 'bank' WHEN 1 THEN 'bnak'
  WHEN 2 THEN 'poo1' WHEN 3 THEN 'p0ol' WHEN 4 THEN 'bonk' ELSE 'pool' END AS name FROM orders
""",
    "fx_glyphs": r"""
SELECT o_orderkey AS k, substr(md5(CAST(o_custkey AS STRING)), 1, 7) || CASE o_orderkey % 5 WHEN 0 THEN 'bank' WHEN 1 THEN 'bаnk'
  WHEN 2 THEN 'poo1' WHEN 3 THEN 'рool' ELSE 'other' END AS name FROM orders
""",
    "fx_blocklist": r"""
SELECT o_orderkey AS k, 'feed' || CAST(o_orderkey % 2 AS STRING) AS feed FROM orders WHERE o_orderkey % 50 = 7
""",
    "fx_scan_results": r"""
SELECT event_id, ts, 'm' || CAST(user_id % 6 AS STRING) AS module, user_id AS target, CASE
  WHEN event_type = 'error' OR (user_id % 6 = 3 AND event_id % 10 < 6) THEN 'timeout' END AS error_kind, value AS elapsed FROM events
""",
    "fx_pages": r"""
SELECT page_id, url, html || CASE page_id % 8 WHEN 0 THEN '<link href="/wp-content/x.css">'
  WHEN 4 THEN '<script src="/typo3conf/a.js"></script>' ELSE '' END AS html FROM pages
""",
}

SOURCES = ("orders", "lineitem", "events", "pages")
#: Derived tables that make rows of lineitem distinct: those are dealt by this column before, over a part for each LINES.
DEALT, LINES = {"fx_ports_info": "l_orderkey", "fx_subdomains": "l_orderkey"}, 1_000_000


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table over the tables of sf_dir."""
    return derived(spark, sf_dir, _text(name))


def _text(name: str) -> str:
    text = FIXTURES[name]
    return re.sub(r"FROM lineitem\b", f"FROM dealt_{DEALT[name]}", text) if name in DEALT else text


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the given tables, read from sf_dir, and over derived tables that stand after FROM."""
    while of := re.search(r"FROM (fx_\w+)", sql):
        sql = sql.replace(of.group(), f"FROM ({_text(of.group(1))})")
    for column in set(DEALT.values()):
        if f"FROM dealt_{column}" in sql:
            lines = f"FROM parquet.`{sf_dir}/lineitem.parquet`"
            n = parts(spark.sql(f"SELECT 1 {lines}"), LINES)
            sql = sql.replace(f"FROM dealt_{column}", f"FROM (SELECT /*+ REPARTITION({n}, {column}) */ * {lines})")
    for table in SOURCES:
        sql = re.sub(rf"FROM {table}\b", f"FROM parquet.`{sf_dir}/{table}.parquet`", sql)
    return spark.sql(sql)
