"""SQL twins of the larger operators, as named WITH items over the derived tables."""

from __future__ import annotations

import re

from perispark.functions import rules
from perispark.plans.fixtures import AS_OF, FIXTURES

_ops = " ".join(f"WHEN ends_with(h, '{s}') THEN '{n}'" for s, n in rules.OPERATORS)
_sectors = (
    " ".join(f"WHEN contains(b, '{w}') THEN {{'sector': '{s}', 'subsector': '{u}', 'confidence': CAST({p} AS DOUBLE)}}" for w, s, u,
    p in rules.SECTORS))
_eu = ", ".join(f"'{x}'" for x in rules.EU)
_gov = "{'sector': 'government', 'subsector': '', 'confidence': CAST(%s AS DOUBLE)}"

JURISDICTION = f"CASE WHEN cc IN ('CH', 'US') THEN cc WHEN cc IN ({_eu}) THEN 'EU' ELSE 'OTHER' END"
KEY_OF = ("list_resize(list_transform(string_split({0}, '.'), lambda p: coalesce(TRY_CAST(regexp_extract(p, '^[0-9]+') AS BIGINT), 0)), "
    "6, 0)")
LIST = "coalesce(TRY(from_json({0}, '[\"VARCHAR\"]')), [])"
_tech_rules = ", ".join(f"({p}, {repr(w) if w else 'NULL'}, '{t}')" for p, w, t in rules.PORT_RULES)
_inventory = (
    " ".join(f"WHEN port IN ({', '.join(map(str, p))})" + (f" AND contains(b, '{w}')" if w else "") + f" THEN '{t}'" for p, w,
    t in rules.INVENTORY))
VERSION = """CASE technology
 WHEN 'mysql' THEN nullif(regexp_extract(regexp_replace(regexp_extract(banner, '(?is)mysql[^0-9]*([0-9]\\S*)', 1), '^5\\.5\\.5-', ''), '^[0-9.]*'), '')
 WHEN 'openssh' THEN nullif(regexp_replace(regexp_extract(banner, '(?is)openssh_[^0-9]*([0-9][0-9.p]*)', 1), 'p[0-9].*$', ''), '')
 WHEN 'mssql' THEN nullif(regexp_extract(banner, '(?is)mssql [^0-9]*([0-9][0-9.]*)', 1), '') || coalesce('.' || nullif(regexp_extract(banner, '(?is) build ([0-9]+)', 1), ''), '')
 WHEN 'proftpd' THEN nullif(regexp_extract(banner, '(?is)proftpd[^0-9]*([0-9][0-9.]*)', 1), '')
 WHEN 'vsftpd' THEN nullif(regexp_extract(banner, '(?is)vsftpd[^0-9]*([0-9][0-9.]*)', 1), '')
 WHEN 'redis' THEN nullif(regexp_extract(banner, '(?is)redis [^0-9]*([0-9][0-9.]*)', 1), '')
 WHEN 'elasticsearch' THEN nullif(regexp_extract(banner, '(?is)elasticsearch [^0-9]*([0-9][0-9.]*)', 1), '')
 WHEN 'memcached' THEN nullif(regexp_extract(banner, '(?is)version [^0-9]*([0-9][0-9.]*)', 1), '') END"""
_flag_names = list(rules.WEIGHTS)
_lost = " + ".join(f"CASE WHEN {f} THEN {w} ELSE 0 END" for f, w in rules.WEIGHTS.items())
_dist = (lambda v: f"count(*) AS domain_count, avg({v}) AS mean, quantile_cont({v}, 0.5) AS median, quantile_cont({v}, 0.25) AS p25, "
    f"quantile_cont({v}, 0.75) AS p75, min({v}) AS min, max({v}) AS max")  # noqa: E731
_metrics = " UNION ALL ".join(f"SELECT sector, '{m}' AS metric, CAST({e} AS DOUBLE) AS v FROM v_flags JOIN v_classes USING (k)" for m,
    e in (
    ("risk_score", "score"), ("hsts_adoption", "CASE WHEN NOT missing_hsts THEN 100 ELSE 0 END"),
        ("dnssec_adoption", "CASE WHEN NOT no_dnssec THEN 100 ELSE 0 END"),
        ("dmarc_weak_pct", "CASE WHEN dmarc_weak THEN 100 ELSE 0 END")))

VIEWS = {
    "v_classes": f"SELECT k, s.sector AS sector, s.subsector AS subsector, s.confidence AS confidence FROM (SELECT k, CASE WHEN d = "
        f"'admin.ch' OR ends_with(d, '.admin.ch') THEN {_gov % 0.95} WHEN regexp_matches(d, '(^|\\.)({'|'.join(rules.CANTONS)})\\.ch$') "
        f"THEN {_gov % 0.9} {_sectors} END AS s FROM (SELECT k, lower(domain) AS d, lower(domain) || ' ' || lower(coalesce(title, '')) "
        f"AS b FROM fx_domains)) WHERE s IS NOT NULL",
    "v_hosts": f"SELECT k, host, CASE {_ops} WHEN contains(h, 'awsdns') THEN 'AWS Route53' ELSE array_to_string(string_split(h, "
        f"'.')[-2:], '.') END AS operator FROM (SELECT k, host, lower(regexp_replace(host, '\\.+$', '')) AS h FROM (SELECT k, "
        f"unnest({LIST.format('ns')}) AS host FROM fx_dns_info))",
    "v_staging": "SELECT DISTINCT k, operator FROM v_hosts",
    "v_operators": f"SELECT operator, cc AS country_code, {JURISDICTION} AS jurisdiction FROM (SELECT DISTINCT s.operator, "
        f"c.country_code AS cc FROM v_staging s LEFT JOIN fx_operator_country c USING (operator))",
    "v_sovereign": "SELECT d.*, s AS sovereignty_score FROM fx_domains d LEFT JOIN (SELECT k, max(CASE jurisdiction WHEN 'US' THEN 3 "
        "WHEN 'OTHER' THEN 2 WHEN 'EU' THEN 1 ELSE 0 END) AS s FROM v_staging JOIN v_operators USING (operator) GROUP BY k) USING (k)",
    "v_http_matches": "SELECT k, technology, CASE WHEN strpos(lower(server), technology || '/') > 0 THEN "
        "split_part(substr(lower(server), strpos(lower(server), technology || '/') + len(technology) + 1), ' ', 1) END AS version, "
        "cve_id, severity, cvss_score, in_kev FROM fx_domains JOIN fx_cve_catalog ON lower(coalesce(cms, '')) = technology OR "
        "contains(lower(coalesce(server, '')), technology) OR contains(lower(coalesce(powered_by, '')), technology)",
    "v_port_rules": f"SELECT * FROM (VALUES {_tech_rules}) AS t(port, needle, technology)",
    "v_port_matches": "SELECT DISTINCT p.k, technology, CAST(NULL AS VARCHAR) AS version, cve_id, severity, cvss_score, in_kev FROM "
        "fx_ports_info p JOIN v_port_rules r ON p.port = r.port AND (needle IS NULL OR contains(lower(coalesce(banner, '')), needle)) "
        "JOIN fx_cve_catalog USING (technology)",
    "v_combined": "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY k, cve_id ORDER BY version NULLS LAST, "
        "technology) AS r FROM (SELECT * FROM v_http_matches UNION SELECT * FROM v_port_matches)) WHERE r = 1",
    "v_port_versions": f"SELECT k, technology, arg_max(v, {{'a': {KEY_OF.format('v')}, 'b': v}}) AS found FROM (SELECT k, technology, "
        f"{VERSION} AS v FROM fx_ports_info p JOIN v_port_rules r ON p.port = r.port AND contains(lower(banner), CASE WHEN technology = "
        f"'memcached' THEN 'version ' ELSE needle END)) WHERE v IS NOT NULL GROUP BY ALL",
    "v_versioned": "SELECT k, technology, coalesce(found, version) AS version, cve_id, severity, cvss_score, in_kev FROM v_combined LEFT "
        "JOIN v_port_versions USING (k, technology)",
    "v_matches": f"SELECT m.* FROM v_versioned m JOIN fx_cve_catalog c USING (cve_id) WHERE version IS NULL OR NOT "
        f"regexp_matches(version, '[0-9]') OR (coalesce({KEY_OF.format('version')} >= {KEY_OF.format('affected_from')}, true) AND "
        f"coalesce({KEY_OF.format('version')} <= {KEY_OF.format('affected_to')}, true))",
    "v_port_flags": "SELECT k, bool_or(port IN (3306, 5432, 6379, 9200, 27017, 11211)) AS db, bool_or(port IN (445, 23, 3389, 5900)) AS "
        "risky, bool_or(port = 21) AS ftp, bool_or(port = 2375) AS docker FROM fx_ports_info GROUP BY k",
    "v_critical": "SELECT k, bool_or(severity = 'CRITICAL') AS critical FROM v_matches GROUP BY k",
    "v_raw_flags": f"""SELECT d.k, coalesce(d.sovereignty_score, 0) AS sovereignty_score,
 hsts IS NULL AND status_code = 200 AS missing_hsts, csp IS NULL
 AND status_code = 200 AS missing_csp, len({LIST.format('n.caa')}) = 0 AS missing_caa,
 replace(tls_version, '_', '.') IN ('TLSv1.0', 'TLSv1.1')
 OR valid_to < DATE '{AS_OF}' AS weak_tls, valid_to < DATE '{AS_OF}' AS cert_expired, valid_to - DATE '{AS_OF}' BETWEEN 0
 AND 29 AS cert_expiring,
 NOT coalesce(dnssec_signed, false) AS no_dnssec, CASE WHEN e.k IS NOT NULL THEN coalesce(e.dmarc_policy = 'none', false)
 OR NOT coalesce(dmarc_present, false) ELSE txt_dmarc IS NULL END AS dmarc_weak,
 expires_at < DATE '{AS_OF}' + 30 AS domain_expiring, coalesce(db, false) AS exposed_db_port, coalesce(risky, false) AS exposed_risky_port, coalesce(ftp, false) AS exposed_ftp, coalesce(docker, false) AS exposed_docker_api,
 coalesce(critical, false) AS has_critical_cve, coalesce(spf_too_permissive, false) AS spf_permissive, NOT coalesce(dkim_found, false) AS no_dkim
 FROM v_sovereign d LEFT JOIN fx_http_headers USING (k) LEFT JOIN fx_dns_info n USING (k) LEFT JOIN fx_tls_info USING (k) LEFT
 JOIN fx_whois_info USING (k) LEFT JOIN fx_email_security e USING (k) LEFT JOIN v_port_flags USING (k) LEFT JOIN v_critical USING (k)""",
    "v_flags": f"SELECT *, greatest(0, 100 - ({_lost}) - CASE sovereignty_score WHEN 3 THEN 5 WHEN 2 THEN 3 WHEN 1 THEN 1 ELSE 0 END) AS "
        f"score FROM v_raw_flags",
    "v_orphans": "SELECT k, cname FROM fx_dns_info WHERE cname IS NOT NULL AND cname NOT IN (SELECT DISTINCT 'old' || CAST(o_orderkey % "
        "40 AS STRING) || '.app.example.com' FROM orders)",
    "v_squats": """WITH n AS (SELECT DISTINCT name FROM fx_names) SELECT a.name AS a, b.name AS b FROM n a JOIN n b
 ON a.name < b.name AND abs(len(a.name) - len(b.name)) <= 1 AND (levenshtein(a.name, b.name) <= 1
 OR translate(a.name, '10', 'lo') = translate(b.name, '10', 'lo')
 OR (len(a.name) = len(b.name) AND levenshtein(a.name, b.name) = 2 AND damerau_levenshtein(a.name, b.name) = 1))""",
    "v_lookalikes": "SELECT DISTINCT k FROM fx_names WHERE name IN (SELECT a FROM v_squats UNION SELECT b FROM v_squats)",
    "v_long": _metrics,
    "v_bench": f"SELECT sector, metric, {_dist('v')} FROM v_long GROUP BY ALL",
    "v_services": f"SELECT k, port, technology, {VERSION} AS version FROM (SELECT *, CASE {_inventory} ELSE 'unknown' END AS technology "
        f"FROM (SELECT *, lower(coalesce(banner, '')) AS b FROM fx_ports_info))",
    "v_pairs": "SELECT d.domain, v_hosts.host FROM fx_dns_info n JOIN fx_domains d USING (k) LEFT JOIN v_hosts USING (k)",
    "v_edges": "SELECT domain AS source, CASE WHEN trim(coalesce(host, '')) = '' THEN '(no-ns)' ELSE "
        "array_to_string(string_split(lower(regexp_replace(host, '\\.+$', '')), '.')[-2:], '.') END AS target, 'uses_ns' AS type FROM "
        "v_pairs",
    "v_nodes": "SELECT id, id AS label, min(type) AS type FROM (SELECT source AS id, 'domain' AS type FROM v_edges UNION ALL SELECT "
        "target, 'ns' FROM v_edges) GROUP BY id",
    "v_index": "SELECT id, label, type, row_number() OVER (ORDER BY id) - 1 AS idx FROM v_nodes",
    "v_indexed": "SELECT source, target, e.type, s.idx AS sourceidx, t.idx AS targetidx FROM v_edges e JOIN v_index s ON s.id = source "
        "JOIN v_index t ON t.id = target",
}


def with_views(sql: str) -> str:
    """sql with the derived tables and views that it needs as leading WITH items."""
    every = FIXTURES | VIEWS
    needed: set[str] = set()

    def add(text: str) -> None:
        for name in set(re.findall(r"\b(?:fx|v)_\w+", text)) & set(every) - needed:
            needed.add(name)
            add(every[name])

    add(sql)
    items = ", ".join(f"{n} AS ({every[n].strip()})" for n in every if n in needed)
    if not items:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {items}, {body[15:]}"
    return f"WITH {items}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {items} {body}"
