"""Scalar rules as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from perispark.functions import rules


def _first(cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first case that holds."""
    out = reduce(lambda w, c: w.when(*c), cases[1:], F.when(*cases[0]))
    return out if otherwise is None else out.otherwise(otherwise)


def _any_word(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def sanitize_domain(c: Column) -> Column:
    """The bare host: no scheme, path, outer blanks and dots; null if empty, over 253 bytes, or with
    a control byte, blank, comma or quote."""
    host = F.regexp_replace(F.regexp_replace(F.trim(c), r"^https?://", ""), r"/[\s\S]*$", "")
    host = F.regexp_replace(F.regexp_replace(F.trim(host), r"^\.+|\.+$", ""), r"^\s+|\s+$", "")
    return F.when((host != "") & (F.octet_length(host) <= 253) & ~host.rlike(r"[\x00-\x20,\"']"), host)


def should_try_www(c: Column) -> Column:
    return ~(F.startswith(F.lower(c), F.lit("www.")) | c.rlike(r"^[0-9.]*$"))


def candidate_urls(c: Column) -> Column:
    www = should_try_www(c)
    every = F.array(F.concat(F.lit("https://"), c), F.when(www, F.concat(F.lit("https://www."), c)), F.concat(F.lit("http://"), c),
        F.when(www, F.concat(F.lit("http://www."), c)))
    return F.array_compact(every)


def dedupe_sorted(arr: Column) -> Column:
    clean = F.transform(arr, lambda x: F.trim(F.regexp_replace(F.trim(x), r"\.+$", "")))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x != "")))


def extract_title(html: Column) -> Column:
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    text = F.regexp_replace(raw, r"\s+", " ")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.nullif(F.trim(text), F.lit(""))


def body_hash(html: Column) -> Column:
    return F.when(html != "", F.md5(html.cast("binary")))


CMS = (("wordpress", "WordPress"), ("drupal", "Drupal"), ("joomla", "Joomla"), ("typo3", "TYPO3"), ("wix", "Wix"))
BODY_MARKS = ((("wp-content/", "wp-includes/"), "WordPress"), (("drupal.settings", "/sites/default/files/"), "Drupal"),
    (("/components/com_",), "Joomla"), (("typo3conf/", "typo3temp/"), "TYPO3"))


def detect_cms(powered_by: Column, html: Column, server: Column) -> Column:
    pb, body, srv = (F.lower(F.coalesce(c, F.lit(""))) for c in (powered_by, html, server))
    at = F.coalesce(F.nullif(F.locate('name="generator"', body), F.lit(0)), F.locate("name='generator'", body))
    window = F.when(at > 0, F.substr(body, at, F.lit(500))).otherwise("")
    cases = [(F.contains(pb, F.lit(w)), F.lit(v)) for w, v in CMS]
    cases.append((F.contains(pb, F.lit("php/")) | F.startswith(pb, F.lit("php")), F.lit("php")))
    cases += [(F.contains(window, F.lit(w)), F.lit(v)) for w, v in CMS]
    cases += [(_any_word(body, words), F.lit(v)) for words, v in BODY_MARKS]
    cases += [(F.contains(srv, F.lit(w)), F.lit(w)) for w in ("apache", "nginx")]
    cases.append((F.contains(pb, F.lit("php")), F.lit("php")))
    return _first(cases)


def pick_spf(txt: Column) -> Column:
    return F.get(F.filter(txt, lambda x: F.startswith(F.lower(x), F.lit("v=spf1"))), F.lit(0))


SPF_LOOKUP = r"^(include:.*|redirect=.*|exists:.*|[+?~-]?(a|mx)([:/].*)?)$"


def parse_spf(c: Column) -> Column:
    """struct(present, policy, too_permissive, dns_lookups, over_limit)."""
    tokens = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda t: t != "")
    last = F.try_element_at(F.filter(tokens, lambda t: F.regexp_replace(t, r"^[+?~-]", "") == "all"), F.lit(-1))
    lookups = F.size(F.filter(tokens, lambda t: t.rlike(SPF_LOOKUP)))
    return F.struct(
        (F.coalesce(c, F.lit("")) != "").alias("present"), last.alias("policy"),
        F.coalesce(F.regexp_extract(last, r"^[+?~-]?", 0).isin("+", "?", ""), F.lit(False)).alias("too_permissive"),
        lookups.alias("dns_lookups"), (lookups > 10).alias("over_limit"),
    )


def parse_dmarc(c: Column) -> Column:
    """struct(present, policy, subdomain_policy, has_reporting, pct)."""
    tags = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda t: F.trim(t))
    value = (
        lambda name: F.regexp_replace(F.try_element_at(F.filter(tags, lambda t: F.startswith(F.lower(t), F.lit(f"{name}="))), F.lit(-1)),
        "^[^=]*=", ""))
    present = F.startswith(F.lower(F.coalesce(c, F.lit(""))), F.lit("v=dmarc1"))
    inside = lambda x: F.when(present, x)
    return F.struct(
        present.alias("present"), inside(F.lower(F.trim(value("p")))).alias("policy"),
            inside(F.lower(F.trim(value("sp")))).alias("subdomain_policy"),
        (present & F.exists(tags, lambda t: F.startswith(F.lower(t), F.lit("rua=")))).alias("has_reporting"),
            inside(F.trim(value("pct")).try_cast("int")).alias("pct"),
    )


def dkim_flags(default: Column, google: Column) -> Column:
    has = lambda a: F.coalesce(F.exists(a, lambda x: F.contains(x, F.lit("v=DKIM1"))), F.lit(False))
    return F.struct(has(default).alias("dkim_default"), has(google).alias("dkim_google"),
        (has(default) | has(google)).alias("dkim_found"))


def parse_whois(text: Column) -> Column:
    """struct(registrar, created, expires, status, dnssec_delegated); a value stands on the
    label's line or else on the next one that isn't blank."""
    found = lambda label: F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^[ \t]*(?:{label})\s*([^\r\n]*)", 1)), F.lit(""))
    date = lambda s: F.coalesce(F.try_to_date(s, "yyyy-MM-dd"), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))
    dnssec = F.lower(found("dnssec:"))
    return F.struct(
        found("registrar:").alias("registrar"),
            date(F.trim(F.regexp_replace(found("first registration date:"), "^(before)+", ""))).alias("created"),
        date(found("expiration date:|expires:|expiry date:")).alias("expires"), found("state:|status:").alias("status"),
        ((dnssec == "y") | F.startswith(dnssec, F.lit("yes")) | F.startswith(dnssec, F.lit("signed"))).alias("dnssec_delegated"),
    )


def cert_status(valid_to: Column, issuer: Column, subject: Column, as_of: Column) -> Column:
    return F.struct(F.datediff(valid_to, as_of).alias("days_remaining"), (valid_to < as_of).alias("expired"),
        (issuer == subject).alias("self_signed"))


def key_alg(oid: Column, curve: Column, rsa_bits: Column) -> Column:
    """struct(algorithm, size)."""
    names = ([(oid == k, F.lit(v)) for k, v in rules.KEY_OIDS.items()]
        + [((oid == rules.EC_OID) & (curve == k), F.lit(v[0])) for k, v in rules.CURVES.items()] + [(oid == rules.EC_OID, F.lit("EC"))])
    sizes = ([(oid == "1.2.840.113549.1.1.1", rsa_bits.cast("int"))] + [(oid == k, F.lit(v)) for k, v in rules.KEY_SIZES.items()]
        + [((oid == rules.EC_OID) & (curve == k), F.lit(v[1])) for k, v in rules.CURVES.items()])
    return F.struct(_first(names).alias("algorithm"), _first(sizes).alias("size"))


def sig_alg(oid: Column) -> Column:
    return _first([(oid == k, F.lit(v)) for k, v in rules.SIGNATURE_OIDS.items()], oid)


def cert_ext_flags(exts: Column) -> Column:
    """exts: array<struct<oid, value: hex text>>. struct(ct_logged, must_staple)."""
    feature = F.filter(exts, lambda e: e["oid"] == rules.TLS_FEATURE_OID)
    return F.struct(F.exists(exts, lambda e: e["oid"] == rules.SCT_OID).alias("ct_logged"),
        F.when(F.size(feature) > 0, F.contains(F.lower(F.get(feature, F.lit(0))["value"]), F.lit("020105"))).alias("must_staple"))


def asn1_date(epoch: Column) -> Column:
    return F.to_date(F.timestamp_seconds(epoch))


def service_name(port: Column) -> Column:
    return _first([(port == k, F.lit(v)) for k, v in rules.SERVICES.items()], F.lit("unknown"))


def is_public_ip(c: Column) -> Column:
    octets = F.transform(F.split(c, r"\."), lambda x: x.try_cast("int"))
    a, b = F.get(octets, F.lit(0)), F.get(octets, F.lit(1))
    v4 = c.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    inner = (a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
        | (c == "255.255.255.255"))
    return F.when(v4, ~inner).when(F.contains(c, F.lit(":")), ~c.rlike(r"^[0:]*:[0:]*[01]?$")).otherwise(F.lit(False))


def classify_http_error(msg: Column, is_timeout: Column, is_connect: Column) -> Column:
    low = F.lower(msg)
    return _first(
        [(is_timeout, F.lit("timeout")), (_any_word(low, rules.TLS_WORDS), F.lit("tls_failed")),
        (is_connect & _any_word(low, ("dns", *rules.LOOKUP_WORDS)), F.lit("dns")),
        (is_connect & F.contains(low, F.lit("refused")), F.lit("refused"))], F.lit("other"))


def classify_dns_error(msg: Column, no_records: Column) -> Column:
    low = F.lower(msg)
    return _first(
        [(no_records, F.lit("not_found")), (_any_word(low, ("timed out", "timeout")), F.lit("timeout")),
        (F.contains(low, F.lit("refused")), F.lit("refused"))], F.lit("dns"))


def classify_io_error(msg: Column, kind: Column) -> Column:
    return _first(
        [(kind == "timed_out", F.lit("timeout")), (kind == "connection_refused", F.lit("refused")),
        (_any_word(F.lower(msg), rules.LOOKUP_WORDS), F.lit("dns"))], F.lit("other"))


def dns_status(errors: Column) -> Column:
    """struct(status, error_kind) from the errors of the A, AAAA, NS and MX lookups, null where one worked."""
    failed = F.forall(errors, lambda e: e.isNotNull())
    return F.struct(F.when(failed, "error").otherwise("ok").alias("status"), F.when(failed, F.get(errors, F.lit(0))).alias("error_kind"))


def http_error_kind(code: Column, body_error: Column) -> Column:
    return F.when(code >= 400, F.lit("http_status")).otherwise(body_error)


def redirect_chain(start: Column, final: Column) -> Column:
    return F.when(start != final, F.array(start)).otherwise(F.array().cast("array<string>"))


DIGITS = r"[^0-9]*([0-9][0-9.]*)"


def extract_version(banner: Column, tech: Column) -> Column:
    find = lambda pattern: F.nullif(F.regexp_extract(banner, f"(?is){pattern}", 1), F.lit(""))
    mysql = F.regexp_replace(find(r"mysql[^0-9]*([0-9]\S*)"), r"^5\.5\.5-", "")
    ssh = find(r"openssh_[^0-9]*([0-9][0-9.p]*)")
    build = find(r" build ([0-9]+)")
    mssql = find(r"mssql " + DIGITS)
    plain = [(tech == t, find(mark + DIGITS))
        for t, mark in (("proftpd", "proftpd"), ("vsftpd", "vsftpd"), ("redis", "redis "), ("elasticsearch", "elasticsearch "),
        ("memcached", "version "))]
    return _first(
        [(tech == "mysql", F.nullif(F.regexp_extract(mysql, r"^[0-9.]*", 0), F.lit(""))),
        (tech == "openssh", F.regexp_replace(ssh, r"p[0-9].*$", "")),
        (tech == "mssql", F.coalesce(F.concat_ws(".", mssql, F.when(mssql.isNotNull(), build)), mssql)), *plain])


def server_version(server: Column, tech: Column) -> Column:
    """What follows the first "tech/" in the header, up to a blank, in lower case."""
    low, mark = F.lower(server), F.concat(F.lower(tech), F.lit("/"))
    at = F.position(mark, low)
    return F.when(at > 0, F.split_part(F.substr(low, at + F.length(mark)), F.lit(" "), F.lit(1)))


def version_key(c: Column) -> Column:
    """Six numbers: the leading digits of each dotted part, 0 where there are none."""
    parts = F.transform(F.split(c, r"\."),
        lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^[0-9]+", 0), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint")))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0).cast("bigint"), 6)), 1, 6)


def version_in_range(v: Column, low: Column, high: Column) -> Column:
    return version_key_in_range(v, version_key(low), version_key(high))


def version_key_in_range(v: Column, low: Column, high: Column) -> Column:
    """version_in_range() with the ends as version_key()."""
    inside = F.coalesce(version_key(v) >= low, F.lit(True)) & F.coalesce(version_key(v) <= high, F.lit(True))
    return F.when(~v.rlike("[0-9]"), F.lit(True)).otherwise(inside)


def ns_operator(host: Column) -> Column:
    """The operator of a nameserver host: of the first suffix it ends in, else its registrable domain.

    The suffix is found by one pattern and named by a map, so a host is gone through once. The pattern
    takes the longest suffix; where two rules fit a host, they name the same operator (a test holds that).
    """
    h = F.lower(F.rtrim(host, F.lit(".")))
    names = dict(reversed(rules.OPERATORS))
    suffix = F.regexp_extract(h, f"(?:{'|'.join(re.escape(s) for s in names)})$", 0)
    name = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    known = F.when(suffix != "", F.try_element_at(name, suffix))
    return F.coalesce(known, F.when(F.contains(h, F.lit("awsdns")), "AWS Route53"), registrable_domain(h))


def registrable_domain(host: Column) -> Column:
    parts = F.split(F.rtrim(host, F.lit(".")), r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".")


def jurisdiction(cc: Column) -> Column:
    return _first([(cc.isin("CH", "US"), cc), (cc.isin(*rules.EU), F.lit("EU"))], F.lit("OTHER"))


def parse_json_array(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def banner_technology(port: Column, banner: Column) -> Column:
    low = F.lower(F.coalesce(banner, F.lit("")))
    cases = [(port.isin(*ports) & (F.contains(low, F.lit(w)) if w else F.lit(True)), F.lit(t)) for ports, w, t in rules.INVENTORY]
    return _first(cases, F.lit("unknown"))


def sector(domain: Column, title: Column) -> Column:
    """struct(sector, subsector, confidence), null without a match."""
    d = F.lower(domain)
    both = F.concat(d, F.lit(" "), F.lower(F.coalesce(title, F.lit(""))))
    value = (lambda s, sub, c: F.struct(F.lit(s).alias("sector"), F.lit(sub).alias("subsector"), F.lit(c).alias("confidence")))
    cases = [((d == "admin.ch") | F.endswith(d, F.lit(".admin.ch")), value("government", "", 0.95)),
        (d.rlike(rf"(^|\.)({'|'.join(rules.CANTONS)})\.ch$"), value("government", "", 0.9))]
    named = [(F.contains(both, F.lit(word)), value(s, sub, c)) for word, s, sub, c in rules.SECTORS]
    return _first([*cases, *named])
