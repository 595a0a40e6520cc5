"""Technologies in header texts against a plain search, and look-alike names against all pairs."""

import itertools
import random

from perispark.operators import matching, research


def test_technologies_anywhere_in_a_text(spark):
    rng = random.Random(2)
    names = ["php", "iis", "apache", "apache tomcat", "ab", "aba", "é", "microsoft-iis", "x" * 40]
    texts = ["".join(rng.choice(["php", "iis", "ap", "ache", " ", "ab", "a", "é", "microsoft-"]) for _ in range(rng.randint(0, 9))) for _ in range(200)]
    texts += ["x" * 50, "", None, "apache tomcat/9", texts[0]]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    catalog = spark.createDataFrame([(n, i) for i, n in enumerate([*names, "php", ""])], "technology string, id int")
    got = {r.text: r.found for r in matching.technologies_in(df, catalog).collect()}
    want = {t: sorted(n for n in names if n in t) for t in texts if t and any(n in t for n in names)}
    assert {t: sorted(f) for t, f in got.items()} == want
    assert matching.technologies_in(df.limit(0), catalog).collect() == [] == matching.technologies_in(df, catalog.limit(0)).collect()


def alike(a, b):
    fold = lambda x: x.replace("1", "l").replace("0", "o")
    if fold(a) == fold(b):
        return True
    if len(a) == len(b):
        at = [i for i in range(len(a)) if a[i] != b[i]]
        return len(at) == 1 or (len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]])
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_a_key_of_many_names_is_spread(spark, monkeypatch):
    """All pairs, though one key holds most names and its parts are of seven."""
    monkeypatch.setattr(research, "TOGETHER", 7)
    rng = random.Random(6)
    names = {"".join(rng.choice(x) for x in ("l1", "o0", "l1", "o0", "l1", "l1")) for _ in range(200)}
    names |= {f"bank{c}" for c in "abcdefghijklmnop"} | {"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(60)} | {"abcd", "abdc", "x"}
    df = spark.createDataFrame([(n,) for n in sorted(names)], "name string")
    got = sorted(map(tuple, research.typosquats(df).collect()))
    assert got == sorted(tuple(sorted(p)) for p in itertools.combinations(sorted(names), 2) if alike(*p))


def test_matches_of_one_key_are_chosen_without_sorting_rows(spark):
    """A cve_id under several technologies gives a key one row: with a version first, then the least version and name."""
    entries = [("c1", "apache", "1.0", "3.0"), ("c1", "redis", "1.0", "3.0"), ("c2", "redis", "6.0", "7.0"), ("c3", "php", None, None), ("c3", "apache", None, None),
        ("c4", "memcached", "1.0", "1.5"), ("c5", "openssh", None, "9.1")]
    catalog = spark.createDataFrame([(*e, "HIGH", 5.0, True) for e in entries],
        "cve_id string, technology string, affected_from string, affected_to string, severity string, cvss_score double, in_kev boolean")
    hosts = [(1, "Apache/2.4 (Unix)", "PHP/8", None), (2, None, None, "Redis"), (3, "apache", "php", "memcached"), (4, "Apache/9", None, None)]
    domains = spark.createDataFrame(hosts, "k int, server string, powered_by string, cms string")
    open_ = [(1, 6379, "Redis 6.2.1"), (2, 6379, "Redis 5"), (3, 11211, "VERSION 1.6.9"), (5, 22, "SSH-2.0-OpenSSH_9.3p1"), (5, 22, "SSH-2.0-OpenSSH_8.10p1"), (5, 443, None)]
    ports = spark.createDataFrame(open_, "k int, port int, banner string")
    combined = {(r.k, r.cve_id): (r.technology, r.version) for r in matching.combined_matches(domains, ports, catalog, "k").collect()}
    assert combined == {(1, "c1"): ("apache", "2.4"), (1, "c2"): ("redis", None), (1, "c3"): ("apache", "2.4"), (2, "c1"): ("redis", None),
        (2, "c2"): ("redis", None), (3, "c1"): ("apache", None), (3, "c3"): ("apache", None), (3, "c4"): ("memcached", None),
        (4, "c1"): ("apache", "9"), (4, "c3"): ("apache", "9"), (5, "c5"): ("openssh", None)}
    found = matching.match_cves(domains, ports, catalog, "k")
    rows = sorted({(r.k, r.cve_id, r.technology, r.version) for r in found.collect()})
    # redis 5 is below c2's range, memcached 1.6.9 above c4's, openssh 9.3 (the greatest) above c5's, apache 9 above c1's
    assert rows == [(1, "c1", "apache", "2.4"), (1, "c2", "redis", "6.2.1"), (1, "c3", "apache", "2.4"), (3, "c1", "apache", None),
        (3, "c3", "apache", None), (4, "c3", "apache", "9")]
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_counts_over_lists_are_those_over_matches(spark):
    """Keys that show the same are counted, and the catalogue is joined once for each different list."""
    rng = random.Random(8)
    entries = [("c1", "apache", "1.0", "3.0"), ("c1", "redis", "1.0", "9.0"), ("c2", "redis", "6.0", "7.0"), ("c3", "php", None, None), ("c4", "openssh", None, "9.1")]
    catalog = spark.createDataFrame([(*e, rng.choice(["CRITICAL", "HIGH"]), 5.0, True) for e in entries],
        "cve_id string, technology string, affected_from string, affected_to string, severity string, cvss_score double, in_kev boolean")
    domains = spark.createDataFrame([(k, rng.choice(["Apache/2.4", "apache/9", None]), rng.choice(["PHP/8", None]), None) for k in range(90)],
        "k int, server string, powered_by string, cms string")
    ports = spark.createDataFrame([(rng.randrange(100), *rng.choice([(6379, "Redis 6.2"), (6379, "redis"), (22, "SSH-2.0-OpenSSH_9.0"), (443, None)])) for _ in range(120)],
        "k int, port int, banner string")
    rows = matching.match_cves(domains, ports, catalog, "k").collect()
    items = matching.shown(domains, ports, catalog, "k")
    counted = matching.counted_matches(items, catalog)
    got = {r.technology: r.domains for r in matching.keys_of(counted, "technology").collect()}
    assert got == {t: len({r.k for r in rows if r.technology == t}) for t in {r.technology for r in rows}}
    assert [r.domains for r in matching.keys_of(counted).collect()] == [len({r.k for r in rows})]
    each = matching.over_matches(items, catalog, lambda m: m.groupBy("_set").count())
    assert dict(map(tuple, each.collect())) == {k: sum(r.k == k for r in rows) for k in {r.k for r in rows}}
    sets = counted.select("_set").distinct().count()
    assert counted.count() < len(rows) and 0 < sets < len({r.k for r in rows})
    assert matching.counted_matches(items.limit(0), catalog).collect() == []


def test_names_with_a_look_alike(spark):
    """The names of all pairs, found without the pairs."""
    rng = random.Random(3)
    names = {"".join(rng.choice("ab1l0") for _ in range(rng.randint(0, 7))) for _ in range(300)} | {"aab", "aba", "baa", "zzzzzz", "xyxyxy", "yxyxyx", "é\U0001f600", "\U0001f600é"}
    names |= {"".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)}
    df = spark.createDataFrame([(n,) for n in sorted(names)], "name string")
    want = sorted({n for p in itertools.combinations(names, 2) if alike(*p) for n in p})
    found = research.with_lookalike(df)
    assert sorted(r.name for r in found.collect()) == want and want != sorted(names)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan
    assert research.with_lookalike(df.limit(0)).collect() == []
