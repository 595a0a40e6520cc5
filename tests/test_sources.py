"""Reading, writing and merging of the observation tables, and the streams, on small literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from perispark.functions import catalogue
from perispark.operators import graph, matching, merge, risk, work
from perispark.operators.ordering import numbered, sorted_ranges
from perispark.sources import tables as T
from perispark.sources import versions
from perispark.sources.versions import BucketTable
from perispark.streaming import results as R


def test_domain_list(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a.ch\n https://b.ch/x \n\na.ch\nbad name.ch\n..c.ch..\n")
    got = T.load_domain_list(spark, str(tmp_path / "list.txt"))
    assert sorted(r.domain for r in got.collect()) == ["a.ch", "b.ch", "c.ch"]
    have = spark.createDataFrame([("old.ch",)], "domain string")
    assert T.load_domain_list(spark, str(tmp_path / "list.txt"), have).collect() == have.collect()
    assert T.load_domain_list(spark, str(tmp_path / "list.txt"), have.limit(0)).count() == 3


@pytest.fixture
def two(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    return {"a": a, "b": spark.createDataFrame([("k", 1.5)], "name string, n double")}


def test_export_and_import(spark, two, tmp_path):
    folder = str(tmp_path / "out")
    assert T.export_tables(two, folder, exclude=["b"]) == ["a"] and not (tmp_path / "out" / "b.parquet").exists()
    assert T.export_tables(two, folder) == ["a", "b"]
    keys = {"a": ["id"], "b": ["name"], "c": ["id"]}
    nothing = {n: df.limit(0) for n, df in two.items()}
    for n, df in T.import_tables(spark, folder, nothing, keys).items():
        assert sorted(df.collect(), key=str) == sorted(two[n].collect(), key=str)
    cur = {"a": spark.createDataFrame([(2, "mine"), (3, "z")], "id int, v string"), "c": two["a"]}
    rows = (lambda how, **kw: sorted(tuple(r) for r in T.import_tables(spark, folder, cur, keys, on_conflict=how, **kw)["a"].collect()))
    replaced = [(1, "x"), (2, None), (3, "z")]
    assert sorted(rows("replace"), key=str) == replaced and rows("anything") == rows("replace")
    assert rows("ignore") == [(1, "x"), (2, "mine"), (3, "z")]
    assert rows("replace", exclude=["a"]) == [(2, "mine"), (3, "z")]
    with pytest.raises(Exception, match="duplicate key"):
        rows("abort")
    assert T.import_tables(spark, folder, cur, keys)["c"] is cur["c"]


def test_known_exploited_feed(spark, tmp_path):
    names = [("CVE-1", "Microsoft", "SQL Server"), ("CVE-2", "Oracle", "MySQL"), ("", "Apache", "Tomcat"), ("CVE-3", "Acme", "Thing"),
        ("CVE-4", None, "PHP")]
    feed = {"title": "x",
        "vulnerabilities": [{"cveID": c, "vendorProject": v, "product": p, "shortDescription": "d", "dateAdded": "2024-01-02"} for c, v,
        p in names]}
    (tmp_path / "kev.json").write_text(json.dumps(feed, indent=1))
    got = T.ingest_kev(spark.read.json(str(tmp_path / "kev.json"), multiLine=True)).collect()
    assert sorted((r.cve_id, r.technology, r.severity, r.in_kev) for r in got) == [
        ("CVE-1", "mssql", "CRITICAL", True), ("CVE-2", "mysql", "CRITICAL", True), ("CVE-4", "php", "CRITICAL", True)
    ]


def test_certificate_log(spark):
    log = (
        spark.createDataFrame([("a.ch", "www.a.ch\nA.ch\n *.Shop.a.ch "), ("a.ch", "www.a.ch\nxa.ch\nwww.b.ch")],
        "apex string, name_value string"))
    assert sorted((r.domain, r.subdomain, r.source) for r in T.ingest_ct(log).collect()) == [("a.ch", "*.shop.a.ch", "ct"),
        ("a.ch", "www.a.ch", "ct")]


def test_nameserver_csv(spark, tmp_path):
    (tmp_path / "ns.csv").write_text('dominio,ns\n"a.ch","ns1.x.ch"\nb.ch,\n"c, d.ch","n""s"\n')
    got = [tuple(r) for r in T.read_ns_csv(spark, str(tmp_path / "ns.csv")).collect()]
    assert sorted(got, key=str) == sorted([("a.ch", "ns1.x.ch"), ("b.ch", None), ("c, d.ch", 'n"s')], key=str)
    edges = graph.ns_edges(spark.createDataFrame(got, "domain string, host string"))
    assert {r.target for r in edges.collect()} == {"x.ch", graph.NO_NS, 'n"s'}


def test_seed_catalogue(spark):
    seed = T.seed_catalog(spark)
    assert seed.count() == len(catalogue.SEED) == 82 and seed.select("technology").distinct().count() == 26
    known = seed.limit(1).withColumns({"in_kev": F.lit(True), "published_at": F.lit("2020-01-01"), "summary": F.lit("old")})
    own = known.withColumns({"cve_id": F.lit("OWN-1"), "technology": F.lit("own")})
    rows = {r.cve_id: r for r in T.seed_catalog(spark, known.unionByName(own)).collect()}
    first = known.first().cve_id
    assert len(rows) == 83 and rows[first].in_kev and rows[first].published_at == "2020-01-01" and rows[first].summary != "old"
    assert rows["OWN-1"].in_kev and sum(r.in_kev for r in rows.values()) == 2


def test_graph_files(spark, tmp_path):
    pairs = spark.createDataFrame([("b.ch", "NS1.x.ch."), ("a.ch", None), ("a.ch", "ns.y.net")], "domain string, host string")
    edges = graph.ns_edges(pairs)
    nodes = graph.index_nodes(graph.ns_nodes(edges))
    T.write_graph(nodes, graph.index_edges(edges, nodes), str(tmp_path))
    back = spark.read.parquet(str(tmp_path / "nodes.parquet")).orderBy("idx").collect()
    assert [(r.id, r.idx) for r in back] == [("(no-ns)", 0), ("a.ch", 1), ("b.ch", 2), ("x.ch", 3), ("y.net", 4)]
    assert spark.read.parquet(str(tmp_path / "edges.parquet")).count() == 3
    assert graph.dropped_edges(edges, nodes.filter("id != 'x.ch'")).first().dropped == 1


def test_markdown(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body><h2 class="a>b">T &amp; u</h2><script>x("</p>")</script>
    <p>one  <b>two</b> <a class='c' href="/x">li<i>nk</i></a></p><ul><li>a<ul><li>b</li></ul></li><li>c</li></ul></body></html>"""
    assert T.markdown_of(page) == "## T & u\n\none two [link](/x)\n\n- a\n  - b\n\n- c"
    pages = (
        spark.createDataFrame([(1, page, 200), (2, page, 404), (3, "", 200), (4, None, 204), (5, "<p>x", 201)],
        "page_id int, html string, status_code int"))
    got = {r.page_id: r.markdown for r in T.pages_to_markdown(pages, spark.createDataFrame([(1,)], "page_id int")).collect()}
    assert got == {5: "x"}


def test_incremental_classes(spark):
    domains = (
        spark.createDataFrame([(1, "bank.ch", None), (2, "spital.ch", None), (3, "x.ch", None)], "id int, domain string, title string"))
    old = risk.classify(domains.filter("id = 1"), "id").withColumn("sector", F.lit("mine"))
    new = risk.classify_incremental(domains, old, "id")
    assert sorted((r.id, r.sector) for r in new.collect()) == [(1, "mine"), (2, "healthcare")]
    assert [r.id for r in work.unclassified(domains, new, "id").collect()] == [3]
    named = risk.classify_incremental(domains.drop("id"), risk.classify(domains.drop("id")).limit(0))
    assert named.count() == 2


def test_public_suffixes(spark):
    hosts = [("A.b.co.uk.", "b.co.uk"), ("co.uk", "co.uk"), ("x.ch", "x.ch"), ("a.b.unknown", "b.unknown"), ("solo", "solo"), (None, None)]
    df = spark.createDataFrame([(h,) for h, _ in hosts], "host string")
    hosts += [("a.b.ck", "a.b.ck"), ("x.a.b.ck", "a.b.ck"), ("b.ck", "b.ck"), ("x.www.ck", "www.ck"), ("www.ck", "www.ck"), ("ck", "ck"), ("ch", "ch")]
    df = spark.createDataFrame([(h,) for h, _ in hosts], "host string")
    suffixes = spark.createDataFrame([("uk",), ("co.uk",), ("ch",), ("ck",), ("*.ck",), ("!www.ck",)], "suffix string")
    got = {r.host: r.registrable for r in matching.registrable(df, "host", suffixes).collect()}
    assert got == dict(hosts)


def test_numbering(spark):
    names = [f"{a}{b}" for a in ("site", "www", "é", "a") for b in range(300)]
    df = spark.createDataFrame([(n, i % 3) for i, n in enumerate(names)], "name string, g int")
    got = {r.name: r.idx for r in numbered(df, "name").collect()}
    assert got == {n: i for i, n in enumerate(sorted(names, key=lambda x: x.encode()))}
    within = {(r.g, r.name): r.idx for r in numbered(df, "name", ["g"]).collect()}
    for g in range(3):
        of_g = sorted((n for i, n in enumerate(names) if i % 3 == g), key=lambda x: x.encode())
        assert [within[g, n] for n in of_g] == list(range(len(of_g)))


def test_ranges_of_names_with_one_beginning(spark):
    """No range holds over twice the mean, the numbers are the names' places, and a task that runs again gives the same."""
    df = spark.range(40_000).select(F.concat(F.lit("https://www.kantonal"), F.md5(F.col("id").cast("string"))).alias("name"))
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        sizes = [r["count"] for r in sorted_ranges(df, ["name"]).groupBy("_range").count().collect()]
    finally:
        spark.conf.unset(setting)
    assert len(sizes) == 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    out = numbered(df, "name")
    once = {r.name: r.idx for r in out.collect()}
    assert once == {n: i for i, n in enumerate(sorted(once))} and len(once) == 40_000
    assert once == {r.name: r.idx for r in out.repartition(7).collect()}


def test_numbering_in_descending_order(spark):
    rows = [(i % 5, i) for i in range(200)]
    df = spark.createDataFrame(rows, "score int, id int")
    got = {(r.score, r.id): r.idx for r in numbered(df, [F.col("score").desc(), "id"], out="idx").collect()}
    assert got == {x: i for i, x in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])))}
    assert numbered(df.limit(0), "id").collect() == []


def results(spark, rows):
    return spark.createDataFrame(rows, "event_id long, target long, ts timestamp, error_kind string, elapsed double")


def test_two_batches_of_upserts(spark, tmp_path):
    at = lambda m: __import__("datetime").datetime(2024, 1, 1, 0, m)
    folder, source, state = (str(tmp_path / x) for x in ("out", "in", "state"))
    batches = [[(1, 1, at(1), None, 1.0), (2, 1, at(2), "dns", 2.0), (3, 2, at(1), None, 3.0)], [(4, 1, at(5), None, 4.0)],
        [(5, 3, at(6), None, 5.0), (6, 2, at(7), "dns", 6.0)]]
    want = {}
    for rows in batches:
        results(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(results(spark, []).schema).parquet(source)
        R.stream_upsert(stream, folder, ["target"], "ts", buckets=16, tidy=2).option("checkpointLocation",
            state).trigger(availableNow=True).start().awaitTermination()
        for e, target, *_ in sorted(rows, key=lambda r: r[2]):
            want[target] = e
        assert {r.target: r.event_id for r in R.upserted(spark, folder, ["target"]).collect()} == want
    table = BucketTable(spark, folder, ["target"])
    assert table.versions() == [0, 1, 2] and table.manifest()["n"] == 16
    assert sorted(table.manifest()["buckets"].values()) == [1, 2, 2]


def kept(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge_touches_only_its_buckets(spark, tmp_path):
    folder = str(tmp_path / "table")
    table = BucketTable(spark, folder, ["k"], buckets=32)
    assert table.read() is None and table.merge(spark.createDataFrame([], "k long, v string")) == []
    rows = [(i, f"old{i}") for i in range(400)] + [(None, "none")]
    make = lambda x: spark.createDataFrame(x, "k long, v string")
    assert len(table.merge(make(rows))) == 32
    hit = table.merge(make([(3, "new"), (1000, "more"), (7, None)]))
    assert 1 <= len(hit) <= 3
    written = {p.name for p in (tmp_path / "table" / "data" / "v=1").iterdir() if p.name.startswith("bucket=")}
    assert written == {f"bucket={b}" for b in hit}
    want = {**dict(rows), 3: "new", 1000: "more", 7: None}
    assert kept(table.read()) == sorted(want.items(), key=str) and kept(table.read(0)) == sorted(rows, key=str)
    table.merge(make([(5, "x"), (2000, "y")]), lambda cur, new: merge.merge_ignore(cur, new, ["k"]))
    assert kept(table.read()) == sorted({**want, 2000: "y"}.items(), key=str)


def test_killed_merge_leaves_the_version_before(spark, tmp_path):
    make = lambda x: spark.createDataFrame(x, "k long, v string")
    table = BucketTable(spark, str(tmp_path / "table"), ["k"], buckets=8)
    table.merge(make([(i, "a") for i in range(50)]))
    before = kept(table.read())

    def broken(cur, new):
        bad = F.when(F.col("k") == 49, F.raise_error(F.lit("lost"))).otherwise(F.col("v"))
        return merge.merge_replace(cur, new, ["k"]).withColumn("v", bad)

    every = make([(i, "b") for i in range(50)])
    with pytest.raises(Exception, match="lost"):
        table.merge(every, broken)
    assert kept(table.read()) == before and table.versions() == [0]
    table.merge(every)
    table.merge(make([(1, "c")]))
    table.merge(make([(1, "c")]), version=2)  # the same batch again
    assert kept(table.read()) == sorted([(i, "c" if i == 1 else "b") for i in range(50)], key=str)
    table.vacuum()
    assert table.versions() == [1, 2] and kept(table.read(1)) == [(i, "b") for i in sorted(range(50), key=lambda i: str((i, "b")))]
    table.vacuum(keep=1)
    assert not [p for p in (tmp_path / "table" / "data" / "v=0").iterdir() if p.name.startswith("bucket=")]
    assert kept(table.read()) == sorted([(i, "c" if i == 1 else "b") for i in range(50)], key=str)


def test_bucketed_satellites_meet_without_a_shuffle(spark):
    """No exchange on the key anywhere in the plan of the risk flags, and the same rows."""
    from perispark.plans import queries as Q

    t = Q.Tables(spark, "/root/testdata/sf0.001")
    tables = {n: t[n] for n in Q.SATELLITES}
    want = kept(risk.risk_flags(tables | {"domains": t["sovereign"]}, Q.AS_OF, "k"))
    prefix, off = "test_satellites", {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    saved = versions.save_bucketed(tables | {"domains": t["sovereign"]}, "k", 4, prefix)
    old = {c: spark.conf.get(c) for c in off}
    try:
        for c, v in off.items():
            spark.conf.set(c, v)
        flags = risk.risk_flags(saved, Q.AS_OF, "k")
        plan = flags._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 7 and "Exchange" not in plan
        assert kept(flags) == want
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
        versions.drop_bucketed(spark, list(saved), prefix)


def test_progress_and_dedupe(spark, tmp_path):
    at = lambda m: __import__("datetime").datetime(2024, 1, 1, m // 60, m % 60)
    rows = [(i, i % 4, at(5 * i), "dns" if i % 3 == 0 else None, float(i)) for i in range(24)] + [(3, 3, at(15), "dns", 3.0)]
    df = results(spark, rows)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(query, name, mode):
        sink = query.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name))
        sink.trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    once = run(R.stream_dedupe(stream(), ["event_id"]), "once", "append")
    assert sorted(r.event_id for r in once.collect()) == list(range(24))
    seen = run(R.stream_progress(stream()), "seen", "complete")
    assert sorted(seen.collect()) == sorted(R.progress(df).collect())


def streamed(spark, tmp_path, make, batches, schema, name):
    """What a stream over the batches, one micro-batch after another with its state kept, gives."""
    source, out, state = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "state"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).parquet(source))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append")
        query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_state_of_silent_keys_ends(spark, tmp_path):
    """A key silent for over a day is added anew, whether or not its timer has come; late and older rows say nothing."""
    at = lambda h: __import__("datetime").datetime(2024, 1, 1 + h // 24, h % 24)
    schema = "target long, ts timestamp, module string, error_kind string"
    batches = [
        [(1, at(0), "a", None), (2, at(1), "a", "dns"), (None, at(1), "x", "y"), (1, at(2), "b", None)],
        [(1, at(3), "b", "dns"), (2, at(30), "a", "dns")],  # 2 comes back before its timer
        [(3, at(60), "c", None)],  # the watermark passes the end of 1
        [(3, at(61), "c", None), (1, at(62), "b", "dns"), (2, at(2), "late", None)],
        [(1, at(61), "old", None), (1, at(63), "b", None)],
    ]
    make = lambda s: R.stream_changelog(s, "target", ["module", "error_kind"], late="2 hours", forget=86400)
    got = kept(streamed(spark, tmp_path, make, batches, schema, "log"))
    told = [row for b in batches for row in b if row[2] not in ("late", "old")]
    want = kept(R.changelog(spark.createDataFrame(told, schema), "target", ["module", "error_kind"], forget=86400))
    assert got == want
    assert [x[0] for x in got if x[1] == "added"] == [1, 1, 2, 2, 3]


def test_guard_forgets(spark, tmp_path):
    at = lambda h: __import__("datetime").datetime(2024, 1, 1 + h // 24, h % 24)
    schema = "module string, ts timestamp, error_kind string"
    batches = [[("m", at(0), "dns")] * 3, [("m", at(1), None)], [("n", at(80), None)], [("n", at(81), None), ("m", at(81), "dns")],
        [("m", at(82), "dns")] * 4]
    make = lambda s: R.stream_error_guard(s, 0.5, 4, late="1 hour", forget=86400)
    assert kept(streamed(spark, tmp_path, make, batches, schema, "guard")) == [("m", 4, 3), ("m", 5, 5)]
    forever = lambda s: R.stream_error_guard(s, 0.5, 4, late="1 hour", forget=10**6)
    assert kept(streamed(spark, tmp_path, forever, batches, schema, "keeps")) == [("m", 4, 3)]
