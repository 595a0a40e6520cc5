"""Joins by key at size: merged, not collected in the driver, over as many tasks as the keys need; what is evaluated once."""

from pyspark.sql import functions as F

from perispark.operators import dealing, risk


def satellites(spark):
    cols = {"domains": "200 AS status_code, 1 AS sovereignty_score", "headers": "'a' AS hsts, CAST(NULL AS STRING) AS csp",
        "dns": "'[]' AS caa, true AS dnssec_signed, 'x' AS txt_dmarc", "tls": "'TLSv1_1' AS tls_version, DATE '2001-08-20' AS valid_to",
        "whois": "DATE '2001-08-05' AS expires_at", "email": "true AS spf_too_permissive, false AS dmarc_present, 'none' AS dmarc_policy, true AS dkim_found",
        "ports": "21 AS port", "matches": "'CRITICAL' AS severity"}
    return {n: spark.sql(f"SELECT id AS k, {c} FROM range(3)" + ("" if n == "domains" else " WHERE id > 0")) for n, c in cols.items()}


def test_satellites_are_never_collected(spark):
    """Small files of many rows were broadcast through the driver."""
    flags = risk.risk_flags(satellites(spark), "2001-08-01", "k")
    plan = flags._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 7 and "Broadcast" not in plan
    rows = {r.k: r.asDict() for r in flags.collect()}
    assert rows[0]["missing_hsts"] and rows[0]["missing_caa"] and rows[0]["dmarc_weak"] and rows[0]["weak_tls"] is None and not rows[0]["has_critical_cve"]
    assert not rows[1]["missing_hsts"] and rows[1]["missing_csp"] and rows[1]["weak_tls"] and rows[1]["cert_expiring"] and rows[1]["dmarc_weak"]
    assert rows[2]["domain_expiring"] and rows[2]["exposed_ftp"] and rows[2]["has_critical_cve"] and not rows[2]["no_dkim"] and not rows[2]["no_dnssec"]


def test_parts_grow_with_the_rows(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert dealing.parts(df, 100) == 10 and dealing.parts(df) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealing.dealt(df, "k", 10).rdd.getNumPartitions() == 10


def test_sector_metrics_over_counts(spark):
    """Quantiles and means over counts of values are those over the rows, and no row is expanded into its metrics."""
    scores = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 37 % 101).cast("int").alias("score"), (F.col("id") % 3 == 0).alias("missing_hsts"),
        F.when(F.col("id") % 4 > 0, F.col("id") % 4 == 1).alias("no_dnssec"), (F.col("id") % 5 == 0).alias("dmarc_weak"))
    classes = spark.range(500).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("sector"))
    got = {(r.sector, r.metric): r for r in risk.sector_benchmarks(scores, classes, "k").collect()}
    of = scores.join(classes, "k").filter("sector IS NOT NULL").groupBy("sector").agg(F.count("*").alias("n"), F.avg("score").alias("mean"),
        F.percentile("score", 0.5).alias("median"), F.percentile("score", 0.25).alias("p25"), F.max("score").alias("max"))
    for r in of.collect():
        g = got[r.sector, "risk_score"]
        assert (g.domain_count, g.median, g.p25, g.max) == (r.n, r.median, r.p25, r.max) and abs(g.mean - r.mean) < 1e-9
    assert len(got) == 12
    plan = risk.sector_benchmarks(scores, classes, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate")  # counted before it is expanded


def test_sector_rules_are_gone_through_once(spark):
    domains = spark.createDataFrame([(1, "klinik-1.ch", None), (2, "x.ch", "nothing"), (3, "x.admin.ch", "Bank"), (4, None, None)], "k int, domain string, title string")
    classes = risk.classify(domains, "k")
    assert sorted(map(tuple, classes.collect())) == [(1, "healthcare", "", 0.75), (3, "government", "", 0.95)]
    assert classes._jdf.queryExecution().optimizedPlan().toString().count("klinik") == 1


def test_lines_are_dealt_before_they_are_distinct(spark, monkeypatch):
    """Ports were made distinct in the session's partitions, however many lines there are."""
    from perispark.plans import fixtures

    few = fixtures.fixture(spark, "/root/testdata/sf0.001", "fx_ports_info")
    monkeypatch.setattr(fixtures, "LINES", 500)
    many = fixtures.fixture(spark, "/root/testdata/sf0.001", "fx_ports_info")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert many.groupBy("k").count().rdd.getNumPartitions() == -(-lines // 500) > few.rdd.getNumPartitions()
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
