"""A spread of registered queries against their SQL twins, and invariants; the driver runs them all."""

import itertools
import math
import os

import duckdb
import pytest

from perispark.plans import queries as Q

SF = "/root/testdata/sf0.001"
SOME = (
    "a3_import_ignore", "a4_kev_feed", "a7_seed_catalog", "b7_banner_backlog", "c2_coalesce", "d9_d10_spf", "d33_public_suffix",
        "e8_matches",
    "e12_upsert", "f2_incremental", "f4_risk_score", "f10_percentile", "g6_php_branches", "g12_clones", "g20_continents",
        "g34_operator_pairs",
    "g47_cms_by_sector", "h11_change_log", "h14_typosquats", "h15_homoglyphs", "i8_overall", "j3_index", "j5_degrees", "k2_progress",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not there")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    want = con.sql(Q.ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a and a == b


def test_invariants(spark):
    t = Q.Tables(spark, SF)
    low, high = t["flags"].selectExpr("min(score)", "max(score)").first()
    assert 0 <= low <= high <= 100
    new = t["snapshot_2"]
    once = Q.merge.merge_replace(Q._cur(t), new, ["k"])
    plain = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert plain(Q.merge.merge_replace(once, new, ["k"])) == plain(once)


@pytest.mark.parametrize("share", [0.1, 0.25])
def test_hub_removal(spark, share):
    staging = Q.Tables(spark, SF)["staging"]
    up = {}
    for r in staging.collect():
        up.setdefault(r.k, set()).add(r.operator)
    total, want = len(up), []
    while True:
        fall, reach = {}, {}
        for ops in up.values():
            for o in ops:
                reach[o] = reach.get(o, 0) + 1
                fall[o] = fall.get(o, 0) + (len(ops) == 1)
        best = min(reach, key=lambda o: (-fall[o], -reach[o], o))
        up = {k: ops - {best} for k, ops in up.items() if ops != {best}}
        want.append((len(want) + 1, best, total - len(up), total - len(up) >= share * total))
        if want[-1][-1]:
            break
    assert [tuple(r) for r in Q.research.hub_removal(staging, share).orderBy("step").collect()] == want
    assert not Q.research.hub_removal(staging, 1.0, most=2).agg({"reached": "max"}).first()[0]


def test_three_shares_in_one_run(spark):
    """All shares come from one run of steps, and no smaller set than least brings down as many (by trying all sets)."""
    rows = [(k, o) for k in range(60) for o in {f"o{k % 5}", f"o{(k * k) % 7}"}] + [(100 + k, "big") for k in range(25)]
    staging = spark.createDataFrame(rows, "k int, operator string")
    steps = Q.research.hub_removals(staging).orderBy("step").collect()
    total, names = len({k for k, _ in rows}), sorted({o for _, o in rows})
    needs = {}
    for k, o in rows:
        needs.setdefault(k, set()).add(o)
    fallen = lambda s: sum(ops <= set(s) for ops in needs.values())
    for r in steps:
        assert r.fallen == fallen([x.operator for x in steps[: r.step]])
        assert r.share == max((s for s in Q.research.SHARES if r.fallen >= s * total), default=None)
        best = next(n for n in range(len(names) + 1) if any(fallen(s) >= r.fallen for s in itertools.combinations(names, n)))
        assert r.least <= best <= r.step
    assert steps[-1].share == 0.5
    assert Q.research.hub_removals(staging.limit(0)).collect() == []


def test_abort_on_duplicates(spark):
    cur, new = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b")], "k int, v string")
    with pytest.raises(Exception, match="duplicate key"):
        Q.merge.merge_abort(cur, new, ["k"]).collect()


def test_streams(spark, tmp_path):
    from perispark.streaming import results as R

    rows = Q.Tables(spark, SF)["scan_results"].coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    R.stream_upsert(stream, str(tmp_path / "out"), ["target"], "ts").option("checkpointLocation",
        str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert R.upserted(spark, str(tmp_path / "out"), ["target"]).count() == rows.select("target").distinct().count()
    q = (
        R.stream_error_guard(stream, 0.3, 50).writeStream.format("memory").queryName("guard").option("checkpointLocation",
        str(tmp_path / "c2")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    batch = Q.QUERIES["k3_guard_batch"](spark, SF)
    assert sorted(spark.table("guard").collect()) == sorted(batch.collect())
    q = (
        R.stream_changelog(stream, "target",
        ["module", "error_kind"]).writeStream.format("memory").queryName("log").option("checkpointLocation",
        str(tmp_path / "c3")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.table("log").filter("change = 'added'").count() == rows.select("target").distinct().count()
