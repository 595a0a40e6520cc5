"""Sketches kept for each day and merged: within their error bounds, and the same however they are put together."""

import random

from perispark.operators import sketches as S

QUANTILES = {"p25": 0.25, "p50": 0.5, "p95": 0.95}


def rows():
    rng = random.Random(3)
    return [(d, rng.choice(["CH", "US", None]), f"ip{int(rng.paretovariate(0.4)) % 9000}", rng.lognormvariate(5, 2)) for d in range(12) for _ in range(3000)]


def rank_of(values, x):
    return sum(v < x for v in values) / len(values), sum(v <= x for v in values) / len(values)


def test_days_merged_hold_their_bounds(spark):
    data = rows()
    df = spark.createDataFrame([*data, (0, "CH", None, None), (13, "US", None, float("nan"))], "day int, cc string, ip string, ms double")
    days = S.sketched(df, ["day", "cc"], {"ip": "ip"}, {"ms": "ms"})
    for by in ([], ["cc"], ["day"]):
        for r in S.estimates(S.merged(days, by), QUANTILES).collect():
            mine = [x for x in data if all(r[b] == {"day": x[0], "cc": x[1]}[b] for b in by)]
            extra = sum(all(r[b] == {"day": d, "cc": c}[b] for b in by) for d, c in ((0, "CH"), (13, "US")))
            assert r.n == len(mine) + extra
            exact = len({x[2] for x in mine})
            assert abs(r.ip - exact) <= max(1, S.COUNT_ERROR * exact)
            for name, q in QUANTILES.items():
                if not mine:
                    assert r[f"ms_{name}"] is None
                    continue
                low, high = rank_of([x[3] for x in mine], r[f"ms_{name}"])
                assert low - S.RANK_ERROR <= q <= high + S.RANK_ERROR


def test_a_day_again_replaces_its_row(spark):
    """Merging daily rows equals the sketch of all rows' distinct counts, in any order, and empty tables give none."""
    data = rows()
    df = spark.createDataFrame(data, "day int, cc string, ip string, ms double")
    days = S.sketched(df, ["day"], {"ip": "ip"})
    once = S.estimates(S.merged(days)).first().ip
    assert once == S.estimates(S.merged(days.repartition(5).union(days.filter("day = 3")))).first().ip
    assert once == S.estimates(S.sketched(df, [], {"ip": "ip"})).first().ip
    assert S.sketched(df.limit(0), ["day"], {"ip": "ip"}, {"ms": "ms"}).collect() == []
