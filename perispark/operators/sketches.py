"""Mergeable sketches: distinct counts (HLL) and quantiles (KLL) kept a row for each snapshot and merged over any of them.

A sketch's size doesn't depend on the rows behind it, so years of daily snapshots are summed up from a few
kilobytes each, and a day that comes in again replaces its own row alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: lg of the registers of a distinct count and the k of a quantile sketch, and the errors that they hold in about 99 of 100
#: cases: of an estimate as a share of the count (three standard errors), and of a quantile's rank.
HLL_LG, KLL_K = 12, 400
COUNT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (HLL_LG / 2), 0.01


def sketched(df: DataFrame, by: Sequence[str], distinct: Mapping[str, str | Column] = {}, numbers: Mapping[str, str | Column] = {}) -> DataFrame:  # noqa: B006
    """One row for each group of by: n, a sketch <name>_hll of each distinct column (nulls don't count), and <name>_kll of
    each number (nulls and NaN don't count; null where none is left)."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    out = [F.count("*").alias("n")]
    out += [F.hll_sketch_agg(col(c), F.lit(HLL_LG)).alias(f"{n}_hll") for n, c in distinct.items()]
    for name, c in numbers.items():
        value = col(c).cast("double")
        out.append(F.kll_sketch_agg_double(F.when(~F.isnan(value), value), F.lit(KLL_K)).alias(f"{name}_kll"))
    return df.groupBy(*by).agg(*out)


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of sketched() put together, for each group of by: the same columns."""
    put = {"_hll": lambda c: F.hll_union_agg(c), "_kll": lambda c: F.kll_merge_agg_double(c, F.lit(KLL_K))}
    out = [F.sum("n").alias("n")] + [put[c[-4:]](c).alias(c) for c in sketches.columns if c[-4:] in put and c not in by]
    return sketches.groupBy(*by).agg(*out)


def estimates(sketches: DataFrame, quantiles: Mapping[str, float] = {}) -> DataFrame:  # noqa: B006
    """Each <name>_hll as the count <name>, and each <name>_kll as <name>_<q> for the named quantiles; other columns stay."""
    out = []
    for c in sketches.columns:
        if c.endswith("_hll"):
            out.append(F.hll_sketch_estimate(c).alias(c[:-4]))
        elif c.endswith("_kll"):
            for n, q in quantiles.items():
                out.append(F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(q))).alias(f"{c[:-4]}_{n}"))
        else:
            out.append(F.col(c))
    return sketches.select(*out)
