"""Agreement and evaluation statistics: column expressions where closed forms exist, exact tests on aggregated counts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, m = k / n, n.cast("double")
    d = 1 + z * z / m
    mid, half = (p + z * z / (2 * m)) / d, z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / d
    zero = lambda x: F.when(n == 0, 0.0).otherwise(x)
    return zero(F.greatest(F.lit(0.0), mid - half)), zero(F.least(F.lit(1.0), mid + half))


def kappa(po: Column, pa: Column, pb: Column) -> Column:
    pe = pa * pb + (1 - pa) * (1 - pb)
    return F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0)


def ac1(po: Column, pa: Column, pb: Column) -> Column:
    pi = (pa + pb) / 2
    pe = 2 * pi * (1 - pi)
    return F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0)


def binomial_two_sided(k: int, n: int) -> float:
    """Exact test against one half; sums in logarithms, so large n stay finite."""
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + n * math.log(0.5) for i in range(n + 1)]
    return min(1.0, math.fsum(math.exp(x) for x in logs if x <= logs[k] + 1e-9))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    row, col, n = a + b, a + c, a + b + c + d
    choose = lambda m, x: math.lgamma(m + 1) - math.lgamma(x + 1) - math.lgamma(m - x + 1)
    log_p = {x: choose(row, x) + choose(n - row, col - x) - choose(n, col) for x in range(max(0, col - (n - row)), min(row, col) + 1)}
    return min(1.0, math.fsum(math.exp(v) for v in log_p.values() if v <= log_p[a] + 1e-9))


@F.pandas_udf(DoubleType())
def mcnemar_exact(b: pd.Series, c: pd.Series) -> pd.Series:
    """Two-sided, from the two discordant counts."""
    return pd.Series([binomial_two_sided(int(x), int(x) + int(y)) for x, y in zip(b, c)])


@F.pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(*map(int, r)) for r in zip(a, b, c, d)])


def _running(values: DataFrame, order: str, n: str, out: str, parts: int = 64) -> DataFrame:
    """Adds the sum of `n` over all rows with a smaller `order`, whose values are distinct numbers.

    The rows are dealt by ranges between quantiles, summed within each, and the ranges' totals, one row each, are added: no task holds all rows.
    """
    cuts = sorted(set(values.approxQuantile(order, [i / parts for i in range(1, parts)], 0.25 / parts))) if values.limit(1).count() else []
    piece = F.lit(0)
    for c in cuts:
        piece = piece + (F.col(order) >= F.lit(c)).cast("int")
    dealt = values.withColumn("_piece", F.when(F.col(order).isNull(), -1).otherwise(piece))
    own = F.sum(n).over(Window.partitionBy("_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    totals = dealt.groupBy("_piece").agg(F.sum(n).alias("_total"))
    later = totals.select(F.col("_piece").alias("_of"), F.explode(F.sequence(F.col("_piece") + 1, F.lit(len(cuts) + 1))).alias("_piece"), "_total")
    before = later.groupBy("_piece").agg(F.sum("_total").alias("_before"))
    got = dealt.withColumn("_own", F.coalesce(own, F.lit(0))).join(F.broadcast(before), "_piece", "left")  # a row per range
    return got.withColumn(out, F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_piece", "_own", "_before")


def positions(values: DataFrame, order: str, out: str) -> DataFrame:
    """Adds the place, from 0, of each row in the order of a column of distinct numbers."""
    return _running(values.withColumn("_one", F.lit(1).cast("long")), order, "_one", out).drop("_one")


def midranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """Average ranks for ties, from value counts: the running sum is over distinct values, not rows."""
    values = _running(df.groupBy(col).agg(F.count("*").alias("_n")), col, "_n", "_below")
    ranks = values.select(F.col(col).alias("_v"), (F.col("_below") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, df[col].eqNullSafe(ranks["_v"])).drop("_v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    ranked = midranks(midranks(df.select(x, y), x, "_rx"), y, "_ry")
    return ranked.agg(F.coalesce(F.corr("_rx", "_ry"), F.lit(0.0)).alias("rho"), F.count("*").alias("n"))


def bootstrap_kappa(cells: dict[tuple[int, int], int], resamples: int = 10_000, seed: int = 13) -> tuple[float, float]:
    """95 % interval of kappa, by multinomial resamples of the four cells (the same as resampling the rows)."""
    import numpy as np

    pairs = [(0, 0), (0, 1), (1, 0), (1, 1)]
    n = sum(cells.values())
    draws = np.random.default_rng(seed).multinomial(n, [cells.get(p, 0) / n for p in pairs], size=resamples) / n
    po, pa, pb = draws[:, 0] + draws[:, 3], draws[:, 2] + draws[:, 3], draws[:, 1] + draws[:, 3]
    pe = pa * pb + (1 - pa) * (1 - pb)
    k = np.sort(np.where(pe < 1, (po - pe) / np.where(pe < 1, 1 - pe, 1), 1.0))
    return float(k[int(0.025 * resamples)]), float(k[int(0.975 * resamples)])


def sample_ids(seed: int, key: Column) -> Column:
    """A repeatable shuffle: order by this and take the first n."""
    return F.xxhash64(F.lit(seed), key)
