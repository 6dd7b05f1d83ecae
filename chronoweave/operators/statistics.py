"""Paired tests and resampling over tables of scores."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EXACT = 50
#: The most values in one row to draw from (a larger group has several rows), and about how many draws are made from a row.
BLOCK, DRAWS = 4096, 1 << 19


def exact_p(statistic: float, n: int) -> float:
    """Two-sided p of a signed-rank statistic without ties, from the number of rank subsets with each sum."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for total in range(len(ways) - 1, rank - 1, -1):
            ways[total] += ways[total - rank]
    return min(1.0, 2 * sum(ways[: int(math.floor(statistic)) + 1]) / 2**n)


def normal_p(statistic: float, n: int, ties: float) -> float:
    """Two-sided p by the normal approximation; ties is the sum of t^3 - t over groups of equal differences."""
    spread = math.sqrt(max(1e-300, n * (n + 1) * (2 * n + 1) / 24 - ties / 48))
    return min(1.0, math.erfc(abs(statistic - n * (n + 1) / 4) / spread / math.sqrt(2)))


def signed_rank(pairs: DataFrame, group: str, a: str = "a", b: str = "b") -> DataFrame:
    """Wilcoxon signed-rank test of each group: n, mean_diff, statistic, p_value. Zero differences are left out of the
    ranks; with nothing else the statistic is 0 and p 1."""
    diff = F.col(a) - F.col(b)
    base = pairs.select(group, diff.alias("d"))
    means = base.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"))
    size = F.abs("d")
    w = Window.partitionBy(group)
    same = F.count(F.lit(1)).over(Window.partitionBy(group, size))
    ranks = base.where("d <> 0").withColumn("rank", F.rank().over(w.orderBy(size)) + (same - 1) / 2).withColumn("t", same)
    sums = ranks.groupBy(group).agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("_up"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("_down"), F.count(F.lit(1)).alias("_m"), F.sum(F.col("t") * F.col("t") - 1).alias("_ties"))
    got = means.join(sums, group, "left").withColumn("statistic", F.coalesce(F.least("_up", "_down"), F.lit(0.0)))

    @F.pandas_udf("double")
    def p_value(statistic: pd.Series, n: pd.Series, m: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for s, all_, k, t in zip(statistic, n, m.fillna(0), ties.fillna(0)):
            out.append(1.0 if k == 0 else exact_p(s, int(k)) if k <= EXACT and t == 0 and k == all_ else normal_p(s, int(k), t))
        return pd.Series(out)

    return got.withColumn("p_value", p_value("statistic", "n", "_m", "_ties")).select(group, "n", "statistic", "p_value", "mean_diff")


def shares(key: list[int], n: int, block: int, at: int, resamples: int) -> np.ndarray:
    """How many of the n draws of each resample fall on block number `at`, when n places lie in blocks of `block`.

    Draws are halved binomially by the places of both halves, down to the block. What a half gets depends on key and its
    ends alone, so the blocks of a resample have n draws together wherever they are drawn.
    """
    got, low, high = np.full(resamples, n), 0, -(-n // block)
    while high - low > 1:
        mid = (low + high) // 2
        left = np.random.default_rng([*key, low, high]).binomial(got, (mid - low) * block / (min(high * block, n) - low * block))
        got, low, high = (left, low, mid) if at < mid else (got - left, mid, high)
    return got


def bootstrap(values: DataFrame, group: str, value: str, resamples: int = 10_000, confidence: float = 0.95, seed: int = 0, statistic: Callable[[Column], Column] = F.avg, block: int = BLOCK) -> DataFrame:
    """Percentile interval of a statistic of each group by resampling: point_estimate, low, high, n_resamples.

    statistic makes an aggregate of the value column (F.avg, F.median, F.stddev, ...). A resample draws as many values as
    the group has; draws are hashes of seed, group, resample and place, so they are the same on any cluster. Draws are made
    where the values are and go straight into the aggregate: a row holds a block of a group's sorted values and some of
    the resamples, and shares() tells how many draws fall on a block. So no group is gathered and no draw is joined.
    """
    spark = values.sparkSession
    rows = values.where(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).alias("_v"))
    sizes = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), statistic(F.col("_v")).alias("point_estimate"))
    same = Window.partitionBy("_g")
    placed = rows.select("_g", "_v", F.count(F.lit(1)).over(same).alias("_n"), F.floor((F.row_number().over(same.orderBy("_v")) - 1) / block).alias("_b"))
    blocks = placed.groupBy("_g", "_n", "_b").agg(F.sort_array(F.collect_list("_v")).alias("_of"))
    many = F.floor(F.greatest(F.lit(1), F.lit(DRAWS) / F.least("_n", F.lit(block))))
    some = blocks.withColumn("_many", many).withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"), "_many")))

    @F.pandas_udf("array<bigint>")
    def counts(key: pd.Series, n: pd.Series, b: pd.Series, first: pd.Series, many: pd.Series) -> pd.Series:
        return pd.Series([shares([seed % 2**64, k % 2**64, f], s, block, at, min(m, resamples - f)) for k, s, at, f, m in zip(key.tolist(), n.tolist(), b.tolist(), first.tolist(), many.tolist())])

    # a fixed number, for rows so few and small that adaptive execution would put them into one task
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    dealt = some.repartition(parts, "_g", "_b", "_first").withColumn("_c", counts(F.xxhash64("_g"), "_n", "_b", "_first", "_many"))
    each = dealt.select("_g", "_b", "_of", "_first", F.posexplode("_c").alias("_k", "_c")).where("_c > 0")
    draws = each.select("_g", "_b", "_of", (F.col("_first") + F.col("_k") + 1).cast("int").alias("_r"), F.explode(F.sequence(F.lit(1).cast("long"), "_c")).alias("_i"))
    at = F.pmod(F.xxhash64(F.lit(seed), "_g", "_r", F.col("_b") * 2**40 + F.col("_i")), F.size("_of")).cast("int")
    drawn = draws.select("_g", "_r", F.col("_of")[at].alias("_v")).groupBy("_g", "_r").agg(statistic(F.col("_v")).alias("_m"))
    alpha = 1 - confidence
    bound = lambda k: max(0, min(k, resamples - 1)) + 1
    low, high = bound(int(alpha / 2 * resamples)), bound(int((1 - alpha / 2) * resamples) - 1)
    nth = F.row_number().over(Window.partitionBy("_g").orderBy("_m", "_r"))
    at = lambda k: F.max(F.when(F.col("_nth") == k, F.col("_m")))
    found = drawn.withColumn("_nth", nth).groupBy("_g").agg(at(low).alias("low"), at(high).alias("high"), F.count(F.lit(1)).alias("n_resamples"))
    return sizes.join(found.withColumnRenamed("_g", "_h"), F.col("_g").eqNullSafe(F.col("_h"))).select(F.col("_g").alias(group), "point_estimate", "low", "high", "n_resamples")
