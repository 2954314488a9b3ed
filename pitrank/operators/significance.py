"""Paired tests on daily differences and family-wise correction.

Inputs have one row per day (or per tested variant), so they are calendar-sized;
all sums and ranks are Spark aggregates and only the single result row meets a
distribution function.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from pitrank.functions.scalars import normal_two_sided, student_t_two_sided
from pitrank.operators.ranks import GRAIN, average_rank, with_rank_parts


@F.pandas_udf(T.DoubleType())
def _t_pvalue(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([student_t_two_sided(a, int(b) - 1) if pd.notna(a) else None for a, b in zip(t, n)])


@F.pandas_udf(T.DoubleType())
def _z_pvalue(z: pd.Series) -> pd.Series:
    return pd.Series([normal_two_sided(v) if pd.notna(v) else None for v in z])


def paired_t_test(paired: DataFrame, a: str = "model_hits", b: str = "baseline_hits") -> DataFrame:
    """statistic = mean(d) / (sd(d) / sqrt(n)), two-sided; null when n < 2 or sd = 0."""
    stats = paired.select((F.col(a) - F.col(b)).cast("double").alias("d")).agg(
        F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd")
    )
    error = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    scored = stats.withColumn(
        "statistic", F.when(F.col("n") >= 2, F.col("mean_diff") / F.when(error > 0, error))
    )
    return scored.select("n", "mean_diff", "statistic", _t_pvalue("statistic", "n").alias("p_value"))


def wilcoxon_pratt(paired: DataFrame, a: str = "model_hits", b: str = "baseline_hits") -> DataFrame:
    """Signed-rank test, zeros ranked and then left out (Pratt), normal approximation with tie correction.

    All differences zero: statistic 0, p 1.  No rows: nulls.
    """
    diffs = paired.select((F.col(a) - F.col(b)).cast("double").alias("d")).where(F.col("d").isNotNull()).select(
        "d", F.abs("d").alias("m"), F.lit(1).alias("g")
    )
    ranked = with_rank_parts(diffs, ["g"], "m", grain=GRAIN).withColumn("r", average_rank())
    by_size = ranked.groupBy("m").agg(
        F.count(F.lit(1)).alias("t"),
        F.sum(F.when(F.col("d") > 0, F.col("r"))).alias("plus"),
        F.sum(F.when(F.col("d") < 0, F.col("r"))).alias("minus"),
    )
    t = F.col("t").cast("double")
    sums = by_size.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("m") == 0, t)), F.lit(0.0)).alias("z"),
        F.coalesce(F.sum("plus"), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum("minus"), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum(F.when(F.col("m") > 0, t * t * t - t)), F.lit(0.0)).alias("ties"),
    )
    n, z = F.col("n").cast("double"), F.col("z")
    mean = (n * (n + 1) - z * (z + 1)) / 4.0
    var = (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1)) / 24.0 - F.col("ties") / 48.0
    out = sums.select(
        "n",
        F.when(n > 0, F.least("w_plus", "w_minus")).alias("statistic"),
        mean.alias("mean"),
        var.alias("variance"),
        ((n > 0) & (n == z)).alias("all_zero"),
    )
    score = (F.col("statistic") - F.col("mean")) / F.when(F.col("variance") > 0, F.sqrt("variance"))
    scored = out.withColumn("z_score", F.when(~F.col("all_zero"), score))
    return scored.select(
        "n", "statistic", "z_score",
        F.when(F.col("all_zero"), F.lit(1.0)).otherwise(_z_pvalue("z_score")).alias("p_value"),
    )


def holm(pvalues: DataFrame, p: str = "p_value", key: str = "variant") -> DataFrame:
    """Holm step-down adjusted p-values; one row per tested variant."""
    order = W.orderBy(p, key)
    m = F.count(F.lit(1)).over(W.partitionBy())
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return pvalues.withColumn("_step", step).withColumn("p_adjusted", F.max("_step").over(upto)).drop("_step")
