"""Agreement between the proxy top-k and a captured list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from pitrank.contracts import TOP_K
from pitrank.operators.calendar import business_days

# Freeze rule.
FREEZE_MEDIAN = 8
FREEZE_WINDOW = 30


def first_k(listed: DataFrame, k: int = TOP_K) -> DataFrame:
    """First ``k`` entries per day of (trade_date, pos, ticker), upper-cased."""
    w = W.partitionBy("trade_date").orderBy("pos", "ticker")
    return (
        listed.withColumn("_n", F.row_number().over(w))
        .where(F.col("_n") <= k)
        .select("trade_date", F.upper("ticker").alias("ticker"))
        .distinct()
    )


def overlap_at_k(proxy: DataFrame, real: DataFrame, k: int = TOP_K) -> DataFrame:
    """Per day that has both lists: size of the intersection of their first ``k`` entries."""
    a = first_k(proxy, k).withColumn("_a", F.lit(1))
    b = first_k(real, k).withColumn("_b", F.lit(1))
    both = a.join(b, ["trade_date", "ticker"], "full")
    return (
        both.groupBy("trade_date")
        .agg(F.count("_a").alias("na"), F.count("_b").alias("nb"),
             F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("overlap_at_k"))
        .where("na > 0 and nb > 0")
        .select("trade_date", "overlap_at_k")
    )


def overlap_report(proxy: DataFrame, real: DataFrame, bounds: DataFrame, k: int = TOP_K) -> DataFrame:
    """Every business day in ``bounds``: which lists exist and their overlap (null unless both do)."""
    days = business_days(bounds)
    have_a = proxy.select("trade_date").distinct().withColumn("_a", F.lit(True))
    have_b = real.select("trade_date").distinct().withColumn("_b", F.lit(True))
    return (
        days.join(have_a, "trade_date", "left")
        .join(have_b, "trade_date", "left")
        .join(overlap_at_k(proxy, real, k), "trade_date", "left")
        .select(
            "trade_date",
            F.coalesce("_a", F.lit(False)).alias("proxy_available"),
            F.coalesce("_b", F.lit(False)).alias("real_available"),
            "overlap_at_k",
        )
    )


def freeze_criterion(report: DataFrame, threshold: float = FREEZE_MEDIAN, window: int = FREEZE_WINDOW) -> DataFrame:
    """One row: median overlap of the newest ``window`` report rows (nulls left out) and the verdict."""
    newest = report.orderBy(F.col("trade_date").desc()).limit(window)
    return newest.agg(
        F.count("overlap_at_k").alias("n_days"), F.median("overlap_at_k").alias("median_overlap")
    ).withColumn("met", F.coalesce(F.col("median_overlap") >= threshold, F.lit(False)))
