"""Ranking metrics on predictions (trade_date, ticker, score) against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from pitrank.contracts import TOP_K
from pitrank.operators.ranks import top_k


def scored_top_k(predictions: DataFrame, labels: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top-k rows per day with position and label (missing label = 0)."""
    best = top_k(predictions.select("trade_date", "ticker", "score"), k, position="pos")
    hits = labels.where("label = 1").select("trade_date", "ticker", "label")
    return best.join(hits, ["trade_date", "ticker"], "left").withColumn(
        "label", F.coalesce(F.col("label"), F.lit(0))
    )


def daily_scores(predictions: DataFrame, labels: DataFrame, k: int = TOP_K) -> DataFrame:
    """Per day: hits, picks, precision and average precision in one pass over the top-k.

    AP@k divides by min(relevant, k), relevant counting every positive of the day;
    it is null on days without positives.
    """
    picked = scored_top_k(predictions, labels, k)
    upto = W.partitionBy("trade_date").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    gains = picked.withColumn("_hits", F.sum("label").over(upto)).withColumn(
        "_gain", F.when(F.col("label") == 1, F.col("_hits") / F.col("pos"))
    )
    per_day = gains.groupBy("trade_date").agg(
        F.sum("label").cast("long").alias("hits"),
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.col("_gain")), F.lit(0.0)).alias("_gain"),
    )
    relevant = labels.where("label = 1").groupBy("trade_date").agg(F.count(F.lit(1)).alias("_relevant"))
    return per_day.join(relevant, "trade_date", "left").select(
        "trade_date",
        "hits",
        "n",
        (F.col("hits") / F.col("n")).alias("precision"),
        # least() skips nulls, so a day without positives is kept out explicitly.
        F.when(F.col("_relevant") > 0, F.col("_gain") / F.least(F.col("_relevant"), F.lit(k))).alias(
            "average_precision"
        ),
    )


def hits_per_day(predictions: DataFrame, labels: DataFrame, k: int = TOP_K) -> DataFrame:
    return (
        scored_top_k(predictions, labels, k)
        .groupBy("trade_date")
        .agg(F.sum("label").cast("long").alias("hits"))
    )


def precision_at_k(predictions: DataFrame, labels: DataFrame, k: int = TOP_K) -> DataFrame:
    per_day = scored_top_k(predictions, labels, k).groupBy("trade_date").agg(F.avg("label").alias("p"))
    return per_day.agg(F.avg("p").alias("precision"), F.count(F.lit(1)).alias("n_days"))


def map_at_k(predictions: DataFrame, labels: DataFrame, k: int = TOP_K) -> DataFrame:
    return daily_scores(predictions, labels, k).agg(
        F.avg("average_precision").alias("map"), F.count("average_precision").alias("n_days")
    )


def per_year_report(predictions: DataFrame, labels: DataFrame, k: int = TOP_K) -> DataFrame:
    """Calendar-year precision, MAP, mean and median hits, days; ordered, it is the decay series."""
    return (
        daily_scores(predictions, labels, k)
        .groupBy(F.year("trade_date").alias("year"))
        .agg(
            F.avg("precision").alias("precision_at_k"),
            F.avg("average_precision").alias("map_at_k"),
            F.avg("hits").alias("mean_hits"),
            F.median("hits").alias("median_hits"),
            F.count(F.lit(1)).alias("n_days"),
        )
    )


def decay_series(predictions: DataFrame, labels: DataFrame, k: int = TOP_K) -> DataFrame:
    """The yearly report as one row of aligned, year-ordered arrays."""
    report = per_year_report(predictions, labels, k)
    rows = F.array_sort(F.collect_list(F.struct("year", "precision_at_k", "map_at_k", "mean_hits", "n_days")))
    one = report.agg(rows.alias("r"))
    return one.select(*[F.col(f"r.{c}").alias(c) for c in ("year", "precision_at_k", "map_at_k", "mean_hits", "n_days")])


def paired_hits(model: DataFrame, baseline: DataFrame, labels: DataFrame, k: int = TOP_K) -> DataFrame:
    """Daily hits of both on their common days."""
    a = hits_per_day(model, labels, k).withColumnRenamed("hits", "model_hits")
    b = hits_per_day(baseline, labels, k).withColumnRenamed("hits", "baseline_hits")
    return a.join(b, "trade_date")


def yearly_record(paired: DataFrame) -> DataFrame:
    return (
        paired.groupBy(F.year("trade_date").alias("year"))
        .agg(
            F.avg("model_hits").alias("model_mean_hits"),
            F.avg("baseline_hits").alias("baseline_mean_hits"),
            F.count(F.lit(1)).alias("n_days"),
        )
        .withColumn("model_won", F.col("model_mean_hits") > F.col("baseline_mean_hits"))
    )


def compare_to_baseline(model: DataFrame, baseline: DataFrame, labels: DataFrame, k: int = TOP_K) -> DataFrame:
    """One row: mean hits delta over common days, years won, years, days."""
    paired = paired_hits(model, baseline, labels, k)
    years = (
        paired.groupBy(F.year("trade_date").alias("year"))
        .agg(
            F.sum("model_hits").alias("m"), F.sum("baseline_hits").alias("b"), F.count(F.lit(1)).alias("d")
        )
        .withColumn("won", (F.col("m") / F.col("d") > F.col("b") / F.col("d")).cast("long"))
    )
    return years.agg(
        (F.sum("m") / F.sum("d") - F.sum("b") / F.sum("d")).alias("mean_hits_delta"),
        F.sum("won").alias("years_won"),
        F.count(F.lit(1)).alias("years_total"),
        F.sum("d").alias("n_days"),
    )
