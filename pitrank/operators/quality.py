"""Data-quality checks on labels and universe: offender tables and one report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from pitrank.contracts import TOP_K
from pitrank.operators.universe import split_days

# Alarm thresholds.
MAX_COUNT_DRIFT = 0.05
CONTAMINATION_MEDIAN = 1.00
QUIET_MEDIAN = 0.20
MAX_DROP_FRACTION = 0.05


class QualityError(RuntimeError):
    """A hard check failed."""


def unique_tickers(df: DataFrame) -> DataFrame:
    """Distinct names per day."""
    return df.groupBy("trade_date").agg(F.count_distinct("ticker").alias("n_tickers"))


def continuity_offenders(df: DataFrame, max_drift: float = MAX_COUNT_DRIFT) -> DataFrame:
    """Day-over-day jumps in the number of names (calendar-sized window after aggregation)."""
    w = W.orderBy("trade_date")
    steps = unique_tickers(df).select(
        F.lag("trade_date").over(w).alias("from_date"),
        F.col("trade_date").alias("to_date"),
        F.lag("n_tickers").over(w).alias("from_count"),
        F.col("n_tickers").alias("to_count"),
    )
    change = F.abs(F.col("to_count") - F.col("from_count")) / F.when(F.col("from_count") > 0, F.col("from_count"))
    return steps.withColumn("pct_change", change).where(F.col("pct_change") > max_drift)


def median_positive_return(labels: DataFrame) -> DataFrame:
    """Exact median return of each day's positives (at most k rows per day)."""
    return labels.where("label = 1").groupBy("trade_date").agg(F.median("return_t").alias("median_return"))


def contamination_offenders(labels: DataFrame, above: float = CONTAMINATION_MEDIAN) -> DataFrame:
    return median_positive_return(labels).where(F.col("median_return") > above)


def quiet_offenders(labels: DataFrame, below: float = QUIET_MEDIAN) -> DataFrame:
    return median_positive_return(labels).where(F.col("median_return") < below)


def cardinality_offenders(labels: DataFrame, k: int = TOP_K) -> DataFrame:
    per_day = labels.groupBy("trade_date").agg(
        F.sum(F.col("label").cast("long")).alias("n_positive"), F.count("ticker").alias("n_total")
    )
    return per_day.where((F.col("n_positive") != k) & (F.col("n_total") >= k))


def split_day_offenders(labels: DataFrame, actions: DataFrame) -> DataFrame:
    return labels.select("trade_date", "ticker").distinct().join(
        split_days(actions), ["trade_date", "ticker"], "left_semi"
    )


def coverage_offenders(labels: DataFrame, universe: DataFrame, max_drop: float = MAX_DROP_FRACTION) -> DataFrame:
    """Days on which too much of the universe got no label row."""
    have = unique_tickers(universe).withColumnRenamed("n_tickers", "universe_n")
    got = unique_tickers(labels).withColumnRenamed("n_tickers", "labeled_n")
    joined = have.join(got, "trade_date", "left").withColumn("labeled_n", F.coalesce("labeled_n", F.lit(0)).cast("long"))
    dropped = F.col("universe_n") - F.col("labeled_n")
    return (
        joined.withColumn("dropped", dropped)
        .withColumn("dropped_fraction", F.col("dropped") / F.col("universe_n"))
        .where(F.col("dropped_fraction") > max_drop)
    )


def daily_quality(labels: DataFrame, actions: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Everything the checks need, one row per day: a single pass over labels and one over the universe."""
    flagged = labels.join(
        split_days(actions).withColumn("_split", F.lit(True)), ["trade_date", "ticker"], "left"
    )
    per_day = flagged.groupBy("trade_date").agg(
        F.count_distinct("ticker").alias("labeled_n"),
        F.sum(F.col("label").cast("long")).alias("n_positive"),
        F.count("ticker").alias("n_total"),
        F.median(F.when(F.col("label") == 1, F.col("return_t"))).alias("median_return"),
        F.count_distinct(F.when(F.col("_split"), F.col("ticker"))).alias("n_split"),
    )
    if universe is None:
        return per_day.withColumn("universe_n", F.lit(None).cast("long")).withColumn("counted_n", F.col("labeled_n"))
    have = unique_tickers(universe).withColumnRenamed("n_tickers", "universe_n")
    return per_day.join(have, "trade_date", "full").withColumn("counted_n", F.col("universe_n"))


def sanity_report(labels: DataFrame, actions: DataFrame, universe: DataFrame | None = None, k: int = TOP_K) -> DataFrame:
    """One row per check; only ``severity = 'fail'`` rows may stop a pipeline."""
    w = W.orderBy("trade_date")
    before = F.last("counted_n", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    drift = F.when(before > 0, F.abs(F.col("counted_n") - before) / F.when(before > 0, before))
    # Only days that have names take part in the continuity chain.
    days = daily_quality(labels, actions, universe).withColumn("drift", drift)
    dropped = (F.col("universe_n") - F.coalesce("labeled_n", F.lit(0))) / F.when(F.col("universe_n") > 0, F.col("universe_n"))
    median = F.col("median_return")
    none = F.lit(None).cast("double")
    # (check, severity, offending condition, offender count, worst value)
    checks = [
        ("universe_continuity", "fail", F.col("drift") > MAX_COUNT_DRIFT, None, F.max, F.col("drift")),
        ("median_gainer_contamination", "fail", median > CONTAMINATION_MEDIAN, None, F.max, median),
        ("median_gainer_quiet_regime", "warn", median < QUIET_MEDIAN, None, F.min, median),
        ("label_cardinality", "fail", (F.col("n_positive") != k) & (F.col("n_total") >= k), None, F.max, F.col("n_positive")),
        ("no_split_days", "fail", F.col("n_split") > 0, F.col("n_split"), F.max, none),
    ]
    if universe is not None:
        checks.append(("universe_coverage", "fail", dropped > MAX_DROP_FRACTION, None, F.max, dropped))
    sums = []
    for i, (_, _, bad, weight, worst, value) in enumerate(checks):
        count = F.count(F.when(bad, 1)) if weight is None else F.coalesce(F.sum(F.when(bad, weight)), F.lit(0))
        sums += [count.alias(f"n{i}"), worst(F.when(bad, value)).cast("double").alias(f"w{i}")]
    lines = F.array(*[
        F.struct(
            F.lit(name).alias("check"), (F.col(f"n{i}") == 0).alias("passed"), F.lit(severity).alias("severity"),
            F.col(f"n{i}").alias("n_offenders"), F.col(f"w{i}").alias("worst"),
        )
        for i, (name, severity, *_) in enumerate(checks)
    ])
    return days.agg(*sums).select(F.explode(lines).alias("l")).select("l.*")


def enforce(report: DataFrame) -> list:
    """Raise on a failed hard check; return the warnings."""
    rows = report.collect()
    failed = [r.asDict() for r in rows if not r["passed"] and r["severity"] == "fail"]
    if failed:
        raise QualityError(f"sanity checks failed: {failed}")
    return [r.asDict() for r in rows if not r["passed"]]
