"""Live scoring and the stop / kill rules, evaluated for every day at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

# Rule windows and drift.
STOP_DRIFT_HITS = 1.5
STOP_WINDOW_DAYS = 20
KILL_WINDOW_DAYS = 30


def score_days(predictions: DataFrame, captured: DataFrame, labels: DataFrame) -> DataFrame:
    """Per predicted day: picks, hits in the captured list and hits in the proxy positives.

    ``captured`` has (trade_date, ticker) rows.  Equi-joins on the pair, no lists.
    """
    keys = ["trade_date", "ticker"]
    picks = predictions.select(*keys).distinct()
    live = captured.select(*keys).distinct().withColumn("_c", F.lit(1))
    proxy = labels.where("label = 1").select(*keys).distinct().withColumn("_p", F.lit(1))
    joined = picks.join(live, keys, "left").join(proxy, keys, "left")
    return joined.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("n_predicted"),
        F.count("_c").alias("captured_hits"),
        F.count("_p").alias("proxy_hits"),
    )


def rolling_monitor(hits: DataFrame, expectation: float | None, stop_window: int = STOP_WINDOW_DAYS,
                    kill_window: int = KILL_WINDOW_DAYS, drift: float = STOP_DRIFT_HITS) -> DataFrame:
    """Verdict after each day of (trade_date, live_hits, baseline_hits).

    STOP: the last ``stop_window`` days all fall short of ``expectation`` by more than
    ``drift``.  KILL: the last ``kill_window`` days are all strictly below the baseline.
    A null never satisfies a rule.  One row per day: calendar-sized.
    """
    w = W.orderBy("trade_date")
    last = lambda n: w.rowsBetween(-n + 1, 0)
    short = F.coalesce(F.lit(expectation).cast("double") - F.col("live_hits") > drift, F.lit(False)).cast("int")
    below = F.coalesce(F.col("live_hits") < F.col("baseline_hits"), F.lit(False)).cast("int")
    full = lambda n: F.count(F.lit(1)).over(last(n)) == n
    return hits.select(
        "trade_date",
        "live_hits",
        "baseline_hits",
        (full(stop_window) & (F.min(short).over(last(stop_window)) == 1)).alias("stop"),
        (full(kill_window) & (F.min(below).over(last(kill_window)) == 1)).alias("kill"),
    )


def latest_verdict(monitor: DataFrame) -> DataFrame:
    """The newest day's row."""
    return monitor.orderBy(F.col("trade_date").desc()).limit(1)
