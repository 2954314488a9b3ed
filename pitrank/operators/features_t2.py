"""Premarket (T2) features: the T1 columns re-stamped to 09:25 plus seven premarket columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitrank import contracts as C
from pitrank.functions.clock import premarket_open, premarket_time
from pitrank.functions.scalars import growth, ratio
from pitrank.operators.leakage import guarded


def premarket_only(bars: DataFrame) -> DataFrame:
    """Strictly before 09:25 and knowable by 09:25, whatever window the feed claims."""
    cutoff = premarket_time("trade_date")
    return bars.where((F.col("minute") < cutoff) & (F.col("as_of") <= cutoff))


def premarket_aggregate(bars: DataFrame) -> DataFrame:
    """One row per (date, ticker): a single map-side combined aggregate over the minutes."""
    money = (F.col("close") * F.col("volume")).cast("decimal(28,6)")
    return premarket_only(bars).groupBy("trade_date", "ticker").agg(
        F.max_by("close", "minute").alias("last_price"),
        F.max("high").alias("high_price"),
        F.sum("volume").alias("total_volume"),
        F.sum(money).cast("double").alias("premarket_dollar_volume"),
        F.sum("trade_count").cast("long").alias("premarket_trade_count"),
        F.min("minute").alias("first_minute"),
    )


def halt_flags(halts: DataFrame) -> DataFrame:
    """Names halted on the date and known to be by 09:25."""
    known = halts.where(F.col("as_of") <= premarket_time("trade_date"))
    return known.select("trade_date", "ticker").distinct().withColumn("overnight_halt_flag", F.lit(1))


def build_t2_features(t1: DataFrame, premarket: DataFrame, prior_close: DataFrame, halts: DataFrame) -> DataFrame:
    """The 52-column T2 contract; a prior close stamped after T1 stops the query."""
    keys = ["trade_date", "ticker"]
    base = guarded(prior_close, "T1").where(F.col("as_of").isNotNull()).select(
        *keys, F.col("close").alias("_prior")
    )
    joined = (
        t1.drop("as_of")
        .join(premarket_aggregate(premarket), keys, "left")
        .join(base, keys, "left")
        .join(halt_flags(halts), keys, "left")
    )
    minutes = F.timestamp_diff("MINUTE", premarket_open("trade_date"), F.col("first_minute"))
    return joined.select(
        *[c for c in C.T1_COLUMNS if c != "as_of"],
        growth(F.col("last_price"), F.col("_prior")).alias("premarket_gap_pct"),
        "premarket_dollar_volume",
        ratio(F.col("total_volume"), F.col("adv_20")).alias("premarket_rel_volume"),
        growth(F.col("last_price"), F.col("high_price")).alias("premarket_high_to_last_drawdown"),
        F.coalesce("premarket_trade_count", F.lit(0)).cast("long").alias("premarket_trade_count"),
        minutes.cast("double").alias("premarket_first_trade_minutes"),
        F.coalesce("overnight_halt_flag", F.lit(0)).alias("overnight_halt_flag"),
        premarket_time("trade_date").alias("as_of"),
    )
