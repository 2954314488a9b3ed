"""Names that stop trading: inferred delistings and the survivorship check."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitrank.operators import calendar as cal


def _last_sessions(bars: DataFrame, calendar: DataFrame, extra: list[str]) -> DataFrame:
    last = bars.groupBy("ticker").agg(
        F.max("trade_date").alias("last_trade_date"),
        *[F.max_by(c, "trade_date").alias(c) for c in extra],
    )
    named = calendar.select(F.col("session").alias("last_trade_date"), "session_idx", "next_session")
    span = calendar.agg(F.max("session_idx").alias("_last"))
    return last.join(F.broadcast(named), "last_trade_date").crossJoin(F.broadcast(span))


def infer_delistings(bars: DataFrame, min_gap: int = 5, calendar: DataFrame | None = None) -> DataFrame:
    """Tickers silent for at least ``min_gap`` final sessions; halts that resume never show.

    Confidence grows with the silence and is full at four times ``min_gap``.
    """
    calendar = calendar if calendar is not None else cal.sessions(bars)
    extra = [c for c in ("instrument_id",) if c in bars.columns]
    gap = F.col("_last") - F.col("session_idx")
    return (
        _last_sessions(bars, calendar, extra)
        .withColumn("gap", gap)
        .where((F.col("gap") >= min_gap) & (F.col("gap") > 0))
        .select(
            "ticker",
            *extra,
            "last_trade_date",
            F.coalesce("next_session", "last_trade_date").alias("inferred_delist_date"),
            F.least(F.lit(1.0), F.col("gap") / F.lit(4.0 * min_gap)).alias("confidence"),
        )
    )


def delisting_actions(delistings: DataFrame) -> DataFrame:
    """Corporate-action rows, stamped on the first day the absence was visible."""
    return delistings.select(
        F.col("inferred_delist_date").alias("ex_date"),
        "ticker",
        F.lit("delisting").alias("action_type"),
        F.lit(None).cast("double").alias("ratio"),
        F.lit(None).cast("double").alias("cash_amount"),
        F.lit(None).cast("string").alias("new_ticker"),
        F.col("inferred_delist_date").cast("timestamp_ntz").alias("as_of"),
        "confidence",
    )


def _window_tickers(bars: DataFrame, calendar: DataFrame, early: float, late: float) -> DataFrame:
    """Per ticker: seen in the first / last fraction of the sessions."""
    n = F.col("_n")
    span = calendar.agg(F.max("session_idx").alias("_n")).select(
        F.greatest(F.lit(0), F.floor(n * early).cast("int") - 1).alias("_early_end"),
        F.least(n - 1, F.floor(n * F.lit(1.0 - late)).cast("int")).alias("_late_start"),
    )
    edges = calendar.crossJoin(F.broadcast(span)).select(
        F.col("session").alias("trade_date"),
        (F.col("session_idx") - 1 <= F.col("_early_end")).alias("early"),
        (F.col("session_idx") - 1 >= F.col("_late_start")).alias("late"),
    )
    return bars.select("ticker", "trade_date").join(F.broadcast(edges), "trade_date").groupBy("ticker").agg(
        F.max("early").alias("early"), F.max("late").alias("late")
    )


def disappeared(bars: DataFrame, early: float = 0.1, late: float = 0.1, calendar: DataFrame | None = None) -> DataFrame:
    """Tickers of the early window that are absent from the late one."""
    calendar = calendar if calendar is not None else cal.sessions(bars)
    return _window_tickers(bars, calendar, early, late).where("early and not late").select("ticker")


def survivorship_report(bars: DataFrame, early: float = 0.1, late: float = 0.1, min_disappeared: int = 1,
                        calendar: DataFrame | None = None) -> DataFrame:
    """One row; nothing disappearing is itself the failure.  Fewer than two sessions cannot pass."""
    calendar = calendar if calendar is not None else cal.sessions(bars)
    seen = _window_tickers(bars, calendar, early, late)
    counts = seen.agg(
        F.count(F.when(F.col("early"), 1)).alias("early_tickers"),
        F.count(F.when(F.col("late"), 1)).alias("late_tickers"),
        F.count(F.when(F.col("early") & ~F.col("late"), 1)).alias("disappeared_tickers"),
    )
    size = calendar.agg(F.count(F.lit(1)).alias("n_sessions"))
    return counts.crossJoin(F.broadcast(size)).withColumn(
        "passed", (F.col("n_sessions") >= 2) & (F.col("disappeared_tickers") >= min_disappeared)
    )
