"""Trading calendar derived from the data: one row per distinct date.

A calendar has at most one row per calendar day, so its size is bounded by the
DATE domain no matter how many rows produced it.  That bound is what makes the
broadcasts and the partition-free windows below safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

BUSINESS_DAYS = (0, 1, 2, 3, 4)


def sessions(df: DataFrame, date_col: str = "trade_date") -> DataFrame:
    """Distinct dates with a dense index and the neighbouring sessions."""
    days = df.select(F.col(date_col).alias("session")).where(F.col(date_col).isNotNull()).distinct()
    w = W.orderBy("session")
    return days.select(
        "session",
        F.row_number().over(w).alias("session_idx"),
        F.lead("session").over(w).alias("next_session"),
        F.lag("session").over(w).alias("prev_session"),
    )


def session_dates(df: DataFrame, date_col: str = "trade_date") -> DataFrame:
    return df.select(F.col(date_col).alias("session")).where(F.col(date_col).isNotNull()).distinct()


def with_session_index(df: DataFrame, calendar: DataFrame, date_col: str = "trade_date") -> DataFrame:
    """Attach ``session_idx`` by a broadcast equi-join on the calendar."""
    idx = calendar.select(F.col("session").alias(date_col), "session_idx")
    return df.join(F.broadcast(idx), date_col)


def shift_to_next_session(df: DataFrame, calendar: DataFrame, date_col: str = "trade_date") -> DataFrame:
    """Re-date rows to the next shared session; rows of the last session drop out."""
    nxt = calendar.where(F.col("next_session").isNotNull()).select(
        F.col("session").alias("_from"), F.col("next_session").alias("_to")
    )
    others = [c for c in df.columns if c != date_col]
    return df.join(F.broadcast(nxt), F.col(date_col) == F.col("_from")).select(
        F.col("_to").alias(date_col), *others
    )


def business_days(bounds: DataFrame) -> DataFrame:
    """Monday-to-Friday dates between ``start`` and ``end`` of a one-row frame."""
    return bounds.select(
        F.explode(F.sequence(F.col("start"), F.col("end"), F.expr("INTERVAL 1 DAY"))).alias("trade_date")
    ).where(F.weekday("trade_date").isin(*BUSINESS_DAYS))


def day_index(calendar: DataFrame) -> DataFrame:
    """Every calendar day from the first to the last session -> index of the first session on or after it."""
    span = calendar.agg(F.min("session").alias("lo"), F.max("session").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day"))
    ahead = W.orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return days.join(
        calendar.select(F.col("session").alias("day"), "session_idx"), "day", "left"
    ).select("day", F.last("session_idx", ignorenulls=True).over(ahead).alias("first_idx"))


def serve_sessions(
    df: DataFrame,
    calendar: DataFrame,
    start: str,
    until: str,
    session_col: str = "trade_date",
    origin: str | None = None,
    max_sessions: int = 0,
) -> DataFrame:
    """One row per session ``t`` with ``start <= t < until`` (open end: last session).

    With ``origin`` and ``max_sessions`` a row serves at most that many sessions
    after the session ``origin``.  Dates are resolved to session indexes through
    broadcast equi-joins on the day index, so no range join is needed and a row is
    only expanded to sessions it really serves.
    """
    index = F.broadcast(day_index(calendar))
    span = F.broadcast(
        calendar.agg(
            F.min("session").alias("_lo"), F.max("session").alias("_hi"), F.max("session_idx").alias("_last")
        )
    )
    kept = df.columns
    out = (
        df.crossJoin(span)
        .where((F.col(start) <= F.col("_hi")) & (F.col(until).isNull() | (F.col(until) > F.col("_lo"))))
        .withColumn("_start", F.greatest(F.col(start), F.col("_lo")))
        .join(index.select(F.col("day").alias("_start"), F.col("first_idx").alias("_a")), "_start")
        .join(index.select(F.col("day").alias("_until_day"), F.col("first_idx").alias("_b")),
              F.col(until) == F.col("_until_day"), "left")
    )
    last = F.coalesce(F.col("_b") - 1, F.col("_last"))
    if origin and max_sessions > 0:
        out = out.join(
            index.select(F.col("day").alias("_origin_day"), F.col("first_idx").alias("_o")),
            F.col(origin) == F.col("_origin_day"),
        )
        last = F.least(last, F.col("_o") + max_sessions)
    out = out.withColumn("_z", last).where("_a <= _z")
    served = out.select(*[c for c in kept if c != session_col], F.explode(F.sequence("_a", "_z")).alias("_idx"))
    named = calendar.select(F.col("session_idx").alias("_idx"), F.col("session").alias(session_col))
    return served.join(F.broadcast(named), "_idx").drop("_idx")
