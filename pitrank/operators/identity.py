"""Point-in-time symbol and instrument identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def resolve_symbols(records: DataFrame, mapping: DataFrame, keys: Sequence[str] = ("trade_date", "venue", "instrument_id")) -> DataFrame:
    """Ticker of each record for exactly its day and venue; ids are reused, so never by id alone.

    A day that maps one id to several symbols is corrupt and stops the query;
    unresolved records drop out.
    """
    daily = mapping.groupBy(*keys).agg(
        F.min("ticker").alias("ticker"), F.max("ticker").alias("_other")
    )
    checked = daily.select(
        *keys,
        F.when(
            F.col("ticker") != F.col("_other"), F.raise_error(F.lit("instrument id maps to several symbols within one day"))
        ).otherwise(F.col("ticker")).alias("ticker"),
    )
    return records.join(checked, list(keys))


def align_identity(rows: DataFrame, mapping: DataFrame, ticker: str = "ticker", at: str = "ex_date") -> DataFrame:
    """Attach ``instrument_id`` resolved at each row's own date; unresolved or ambiguous rows stay with null."""
    daily = mapping.groupBy(F.col("ticker").alias(ticker), F.col("trade_date").alias(at)).agg(
        F.min("instrument_id").alias("_lo"), F.max("instrument_id").alias("_hi")
    ).select(ticker, at, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("instrument_id"))
    return rows.join(daily, [ticker, at], "left").select(*rows.columns, "instrument_id")


def alignment_report(aligned: DataFrame, ticker: str = "ticker") -> DataFrame:
    """One row: rows, aligned rows, distinct unaligned tickers (the names are ``unaligned_tickers``)."""
    missing = F.when(F.col("instrument_id").isNull(), F.col(ticker))
    return aligned.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count("instrument_id").alias("aligned_rows"),
        F.count_distinct(missing).alias("unaligned_ticker_count"),
    )


def unaligned_tickers(aligned: DataFrame, ticker: str = "ticker") -> DataFrame:
    return aligned.where(F.col("instrument_id").isNull() & F.col(ticker).isNotNull()).select(ticker).distinct()
