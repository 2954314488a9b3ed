"""Security-master tables (permanent id, name ranges, distributions, delistings) to contract frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from pitrank import contracts as C
from pitrank.functions.clock import close_time
from pitrank.operators.asof import date_bounds, interval_join
from pitrank.sources.json_feeds import _map

# Share-code and exchange-code lists.
SHARE_CODES = {10: "CS", 11: "CS", 30: "ADR", 31: "ADR"}
EXCHANGE_CODES = {1: "XNYS", 2: "XASE", 3: "XNAS"}
SHARES_UNIT = 1000.0


def named_prices(prices: DataFrame, names: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Daily prices with the ticker in force on each date: equi on permno, date inside [namedt, nameendt].

    Delisted names stay: nothing here looks at whether a security still trades.
    """
    bounds = bounds if bounds is not None else date_bounds(prices, "date")
    ranges = names.select("permno", "namedt", "nameendt", "ticker", "exchcd")
    return interval_join(prices, ranges, ["permno"], "date", "namedt", "nameendt", bounds, unit="YEAR").drop(
        "namedt", "nameendt"
    )


def signed_price_bars(named: DataFrame) -> DataFrame:
    """Daily bars; a negative price is a bid/ask midpoint, kept as its absolute value and flagged."""
    close = F.abs("prc").cast("double")
    bars = named.select(
        F.col("date").alias("trade_date"), "ticker", F.col("openprc").alias("open"), F.col("askhi").alias("high"),
        F.col("bidlo").alias("low"), close.alias("close"), F.col("vol").alias("volume"),
        (close * F.col("vol")).alias("dollar_volume"), close_time("date").alias("as_of"),
        "permno", F.coalesce(F.col("prc") < 0, F.lit(False)).alias("price_is_midpoint"),
    )
    contract = [F.col(f.name).cast(f.dataType).alias(f.name) for f in C.DAILY_BARS]
    return bars.select(*contract, "permno", "price_is_midpoint")


def distribution_actions(dist: DataFrame) -> DataFrame:
    """Splits where a price factor is set (ratio = 1 + factor), else dividends; stamped at declaration."""
    factor = F.when(F.col("facpr") != 0, F.col("facpr"))
    rows = dist.withColumn("ratio", F.lit(1.0) + factor).where(F.col("ratio").isNotNull() | F.col("divamt").isNotNull())
    return rows.select(
        F.col("exdt").alias("ex_date"), F.lit(None).cast("string").alias("ticker"),
        F.when(F.col("ratio") >= 1, "split").when(F.col("ratio").isNotNull(), "reverse_split").otherwise("dividend").alias("action_type"),
        "ratio",
        F.when(F.col("ratio").isNull(), F.col("divamt")).alias("cash_amount"),
        F.lit(None).cast("string").alias("new_ticker"),
        F.coalesce("dclrdt", "exdt").cast("timestamp_ntz").alias("as_of"),
        "permno",
    )


def _between(rows: DataFrame, start, end) -> DataFrame:
    """Rows whose ``ex_date`` lies in the range, both ends included; an end that is None is open."""
    if start is not None:
        rows = rows.where(F.col("ex_date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("ex_date") <= F.lit(end).cast("date"))
    return rows


def ticker_changes(names: DataFrame, start=None, end=None) -> DataFrame:
    """Consecutive name rows of one security whose ticker differs, dated at the newer row's start."""
    w = W.partitionBy("permno").orderBy("namedt")
    moved = names.select(
        F.col("namedt").alias("ex_date"), F.lag("ticker").over(w).alias("ticker"),
        F.row_number().over(w).alias("_n"), F.col("ticker").alias("new_ticker"), "permno",
    ).where((F.col("_n") > 1) & ~F.col("ticker").eqNullSafe(F.col("new_ticker")))
    return _between(moved, start, end).select(
        "ex_date", "ticker", F.lit("ticker_change").alias("action_type"), F.lit(None).cast("double").alias("ratio"),
        F.lit(None).cast("double").alias("cash_amount"), "new_ticker",
        F.col("ex_date").cast("timestamp_ntz").alias("as_of"), "permno",
    )


def delisting_rows(delist: DataFrame) -> DataFrame:
    """Delisting events; the amount column carries the delisting return."""
    return delist.select(
        F.col("dlstdt").alias("ex_date"), F.lit(None).cast("string").alias("ticker"),
        F.lit("delisting").alias("action_type"), F.lit(None).cast("double").alias("ratio"),
        F.col("dlret").cast("double").alias("cash_amount"), F.lit(None).cast("string").alias("new_ticker"),
        F.col("dlstdt").cast("timestamp_ntz").alias("as_of"), "permno",
    )


def security_actions(dist: DataFrame, names: DataFrame, delist: DataFrame, start=None, end=None) -> DataFrame:
    """All three kinds of action in one contract, those of ``start`` to ``end`` by their own date."""
    every = distribution_actions(dist).unionByName(ticker_changes(names)).unionByName(delisting_rows(delist))
    return _between(every, start, end)


def name_history_meta(names: DataFrame, prices: DataFrame) -> DataFrame:
    """Listing metadata from name ranges; market cap from the price row on the range's first day."""
    at_start = prices.select("permno", F.col("date").alias("namedt"), "prc", "shrout")
    rows = names.join(at_start, ["permno", "namedt"], "left").select(
        "ticker", F.col("comnam").alias("name"),
        _map(F.col("shrcd").cast("int"), SHARE_CODES, "OTHER").alias("security_type"),
        _map(F.abs(F.col("exchcd").cast("int")), EXCHANGE_CODES, "OTC").alias("exchange"),
        F.col("namedt").alias("active_from"), F.col("nameendt").alias("active_to"),
        (F.abs("prc") * F.col("shrout") * SHARES_UNIT).alias("market_cap"),
        F.lit(None).cast("double").alias("float_shares"),
        F.lit(None).cast("string").alias("sector"), F.lit(None).cast("string").alias("industry"),
        F.col("namedt").cast("timestamp_ntz").alias("as_of"), "permno",
    )
    contract = [F.col(f.name).cast(f.dataType).alias(f.name) for f in C.TICKER_META]
    return rows.select(*contract, "permno")
