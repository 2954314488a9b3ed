"""Per-venue bars to one consolidated bar per (date, ticker)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitrank.functions.clock import close_time
from pitrank.sources.json_feeds import _map

# Listing exchange to feed, and states that void a session.
EXCHANGE_FEED = {
    "XNAS": "XNAS.ITCH",
    "XNYS": "XNYS.PILLAR",
    "ARCX": "XNYS.PILLAR",
    "XASE": "XASE.PILLAR",
}
BAD_STATES = ("degraded", "pending")


def drop_degraded(bars: DataFrame, conditions: DataFrame) -> DataFrame:
    """Remove every date that any venue reports as degraded or pending.

    The date list is calendar-sized, hence the broadcast.
    """
    bad = conditions.where(F.col("condition").isin(*BAD_STATES)).select("trade_date").distinct()
    return bars.join(F.broadcast(bad), "trade_date", "left_anti")


def listing_snapshot(definitions: DataFrame) -> DataFrame:
    """Feed and type per (month, ticker) from the month's first snapshot.

    An exchange without a known feed keeps the venue that reported it.  Several
    reports of one ticker: the last venue in name order wins.
    """
    feed = F.coalesce(
        F.when(F.col("exchange").isin(*EXCHANGE_FEED), _map(F.col("exchange"), EXCHANGE_FEED, "")), F.col("venue")
    )
    rows = definitions.select(
        F.trunc("snapshot_date", "MM").alias("month"), "ticker", "venue", "snapshot_date",
        feed.alias("listing_venue"), "security_class",
    )
    # Earliest snapshot day of the month, then the greatest venue name.
    order = F.struct(-F.datediff("snapshot_date", F.lit("1970-01-01").cast("date")), F.col("venue"))
    return rows.groupBy("month", "ticker").agg(
        F.max_by(F.struct("listing_venue", "security_class"), order).alias("r")
    ).select("month", "ticker", "r.listing_venue", "r.security_class")


def with_listing(bars: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Carry a month's snapshot over all its days (equi-join on month and ticker)."""
    keyed = bars.withColumn("month", F.trunc("trade_date", "MM"))
    return keyed.join(snapshot, ["month", "ticker"], "left").drop("month")


def merge_venues(bars: DataFrame) -> DataFrame:
    """Volume summed over venues; prices from the listing venue, else from the first venue by name.

    ``bars`` has (trade_date, ticker, venue, open, high, low, close, volume, listing_venue).
    One aggregate, combined map-side.
    """
    away = F.coalesce(F.col("venue") == F.col("listing_venue"), F.lit(False))
    priority = F.struct((~away).cast("int"), F.col("venue"))
    merged = bars.groupBy("trade_date", "ticker").agg(
        F.min_by(F.struct("open", "high", "low", "close"), priority).alias("p"),
        F.sum(F.coalesce("volume", F.lit(0.0))).alias("volume"),
    )
    return merged.select(
        "trade_date", "ticker", "p.open", "p.high", "p.low", "p.close", "volume",
        (F.col("p.close") * F.col("volume")).alias("dollar_volume"), close_time("trade_date").alias("as_of"),
    )
