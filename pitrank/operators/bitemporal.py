"""Which bars are known when.

A bar serves the sessions from its first usable date until a newer bar of the
ticker becomes usable.  As long as bars arrive in date order, one trailing window
per ticker is exact.  A bar that arrives after a newer one breaks that: sessions
before its arrival must not see it, later ones must.  Only for the tickers
concerned the timeline then falls into "epochs", one per arrival that a served row
can notice, and the window partition becomes (ticker, epoch).  An epoch repeats no
more than the bars a trailing frame can reach from its first served row, so its
rows grow with the number of late bars, not with its square.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitrank.functions.clock import first_usable_date

DAWN = dt.date(1, 1, 1)
#: Partitions of bars that are repeated in epochs, in shuffle partitions.
REPEATED = 4


def _with_arrivals(bars: DataFrame) -> DataFrame:
    """``_usable``, and ``_late``: a newer bar of the ticker is usable before this one."""
    # Newest first, so that the frame grows: a frame that shrinks is recomputed for every row.
    following = W.partitionBy("ticker").orderBy(F.desc("trade_date")).rowsBetween(W.unboundedPreceding, -1)
    usable = bars.withColumn("_usable", first_usable_date("as_of", after="trade_date"))
    return usable.withColumn("_late", F.coalesce(F.min("_usable").over(following) < F.col("_usable"), F.lit(False)))


def out_of_order(bars: DataFrame) -> DataFrame:
    """Bars that become usable only after a newer bar of the same ticker."""
    marked = _with_arrivals(bars.select("ticker", "trade_date", "as_of"))
    return marked.where("_late").select("ticker", "trade_date", F.col("_usable").alias("usable"))


def _direction(now: float | None, then: float | None) -> int:
    """Sign of the return between two bars; 0 where there is none."""
    if now is None or then is None or now != now or then != then or then == 0:
        return 0
    change = now / then - 1.0
    return (change > 0) - (change < 0)


def _first_needed(known: list, closes: dict, depth: int) -> int:
    """Position of the oldest known bar that the newest one depends on.

    ``depth`` bars before it, and all of its run of equal direction (with the bar
    that ends the run) where that is longer.
    """
    first, newest = max(0, len(known) - 1 - depth), len(known) - 1
    if first == 0:
        return 0

    def direction(i: int) -> int:
        return _direction(closes[known[i]], closes[known[i - 1]]) if i > 0 else 0

    run = direction(newest)
    start = newest
    while run and start > 0 and direction(start - 1) == run:
        start -= 1
    return max(0, min(first, start - 2))


def ticker_epochs(arrivals: Iterator[tuple], depth: int) -> Iterator[tuple]:
    """Epochs of one ticker: (start, end, oldest and newest bar that it reads).

    ``arrivals``: (usable, trade_date, late, close) in order of ``usable``.  A late bar
    opens an epoch only if it lies within reach of the newest bar known on its arrival;
    any other is never read by a served row.
    """
    known, closes = [], {}
    start, oldest = DAWN, dt.date.max
    opened = False
    pending = list(arrivals)
    i = 0
    while i < len(pending):
        j = i
        before = known[-1] if known else None
        while j < len(pending) and pending[j][0] == pending[i][0]:
            insort(known, pending[j][1])
            closes[pending[j][1]] = pending[j][3]
            j += 1
        late = [day for _, day, is_late, _ in pending[i:j] if is_late]
        if not opened:
            oldest = min(oldest, known[0])
        if late:
            first = _first_needed(known, closes, depth)
            if bisect_left(known, max(late)) >= first:
                yield start, pending[i][0], oldest, before
                start, oldest, opened = pending[i][0], known[first], True
        i = j
    if known:
        yield start, None, oldest, known[-1]


def known_bars(bars: DataFrame, ordered: bool | None = None, depth: int = 0,
               runs: str | None = None) -> tuple[DataFrame, list[str]]:
    """Bars with ``_from`` / ``_epoch_end`` and the partition keys for their windows.

    ``ordered=True`` asserts date-ordered arrival (no check); ``None`` checks.
    ``depth``: rows before a bar that the caller's widest frame reads.  ``runs``: a
    price column whose run of equal direction is read too, however long it is.
    """
    if ordered is None:
        ordered = out_of_order(bars).isEmpty()
    if ordered:
        usable = first_usable_date("as_of", after="trade_date")
        return bars.withColumn("_from", usable).withColumn("_epoch_end", F.lit(None).cast("date")), ["ticker"]
    # Everything stays with its ticker from here on, repeated bars too, so only the bars themselves move.  A number of
    # partitions is given, for one chosen by the size before the repetition would make them too large.
    spread = REPEATED * int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = _with_arrivals(bars.repartition(spread, "ticker")).withColumn("_mixed", F.max("_late").over(W.partitionBy("ticker")))
    price = F.col(runs).cast("double") if runs else F.lit(None).cast("double")

    def epochs_of(key: tuple, arrivals: pd.DataFrame) -> pd.DataFrame:
        # One ticker's dates: at most one row per calendar day.
        ranked = arrivals.sort_values(["_usable", "trade_date"])
        rows = ticker_epochs(zip(ranked["_usable"], ranked["trade_date"], ranked["_late"], ranked["price"]), depth)
        return pd.DataFrame([(*key, *r) for r in rows], columns=["ticker", "_epoch", "_epoch_end", "_oldest", "_newest"])

    epochs = (
        marked.where("_mixed and _usable is not null")
        .select("ticker", "_usable", "trade_date", "_late", price.alias("price"))
        .groupBy("ticker")
        .applyInPandas(epochs_of, "ticker string, _epoch date, _epoch_end date, _oldest date, _newest date")
        .groupBy("ticker").agg(F.collect_list(F.struct("_epoch", "_epoch_end", "_oldest", "_newest")).alias("_epochs"))
    )
    usable = F.col("_usable")

    def reads(e: Column) -> Column:
        known = (e["_epoch_end"].isNull() | (usable < e["_epoch_end"])) & (~F.col("_late") | (usable <= e["_epoch"]))
        return usable.isNotNull() & F.col("trade_date").between(e["_oldest"], e["_newest"]) & known

    never = F.lit(None).cast("date")
    # A ticker in order: one epoch without an end.
    whole = F.array(F.struct(F.lit("0001-01-01").cast("date").alias("_epoch"), never.alias("_epoch_end"), never.alias("_oldest"), never.alias("_newest")))
    placed = marked.join(epochs, "ticker", "left").withColumn("_e", F.explode(F.when(F.col("_mixed"), F.filter("_epochs", reads)).otherwise(whole)))
    return placed.select(
        *bars.columns, F.col("_e._epoch").alias("_epoch"), F.when(usable.isNotNull(), F.greatest(usable, F.col("_e._epoch"))).alias("_from"),
        F.col("_e._epoch_end").alias("_epoch_end"),
    ), ["ticker", "_epoch"]
