"""Trailing-window building blocks with pandas-style minimum periods.

All frames of one feature builder share the same partition and order, so the
planner evaluates them in one sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F


def timeline(partition: Sequence[str] | str = "ticker", order: str = "trade_date") -> WindowSpec:
    keys = [partition] if isinstance(partition, str) else list(partition)
    return W.partitionBy(*keys).orderBy(order)


def trailing(w: WindowSpec, rows: int, end: int = 0) -> WindowSpec:
    """The ``rows`` rows that end ``end`` rows away from the current one."""
    return w.rowsBetween(end - rows + 1, end)


def rolling_std(x: Column, w: WindowSpec, rows: int, min_periods: int | None = None, end: int = 0) -> Column:
    need = rows if min_periods is None else min_periods
    frame = trailing(w, rows, end)
    return F.when(F.count(x).over(frame) >= max(need, 2), F.stddev_samp(x).over(frame))


def rolling_mean(x: Column, w: WindowSpec, rows: int, min_periods: int | None = None, end: int = 0) -> Column:
    need = rows if min_periods is None else min_periods
    frame = trailing(w, rows, end)
    return F.when(F.count(x).over(frame) >= need, F.avg(x).over(frame))


def rolling_max(x: Column, w: WindowSpec, rows: int, min_periods: int = 1, end: int = 0) -> Column:
    frame = trailing(w, rows, end)
    return F.when(F.count(x).over(frame) >= min_periods, F.max(x).over(frame))


def rolling_sum(x: Column, w: WindowSpec, rows: int, min_periods: int = 1, end: int = 0) -> Column:
    frame = trailing(w, rows, end)
    return F.when(F.count(x).over(frame) >= min_periods, F.sum(x).over(frame))


def with_extremes(df: DataFrame, w: WindowSpec, rows: int, outs: dict[str, tuple[str, Callable[..., Column]]]) -> DataFrame:
    """Add extremes of the last ``rows`` rows: ``outs`` names a column's value and ``F.greatest`` or ``F.least``.

    Four overlapping spans make a span up to four times as long, so a frame costs a few lags a row and not a
    comparison with each of its rows.  Nulls are skipped, as ``max`` and ``min`` do.
    """
    held, span = {out: F.col(value) for out, (value, _) in outs.items()}, 1
    while span < rows:
        wide = min(span * 4, rows)
        # The last span ends where the frame does; where it overlaps the one before, nothing changes.
        steps = [*range(span, wide - span, span), wide - span]
        df = df.withColumns({out: pick(held[out], *[F.lag(held[out], n).over(w) for n in steps]) for out, (_, pick) in outs.items()})
        held, span = {out: F.col(out) for out in outs}, wide
    return df if rows > 1 else df.withColumns(held)


def running_total(x: Column, w: WindowSpec) -> Column:
    """Sum of all rows up to the current one, nulls as zero: differences of it are sums of whole numbers over any frame."""
    return F.sum(F.coalesce(x, F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))


def signed_streak(ret: str, w: WindowSpec) -> tuple[Column, Column]:
    """Two stages of the signed run length.

    First column: row number at which the current run began (evaluate first,
    name it ``_run_start``).  Second: the signed length, zero when the latest
    return is zero or missing.
    """
    r = F.col(ret)
    sign = F.signum(r)
    began = ~F.coalesce(sign == F.lag(sign).over(w), F.lit(False))
    run_start = F.when(began, F.row_number().over(w))
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    length = F.row_number().over(w) - F.last("_run_start", ignorenulls=True).over(upto) + 1
    streak = F.when(r.isNull() | (r == 0), F.lit(0.0)).otherwise(sign * length)
    return run_start, streak
