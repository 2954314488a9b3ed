"""Decision-time calculus.  Instants are wall-clock (NTZ); dates are DATE."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PREMARKET_OPEN_MINUTES = 4 * 60
PREMARKET_CUTOFF_MINUTES = 9 * 60 + 25


def _shift(date: Column | str, minutes: int) -> Column:
    date = F.col(date) if isinstance(date, str) else date
    # DATE cast to NTZ is midnight; a day-time interval keeps it NTZ.
    return date.cast("timestamp_ntz") + F.expr(f"INTERVAL '{minutes}' MINUTE") if minutes >= 0 else (
        date.cast("timestamp_ntz") - F.expr(f"INTERVAL '{-minutes}' MINUTE")
    )


def prior_close_time(date: Column | str) -> Column:
    """T1: 16:00 on the calendar day before ``date``."""
    return _shift(date, -8 * 60)


def premarket_time(date: Column | str) -> Column:
    """T2: 09:25 on ``date`` (exclusive for minute bars)."""
    return _shift(date, PREMARKET_CUTOFF_MINUTES)


def premarket_open(date: Column | str) -> Column:
    return _shift(date, PREMARKET_OPEN_MINUTES)


def close_time(date: Column | str) -> Column:
    """16:00 on ``date``."""
    return _shift(date, 16 * 60)


def decision_time(task: str, date: Column | str = "trade_date") -> Column:
    """Decision instant of a feature task; an unknown task is refused.

    ``T1``-family tasks decide at 16:00 on the previous calendar day, which is
    never later than the true prior session's close plus its weekend.
    """
    if task in ("T1", "T1B", "T1B_TFM"):
        return prior_close_time(date)
    if task == "T2":
        return premarket_time(date)
    if task == "close":
        return close_time(date)
    raise ValueError(f"no decision time is registered for task {task!r}")


def first_usable_date(as_of: Column | str, after: Column | str | None = None) -> Column:
    """Earliest date ``t`` whose T1 instant is at or after ``as_of``.

    ``as_of <= t - 8h`` is ``as_of + 8h <= t``: midnight itself still counts, any
    later moment moves to the next day.  ``after`` adds the strict event-date
    rule ``event_date < t``.  Turning the inequality into a date lets as-of
    lookups run on day-grained keys that can be pre-aggregated.
    """
    as_of = F.col(as_of) if isinstance(as_of, str) else as_of
    shifted = as_of + F.expr("INTERVAL '8' HOUR")
    day = F.to_date(shifted)
    usable = F.when(shifted > day.cast("timestamp_ntz"), F.date_add(day, 1)).otherwise(day)
    if after is not None:
        after = F.col(after) if isinstance(after, str) else after
        # greatest() skips nulls; a row without as_of must stay unusable.
        usable = F.when(as_of.isNotNull(), F.greatest(usable, F.date_add(after, 1)))
    return usable


def utc_millis_to_eastern(millis: Column | str) -> Column:
    """Epoch milliseconds (UTC) to New York wall clock, independent of the session zone."""
    name = millis if isinstance(millis, str) else None
    col = F.col(name) if name else millis
    instant = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (col / F.lit(1000)).cast("decimal(18,6)")
    )
    return F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), instant)
