"""Small frames in contract shape."""

from __future__ import annotations

import datetime as dt

from pitrank import contracts as C


def D(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def T(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def weekdays(start: str, n: int) -> list[dt.date]:
    out, day = [], D(start)
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += dt.timedelta(days=1)
    return out


def at(day: dt.date, hour: int = 16) -> dt.datetime:
    return dt.datetime.combine(day, dt.time(hour))


def bars(spark, rows):
    """rows: (date, ticker, close[, volume[, as_of]])"""
    full = []
    for r in rows:
        day, ticker, close = r[:3]
        volume = r[3] if len(r) > 3 else 1e6
        stamp = r[4] if len(r) > 4 else at(day)
        full.append((day, ticker, close, close, close, close, float(volume), float(close * volume), stamp))
    return spark.createDataFrame(full, C.DAILY_BARS)


def meta(spark, rows):
    """rows: dicts over listing defaults"""
    base = dict(ticker="A", name="n", security_type="CS", exchange="XNYS", active_from=D("2015-01-01"), active_to=None,
                market_cap=1e9, float_shares=1e8, sector="Technology", industry="Software", as_of=T("2015-01-01"))
    return spark.createDataFrame([tuple({**base, **r}[f] for f in C.TICKER_META.fieldNames()) for r in rows], C.TICKER_META)


def actions(spark, rows=()):
    return spark.createDataFrame(
        [(d, t, kind, ratio, None, None, stamp) for d, t, kind, ratio, stamp in rows], C.CORPORATE_ACTIONS)


def labels(spark, rows):
    """rows: (date, ticker, rank, ret, label[, as_of])"""
    return spark.createDataFrame(
        [(r[0], r[1], r[2], r[3], r[4], "v1", r[5] if len(r) > 5 else at(r[0])) for r in rows], C.LABELS)


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
