"""Late bars: every session sees exactly what had arrived, at a cost that grows with the late bars only."""

import datetime as dt
import random

from pitrank.operators import features_t1 as t1
from pitrank.operators.bitemporal import known_bars, ticker_epochs
from tests.frames import at, bars, weekdays

DAYS = weekdays("2019-01-01", 700)


def _marked(arrivals):
    """(usable, day, late, close) in order of arrival."""
    late = lambda u, d: any(u2 < u for u2, d2, _ in arrivals if d2 > d)
    return sorted((u, d, late(u, d), c) for u, d, c in arrivals)


def _read(arrivals, depth):
    """Per session the bars that the epochs give to the newest known bar, and those really known."""
    marked = _marked(arrivals)
    epochs = list(ticker_epochs(marked, depth))
    for session in sorted({u for u, _, _, _ in marked}):
        start, end, oldest, newest = [e for e in epochs if e[0] <= session and (e[1] is None or session < e[1])][0]
        rows = {d: c for u, d, late, c in marked
                if oldest <= d <= newest and (end is None or u < end) and (not late or u <= start)}
        known = {d: c for u, d, _, c in marked if u <= session}
        anchor = max(known)
        yield [(d, c) for d, c in sorted(rows.items()) if d <= anchor], sorted(known.items())


def _streak(rows):
    closes = [c for _, c in rows]
    signs = [(b > a) - (b < a) for a, b in zip(closes, closes[1:])]
    length = 0
    for s in reversed(signs):
        if not signs[-1] or s != signs[-1]:
            break
        length += 1
    return length * (signs[-1] if signs else 0)


def test_epochs_hold_what_a_frame_reads():
    rng = random.Random(5)
    for trial in range(60):
        depth = rng.choice([2, 3, 6])
        days = DAYS[: rng.randrange(2, 40)]
        drift = rng.choice([0.0, 1.0, 1.0])
        arrivals, price = [], 50.0
        for d in days:
            price += drift if drift and rng.random() < 0.9 else rng.choice([-1.0, 0.0, 1.0])
            delay = rng.choice([0, 0, 0, 1, 4, 15]) if trial % 3 else rng.randrange(0, 40)
            arrivals.append((d + dt.timedelta(days=1 + delay), d, price))
        for rows, known in _read(arrivals, depth):
            assert rows[-depth - 1:] == known[-depth - 1:]
            assert _streak(rows) == _streak(known)


def test_backfills_in_either_direction_repeat_no_more_than_the_frame():
    newest = DAYS[600]
    for order in (list(range(600)), list(reversed(range(600)))):
        arrivals = [(newest + dt.timedelta(days=1), newest, 1.0)]
        arrivals += [(newest + dt.timedelta(days=2 + i), DAYS[j], float(j % 7)) for i, j in enumerate(order)]
        marked = _marked(arrivals)
        read = sum(
            sum(oldest <= d <= last and (end is None or u < end) and (not late or u <= start) for u, d, late, _ in marked)
            for start, end, oldest, last in ticker_epochs(marked, 20)
        )
        # 21 bars of the frame and a run that reaches past it, for each of 600 arrivals.
        assert read <= 600 * 30


def test_rows_grow_with_late_bars_not_with_their_square(spark):
    def frame(every):
        data = []
        for i, d in enumerate(DAYS):
            late = i % every == 0 and i < 650
            data.append((d, "A", 10.0 + (i * 37) % 11, 1e6, at(DAYS[i + 12] if late else d)))
        return bars(spark, data)

    few, many = (known_bars(frame(n), depth=20)[0].count() - len(DAYS) for n in (40, 20))
    assert 0 < few and many <= 2.2 * few
    # an arrival repeats the frame, not the history
    assert few <= 17 * (20 + 2)


def test_a_run_longer_than_every_frame_is_kept(spark):
    data = [(d, "A", 10.0 + i) for i, d in enumerate(DAYS[:330])]
    data[320] = (DAYS[320], "A", 330.0, 1e6, at(DAYS[323]))
    served = t1.served_bar_features(bars(spark, data))
    got = {r["_from"]: (r.trade_date, r.consecutive_streak) for r in served.collect()}
    assert got[DAYS[323] + dt.timedelta(days=1)] == (DAYS[323], 323.0)
    assert [r.consecutive_streak for r in served.where(f"trade_date = date'{DAYS[329]}'").collect()] == [329.0]


def test_bars_without_a_stamp_and_tickers_in_order_beside_late_ones(spark):
    data = [(d, t, 10.0 + i) for i, d in enumerate(DAYS[:9]) for t in ("A", "B")]
    data[8] = (DAYS[4], "A", 99.0, 1e6, at(DAYS[7]))
    data[10] = (DAYS[5], "A", 7.0, 1e6, None)
    known, keys = known_bars(bars(spark, data), depth=3)
    assert keys == ["ticker", "_epoch"]
    assert known.where("ticker = 'B'").count() == 9
    assert known.where(f"ticker = 'A' and trade_date = date'{DAYS[5]}'").isEmpty()


def test_repeated_bars_and_served_features_stay_with_their_tickers(spark):
    from pitrank.operators import calendar as cal

    rng = random.Random(3)
    data = []
    for i, d in enumerate(DAYS[:90]):
        for t in ("A", "B", "C"):
            late = t != "C" and rng.random() < 0.2
            if rng.random() < 0.9:
                data.append((d, t, float(rng.randrange(5, 30)), 1e6, at(DAYS[i + rng.randrange(1, 9)] if late else d)))
    frame = bars(spark, data)
    names = ("ret_1d", "rvol_20d", "dist_from_52w_high", "consecutive_streak")
    got = t1.bar_features_on(frame, frame, names)
    # Neither the repeated bars nor the features are dealt anew: every exchange is by ticker alone.
    assert "_epoch" not in "".join(line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hash" in line)
    served = cal.serve_sessions(t1.served_bar_features(frame).select("ticker", "_from", "_until", *names), cal.sessions(frame), "_from", "_until")
    want = served.join(frame.select("trade_date", "ticker"), ["trade_date", "ticker"], "left_semi").select("trade_date", "ticker", *names)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
