"""Rows move no more often than the result needs, and the result stays the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitrank import contracts as C
from pitrank.operators import features_bars as fb
from pitrank.operators import features_t1 as t1
from pitrank.operators import redundancy as rd
from pitrank.operators import universe as uni
from pitrank.operators.calendar import sessions
from pitrank.operators.rolling import rolling_max, timeline, with_extremes
from pitrank.plans import catalog as P
from tests.frames import actions, at, bars, meta, rows, weekdays

KEYS = ("trade_date", "ticker")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def daily(spark):
    rng = np.random.default_rng(11)
    data = [(d, f"N{i:02d}", float(rng.integers(1, 40)), float(rng.integers(1, 9))) for d in weekdays("2021-01-04", 130) for i in range(14) if rng.random() < 0.9]
    return bars(spark, data)


@pytest.mark.parametrize("width", [1, 2, 3, 5, 17, 100])
def test_extremes_of_spans_equal_frames(daily, width):
    w = timeline()
    some = daily.withColumn("close", F.when(F.col("close") % 7 != 0, F.col("close")))
    got = with_extremes(some, w, width, {"high": ("close", F.greatest), "low": ("close", F.least)})
    got = got.withColumn("want", rolling_max(F.col("close"), w, width)).withColumn("lowest", -rolling_max(-F.col("close"), w, width))
    assert got.where("not (high <=> want) or not (low <=> lowest)").isEmpty()


def test_labels_without_ranks_are_the_same_and_rows_stay_with_their_tickers(daily):
    whole, narrow = fb.bars_universe(daily, k=3), fb.bars_universe(daily, k=3, ranked=False)
    assert rows(whole.select(*narrow.columns), *KEYS) == rows(narrow, *KEYS)
    kept = ("ret", "rank", "label")
    assert rows(fb.build_bars_features(whole, kept), *KEYS) == rows(fb.build_bars_features(narrow, kept), *KEYS)


def test_warm_rows_rank_nothing(daily):
    universe = fb.bars_universe(daily, ranked=False)
    want = fb.drop_warmup(fb.build_bars_features(universe)).select(*KEYS, "as_of")
    got = fb.warm_rows(universe)
    assert rows(got, *KEYS) == rows(want, *KEYS) != []
    assert "rank(" not in plan(got)


def test_carried_quantiles_equal_joined_ones(daily):
    universe = fb.bars_universe(daily, ranked=False)
    carried = fb.build_bars_forecast_features(fb.build_bars_features(P.with_forecast(universe), keep=("q10", "q50", "q90")), None)
    joined = fb.build_bars_forecast_features(fb.build_bars_features(universe), P.forecast_quantiles(universe))
    assert carried.columns == list(C.T1B_TFM_COLUMNS)
    assert rows(carried, *KEYS) == rows(joined, *KEYS)


def test_figures_of_a_day_come_from_one_move(daily):
    features = daily.select("trade_date", F.col("close").alias("anchor"), F.col("volume").alias("a"), (F.col("close") * -1).alias("b"))
    rho = rd.daily_spearman(features, ("a", "b"), "anchor")
    assert plan(rho).count("Exchange hashpartitioning") == 1
    pdf = daily.toPandas()
    want = pdf.groupby("trade_date").apply(lambda d: d["close"].rank().corr(d["volume"].rank()))
    got = rho.where("feature = 'a'").toPandas().set_index("trade_date")["spearman"]
    np.testing.assert_allclose(got.sort_index().to_numpy(), want.to_numpy())
    assert rho.where("feature = 'b' and abs(spearman + 1) > 1e-12").isEmpty()


def test_labels_straight_from_bars_equal_those_of_the_universe(spark):
    days = weekdays("2021-01-04", 40)
    rng = np.random.default_rng(5)
    data = []
    for i in range(9):
        for n, d in enumerate(days):
            if rng.random() < 0.6:
                # One name reports two days late, in date order: its newest bar is not yet known.
                stamp = at(days[min(n + 2, 39)]) if i == 0 else at(d)
                data.append((d, f"N{i}", float(rng.integers(1, 9)), 1e6, stamp))
    frame, names = bars(spark, data), meta(spark, [{"ticker": f"N{i}"} for i in range(8)])
    split = actions(spark, [(days[20], "N3", "split", 2.0, at(days[10]))])
    calendar = sessions(frame)
    how = dict(min_close=2.0, min_dollar_volume=1.0, max_staleness=3)
    want = uni.build_labels(uni.build_universe(frame, names, calendar=calendar, ordered=True, **how), frame, split, k=2)
    candidates = uni.rankable_bars(frame, names, split, calendar=calendar, **how)
    assert rows(uni.labels_of(candidates, k=2), *KEYS) == rows(want, *KEYS) != []
    assert rows(uni.labels_of(candidates, k=2, positives=True), *KEYS) == rows(want.where("label = 1"), *KEYS)


def test_wide_price_frames_are_not_scanned_row_by_row(daily):
    text = plan(t1.bar_features(daily))
    assert "max(close" not in text and "min(close" not in text


def test_streams_of_a_ticker_meet_where_its_bars_lie(spark, daily):
    calendar = sessions(daily)
    plans = plan(t1.rank_stream(daily, calendar, True))
    moved = [line for line in plans.splitlines() if "Exchange hashpartitioning" in line]
    # Returns go to their weeks before they are laid out over sessions; no exchange by date follows.
    assert any("hashpartitioning(_week" in line for line in moved) and not any("(trade_date" in line for line in moved)
    earnings = spark.createDataFrame([("N01", weekdays("2021-02-01", 40)[i], at(weekdays("2021-01-04", 20)[i]), False) for i in range(20)],
                                     "ticker string, report_date date, as_of timestamp_ntz, date_is_revisable boolean")
    reports = plan(t1.report_stream(earnings, calendar))
    assert len([line for line in reports.splitlines() if "Exchange hashpartitioning(ticker" in line]) == 1
    assert "hashpartitioning(ticker#" in reports and "report_date" not in "".join(l for l in reports.splitlines() if "Exchange hash" in l)


def test_ranks_by_weeks_equal_ranks_by_sessions(daily):
    calendar = sessions(daily)
    # A ticker that stops early serves every later session; one bar serves several weeks.
    some = daily.where("ticker <> 'N03' or trade_date < date'2021-02-10'")
    got = t1.rank_stream(some, calendar, True).select("ticker", "day", F.explode("placed").alias("trade_date", "position"))
    live = t1.served_bar_features(some, True).where("ret_1d is not null").select("ticker", F.col("_from").alias("day"), "_from", "_until", "ret_1d")
    from pitrank.operators.calendar import serve_sessions
    from pitrank.operators.ranks import add_min_rank_desc
    want = add_min_rank_desc(serve_sessions(live, calendar, "_from", "_until").drop("_from", "_until"), ["trade_date"], "ret_1d", "position")
    want = want.select("ticker", "day", "trade_date", F.col("position").cast("int").alias("position"))
    assert rows(got, *KEYS) == rows(want, *KEYS) != []
