import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from pitrank.functions.hashing import uniform_key
from pitrank.operators import features_t1 as t1
from pitrank.operators import ranks
from pitrank.operators.calendar import sessions, shift_to_next_session
from tests.frames import D, bars, rows, weekdays


@pytest.fixture(scope="module")
def section(spark):
    rng = np.random.default_rng(3)
    data = []
    for day in weekdays("2021-03-01", 3):
        for i in range(80):
            v = None if i % 11 == 0 else float(rng.integers(0, 25))
            data.append((day, f"N{i:03d}", v))
    # a value shared by a third of one day
    data += [(D("2021-03-01"), f"H{i:03d}", 7.0) for i in range(60)]
    return spark.createDataFrame(data, "trade_date date, ticker string, v double")


@pytest.mark.parametrize("grain", [0.001, 1, 64])
def test_ranks_match_pandas_however_finely_sliced(section, grain):
    pdf = section.toPandas()
    days = pdf.groupby("trade_date")["v"]
    want = pdf.assign(pct=days.rank(pct=True), low=days.rank(method="min", ascending=False)).set_index(["trade_date", "ticker"])
    got = ranks.add_pct_rank(section, ["trade_date"], "v", "pct", grain=grain).toPandas().set_index(["trade_date", "ticker"])
    pd.testing.assert_series_equal(got["pct"].reindex(want.index), want["pct"])
    got = ranks.add_min_rank_desc(section, ["trade_date"], "v", "low", grain=grain).toPandas().set_index(["trade_date", "ticker"])
    pd.testing.assert_series_equal(got["low"].reindex(want.index), want["low"])


def test_slices_never_fall(spark):
    values = [float("-inf"), -1e300, -2.5, -1e-12, -0.0, 0.0, 1e-300, 0.3, 1e9, 1e300, float("inf"), float("nan"), None]
    got = [r.s for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", ranks.slice_of("v").alias("s")).orderBy("i").collect()]
    assert got == sorted(got) and got[4] == got[5]


def test_positions_of_a_hash(section):
    keyed = section.withColumn("h", uniform_key(1, "trade_date", "ticker"))
    got = ranks.positions(keyed, ["trade_date"], "h", ["ticker"], "p").toPandas()
    want = keyed.toPandas().sort_values(["trade_date", "h", "ticker"])
    want["p"] = want.groupby("trade_date").cumcount() + 1
    key = ["trade_date", "ticker"]
    pd.testing.assert_series_equal(got.set_index(key)["p"].sort_index(), want.set_index(key)["p"].sort_index(), check_dtype=False)


def test_top_k_group_limit_in_plan(section):
    plan = ranks.top_k(section.withColumnRenamed("v", "score"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_next_session_skips_weekends(spark):
    days = weekdays("2021-03-04", 3)
    b = bars(spark, [(d, "A", 1.0) for d in days])
    moved = shift_to_next_session(b.select("trade_date", "ticker"), sessions(b))
    assert [r[0] for r in rows(moved, "trade_date")] == days[1:]


def _naive(closes, volumes):
    out = {}
    c, v = np.array(closes), np.array(volumes)
    n = len(c)
    r = c[1:] / c[:-1] - 1
    out["ret_1d"] = r[-1] if n >= 2 else None
    out["rvol_5d"] = np.std(r[-5:], ddof=1) if len(r) >= 5 else None
    roll = pd.Series(r).rolling(5).std().dropna()
    out["vol_of_vol"] = roll.tail(10).std() if len(r) >= 14 else None
    out["rel_volume_5d_trend"] = None
    if n >= 24:
        y = [v[n - o - 1] / v[n - o - 20:n - o].mean() for o in range(5)][::-1]
        out["rel_volume_5d_trend"] = np.polyfit(range(5), y, 1)[0]
    out["dist_from_52w_high"] = c[-1] / c[-252:].max() - 1
    streak = 0.0
    for x in r[::-1]:
        s = np.sign(x)
        if s == 0 or (streak and np.sign(streak) != s):
            break
        streak += s
    out["consecutive_streak"] = streak if n >= 2 else 0.0
    return out


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(5, 9), st.integers(1, 50)), min_size=1, max_size=40), st.integers(1, 5))
def test_bar_features_equal_per_day_recomputation(spark, series, parts):
    days = weekdays("2021-01-04", len(series))
    data = [(d, "A", float(c), float(v)) for d, (c, v) in zip(days, series)]
    got = {r.trade_date: r for r in t1.bar_features(bars(spark, data[::-1]).repartition(parts)).collect()}
    for i, day in enumerate(days):
        want = _naive([c for c, _ in series[: i + 1]], [v for _, v in series[: i + 1]])
        for name, value in want.items():
            have = got[day][name]
            if value is None:
                assert have is None, (name, day)
            else:
                assert have == pytest.approx(value, abs=1e-9), (name, day)


def test_many_ranks_read_their_input_twice(spark):
    wide = spark.range(200).select(F.lit(1).alias("g"), *[((F.col("id") * k) % 17).cast("double").alias(f"v{k}") for k in range(1, 6)], "id")
    ranked = ranks.add_pct_ranks(wide, ["g"], {f"v{k}": f"p{k}" for k in range(1, 6)})
    assert ranked._jdf.queryExecution().optimizedPlan().toString().count("Range (") <= 2
    got = ranked.toPandas().sort_values("id")
    for k in range(1, 6):
        want = got[f"v{k}"].rank(pct=True)
        np.testing.assert_allclose(got[f"p{k}"], want)


def test_least_squares_from_one_aggregate(spark):
    from pitrank.operators import moments

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    x = np.column_stack([x, x[:, 0] * 2 - x[:, 1]])  # the last one is explained by the others
    y = x[:, 0] - 3 * x[:, 2] + rng.normal(size=300)
    names = ["a", "b", "c", "d", "y"]
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=names))
    one = moments.co_moments(df, names).first()
    cov = [[one[f"c{max(i, j)}_{min(i, j)}"] for j in range(5)] for i in range(5)]
    w = moments.solved_weights(cov)
    fitted = np.linalg.lstsq(np.column_stack([x[:, :3], np.ones(300)]), y, rcond=None)[0]
    np.testing.assert_allclose(w, [*fitted[:3], 0.0], atol=1e-9)
    share = moments.with_cholesky(moments.co_moments(df, names), 4, 1).select(moments.unexplained_share(4, 4).alias("s")).first().s
    left = y - np.column_stack([x[:, :3], np.ones(300)]) @ fitted
    assert share == pytest.approx(left.var() / y.var())


def test_ranks_of_a_cross_section_share_one_read_and_one_shuffle(section):
    wide = section.withColumn("u", -F.col("v"))
    ranked = ranks.add_pct_ranks(wide.repartition(3), ["trade_date"], {"v": "pv", "u": "pu"})
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Union" not in plan
