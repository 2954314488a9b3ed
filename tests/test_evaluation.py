import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitrank import contracts as C
from pitrank.functions.scalars import normal_two_sided, student_t_two_sided
from pitrank.operators import baselines as bl, metrics as mt, monitor as mon, overlap as ov, sampling as sp
from pitrank.operators import ranker as rk, significance as sg, survivorship as sv, walkforward as wf
from pitrank.plans.registry import QUERIES
from pitrank.session import scratch_path
from tests.frames import D, at, bars, labels, rows, weekdays

DAYS = weekdays("2021-03-01", 3)


def _preds(spark, data):
    return spark.createDataFrame(data, C.PREDICTIONS)


def test_average_precision_by_hand(spark):
    lab = labels(spark, [(DAYS[0], t, None, 0.0, y) for t, y in (("A", 1), ("B", 0), ("C", 1), ("D", 1))])
    p = _preds(spark, [(DAYS[0], "A", 4.0), (DAYS[0], "B", 3.0), (DAYS[0], "C", 2.0), (DAYS[0], "X", 1.0)])
    d = mt.daily_scores(p, lab, k=3).first()
    assert d.hits == 2 and d.precision == pytest.approx(2 / 3)
    assert d.average_precision == pytest.approx((1 + 2 / 3) / 3)
    assert mt.map_at_k(p.withColumn("trade_date", F.lit(DAYS[1])), lab).first().map is None


def test_ties_break_by_ticker(spark):
    p = _preds(spark, [(DAYS[0], t, 1.0) for t in "DCBA"])
    assert [r.ticker for r in mt.scored_top_k(p, labels(spark, [(DAYS[0], "A", 1, 0.1, 1)]), 2).orderBy("pos").collect()] == ["A", "B"]


def test_pinned_distributions():
    assert student_t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert student_t_two_sided(-4.5, 3) == pytest.approx(0.02050, abs=1e-4)
    assert normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-8)


def test_paired_tests(spark):
    df = spark.createDataFrame([(a, b) for a, b in ((3, 1), (2, 2), (4, 1), (0, 1), (5, 2), (2, 2))], "model_hits int, baseline_hits int")
    t = sg.paired_t_test(df).first()
    assert t.n == 6 and t.statistic == pytest.approx((7 / 6) / ((89 / 30) ** 0.5 / 6**0.5))
    w = sg.wilcoxon_pratt(df).first()
    # |d| ranks with zeros first: zeros 1.5 each, 1 -> 3, 2 -> 4, 3 -> 5.5 twice; W- = 3.
    assert w.statistic == 3.0 and 0 < w.p_value < 1
    same = sg.wilcoxon_pratt(df.select("model_hits", F.col("model_hits").alias("baseline_hits"))).first()
    assert (same.p_value) == 1.0
    assert sg.paired_t_test(df.limit(1)).first().statistic is None


def test_holm(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "variant string, p_value double")
    got = {r.variant: r.p_adjusted for r in sg.holm(p).collect()}
    assert got == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})


def test_baselines(spark):
    days = weekdays("2021-03-01", 9)
    lab = labels(spark, [(d, t, i + 1, 0.1, int(i < 2)) for d in days for i, t in enumerate("ABC")])
    b1 = rows(bl.yesterday_repeat(lab), "trade_date", "ticker")
    assert b1[0] == (days[1], "A", 2.0) and b1[1] == (days[1], "B", 1.0) and len(b1) == 16
    b = bars(spark, [(d, t, 10.0 + (i % 2) * s) for i, d in enumerate(days) for t, s in (("CALM", 0.1), ("WILD", 3.0))])
    b2 = bl.realised_vol(b, k=1)
    assert {r.ticker for r in b2.collect()} == {"WILD"} and min(r.trade_date for r in b2.collect()) == days[6]
    u = lab.select("trade_date", "ticker", F.expr("cast(trade_date as timestamp_ntz) - interval 8 hours").alias("as_of"))
    assert rows(bl.random_pick(u, 1, 2), "trade_date", "ticker") == rows(bl.random_pick(u.repartition(5), 1, 2), "trade_date", "ticker")
    with pytest.raises(Exception, match="not knowable"):
        bl.random_pick(lab.select("trade_date", "ticker", "as_of")).collect()


def test_expanding_splits_and_seal(spark):
    dates = spark.createDataFrame([(D(f"{y}-{m:02d}-15"),) for y in range(2018, 2024) for m in (1, 5, 9)], "trade_date date")
    yearly = wf.collect_splits(wf.expanding_splits(dates.where("trade_date < date'2023-01-01'")))
    assert [s.test_start.year for s in yearly] == [2020, 2021, 2022]
    assert all(s.train_end < s.test_start and s.train_start == D("2018-01-15") for s in yearly)
    assert wf.expanding_splits(dates.where("trade_date < date'2023-01-01'"), "quarterly").count() == 9
    with pytest.raises(C.LeakageError):
        wf.collect_splits(wf.expanding_splits(dates))
    with pytest.raises(ValueError):
        wf.Split(D("2020-01-01"), D("2021-01-01"), D("2021-01-01"), D("2021-06-01"))


def test_gate_verdicts(spark):
    lab = labels(spark, [(D(f"{y}-03-01"), "A", 1, 0.1, 1) for y in range(2015, 2022)])
    good = lab.select("trade_date", "ticker", F.lit(1.0).alias("score"))
    poor = good.withColumn("ticker", F.lit("Z"))
    assert wf.baseline_gate(good, poor, lab).first().verdict == "pass"
    assert wf.baseline_gate(poor, good, lab).first().verdict == "fail"
    assert wf.baseline_gate(good, poor, lab.where("trade_date < date'2018-01-01'"), min_years=8).first().verdict == "undecidable"


def _hits(spark, live, base=5):
    days = weekdays("2021-01-04", len(live))
    return spark.createDataFrame([(d, h, base) for d, h in zip(days, live)], "trade_date date, live_hits long, baseline_hits long")


def test_stop_and_kill_need_full_windows(spark):
    verdict = lambda n: mon.latest_verdict(mon.rolling_monitor(_hits(spark, [1] * n), 3.0)).first()
    assert not verdict(19).stop and verdict(20).stop
    assert not verdict(29).kill and verdict(30).kill
    assert not mon.latest_verdict(mon.rolling_monitor(_hits(spark, [1] * 25 + [5]), 3.0)).first().stop


def test_overlap_and_freeze(spark):
    days = weekdays("2021-01-04", 30)
    mk = lambda names: spark.createDataFrame([(d, i, t) for d in days for i, t in enumerate(names)], "trade_date date, pos int, ticker string")
    proxy, real = mk([f"t{i}" for i in range(10)]), mk([f"T{i}" for i in range(7)] + ["X", "Y", "Z"])
    bounds = spark.createDataFrame([(days[0], days[-1] + dt.timedelta(days=1))], "start date, end date")
    rep = ov.overlap_report(proxy, real, bounds)
    assert {r.overlap_at_k for r in rep.collect() if r.trade_date <= days[-1]} == {7}
    assert not ov.freeze_criterion(rep).first().met
    assert ov.freeze_criterion(rep.withColumn("overlap_at_k", F.col("overlap_at_k") + 1)).first().met
    assert not ov.freeze_criterion(rep.withColumn("overlap_at_k", F.lit(None).cast("long"))).first().met


def test_sampling_and_wilson(spark):
    lab = labels(spark, [(d, f"N{i}", i, 0.1, 1) for d in weekdays("2022-12-26", 8) for i in range(20)])
    one = sp.sample_positives(lab, 30, seed=1)
    assert one.count() == 30 and one.where("trade_date >= date'2023-01-01'").count() == 0
    assert rows(one, "trade_date", "ticker") == rows(sp.sample_positives(lab.repartition(9), 30, seed=1), "trade_date", "ticker")
    share = {r.category: r for r in sp.category_share(sp.classify(one, lambda p: ["carryover"] * len(p))).collect()}
    assert share["carryover"].share == 1.0 and share["carryover"].ci_high == 1.0 and share["unscheduled"]["count"] == 0
    with pytest.raises(Exception, match="classifier returned"):
        sp.classify(one, lambda p: ["typo"] * len(p)).collect()


def test_delistings_and_survivorship(spark):
    days = weekdays("2021-01-04", 20)
    gone = bars(spark, [(d, "STAY", 1.0) for d in days] + [(d, "GONE", 1.0) for d in days[:10]]
                + [(d, "HALT", 1.0) for i, d in enumerate(days) if not 5 <= i < 12])
    got = sv.infer_delistings(gone).collect()
    assert [(r.ticker, r.inferred_delist_date, r.confidence) for r in got] == [("GONE", days[10], 0.5)]
    assert sv.delisting_actions(sv.infer_delistings(gone)).first().as_of == at(days[10], 0)
    assert sv.survivorship_report(gone).first().passed
    assert not sv.survivorship_report(bars(spark, [(d, "STAY", 1.0) for d in days])).first().passed


def test_ranker_round_trip_and_spec_guard(spark):
    spec = C.FeatureSpec("T1B", ("trade_date", "ticker", "x", "as_of"))
    days = weekdays("2021-01-04", 6)
    data = [(d, f"N{i}", float(i), at(d), int(i >= 18)) for d in days for i in range(20)]
    df = spark.createDataFrame(data, "trade_date date, ticker string, x double, as_of timestamp_ntz, label int")
    feats, lab = df.drop("label"), df.select("trade_date", "ticker", "label", F.lit("v1").alias("label_spec_version"))
    params = {"maxIter": 2, "maxDepth": 2, "minInstancesPerNode": 1, "subsamplingRate": 1.0}
    model = rk.Ranker(params, spec).fit(feats, lab)
    assert rk.class_weight(lab).first().weight == 9.0
    path = scratch_path(spark, "model")
    model.save(path)
    again = rk.Ranker.load(spark, path, spec)
    top = rows(again.rank_top_k(feats, 2).select("trade_date", "ticker"), "trade_date", "ticker")
    assert top == [(d, t) for d in days for t in ("N18", "N19")]
    with pytest.raises(C.ContractError):
        rk.Ranker.load(spark, path, C.T1_SPEC)
    best = rk.tune(feats, lab, feats, lab, {"maxDepth": [1, 2]}, {**params}, k=2)
    assert best["best_score"] == 1.0 and len(best["results"]) == 2
    with pytest.raises(C.LeakageError):
        rk.Ranker(params, spec, sealed_from="2021-01-05").fit(feats, lab)


def test_ranker_keeps_rows_with_missing_features(spark):
    days = weekdays("2021-01-04", 6)
    data = [(d, f"N{i}", float(i) if i % 3 else None, float("nan") if i % 5 == 0 else 1.0, at(d), int(i >= 18)) for d in days for i in range(20)]
    df = spark.createDataFrame(data, "trade_date date, ticker string, x double, y double, as_of timestamp_ntz, label int")
    model = rk.Ranker({"maxIter": 2, "maxDepth": 2, "minInstancesPerNode": 1, "subsamplingRate": 1.0}).fit(df.drop("label"), df.select("trade_date", "ticker", "label"))
    assert model.predict(df.drop("label")).count() == df.count()
    assert model.predict(df.drop("label").withColumn("x", F.lit(None).cast("double"))).where("score is not null").count() == df.count()


def test_walkforward_query_fits_the_published_rounds(spark, monkeypatch):
    class Fitted(Exception):
        pass

    def fit(self, features, labels):
        raise Fitted(self.params)
    monkeypatch.setattr(rk.Ranker, "fit", fit)
    with pytest.raises(Fitted) as seen:
        QUERIES["walkforward_gbt"](spark, "/root/testdata/sf0.001")
    assert seen.value.args[0] == rk.DEFAULTS and (rk.DEFAULTS["maxIter"], rk.DEFAULTS["maxDepth"]) == (300, 5)


def test_a_gap_from_zero_is_infinite_and_comes_first(spark):
    day, before = D("2021-03-02"), D("2021-03-01")
    minutes = spark.createDataFrame([(day, t, at(day, 9), p, 1e6, at(day, 9)) for t, p in (("A", 12.0), ("B", 5.0), ("C", 0.0), ("D", 9.0))],
                                    "trade_date date, ticker string, minute timestamp_ntz, close double, volume double, as_of timestamp_ntz")
    close = spark.createDataFrame([(day, t, p, at(before)) for t, p in (("A", 10.0), ("B", 0.0), ("C", 0.0), ("D", 10.0))],
                                  "trade_date date, ticker string, close double, as_of timestamp_ntz")
    got = {r.ticker: r.score for r in bl.premarket_gap(minutes, close, floor=0.0, k=3).collect()}
    assert got.pop("B") == float("inf") and got == pytest.approx({"A": 20.0, "D": -10.0})
    assert {r.ticker: r.score for r in bl.premarket_gap(minutes, close, floor=0.0).collect()}["C"] is None


def test_walkforward_joins_its_labels_once(spark, monkeypatch):
    from pitrank.operators import linear

    days = weekdays("2016-01-04", 900)[::9]
    x = spark.createDataFrame([(d, f"N{i}", float((i * 7 + k) % 11), at(d - dt.timedelta(1))) for k, d in enumerate(days) for i in range(4)],
                              "trade_date date, ticker string, x double, as_of timestamp_ntz")
    y = labels(spark, [(d, f"N{i}", i + 1, 0.1, int(i < 1)) for d in days for i in range(4)])
    splits = wf.collect_splits(wf.expanding_splits(x))
    joins = []
    joined = wf.with_target
    monkeypatch.setattr(wf, "with_target", lambda *a: joins.append(1) or joined(*a))
    got = {(r.trade_date, r.ticker): r.score for r in wf.run_walkforward(linear.LinearRanker, x, y, splits).collect()}
    want = {}
    for s in splits:
        train, test = (F.col("trade_date").between(a, b) for a, b in ((s.train_start, s.train_end), (s.test_start, s.test_end)))
        want |= {(r.trade_date, r.ticker): r.score for r in linear.LinearRanker().fit(x.where(train), y.where(train)).predict(x.where(test)).collect()}
    assert splits and len(joins) == 1 and got == pytest.approx(want)
