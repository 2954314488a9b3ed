import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitrank import contracts as C
from pitrank.operators import baselines as bl, leakage as lk, quality as qa
from pitrank.sources import tables
from pitrank.session import scratch_path
from tests.frames import D, actions, at, bars, labels, rows, weekdays

DAYS = weekdays("2021-03-01", 6)


@pytest.fixture(scope="module")
def lab(spark):
    return labels(spark, [(d, f"N{i:02d}", i + 1, 0.3 - i * 0.01, int(i < 10)) for d in DAYS for i in range(20)])


def _features(lab, expr):
    return lab.select("trade_date", "ticker", expr.cast("double").alias("x"),
                      F.hash("ticker", "trade_date").cast("double").alias("noise"), "as_of")


@pytest.mark.parametrize("expr", ["return_t * 100 + 1", "exp(return_t)", "-2 * rank"])
def test_disguised_labels_are_caught_and_noise_passes(lab, expr):
    expr = F.expr(expr)
    verdicts = {(r.feature, r.label_col): r.leaks for r in lk.correlation_leaks(_features(lab, expr), lab).collect()}
    assert verdicts[("x", "return_t")] and verdicts[("x", "rank")]
    assert not any(v for (f, _), v in verdicts.items() if f == "noise")
    with pytest.raises(C.LeakageError):
        lk.assert_self_exclusion(_features(lab, expr), lab)


def test_null_ranks_use_pairwise_rows(lab):
    partial = lab.withColumn("rank", F.when(F.col("label") == 1, F.col("rank")))
    got = {(r.feature, r.label_col): r for r in lk.correlation_leaks(_features(lab, F.col("return_t")), partial).collect()}
    assert got[("x", "rank")].leaks and got[("x", "return_t")].evaluable_days == len(DAYS)


def test_identity_and_forbidden_columns(lab):
    same = {(r.feature, r.label_col) for r in lk.identity_leaks(_features(lab, F.col("return_t")), lab).where("identical").collect()}
    assert same == {("x", "return_t")}
    with pytest.raises(C.LeakageError):
        lk.identity_leaks(lab, lab)


def test_shuffle_is_a_permutation_within_the_day(lab):
    mixed = lk.shuffle_labels(lab, seed=4)
    for day in DAYS[:2]:
        a = sorted(r.rank for r in lab.where(f"trade_date = date'{day}'").collect())
        b = sorted(r.rank for r in mixed.where(f"trade_date = date'{day}'").collect())
        assert a == b
    assert rows(mixed, "trade_date", "ticker") != rows(lab, "trade_date", "ticker")
    assert rows(mixed, "trade_date", "ticker") == rows(lk.shuffle_labels(lab.repartition(7), seed=4), "trade_date", "ticker")


def test_shuffle_test_catches_a_leaking_model(lab):
    leaking = lambda x, y: x.select("trade_date", "ticker", F.col("x").alias("score"))
    bad = lk.shuffle_label_verdict(lk.shuffle_label_trials(lk.each_trial(leaking, 2), _features(lab.withColumn("label", (F.col("rank") <= 1).cast("int")), F.col("return_t")),
                                lab.withColumn("label", (F.col("rank") <= 1).cast("int")), k=1, trials=2))
    assert not bad["passed"] and bad["observed_precision"] == 1.0


def test_dates_without_rows_are_built_once(spark):
    base = scratch_path(spark, "ledger")
    dates = spark.createDataFrame([(d,) for d in DAYS], "trade_date date")
    asked = []

    def build(todo):
        asked.append(sorted(r[0] for r in todo.collect()))
        return todo.where(F.dayofmonth("trade_date") % 2 == 0).select("trade_date", F.lit("A").alias("ticker"))

    none = tables.build_incrementally(spark, dates.limit(0), build, base, "v0")
    assert none.count() == 0
    odd = [d for d in DAYS if d.day % 2]
    assert tables.build_incrementally(spark, dates.where(F.col("trade_date").isin(odd)), build, base, "v1").count() == 0
    assert tables.build_incrementally(spark, dates, build, base, "v1").count() == len(DAYS) - len(odd)
    tables.build_incrementally(spark, dates, build, base, "v1")
    assert [a for a in asked if a] == [odd, sorted(set(DAYS) - set(odd))]


def test_a_sealed_date_stops_every_baseline(spark):
    sealed = [D("2023-01-03"), D("2023-01-04")]
    stamped = spark.createDataFrame([(d, t, 1, 1, at(d - dt.timedelta(1))) for d in sealed for t in "AB"], "trade_date date, ticker string, label int, rank int, as_of timestamp_ntz")
    long = bars(spark, [(d, t, 10.0 + i % 3) for i, d in enumerate(weekdays("2022-12-01", 30)) for t in "AB"])
    earnings = spark.createDataFrame([(d, "A", at(D("2022-11-01"))) for d in weekdays("2022-12-01", 30)], "report_date date, ticker string, as_of timestamp_ntz")
    minutes = spark.createDataFrame([(sealed[0], "A", at(sealed[0], 9), 11.0, 1e9, at(sealed[0], 9))], "trade_date date, ticker string, minute timestamp_ntz, close double, volume double, as_of timestamp_ntz")
    close = spark.createDataFrame([(sealed[0], "A", 10.0, at(sealed[0] - dt.timedelta(1)))], "trade_date date, ticker string, close double, as_of timestamp_ntz")
    runs = [lambda **s: bl.random_pick(stamped, **s), lambda **s: bl.yesterday_repeat(stamped.withColumn("as_of", F.col("trade_date").cast("timestamp_ntz")), **s),
            lambda **s: bl.realised_vol(long, **s), lambda **s: bl.earnings_vol(long, earnings, window=5, **s), lambda **s: bl.premarket_gap(minutes, close, **s)]
    for run in runs:
        with pytest.raises(Exception, match="sealed period"):
            run().collect()
        assert run(token=C.UNSEAL_TOKEN).count() > 0


def test_adjusted_and_unadjusted(spark):
    days = weekdays("2021-03-01", 10)
    flat = bars(spark, [(d, "A", 10.0) for d in days])
    jump = bars(spark, [(d, "A", 10.0 if d < days[5] else 5.0) for d in days])
    a = actions(spark, [(days[5], "A", "split", 2.0, at(days[3]))])
    assert lk.unadjusted_violations(flat, a).count() == 1 and lk.unadjusted_violations(jump, a).count() == 0
    assert [r[1] for r in rows(lk.adjusted_suspects(flat, a), "trade_date")] == days[:3]
    early = flat.withColumn("as_of", F.col("trade_date").cast("timestamp_ntz") - F.expr("INTERVAL 1 HOUR"))
    assert lk.adjusted_suspects(early, None).count() == 10


def test_decision_time_gate_and_seal(spark):
    b = bars(spark, [(D("2022-12-30"), "A", 1.0), (D("2023-01-03"), "A", 1.0)])
    assert lk.decision_time_violations(b, "T1").count() == 2 and lk.decision_time_violations(b, "close").count() == 0
    with pytest.raises(C.LeakageError):
        lk.assert_sealed(b)
    lk.assert_sealed(b, C.UNSEAL_TOKEN)
    lk.assert_sealed(b.where("trade_date < date'2023-01-01'"))
    with pytest.raises(ValueError):
        lk.decision_time_violations(b, "T9")


def test_sanity_report_and_enforcement(spark, lab):
    report = {r.check: r for r in qa.sanity_report(lab, actions(spark)).collect()}
    assert report["label_cardinality"].passed and report["universe_continuity"].passed
    assert report["median_gainer_quiet_regime"].passed
    hot = lab.withColumn("return_t", F.col("return_t") + 2)
    with pytest.raises(qa.QualityError):
        qa.enforce(qa.sanity_report(hot, actions(spark)))
    quiet = lab.withColumn("return_t", F.lit(0.01))
    assert [w["check"] for w in qa.enforce(qa.sanity_report(quiet, actions(spark)))] == ["median_gainer_quiet_regime"]
    split = actions(spark, [(DAYS[0], "N00", "split", 2.0, at(DAYS[0]))])
    assert qa.split_day_offenders(lab, split).count() == 1


def test_conform_and_spec(spark):
    df = spark.createDataFrame([("A", D("2021-01-04"), "bmo", None, None, None)], C.EARNINGS)
    with pytest.raises(Exception, match="null in boolean"):
        C.conform(df, C.EARNINGS).collect()
    with pytest.raises(C.ContractError):
        C.conform(df.drop("session"), C.EARNINGS)
    spec = C.FeatureSpec("T1", ("trade_date", "ticker", "x", "as_of"))
    with pytest.raises(C.ContractError, match="order"):
        spec.check(df.selectExpr("report_date trade_date", "ticker", "as_of", "1 x"))
    assert spec.spec_hash != C.FeatureSpec("T1", ("trade_date", "ticker", "x", "as_of"), "2").spec_hash


def test_sinks(spark, lab):
    base = scratch_path(spark, "sink")
    with pytest.raises(C.LeakageError):
        tables.write_pit(lab.drop("as_of"), f"{base}/a")
    tables.write_once(lab, f"{base}/b")
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_once(lab, f"{base}/b")
    seen = tables.read_pit(spark, f"{base}/b", f"{DAYS[2]} 16:00:00")
    assert seen.select("trade_date").distinct().count() == 3
    assert "PushedFilters: [IsNotNull(as_of), LessThanOrEqual(as_of" in seen._jdf.queryExecution().executedPlan().toString()
    spec = C.FeatureSpec("T1", ("trade_date", "ticker", "x", "as_of"))
    leak = _features(lab, F.col("return_t")).select("trade_date", "ticker", "x", "as_of")
    with pytest.raises(Exception, match="not knowable"):
        tables.write_features(leak, spec, f"{base}/f")
    with pytest.raises(ValueError):
        tables.write_features(leak, C.FeatureSpec("T9", spec.columns), f"{base}/f")


def test_incremental_build_only_computes_missing(spark, lab):
    base, asked = scratch_path(spark, "inc"), []

    def build(dates):
        asked.append(sorted(r[0] for r in dates.collect()))
        return lab.join(dates, "trade_date", "left_semi")

    dates = lab.select("trade_date").distinct()
    tables.build_incrementally(spark, dates.where(f"trade_date <= date'{DAYS[2]}'"), build, base, "v1")
    full = tables.build_incrementally(spark, dates, build, base, "v1")
    assert full.count() == lab.count()
    tables.build_incrementally(spark, dates, build, base, "v1")
    assert asked == [DAYS[:3], DAYS[3:]]


@pytest.mark.parametrize("gaps", [False, True])
def test_correlations_of_a_day_equal_those_in_slices(spark, lab, gaps):
    given = lab.withColumn("rank", F.when((F.col("label") == 1) | ~F.lit(gaps), F.col("rank")))
    x = _features(lab, F.expr("case when rank % 7 = 3 then null else round(return_t, 1) * rank end"))
    got, sliced = ({(r.trade_date, r.feature, r.label_col): r for r in lk.daily_correlations(x, given, wide_day=n).collect()} for n in (10**6, 5))
    assert got.keys() == sliced.keys() and len(got) == 6 * len(DAYS)
    for key, r in got.items():
        assert (r.n, r.varies) == (sliced[key].n, sliced[key].varies)
        assert [r.pearson, r.spearman] == pytest.approx([sliced[key].pearson, sliced[key].spearman], abs=1e-12)


def test_features_that_carry_their_labels_are_compared_in_one_read(lab):
    carried = lab.select("trade_date", "ticker", F.col("return_t").alias("x"), *lk.LABEL_COLUMNS)
    assert {(r.feature, r.label_col) for r in lk.identity_leaks(carried, None).where("identical").collect()} == {("x", "return_t")}
    apart = lk.correlation_leaks(carried.select("trade_date", "ticker", "x"), lab).collect()
    assert sorted(apart) == sorted(lk.correlation_leaks(carried, None).collect())
