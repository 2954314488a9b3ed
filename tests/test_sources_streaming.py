import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pitrank.operators import identity as idn
from pitrank.session import scratch_path
from pitrank.sources import json_feeds as js, names_history as nh, venues as vn
from pitrank.streaming import jobs as st
from tests.frames import D, T, rows, weekdays


def _docs(spark, *payloads, **cols):
    names = list(cols)
    return spark.createDataFrame(
        [(json.dumps(p), *[cols[c] for c in names]) for p in payloads],
        "payload string" + "".join(f", {c} {'date' if isinstance(cols[c], dt.date) else 'string'}" for c in names))


def test_grouped_daily_falls_back_to_close(spark):
    d = D("2024-01-05")
    got = js.grouped_daily(_docs(spark, {"results": [
        {"T": "AAA", "v": 100.0, "vw": 2.0, "o": 1, "h": 3, "l": 1, "c": 2.5}, {"T": "BBB", "v": 10.0, "c": 4.0}]}, trade_date=d))
    vals = {r.ticker: (r.dollar_volume, r.as_of) for r in got.collect()}
    assert vals == {"AAA": (200.0, T("2024-01-05 16:00:00")), "BBB": (40.0, T("2024-01-05 16:00:00"))}


def test_landed_files_carry_their_date(spark, tmp_path):
    (tmp_path / "bars_2024-01-05.json").write_text(json.dumps({"results": [{"T": "A", "v": 1.0, "c": 2.0}]}, indent=1))
    docs = js.read_documents(spark, str(tmp_path)).withColumn("trade_date", js.file_date(F.col("path")))
    assert js.grouped_daily(docs).first().trade_date == D("2024-01-05")


def test_minute_window_follows_daylight_saving(spark):
    ms = lambda t: int(T(t).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    times = ["2024-01-05 14:24:00", "2024-01-05 14:25:00", "2024-07-05 13:24:00", "2024-07-05 07:59:00", "2024-07-05 08:00:00"]
    got = js.minute_aggregates(_docs(spark, {"results": [{"t": ms(t), "c": 1.0} for t in times]}, ticker="A"))
    assert [r.minute for r in got.orderBy("minute").collect()] == [T("2024-01-05 09:24:00"), T("2024-07-05 04:00:00"), T("2024-07-05 09:24:00")]


def test_capture_never_substitutes_the_context_list(spark):
    a = {"trade_date": "2024-01-05", "top_movers_available": False, "top_movers": {"symbols": ["x"]}, "sp500": {"payload": [{"ticker": "q"}]}}
    b = {"trade_date": "2024-01-08", "top_movers_available": True, "top_movers": {"symbols": ["b", "a"]}, "sp500": {"payload": {"results": [{"symbol": "z"}]}}}
    got = rows(js.captured_lists(_docs(spark, a, b)).select("trade_date", "list", "pos", "ticker"), "trade_date", "list", "pos")
    assert got == [(D("2024-01-05"), "sp500", 0, "Q"), (D("2024-01-08"), "sp500", 0, "Z"),
                   (D("2024-01-08"), "top_movers", 0, "B"), (D("2024-01-08"), "top_movers", 1, "A")]


def test_short_interest_alternate_fields_and_lag(spark):
    got = js.short_interest_feed(_docs(spark, {"results": [
        {"ticker": "A", "settlement_date": "2024-01-10", "settlement_shares": 5, "percent_of_float": 2.0},
        {"ticker": "B", "settlement_date": "2024-01-10", "publish_date": "2024-01-19", "short_interest": 7}]}))
    vals = {r.ticker: (r.short_interest_shares, r.short_interest_pct_float, r.as_of) for r in got.collect()}
    assert vals == {"A": (5.0, 2.0, T("2024-01-24 00:00:00")), "B": (7.0, None, T("2024-01-19 00:00:00"))}


def test_reverse_split_ratio(spark):
    s = _docs(spark, {"results": [{"ticker": "A", "execution_date": "2024-01-10", "split_from": 10, "split_to": 1}]})
    row = js.splits_and_dividends(s, _docs(spark, {"results": []})).first()
    assert (row.action_type, row.ratio, row.as_of) == ("reverse_split", 0.1, T("2024-01-10 00:00:00"))


def test_ticker_changes_and_signed_prices(spark):
    names = spark.createDataFrame([(1, "OLD", "c", 11, -1, D("2020-01-01"), D("2020-06-30")), (1, "NEW", "c", 11, 1, D("2020-07-01"), None)],
                                  "permno long, ticker string, comnam string, shrcd int, exchcd int, namedt date, nameendt date")
    assert [(r.ticker, r.new_ticker, r.ex_date) for r in nh.ticker_changes(names).collect()] == [("OLD", "NEW", D("2020-07-01"))]
    prices = spark.createDataFrame([(1, D("2020-06-30"), -5.0, 5.0, 5.0, 5.0, 10.0), (1, D("2020-07-01"), 6.0, 6.0, 6.0, 6.0, 10.0)],
                                   "permno long, date date, prc double, openprc double, askhi double, bidlo double, vol double")
    got = rows(nh.signed_price_bars(nh.named_prices(prices, names)).select("trade_date", "ticker", "close", "price_is_midpoint"), "trade_date")
    assert got == [(D("2020-06-30"), "OLD", 5.0, True), (D("2020-07-01"), "NEW", 6.0, False)]


def test_venue_fallback_and_corrupt_mapping(spark):
    b = spark.createDataFrame([(D("2024-01-05"), "A", v, c, c, c, c, 10.0, None) for v, c in (("V2", 2.0), ("V1", 1.0))],
                              "trade_date date, ticker string, venue string, open double, high double, low double, close double, volume double, listing_venue string")
    row = vn.merge_venues(b).first()
    assert row.close == 1.0 and row.volume == 20.0
    assert vn.merge_venues(b.withColumn("listing_venue", F.lit("V2"))).first().close == 2.0
    m = spark.createDataFrame([(D("2024-01-05"), "V1", 7, t) for t in "AB"], "trade_date date, venue string, instrument_id long, ticker string")
    with pytest.raises(Exception, match="several symbols"):
        idn.resolve_symbols(m.drop("ticker"), m).collect()
    a = spark.createDataFrame([(D("2024-01-05"), "A"), (D("2024-01-06"), "A")], "ex_date date, ticker string")
    got = rows(idn.align_identity(a, m).select("ex_date", "instrument_id"), "ex_date")
    assert got == [(D("2024-01-05"), 7), (D("2024-01-06"), None)]


def test_write_once_prediction_stream(spark):
    base = scratch_path(spark, "preds")
    days = weekdays("2024-01-01", 2)
    schema = "trade_date date, ticker string, score double"
    run = lambda: st.prediction_sink(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/cp").awaitTermination()
    spark.createDataFrame([(days[0], "A", 1.0)], schema).write.parquet(f"{base}/in")
    run()
    spark.createDataFrame([(days[1], "A", 1.0)], schema).write.mode("append").parquet(f"{base}/in")
    run()
    assert spark.read.parquet(f"{base}/out").count() == 2
    spark.createDataFrame([(days[1], "B", 1.0)], schema).write.mode("append").parquet(f"{base}/in")
    with pytest.raises(Exception, match="already published"):
        run()


def test_monitor_takes_days_in_any_order_across_restarts(spark):
    days = weekdays("2024-01-01", 6)
    schema = "model string, trade_date date, live_hits long, baseline_hits long"
    hits = {d: live for d, live in zip(days, (1, 1, 1, 9, 1, None))}
    want = {}
    for order in ([days], [days[:2], days[2:]], [days[3:], days[:1], days[1:3]], [[d] for d in reversed(days)]):
        base = scratch_path(spark, "mon")
        for part in order:
            frame = [(m, d, hits[d], 5) for d in part for m in ("m", "other")]
            spark.createDataFrame(frame, schema).write.mode("append").parquet(f"{base}/in")
            st.run_monitor(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/cp",
                           expectation=3.0, stop_window=3, kill_window=2).awaitTermination()
        got = {(r.model, r.trade_date): (r.stop, r.kill) for r in st.latest_verdicts(spark, f"{base}/out").collect()}
        want = want or got
        assert got == want
    assert [want["m", d] for d in days] == [(False, False), (False, True), (True, True), (False, False), (False, False), (False, False)]


def test_of_two_runs_at_once_one_publishes_a_date(spark):
    from concurrent.futures import ThreadPoolExecutor

    base = scratch_path(spark, "claims")
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda i: st.claim(spark, f"{base}/_dates/2024-01-01", f"run-{i}") == f"run-{i}", range(16)))
    assert sum(got) == 1
    winner = f"run-{got.index(True)}"
    assert st.claim(spark, f"{base}/_dates/2024-01-01", winner) == winner  # a replay finds its own claim
    schema = "trade_date date, ticker string, score double"
    spark.createDataFrame([(D("2024-02-01"), "A", 1.0)], schema).write.parquet(f"{base}/in")

    def publish(i):
        query = st.prediction_sink(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/cp{i}")
        try:
            query.awaitTermination()
            return True
        except Exception:
            return False

    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(publish, range(2))) == [False, True]
    assert spark.read.parquet(f"{base}/out").count() == 1


def test_a_finite_stream_gives_its_last_minutes(spark):
    base = scratch_path(spark, "ticks")
    schema = "ts timestamp_ntz, ticker string, price double, size double, seq long"
    at = [dt.datetime(2024, 1, 2, 9, 30, s) for s in (0, 5)] + [dt.datetime(2024, 1, 2, 9, 31, 2, 500)]
    frame = spark.createDataFrame([(t, "A", 1.0 + i, 2.0, i) for i, t in enumerate(at)], schema)
    frame.write.parquet(f"{base}/in")
    bars = st.run_to_end(spark, spark.readStream.schema(frame.schema).parquet(f"{base}/in"), st.minute_bars, "bars")
    assert sorted((r.minute.minute, r.open, r.close, r.trade_count) for r in bars.collect()) == [(30, 1.0, 2.0, 2.0), (31, 3.0, 3.0, 1.0)]


def test_published_predictions_are_never_overwritten(spark):
    import datetime as dt

    from pitrank.session import scratch_path
    from pitrank.streaming import jobs

    schema = "trade_date date, ticker string, score double"

    def land(base, day, score):
        spark.createDataFrame([(dt.date(2021, 1, day), "A", score)], schema).write.mode("append").parquet(f"{base}/in")

    def drain(base, out, checkpoint):
        query = jobs.prediction_sink(spark.readStream.schema(schema).parquet(f"{base}/in"), out, checkpoint)
        query.awaitTermination()
        return query

    base = scratch_path(spark, "write-once")
    out = f"{base}/out"
    land(base, 4, 1.0)
    drain(base, out, f"{base}/cp1")
    land(base, 5, 2.0)
    drain(base, out, f"{base}/cp1")
    kept = sorted((r.trade_date.day, r.score) for r in spark.read.parquet(out).collect())
    assert kept == [(4, 1.0), (5, 2.0)]
    with pytest.raises(Exception, match="already published"):
        drain(base, out, f"{base}/cp2")
    land(base, 5, 3.0)
    with pytest.raises(Exception, match="already published"):
        drain(base, out, f"{base}/cp1")
    assert sorted((r.trade_date.day, r.score) for r in spark.read.parquet(out).collect()) == kept
