"""Logical tables of the engine derived from the star-schema test data.

Every view reads a whole source table.  Tickers are ``T<key>``; supplier, customer
and event-user keys share that name space, so the facts meet by natural joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from pitrank.functions.clock import close_time
from pitrank.functions.scalars import growth
from pitrank.operators import calendar as cal
from pitrank.operators.rolling import timeline, with_extremes

# Parameters that fit the synthetic price level of the test data.
MIN_CLOSE = 100.0
MIN_DOLLAR_VOLUME = 40_000.0
MAX_STALENESS = 10
SEALED_FROM = "2002-01-01"
#: The event stream of the test data lies later.
EVENTS_SEALED_FROM = "2025-01-01"


# Declared schemas: opening a table costs no footer scan.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ticker(col: str):
    return F.concat(F.lit("T"), F.col(col).cast("string"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per (ship date, supplier); prices are unit prices.

    Ticks of a day are ordered by (order, line, amount, quantity), packed into one
    decimal: with a fixed-width ordering value ``min_by``/``max_by`` stay in hash
    aggregation, combined map-side, where a struct would force a sort.
    """
    sequence = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("decimal(20,0)")
    amount = F.round(F.col("l_extendedprice") * 100).cast("bigint") * 100 + F.col("l_quantity").cast("bigint")
    order = (sequence * F.lit("1000000000000").cast("decimal(13,0)") + amount.cast("decimal(18,0)")).cast("decimal(38,0)")
    ticks = table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("trade_date"),
        F.col("l_suppkey"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        "l_quantity",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("money"),
        order.alias("tick"),
    )
    bars = ticks.groupBy("trade_date", "l_suppkey").agg(
        F.min_by("price", "tick").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "tick").alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.sum("money").cast("double").alias("dollar_volume"),
    )
    return bars.select(
        "trade_date", _ticker("l_suppkey").alias("ticker"), "open", "high", "low", "close", "volume",
        "dollar_volume", close_time("trade_date").alias("as_of"),
    )


def late_bars(bars: DataFrame) -> DataFrame:
    """The bars with about one in twenty stamped 3 to 62 days late, after newer bars of its ticker."""
    number = F.substring("ticker", 2, 20).cast("long")
    day = F.datediff("trade_date", F.lit("1992-01-01").cast("date"))
    delay = F.when((number * 31 + day * 7) % 20 == 0, 3 + (number + day) % 60).otherwise(0)
    return bars.withColumn("as_of", F.col("as_of") + F.make_dt_interval(delay.cast("int"), F.lit(0), F.lit(0), F.lit(0)))


def ticker_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listing vintages per supplier: at listing, and 900 days later with a new market cap."""
    nation = table(spark, sf_dir, "nation")
    base = table(spark, sf_dir, "supplier").join(
        F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")
    )
    listed = F.date_add(F.lit("1993-06-01").cast("date"), (F.col("s_suppkey") * 37 % 1500).cast("int"))
    types = F.array(*[F.lit(t) for t in ("CS", "ADR", "CS", "ETF", "WARRANT", "CS", "UNIT", "SPAC", "OTHER")])
    venues = F.array(*[F.lit(t) for t in ("XNYS", "XNAS", "XASE", "XNAS", "OTC")])
    sectors = F.array(
        *[F.lit(t) for t in ("Technology", "Health Care", "Energy", " Financials ", "Consumer Staples",
                             "Utilities", "Materials", "Industrials", "Real Estate",
                             "Communication Services", "Mining")]
    )
    industries = F.array(*[F.lit(t) for t in ("Software", "Biotechnology", "Banks", "Oil")])
    vintages = base.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
    return vintages.select(
        _ticker("s_suppkey").alias("ticker"),
        F.col("s_name").alias("name"),
        F.element_at(types, (F.col("s_suppkey") % 9 + 1).cast("int")).alias("security_type"),
        F.element_at(venues, F.col("n_regionkey") + 1).alias("exchange"),
        listed.alias("active_from"),
        F.when(F.col("s_suppkey") % 7 == 0, F.date_add(listed, 2000)).alias("active_to"),
        (F.abs("s_acctbal") * 1e6 * (F.col("v") + 1)).alias("market_cap"),
        F.when(F.col("s_suppkey") % 5 != 0, F.abs("s_acctbal") * 1e4).alias("float_shares"),
        F.when(F.col("s_suppkey") % 12 != 11, F.element_at(sectors, (F.col("s_suppkey") % 11 + 1).cast("int"))).alias("sector"),
        F.element_at(industries, (F.col("s_nationkey") % 4 + 1).cast("int")).alias("industry"),
        F.date_add(listed, F.col("v") * 900).cast("timestamp_ntz").alias("as_of"),
    )


def corporate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (
        F.when(F.col("o_orderpriority").startswith("1"), "split")
        .when(F.col("o_orderpriority").startswith("2"), "reverse_split")
        .when(F.col("o_orderpriority").startswith("3"), "ticker_change")
        .otherwise("dividend")
    )
    ex = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        ex.alias("ex_date"),
        _ticker("o_custkey").alias("ticker"),
        kind.alias("action_type"),
        F.when(kind == "split", F.lit(2.0)).when(kind == "reverse_split", F.lit(0.1)).alias("ratio"),
        F.when(kind == "dividend", F.col("o_totalprice") / 1e5).alias("cash_amount"),
        F.when(kind == "ticker_change", F.concat(F.lit("N"), F.col("o_custkey").cast("string"))).alias("new_ticker"),
        F.date_sub(ex, 5).cast("timestamp_ntz").alias("as_of"),
    )


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One earnings date per (ticker, report date): the earliest order behind it."""
    announced = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("timestamp_ntz"))
    report = F.date_add(F.to_date("o_orderdate"), 30)
    rows = table(spark, sf_dir, "orders").select(
        _ticker("o_custkey").alias("ticker"),
        report.alias("report_date"),
        F.col("o_orderkey"),
        announced.alias("announced_on"),
    )
    first = rows.groupBy("ticker", "report_date").agg(
        F.min(F.struct("o_orderkey", "announced_on")).alias("r")
    )
    return first.select(
        "ticker",
        "report_date",
        F.when(F.col("r.o_orderkey") % 2 == 0, "bmo").otherwise("amc").alias("session"),
        F.col("r.announced_on").alias("announced_on"),
        F.col("r.announced_on").isNull().alias("date_is_revisable"),
        F.coalesce(
            F.col("r.announced_on"), F.date_sub("report_date", 1).cast("timestamp_ntz")
        ).alias("as_of"),
    )


def short_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    settled = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        _ticker("o_custkey").alias("ticker"),
        settled.alias("settlement_date"),
        F.col("o_totalprice").alias("short_interest_shares"),
        (F.col("o_totalprice") / 1e4).alias("short_interest_pct_float"),
        (F.col("o_totalprice") / 1e5).alias("days_to_cover"),
        F.date_add(settled, 14).cast("timestamp_ntz").alias("as_of"),
    )


def market_context(bars: DataFrame) -> DataFrame:
    """Daily mean return, its 5-session sum, mean absolute return and large-mover count."""
    w = timeline("ticker", "trade_date")
    rets = bars.select("trade_date", growth(F.col("close"), F.lag("close").over(w)).alias("ret"))
    daily = rets.groupBy("trade_date").agg(
        (F.sum(F.col("ret").cast("decimal(18,8)")).cast("double") / F.expr("nullif(count(ret), 0)")).alias("spy_ret_1d"),
        (F.sum(F.abs("ret").cast("decimal(18,8)")).cast("double") / F.expr("nullif(count(ret), 0)")).alias("vix_level"),
        F.count(F.when(F.abs("ret") > 0.10, 1)).cast("double").alias("movers_10pct_count"),
    )
    w5 = W.orderBy("trade_date")
    # Oldest first, so every engine adds the five values in the same order.
    last5 = [F.coalesce(F.lag("spy_ret_1d", n).over(w5), F.lit(0.0)) for n in (4, 3, 2, 1)]
    total5 = last5[0] + last5[1] + last5[2] + last5[3] + F.coalesce("spy_ret_1d", F.lit(0.0))
    return daily.select(
        "trade_date",
        "spy_ret_1d",
        total5.alias("spy_ret_5d"),
        "vix_level",
        (F.col("vix_level") - F.col("spy_ret_1d")).alias("iwm_minus_spy_1d"),
        "movers_10pct_count",
        close_time("trade_date").alias("as_of"),
    )


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("trade_date"),
        _ticker("user_id").alias("ticker"),
        F.expr("ts - make_dt_interval(0, 0, 0, extract(SECOND FROM ts))").alias("minute"),
        F.struct("ts", "event_id").alias("tick"),
        F.col("value"),
        "event_type",
        "ts",
    )


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-day minute bars from events: value is the price, ticks count as 100 shares."""
    return (
        _ticks(spark, sf_dir)
        .groupBy("trade_date", "ticker", "minute")
        .agg(
            F.min_by("value", "tick").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "tick").alias("close"),
            (F.count(F.lit(1)) * 100).cast("double").alias("volume"),
            F.count(F.lit(1)).cast("double").alias("trade_count"),
        )
        .withColumn("as_of", F.col("minute"))
    )


def event_daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the event tickers, the prior-close side of the premarket features."""
    return (
        _ticks(spark, sf_dir)
        .groupBy("trade_date", "ticker")
        .agg(
            F.min_by("value", "tick").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "tick").alias("close"),
            (F.count(F.lit(1)) * 100).cast("double").alias("volume"),
            F.sum((F.col("value") * 100).cast("decimal(18,4)")).cast("double").alias("dollar_volume"),
        )
        .withColumn("as_of", close_time("trade_date"))
    )


def halts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _ticks(spark, sf_dir)
        .where(F.col("event_type") == "error")
        .groupBy("trade_date", "ticker")
        .agg(F.min("minute").alias("as_of"))
    )


def prior_close(bars: DataFrame) -> DataFrame:
    """Last earlier close keyed by the day being predicted (next shared session)."""
    shifted = cal.shift_to_next_session(
        bars.select("trade_date", "ticker", "close", "as_of"), cal.sessions(bars)
    )
    return shifted.select("trade_date", "ticker", "close", "as_of")


def bar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session dates straight from the tick table: a one-column scan, no bar build."""
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("trade_date"))


# --- landed documents, security master and venue feeds, all derived from whole tables ----


def _docs(df: DataFrame, body, *keep: str) -> DataFrame:
    """One JSON document per row, the shape landed files have after reading."""
    return df.select(*keep, F.to_json(body).alias("payload"))


def results(item):
    return F.struct(F.array(item).alias("results"))


def grouped_daily_docs(bars: DataFrame) -> DataFrame:
    vwap = F.when(F.col("volume") % 2 == 1, F.col("dollar_volume") / F.col("volume"))
    item = F.struct(
        F.col("ticker").alias("T"), F.col("volume").alias("v"), vwap.alias("vw"), F.col("open").alias("o"),
        F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"),
    )
    return _docs(bars, results(item), "trade_date")


def action_docs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Split documents and dividend documents from all orders."""
    acts = corporate_actions(spark, sf_dir).withColumn("ex", F.col("ex_date").cast("string"))
    ahead = F.date_sub("ex_date", 5).cast("string")
    is_split = F.col("action_type").isin("split", "reverse_split")
    split_item = F.struct(
        "ticker", F.col("ex").alias("execution_date"),
        F.when(F.col("action_type") == "split", F.lit(1.0)).otherwise(F.lit(10.0)).alias("split_from"),
        F.when(F.col("action_type") == "split", F.lit(2.0)).otherwise(F.lit(1.0)).alias("split_to"),
        F.when(F.dayofmonth("ex_date") > 15, ahead).alias("announcement_date"),
    )
    dividend_item = F.struct(
        "ticker", F.col("ex").alias("ex_dividend_date"),
        F.when(F.dayofmonth("ex_date") > 15, ahead).alias("declaration_date"),
        F.col("cash_amount"),
    )
    return (
        _docs(acts.where(is_split), results(split_item)),
        _docs(acts.where(~is_split), results(dividend_item)),
    )


def reference_docs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Active and delisted listing documents; names with key % 7 = 0 appear in both."""
    codes = F.array(*[F.lit(c) for c in ("cs", "ADRC", "ETN", "WARRANT", "SP", "FUND")])
    key = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier").withColumn(
        "listed", F.date_add(F.lit("1993-06-01").cast("date"), (key * 37 % 1500).cast("int"))
    )

    def item(delisted):
        return F.struct(
            _ticker("s_suppkey").alias("ticker"), F.col("s_name").alias("name"),
            F.element_at(codes, (key % 6 + 1).cast("int")).alias("type"),
            F.when(key % 4 != 3, F.lit("XNYS")).alias("primary_exchange"),
            F.col("listed").cast("string").alias("list_date"), delisted.alias("delisted_utc"),
            F.col("s_acctbal").alias("market_cap"),
            F.when(key % 2 == 0, F.lit(0.0)).otherwise(key * 10.0).alias("weighted_shares_outstanding"),
            (key * 100.0).alias("share_class_shares_outstanding"),
        )

    gone = F.concat(F.date_add("listed", 900).cast("string"), F.lit("T00:00:00Z"))
    return (
        _docs(base, results(item(F.lit(None).cast("string")))),
        _docs(base, results(item(F.when(key % 7 == 0, gone)))),
    )


def earnings_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = earnings(spark, sf_dir)
    item = F.struct(
        "ticker", F.col("report_date").cast("string").alias("report_date"),
        F.when(F.col("session") == "bmo", "bmo").alias("session"),
        F.col("announced_on").cast("string").alias("announced_on"),
    )
    return _docs(e, results(item))


def earnings_calendar_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = earnings(spark, sf_dir)
    item = F.struct(
        F.col("ticker").alias("symbol"), F.col("report_date").cast("string").alias("date"),
        F.when(F.col("session") == "bmo", "BMO").when(F.dayofmonth("report_date") > 10, "amc").otherwise("dmh").alias("hour"),
    )
    return _docs(e, F.struct(F.array(item).alias("earningsCalendar")))


def short_interest_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    settled = F.to_date("o_orderdate")
    late = F.dayofmonth(settled) > 15
    item = F.struct(
        _ticker("o_custkey").alias("ticker"), settled.cast("string").alias("settlement_date"),
        F.when(late, F.date_add(settled, 9).cast("string")).alias("date_published"),
        F.col("o_totalprice").alias("settlement_shares"),
        F.when(late, F.lit(0.0)).alias("short_interest_pct_float"),
        (F.col("o_totalprice") / 1e4).alias("percent_of_float"),
        (F.col("o_totalprice") / 1e5).alias("days_to_cover"),
    )
    return _docs(table(spark, sf_dir, "orders"), results(item))


def minute_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    v = F.col("value")
    item = F.struct(
        ms.alias("t"), v.alias("o"), v.alias("h"), v.alias("l"), v.alias("c"),
        F.lit(100.0).alias("v"), F.lit(1.0).alias("n"),
    )
    e = table(spark, sf_dir, "events").withColumn("ticker", _ticker("user_id"))
    return _docs(e, results(item), "ticker")


def eod_docs(bars: DataFrame) -> DataFrame:
    item = F.struct(
        F.concat(F.col("trade_date").cast("string"), F.lit("T00:00:00.000Z")).alias("date"),
        "open", "high", "low", "close", "volume",
    )
    return bars.select("ticker", F.to_json(F.array(item)).alias("payload"))


def capture_docs(top: DataFrame) -> DataFrame:
    """One envelope per date around a top-k list (trade_date, pos, ticker): at most k entries each."""
    per_day = top.groupBy("trade_date").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.lower("ticker").alias("s")))).alias("l")
    )
    symbols = F.col("l.s")
    even = F.dayofmonth("trade_date") % 2 == 0
    items = F.transform(symbols, lambda s: F.struct(s.alias("symbol")))
    tickers = F.transform(symbols, lambda s: F.struct(s.alias("ticker")))
    as_object = F.to_json(F.struct(items.alias("results")))
    payload = F.concat(
        F.lit('{"trade_date":"'), F.col("trade_date").cast("string"), F.lit('","top_movers_available":'),
        even.cast("string"), F.lit(',"top_movers":{"symbols":'), F.to_json(symbols),
        F.lit('},"sp500":{"available":true,"payload":'),
        F.when(F.month("trade_date") % 2 == 0, as_object).otherwise(F.to_json(tickers)),
        F.lit("}}"),
    )
    return per_day.select(payload.alias("payload"))


def security_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two consecutive name ranges per supplier; every third changes its ticker at the second."""
    key = F.col("s_suppkey")
    listed = F.date_add(F.lit("1993-06-01").cast("date"), (key * 37 % 1500).cast("int"))
    shares = F.element_at(F.array(F.lit(10), F.lit(11), F.lit(31), F.lit(73)), (key % 4 + 1).cast("int"))
    venues = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(-3), F.lit(9)), (key % 4 + 1).cast("int"))
    ranges = table(spark, sf_dir, "supplier").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
    return ranges.select(
        key.alias("permno"),
        F.when((key % 3 == 0) & (F.col("v") == 1), F.concat(F.lit("N"), key.cast("string"))).otherwise(_ticker("s_suppkey")).alias("ticker"),
        F.col("s_name").alias("comnam"), shares.alias("shrcd"), venues.alias("exchcd"),
        F.date_add(listed, F.col("v") * 1100).alias("namedt"),
        F.when(F.col("v") == 0, F.date_add(listed, 1099)).alias("nameendt"),
    )


def security_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed daily prices per permanent id; odd volumes mark midpoint quotes."""
    b = daily_bars(spark, sf_dir)
    return b.select(
        F.substring("ticker", 2, 20).cast("bigint").alias("permno"), F.col("trade_date").alias("date"),
        F.when(F.col("volume") % 2 == 1, -F.col("close")).otherwise(F.col("close")).alias("prc"),
        F.col("open").alias("openprc"), F.col("high").alias("askhi"), F.col("low").alias("bidlo"),
        F.col("volume").alias("vol"), (F.col("volume") * 3).alias("shrout"),
    )


def security_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    ex = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("permno"), ex.alias("exdt"),
        F.when(F.col("o_orderstatus") != "P", F.date_sub(ex, 20)).alias("dclrdt"),
        F.when(first == "1", F.lit(1.0)).when(first == "2", F.lit(-0.9)).when(first == "3", F.lit(0.0)).alias("facpr"),
        F.when(first.isin("3", "4"), F.col("o_totalprice") / 1e5).alias("divamt"),
    )


def security_delistings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("permno"), F.date_add(F.lit("1996-01-01").cast("date"), (key * 11 % 1500).cast("int")).alias("dlstdt"),
        (F.col("s_acctbal") / 1e4).alias("dlret"),
    )


def venue_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-venue daily bars without tickers: instruments carry ids that are only valid for their day."""
    venues = F.array(F.lit("XASE.PILLAR"), F.lit("XNAS.ITCH"), F.lit("XNYS.PILLAR"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    day = F.to_date("l_shipdate")
    ticks = table(spark, sf_dir, "lineitem").select(
        day.alias("trade_date"), F.element_at(venues, F.col("l_linenumber") % 3 + 1).alias("venue"),
        F.col("l_suppkey"), price.alias("price"), "l_quantity",
    )
    bars = ticks.groupBy("trade_date", "venue", "l_suppkey").agg(
        F.min("price").alias("low"), F.max("price").alias("high"), F.sum("l_quantity").alias("volume")
    )
    return bars.select(
        "trade_date", "venue", instrument_id().alias("instrument_id"), F.col("low").alias("open"), "high", "low",
        F.col("high").alias("close"), "volume",
    )


def instrument_id(key: str = "l_suppkey", date: str = "trade_date"):
    return F.col(key) * 1000 + F.datediff(F.col(date), F.lit("1990-01-01").cast("date")) % 997


def symbol_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trade_date, venue, instrument_id) -> ticker, as a per-day symbology feed delivers it."""
    venues = F.array(F.lit("XASE.PILLAR"), F.lit("XNAS.ITCH"), F.lit("XNYS.PILLAR"))
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("trade_date"),
        F.element_at(venues, F.col("l_linenumber") % 3 + 1).alias("venue"), "l_suppkey",
    ).distinct().select("trade_date", "venue", instrument_id().alias("instrument_id"), _ticker("l_suppkey").alias("ticker"))


def listing_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month-start listing snapshots for every ticker seen in the month."""
    exchanges = F.array(F.lit("XNAS"), F.lit("XNYS"), F.lit("ARCX"), F.lit("IEXG"))
    month = F.trunc(F.to_date("l_shipdate"), "MM")
    seen = table(spark, sf_dir, "lineitem").select(month.alias("snapshot_date"), "l_suppkey").distinct()
    pick = ((F.col("l_suppkey") + F.month("snapshot_date")) % 4 + 1).cast("int")
    return seen.select(
        "snapshot_date", _ticker("l_suppkey").alias("ticker"), F.lit("XASE.PILLAR").alias("venue"),
        F.element_at(exchanges, pick).alias("exchange"), F.lit("common_stock").alias("security_class"),
    )


def session_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("l_shipdate")
    state = F.when(F.dayofmonth("trade_date") == 13, "degraded").when(F.dayofmonth("trade_date") == 27, "pending").otherwise("available")
    return table(spark, sf_dir, "lineitem").select(day.alias("trade_date")).distinct().select(
        "trade_date", F.lit("XNAS.ITCH").alias("venue"), state.alias("condition")
    )


def identity_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trade_date, ticker) -> instrument id; tickers with key % 10 = 0 carry two ids on even days."""
    seen = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("trade_date"), "l_suppkey").distinct()
    twice = (F.col("l_suppkey") % 10 == 0) & (F.dayofmonth("trade_date") % 2 == 0)
    ids = F.when(twice, F.array(F.col("l_suppkey") * 10, F.col("l_suppkey") * 10 + 1)).otherwise(F.array(F.col("l_suppkey") * 10))
    return seen.select("trade_date", _ticker("l_suppkey").alias("ticker"), F.explode(ids).alias("instrument_id"))


def with_forecast(universe: DataFrame) -> DataFrame:
    """The universe with a quantile forecast on each row: trailing low, last and high return as q10, q50, q90; null where there is none."""
    w = timeline("ticker", "trade_date")
    last = universe.withColumn("q50", F.lag("ret").over(w))
    spread = with_extremes(last, w, 20, {"q10": ("q50", F.least), "q90": ("q50", F.greatest)})
    known = F.col("q50").isNotNull()
    return spread.withColumns({q: F.when(known, F.col(q)) for q in ("q10", "q90")})


def forecast_quantiles(universe: DataFrame) -> DataFrame:
    """The forecasts as a quantile table with the right contract."""
    return with_forecast(universe).select("trade_date", "ticker", "q10", "q50", "q90").where("q50 is not null")


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a file stream of ticks (one hundred shares each)."""
    raw = spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select(
        "ts", _ticker("user_id").alias("ticker"), F.col("value").alias("price"), F.lit(100.0).alias("size"),
        F.col("event_id").alias("seq"),
    )
