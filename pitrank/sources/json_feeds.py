"""Landed JSON feeds to contract frames.

Each parser takes a frame with a ``payload`` string column (one document per
row; ``read_documents`` lands files that way) and explodes the nested results.
Schemas are declared, never inferred, so no extra pass over the data happens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pitrank import contracts as C
from pitrank.functions.clock import close_time, premarket_open, premarket_time, utc_millis_to_eastern

# Feed code lists.
SECURITY_TYPES = {
    "CS": "CS",
    "ADRC": "ADR",
    "ADR": "ADR",
    "ETF": "ETF",
    "ETN": "ETF",
    "WARRANT": "WARRANT",
    "RIGHT": "RIGHT",
    "UNIT": "UNIT",
    "SP": "SPAC",
}
SESSIONS = ("bmo", "amc")
PUBLISH_LAG_DAYS = 14


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file: ``path`` and whole text as ``payload``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload")
    )


def file_date(path: Column) -> Column:
    """Trade date in a landed file's name (``...YYYY-MM-DD.json``)."""
    return F.to_date(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})\.json", 1))


def _items(docs: DataFrame, schema: str, field: str = "results", keep: tuple[str, ...] = ()) -> DataFrame:
    parsed = docs.select(*keep, F.from_json("payload", f"struct<{field}:array<struct<{schema}>>>").alias("d"))
    return parsed.select(*keep, F.explode(f"d.{field}").alias("r"))


def _date(col: str) -> Column:
    """Calendar date of an ISO text, time and zone suffix ignored rather than converted."""
    return F.to_date(F.substring(F.col(col), 1, 10))


def _stamp(col: str) -> Column:
    text = F.regexp_replace(F.substring(F.col(col), 1, 19), "T", " ")
    return F.when(F.length(text) > 10, text.cast("timestamp_ntz")).otherwise(F.to_date(F.substring(text, 1, 10)).cast("timestamp_ntz"))


def _map(col: Column, table: dict, default: str) -> Column:
    out = F.when(col.isNull(), F.lit(default))
    for key, value in table.items():
        out = out.when(col == F.lit(key), F.lit(value))
    return out.otherwise(F.lit(default))


def grouped_daily(docs: DataFrame) -> DataFrame:
    """Whole-market daily aggregates; ``docs`` has payload and trade_date."""
    rows = _items(docs, "T string, v double, vw double, o double, h double, l double, c double", keep=("trade_date",))
    volume = F.coalesce("r.v", F.lit(0.0))
    price = F.coalesce("r.vw", "r.c", F.lit(0.0))
    return C.conform(
        rows.select(
            "trade_date", F.col("r.T").alias("ticker"), F.col("r.o").alias("open"), F.col("r.h").alias("high"),
            F.col("r.l").alias("low"), F.col("r.c").alias("close"), volume.alias("volume"),
            (price * volume).alias("dollar_volume"), close_time("trade_date").alias("as_of"),
        ),
        C.DAILY_BARS,
    )


def splits_and_dividends(splits: DataFrame, dividends: DataFrame) -> DataFrame:
    """Corporate actions; stamped at announcement where known, else on the ex-date."""
    s = _items(splits, "ticker string, execution_date string, split_from double, split_to double, announcement_date string")
    ratio = F.col("r.split_to") / F.when(F.col("r.split_from") != 0, F.col("r.split_from"))
    split_rows = s.select(
        _date("r.execution_date").alias("ex_date"), F.col("r.ticker").alias("ticker"), ratio.alias("ratio"),
        F.coalesce(_stamp("r.announcement_date"), _stamp("r.execution_date")).alias("as_of"),
    ).withColumn(
        "action_type", F.when(F.coalesce(F.col("ratio"), F.lit(1.0)) >= 1, "split").otherwise("reverse_split")
    )
    d = _items(dividends, "ticker string, ex_dividend_date string, declaration_date string, cash_amount double")
    dividend_rows = d.select(
        _date("r.ex_dividend_date").alias("ex_date"), F.col("r.ticker").alias("ticker"),
        F.lit("dividend").alias("action_type"), F.col("r.cash_amount").alias("cash_amount"),
        F.coalesce(_stamp("r.declaration_date"), _stamp("r.ex_dividend_date")).alias("as_of"),
    )
    both = split_rows.unionByName(dividend_rows, allowMissingColumns=True)
    return C.conform(both.withColumn("new_ticker", F.lit(None).cast("string")), C.CORPORATE_ACTIONS)


def reference_tickers(active: DataFrame, delisted: DataFrame) -> DataFrame:
    """Listings of active and delisted names, one row per (ticker, list date), active first."""
    schema = (
        "ticker string, name string, type string, primary_exchange string, list_date string, delisted_utc string, "
        "market_cap double, weighted_shares_outstanding double, share_class_shares_outstanding double, "
        "sector string, industry string"
    )
    tagged = _items(active, schema).withColumn("src", F.lit(0)).unionByName(
        _items(delisted, schema).withColumn("src", F.lit(1))
    )
    weighted = F.when(F.col("r.weighted_shares_outstanding") != 0, F.col("r.weighted_shares_outstanding"))
    rows = tagged.select(
        "src",
        F.col("r.ticker").alias("ticker"),
        F.col("r.name").alias("name"),
        _map(F.upper("r.type"), SECURITY_TYPES, "OTHER").alias("security_type"),
        F.coalesce(F.when(F.col("r.primary_exchange") != "", F.col("r.primary_exchange")), F.lit("OTC")).alias("exchange"),
        _date("r.list_date").alias("active_from"),
        _date("r.delisted_utc").alias("active_to"),
        F.col("r.market_cap").alias("market_cap"),
        F.coalesce(weighted, "r.share_class_shares_outstanding").alias("float_shares"),
        F.col("r.sector").alias("sector"),
        F.col("r.industry").alias("industry"),
        _date("r.list_date").cast("timestamp_ntz").alias("as_of"),
    )
    payload = [c for c in rows.columns if c not in ("src", "ticker", "active_from")]
    first = rows.groupBy("ticker", "active_from").agg(
        F.min(F.struct("src", *payload)).alias("r")
    )
    return C.conform(first.select("ticker", "active_from", *[F.col(f"r.{c}").alias(c) for c in payload]), C.TICKER_META)


def earnings_feed(docs: DataFrame) -> DataFrame:
    """Dates with a known announcement are firm; others are revisable and stamped one day ahead."""
    rows = _items(docs, "ticker string, report_date string, session string, announced_on string")
    announced = _stamp("r.announced_on")
    report = _date("r.report_date")
    return C.conform(
        rows.select(
            F.col("r.ticker").alias("ticker"), report.alias("report_date"),
            F.coalesce("r.session", F.lit("unknown")).alias("session"), announced.alias("announced_on"),
            announced.isNull().alias("date_is_revisable"),
            F.coalesce(announced, F.date_sub(report, 1).cast("timestamp_ntz")).alias("as_of"),
        ),
        C.EARNINGS,
    )


def earnings_calendar(docs: DataFrame) -> DataFrame:
    """Calendar variant without announcement times: always revisable."""
    rows = _items(docs, "symbol string, date string, hour string", field="earningsCalendar").where(
        F.col("r.date").isNotNull()
    )
    hour, report = F.lower("r.hour"), _date("r.date")
    return C.conform(
        rows.select(
            F.col("r.symbol").alias("ticker"), report.alias("report_date"),
            F.when(hour.isin(*SESSIONS), hour).otherwise(F.lit("unknown")).alias("session"),
            F.lit(None).cast("timestamp_ntz").alias("announced_on"), F.lit(True).alias("date_is_revisable"),
            F.date_sub(report, 1).cast("timestamp_ntz").alias("as_of"),
        ),
        C.EARNINGS,
    )


def _present(*cols: str) -> Column:
    """First alternative field that is present and not zero."""
    return F.coalesce(*[F.when(F.col(c) != 0, F.col(c)) for c in cols])


def short_interest_feed(docs: DataFrame) -> DataFrame:
    """Stamped at publication; without it, settlement plus a lag that never understates."""
    rows = _items(
        docs,
        "ticker string, settlement_date string, publish_date string, date_published string, short_interest double, "
        "settlement_shares double, short_interest_pct_float double, percent_of_float double, days_to_cover double, "
        "avg_daily_volume_days_to_cover double",
    )
    settled = _date("r.settlement_date")
    published = F.coalesce(_stamp("r.publish_date"), _stamp("r.date_published"))
    return C.conform(
        rows.select(
            F.col("r.ticker").alias("ticker"), settled.alias("settlement_date"),
            _present("r.short_interest", "r.settlement_shares").alias("short_interest_shares"),
            _present("r.short_interest_pct_float", "r.percent_of_float").alias("short_interest_pct_float"),
            _present("r.days_to_cover", "r.avg_daily_volume_days_to_cover").alias("days_to_cover"),
            F.coalesce(published, F.date_add(settled, PUBLISH_LAG_DAYS).cast("timestamp_ntz")).alias("as_of"),
        ),
        C.SHORT_INTEREST,
    )


def minute_aggregates(docs: DataFrame) -> DataFrame:
    """Minute bars stamped in epoch milliseconds UTC, kept from 04:00 up to but not including 09:25 Eastern."""
    rows = _items(docs, "t bigint, o double, h double, l double, c double, v double, n double", keep=("ticker",))
    named = rows.select("ticker", "r.*", F.col("r.t").alias("ms")).withColumn("minute", utc_millis_to_eastern("ms"))
    dated = named.withColumn("trade_date", F.to_date("minute"))
    window = (F.col("minute") >= premarket_open("trade_date")) & (F.col("minute") < premarket_time("trade_date"))
    return C.conform(
        dated.where(window).select(
            "trade_date", "ticker", "minute", F.col("o").alias("open"), F.col("h").alias("high"),
            F.col("l").alias("low"), F.col("c").alias("close"), F.col("v").alias("volume"),
            F.col("n").alias("trade_count"), F.col("minute").alias("as_of"),
        ),
        C.PREMARKET_BARS,
    )


def end_of_day_prices(docs: DataFrame) -> DataFrame:
    """Per-ticker price arrays whose ISO stamps carry a zone suffix that means nothing."""
    rows = docs.select(
        "ticker",
        F.explode(
            F.from_json("payload", "array<struct<date:string,open:double,high:double,low:double,close:double,volume:double>>")
        ).alias("r"),
    )
    close, volume = F.coalesce("r.close", F.lit(0.0)), F.coalesce("r.volume", F.lit(0.0))
    day = _date("r.date")
    return C.conform(
        rows.select(
            day.alias("trade_date"), "ticker", F.col("r.open").alias("open"), F.col("r.high").alias("high"),
            F.col("r.low").alias("low"), close.alias("close"), volume.alias("volume"),
            (close * volume).alias("dollar_volume"), close_time(day).alias("as_of"),
        ),
        C.DAILY_BARS,
    )


def utc_trade_date(stamp: Column) -> Column:
    """Trade date of a UTC-midnight stamp: the UTC calendar date as it is, never shifted to Eastern."""
    return F.to_date(F.substring(stamp.cast("string"), 1, 10))


def captured_lists(docs: DataFrame) -> DataFrame:
    """Captured mover envelopes to ordered, upper-cased (trade_date, list, pos, ticker) rows.

    ``top_movers`` rows appear only when the capture says that list was available;
    the ``sp500`` context list never stands in for it.  The context payload may be
    an object with ``results`` or a bare array; items may name ``symbol`` or ``ticker``.
    """
    item = "array<struct<symbol:string,ticker:string>>"
    top = F.from_json("payload", "struct<trade_date:string,top_movers_available:boolean,top_movers:struct<symbols:array<string>>>")
    base = docs.select(
        top.alias("e"),
        F.get_json_object("payload", "$.sp500.payload").alias("ctx"),
    ).select(
        F.to_date("e.trade_date").alias("trade_date"),
        F.when(F.coalesce("e.top_movers_available", F.lit(False)), F.col("e.top_movers.symbols")).alias("movers"),
        F.transform(
            F.coalesce(
                F.when(F.substring(F.ltrim("ctx"), 1, 1) == "[", F.from_json("ctx", item)),
                F.from_json("ctx", f"struct<results:{item}>")["results"],
            ),
            lambda i: F.coalesce(F.when(i["symbol"] != "", i["symbol"]), i["ticker"]),
        ).alias("context"),
    )
    named = base.select(
        "trade_date",
        F.explode(
            F.array(
                F.struct(F.lit("top_movers").alias("list"), F.col("movers").alias("symbols")),
                F.struct(F.lit("sp500").alias("list"), F.col("context").alias("symbols")),
            )
        ).alias("l"),
    ).select("trade_date", "l.list", F.filter("l.symbols", lambda s: s.isNotNull() & (s != "")).alias("symbols"))
    return named.select("trade_date", "list", F.posexplode("symbols").alias("pos", "ticker")).withColumn(
        "ticker", F.upper("ticker")
    )


def capture_availability(docs: DataFrame) -> DataFrame:
    """(trade_date, top_movers_available) per envelope."""
    e = F.from_json("payload", "struct<trade_date:string,top_movers_available:boolean>")
    return docs.select(e.alias("e")).select(
        F.to_date("e.trade_date").alias("trade_date"),
        F.coalesce("e.top_movers_available", F.lit(False)).alias("top_movers_available"),
    )
