"""Dataset contracts, feature specs and the fixed values shared by operators."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

_D, _N, _S, _I, _B = T.DateType(), T.TimestampNTZType(), T.StringType(), T.IntegerType(), T.BooleanType()
_F = T.DoubleType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


DAILY_BARS = _schema(
    ("trade_date", _D), ("ticker", _S), ("open", _F), ("high", _F), ("low", _F), ("close", _F),
    ("volume", _F), ("dollar_volume", _F), ("as_of", _N),
)
CORPORATE_ACTIONS = _schema(
    ("ex_date", _D), ("ticker", _S), ("action_type", _S), ("ratio", _F), ("cash_amount", _F),
    ("new_ticker", _S), ("as_of", _N),
)
TICKER_META = _schema(
    ("ticker", _S), ("name", _S), ("security_type", _S), ("exchange", _S), ("active_from", _D),
    ("active_to", _D), ("market_cap", _F), ("float_shares", _F), ("sector", _S), ("industry", _S),
    ("as_of", _N),
)
SHORT_INTEREST = _schema(
    ("ticker", _S), ("settlement_date", _D), ("short_interest_shares", _F),
    ("short_interest_pct_float", _F), ("days_to_cover", _F), ("as_of", _N),
)
EARNINGS = _schema(
    ("ticker", _S), ("report_date", _D), ("session", _S), ("announced_on", _N),
    ("date_is_revisable", _B), ("as_of", _N),
)
PREMARKET_BARS = _schema(
    ("trade_date", _D), ("ticker", _S), ("minute", _N), ("open", _F), ("high", _F), ("low", _F),
    ("close", _F), ("volume", _F), ("trade_count", _F), ("as_of", _N),
)
UNIVERSE = _schema(
    ("trade_date", _D), ("ticker", _S), ("security_type", _S), ("exchange", _S), ("flagged_type", _B),
    ("prior_close", _F), ("avg_dollar_volume_20d", _F), ("as_of", _N),
)
LABELS = _schema(
    ("trade_date", _D), ("ticker", _S), ("rank", _I), ("return_t", _F), ("label", _I),
    ("label_spec_version", _S), ("as_of", _N),
)
PRIOR_CLOSE = _schema(("trade_date", _D), ("ticker", _S), ("close", _F), ("as_of", _N))
MARKET_CONTEXT = _schema(
    ("trade_date", _D), ("spy_ret_1d", _F), ("spy_ret_5d", _F), ("vix_level", _F),
    ("iwm_minus_spy_1d", _F), ("movers_10pct_count", _F), ("as_of", _N),
)
HALTS = _schema(("trade_date", _D), ("ticker", _S), ("as_of", _N))
PREDICTIONS = _schema(("trade_date", _D), ("ticker", _S), ("score", _F))

# Thresholds, code lists and bucket edges the results depend on.
ALLOWED_EXCHANGES = ("XNYS", "XNAS", "XASE")
CORE_TYPES = ("CS", "ADR")
FLAGGED_TYPES = ("ETF", "WARRANT", "RIGHT", "UNIT", "SPAC")
SPLIT_ACTIONS = ("split", "reverse_split")
MIN_PRIOR_CLOSE = 1.00
MIN_AVG_DOLLAR_VOLUME = 1_000_000.0
DOLLAR_VOLUME_WINDOW = 20
MAX_STALENESS_SESSIONS = 1
TOP_K = 10
PREMARKET_DOLLAR_FLOOR = 500_000.0
PRICE_EDGES = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0)
MARKET_CAP_EDGES = (50e6, 300e6, 2e9, 10e9, 200e9)
FLOAT_EDGES = (10e6, 50e6, 200e6, 1e9)
MAX_52W_BARS = 252
SECTOR_SUFFIX = {
    "communication services": "communication",
    "consumer": "consumer",
    "consumer discretionary": "consumer",
    "consumer staples": "consumer",
    "energy": "energy",
    "financials": "financials",
    "healthcare": "healthcare",
    "health care": "healthcare",
    "industrials": "industrials",
    "materials": "materials",
    "real estate": "realestate",
    "technology": "technology",
    "information technology": "technology",
    "utilities": "utilities",
}
SECTOR_COLUMNS = tuple(dict.fromkeys(SECTOR_SUFFIX.values()))
SEALED_FROM = "2023-01-01"
UNSEAL_TOKEN = "PREREG_FROZEN"

T1_COLUMNS = (
    "trade_date", "ticker",
    "ret_1d", "ret_5d", "ret_20d", "ret_1d_rank",
    "rvol_5d", "rvol_20d", "vol_of_vol",
    "rel_volume_1d", "rel_volume_5d_trend", "adv_20",
    "price_bucket", "mcap_bucket", "float_bucket",
    "days_since_last_top10", "appearances_30d", "appearances_90d",
    "earnings_today", "earnings_tomorrow", "days_to_earnings", "earnings_date_revisable",
    *(f"sector_{s}" for s in SECTOR_COLUMNS), "sector_other", "is_biotech",
    "short_interest_pct_float", "days_to_cover",
    "dist_from_52w_high", "dist_from_52w_low", "consecutive_streak",
    "mkt_spy_ret_1d", "mkt_spy_ret_5d", "mkt_vix_level", "mkt_iwm_minus_spy_1d",
    "mkt_attention_regime_count",
    "as_of",
)
T2_EXTRA = (
    "premarket_gap_pct", "premarket_dollar_volume", "premarket_rel_volume",
    "premarket_high_to_last_drawdown", "premarket_trade_count", "premarket_first_trade_minutes",
    "overnight_halt_flag",
)
T2_COLUMNS = T1_COLUMNS[:-1] + T2_EXTRA + ("as_of",)
BARS_FEATURES = (
    "xs_vol_rank", "xs_ret_rank", "top90", "logpx", "dist52", "vol20", "vol5", "relvol_prev",
    "ret5", "ret20", "volofvol", "logdv", "prev_ret1", "was_top", "top30",
)
T1B_COLUMNS = ("trade_date", "ticker", *BARS_FEATURES, "as_of")
FORECAST_FEATURES = (
    "tfm_q50", "tfm_q90", "tfm_spread", "tfm_skew_norm", "tfm_upside_ratio", "tfm_q90_xs_rank",
    "tfm_skew_xs_rank",
)
T1B_TFM_COLUMNS = T1B_COLUMNS[:-1] + FORECAST_FEATURES + ("as_of",)
LIQUIDITY_FEATURES = ("log_amihud", "cs_spread_20d", "zero_vol_20d", "adv_pct_rank", "range_20d")


class ContractError(ValueError):
    """A frame does not have the columns or values its contract demands."""


class LeakageError(Exception):
    """A row was used before it was knowable, or a label reached its own features."""


@dataclass(frozen=True)
class FeatureSpec:
    """Column contract of one feature task; its hash names the output folder."""

    task: str
    columns: tuple[str, ...]
    version: str = "1"

    @property
    def spec_hash(self) -> str:
        body = {"task": self.task, "columns": list(self.columns), "version": self.version}
        text = json.dumps(body, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()

    @property
    def features(self) -> list[str]:
        return [c for c in self.columns if c not in ("trade_date", "ticker", "as_of")]

    def check(self, df: DataFrame) -> DataFrame:
        """Exact columns in exact order; reads no data."""
        got, want = list(df.columns), list(self.columns)
        if got != want:
            missing = [c for c in want if c not in got]
            extra = [c for c in got if c not in want]
            what = f"missing={missing} extra={extra}" if missing or extra else "columns out of order"
            raise ContractError(f"{self.task} [{self.spec_hash[:12]}]: {what}")
        return df


T1_SPEC = FeatureSpec("T1", T1_COLUMNS)
T2_SPEC = FeatureSpec("T2", T2_COLUMNS)
T1B_SPEC = FeatureSpec("T1B", T1B_COLUMNS)
T1B_TFM_SPEC = FeatureSpec("T1B_TFM", T1B_TFM_COLUMNS)


def require(df: DataFrame, columns: Iterable[str], who: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"{who}: missing required column(s) {missing}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to a contract: select, order, cast.

    A missing column is refused at plan time.  A null in a boolean column is
    refused while the rows stream by (``raise_error`` in the projection), so the
    guard costs no extra pass.
    """
    require(df, schema.fieldNames(), "conform")
    out = []
    for field in schema:
        col = F.col(field.name).cast(field.dataType)
        if isinstance(field.dataType, T.BooleanType):
            col = F.coalesce(col, F.raise_error(F.lit(f"null in boolean column {field.name}")).cast(_B))
        out.append(col.alias(field.name))
    return df.select(*out)
