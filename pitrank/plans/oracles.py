"""Equivalent SQL for the registered queries.

``CTES`` holds the shared logical tables; ``build`` stitches the ones a query
needs in dependency order.  Dates and instants are rendered as ISO text on both
sides so results compare by value.
"""

from __future__ import annotations

import re

from pitrank import contracts as C
from pitrank.plans import catalog as P

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def build(select: str) -> str:
    """``WITH`` only the CTEs reachable from ``select``."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(select)
    if not order:
        return select.strip()
    ctes = ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in order)
    return f"WITH {ctes}\n{select.strip()}"


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


cte("bars_v", """
SELECT CAST(l_shipdate AS DATE) AS trade_date, 'T' || l_suppkey AS ticker,
       arg_min(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS open,
       max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
       arg_max(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS close,
       sum(l_quantity) AS volume,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS dollar_volume,
       CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + INTERVAL 16 HOUR AS as_of
FROM lineitem GROUP BY 1, 2, 9
""")
cte("cal_v", """
SELECT trade_date AS session, row_number() OVER (ORDER BY trade_date) AS session_idx,
       lead(trade_date) OVER (ORDER BY trade_date) AS next_session,
       lag(trade_date) OVER (ORDER BY trade_date) AS prev_session
FROM (SELECT DISTINCT trade_date FROM bars_v)
""")
cte("meta_v", """
SELECT 'T' || s_suppkey AS ticker, s_name AS name,
       list_value('CS', 'ADR', 'CS', 'ETF', 'WARRANT', 'CS', 'UNIT', 'SPAC', 'OTHER')[s_suppkey % 9 + 1] AS security_type,
       list_value('XNYS', 'XNAS', 'XASE', 'XNAS', 'OTC')[n_regionkey + 1] AS exchange,
       CAST(DATE '1993-06-01' + CAST(s_suppkey * 37 % 1500 AS INTEGER) AS DATE) AS active_from,
       CASE WHEN s_suppkey % 7 = 0 THEN CAST(DATE '1993-06-01' + CAST(s_suppkey * 37 % 1500 + 2000 AS INTEGER) AS DATE) END AS active_to,
       abs(s_acctbal) * 1e6 * (v + 1) AS market_cap,
       CASE WHEN s_suppkey % 5 <> 0 THEN abs(s_acctbal) * 1e4 END AS float_shares,
       CASE WHEN s_suppkey % 12 <> 11 THEN list_value('Technology', 'Health Care', 'Energy', ' Financials ', 'Consumer Staples',
            'Utilities', 'Materials', 'Industrials', 'Real Estate', 'Communication Services', 'Mining')[s_suppkey % 11 + 1] END AS sector,
       list_value('Software', 'Biotechnology', 'Banks', 'Oil')[s_nationkey % 4 + 1] AS industry,
       CAST(CAST(DATE '1993-06-01' + CAST(s_suppkey * 37 % 1500 + v * 900 AS INTEGER) AS DATE) AS TIMESTAMP) AS as_of
FROM supplier JOIN nation ON s_nationkey = n_nationkey, (SELECT unnest([0, 1]) AS v)
""")
cte("actions_v", """
SELECT CAST(o_orderdate AS DATE) AS ex_date, 'T' || o_custkey AS ticker,
       CASE left(o_orderpriority, 1) WHEN '1' THEN 'split' WHEN '2' THEN 'reverse_split'
            WHEN '3' THEN 'ticker_change' ELSE 'dividend' END AS action_type,
       CASE left(o_orderpriority, 1) WHEN '1' THEN 2.0::DOUBLE WHEN '2' THEN 0.1::DOUBLE END AS ratio,
       CASE WHEN left(o_orderpriority, 1) NOT IN ('1', '2', '3') THEN o_totalprice / 1e5 END AS cash_amount,
       CASE WHEN left(o_orderpriority, 1) = '3' THEN 'N' || o_custkey END AS new_ticker,
       CAST(CAST(o_orderdate AS DATE) - 5 AS TIMESTAMP) AS as_of
FROM orders
""")
cte("earnings_v", """
SELECT ticker, report_date, CASE WHEN o_orderkey % 2 = 0 THEN 'bmo' ELSE 'amc' END AS session,
       announced_on, announced_on IS NULL AS date_is_revisable,
       coalesce(announced_on, CAST(report_date - 1 AS TIMESTAMP)) AS as_of
FROM (SELECT 'T' || o_custkey AS ticker, CAST(o_orderdate AS DATE) + 30 AS report_date, o_orderkey,
             CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS TIMESTAMP) END AS announced_on,
             row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS rn
      FROM orders) WHERE rn = 1
""")
cte("si_v", """
SELECT 'T' || o_custkey AS ticker, CAST(o_orderdate AS DATE) AS settlement_date,
       o_totalprice AS short_interest_shares, o_totalprice / 1e4 AS short_interest_pct_float,
       o_totalprice / 1e5 AS days_to_cover, CAST(CAST(o_orderdate AS DATE) + 14 AS TIMESTAMP) AS as_of
FROM orders
""")
cte("stats_v", """
SELECT b.ticker, b.trade_date, c.session_idx, b.close AS prior_close,
       avg(dollar_volume) OVER w AS avg_dollar_volume_20d,
       lead(c.session_idx) OVER (PARTITION BY b.ticker ORDER BY b.trade_date) AS next_idx
FROM bars_v b JOIN cal_v c ON b.trade_date = c.session
WINDOW w AS (PARTITION BY b.ticker ORDER BY b.trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
""")
cte("elig_v", f"""
SELECT s.session AS trade_date, x.ticker, x.security_type, x.exchange, x.prior_close, x.avg_dollar_volume_20d
FROM cal_v s JOIN (
  SELECT st.*, m.security_type, m.exchange, m.active_from, m.active_to, m.as_of
  FROM stats_v st JOIN meta_v m ON st.ticker = m.ticker
  WHERE m.exchange IN {in_list(C.ALLOWED_EXCHANGES)} AND m.security_type IN {in_list(C.CORE_TYPES + C.FLAGGED_TYPES)}
    AND st.prior_close >= {P.MIN_CLOSE} AND st.avg_dollar_volume_20d >= {P.MIN_DOLLAR_VOLUME}
) x ON s.session_idx > x.session_idx AND s.session_idx <= x.session_idx + {P.MAX_STALENESS}
   AND (x.next_idx IS NULL OR s.session_idx <= x.next_idx)
   AND x.as_of <= CAST(s.session AS TIMESTAMP) - INTERVAL 8 HOUR
   AND x.active_from <= s.session AND (x.active_to IS NULL OR x.active_to >= s.session)
QUALIFY row_number() OVER (PARTITION BY s.session, x.ticker ORDER BY x.as_of DESC) = 1
""")
cte("universe_v", f"""
SELECT trade_date, ticker, security_type, exchange, security_type IN {in_list(C.FLAGGED_TYPES)} AS flagged_type,
       prior_close, avg_dollar_volume_20d, CAST(trade_date AS TIMESTAMP) - INTERVAL 8 HOUR AS as_of
FROM elig_v
""")
cte("splits_v", f"""
SELECT DISTINCT ex_date AS trade_date, ticker FROM actions_v WHERE action_type IN {in_list(C.SPLIT_ACTIONS)}
""")
cte("labels_v", f"""
SELECT u.trade_date, u.ticker,
       row_number() OVER (PARTITION BY u.trade_date ORDER BY b.close / u.prior_close - 1.0 DESC, u.ticker) AS rank,
       b.close / u.prior_close - 1.0 AS return_t,
       CASE WHEN row_number() OVER (PARTITION BY u.trade_date ORDER BY b.close / u.prior_close - 1.0 DESC, u.ticker) <= {C.TOP_K} THEN 1 ELSE 0 END AS label,
       'v1' AS label_spec_version, CAST(u.trade_date AS TIMESTAMP) + INTERVAL 16 HOUR AS as_of
FROM universe_v u JOIN bars_v b ON u.trade_date = b.trade_date AND u.ticker = b.ticker
WHERE NOT EXISTS (SELECT 1 FROM splits_v s WHERE s.trade_date = u.trade_date AND s.ticker = u.ticker)
""")

ORACLES: dict[str, str] = {}


def oracle(name: str, select: str) -> None:
    ORACLES[name] = select


oracle("daily_bars", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, ticker, open, high, low, close, volume, dollar_volume,
       CAST(as_of AS VARCHAR) AS as_of FROM bars_v""")
oracle("universe", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, ticker, security_type, exchange, flagged_type, prior_close,
       round(avg_dollar_volume_20d, 6) AS avg_dollar_volume_20d, CAST(as_of AS VARCHAR) AS as_of FROM universe_v""")
oracle("labels_topk", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, ticker, CAST(rank AS INTEGER) AS rank, return_t,
       CAST(label AS INTEGER) AS label, label_spec_version, CAST(as_of AS VARCHAR) AS as_of FROM labels_v""")


# --- bars-only features ---------------------------------------------------------------

cte("bu0_v", """
SELECT *, close / prev_close - 1.0 AS ret FROM (
  SELECT trade_date, ticker, close, high, low, volume, dollar_volume,
         lag(close) OVER t AS prev_close, lag(trade_date) OVER t AS prev_date,
         avg(dollar_volume) OVER w AS adv20
  FROM bars_v
  WINDOW t AS (PARTITION BY ticker ORDER BY trade_date),
         w AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
WHERE prev_close IS NOT NULL
""")
cte("bu_v", """
SELECT *, CASE WHEN rank <= 10 THEN 1 ELSE 0 END AS label
FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY ret DESC, ticker) AS rank FROM bu0_v)
""")
cte("bf1_v", """
SELECT trade_date, ticker, prev_date,
       lag(close) OVER t / lag(close, 6) OVER t - 1.0 AS ret5,
       lag(close) OVER t / lag(close, 21) OVER t - 1.0 AS ret20,
       lag(ret) OVER t AS prev_ret1,
       CASE WHEN count(ret) OVER w5 >= 3 THEN stddev_samp(ret) OVER w5 END AS vol5,
       CASE WHEN count(ret) OVER w20 >= 10 THEN stddev_samp(ret) OVER w20 END AS vol20,
       lag(dollar_volume / adv20) OVER t AS relvol_prev,
       ln(1 + lag(dollar_volume) OVER t) AS logdv,
       ln(lag(close) OVER t) AS logpx,
       CASE WHEN count(close) OVER w252 >= 60 THEN lag(close) OVER t / max(close) OVER w252 - 1.0 END AS dist52,
       CAST(lag(label) OVER t AS DOUBLE) AS was_top,
       CAST(sum(label) OVER w30 AS DOUBLE) AS top30,
       CAST(sum(label) OVER w90 AS DOUBLE) AS top90
FROM bu_v
WINDOW t AS (PARTITION BY ticker ORDER BY trade_date),
       w5 AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
       w20 AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
       w30 AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),
       w90 AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING),
       w252 AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)
""")
cte("bf_v", """
SELECT *, CASE WHEN count(vol5) OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 10
               THEN stddev_samp(vol5) OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS volofvol,
       CASE WHEN prev_ret1 IS NOT NULL THEN
         (rank() OVER (PARTITION BY trade_date ORDER BY prev_ret1 NULLS LAST)
          + (count(*) OVER (PARTITION BY trade_date, prev_ret1) - 1) / 2.0::DOUBLE)
         / count(prev_ret1) OVER (PARTITION BY trade_date) END AS xs_ret_rank,
       CASE WHEN vol20 IS NOT NULL THEN
         (rank() OVER (PARTITION BY trade_date ORDER BY vol20 NULLS LAST)
          + (count(*) OVER (PARTITION BY trade_date, vol20) - 1) / 2.0::DOUBLE)
         / count(vol20) OVER (PARTITION BY trade_date) END AS xs_vol_rank,
       CAST(prev_date AS TIMESTAMP) + INTERVAL 16 HOUR AS as_of
FROM bf1_v
""")
oracle("bars_universe", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, ticker, close, high, low, volume, dollar_volume, prev_close,
       CAST(prev_date AS VARCHAR) AS prev_date, round(adv20, 6) AS adv20, ret, CAST(rank AS INTEGER) AS rank, CAST(label AS INTEGER) AS label FROM bu_v""")
oracle("bars_t1", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, ticker, xs_vol_rank, xs_ret_rank, top90, round(logpx, 8) AS logpx, dist52,
       round(vol20, 8) AS vol20, round(vol5, 8) AS vol5, round(relvol_prev, 8) AS relvol_prev, ret5, ret20, round(volofvol, 8) AS volofvol,
       round(logdv, 8) AS logdv, prev_ret1, was_top, top30, CAST(as_of AS VARCHAR) AS as_of FROM bf_v""")
oracle("warmup_drop", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, ticker, CAST(as_of AS VARCHAR) AS as_of FROM bf_v
WHERE xs_vol_rank IS NOT NULL AND xs_ret_rank IS NOT NULL AND top90 IS NOT NULL AND logpx IS NOT NULL AND dist52 IS NOT NULL
  AND vol20 IS NOT NULL AND vol5 IS NOT NULL AND relvol_prev IS NOT NULL AND ret5 IS NOT NULL AND ret20 IS NOT NULL
  AND volofvol IS NOT NULL AND logdv IS NOT NULL AND prev_ret1 IS NOT NULL AND was_top IS NOT NULL AND top30 IS NOT NULL""")
cte("liq_v", """
SELECT trade_date, ticker, prev_date, ret, dollar_volume, volume, adv20, (high - low) / close AS rng,
       (ln(high / low) * ln(high / low) + lag(ln(high / low) * ln(high / low)) OVER t) AS beta,
       ln(greatest(high, lag(high) OVER t) / least(low, lag(low) OVER t)) AS g,
       lag(close) OVER t IS NOT NULL AS has_prev
FROM bu_v WINDOW t AS (PARTITION BY ticker ORDER BY trade_date)
""")
cte("liq2_v", """
SELECT *, CASE WHEN has_prev THEN (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2.0::DOUBLE)) - sqrt(g * g / (3 - 2 * sqrt(2.0::DOUBLE))) END AS alpha FROM liq_v
""")
cte("liq3_v", """
SELECT *, CASE WHEN alpha IS NOT NULL THEN greatest(2 * (exp(alpha) - 1) / (1 + exp(alpha)), 0) END AS spread FROM liq2_v
""")
cte("liq4_v", """
SELECT trade_date, ticker, prev_date,
       CASE WHEN count(ret) OVER w >= 10 THEN ln(avg(abs(ret) / dollar_volume) OVER w) END AS log_amihud,
       CASE WHEN count(spread) OVER w >= 10 THEN avg(spread) OVER w END AS cs_spread_20d,
       CAST(sum(CASE WHEN volume = 0 THEN 1 ELSE 0 END) OVER w AS DOUBLE) AS zero_vol_20d,
       lag(adv20) OVER t AS adv,
       CASE WHEN count(rng) OVER w >= 10 THEN avg(rng) OVER w END AS range_20d
FROM liq3_v
WINDOW t AS (PARTITION BY ticker ORDER BY trade_date),
       w AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
""")
oracle("liquidity_features", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, ticker, round(log_amihud, 6) AS log_amihud, round(cs_spread_20d, 6) AS cs_spread_20d,
       zero_vol_20d, CASE WHEN adv IS NOT NULL THEN
         (rank() OVER (PARTITION BY trade_date ORDER BY adv NULLS LAST)
          + (count(*) OVER (PARTITION BY trade_date, adv) - 1) / 2.0::DOUBLE)
         / count(adv) OVER (PARTITION BY trade_date) END AS adv_pct_rank,
       round(range_20d, 6) AS range_20d,
       CAST(CAST(prev_date AS TIMESTAMP) + INTERVAL 16 HOUR AS VARCHAR) AS as_of FROM liq4_v""")

# --- T1 ---------------------------------------------------------------------------------

cte("r1_v", """
SELECT *, sign(ret) AS sgn, row_number() OVER (PARTITION BY ticker ORDER BY trade_date) AS n FROM (
  SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY trade_date) - 1.0 AS ret FROM bars_v)
""")
cte("r2_v", """
SELECT *, CASE WHEN n >= 20 THEN avg(volume) OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS adv_20,
       CASE WHEN count(ret) OVER w5 >= 5 THEN stddev_samp(ret) OVER w5 END AS std5,
       CASE WHEN sgn = lag(sgn) OVER (PARTITION BY ticker ORDER BY trade_date) THEN NULL ELSE n END AS start_n
FROM r1_v WINDOW w5 AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
""")
cte("r3_v", """
SELECT *, volume / adv_20 AS rv, last_value(start_n IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_n FROM r2_v
""")

def bucket_sql(col: str, edges) -> str:
    arms = " ".join(f"WHEN {col} < {e} THEN {float(i)}" for i, e in enumerate(edges))
    return f"CAST(CASE WHEN {col} IS NULL THEN NULL {arms} ELSE {float(len(edges))} END AS DOUBLE)"


cte("barfeat_v", f"""
SELECT trade_date, ticker, ret AS ret_1d, close / lag(close, 5) OVER t - 1.0 AS ret_5d, close / lag(close, 20) OVER t - 1.0 AS ret_20d,
       round(std5, 8) AS rvol_5d,
       round(CASE WHEN count(ret) OVER w20 >= 20 THEN stddev_samp(ret) OVER w20 END, 8) AS rvol_20d,
       round(CASE WHEN n >= 15 THEN stddev_samp(std5) OVER w10 END, 8) AS vol_of_vol,
       rv AS rel_volume_1d,
       round(CASE WHEN n >= 24 THEN regr_slope(rv, n) OVER w5 END, 8) AS rel_volume_5d_trend,
       adv_20, {bucket_sql("close", C.PRICE_EDGES)} AS price_bucket,
       close / max(close) OVER w252 - 1.0 AS dist_from_52w_high, close / min(close) OVER w252 - 1.0 AS dist_from_52w_low,
       CAST(CASE WHEN ret IS NULL OR ret = 0 THEN 0 ELSE sgn * (n - run_n + 1) END AS DOUBLE) AS consecutive_streak
FROM r3_v
WINDOW t AS (PARTITION BY ticker ORDER BY trade_date),
       w5 AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
       w10 AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
       w20 AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
       w252 AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)
""")
oracle("t1_bar_features", "SELECT * REPLACE (CAST(trade_date AS VARCHAR) AS trade_date) FROM barfeat_v")
cte("mkt_v", """
SELECT trade_date, spy_ret_1d, vix_level, vix_level - spy_ret_1d AS iwm_minus_spy_1d, movers AS movers_10pct_count,
       coalesce(lag(spy_ret_1d, 4) OVER o, 0) + coalesce(lag(spy_ret_1d, 3) OVER o, 0) + coalesce(lag(spy_ret_1d, 2) OVER o, 0) + coalesce(lag(spy_ret_1d, 1) OVER o, 0) + coalesce(spy_ret_1d, 0) AS spy_ret_5d
FROM (SELECT trade_date, CAST(sum(CAST(ret AS DECIMAL(18,8))) AS DOUBLE) / nullif(count(ret), 0) AS spy_ret_1d,
             CAST(sum(CAST(abs(ret) AS DECIMAL(18,8))) AS DOUBLE) / nullif(count(ret), 0) AS vix_level,
             CAST(count(*) FILTER (WHERE abs(ret) > 0.10) AS DOUBLE) AS movers
      FROM r1_v GROUP BY trade_date)
WINDOW o AS (ORDER BY trade_date)
""")
cte("grid_v", """
SELECT s.session AS t, f.* FROM (
  SELECT f.*, c.session_idx, lead(c.session_idx) OVER (PARTITION BY f.ticker ORDER BY f.trade_date) AS next_idx
  FROM barfeat_v f JOIN cal_v c ON f.trade_date = c.session) f
JOIN cal_v s ON s.session_idx > f.session_idx AND (f.next_idx IS NULL OR s.session_idx <= f.next_idx)
""")
cte("gmeta_v", """
SELECT g.t, g.ticker, m.sector, m.industry, m.market_cap, m.float_shares FROM grid_v g JOIN meta_v m
  ON g.ticker = m.ticker AND m.as_of <= CAST(g.t AS TIMESTAMP) - INTERVAL 8 HOUR
QUALIFY row_number() OVER (PARTITION BY g.t, g.ticker ORDER BY m.as_of DESC) = 1
""")
cte("gsi_v", """
SELECT g.t, g.ticker, m.short_interest_pct_float, m.days_to_cover FROM grid_v g JOIN si_v m
  ON g.ticker = m.ticker AND m.as_of <= CAST(g.t AS TIMESTAMP) - INTERVAL 8 HOUR
QUALIFY row_number() OVER (PARTITION BY g.t, g.ticker ORDER BY m.as_of DESC, m.settlement_date DESC, m.short_interest_shares DESC) = 1
""")
cte("gearn_v", """
SELECT g.t, g.ticker, m.report_date, m.date_is_revisable FROM grid_v g JOIN earnings_v m
  ON g.ticker = m.ticker AND m.report_date >= g.t AND m.as_of <= CAST(g.t AS TIMESTAMP) - INTERVAL 8 HOUR
QUALIFY row_number() OVER (PARTITION BY g.t, g.ticker ORDER BY m.report_date) = 1
""")
cte("gapp_v", """
SELECT g.t, g.ticker, max(p.trade_date) AS last_p,
       count(*) FILTER (WHERE p.trade_date >= g.t - 30) AS a30, count(*) FILTER (WHERE p.trade_date >= g.t - 90) AS a90
FROM grid_v g JOIN (SELECT ticker, trade_date FROM labels_v WHERE label = 1) p
  ON g.ticker = p.ticker AND p.trade_date < g.t GROUP BY 1, 2
""")
cte("gmkt_v", """
SELECT c.session AS t, m.* FROM cal_v c JOIN mkt_v m ON m.trade_date = c.prev_session
""")

def sector_sql() -> str:
    arms = []
    for suffix in C.SECTOR_COLUMNS:
        names = in_list(k for k, v in C.SECTOR_SUFFIX.items() if v == suffix)
        arms.append(f"CAST(coalesce(lower(trim(m.sector)) IN {names}, false) AS INTEGER) AS sector_{suffix}")
    arms.append(f"CAST(NOT coalesce(lower(trim(m.sector)) IN {in_list(C.SECTOR_SUFFIX)}, false) AS INTEGER) AS sector_other")
    arms.append("CAST(coalesce(contains(lower(trim(m.industry)), 'biotech'), false) AS INTEGER) AS is_biotech")
    return ", ".join(arms)


cte("t1_v", f"""
SELECT g.t AS trade_date, g.ticker, g.ret_1d, g.ret_5d, g.ret_20d,
       CASE WHEN g.ret_1d IS NOT NULL THEN CAST(rank() OVER (PARTITION BY g.t ORDER BY g.ret_1d DESC NULLS LAST) AS DOUBLE) END AS ret_1d_rank,
       g.rvol_5d, g.rvol_20d, g.vol_of_vol, g.rel_volume_1d, g.rel_volume_5d_trend, g.adv_20, g.price_bucket,
       {bucket_sql("m.market_cap", C.MARKET_CAP_EDGES)} AS mcap_bucket, {bucket_sql("m.float_shares", C.FLOAT_EDGES)} AS float_bucket,
       CAST(g.t - p.last_p AS DOUBLE) AS days_since_last_top10,
       CAST(coalesce(p.a30, 0) AS INTEGER) AS appearances_30d, CAST(coalesce(p.a90, 0) AS INTEGER) AS appearances_90d,
       CAST(coalesce(e.report_date = g.t, false) AS INTEGER) AS earnings_today,
       CAST(coalesce(e.report_date = g.t + 1, false) AS INTEGER) AS earnings_tomorrow,
       CAST(e.report_date - g.t AS DOUBLE) AS days_to_earnings, coalesce(e.date_is_revisable, false) AS earnings_date_revisable,
       {sector_sql()},
       s.short_interest_pct_float, s.days_to_cover, g.dist_from_52w_high, g.dist_from_52w_low, g.consecutive_streak,
       k.spy_ret_1d AS mkt_spy_ret_1d, k.spy_ret_5d AS mkt_spy_ret_5d, k.vix_level AS mkt_vix_level,
       k.iwm_minus_spy_1d AS mkt_iwm_minus_spy_1d, k.movers_10pct_count AS mkt_attention_regime_count,
       CAST(g.t AS TIMESTAMP) - INTERVAL 8 HOUR AS as_of
FROM grid_v g
LEFT JOIN gmeta_v m ON g.t = m.t AND g.ticker = m.ticker
LEFT JOIN gsi_v s ON g.t = s.t AND g.ticker = s.ticker
LEFT JOIN gearn_v e ON g.t = e.t AND g.ticker = e.ticker
LEFT JOIN gapp_v p ON g.t = p.t AND g.ticker = p.ticker
LEFT JOIN gmkt_v k ON g.t = k.t
""")
oracle("t1_features", "SELECT * REPLACE (CAST(trade_date AS VARCHAR) AS trade_date, CAST(as_of AS VARCHAR) AS as_of) FROM t1_v")


# Late bars by the definition: on each session, all bars that have arrived by then.
cte("late_v", """
SELECT b.*, c.session_idx, CAST(b.trade_date + 1 + CAST(CASE WHEN (s * 31 + d * 7) % 20 = 0 THEN 3 + (s + d) % 60 ELSE 0 END AS INTEGER) AS DATE) AS usable
FROM (SELECT *, CAST(substr(ticker, 2) AS BIGINT) AS s, trade_date - DATE '1992-01-01' AS d FROM bars_v) b
JOIN cal_v c ON b.trade_date = c.session
""")
cte("latest_v", f"""
SELECT c.session AS t, x.ticker, max(x.trade_date) AS bar_date, arg_max(x.close, x.trade_date) AS prior_close
FROM late_v x JOIN cal_v c ON x.usable <= c.session AND c.session_idx > x.session_idx AND c.session_idx <= x.session_idx + {P.MAX_STALENESS}
GROUP BY 1, 2
""")
cte("lateadv_v", """
SELECT t, ticker, any_value(prior_close) AS prior_close, avg(dollar_volume) AS adv FROM (
  SELECT a.t, a.ticker, a.prior_close, x.dollar_volume FROM latest_v a
  JOIN late_v x ON x.ticker = a.ticker AND x.usable <= a.t AND x.trade_date <= a.bar_date
  QUALIFY row_number() OVER (PARTITION BY a.t, a.ticker ORDER BY x.trade_date DESC) <= 20)
GROUP BY 1, 2
""")
oracle("late_bars_universe", f"""
SELECT CAST(a.t AS VARCHAR) AS trade_date, a.ticker, m.security_type, m.exchange,
       m.security_type IN {in_list(C.FLAGGED_TYPES)} AS flagged_type, a.prior_close,
       round(a.adv, 6) AS avg_dollar_volume_20d, CAST(CAST(a.t AS TIMESTAMP) - INTERVAL 8 HOUR AS VARCHAR) AS as_of
FROM lateadv_v a JOIN meta_v m ON a.ticker = m.ticker AND m.as_of <= CAST(a.t AS TIMESTAMP) - INTERVAL 8 HOUR
 AND m.active_from <= a.t AND (m.active_to IS NULL OR m.active_to >= a.t)
 AND m.exchange IN {in_list(C.ALLOWED_EXCHANGES)} AND m.security_type IN {in_list(C.CORE_TYPES + C.FLAGGED_TYPES)}
WHERE a.prior_close >= {P.MIN_CLOSE} AND a.adv >= {P.MIN_DOLLAR_VOLUME}
QUALIFY row_number() OVER (PARTITION BY a.t, a.ticker ORDER BY m.as_of DESC) = 1""")
cte("lateseq_v", """
SELECT t, ticker, close, n, close / lead(close) OVER (PARTITION BY t, ticker ORDER BY n) - 1.0 AS ret
FROM (SELECT a.trade_date AS t, a.ticker, x.close, row_number() OVER (PARTITION BY a.trade_date, a.ticker ORDER BY x.trade_date DESC) AS n
      FROM late_v a JOIN late_v x ON x.ticker = a.ticker AND x.usable <= a.trade_date)
""")
oracle("late_bars_features", """
SELECT CAST(t AS VARCHAR) AS trade_date, ticker, max(ret) FILTER (WHERE n = 1) AS ret_1d,
       max(close) FILTER (WHERE n = 1) / max(close) FILTER (WHERE n = 6) - 1.0 AS ret_5d,
       max(close) FILTER (WHERE n = 1) / max(close) FILTER (WHERE n = 21) - 1.0 AS ret_20d,
       round(CASE WHEN count(ret) FILTER (WHERE n <= 20) >= 20 THEN stddev_samp(ret) FILTER (WHERE n <= 20) END, 8) AS rvol_20d,
       max(close) FILTER (WHERE n = 1) / max(close) FILTER (WHERE n <= 252) - 1.0 AS dist_from_52w_high,
       max(close) FILTER (WHERE n = 1) / min(close) FILTER (WHERE n <= 252) - 1.0 AS dist_from_52w_low,
       CAST(coalesce(max(sgn) FILTER (WHERE n = 1), 0) * (coalesce(min(n) FILTER (WHERE sgn IS DISTINCT FROM sgn1), 1) - 1) AS DOUBLE) AS consecutive_streak
FROM (SELECT *, sign(ret) AS sgn, first_value(sign(ret)) OVER (PARTITION BY t, ticker ORDER BY n) AS sgn1 FROM lateseq_v)
GROUP BY t, ticker""")


oracle("asof_meta", """
SELECT CAST(b.trade_date AS VARCHAR) AS trade_date, b.ticker, m.security_type, m.exchange, m.market_cap
FROM bars_v b LEFT JOIN meta_v m ON b.ticker = m.ticker AND m.as_of <= CAST(b.trade_date AS TIMESTAMP) - INTERVAL 8 HOUR
QUALIFY row_number() OVER (PARTITION BY b.trade_date, b.ticker ORDER BY m.as_of DESC NULLS LAST) = 1""")
oracle("short_interest_asof", """
SELECT CAST(b.trade_date AS VARCHAR) AS trade_date, b.ticker, m.short_interest_pct_float, m.days_to_cover
FROM bars_v b LEFT JOIN si_v m ON b.ticker = m.ticker AND m.as_of <= CAST(b.trade_date AS TIMESTAMP) - INTERVAL 8 HOUR
QUALIFY row_number() OVER (PARTITION BY b.trade_date, b.ticker ORDER BY m.as_of DESC NULLS LAST, m.settlement_date DESC, m.short_interest_shares DESC) = 1""")
oracle("pit_read", """
SELECT ticker, count(*) AS n_bars, CAST(max(trade_date) AS VARCHAR) AS last_date FROM bars_v
WHERE as_of <= TIMESTAMP '1998-12-31 16:00:00' GROUP BY ticker""")
oracle("next_session", """
SELECT CAST(session AS VARCHAR) AS session, session_idx, CAST(next_session AS VARCHAR) AS next_session, CAST(prev_session AS VARCHAR) AS prev_session FROM cal_v""")
oracle("staleness", f"""
SELECT CAST(s.session AS VARCHAR) AS trade_date, x.ticker, CAST(x.trade_date AS VARCHAR) AS bar_date, x.prior_close, round(x.avg_dollar_volume_20d, 6) AS avg_dollar_volume_20d
FROM stats_v x JOIN cal_v s ON s.session_idx > x.session_idx AND s.session_idx <= x.session_idx + {P.MAX_STALENESS}
 AND (x.next_idx IS NULL OR s.session_idx <= x.next_idx)""")
oracle("earnings_next", """
SELECT m.ticker, CAST(c.session AS VARCHAR) AS trade_date, CAST(m.report_date AS VARCHAR) AS report_date, m.date_is_revisable
FROM earnings_v m JOIN cal_v c ON m.report_date >= c.session AND m.as_of <= CAST(c.session AS TIMESTAMP) - INTERVAL 8 HOUR
QUALIFY row_number() OVER (PARTITION BY m.ticker, c.session ORDER BY m.report_date) = 1""")
oracle("market_context", """
SELECT CAST(c.session AS VARCHAR) AS trade_date, m.spy_ret_1d AS mkt_spy_ret_1d, m.spy_ret_5d AS mkt_spy_ret_5d,
       m.vix_level AS mkt_vix_level, m.iwm_minus_spy_1d AS mkt_iwm_minus_spy_1d,
       m.movers_10pct_count AS mkt_attention_regime_count
FROM cal_v c LEFT JOIN mkt_v m ON m.trade_date = c.prev_session""")
cte("app_v", """
SELECT ticker, day, max(p) AS p, sum(d30) AS d30, sum(d90) AS d90 FROM (
  SELECT ticker, trade_date + 1 AS day, trade_date AS p, 1 AS d30, 1 AS d90 FROM labels_v WHERE label = 1
  UNION ALL SELECT ticker, trade_date + 31, NULL, -1, 0 FROM labels_v WHERE label = 1
  UNION ALL SELECT ticker, trade_date + 91, NULL, 0, -1 FROM labels_v WHERE label = 1) GROUP BY ticker, day
""")
oracle("appearances", """
SELECT ticker, CAST(day AS VARCHAR) AS day, CAST(max(p) OVER w AS VARCHAR) AS last_positive,
       CAST(sum(d30) OVER w AS BIGINT) AS appearances_30d, CAST(sum(d90) OVER w AS BIGINT) AS appearances_90d
FROM app_v WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
oracle("buckets", f"""
SELECT ticker, CAST(as_of AS VARCHAR) AS as_of, {bucket_sql("market_cap", C.MARKET_CAP_EDGES)} AS mcap_bucket,
       {bucket_sql("float_shares", C.FLOAT_EDGES)} AS float_bucket FROM meta_v""")
oracle("sector_flags", f"SELECT m.ticker, CAST(m.as_of AS VARCHAR) AS as_of, {sector_sql()} FROM meta_v m")
oracle("missing_bars", """
SELECT CAST(u.trade_date AS VARCHAR) AS trade_date, u.ticker FROM universe_v u
WHERE NOT EXISTS (SELECT 1 FROM bars_v b WHERE b.trade_date = u.trade_date AND b.ticker = u.ticker)""")
oracle("topk_returns", "SELECT CAST(trade_date AS VARCHAR) AS trade_date, ticker, return_t, rank FROM labels_v WHERE label = 1")

# --- T2 ---------------------------------------------------------------------------------

cte("ticks_v", """
SELECT CAST(ts AS DATE) AS trade_date, 'T' || user_id AS ticker, date_trunc('minute', ts) AS minute, ts, event_id, value, event_type FROM events
""")
cte("minutes_v", """
SELECT trade_date, ticker, minute, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, row(ts, event_id)) AS close, CAST(count(*) * 100 AS DOUBLE) AS volume, CAST(count(*) AS DOUBLE) AS trade_count, minute AS as_of
FROM ticks_v GROUP BY trade_date, ticker, minute
""")
cte("ebars_v", """
SELECT trade_date, ticker, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, row(ts, event_id)) AS close, CAST(count(*) * 100 AS DOUBLE) AS volume,
       CAST(sum(CAST(value * 100 AS DECIMAL(18,4))) AS DOUBLE) AS dollar_volume, CAST(trade_date AS TIMESTAMP) + INTERVAL 16 HOUR AS as_of
FROM ticks_v GROUP BY trade_date, ticker
""")
cte("ecal_v", CTES["cal_v"].replace("bars_v", "ebars_v"))
cte("ebu0_v", CTES["bu0_v"].replace("bars_v", "ebars_v"))
cte("ebu_v", CTES["bu_v"].replace("bu0_v", "ebu0_v"))
cte("elabels_v", "SELECT trade_date, ticker, rank, ret AS return_t, label, CAST(trade_date AS TIMESTAMP) + INTERVAL 16 HOUR AS as_of FROM ebu_v")
for _name in ("r1_v", "r2_v", "r3_v", "barfeat_v", "mkt_v", "grid_v", "gmeta_v", "gsi_v", "gearn_v", "gapp_v", "gmkt_v", "t1_v"):
    _swap = r"\b(r1_v|r2_v|r3_v|barfeat_v|mkt_v|grid_v|gmeta_v|gsi_v|gearn_v|gapp_v|gmkt_v|bars_v|cal_v|labels_v)\b"
    cte("e" + _name, re.sub(_swap, r"e\1", CTES[_name]))
cte("pm_v", """
SELECT trade_date, ticker, arg_max(close, minute) AS last_price, max(high) AS high_price, sum(volume) AS total_volume,
       CAST(sum(CAST(close * volume AS DECIMAL(28,6))) AS DOUBLE) AS premarket_dollar_volume,
       CAST(sum(trade_count) AS BIGINT) AS premarket_trade_count, min(minute) AS first_minute
FROM minutes_v WHERE minute < CAST(trade_date AS TIMESTAMP) + INTERVAL '9 hours 25 minutes' GROUP BY trade_date, ticker
""")
cte("halts_v", """
SELECT trade_date, ticker, min(minute) AS as_of FROM ticks_v WHERE event_type = 'error' GROUP BY trade_date, ticker
""")
cte("epc_v", """
SELECT c.next_session AS trade_date, b.ticker, b.close, b.as_of FROM ebars_v b JOIN ecal_v c ON b.trade_date = c.session WHERE c.next_session IS NOT NULL
""")
oracle("minute_bars", "SELECT * REPLACE (CAST(trade_date AS VARCHAR) AS trade_date, CAST(minute AS VARCHAR) AS minute, CAST(as_of AS VARCHAR) AS as_of) FROM minutes_v")
oracle("premarket_agg", "SELECT * REPLACE (CAST(trade_date AS VARCHAR) AS trade_date, CAST(first_minute AS VARCHAR) AS first_minute) FROM pm_v")
oracle("halt_flag", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, ticker, CAST(1 AS BIGINT) AS overnight_halt_flag FROM halts_v
WHERE as_of <= CAST(trade_date AS TIMESTAMP) + INTERVAL '9 hours 25 minutes'""")
oracle("prior_close", "SELECT CAST(trade_date AS VARCHAR) AS trade_date, ticker, close, CAST(as_of AS VARCHAR) AS as_of FROM epc_v")
oracle("t2_features", """
SELECT t.* REPLACE (CAST(t.trade_date AS VARCHAR) AS trade_date,
                    CAST(CAST(t.trade_date AS TIMESTAMP) + INTERVAL '9 hours 25 minutes' AS VARCHAR) AS as_of),
       p.last_price / c.close - 1.0 AS premarket_gap_pct, p.premarket_dollar_volume,
       p.total_volume / t.adv_20 AS premarket_rel_volume,
       p.last_price / p.high_price - 1.0 AS premarket_high_to_last_drawdown,
       coalesce(p.premarket_trade_count, 0) AS premarket_trade_count,
       CAST(date_diff('minute', CAST(t.trade_date AS TIMESTAMP) + INTERVAL 4 HOUR, p.first_minute) AS DOUBLE) AS premarket_first_trade_minutes,
       CASE WHEN h.ticker IS NOT NULL THEN 1 ELSE 0 END AS overnight_halt_flag
FROM et1_v t LEFT JOIN pm_v p ON t.trade_date = p.trade_date AND t.ticker = p.ticker
LEFT JOIN epc_v c ON t.trade_date = c.trade_date AND t.ticker = c.ticker
LEFT JOIN (SELECT * FROM halts_v WHERE as_of <= CAST(trade_date AS TIMESTAMP) + INTERVAL '9 hours 25 minutes') h
  ON t.trade_date = h.trade_date AND t.ticker = h.ticker""")

# --- baselines ----------------------------------------------------------------------------

cte("b0_v", """
SELECT trade_date, ticker, CAST(('0x' || left(md5('7|' || CAST(trade_date AS VARCHAR) || '|' || ticker), 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS score FROM universe_v
QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY CAST(('0x' || left(md5('7|' || CAST(trade_date AS VARCHAR) || '|' || ticker), 13)) AS BIGINT) DESC, ticker) <= 10
""")
cte("lcal_v", """
SELECT trade_date AS session, lead(trade_date) OVER (ORDER BY trade_date) AS next_session FROM (SELECT DISTINCT trade_date FROM labels_v)
""")
cte("b1_v", """
SELECT c.next_session AS trade_date, l.ticker, CAST(max(l.rank) OVER (PARTITION BY l.trade_date) + 1 - l.rank AS DOUBLE) AS score
FROM labels_v l JOIN lcal_v c ON l.trade_date = c.session WHERE l.label = 1 AND c.next_session IS NOT NULL
""")
cte("vol_v", """
SELECT c.next_session AS trade_date, x.ticker, x.v5, x.v20 FROM (
  SELECT trade_date, ticker, CASE WHEN count(ret) OVER w5 = 5 THEN stddev_samp(ret) OVER w5 END AS v5,
         CASE WHEN count(ret) OVER w20 = 20 THEN stddev_samp(ret) OVER w20 END AS v20
  FROM r1_v
  WINDOW w5 AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
         w20 AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) x
JOIN cal_v c ON x.trade_date = c.session WHERE c.next_session IS NOT NULL
""")
cte("b2_v", """
SELECT trade_date, ticker, v5 AS score FROM vol_v WHERE v5 IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY v5 DESC, ticker) <= 10
""")
cte("b3_v", """
SELECT v.trade_date, v.ticker, v.v20 AS score FROM vol_v v JOIN earnings_v e ON v.trade_date = e.report_date AND v.ticker = e.ticker
WHERE v.v20 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY v.trade_date ORDER BY v.v20 DESC, v.ticker) <= 10
""")
cte("b4_v", """
SELECT trade_date, ticker, score FROM (
  SELECT p.trade_date, p.ticker, CASE WHEN p.last_price <> 0 OR c.close <> 0 THEN (p.last_price / c.close - 1.0) * 100.0 END AS score
  FROM pm_v p JOIN epc_v c ON p.trade_date = c.trade_date AND p.ticker = c.ticker WHERE p.premarket_dollar_volume >= 5000.0)
QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY score DESC NULLS LAST, ticker) <= 10
""")
for _q, _t, _s in (("b0_random", "b0_v", "score"), ("b1_repeat", "b1_v", "score"), ("b2_vol", "b2_v", "round(score, 8)"),
                   ("b3_earnings_vol", "b3_v", "round(score, 8)"), ("b4_gap", "b4_v", "score")):
    oracle(_q, f"SELECT CAST(trade_date AS VARCHAR) AS trade_date, ticker, {_s} AS score FROM {_t}")
cte("warm_v", """
SELECT trade_date, ticker FROM bf_v
WHERE xs_vol_rank IS NOT NULL AND xs_ret_rank IS NOT NULL AND dist52 IS NOT NULL AND vol5 IS NOT NULL AND relvol_prev IS NOT NULL
  AND ret5 IS NOT NULL AND ret20 IS NOT NULL AND volofvol IS NOT NULL AND was_top IS NOT NULL AND top30 IS NOT NULL AND top90 IS NOT NULL
""")
oracle("b2_restricted", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, ticker, round(score, 8) AS score FROM (
  SELECT next_session AS trade_date, ticker, score FROM (
    SELECT trade_date, ticker, CASE WHEN count(r) OVER w = 5 THEN stddev_samp(r) OVER w END AS score
    FROM (SELECT trade_date, ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY trade_date) - 1.0 AS r FROM bu_v)
    WINDOW w AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) x
  JOIN (SELECT trade_date AS session, lead(trade_date) OVER (ORDER BY trade_date) AS next_session FROM (SELECT DISTINCT trade_date FROM bu_v)) c ON x.trade_date = c.session
  WHERE score IS NOT NULL AND next_session IS NOT NULL) JOIN warm_v USING (trade_date, ticker)
QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, ticker) <= 10""")
oracle("all_baselines", """
SELECT baseline, CAST(trade_date AS VARCHAR) AS trade_date, count(*) AS n_picks, min(ticker) AS first_ticker FROM (
  SELECT 'B0' AS baseline, * FROM b0_v UNION ALL SELECT 'B1', * FROM b1_v UNION ALL SELECT 'B2', * FROM b2_v
  UNION ALL SELECT 'B3', * FROM b3_v UNION ALL SELECT 'B4', * FROM b4_v) GROUP BY baseline, trade_date""")

# --- metrics ------------------------------------------------------------------------------

cte("picked_v", """
SELECT b.trade_date, b.ticker, b.score, row_number() OVER (PARTITION BY b.trade_date ORDER BY b.score DESC, b.ticker) AS pos, coalesce(l.label, 0) AS label
FROM b2_v b LEFT JOIN labels_v l ON b.trade_date = l.trade_date AND b.ticker = l.ticker
""")
cte("picked1_v", """
SELECT b.trade_date, b.ticker, coalesce(l.label, 0) AS label FROM b1_v b LEFT JOIN labels_v l ON b.trade_date = l.trade_date AND b.ticker = l.ticker
""")
cte("daily_v", """
SELECT d.*, CASE WHEN r.relevant > 0 THEN d.gain / least(r.relevant, 10) END AS ap FROM (
  SELECT trade_date, CAST(sum(label) AS BIGINT) AS hits, count(*) AS n, sum(label) / count(*) AS precision, coalesce(sum(CASE WHEN label = 1 THEN cum / pos END), 0) AS gain
  FROM (SELECT *, sum(label) OVER (PARTITION BY trade_date ORDER BY pos) AS cum FROM picked_v) GROUP BY trade_date) d
LEFT JOIN (SELECT trade_date, count(*) AS relevant FROM labels_v WHERE label = 1 GROUP BY trade_date) r USING (trade_date)
""")
cte("paired_v", """
SELECT a.trade_date, a.hits AS model_hits, b.hits AS baseline_hits FROM daily_v a
JOIN (SELECT trade_date, CAST(sum(label) AS BIGINT) AS hits FROM picked1_v GROUP BY trade_date) b USING (trade_date)
""")
cte("years_v", """
SELECT CAST(year(trade_date) AS INTEGER) AS year, avg(model_hits) AS model_mean_hits, avg(baseline_hits) AS baseline_mean_hits, count(*) AS n_days,
       avg(model_hits) > avg(baseline_hits) AS model_won FROM paired_v GROUP BY 1
""")
oracle("topk_per_day", "SELECT CAST(trade_date AS VARCHAR) AS trade_date, ticker, round(score, 8) AS score, pos, CAST(label AS BIGINT) AS label FROM picked_v")
oracle("hits_per_day", "SELECT CAST(trade_date AS VARCHAR) AS trade_date, hits FROM daily_v")
oracle("precision_at_k", "SELECT round(avg(precision), 9) AS precision, count(*) AS n_days FROM daily_v")
oracle("map_at_k", "SELECT round(avg(ap), 9) AS map, count(ap) AS n_days FROM daily_v")
oracle("per_year", """
SELECT CAST(year(trade_date) AS INTEGER) AS year, round(avg(precision), 9) AS precision_at_k, round(avg(ap), 9) AS map_at_k,
       round(avg(hits), 9) AS mean_hits, CAST(median(hits) AS DOUBLE) AS median_hits, count(*) AS n_days FROM daily_v GROUP BY 1""")
oracle("decay_series", """
SELECT row_number() OVER (ORDER BY year) - 1 AS pos, year, mean_hits, n_days FROM (
  SELECT CAST(year(trade_date) AS INTEGER) AS year, round(avg(hits), 9) AS mean_hits, count(*) AS n_days FROM daily_v GROUP BY 1)""")
oracle("compare_baseline", """
SELECT round(avg(model_hits) - avg(baseline_hits), 9) AS mean_hits_delta,
       (SELECT count(*) FROM years_v WHERE model_won) AS years_won, (SELECT count(*) FROM years_v) AS years_total, count(*) AS n_days FROM paired_v""")
oracle("yearly_record", "SELECT year, round(model_mean_hits, 9) AS model_mean_hits, round(baseline_mean_hits, 9) AS baseline_mean_hits, n_days, model_won FROM years_v")
oracle("paired_t", """
SELECT count(*) AS n, round(avg(model_hits - baseline_hits), 6) AS mean_diff,
       round(avg(model_hits - baseline_hits) / (stddev_samp(model_hits - baseline_hits) / sqrt(count(*))), 6) AS statistic FROM paired_v""")
cte("wil_v", """
SELECT *, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0::DOUBLE AS r FROM (
  SELECT model_hits - baseline_hits AS d, abs(model_hits - baseline_hits) AS m FROM paired_v)
""")
cte("wil2_v", """
SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE m = 0) AS DOUBLE) AS z,
       least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)) AS statistic,
       (SELECT sum(t * t * t - t) FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM wil_v WHERE m > 0 GROUP BY m)) AS ties FROM wil_v
""")
oracle("wilcoxon_pratt", """
SELECT CAST(n AS BIGINT) AS n, statistic,
       round((statistic - (n * (n + 1) - z * (z + 1)) / 4.0) / sqrt((n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1)) / 24.0 - ties / 48.0), 6) AS z_score FROM wil2_v""")
cte("pv_v", """
SELECT CAST(year(trade_date) AS VARCHAR) AS variant, sum(CASE WHEN hits = 0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) / 10 AS p_value FROM daily_v GROUP BY 1
""")
oracle("holm", """
SELECT variant, round(p_value, 9) AS p_value, round(max(step) OVER (ORDER BY p_value, variant ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS p_adjusted FROM (
  SELECT *, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p_value, variant) + 1) * p_value) AS step FROM pv_v)""")
oracle("baseline_gate", """
SELECT count(*) FILTER (WHERE model_won) AS years_won, count(*) AS years_total,
       CASE WHEN count(*) < 5 THEN 'undecidable' WHEN count(*) FILTER (WHERE model_won) >= 3 THEN 'pass' ELSE 'fail' END AS verdict,
       count(*) >= 5 AND count(*) FILTER (WHERE model_won) >= 3 AS passed FROM years_v""")
oracle("expanding_splits", """
SELECT CAST((SELECT min(session) FROM cal_v) AS VARCHAR) AS train_start, CAST(train_end AS VARCHAR) AS train_end,
       CAST(test_start AS VARCHAR) AS test_start, CAST(test_end AS VARCHAR) AS test_end, retrain FROM (
  SELECT u AS retrain, min(session) AS test_start, max(session) AS test_end,
         lag(max(session)) OVER (PARTITION BY u ORDER BY min(session)) AS train_end
  FROM (SELECT session, u, CASE u WHEN 'yearly' THEN date_trunc('year', session) ELSE date_trunc('quarter', session) END AS period
        FROM cal_v, (SELECT unnest(['yearly', 'quarterly']) AS u)) GROUP BY u, period)
WHERE train_end IS NOT NULL AND year(test_start) >= year((SELECT min(session) FROM cal_v)) + 2""")

# --- quality --------------------------------------------------------------------------------

cte("qcont_v", """
SELECT lag(trade_date) OVER (ORDER BY trade_date) AS from_date, trade_date AS to_date, lag(n) OVER (ORDER BY trade_date) AS from_count, n AS to_count,
       abs(n - lag(n) OVER (ORDER BY trade_date)) / CAST(lag(n) OVER (ORDER BY trade_date) AS DOUBLE) AS pct_change
FROM (SELECT trade_date, count(DISTINCT ticker) AS n FROM universe_v GROUP BY trade_date)
QUALIFY pct_change > 0.05
""")
cte("med_v", "SELECT trade_date, median(return_t) AS median_return FROM labels_v WHERE label = 1 GROUP BY trade_date")
cte("card_v", "SELECT trade_date, CAST(sum(label) AS BIGINT) AS n_positive, count(*) AS n_total FROM labels_v GROUP BY trade_date")
cte("qcov_v", """
SELECT u.trade_date, universe_n, coalesce(labeled_n, 0) AS labeled_n, universe_n - coalesce(labeled_n, 0) AS dropped,
       (universe_n - coalesce(labeled_n, 0)) / CAST(universe_n AS DOUBLE) AS dropped_fraction
FROM (SELECT trade_date, count(DISTINCT ticker) AS universe_n FROM universe_v GROUP BY trade_date) u
LEFT JOIN (SELECT trade_date, count(DISTINCT ticker) AS labeled_n FROM labels_v GROUP BY trade_date) l USING (trade_date)
WHERE (universe_n - coalesce(labeled_n, 0)) / CAST(universe_n AS DOUBLE) > 0.05
""")
oracle("q_continuity", "SELECT CAST(from_date AS VARCHAR) AS from_date, CAST(to_date AS VARCHAR) AS to_date, from_count, to_count, pct_change FROM qcont_v")
oracle("q_contamination", "SELECT CAST(trade_date AS VARCHAR) AS trade_date, median_return FROM med_v WHERE median_return > 1.0")
oracle("q_quiet", "SELECT CAST(trade_date AS VARCHAR) AS trade_date, median_return FROM med_v WHERE median_return < 5.0")
oracle("q_cardinality", "SELECT CAST(trade_date AS VARCHAR) AS trade_date, n_positive, n_total FROM card_v WHERE n_positive <> 11 AND n_total >= 11")
oracle("q_split_days", "SELECT CAST(trade_date AS VARCHAR) AS trade_date, ticker FROM bars_v SEMI JOIN splits_v USING (trade_date, ticker)")
oracle("q_coverage", "SELECT * REPLACE (CAST(trade_date AS VARCHAR) AS trade_date) FROM qcov_v")
oracle("sanity_report", """
SELECT 'universe_continuity' AS "check", count(*) = 0 AS passed, 'fail' AS severity, count(*) AS n_offenders, max(pct_change) AS worst FROM qcont_v
UNION ALL SELECT 'median_gainer_contamination', count(*) = 0, 'fail', count(*), max(median_return) FROM med_v WHERE median_return > 1.0
UNION ALL SELECT 'median_gainer_quiet_regime', count(*) = 0, 'warn', count(*), min(median_return) FROM med_v WHERE median_return < 0.2
UNION ALL SELECT 'label_cardinality', count(*) = 0, 'fail', count(*), CAST(max(n_positive) AS DOUBLE) FROM card_v WHERE n_positive <> 10 AND n_total >= 10
UNION ALL SELECT 'no_split_days', count(*) = 0, 'fail', count(*), NULL FROM labels_v SEMI JOIN splits_v USING (trade_date, ticker)
UNION ALL SELECT 'universe_coverage', count(*) = 0, 'fail', count(*), max(dropped_fraction) FROM qcov_v""")

# --- leakage --------------------------------------------------------------------------------

oracle("asof_violations", """
SELECT ticker, CAST(settlement_date AS VARCHAR) AS trade_date, CAST(as_of AS VARCHAR) AS as_of,
       CAST(CAST(settlement_date AS TIMESTAMP) - INTERVAL 8 HOUR AS VARCHAR) AS decision_time
FROM si_v WHERE as_of > CAST(settlement_date AS TIMESTAMP) - INTERVAL 8 HOUR""")
oracle("adjusted_suspects", """
SELECT b.ticker, CAST(b.trade_date AS VARCHAR) AS trade_date, CAST(b.as_of AS VARCHAR) AS as_of, CAST(max(a.as_of) AS VARCHAR) AS latest_action_as_of
FROM bars_v b JOIN actions_v a ON a.ticker = b.ticker AND a.ex_date > b.trade_date AND a.as_of > b.as_of GROUP BY b.ticker, b.trade_date, b.as_of""")
oracle("unadjusted_check", """
SELECT ticker, CAST(ex_date AS VARCHAR) AS ex_date, split_ratio, 1.0 / split_ratio AS expected_ratio, observed_ratio FROM (
  SELECT a.ticker, a.ex_date, a.ratio AS split_ratio, f.close / l.close AS observed_ratio
  FROM (SELECT ticker, ex_date, ratio FROM actions_v WHERE action_type IN ('split', 'reverse_split') AND ratio > 0) a
  ASOF JOIN bars_v l ON a.ticker = l.ticker AND a.ex_date > l.trade_date
  ASOF JOIN bars_v f ON a.ticker = f.ticker AND a.ex_date <= f.trade_date)
WHERE abs(observed_ratio - 1.0) <= 0.25""")
cte("leak_v", """
SELECT f.*, u.ret * 100 + 1 AS planted_affine, CAST(u.rank AS DOUBLE) AS planted_copy, u.ret AS return_t, CAST(u.rank AS DOUBLE) AS rank, CAST(u.label AS DOUBLE) AS label
FROM bf_v f JOIN bu_v u USING (trade_date, ticker)
""")
_LEAK = C.BARS_FEATURES + ("planted_affine", "planted_copy")
cte("leaklong_v", " UNION ALL ".join(
    f"SELECT trade_date, '{c}' AS feature, CAST({c} AS DOUBLE) AS x, return_t, rank, label FROM leak_v" for c in _LEAK))
cte("leakpair_v", " UNION ALL ".join(
    f"SELECT trade_date, feature, x, '{y}' AS label_col, {y} AS y FROM leaklong_v" for y in ("return_t", "rank", "label")))
oracle("self_exclusion_identity", """
SELECT feature, label_col, bool_and((x IS NULL AND y IS NULL) OR coalesce(abs(x - y) <= 1e-8 + 1e-5 * abs(y), false)) AS identical
FROM leakpair_v GROUP BY feature, label_col""")
cte("leakrank_v", """
SELECT trade_date, feature, label_col, x, y,
       rank() OVER (PARTITION BY trade_date, feature, label_col ORDER BY x) + (count(*) OVER (PARTITION BY trade_date, feature, label_col, x) - 1) / 2.0::DOUBLE AS rx,
       rank() OVER (PARTITION BY trade_date, feature, label_col ORDER BY y) + (count(*) OVER (PARTITION BY trade_date, feature, label_col, y) - 1) / 2.0::DOUBLE AS ry
FROM leakpair_v WHERE x IS NOT NULL AND y IS NOT NULL
""")
oracle("self_exclusion_corr", """
SELECT feature, label_col, count(*) AS evaluable_days, count(*) FILTER (WHERE greatest(abs(p), abs(s)) >= 0.99) AS hit_days,
       count(*) FILTER (WHERE greatest(abs(p), abs(s)) >= 0.99) >= 0.5 * count(*) AS leaks
FROM (SELECT trade_date, feature, label_col, covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0) AS p,
             covar_pop(rx, ry) / nullif(sqrt(var_pop(rx) * var_pop(ry)), 0) AS s
      FROM leakrank_v GROUP BY 1, 2, 3 HAVING count(*) >= 5 AND max(x) > min(x) AND max(y) > min(y))
GROUP BY feature, label_col""")
cte("shuf_v", """
SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY CAST(('0x' || left(md5('3:from|' || CAST(trade_date AS VARCHAR) || '|' || ticker), 13)) AS BIGINT), ticker) AS i_from,
       row_number() OVER (PARTITION BY trade_date ORDER BY CAST(('0x' || left(md5('3:to|' || CAST(trade_date AS VARCHAR) || '|' || ticker), 13)) AS BIGINT), ticker) AS i_to
FROM labels_v
""")
oracle("shuffle_labels", """
SELECT CAST(t.trade_date AS VARCHAR) AS trade_date, t.ticker, CAST(s.rank AS INTEGER) AS rank, s.return_t, CAST(s.label AS INTEGER) AS label
FROM shuf_v t JOIN shuf_v s ON t.trade_date = s.trade_date AND t.i_to = s.i_from""")
_at = "CAST(('0x' || left(md5((2000 + t) || ':{}|' || CAST(trade_date AS VARCHAR) || '|' || ticker), 13)) AS BIGINT)"
cte("shuft_v", f"""
SELECT *, row_number() OVER (PARTITION BY t, trade_date ORDER BY {_at.format('from')}, ticker) AS i_from, row_number() OVER (PARTITION BY t, trade_date ORDER BY {_at.format('to')}, ticker) AS i_to
FROM labels_v, (SELECT unnest([0, 1, 2]) AS t)
""")
cte("shufs_v", """
SELECT a.t, a.ticker, avg(b.label) AS score FROM shuft_v a JOIN shuft_v b ON a.t = b.t AND a.trade_date = b.trade_date AND a.i_to = b.i_from GROUP BY 1, 2
""")
cte("shufp_v", """
SELECT t, avg(p) AS precision FROM (
  SELECT t, trade_date, avg(label) AS p FROM (
    SELECT s.t, l.trade_date, l.label FROM labels_v l JOIN shufs_v s ON l.ticker = s.ticker
    QUALIFY row_number() OVER (PARTITION BY s.t, l.trade_date ORDER BY s.score DESC, l.ticker) <= 10) GROUP BY 1, 2) GROUP BY t
""")
oracle("shuffle_label_test", """
SELECT t AS trial, round(precision, 9) AS precision, round(p, 9) AS expected_precision, round(tol, 9) AS tolerance, round(avg(precision) OVER (), 9) AS observed_precision,
       avg(precision) OVER () <= tol AS passed
FROM shufp_v, (SELECT p, least(1.0::DOUBLE, greatest(p, 3 * p, p + 3 * sqrt(p * (1 - p) / (n_days * 30)))) AS tol
               FROM (SELECT count(*) AS n_days, least(1.0::DOUBLE, 10.0::DOUBLE / avg(n)) AS p FROM (SELECT trade_date, count(DISTINCT ticker) AS n FROM labels_v GROUP BY trade_date)))""")
oracle("tolerance", """
SELECT n_days, round(a, 9) AS avg_candidates, round(p, 9) AS expected_precision, n_days * 50 AS observations,
       round(least(1.0::DOUBLE, greatest(p, 3 * p, p + 3 * sqrt(p * (1 - p) / (n_days * 50)))), 9) AS tolerance
FROM (SELECT count(*) AS n_days, avg(n) AS a, least(1.0::DOUBLE, 10.0::DOUBLE / avg(n)) AS p FROM (
  SELECT trade_date, count(DISTINCT ticker) AS n FROM universe_v GROUP BY trade_date))""")
oracle("holdout_seal", """
SELECT CAST(max(trade_date) AS VARCHAR) AS newest, count(*) FILTER (WHERE trade_date >= DATE '2001-01-01') AS n_rows FROM bars_v
HAVING count(*) FILTER (WHERE trade_date >= DATE '2001-01-01') > 0""")


# --- landed JSON ------------------------------------------------------------------------------

oracle("json_grouped_daily", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, ticker, open, high, low, close, volume,
       CASE WHEN volume % 2 = 1 THEN dollar_volume / volume ELSE close END * volume AS dollar_volume, CAST(as_of AS VARCHAR) AS as_of FROM bars_v""")
oracle("json_splits_dividends", """
SELECT CAST(ex_date AS VARCHAR) AS ex_date, ticker, CASE WHEN action_type IN ('split', 'reverse_split') THEN action_type ELSE 'dividend' END AS action_type,
       CASE action_type WHEN 'split' THEN 2.0::DOUBLE WHEN 'reverse_split' THEN 0.1::DOUBLE END AS ratio, cash_amount, CAST(NULL AS VARCHAR) AS new_ticker,
       CAST(CAST(CASE WHEN day(ex_date) > 15 THEN ex_date - 5 ELSE ex_date END AS TIMESTAMP) AS VARCHAR) AS as_of FROM actions_v""")
oracle("json_reference_tickers", """
SELECT 'T' || s_suppkey AS ticker, s_name AS name, list_value('CS', 'ADR', 'ETF', 'WARRANT', 'SPAC', 'OTHER')[s_suppkey % 6 + 1] AS security_type,
       CASE WHEN s_suppkey % 4 <> 3 THEN 'XNYS' ELSE 'OTC' END AS exchange,
       CAST(DATE '1993-06-01' + CAST(s_suppkey * 37 % 1500 AS INTEGER) AS VARCHAR) AS active_from, CAST(NULL AS VARCHAR) AS active_to, s_acctbal AS market_cap,
       CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 100.0::DOUBLE ELSE s_suppkey * 10.0::DOUBLE END AS float_shares,
       CAST(CAST(DATE '1993-06-01' + CAST(s_suppkey * 37 % 1500 AS INTEGER) AS TIMESTAMP) AS VARCHAR) AS as_of FROM supplier""")
oracle("json_earnings", """
SELECT ticker, CAST(report_date AS VARCHAR) AS report_date, CASE WHEN session = 'bmo' THEN 'bmo' ELSE 'unknown' END AS session,
       CAST(announced_on AS VARCHAR) AS announced_on, date_is_revisable, CAST(as_of AS VARCHAR) AS as_of FROM earnings_v""")
oracle("json_earnings_calendar", """
SELECT ticker, CAST(report_date AS VARCHAR) AS report_date, CASE WHEN session = 'bmo' THEN 'bmo' WHEN day(report_date) > 10 THEN 'amc' ELSE 'unknown' END AS session,
       CAST(NULL AS VARCHAR) AS announced_on, true AS date_is_revisable, CAST(CAST(report_date - 1 AS TIMESTAMP) AS VARCHAR) AS as_of FROM earnings_v""")
oracle("json_short_interest", """
SELECT ticker, CAST(settlement_date AS VARCHAR) AS settlement_date, short_interest_shares, short_interest_pct_float, days_to_cover,
       CAST(CAST(settlement_date + CASE WHEN day(settlement_date) > 15 THEN 9 ELSE 14 END AS TIMESTAMP) AS VARCHAR) AS as_of FROM si_v""")
cte("et_v", """
SELECT 'T' || user_id AS ticker, value, date_trunc('millisecond', ts) - CASE WHEN month(ts) BETWEEN 4 AND 10 THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS minute FROM events
""")
oracle("json_minutes", """
SELECT CAST(CAST(minute AS DATE) AS VARCHAR) AS trade_date, ticker, CAST(minute AS VARCHAR) AS minute, value AS open, value AS high, value AS low, value AS close,
       100.0::DOUBLE AS volume, 1.0::DOUBLE AS trade_count, CAST(minute AS VARCHAR) AS as_of FROM et_v
WHERE minute >= CAST(CAST(minute AS DATE) AS TIMESTAMP) + INTERVAL 4 HOUR AND minute < CAST(CAST(minute AS DATE) AS TIMESTAMP) + INTERVAL '9 hours 25 minutes'""")
oracle("json_eod", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, ticker, open, high, low, close, volume, close * volume AS dollar_volume, CAST(as_of AS VARCHAR) AS as_of FROM bars_v""")
cte("cap_v", """
SELECT trade_date, ticker, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, ticker) - 1 AS pos FROM b2_v
""")
oracle("json_capture", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, 'sp500' AS list, pos, ticker FROM cap_v
UNION ALL SELECT CAST(trade_date AS VARCHAR), 'top_movers', pos, ticker FROM cap_v WHERE day(trade_date) % 2 = 0""")

# --- security master and venues -----------------------------------------------------------------

cte("sn_v", """
SELECT s_suppkey AS permno, CASE WHEN s_suppkey % 3 = 0 AND v = 1 THEN 'N' ELSE 'T' END || s_suppkey AS ticker, s_name AS comnam,
       list_value(10, 11, 31, 73)[s_suppkey % 4 + 1] AS shrcd, list_value(1, 2, -3, 9)[s_suppkey % 4 + 1] AS exchcd,
       CAST(DATE '1993-06-01' + CAST(s_suppkey * 37 % 1500 + v * 1100 AS INTEGER) AS DATE) AS namedt,
       CASE WHEN v = 0 THEN CAST(DATE '1993-06-01' + CAST(s_suppkey * 37 % 1500 + 1099 AS INTEGER) AS DATE) END AS nameendt
FROM supplier, (SELECT unnest([0, 1]) AS v)
""")
cte("sp_v", "SELECT CAST(substr(ticker, 2) AS BIGINT) AS permno, trade_date, open, high, low, CASE WHEN volume % 2 = 1 THEN -close ELSE close END AS prc, volume FROM bars_v")
oracle("name_interval_join", """
SELECT CAST(p.trade_date AS VARCHAR) AS trade_date, n.ticker, open, high, low, abs(prc) AS close, volume, abs(prc) * volume AS dollar_volume,
       CAST(CAST(p.trade_date AS TIMESTAMP) + INTERVAL 16 HOUR AS VARCHAR) AS as_of, p.permno, prc < 0 AS price_is_midpoint
FROM sp_v p JOIN sn_v n ON p.permno = n.permno AND p.trade_date BETWEEN n.namedt AND coalesce(n.nameendt, p.trade_date)""")
cte("tc_v", """
SELECT permno, namedt AS ex_date, ticker AS new_ticker, lag(ticker) OVER (PARTITION BY permno ORDER BY namedt) AS ticker FROM sn_v
QUALIFY lag(ticker) OVER (PARTITION BY permno ORDER BY namedt) <> ticker
""")
oracle("ticker_changes", "SELECT permno, CAST(ex_date AS VARCHAR) AS ex_date, ticker, new_ticker, CAST(CAST(ex_date AS TIMESTAMP) AS VARCHAR) AS as_of FROM tc_v")
oracle("security_actions", """
SELECT CAST(ex_date AS VARCHAR) AS ex_date, ticker, action_type, ratio, cash_amount, new_ticker, CAST(CAST(as_of AS TIMESTAMP) AS VARCHAR) AS as_of, permno FROM (
  SELECT CAST(o_orderdate AS DATE) AS ex_date, CAST(NULL AS VARCHAR) AS ticker,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'split' WHEN '2' THEN 'reverse_split' ELSE 'dividend' END AS action_type,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 1.0::DOUBLE + 1.0::DOUBLE WHEN '2' THEN 1.0::DOUBLE + (-0.9)::DOUBLE END AS ratio,
         CASE WHEN left(o_orderpriority, 1) IN ('3', '4') THEN o_totalprice / 1e5 END AS cash_amount, CAST(NULL AS VARCHAR) AS new_ticker,
         CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) - 20 ELSE CAST(o_orderdate AS DATE) END AS as_of, o_custkey AS permno
  FROM orders WHERE left(o_orderpriority, 1) IN ('1', '2', '3', '4')
  UNION ALL SELECT ex_date, ticker, 'ticker_change', NULL, NULL, new_ticker, ex_date, permno FROM tc_v
  UNION ALL SELECT CAST(DATE '1996-01-01' + CAST(s_suppkey * 11 % 1500 AS INTEGER) AS DATE), NULL, 'delisting', NULL, s_acctbal / 1e4, NULL,
                   CAST(DATE '1996-01-01' + CAST(s_suppkey * 11 % 1500 AS INTEGER) AS DATE), s_suppkey FROM supplier)
WHERE ex_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")
oracle("name_history_meta", """
SELECT n.permno, n.ticker, comnam AS name, CASE WHEN shrcd IN (10, 11) THEN 'CS' WHEN shrcd IN (30, 31) THEN 'ADR' ELSE 'OTHER' END AS security_type,
       CASE abs(exchcd) WHEN 1 THEN 'XNYS' WHEN 2 THEN 'XASE' WHEN 3 THEN 'XNAS' ELSE 'OTC' END AS exchange,
       CAST(namedt AS VARCHAR) AS active_from, CAST(nameendt AS VARCHAR) AS active_to, abs(prc) * (volume * 3) * 1000 AS market_cap, CAST(CAST(namedt AS TIMESTAMP) AS VARCHAR) AS as_of
FROM sn_v n LEFT JOIN sp_v p ON n.permno = p.permno AND n.namedt = p.trade_date""")
cte("vb_v", """
SELECT CAST(l_shipdate AS DATE) AS trade_date, list_value('XASE.PILLAR', 'XNAS.ITCH', 'XNYS.PILLAR')[l_linenumber % 3 + 1] AS venue, 'T' || l_suppkey AS ticker, l_suppkey,
       min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2, 3, 4
""")
oracle("symbol_resolution", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, venue, l_suppkey * 1000 + (trade_date - DATE '1990-01-01') % 997 AS instrument_id, ticker, volume FROM vb_v""")
cte("vm_v", """
SELECT *, CASE list_value('XNAS', 'XNYS', 'ARCX', 'IEXG')[(l_suppkey + month(trade_date)) % 4 + 1] WHEN 'XNAS' THEN 'XNAS.ITCH' WHEN 'XNYS' THEN 'XNYS.PILLAR'
       WHEN 'ARCX' THEN 'XNYS.PILLAR' ELSE 'XASE.PILLAR' END AS listing FROM vb_v WHERE day(trade_date) NOT IN (13, 27)
""")
oracle("venue_merge", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, ticker, low AS open, high, low, high AS close, total AS volume, high * total AS dollar_volume,
       CAST(CAST(trade_date AS TIMESTAMP) + INTERVAL 16 HOUR AS VARCHAR) AS as_of FROM (
  SELECT *, sum(volume) OVER (PARTITION BY trade_date, ticker) AS total FROM vm_v
  QUALIFY row_number() OVER (PARTITION BY trade_date, ticker ORDER BY CASE WHEN venue = listing THEN 0 ELSE 1 END, venue) = 1)""")
cte("ids_v", """
SELECT trade_date, ticker, CASE WHEN k % 10 = 0 AND day(trade_date) % 2 = 0 THEN NULL ELSE k * 10 END AS instrument_id FROM (
  SELECT DISTINCT CAST(l_shipdate AS DATE) AS trade_date, 'T' || l_suppkey AS ticker, l_suppkey AS k FROM lineitem)
""")
cte("al_v", """
SELECT a.ticker, a.ex_date, a.action_type, i.instrument_id FROM actions_v a LEFT JOIN ids_v i ON a.ticker = i.ticker AND a.ex_date = i.trade_date
""")
oracle("identity_align", "SELECT ticker, CAST(ex_date AS VARCHAR) AS ex_date, action_type, instrument_id FROM al_v")
oracle("alignment_report", """
SELECT count(*) AS total_rows, count(instrument_id) AS aligned_rows, count(DISTINCT CASE WHEN instrument_id IS NULL THEN ticker END) AS unaligned_ticker_count FROM al_v""")
oracle("unaligned_tickers", "SELECT DISTINCT ticker FROM al_v WHERE instrument_id IS NULL")

# --- survivorship --------------------------------------------------------------------------------

cte("del_v", """
SELECT l.ticker, l.d AS last_trade_date, coalesce(c.next_session, l.d) AS inferred_delist_date, least(1.0::DOUBLE, ((SELECT max(session_idx) FROM cal_v) - c.session_idx) / 8.0::DOUBLE) AS confidence
FROM (SELECT ticker, max(trade_date) AS d FROM bars_v GROUP BY ticker) l JOIN cal_v c ON l.d = c.session
WHERE (SELECT max(session_idx) FROM cal_v) - c.session_idx >= 2
""")
oracle("infer_delistings", "SELECT ticker, CAST(last_trade_date AS VARCHAR) AS last_trade_date, CAST(inferred_delist_date AS VARCHAR) AS inferred_delist_date, confidence FROM del_v")
oracle("delisting_actions", """
SELECT CAST(inferred_delist_date AS VARCHAR) AS ex_date, ticker, 'delisting' AS action_type, CAST(CAST(inferred_delist_date AS TIMESTAMP) AS VARCHAR) AS as_of, confidence FROM del_v""")
cte("surv_v", """
SELECT b.ticker, bool_or(c.session_idx - 1 <= greatest(0, CAST(floor(n * 0.002) AS INTEGER) - 1)) AS early, bool_or(c.session_idx - 1 >= least(n - 1, CAST(floor(n * 0.998) AS INTEGER))) AS late
FROM bars_v b JOIN cal_v c ON b.trade_date = c.session, (SELECT max(session_idx) AS n FROM cal_v) GROUP BY b.ticker
""")
oracle("survivorship", """
SELECT count(*) FILTER (WHERE early) AS early_tickers, count(*) FILTER (WHERE late) AS late_tickers, count(*) FILTER (WHERE early AND NOT late) AS disappeared_tickers,
       (SELECT count(*) FROM cal_v) AS n_sessions, (SELECT count(*) FROM cal_v) >= 2 AND count(*) FILTER (WHERE early AND NOT late) >= 1 AS passed FROM surv_v""")
oracle("disappeared_tickers", "SELECT ticker FROM surv_v WHERE early AND NOT late")

# --- monitoring, overlap, sampling -----------------------------------------------------------------

oracle("score_days", """
SELECT CAST(p.trade_date AS VARCHAR) AS trade_date, count(*) AS n_predicted, count(c.ticker) AS captured_hits, count(l.ticker) AS proxy_hits
FROM b2_v p LEFT JOIN b1_v c ON p.trade_date = c.trade_date AND p.ticker = c.ticker
LEFT JOIN (SELECT trade_date, ticker FROM labels_v WHERE label = 1) l ON p.trade_date = l.trade_date AND p.ticker = l.ticker GROUP BY p.trade_date""")
cte("mon_v", """
SELECT trade_date, model_hits AS live_hits, baseline_hits,
       count(*) OVER w4 = 4 AND min(CASE WHEN 6.0 - model_hits > 1.5 THEN 1 ELSE 0 END) OVER w4 = 1 AS stop,
       count(*) OVER w3 = 3 AND min(CASE WHEN model_hits < baseline_hits THEN 1 ELSE 0 END) OVER w3 = 1 AS kill
FROM paired_v WINDOW w4 AS (ORDER BY trade_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), w3 AS (ORDER BY trade_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
""")
oracle("rolling_monitor", "SELECT * REPLACE (CAST(trade_date AS VARCHAR) AS trade_date) FROM mon_v")
_ekey = "CAST(('0x' || left(md5('7|' || CAST(trade_date AS VARCHAR) || '|' || ticker), 13)) AS BIGINT)"
cte("eb0_v", f"SELECT trade_date, ticker FROM elabels_v QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY {_ekey} DESC, ticker) <= 10")
cte("mhits_v", " UNION ALL ".join(
    f"SELECT '{m}' AS model, b.trade_date, CAST(sum(coalesce(l.label, 0)) AS BIGINT) AS hits FROM {v} b LEFT JOIN {lab} l ON b.trade_date = l.trade_date AND b.ticker = l.ticker GROUP BY b.trade_date"
    for m, v, lab in (("b0", "b0_v", "labels_v"), ("b1", "b1_v", "labels_v"), ("b2", "b2_v", "labels_v"), ("b3", "b3_v", "labels_v"), ("b4", "b4_v", "elabels_v"), ("eb0", "eb0_v", "elabels_v"))))
oracle("stream_monitor", """
SELECT model, CAST(trade_date AS VARCHAR) AS trade_date, coalesce(n3 = 3 AND short3, false) AS stop, coalesce(n2 = 2 AND below2, false) AS kill FROM (
  SELECT m.model, m.trade_date, count(*) OVER w3 AS n3, bool_and(4.0 - m.hits > 1.5) OVER w3 AS short3, count(*) OVER w2 AS n2, bool_and(m.hits < o.hits) OVER w2 AS below2
  FROM mhits_v m JOIN mhits_v o ON o.trade_date = m.trade_date AND o.model = CASE m.model WHEN 'b4' THEN 'eb0' ELSE 'b1' END
  WHERE m.model <> 'eb0'
  WINDOW w3 AS (PARTITION BY m.model ORDER BY m.trade_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY m.model ORDER BY m.trade_date ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))""")
cte("ovl_v", """
SELECT a.trade_date, count(c.ticker) AS overlap_at_k FROM (SELECT trade_date, ticker FROM labels_v WHERE label = 1) a
LEFT JOIN cap_v c ON a.trade_date = c.trade_date AND a.ticker = c.ticker
WHERE day(a.trade_date) % 2 = 0 AND a.trade_date IN (SELECT trade_date FROM cap_v) GROUP BY a.trade_date
""")
cte("ovr_v", """
SELECT CAST(d AS DATE) AS trade_date, CAST(d AS DATE) IN (SELECT trade_date FROM labels_v) AS proxy_available,
       CAST(d AS DATE) IN (SELECT trade_date FROM cap_v WHERE day(trade_date) % 2 = 0) AS real_available, o.overlap_at_k
FROM (SELECT unnest(generate_series(CAST(min(trade_date) AS TIMESTAMP), CAST(max(trade_date) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM bars_v)
LEFT JOIN ovl_v o ON o.trade_date = CAST(d AS DATE) WHERE isodow(d) <= 5
""")
oracle("overlap_at_k", "SELECT CAST(trade_date AS VARCHAR) AS trade_date, overlap_at_k FROM ovl_v")
oracle("overlap_report", "SELECT * REPLACE (CAST(trade_date AS VARCHAR) AS trade_date) FROM ovr_v")
oracle("freeze_criterion", """
SELECT count(overlap_at_k) AS n_days, CAST(median(overlap_at_k) AS DOUBLE) AS median_overlap, coalesce(median(overlap_at_k) >= 4, false) AS met
FROM (SELECT * FROM ovr_v ORDER BY trade_date DESC LIMIT 30)""")
cte("smp_v", """
SELECT trade_date, ticker, rank, return_t FROM labels_v WHERE label = 1 AND trade_date < DATE '2001-01-01'
ORDER BY CAST(('0x' || left(md5('5|' || CAST(trade_date AS VARCHAR) || '|' || ticker), 13)) AS BIGINT), trade_date, ticker LIMIT 200
""")
oracle("sample_positives", "SELECT CAST(trade_date AS VARCHAR) AS trade_date, ticker, CAST(rank AS INTEGER) AS rank, return_t FROM smp_v")
cte("shr_v", """
SELECT category, count(s.rank) AS c, (SELECT count(*) FROM smp_v) AS n FROM (SELECT unnest(['scheduled_catalyst', 'carryover', 'unscheduled']) AS category)
LEFT JOIN (SELECT rank, CASE WHEN rank <= 2 THEN 'scheduled_catalyst' WHEN rank <= 6 THEN 'carryover' ELSE 'unscheduled' END AS cat FROM smp_v) s ON s.cat = category GROUP BY category
""")
cte("wils_v", "SELECT category, c, n, c / CAST(n AS DOUBLE) AS p, 1.959963984540054::DOUBLE AS z FROM shr_v")
oracle("category_share", """
SELECT category, c AS count, n, round(p, 9) AS share,
       round(greatest(0.0::DOUBLE, (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4.0::DOUBLE*n*n))) / (1 + z*z/n)), 9) AS ci_low,
       round(least(1.0::DOUBLE, (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4.0::DOUBLE*n*n))) / (1 + z*z/n)), 9) AS ci_high FROM wils_v""")
oracle("class_balance", """
SELECT n_pos, n_neg, round(n_neg / CAST(n_pos AS DOUBLE), 9) AS weight FROM (
  SELECT count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label <> 1) AS n_neg FROM labels_v)""")

# --- forecasts -----------------------------------------------------------------------------------------

cte("fq_v", """
SELECT * FROM (SELECT trade_date, ticker, min(ret) OVER w AS q10, lag(ret) OVER (PARTITION BY ticker ORDER BY trade_date) AS q50, max(ret) OVER w AS q90
  FROM bu_v WINDOW w AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE q50 IS NOT NULL
""")
cte("ff0_v", """
SELECT trade_date, ticker, q50 AS tfm_q50, q90 AS tfm_q90, q90 - q10 AS tfm_spread, ((q90 - q50) - (q50 - q10)) / nullif(q90 - q10, 0) AS tfm_skew_norm,
       (q90 - q50) / nullif(q50 - q10, 0) AS tfm_upside_ratio FROM fq_v
""")
cte("ff_v", """
SELECT *, (rank() OVER (PARTITION BY trade_date ORDER BY tfm_q90 NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, tfm_q90) - 1) / 2.0::DOUBLE) / count(tfm_q90) OVER (PARTITION BY trade_date) AS tfm_q90_xs_rank,
       CASE WHEN tfm_skew_norm IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY tfm_skew_norm NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, tfm_skew_norm) - 1) / 2.0::DOUBLE) / count(tfm_skew_norm) OVER (PARTITION BY trade_date) END AS tfm_skew_xs_rank
FROM ff0_v
""")
oracle("forecast_features", "SELECT * REPLACE (CAST(trade_date AS VARCHAR) AS trade_date) FROM ff_v")
oracle("bars_t1_forecast", """
SELECT CAST(b.trade_date AS VARCHAR) AS trade_date, b.ticker, xs_vol_rank, xs_ret_rank, top90, round(logpx, 8) AS logpx, dist52,
       round(vol20, 8) AS vol20, round(vol5, 8) AS vol5, round(relvol_prev, 8) AS relvol_prev, ret5, ret20, round(volofvol, 8) AS volofvol,
       round(logdv, 8) AS logdv, prev_ret1, was_top, top30, tfm_q50, tfm_q90, tfm_spread, tfm_skew_norm, tfm_upside_ratio, tfm_q90_xs_rank, tfm_skew_xs_rank,
       CAST(as_of AS VARCHAR) AS as_of FROM bf_v b LEFT JOIN ff_v f ON b.trade_date = f.trade_date AND b.ticker = f.ticker""")
cte("rdl_v", " UNION ALL ".join(
    f"SELECT b.trade_date, '{c}' AS feature, {c} AS x, xs_vol_rank AS y FROM bf_v b JOIN ff_v f ON b.trade_date = f.trade_date AND b.ticker = f.ticker WHERE xs_vol_rank IS NOT NULL AND {c} IS NOT NULL"
    for c in ("tfm_spread", "tfm_skew_norm", "tfm_q90")))
cte("rdr_v", """
SELECT trade_date, feature, rank() OVER (PARTITION BY trade_date, feature ORDER BY x) + (count(*) OVER (PARTITION BY trade_date, feature, x) - 1) / 2.0::DOUBLE AS rx,
       rank() OVER (PARTITION BY trade_date, feature ORDER BY y) + (count(*) OVER (PARTITION BY trade_date, feature, y) - 1) / 2.0::DOUBLE AS ry FROM rdl_v
""")
oracle("redundancy_spearman", """
SELECT feature, count(*) AS n_days, round(avg(rho), 7) AS spearman FROM (
  SELECT trade_date, feature, covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) AS rho FROM rdr_v GROUP BY 1, 2 HAVING sqrt(var_pop(rx) * var_pop(ry)) > 0) GROUP BY feature""")


def least_squares(source: str, xs, ys, tolerance: str = "1e-10::DOUBLE") -> str:
    """Normal equations as nested selects: covariances ``c<i>_<j>`` of ``source`` reduced column by column (``l<i>_<j>``)."""
    cols = [*xs, *ys]
    pairs = [f"covar_pop({a}, {b}) AS c{i}_{j}" for i, a in enumerate(cols) for j, b in enumerate(cols[: i + 1])]
    means = [f"avg({c}) AS m{i}" for i, c in enumerate(cols)]
    sql = source.format(moments=", ".join([*pairs, *means]))
    for j in range(len(xs)):
        def left(i):
            return f"(c{i}_{j}" + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j)) + ")"

        made = ", ".join(f"CASE WHEN {left(j)} > c{j}_{j} * {tolerance} THEN {left(i)} / sqrt({left(j)}) ELSE 0.0::DOUBLE END AS l{i}_{j}" for i in range(j, len(cols)))
        sql = f"SELECT *, {made} FROM ({sql})"
    return sql


_inc, _new = ("vol5", "vol20", "xs_vol_rank", "relvol_prev", "dist52", "logpx"), ("tfm_spread", "tfm_skew_norm")
cte("rdc_v", "SELECT b.trade_date, " + ", ".join([*_inc, *_new]) + " FROM bf_v b JOIN ff_v f ON b.trade_date = f.trade_date AND b.ticker = f.ticker WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in (*_inc, *_new)))
cte("rdp_v", "SELECT " + ", ".join(
    f"(rank() OVER (PARTITION BY trade_date ORDER BY {c}) + (count(*) OVER (PARTITION BY trade_date, {c}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY trade_date) AS {c}_p0"
    for c in (*_inc, *_new)) + ", count(*) OVER (PARTITION BY trade_date) AS n_p0 FROM rdc_v")
cte("rdq_v", "SELECT " + ", ".join(f"{c}_p0 - (n_p0 + 1) / (2.0::DOUBLE * n_p0) AS {c}" for c in (*_inc, *_new)) + " FROM rdp_v")
cte("rds_v", least_squares("SELECT {moments} FROM rdq_v", _inc, _new))
oracle("redundancy_gate", """
SELECT * FROM (WITH s AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, 1.0::DOUBLE - (" + " + ".join(f"l{6 + i}_{k} * l{6 + i}_{k}" for k in range(6)) + f") / c{6 + i}_{6 + i} AS residual_share FROM rds_v" for i, c in enumerate(_new)) + """),
r AS (SELECT feature, avg(rho) AS spearman FROM (
  SELECT trade_date, feature, covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) AS rho FROM rdr_v GROUP BY 1, 2 HAVING sqrt(var_pop(rx) * var_pop(ry)) > 0) GROUP BY feature),
v AS (SELECT feature, spearman, residual_share, abs(spearman) >= 0.9 OR residual_share < 0.1 AS redundant FROM s JOIN r USING (feature))
SELECT feature, round(spearman, 7) AS spearman, round(residual_share, 7) AS residual_share, redundant, bool_and(redundant) OVER () AS stop FROM v)""")

# Least squares refitted by year on the warmed-up pool, against the same-pool baselines.
_X = C.T1B_SPEC.features
cte("wfp_v", "SELECT f.trade_date, f.ticker, " + ", ".join(f"CAST(f.{c} AS DOUBLE) AS {c}" for c in _X) + ", CAST(u.label AS DOUBLE) AS y FROM bf_v f JOIN bu_v u "
    "ON f.trade_date = u.trade_date AND f.ticker = u.ticker WHERE " + " AND ".join(f"f.{c} IS NOT NULL" for c in _X))
cte("wfs_v", """
SELECT * FROM (SELECT y, test_start, test_end, lag(test_end) OVER (ORDER BY y) AS train_end, min(y) OVER () AS first_year
  FROM (SELECT year(trade_date) AS y, min(trade_date) AS test_start, max(trade_date) AS test_end FROM wfp_v GROUP BY 1))
WHERE train_end IS NOT NULL AND y >= first_year + 2
""")
_n = len(_X)
_solved = least_squares("SELECT s.y AS split, any_value(test_start) AS t0, any_value(test_end) AS t1, {moments} FROM wfp_v p JOIN wfs_v s ON p.trade_date <= s.train_end GROUP BY s.y",
                        [f"p.{c}" for c in _X], ["p.y"])
for _i in reversed(range(_n)):
    _rest = f"(l{_n}_{_i}" + "".join(f" - l{_k}_{_i} * w{_k}" for _k in range(_i + 1, _n)) + ")"
    _solved = f"SELECT *, CASE WHEN l{_i}_{_i} > 0 THEN {_rest} / l{_i}_{_i} ELSE 0.0::DOUBLE END AS w{_i} FROM ({_solved})"
cte("wfw_v", _solved)
cte("wft_v", "SELECT p.trade_date, p.ticker, p.y AS label, " + " + ".join(f"w{_i} * ({c} - m{_i})" for _i, c in enumerate(_X))
    + " AS score FROM wfp_v p JOIN wfw_v w ON p.trade_date BETWEEN w.t0 AND w.t1")
cte("wfh_v", """
SELECT trade_date, CAST(sum(label) AS BIGINT) AS hits FROM (SELECT * FROM wft_v QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, ticker) <= 10) GROUP BY 1
""")
cte("wfc_v", "SELECT trade_date AS session, lead(trade_date) OVER (ORDER BY trade_date) AS next_session FROM (SELECT DISTINCT trade_date FROM bu_v)")
cte("wfb_v", """
SELECT 'B1' AS baseline, next_session AS trade_date, ticker, max(rank) OVER (PARTITION BY trade_date) + 1.0 - rank AS score FROM bu_v JOIN wfc_v ON trade_date = session WHERE label = 1
UNION ALL
SELECT 'B2', next_session, ticker, v FROM (
  SELECT trade_date, ticker, CASE WHEN count(r) OVER w = 5 THEN stddev_samp(r) OVER w END AS v
  FROM (SELECT trade_date, ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY trade_date) - 1.0 AS r FROM bu_v)
  WINDOW w AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) JOIN wfc_v ON trade_date = session WHERE v IS NOT NULL
""")
cte("wfbh_v", """
SELECT baseline, trade_date, CAST(sum(label) AS BIGINT) AS hits FROM (
  SELECT b.baseline, b.trade_date, p.y AS label FROM wfb_v b JOIN wfp_v p ON b.trade_date = p.trade_date AND b.ticker = p.ticker
  QUALIFY row_number() OVER (PARTITION BY baseline, b.trade_date ORDER BY score DESC, b.ticker) <= 10) GROUP BY 1, 2
""")
oracle("walkforward_linear", """
SELECT * FROM (WITH d AS (SELECT b.baseline, year(m.trade_date) AS y, m.hits AS mh, b.hits AS bh FROM wfh_v m JOIN wfbh_v b ON m.trade_date = b.trade_date),
y AS (SELECT baseline, y, avg(mh) > avg(bh) AS won FROM d GROUP BY 1, 2)
SELECT d.baseline, round(avg(mh) - avg(bh), 7) AS mean_hits_delta, (SELECT CAST(count(*) FILTER (WHERE won) AS BIGINT) FROM y WHERE y.baseline = d.baseline) AS years_won,
       (SELECT count(*) FROM y WHERE y.baseline = d.baseline) AS years_total, count(*) AS n_days
FROM d GROUP BY d.baseline)""")

# --- streaming -------------------------------------------------------------------------------------------

cte("wm_v", "SELECT max(date_trunc('millisecond', ts)) - INTERVAL 10 MINUTE AS wm FROM events")
oracle("stream_minute_bars", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, ticker, CAST(minute AS VARCHAR) AS minute, open, high, low, close, volume, trade_count, CAST(as_of AS VARCHAR) AS as_of
FROM minutes_v""")
oracle("stream_premarket", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, ticker, arg_max(value, row(ts, event_id)) AS last_price, max(value) AS high_price, CAST(count(*) * 100 AS DOUBLE) AS total_volume,
       CAST(sum(CAST(value * 100 AS DECIMAL(28,6))) AS DOUBLE) AS premarket_dollar_volume, count(*) AS premarket_trade_count, CAST(min(ts) AS VARCHAR) AS first_tick
FROM ticks_v, wm_v WHERE hour(ts) * 60 + minute(ts) < 565 AND CAST(trade_date AS TIMESTAMP) + INTERVAL '9 hours 25 minutes' <= wm GROUP BY trade_date, ticker""")
oracle("stream_quarantine", """
SELECT CASE WHEN day(settlement_date) > 20 THEN 'quarantine' ELSE 'accepted' END AS side, ticker, count(*) AS n_rows FROM si_v GROUP BY 1, 2""")
oracle("stream_predictions", "SELECT CAST(trade_date AS VARCHAR) AS trade_date, ticker, round(score, 8) AS score FROM b2_v")
oracle("resumable_build", "SELECT CAST(trade_date AS VARCHAR) AS trade_date, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_positive FROM labels_v GROUP BY trade_date")
oracle("feature_sink", """
SELECT ticker, count(*) AS n_rows, CAST(max(as_of) AS VARCHAR) AS last_as_of FROM bf_v WHERE as_of <= TIMESTAMP '1999-12-31 16:00:00' GROUP BY ticker""")


def all_sql() -> dict[str, str]:
    return {name: build(sql) for name, sql in ORACLES.items()}
