"""Common table expressions of the checking SQL: the adapters in another dialect."""

LINES = """
lines AS (
  SELECT l_suppkey, l_linenumber, CAST(l_shipdate AS DATE) AS trading_date, l_returnflag, l_linestatus,
         CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents,
         CAST(l_quantity AS BIGINT) AS qty,
         CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) // CAST(l_quantity AS BIGINT) AS unit
  FROM lineitem)"""

BARS = LINES + """,
bars AS (
  SELECT CAST(l_suppkey + 1000 AS VARCHAR) AS ticker, l_suppkey, trading_date,
         max(unit) FILTER (WHERE l_returnflag = 'N') AS open_c,
         max(unit) FILTER (WHERE l_returnflag <> 'R') AS high_c,
         min(unit) FILTER (WHERE l_returnflag <> 'R') AS low_c,
         CAST(2 * sum(cents) FILTER (WHERE l_returnflag <> 'R') + sum(qty) FILTER (WHERE l_returnflag <> 'R') AS BIGINT)
           // CAST(2 * sum(qty) FILTER (WHERE l_returnflag <> 'R') AS BIGINT) AS close_c,
         CAST(sum(cents) AS BIGINT) AS trading_value,
         CAST(sum(qty) AS BIGINT) AS trading_volume,
         count(*) AS transaction_count,
         max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS open_line
  FROM lines GROUP BY l_suppkey, trading_date)"""

LISTING = """
listing AS (
  SELECT s_suppkey, CAST(s_suppkey + 1000 AS VARCHAR) AS ticker, s_name, s_acctbal,
         CASE WHEN n_regionkey IN (0, 2, 4) THEN 'TWSE' ELSE 'TPEX' END AS market
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
stocks AS (SELECT ticker, s_name AS name, market FROM listing WHERE s_acctbal >= 0)"""

QUOTES = BARS + "," + LISTING + """,
quotes AS (
  SELECT market, b.ticker, s_name || CASE WHEN open_line = 1 THEN ' O' ELSE '' END AS name, trading_date,
         open_c / 100.0::DOUBLE AS open_price, high_c / 100.0::DOUBLE AS high_price,
         low_c / 100.0::DOUBLE AS low_price, close_c / 100.0::DOUBLE AS close_price,
         trading_value, trading_volume, transaction_count
  FROM bars b JOIN listing l ON b.l_suppkey = l.s_suppkey)"""

NON_REGULAR = """
excluded AS (
  SELECT CAST(l_suppkey + 1000 AS VARCHAR) AS ticker, trading_date,
         CAST(sum(cents) AS BIGINT) AS excluded_value, CAST(sum(qty) AS BIGINT) AS excluded_volume
  FROM lines WHERE l_returnflag = 'R' GROUP BY 1, 2)"""

EVENTS = """
actions AS (
  SELECT CAST(l_suppkey + 1000 AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS effective_date,
         l_extendedprice AS previous_close, l_extendedprice * (1 - l_discount) AS reference_price
  FROM lineitem WHERE l_linenumber = 7 AND l_discount >= 0.09 AND l_quantity >= 45)"""

INDEX = """
idx AS (
  SELECT CAST(o_orderdate AS DATE) AS trading_date,
         CASE WHEN n_regionkey IN (0, 2, 4) THEN 'TWSE' ELSE 'TPEX' END AS market,
         CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS value_c
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2)"""

REVENUE = """
monthly AS (
  SELECT CAST(l_suppkey + 1000 AS VARCHAR) AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS revenue,
         year(date_trunc('month', min(l_shipdate))) * 12 + month(min(l_shipdate)) AS m
  FROM lineitem GROUP BY l_suppkey, date_trunc('month', l_shipdate))"""

INTRADAY = """
ticks AS (
  SELECT CAST(ts AS DATE) AS trade_date, date_trunc('hour', ts) AS captured_at,
         CAST(user_id + 1000 AS VARCHAR) AS ticker, event_id, event_type,
         CAST(floor(value * 100 + 0.5) AS BIGINT) AS price_c,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS lots,
         CAST(floor(value * 100 + 0.5) AS BIGINT) * CAST(json_extract_string(props, '$.k') AS BIGINT) * 1000 AS turnover
  FROM events),
rounds AS (
  SELECT trade_date, captured_at, quote_count,
         CAST(sum(traded) OVER (PARTITION BY trade_date ORDER BY captured_at) AS BIGINT)
           // CASE WHEN CAST(epoch(captured_at) AS BIGINT) // 3600 % 13 = 5 THEN 2 ELSE 1 END AS turnover_total
  FROM (SELECT trade_date, captured_at, sum(turnover) AS traded, count(*) AS quote_count FROM ticks GROUP BY 1, 2))"""

NOTICES = """
notices AS (
  SELECT CAST(o_custkey + 1000 AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS start,
         CAST(o_orderdate AS DATE) + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 10 AS "end",
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 5 AS matching_minutes, o_orderkey AS source_order
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))"""

ALTERED = """
altered AS (
  SELECT DISTINCT CAST(o_custkey + 1000 AS VARCHAR) AS ticker
  FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW')"""


def ranking_ctes(n: int, end: str | None, mode: str, market: str, minimum: int) -> str:
    """CTEs up to ``ranked``: the whole ranking, value columns in cents."""
    known = "bars" if end is None else f"(SELECT * FROM bars WHERE trading_date <= DATE '{end}')"
    need = n * (3 if mode == "acceleration" else 2)
    key, previous_key = (
        ("change_rate", "previous_change_rate") if mode == "acceleration" else ("average_value", "previous_average_value")
    )
    comparable = f"{previous_key} IS NOT NULL" + ("" if mode == "acceleration" else f" AND {previous_key} > 0")
    wanted = "TRUE" if market == "all" else f"market = '{market}'"
    return BARS + "," + LISTING + f""",
known AS (SELECT * FROM {known}),
cal AS (
  SELECT trading_date, row_number() OVER (ORDER BY trading_date DESC) - 1 AS age, count(*) OVER () AS n_dates,
         max(trading_date) OVER () AS base_date
  FROM (SELECT DISTINCT trading_date FROM known)),
aged AS (SELECT k.*, age, n_dates, base_date FROM known k JOIN cal USING (trading_date)),
stats AS (
  SELECT ticker, any_value(n_dates) AS n_dates,
         coalesce(sum(trading_value) FILTER (WHERE age < {n}), 0) AS total,
         coalesce(sum(trading_value) FILTER (WHERE age >= {n} AND age < {2 * n}), 0) AS previous_total,
         coalesce(sum(trading_value) FILTER (WHERE age >= {2 * n} AND age < {3 * n} AND n_dates >= {3 * n}), 0) AS prior_total,
         count(*) FILTER (WHERE age < {n} AND trading_value > 0) AS active_days,
         arg_max(close_c, trading_date) FILTER (WHERE age < {n} AND close_c IS NOT NULL) AS end_c,
         arg_max(close_c, trading_date) FILTER (WHERE age >= {n} AND close_c IS NOT NULL) AS base_c,
         max(close_c) FILTER (WHERE age = 0) AS day_c,
         arg_max(close_c, trading_date) FILTER (WHERE age > 0 AND close_c IS NOT NULL) AS day_base_c,
         arg_max(close_c, trading_date)
           FILTER (WHERE trading_date < date_trunc('week', base_date) AND close_c IS NOT NULL) AS week_base_c
  FROM aged GROUP BY ticker),
totals AS (SELECT sum(total) AS market_total, sum(previous_total) AS previous_market_total FROM stats),
cand AS (
  SELECT s.*, t.*, k.name, k.market,
         total / {n}.0::DOUBLE AS average_value, previous_total / {n}.0::DOUBLE AS previous_average_value,
         CASE WHEN previous_total <> 0
              THEN (total - previous_total)::DOUBLE / previous_total::DOUBLE END AS change_rate,
         CASE WHEN prior_total <> 0
              THEN (previous_total - prior_total)::DOUBLE / prior_total::DOUBLE END AS previous_change_rate,
         CASE WHEN base_c > 0 THEN (end_c - base_c)::DOUBLE / base_c END AS price_change,
         CASE WHEN day_base_c > 0 THEN (day_c - day_base_c)::DOUBLE / day_base_c END AS daily_price_change,
         CASE WHEN week_base_c > 0 THEN (day_c - week_base_c)::DOUBLE / week_base_c END AS weekly_price_change,
         CASE WHEN market_total = 0 THEN 0.0::DOUBLE ELSE total::DOUBLE / market_total::DOUBLE END AS share,
         CASE WHEN previous_market_total = 0 THEN 0.0::DOUBLE
              ELSE previous_total::DOUBLE / previous_market_total::DOUBLE END AS previous_share
  FROM stats s CROSS JOIN totals t JOIN stocks k USING (ticker)
  WHERE n_dates >= {need} AND NOT (total = 0 AND active_days = 0 AND end_c IS NULL)
    AND total >= {minimum} * {n} AND {wanted}),
placed AS (
  SELECT *, row_number() OVER (ORDER BY {key} DESC NULLS LAST, ticker) AS "rank",
         row_number() OVER (ORDER BY {previous_key} DESC NULLS LAST, ticker) AS prev_position
  FROM cand),
ranked AS (
  SELECT *, CASE WHEN {comparable} THEN prev_position END AS previous_rank,
         CASE WHEN {comparable} THEN prev_position - "rank" END AS rank_change
  FROM placed)"""
