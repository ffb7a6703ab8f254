"""Pieces of the comparison SQL: the input tables as CTEs, and exact rounding."""

from __future__ import annotations

ORDER_LOGINS = "logins AS (SELECT o_custkey AS user_id, CAST(o_orderdate AS DATE) AS login_date FROM orders)"
EVENT_LOGINS = "logins AS (SELECT user_id, CAST(ts AS DATE) AS login_date FROM events)"
ORDER_USERS = (
    "users AS (SELECT o_custkey AS user_id, CAST(min(o_orderdate) AS DATE) AS create_date FROM orders GROUP BY 1)"
)
EVENT_USERS = """users AS (
    SELECT user_id, CAST(min(ts) AS DATE) AS create_date, CAST(user_id AS VARCHAR) AS attribute_id
    FROM events WHERE event_type = 'signup' GROUP BY user_id)"""
INSTALLS = """installs AS (
    SELECT 'organic' AS attribute_type, ts AS install_time, CAST(user_id AS VARCHAR) AS attribute_id,
           CAST(NULL AS VARCHAR) AS campaign
    FROM events WHERE event_type = 'view'
    UNION ALL
    SELECT 'non_organic', ts, CAST(user_id AS VARCHAR), json_extract_string(props, '$.k')
    FROM events WHERE event_type = 'click')"""
SEGMENT_USERS = """users AS (
    SELECT o.user_id, o.create_date, c_mktsegment AS campaign,
           CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'organic' ELSE 'non_organic' END AS attribute_type
    FROM (SELECT o_custkey AS user_id, CAST(min(o_orderdate) AS DATE) AS create_date FROM orders GROUP BY 1) o
    JOIN customer ON c_custkey = o.user_id)"""
USER_REGION = """user_region AS (
    SELECT c_custkey AS user_id, r_name || '-' || n_name AS region, r_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SALES = """sales AS (
    SELECT o_orderdate AS order_date, s_name AS pickup_shop_name, sr.r_name AS shop_region, o_custkey AS user_id,
           CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS payment_amount
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey
    JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey)"""
COST = """cost AS (
    SELECT CAST(l_shipdate AS DATE) AS aggregate_date,
           CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(4,2)) AS cost, c_mktsegment AS campaign
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)"""
#: The end of the last full month of the orders, which the CTEs of the cohorts call (order_date, user_id, amount).
OBSERVED = """observed AS (
    SELECT CASE WHEN last_day(d) = d THEN d ELSE CAST(date_trunc('month', d) AS DATE) - 1 END AS obs_end
    FROM (SELECT max(CAST(order_date AS DATE)) AS d FROM spend))"""
OBS_END = "(SELECT obs_end FROM observed)"


def month(c: str) -> str:
    return f"strftime({c}, '%Y-%m')"


def half_up(numerator: str, denominator: str, digits: int) -> str:
    """Quotient of two integers rounded half away from zero, in integer arithmetic; null on a zero base."""
    scale = 10**digits
    top, base = f"CAST({numerator} AS HUGEINT)", f"CAST({denominator} AS HUGEINT)"
    return (
        f"CASE WHEN {base} <> 0 THEN CAST(sign({top}) * ((2 * abs({top}) * {scale} + {base}) // (2 * {base})) AS DOUBLE)"
        f" / CAST({scale} AS DOUBLE) END"
    )


def cents(amount: str, digits: int = 2) -> str:
    """An amount with ``digits`` decimals as an integer."""
    return f"CAST(({amount}) * {10**digits} AS HUGEINT)"
