"""The metric tables over the star-schema inputs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timekeys import month_from_key
from tidemark.operators import (
    activity,
    annotate,
    attribution,
    cohorts,
    cost,
    growth,
    intervals,
    profile,
    retention,
    sales,
    value,
)
from tidemark.plans import star_inputs as inputs
from tidemark.plans.registry import query
from tidemark.plans.sql_parts import (
    COST,
    EVENT_LOGINS,
    EVENT_USERS,
    INSTALLS,
    OBS_END,
    OBSERVED,
    ORDER_LOGINS,
    ORDER_USERS,
    SALES,
    SEGMENT_USERS,
    USER_REGION,
    cents,
    half_up,
    month,
)

REF_MONTH = "2001-07"
#: Months for which a campaign cohort must have been tracked.
HORIZON = 12
WORLD_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
EVENT_PERIODS = (
    (dt.date(2024, 1, 5), dt.date(2024, 1, 9), "shop opening"),
    (dt.date(2024, 1, 8), dt.date(2024, 1, 12), "campaign"),
    (dt.date(2024, 1, 21), dt.date(2024, 1, 30), "third week on"),
)
ORDER_PERIODS = (
    (dt.date(1995, 12, 15), dt.date(1996, 4, 15), "falling"),
    (dt.date(2001, 6, 1), dt.date(2001, 8, 31), "closing"),
)
OPEN_PERIODS = (
    (None, dt.date(2024, 1, 6), "before the campaign"),
    (dt.date(2024, 1, 5), dt.date(2024, 1, 12), "campaign"),
    (dt.date(2024, 1, 21), None, "third week on"),
    (dt.date(2024, 1, 9), dt.date(2024, 1, 8), "ends before it begins"),
)
MONTH_PERIODS = (("1995-12", "1996-04", "falling"), ("1996-03", "1999-10", "long"), (None, "1995-02", "start"), ("2001-06", None, "closing"))
INDEX_PERIODS = (("M+0", "M+2", "trial"), ("M+2", "M+5", "habit"), ("M+24", None, "loyal"))


# --- sales and cost ---------------------------------------------------------


def _named(spark: SparkSession, sf_dir: str, sums: DataFrame) -> DataFrame:
    """Replace the shop key of finished sums with the shop's name."""
    return sales.shop_sales_located(sums, inputs.shop_names(spark, sf_dir), "shop_id").drop("shop_id")


@query(f"""
WITH {SALES}
SELECT pickup_shop_name, CAST(sum(payment_amount) AS DOUBLE) AS sales, count(DISTINCT user_id) AS pu
FROM sales GROUP BY 1""")
def shop_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir, sales.shop_sales(inputs.shop_orders(spark, sf_dir), shop="shop_id"))


@query(f"""
WITH {SALES}
SELECT {month('order_date')} AS order_year_month, pickup_shop_name, 'payment_amount' AS variable,
       CAST(sum(payment_amount) AS DOUBLE) AS value
FROM sales GROUP BY 1, 2""")
def shop_sales_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir, sales.shop_sales_monthly(inputs.shop_orders(spark, sf_dir), shop="shop_id"))


PIVOT_CASES = {r: f"r_name = '{r}'" for r in WORLD_REGIONS} | {
    "other": f"r_name IS NULL OR r_name NOT IN {WORLD_REGIONS}"
}
PIVOT_COLUMNS = ", ".join(
    f"CAST(sum(CASE WHEN {case} THEN payment_amount END) AS DOUBLE) AS \"{c}\"" for c, case in PIVOT_CASES.items()
)
FILLED_COLUMNS = ", ".join(
    f"CAST(coalesce(sum(CASE WHEN {case} THEN payment_amount END), 0) AS DOUBLE) AS \"{c}\""
    for c, case in PIVOT_CASES.items()
)


@query(f"""
WITH {SALES}, {USER_REGION}
SELECT {month('order_date')} AS order_year_month, pickup_shop_name, {PIVOT_COLUMNS}
FROM sales LEFT JOIN user_region USING (user_id) GROUP BY 1, 2""")
def shop_region_sales_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, regions = inputs.shop_orders(spark, sf_dir), inputs.user_world_region(spark, sf_dir)
    return _named(spark, sf_dir, sales.shop_region_sales_pivot(orders, regions, WORLD_REGIONS, shop="shop_id"))


@query(f"""
WITH {SALES}, {USER_REGION}
SELECT {month('order_date')} AS order_year_month, shop_region AS pickup_shop_name, {FILLED_COLUMNS}
FROM sales LEFT JOIN user_region USING (user_id) WHERE {month('order_date')} = '{REF_MONTH}' GROUP BY 1, 2""")
def shop_region_sales_pivot_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, regions = inputs.shop_region_orders(spark, sf_dir), inputs.user_world_region(spark, sf_dir)
    return sales.shop_region_sales_pivot(orders, regions, WORLD_REGIONS, month=REF_MONTH, fill_zero=True)


@query(f"""
WITH {COST}
SELECT aggregate_date, {month('aggregate_date')} AS aggregate_year_month, CAST(sum(cost) AS DOUBLE) AS cost
FROM cost GROUP BY 1, 2""")
def daily_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.daily_cost(inputs.cost(spark, sf_dir))


@query(f"""
WITH {COST}
SELECT {month('aggregate_date')} AS aggregate_year_month, CAST(sum(cost) AS DOUBLE) AS cost FROM cost GROUP BY 1""")
def monthly_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.monthly_cost(cost.daily_cost(inputs.cost(spark, sf_dir)))


# --- signups by attribution -------------------------------------------------


def _signups_sql(period: str, column: str, join: str) -> str:
    return f"""
WITH {EVENT_USERS}, {INSTALLS}
SELECT {period} AS {column}, attribute_type, count(DISTINCT user_id) AS user_cnt
FROM users {join} JOIN installs
  ON users.attribute_id IS NOT DISTINCT FROM installs.attribute_id
 AND users.create_date IS NOT DISTINCT FROM CAST(installs.install_time AS DATE)
GROUP BY 1, 2"""


def _signups(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    installs = inputs.organic_installs(spark, sf_dir), inputs.non_organic_installs(spark, sf_dir)
    return attribution.signups_by_attribution(inputs.event_users(spark, sf_dir), *installs, **options)


@query(_signups_sql("create_date", "create_date", ""))
def signups_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signups(spark, sf_dir)


@query(_signups_sql(month("create_date"), "create_year_month", ""))
def signups_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signups(spark, sf_dir, grain="month")


@query(_signups_sql("create_date", "create_date", "LEFT"))
def signups_daily_with_unattributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signups(spark, sf_dir, keep_unattributed=True)


# --- lifetime value and return on ad spend ----------------------------------


SPEND = "spend AS (SELECT o_custkey AS user_id, o_orderdate AS order_date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders)"
LATER_SPEND = SPEND.replace("o_orderdate AS", f"o_orderdate + INTERVAL {inputs.LATER_YEARS} YEAR AS")


def _ltv_ctes(by: str, with_all: bool, users: str = SEGMENT_USERS, spend: str = SPEND) -> str:
    """Sizes, cumulative revenue and periods of the cohorts, summed straight from the orders.

    ``users`` may hold a user several times, with different values of ``by``.
    """
    groups = f"SELECT user_id, create_date, {by} AS grp FROM users"
    if with_all:
        groups += " UNION SELECT user_id, create_date, 'all' FROM users"
    return f"""{users}, {spend}, {OBSERVED},
members AS (SELECT *, date_trunc('month', create_date) AS m
            FROM ({groups}) WHERE date_trunc('month', create_date) <= {OBS_END}),
cohort AS (SELECT grp, m, count(*) AS user_cnt FROM members GROUP BY 1, 2),
bought AS (
    SELECT grp, m, date_diff('month', m, order_date) AS p, sum(amount) AS paid
    FROM members JOIN spend USING (user_id)
    WHERE CAST(order_date AS DATE) >= create_date AND CAST(order_date AS DATE) <= {OBS_END}
    GROUP BY 1, 2, 3),
ltv AS (
    SELECT c.grp, {month('c.m')} AS create_year_month, CAST(n AS INTEGER) AS ltv_period, c.user_cnt,
           coalesce(sum(b.paid), 0) AS revenue
    FROM (SELECT *, unnest(range(0, date_diff('month', m, {OBS_END}) + 1)) AS n FROM cohort) c
    LEFT JOIN bought b ON b.grp = c.grp AND b.m = c.m AND b.p <= n
    GROUP BY 1, 2, 3, 4)"""


LTV_VALUE = half_up(cents("revenue"), "user_cnt * 100", 2)


def _ltv_sql(by: str, ctes: str) -> str:
    return f"""
WITH {ctes}
SELECT grp AS {by}, create_year_month, ltv_period, user_cnt, CAST(revenue AS DOUBLE) AS revenue, {LTV_VALUE} AS ltv
FROM ltv"""


def _roas_sql(by: str, ctes: str, cost_key: str, horizon: int, cost: str = COST, digits: int = 4) -> str:
    keys, match = ("", "") if not cost_key else (f"{cost_key},", f" AND s.{cost_key} = l.grp")
    group = "1, 2" if cost_key else "1"
    closed = f"date_diff('month', CAST(l.create_year_month || '-01' AS DATE), {OBS_END}) >= {horizon}"
    return f"""
WITH {ctes}, {cost},
spent AS (SELECT {keys} {month('aggregate_date')} AS ym, sum(cost) AS cost FROM cost GROUP BY {group})
SELECT grp AS {by}, create_year_month, ltv_period, user_cnt, CAST(revenue AS DOUBLE) AS revenue,
       {LTV_VALUE} AS ltv, CAST(s.cost AS DOUBLE) AS cost,
       {half_up(cents('revenue', digits), cents('s.cost', digits), 4)} AS roas
FROM ltv l LEFT JOIN spent s ON s.ym = l.create_year_month{match}
WHERE {closed}"""


@query(_ltv_sql("attribute_type", _ltv_ctes("attribute_type", True)))
def cohort_ltv(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, orders = inputs.segment_users(spark, sf_dir), inputs.orders(spark, sf_dir)
    return value.cohort_ltv(users, orders, None, value.observed_to(orders))


@query(_roas_sql("attribute_type", _ltv_ctes("attribute_type", True), "", 1))
def roas_by_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = inputs.orders(spark, sf_dir)
    users, cost_rows = inputs.segment_users(spark, sf_dir), inputs.cost(spark, sf_dir)
    return value.roas_by_attribute(users, orders, cost_rows, None, value.observed_to(orders))


@query(_roas_sql("campaign", _ltv_ctes("campaign", False), "campaign", HORIZON))
def roas_by_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = inputs.orders(spark, sf_dir)
    users, cost_rows = inputs.segment_users(spark, sf_dir), inputs.campaign_cost(spark, sf_dir)
    return value.roas_by_campaign(users, orders, cost_rows, None, value.observed_to(orders), horizon=HORIZON)


def _install_users(attribute: str) -> str:
    """CTE ``users``: the signups with each type or campaign of their installs."""
    signups = EVENT_USERS.replace("users AS", "signups AS", 1)
    return f"""{signups}, {INSTALLS},
users AS (
    SELECT DISTINCT user_id, create_date, {attribute} FROM signups JOIN installs
    ON signups.attribute_id = installs.attribute_id AND create_date = CAST(install_time AS DATE)
    WHERE {attribute} IS NOT NULL)"""


CLICK_COST = """cost AS (
    SELECT CAST(ts AS DATE) AS aggregate_date, json_extract_string(props, '$.k') AS campaign, CAST(value AS DECIMAL(18,2)) AS cost
    FROM events WHERE event_type = 'click')"""


def _signups_and_installs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    installs = inputs.organic_installs(spark, sf_dir), inputs.non_organic_installs(spark, sf_dir)
    return inputs.event_users(spark, sf_dir), *installs


@query(_ltv_sql("attribute_type", _ltv_ctes("attribute_type", True, _install_users("attribute_type"), LATER_SPEND)))
def cohort_ltv_by_install(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts whose members overlap: a user may have organic and paid installs of the signup day."""
    return value.cohort_ltv_by_install(*_signups_and_installs(spark, sf_dir), inputs.later_orders(spark, sf_dir))


@query(_roas_sql("campaign", _ltv_ctes("campaign", False, _install_users("campaign"), LATER_SPEND), "campaign", HORIZON, CLICK_COST, 2))
def roas_by_install_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, spent = inputs.later_orders(spark, sf_dir), inputs.click_cost(spark, sf_dir)
    return value.roas_by_install_campaign(*_signups_and_installs(spark, sf_dir), orders, spent, horizon=HORIZON)


# --- active and new users ---------------------------------------------------

MAU_SQL = f"SELECT {month('login_date')} AS login_year_month, count(DISTINCT user_id) AS login_user_cnt FROM logins GROUP BY 1"
NRU_SQL = f"SELECT {month('create_date')} AS create_year_month, count(DISTINCT user_id) AS user_cnt FROM users GROUP BY 1"


@query(f"WITH {ORDER_LOGINS} {MAU_SQL}")
def mau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.mau(inputs.order_logins(spark, sf_dir))


@query(f"WITH {EVENT_LOGINS} SELECT login_date, count(DISTINCT user_id) AS dau FROM logins GROUP BY 1")
def dau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.dau(inputs.event_logins(spark, sf_dir))


@query(f"WITH {ORDER_USERS} {NRU_SQL}")
def nru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.nru(inputs.order_users(spark, sf_dir))


@query(f"""
WITH {ORDER_LOGINS}, {ORDER_USERS}, a AS ({MAU_SQL}), n AS ({NRU_SQL})
SELECT coalesce(login_year_month, create_year_month) AS year_month, login_user_cnt AS mau, user_cnt AS nru,
       coalesce(login_year_month = (SELECT max(login_year_month) FROM a), FALSE) AS is_latest
FROM a FULL JOIN n ON login_year_month = create_year_month
WHERE coalesce(login_year_month, create_year_month) >= '1996-01'""")
def mau_nru_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = activity.mau(inputs.order_logins(spark, sf_dir))
    return activity.mau_nru_series(active, activity.nru(inputs.order_users(spark, sf_dir)), start="1996-01")


def _au_sql(key: str, column: str) -> str:
    return f"""
WITH {ORDER_LOGINS}, {ORDER_USERS}
SELECT {month('login_date')} AS login_year_month, {key} AS {column}, count(DISTINCT user_id) AS user_cnt
FROM logins JOIN users USING (user_id) GROUP BY 1, 2"""


def _au(spark: SparkSession, sf_dir: str, grain: str = "month") -> DataFrame:
    return activity.au_by_signup(inputs.order_logins(spark, sf_dir), inputs.order_users(spark, sf_dir), grain)


@query(_au_sql("strftime(create_date, '%Y')", "create_year"))
def au_by_signup_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _au(spark, sf_dir, "year")


AU_MONTH_SQL = _au_sql(month("create_date"), "create_year_month")


@query(AU_MONTH_SQL)
def au_by_signup_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _au(spark, sf_dir)


# --- regional growth --------------------------------------------------------

MAU_REGION_SQL = f"""SELECT coalesce(region, 'unknown') AS region, {month('login_date')} AS ym,
           count(DISTINCT user_id) AS user_cnt
    FROM logins LEFT JOIN user_region USING (user_id) GROUP BY 1, 2"""
NRU_REGION_SQL = f"""SELECT coalesce(region, 'unknown') AS region, {month('create_date')} AS ym,
           count(DISTINCT user_id) AS user_cnt
    FROM users LEFT JOIN user_region USING (user_id) GROUP BY 1, 2"""


def _growth_ctes(counts: str, prefix: str = "", calendar: bool = False) -> str:
    """CTE ``{prefix}banded``: exact rates from the counts of ``counts``."""
    previous = "lag(user_cnt) OVER (PARTITION BY region ORDER BY ym)"
    if calendar:
        previous = f"""(SELECT p.user_cnt FROM {prefix}counts p WHERE p.region = c.region
            AND p.ym = strftime(CAST(c.ym || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m'))"""
    return f"""{prefix}counts AS ({counts}),
{prefix}lagged AS (
    SELECT region, ym, user_cnt, CAST(row_number() OVER (PARTITION BY region ORDER BY ym) AS INTEGER) AS rank_asc,
           {previous} AS bef_1m_user_cnt
    FROM {prefix}counts c),
{prefix}rated AS (
    SELECT *, {half_up('user_cnt - bef_1m_user_cnt', 'bef_1m_user_cnt', 4)} AS rate_of_change FROM {prefix}lagged),
{prefix}refs AS (
    SELECT l.*, r.rate_of_change AS ref_rate_of_change
    FROM {prefix}rated l LEFT JOIN {prefix}rated r ON r.region = l.region AND r.ym = '{REF_MONTH}'),
{prefix}banded AS (
    SELECT *, CASE WHEN ref_rate_of_change IS NULL THEN 'new' WHEN ref_rate_of_change < 0 THEN 'decrease'
                   WHEN ref_rate_of_change <= 0.1 THEN 'increase_0_10' WHEN ref_rate_of_change <= 0.2 THEN 'increase_10_20'
                   WHEN ref_rate_of_change <= 0.3 THEN 'increase_20_30' ELSE 'increase_30_more' END AS user_group
    FROM {prefix}refs)"""


def _growth_sql(inputs_sql: str, counts: str, column: str, calendar: bool = False) -> str:
    return f"""
WITH {inputs_sql}, {USER_REGION}, {_growth_ctes(counts, calendar=calendar)}
SELECT * EXCLUDE (ym), ym AS {column} FROM banded"""


def _mau_growth(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    counts = activity.mau_by_region(inputs.order_logins(spark, sf_dir), inputs.user_region(spark, sf_dir))
    return growth.region_growth(counts, REF_MONTH, **options)


def _nru_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = activity.nru_by_region(inputs.order_users(spark, sf_dir), inputs.user_region(spark, sf_dir))
    return growth.region_growth(counts, REF_MONTH, month="create_year_month")


@query(_growth_sql(ORDER_LOGINS, MAU_REGION_SQL, "login_year_month"))
def mau_by_region_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mau_growth(spark, sf_dir)


@query(_growth_sql(ORDER_LOGINS, MAU_REGION_SQL, "login_year_month", calendar=True))
def mau_by_region_growth_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mau_growth(spark, sf_dir, calendar=True)


@query(_growth_sql(ORDER_USERS, NRU_REGION_SQL, "create_year_month"))
def nru_by_region_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nru_growth(spark, sf_dir)


@query(f"""
WITH {ORDER_LOGINS}, {ORDER_USERS}, {USER_REGION},
{_growth_ctes(MAU_REGION_SQL, 'au_')}, {_growth_ctes(NRU_REGION_SQL, 'nru_')},
both_tables AS (SELECT *, 'AU' AS category FROM au_banded UNION ALL SELECT *, 'NRU' FROM nru_banded)
SELECT * EXCLUDE (ym, user_group), ym AS year_month,
       CASE user_group WHEN 'new' THEN '신규지역' WHEN 'decrease' THEN '감소지역'
            WHEN 'increase_0_10' THEN '10%이하_증가지역' WHEN 'increase_10_20' THEN '10%초과_20%이하_증가지역'
            WHEN 'increase_20_30' THEN '20%초과_30%이하_증가지역' ELSE '30%_초과_증가지역' END AS user_group
FROM both_tables""")
def region_au_nru_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth.region_au_nru_long(_mau_growth(spark, sf_dir), _nru_growth(spark, sf_dir))


# --- cohort return rates ----------------------------------------------------


def _cohort_ctes(index: str) -> str:
    return f"""counts AS ({AU_MONTH_SQL}),
firsts AS (SELECT create_year_month, min(login_year_month) AS first_month FROM counts GROUP BY 1),
rates AS (
    SELECT c.login_year_month, c.create_year_month, substr(c.create_year_month, 1, 4) AS create_year,
           'M' || CAST({index} AS VARCHAR) AS time_order, c.user_cnt, f.user_cnt AS first_user_cnt,
           {half_up('c.user_cnt', 'f.user_cnt', 4)} AS return_rate
    FROM counts c JOIN firsts USING (create_year_month)
    JOIN counts f ON f.create_year_month = c.create_year_month AND f.login_year_month = first_month)"""


OBSERVED_INDEX = "(row_number() OVER (PARTITION BY c.create_year_month ORDER BY c.login_year_month) - 1)"
ELAPSED_INDEX = (
    "date_diff('month', CAST(c.create_year_month || '-01' AS DATE), CAST(c.login_year_month || '-01' AS DATE))"
)


@query(f"WITH {_cohort_ctes(OBSERVED_INDEX)} SELECT * FROM rates")
def cohort_return_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.cohort_return_rate(_au(spark, sf_dir))


@query(f"WITH {_cohort_ctes(ELAPSED_INDEX)} SELECT * FROM rates")
def cohort_return_rate_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.cohort_return_rate(_au(spark, sf_dir), true_elapsed=True)


LONG_IDS = "create_year_month, login_year_month, create_year, time_order"


@query(f"""
WITH {_cohort_ctes(OBSERVED_INDEX)}
SELECT {LONG_IDS}, 'user_cnt' AS variable, CAST(user_cnt AS DOUBLE) AS value FROM rates WHERE create_year_month >= '1995-06'
UNION ALL SELECT {LONG_IDS}, 'return_rate', return_rate FROM rates WHERE create_year_month >= '1995-06'""")
def cohort_return_rate_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.cohort_return_rate_long(cohorts.cohort_return_rate(_au(spark, sf_dir)), from_month="1995-06")


@query(f"""
WITH {ORDER_LOGINS}, {ORDER_USERS}, {USER_REGION},
counts AS (
    SELECT coalesce(region, 'unknown') AS region, {month('login_date')} AS login_year_month,
           {month('create_date')} AS create_year_month, count(DISTINCT user_id) AS user_cnt
    FROM logins JOIN users USING (user_id) LEFT JOIN user_region USING (user_id) GROUP BY 1, 2, 3),
firsts AS (SELECT region, create_year_month, min(login_year_month) AS m, arg_min(user_cnt, login_year_month) AS n
           FROM counts GROUP BY 1, 2)
SELECT c.region, login_year_month, c.create_year_month, substr(c.create_year_month, 1, 4) AS create_year,
       'M' || CAST((SELECT count(DISTINCT d.login_year_month) FROM counts d
                    WHERE d.create_year_month = c.create_year_month AND d.login_year_month < c.login_year_month) AS VARCHAR)
           AS time_order,
       'M' || CAST((SELECT count(*) FROM counts d
                    WHERE d.create_year_month = c.create_year_month AND d.login_year_month < c.login_year_month) AS VARCHAR)
           AS time_order_ranked,
       user_cnt, n AS first_user_cnt, {half_up('user_cnt', 'n', 4)} AS return_rate
FROM counts c JOIN firsts f ON f.region = c.region AND f.create_year_month = c.create_year_month""")
def cohort_return_rate_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.cohort_return_rate_by_region(
        inputs.order_logins(spark, sf_dir), inputs.order_users(spark, sf_dir), inputs.user_region(spark, sf_dir)
    )


# --- retention --------------------------------------------------------------

FIRST_LOGINS = "users AS (SELECT user_id, min(login_date) AS create_date FROM logins GROUP BY 1)"


def _retention_ctes(logins: str, users: str) -> str:
    """CTE ``typed``: a row per user, day and user type with a 0/1 per offset."""
    came_back = ", ".join(
        f"CASE WHEN l.login_date + {n} <= last_day THEN 1 ELSE 0 END AS e{n}, "
        f"CASE WHEN r{n}.user_id IS NULL THEN 0 ELSE 1 END AS r{n}"
        for n in retention.OFFSETS
    )
    later = " ".join(
        f"LEFT JOIN days r{n} ON r{n}.user_id = l.user_id AND r{n}.login_date = l.login_date + {n}"
        for n in retention.OFFSETS
    )
    return f"""{logins}, {users},
days AS (SELECT DISTINCT user_id, login_date FROM logins),
ends AS (SELECT max(login_date) AS last_day FROM days),
flags AS (
    SELECT l.user_id, l.login_date, CASE WHEN l.login_date = u.create_date THEN 'new' ELSE 'returning' END AS kind, {came_back}
    FROM days l JOIN ends ON TRUE LEFT JOIN users u ON u.user_id = l.user_id {later}),
typed AS (SELECT *, 'all' AS user_type FROM flags UNION ALL SELECT *, kind FROM flags)"""


ELIGIBLE = ", ".join(f"CAST(sum(e{n}) AS BIGINT) AS d{n}_eligible" for n in retention.OFFSETS)
RATES = ", ".join(f"coalesce({half_up(f'sum(r{n})', f'sum(e{n})', 3)}, 0) AS d{n}_ret" for n in retention.OFFSETS)
DAILY_RETENTION = f"SELECT login_date, user_type, count(*) AS dau, {ELIGIBLE}, {RATES} FROM typed GROUP BY 1, 2"
MONTHLY_RETENTION = f"""SELECT {month('login_date')} AS login_year_month, user_type, count(DISTINCT user_id) AS mau,
    count(*) AS mau_not_unique, {ELIGIBLE}, {RATES} FROM typed GROUP BY 1, 2"""


def _event_activity(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return inputs.event_logins(spark, sf_dir), inputs.event_users(spark, sf_dir)


def _order_activity(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return inputs.order_logins(spark, sf_dir), inputs.order_users(spark, sf_dir)


@query(f"WITH {_retention_ctes(EVENT_LOGINS, EVENT_USERS)} {DAILY_RETENTION}")
def nday_retention_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.nday_retention_daily(*_event_activity(spark, sf_dir))


@query(f"WITH {_retention_ctes(EVENT_LOGINS, EVENT_USERS)} {MONTHLY_RETENTION}")
def nday_retention_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.nday_retention_monthly(*_event_activity(spark, sf_dir))


@query(f"WITH {_retention_ctes(ORDER_LOGINS, ORDER_USERS)} {MONTHLY_RETENTION}")
def nday_retention_monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.nday_retention_monthly(*_order_activity(spark, sf_dir))


@query(f"WITH {_retention_ctes(EVENT_LOGINS, FIRST_LOGINS)} {MONTHLY_RETENTION}")
def nday_retention_from_first_login(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.nday_retention_monthly(inputs.event_logins(spark, sf_dir))


def _long_retention_sql(table: str, key: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT {key}, user_type, 'd{n}_ret' AS variable, d{n}_ret AS value, d{n}_ret >= 0.7 AS reaches_threshold FROM {table}"
        for n in retention.OFFSETS
    )


@query(f"""
WITH {_retention_ctes(EVENT_LOGINS, EVENT_USERS)}, rates AS ({DAILY_RETENTION})
{_long_retention_sql('rates', 'login_date')}""")
def retention_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.retention_long(retention.nday_retention_daily(*_event_activity(spark, sf_dir)))


@query(f"""
WITH {_retention_ctes(EVENT_LOGINS, EVENT_USERS)},
rates AS (SELECT * FROM ({MONTHLY_RETENTION}) WHERE user_type = 'new')
{_long_retention_sql('rates', 'login_year_month')}""")
def retention_long_new_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = retention.nday_retention_monthly(*_event_activity(spark, sf_dir))
    return retention.retention_long(monthly, user_type="new")


# --- annotated series and profiles ------------------------------------------


def _periods_sql(periods: tuple, kind: str = "DATE") -> str:
    end = lambda x: "NULL" if x is None else f"{kind} '{x}'"
    rows = ", ".join(f"({end(first)}, {end(last)}, '{note}')" for first, last, note in periods)
    return f"periods(first_end, last_end, note) AS (VALUES {rows})"


def _in_period(at: str, end: str = "{}") -> str:
    """Does a period hold ``at``?  ``end`` turns a period's end into what is compared; a null end is open."""
    first, last = end.format("first_end"), end.format("last_end")
    return f"({at} >= {first} OR first_end IS NULL) AND ({at} <= {last} OR last_end IS NULL)"


@query(f"""
WITH {EVENT_LOGINS}, {_periods_sql(EVENT_PERIODS)},
days AS (SELECT login_date, count(DISTINCT user_id) AS dau FROM logins GROUP BY 1)
SELECT login_date, dau, note FROM days LEFT JOIN periods ON login_date BETWEEN first_end AND last_end""")
def period_annotated_dau(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = activity.dau(inputs.event_logins(spark, sf_dir))
    return annotate.annotate_periods(days, annotate.period_table(spark, EVENT_PERIODS), "login_date")


@query(f"""
WITH {ORDER_LOGINS}, {_periods_sql(ORDER_PERIODS)}, a AS ({MAU_SQL})
SELECT login_year_month, login_user_cnt, note
FROM a LEFT JOIN periods ON CAST(login_year_month || '-01' AS DATE) BETWEEN first_end AND last_end""")
def period_annotated_mau(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = activity.mau(inputs.order_logins(spark, sf_dir))
    periods = annotate.period_table(spark, ORDER_PERIODS)
    return annotate.annotate_periods(months, periods, month_from_key("login_year_month"))


@query(f"""
WITH {EVENT_LOGINS}, {_periods_sql(OPEN_PERIODS)},
days AS (SELECT login_date, count(DISTINCT user_id) AS dau FROM logins GROUP BY 1)
SELECT login_date, dau, note FROM days LEFT JOIN periods ON {_in_period('login_date')}""")
def dau_in_open_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = activity.dau(inputs.event_logins(spark, sf_dir))
    return annotate.annotate_periods(days, annotate.period_table(spark, OPEN_PERIODS), "login_date")


@query(f"""
WITH {ORDER_LOGINS}, {_periods_sql(MONTH_PERIODS, '')}, a AS ({MAU_SQL})
SELECT login_year_month, login_user_cnt, note FROM a LEFT JOIN periods ON {_in_period('login_year_month')}""")
def mau_in_month_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = activity.mau(inputs.order_logins(spark, sf_dir))
    periods = annotate.period_table(spark, MONTH_PERIODS, "month")
    return annotate.annotate_periods(months, periods, "login_year_month", "month")


INDEX = "CAST(replace({}, 'M', '') AS INTEGER)"


@query(f"""
WITH {_cohort_ctes(ELAPSED_INDEX)}, {_periods_sql(INDEX_PERIODS, '')}
SELECT create_year_month, time_order, return_rate, note
FROM rates LEFT JOIN periods ON {_in_period(INDEX.format('time_order'), INDEX)}""")
def cohort_return_in_index_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months since signup that the cohort chart marks."""
    rates = cohorts.cohort_return_rate(_au(spark, sf_dir), true_elapsed=True)
    periods = annotate.period_table(spark, INDEX_PERIODS, "index")
    noted = annotate.annotate_periods(rates, periods, "time_order", "index")
    return noted.select("create_year_month", "time_order", "return_rate", "note")


@query(f"""
WITH {INSTALLS}, {EVENT_LOGINS},
days AS (SELECT DISTINCT login_date FROM logins),
spans AS (SELECT campaign, CAST(min(install_time) AS DATE) AS a, CAST(max(install_time) AS DATE) AS b
          FROM installs WHERE campaign IS NOT NULL GROUP BY 1)
SELECT login_date, count(campaign) AS running FROM days LEFT JOIN spans ON login_date BETWEEN a AND b GROUP BY 1""")
def campaigns_running_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaigns between their first and last install, for each day: periods that the data give, and that overlap."""
    installs = inputs.non_organic_installs(spark, sf_dir).filter(F.col("campaign").isNotNull())
    spans = installs.groupBy("campaign").agg(F.min("install_time").alias("a"), F.max("install_time").alias("b"))
    days = inputs.event_logins(spark, sf_dir).select("login_date").distinct()
    at, first, last = map(intervals.day_position, ("login_date", "a", "b"))
    return intervals.interval_join(days, spans, at, first, last).groupBy("login_date").agg(F.count("campaign").alias("running"))


EVENT_COLUMNS = {
    "event_id": "bigint",
    "ts": "timestamp_ntz",
    "user_id": "bigint",
    "event_type": "string",
    "value": "double",
    "props": "string",
}


@query(
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null_cnt, count(*) AS row_cnt FROM events"
        for c, t in EVENT_COLUMNS.items()
    )
)
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(inputs.read(spark, sf_dir, "events"))


@query("SELECT event_type, count(*) AS cnt FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(inputs.read(spark, sf_dir, "events").select(F.col("event_type")), "event_type")
