"""Schemas of the input and result tables.

They are always given to the reader: inference would turn a ``yyyy-MM`` key
into a timestamp.
"""

GROWTH = (
    "rank_asc int, user_cnt bigint, bef_1m_user_cnt bigint, rate_of_change double, "
    "ref_rate_of_change double, user_group string"
)

SCHEMAS = {
    # inputs
    "orders": "order_date timestamp_ntz, pickup_shop_name string, payment_amount decimal(18,2), user_id bigint",
    "login": "login_date date, user_id bigint",
    "users": "user_id bigint, create_date date, attribute_id string",
    "organic_install": "install_time timestamp_ntz, attribute_id string",
    "non_organic_install": "install_time timestamp_ntz, attribute_id string, campaign string",
    "daily_cost": "aggregate_date date, campaign string, cost decimal(18,2)",
    "user_region": "user_id bigint, region string",
    # x holds the latitude and y the longitude
    "pickup_shop": (
        "pickup_shop_name string, region_1depth_name string, region_2depth_name string, "
        "region_3depth_name string, h_code bigint, x double, y double"
    ),
    # metric tables
    "mau": "login_year_month string, login_user_cnt bigint",
    "nru": "create_year_month string, user_cnt bigint",
    "mau_by_region_growth": f"region string, login_year_month string, {GROWTH}",
    "nru_by_region_growth": f"region string, create_year_month string, {GROWTH}",
    "au_by_signup_year": "login_year_month string, create_year string, user_cnt bigint",
    "au_by_signup_month": "login_year_month string, create_year_month string, user_cnt bigint",
    "cohort_return_rate": (
        "login_year_month string, create_year_month string, create_year string, time_order string, "
        "user_cnt bigint, first_user_cnt bigint, return_rate double"
    ),
    "nday_retention_monthly": (
        "login_year_month string, user_type string, mau bigint, mau_not_unique bigint, "
        "d1_ret double, d7_ret double, d14_ret double, d30_ret double"
    ),
    "cohort_ltv": (
        "attribute_type string, create_year_month string, ltv_period int, user_cnt bigint, "
        "revenue decimal(38,2), ltv double"
    ),
}

# The columns of the star schema and event log that the queries use.
STAR_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": (
        "l_orderkey bigint, l_suppkey bigint, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
