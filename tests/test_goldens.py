"""Metric tables replayed from short excerpts of published results."""

import datetime as dt

from tidemark.operators.activity import au_by_signup, mau, mau_nru_series
from tidemark.operators.cohorts import cohort_return_rate, cohort_return_rate_long, rate_regional_cohorts
from tidemark.operators.growth import region_growth
from tidemark.operators.retention import retention_long
from tidemark.sources.schemas import SCHEMAS

COUNTS = "login_year_month string, create_year_month string, user_cnt long"
MONTHS = ["2022-05", "2022-06", "2022-07", "2022-08", "2022-09", "2022-10", "2022-11"]

# Published numbers that a replay must give.
# Signup month -> active users per month, and their rate against the first month.
COHORTS = {
    "2021-07": ([163, 150, 155, 153, 140, 137, 142], [1.0, 0.9202, 0.9509, 0.9387, 0.8589, 0.8405, 0.8712]),
    "2021-08": ([317, 345, 347, 327, 285, 261, 269], [1.0, 1.0883, 1.0946, 1.0315, 0.8991, 0.8233, 0.8486]),
    "2021-09": ([236, 245, 237, 216, 193, 187, 190], [1.0, 1.0381, 1.0042, 0.9153, 0.8178, 0.7924, 0.8051]),
    "2021-10": ([298, 312, 299, 283, 247, 221, 228], [1.0, 1.0470, 1.0034, 0.9497, 0.8289, 0.7416, 0.7651]),
}


def test_cohort_return_rate(spark):
    counts = [(m, c, n) for c, (ns, _) in COHORTS.items() for m, n in zip(MONTHS, ns)]
    rates = cohort_return_rate(spark.createDataFrame(counts, COUNTS)).collect()
    got = {(r.create_year_month, r.login_year_month): (r.time_order, r.first_user_cnt, r.return_rate) for r in rates}
    for cohort, (ns, expected) in COHORTS.items():
        for i, m in enumerate(MONTHS):
            assert got[cohort, m] == (f"M{i}", ns[0], expected[i])
    assert {r.create_year for r in rates} == {"2021"}


def test_true_elapsed_index_counts_from_signup(spark):
    counts = [(m, "2021-07", n) for m, n in zip(MONTHS, COHORTS["2021-07"][0])]
    rates = cohort_return_rate(spark.createDataFrame(counts, COUNTS), true_elapsed=True)
    assert {r.time_order for r in rates.collect()} == {f"M{i}" for i in range(10, 17)}


# Published numbers that a replay must give.
# Month, users, previous users, rate; then the rate and band of 2022-11.
GROWTH = {
    "관악구-조원동": (
        [
            ("2022-05", 85, None, None),
            ("2022-06", 175, 85, 1.0588),
            ("2022-07", 242, 175, 0.3829),
            ("2022-08", 206, 242, -0.1488),
            ("2022-09", 181, 206, -0.1214),
            ("2022-10", 164, 181, -0.0939),
            ("2022-11", 287, 164, 0.75),
        ],
        0.75,
        "increase_30_more",
    ),
    "영등포구-문래동3가": ([("2022-10", 548, None, None), ("2022-11", 518, 548, -0.0547)], -0.0547, "decrease"),
    "구로구-신도림동": ([("2022-10", 351, None, None), ("2022-11", 352, 351, 0.0028)], 0.0028, "increase_0_10"),
    # two months without users: the previous count is the previous row's
    "영등포구-양평동3가": (
        [
            ("2022-05", 1, None, None),
            ("2022-08", 2, 1, 1.0),
            ("2022-09", 1, 2, -0.5),
            ("2022-10", 1, 1, 0.0),
            ("2022-11", 37, 1, 36.0),
        ],
        36.0,
        "increase_30_more",
    ),
    "영등포구-여의도동": ([("2022-11", 23, None, None)], None, "new"),
}


def _growth_counts(spark):
    counts = [(region, m, n) for region, (months, _, _) in GROWTH.items() for m, n, _, _ in months]
    return spark.createDataFrame(counts, "region string, login_year_month string, user_cnt long")


def test_region_growth(spark):
    got = region_growth(_growth_counts(spark), "2022-11").collect()
    assert len(got) == sum(len(months) for months, _, _ in GROWTH.values())
    for r in got:
        months, ref_rate, band = GROWTH[r.region]
        month, count, previous, rate = months[r.rank_asc - 1]
        assert (r.login_year_month, r.user_cnt, r.bef_1m_user_cnt, r.rate_of_change) == (month, count, previous, rate)
        assert (r.ref_rate_of_change, r.user_group) == (ref_rate, band)


def test_region_growth_by_calendar_month_has_no_previous_after_a_gap(spark):
    got = region_growth(_growth_counts(spark), "2022-11", calendar=True)
    sparse = {r.login_year_month: r.bef_1m_user_cnt for r in got.filter("region = '영등포구-양평동3가'").collect()}
    assert sparse == {"2022-05": None, "2022-08": None, "2022-09": 2, "2022-10": 1, "2022-11": 1}


def test_roll_up_to_signup_year_and_month(spark):
    """Users have one signup month, so the cohorts of a month add up to a year's and to all active users."""
    # Published numbers that a replay must give.
    active = {
        "2021-07": 163,
        "2021-08": 317,
        "2021-09": 236,
        "2021-10": 298,
        "2021-11": 269,
        "2021-12": 423,
        "2022-01": 443,
        "2022-02": 362,
        "2022-03": 363,
        "2022-04": 316,
        "2022-05": 504,
    }
    users, logins, first = [], [], 0
    for cohort, n in active.items():
        signup = dt.date(int(cohort[:4]), int(cohort[5:]), 1)
        users += [(u, signup) for u in range(first, first + n)]
        first += n
    logins = [(u, dt.date(2022, 5, 1 + u % 31)) for u, _ in users]
    users = spark.createDataFrame(users, "user_id long, create_date date")
    logins = spark.createDataFrame(logins, "user_id long, login_date date")
    assert {r.create_year_month: r.user_cnt for r in au_by_signup(logins, users).collect()} == active
    by_year = {r.create_year: r.user_cnt for r in au_by_signup(logins, users, "year").collect()}
    assert by_year == {"2021": 1706, "2022": 1988}
    assert mau(logins).first().login_user_cnt == 3694


# Published numbers that a replay must give.
NRU_GROWTH = [
    ("2022-05", 1, 2, None, None),
    ("2022-06", 2, 7, 2, 2.5),
    ("2022-08", 3, 1, 7, -0.8571),
    ("2022-09", 4, 1, 1, 0.0),
    ("2022-10", 5, 10, 1, 9.0),
    ("2022-11", 6, 644, 10, 63.4),
]


def test_region_growth_of_signups(spark):
    counts = [("영등포구-당산동5가", m, n) for m, _, n, _, _ in NRU_GROWTH]
    counts = spark.createDataFrame(counts, "region string, create_year_month string, user_cnt long")
    got = region_growth(counts, "2022-11", month="create_year_month").orderBy("rank_asc").collect()
    assert [
        (r.create_year_month, r.rank_asc, r.user_cnt, r.bef_1m_user_cnt, r.rate_of_change) for r in got
    ] == NRU_GROWTH
    assert {(r.ref_rate_of_change, r.user_group) for r in got} == {(63.4, "increase_30_more")}


def test_regional_cohort_index(spark):
    """The dense index counts months; the ranked one counts rows of all regions and leaves gaps."""
    # Published numbers that a replay must give.
    months = {
        "2022-05": {"a": 2, "b": 2, "c": 135, "d": 24},
        "2022-06": {"a": 2, "b": 2, "c": 123, "d": 23},
        "2022-07": {"e": 1, "a": 2, "b": 2, "c": 127, "d": 23},
        "2022-08": {"e": 1, "a": 2, "b": 2, "c": 123, "d": 23, "f": 1, "g": 1},
        "2022-09": {"a": 1, "b": 2, "c": 119, "d": 18},
    }
    counts = [(r, m, "2021-07", n) for m, regions in months.items() for r, n in regions.items()]
    got = rate_regional_cohorts(spark.createDataFrame(counts, "region string, " + COUNTS)).collect()
    index = {r.login_year_month: (r.time_order, r.time_order_ranked) for r in got}
    assert index == {
        "2022-05": ("M0", "M0"),
        "2022-06": ("M1", "M4"),
        "2022-07": ("M2", "M8"),
        "2022-08": ("M3", "M13"),
        "2022-09": ("M4", "M20"),
    }
    rates = {(r.region, r.login_year_month): r.return_rate for r in got}
    assert rates["c", "2022-06"] == 0.9111 and rates["d", "2022-06"] == 0.9583
    assert rates["c", "2022-09"] == 0.8815 and rates["d", "2022-09"] == 0.75 and rates["a", "2022-09"] == 0.5
    assert rates["e", "2022-07"] == 1.0  # its own first month, not the cohort's


def test_activity_series_from_exported_tables(spark):
    # Published numbers that a replay must give.
    mau_rows = list(zip(MONTHS, [3694, 4404, 4647, 4375, 3971, 4095, 6352]))
    nru_rows = [("2021-11", 415), ("2021-12", 566), ("2022-01", 595), ("2022-02", 491), ("2022-03", 461), ("2022-04", 379)]
    nru_rows += list(zip(MONTHS, [512, 1077, 1079, 704, 619, 811, 2907]))
    series = mau_nru_series(
        spark.createDataFrame(mau_rows, SCHEMAS["mau"]), spark.createDataFrame(nru_rows, SCHEMAS["nru"]), "2022-01"
    ).collect()
    assert len(series) == 11
    assert {r.year_month for r in series if r.is_latest} == {"2022-11"}
    assert {r.year_month: r.mau for r in series}["2022-04"] is None
    assert {r.year_month: (r.mau, r.nru) for r in series}["2022-05"] == (3694, 512)


def test_retention_chart_table_from_an_exported_table(spark):
    # Published numbers that a replay must give.
    exported = [
        ("2022-05", "신규유저", 497, 497, 0.344, 0.171, 0.175, 0.135),
        ("2022-05", "재방문유저", 3472, 36597, 0.637, 0.644, 0.621, 0.534),
        ("2022-11", "신규유저", 2890, 2890, 0.694, 0.530, 0.530, 0.000),
    ]
    table = spark.createDataFrame(exported, SCHEMAS["nday_retention_monthly"])
    long = retention_long(table, user_type="신규유저").collect()
    assert {(r.login_year_month, r.variable): r.value for r in long} == {
        ("2022-05", "d1_ret"): 0.344,
        ("2022-05", "d7_ret"): 0.171,
        ("2022-05", "d14_ret"): 0.175,
        ("2022-05", "d30_ret"): 0.135,
        ("2022-11", "d1_ret"): 0.694,
        ("2022-11", "d7_ret"): 0.530,
        ("2022-11", "d14_ret"): 0.530,
        ("2022-11", "d30_ret"): 0.0,
    }
    assert not any(r.reaches_threshold for r in long)


def test_cohort_chart_table_from_an_exported_table(spark):
    # Published numbers that a replay must give.
    exported = [
        ("2022-06", "2022-05", "2022", "M1", 258, 504, 0.5119),
        ("2022-05", "2022-05", "2022", "M0", 504, 504, 1.0),
        ("2022-05", "2021-07", "2021", "M0", 163, 163, 1.0),
    ]
    schema = SCHEMAS["cohort_return_rate"].replace("return_rate", "rate_of_change")
    long = cohort_return_rate_long(spark.createDataFrame(exported, schema), "2022-05", rate="rate_of_change").collect()
    assert [r.login_year_month for r in long] == ["2022-05", "2022-05", "2022-06", "2022-06"]
    assert {(r.time_order, r.variable): r.value for r in long} == {
        ("M0", "user_cnt"): 504.0,
        ("M0", "rate_of_change"): 1.0,
        ("M1", "user_cnt"): 258.0,
        ("M1", "rate_of_change"): 0.5119,
    }
