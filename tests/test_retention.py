"""N-day retention against a direct count over sets of days."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from tidemark.functions.labels import USER_TYPE_LABELS
from tidemark.operators.retention import nday_retention_daily, nday_retention_monthly, retention_long

LOGIN = "user_id long, login_date date"
SIGNUP = "user_id long, create_date date"


def half_up(top, base):
    return 0.0 if base == 0 else ((2 * top * 1000 + base) // (2 * base)) / 1000


def brute_force(logins, signups, offsets, obs_end, period):
    """{(period, type): (distinct users, user-days, eligible per offset, rate per offset)}."""
    days = {(u, d) for u, d in logins if u is not None and d is not None and (obs_end is None or d <= obs_end)}
    last = obs_end or max(d for _, d in days)
    users, sums = defaultdict(set), defaultdict(lambda: [0] + [0] * 2 * len(offsets))
    for u, d in days:
        for kind in ("all", "new" if signups.get(u) == d else "returning"):
            users[period(d), kind].add(u)
            s = sums[period(d), kind]
            s[0] += 1
            for i, n in enumerate(offsets):
                if d + dt.timedelta(n) <= last:
                    s[1 + 2 * i] += 1
                    s[2 + 2 * i] += (u, d + dt.timedelta(n)) in days
    return {
        k: (len(users[k]), s[0], s[1::2], [half_up(s[2 + 2 * i], s[1 + 2 * i]) for i in range(len(offsets))])
        for k, s in sums.items()
    }


def activity(seed, first=dt.date(2023, 12, 20), length=150, users=12):
    rnd = random.Random(seed)
    logins, signups = [], {}
    for u in range(users):
        start = rnd.randrange(length)
        if u % 4:
            signups[u] = first + dt.timedelta(start)
        density = rnd.choice((0.05, 0.3, 0.9))
        for d in range(start, length):
            if rnd.random() < density:
                logins += [(u, first + dt.timedelta(d))] * rnd.choice((1, 1, 3))
    return logins + [(None, first), (3, None)], signups


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("offsets", [(1, 7, 14, 30), (31, 59, 90)])
def test_monthly_against_brute_force(spark, seed, offsets):
    logins, signups = activity(seed)
    got = nday_retention_monthly(
        spark.createDataFrame(logins, LOGIN), spark.createDataFrame(list(signups.items()), SIGNUP), offsets
    )
    expected = brute_force(logins, signups, offsets, None, lambda d: d.strftime("%Y-%m"))
    assert {
        (r.login_year_month, r.user_type): (
            r.mau,
            r.mau_not_unique,
            [r[f"d{n}_eligible"] for n in offsets],
            [r[f"d{n}_ret"] for n in offsets],
        )
        for r in got.collect()
    } == expected


def test_daily_against_brute_force_up_to_a_given_day(spark):
    logins, signups = activity(3)
    offsets, end = (1, 7, 30), dt.date(2024, 4, 10)
    got = nday_retention_daily(
        spark.createDataFrame(logins, LOGIN), spark.createDataFrame(list(signups.items()), SIGNUP), offsets, end
    )
    expected = brute_force(logins, signups, offsets, end, lambda d: d)
    assert {
        (r.login_date, r.user_type): (r.dau, [r[f"d{n}_eligible"] for n in offsets], [r[f"d{n}_ret"] for n in offsets])
        for r in got.collect()
    } == {k: (v[1], v[2], v[3]) for k, v in expected.items()}


def test_monthly_up_to_a_given_day(spark):
    logins, signups = activity(6)
    offsets, end = (1, 7, 30), dt.date(2024, 3, 17)
    got = nday_retention_monthly(
        spark.createDataFrame(logins, LOGIN), spark.createDataFrame(list(signups.items()), SIGNUP), offsets, end
    )
    expected = brute_force(logins, signups, offsets, end, lambda d: d.strftime("%Y-%m"))
    assert {
        (r.login_year_month, r.user_type): (
            r.mau,
            r.mau_not_unique,
            [r[f"d{n}_eligible"] for n in offsets],
            [r[f"d{n}_ret"] for n in offsets],
        )
        for r in got.collect()
    } == expected


def test_first_login_stands_for_the_signup(spark):
    logins, _ = activity(4)
    firsts = {}
    for u, d in logins:
        if u is not None and d is not None:
            firsts[u] = min(d, firsts.get(u, d))
    got = nday_retention_monthly(spark.createDataFrame(logins, LOGIN), offsets=(1,))
    expected = brute_force(logins, firsts, (1,), None, lambda d: d.strftime("%Y-%m"))
    assert {(r.login_year_month, r.user_type): (r.mau, r.mau_not_unique, r.d1_ret) for r in got.collect()} == {
        k: (v[0], v[1], v[3][0]) for k, v in expected.items()
    }


def test_offsets_must_be_later_days(spark):
    logins = spark.createDataFrame([(1, dt.date(2024, 1, 1))], LOGIN)
    for offsets in ((), (0, 1), (-1,)):
        with pytest.raises(ValueError, match="offsets"):
            nday_retention_daily(logins, offsets=offsets)


def test_only_the_exact_day_counts(spark):
    day = dt.date(2024, 2, 27)
    logins = [(1, day), (1, day + dt.timedelta(8)), (2, day), (2, day + dt.timedelta(7))]
    got = nday_retention_daily(spark.createDataFrame(logins, LOGIN), offsets=(7,)).collect()
    first = {r.user_type: (r.dau, r.d7_eligible, r.d7_ret) for r in got if r.login_date == day}
    assert first == {"all": (2, 2, 0.5), "new": (2, 2, 0.5)}


def test_month_without_a_trackable_day_is_zero_with_nothing_eligible(spark):
    logins = [(1, dt.date(2024, 1, 1)), (1, dt.date(2024, 1, 20))]
    row = nday_retention_monthly(spark.createDataFrame(logins, LOGIN), offsets=(30,)).filter("user_type = 'all'").first()
    assert (row.d30_eligible, row.d30_ret) == (0, 0.0)


def test_user_days_add_up_over_types_but_users_do_not(spark):
    logins, signups = activity(5)
    got = nday_retention_monthly(
        spark.createDataFrame(logins, LOGIN), spark.createDataFrame(list(signups.items()), SIGNUP)
    ).collect()
    months = defaultdict(dict)
    for r in got:
        months[r.login_year_month][r.user_type] = r
    for types in months.values():
        parts = [types[k] for k in ("new", "returning") if k in types]
        assert sum(p.mau_not_unique for p in parts) == types["all"].mau_not_unique
        assert sum(p.mau for p in parts) >= types["all"].mau
        if "new" in types:
            assert types["new"].mau == types["new"].mau_not_unique


def test_long_form_with_labels_and_threshold(spark):
    logins = [(1, dt.date(2024, 1, 1)), (1, dt.date(2024, 1, 2)), (2, dt.date(2024, 1, 1))]
    daily = nday_retention_daily(spark.createDataFrame(logins, LOGIN), offsets=(1,), user_types=USER_TYPE_LABELS)
    long = retention_long(daily, threshold=0.5, user_type="신규유저", offsets=(1,)).collect()
    assert [(r.login_date, r.user_type, r.variable, r.value, r.reaches_threshold) for r in long] == [
        (dt.date(2024, 1, 1), "신규유저", "d1_ret", 0.5, True)
    ]
