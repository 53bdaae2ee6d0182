from datetime import date, datetime

from newsloom.functions import calendar


def stamps(spark, *ts):
    return spark.createDataFrame([(t,) for t in ts], "ts timestamp_ntz")


def column(df, name="nyse_session"):
    return [r[name] for r in df.collect()]


def test_known_session_counts():
    per = {}
    for d, *_ in calendar.session_days():
        per[d.year] = per.get(d.year, 0) + 1
    assert {y: per[y] for y in (2001, 2012, 2018, 2020, 2021, 2022, 2023, 2024, 2025)} == {2001: 248, 2012: 250, 2018: 251, 2020: 253, 2021: 252, 2022: 251, 2023: 250, 2024: 252, 2025: 250}


def test_labels(spark):
    df = stamps(spark, datetime(2024, 1, 12, 23), datetime(2024, 1, 13, 12), datetime(2024, 1, 15, 15), datetime(2024, 1, 16, 3), datetime(1970, 1, 1), None)
    assert column(calendar.with_session_label(df, "ts")) == [date(2024, 1, 12), date(2024, 1, 16), date(2024, 1, 16), date(2024, 1, 16), None, None]


def test_window_over_a_holiday(spark):
    r = calendar.session_bounds(spark).where("nyse_session = date '2024-01-16'").first()
    assert (r.lower, r.upper) == (datetime(2024, 1, 12, 21), datetime(2024, 1, 16, 14, 30))


def test_open_cutoff(spark):
    df = stamps(spark, datetime(2024, 7, 3, 13, 29), datetime(2024, 7, 3, 13, 30), datetime(2024, 7, 3, 16, 59), datetime(2024, 7, 3, 17), datetime(2024, 7, 4, 12), datetime(2024, 7, 5, 13, 29, 59), None)
    assert column(calendar.with_target_session(df, "ts")) == [date(2024, 7, 3), None, None, date(2024, 7, 5), date(2024, 7, 5), date(2024, 7, 5), None]


def test_equi_join_equals_the_window_definition(spark):
    import random

    rng = random.Random(1)
    ts = [datetime.fromtimestamp(rng.randrange(1_690_000_000, 1_740_000_000)) for _ in range(3000)]
    got = dict(calendar.with_target_session(stamps(spark, *ts), "ts").collect())
    days = calendar.session_days(2023, 2025)
    import bisect

    opens = [o for _, o, _ in days]
    for t in ts:
        k = bisect.bisect_right(opens, t)
        want = days[k][0] if k == 0 or t >= days[k - 1][2] else None
        assert got[t] == want


def test_clock(spark):
    df = stamps(spark, datetime(2024, 7, 3, 15), datetime(2024, 7, 3, 18), datetime(2024, 7, 6, 12))
    got = [(r.is_open, r.next_open, r.next_close) for r in calendar.with_market_clock(df, "ts").collect()]
    assert got == [
        (True, datetime(2024, 7, 5, 13, 30), datetime(2024, 7, 3, 17)),
        (False, datetime(2024, 7, 5, 13, 30), datetime(2024, 7, 5, 20)),
        (False, datetime(2024, 7, 8, 13, 30), datetime(2024, 7, 8, 20)),
    ]
