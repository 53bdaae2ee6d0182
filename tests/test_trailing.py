import random
from datetime import datetime, timedelta

from newsloom.operators.trailing import daily_bar_trailing, trailing_cases

DAY = datetime(2024, 7, 1, 4)


def bar(day, close, volume, at=1, symbol="S", source="a", interval="1d"):
    return {"source_api": source, "symbol": symbol, "bar_interval": interval, "bar_ts": DAY + timedelta(day), "close": close, "volume": volume, "ingested_at": datetime(2024, 12, at)}


def brute(rows):
    """Cases by plain loops over days."""
    first = {}
    for r in sorted(rows, key=lambda r: r["ingested_at"]):
        if r["bar_interval"] == "1d":
            first.setdefault((r["source_api"], r["symbol"], r["bar_ts"]), r)
    series = {}
    for (source, symbol, ts), r in first.items():
        series.setdefault((source, symbol), {}).setdefault(ts.date(), []).append(r)
    out = set()
    for key, days in series.items():
        d, last = min(days), max(days)
        start = d
        while d <= last:
            if (d - start).days >= 29:
                span = lambda k: [r for j in range(k) for r in days.get(d - timedelta(j), [])]  # noqa: B023, E731
                v7, v30 = (sum(r["volume"] or 0 for r in span(k)) for k in (7, 30))
                c7, c30 = ([r["close"] for r in span(k) if r["close"] is not None] for k in (7, 30))
                if v7 > v30 / 2:
                    out.add((*key, d.isoformat(), "volume"))
                if c7 and abs(sum(c7) / len(c7) - sum(c30) / len(c30)) > 0.1 * abs(sum(c30) / len(c30)):
                    out.add((*key, d.isoformat(), "close"))
            d += timedelta(1)
    return out


def cases(df):
    return {tuple(r) for r in trailing_cases(daily_bar_trailing(df)).collect()}


def test_against_brute_force(make_bars):
    rng = random.Random(4)
    rows = []
    for symbol in ("S", "T"):
        for day in range(80):
            if rng.random() < 0.6 and not 30 < day < 45:
                rows.append(bar(day, rng.choice([None, 10.0, 11.25, 17.5, -3.0]), rng.choice([None, 0.0, 5.0, 900.0]), symbol=symbol))
                if rng.random() < 0.2:
                    rows.append(bar(day, 1e6, 1e9, at=2, symbol=symbol))
    rows += [bar(0, 1.0, 1.0, interval="1h"), bar(0, 1.0, 1.0, symbol=None)]
    want = brute([r for r in rows if r["symbol"]])
    assert cases(make_bars(rows)) == want
    assert want


def test_sums_of_gaps_ties_and_odd_values(make_bars):
    rows = [bar(0, 1.0, 2.0), bar(0, 1.0, 2.0), bar(3, float("nan"), 5.0), bar(9, None, float("inf"))]
    got = {r.nth_day: r for r in daily_bar_trailing(make_bars(rows)).collect()}
    assert sorted(got) == list(range(1, 11))
    assert float(got[1].volume_sum_7) == 2 and float(got[4].volume_sum_7) == 7 and got[4].close_n_7 == 1
    assert float(got[8].volume_sum_7) == 5 and float(got[10].volume_sum_30) == 7


def test_values_count_as_they_stand(make_bars):
    """Very large and very small values, beside each other and alone."""
    rng = random.Random(9)
    tiny = [bar(day, rng.choice([1e-9, 3e-9, 2e-7]), rng.choice([1e-9, 5e-8]), symbol="tiny") for day in range(60)]
    finer = [bar(day, rng.choice([1e-15, 3e-15]), rng.choice([1.0, 1e-14]), symbol="finer") for day in range(60)]
    huge = [bar(day, rng.choice([1e25, 3e25]), rng.choice([1e22, 7e24]), symbol="huge") for day in range(60)]
    after = [bar(day, 1e25 if day < 5 else rng.choice([1.0, 1.5]), 1e30 if day == 3 else rng.choice([1.0, 40.0]), symbol="after") for day in range(90)]
    rows = tiny + finer + huge + after
    got, want = cases(make_bars(rows)), brute(rows)
    assert got == want and {s for _, s, _, _ in want} == {"tiny", "finer", "huge", "after"}
    last = {r.symbol: r for r in daily_bar_trailing(make_bars(rows)).where("nth_day = 60").collect()}
    assert last["huge"].close_units_7 is None and last["tiny"].close_units_7 is not None
    assert abs(last["finer"].close_sum_7 - sum(r["close"] for r in finer[53:60])) < 1e-20


def test_empty(make_bars):
    assert cases(make_bars([])) == set()
