import math
import random
import statistics
from datetime import datetime, timedelta

from newsloom.operators import spikes

T0 = datetime(2024, 7, 1)


def bars_of(values, source="a", symbol="S", interval="1m", field="close", step=1, start=0):
    other = "volume" if field == "close" else "close"
    return [{"source_api": source, "symbol": symbol, "bar_interval": interval, "bar_ts": T0 + timedelta(minutes=step * (start + k)), field: v, other: None, "ingested_at": datetime(2025, 1, 1)} for k, v in enumerate(values)]


def brute(rows):
    out, series, moves = set(), {}, {}
    for r in rows:
        for f in ("close", "volume"):
            if r[f] is not None and r[f] == r[f] and r["symbol"] is not None:
                series.setdefault((r["source_api"], r["symbol"], r["bar_interval"], f), []).append((r["bar_ts"], r[f]))
    for s in series.values():
        s.sort()
    logs = {k: [(t, math.log(x)) for t, x in s if 0 < x < math.inf] for k, s in series.items()}
    for (a, _, i, f), s in logs.items():
        moves.setdefault((a, i, f), []).extend(abs(y - x) for (_, x), (_, y) in zip(s, s[1:]))
    for key, s in series.items():
        a, sym, i, f = key
        for t, x in s:
            if x < 0 or (f == "close" and x == 0):
                out.add((a, sym, i, t, f))
        k = 0
        while k < len(s):
            j = k
            while j < len(s) and s[j][1] == s[k][1]:
                j += 1
            if j - k >= 6:
                out |= {(a, sym, i, t, f) for t, _ in s[k:j]}
            k = j
        g = logs[key]
        if not moves[a, i, f]:
            continue
        far = 8 * statistics.median(moves[a, i, f])
        for n in (1, 2, 3):
            for k in range(1, len(g) - n):
                b, e, m = g[k - 1][1], g[k + n][1], [x for _, x in g[k : k + n]]
                if abs(b - e) < far and (min(m) - max(b, e) > far or min(b, e) - max(m) > far):
                    out |= {(a, sym, i, t, f) for t, _ in g[k : k + n]}
    return out


def found(df):
    return {(r.source_api, r.symbol, r.bar_interval, datetime(1970, 1, 1) + timedelta(microseconds=r.bar_us), r.field) for r in spikes.suspicious(df).collect()}


def walk(rng, n):
    x, out = 100.0, []
    for _ in range(n):
        x *= math.exp(rng.gauss(0, 0.002))
        out.append(round(x, 4))
    return out


def test_against_brute_force_over_block_borders(make_bars, monkeypatch):
    monkeypatch.setattr(spikes, "BLOCK_SLOTS", 16)
    rng = random.Random(11)
    rows = []
    for symbol in "SUV":
        v = walk(rng, 150)
        for k in range(3, 140, 9):
            n = rng.choice([1, 2, 3, 4])
            for j in range(n):
                v[k + j] *= rng.choice([1.3, 1.4])
        for k in (10, 61, 90):
            v[k : k + rng.choice([5, 6, 9])] = [v[k]] * rng.choice([5, 6, 9])
        for k in (31, 33, 47, 48, 49, 63, 64, 65):
            v[k] = rng.choice([0.0, -1.0, None, float("nan"), v[k]])
        rows += bars_of(v[:150], symbol=symbol)
        rows += bars_of([abs(x or 1) * 1000 for x in walk(rng, 80)], symbol=symbol, field="volume", step=3)
    assert found(make_bars(rows)) == brute(rows)


def test_cases_one_by_one(make_bars):
    v = [100, 101, 100, 101, 100, 101, 100, 101, 200, 101, 100, 101, 100, 99, 0, -5, 100, 101, 7, 7, 7, 7, 7, 7]
    got = {(r.bar_us // 60_000_000 - 28_662_960 - (0), r.impossible, r.stuck, r.spike) for r in spikes.suspicious(make_bars(bars_of([float(x) for x in v]))).collect()}
    base = min(k for k, *_ in got) - 8
    assert {(k - base, *rest) for k, *rest in got} == {(8, False, False, True), (14, True, False, False), (15, True, False, False), *((k, False, True, False) for k in range(18, 24))}


def test_second_deliveries_nulls_and_empty(make_bars):
    rows = bars_of([1.0] * 5) + [dict(r, close=50.0, ingested_at=datetime(2025, 2, 1)) for r in bars_of([1.0] * 5)]
    rows += [dict(bars_of([-1.0])[0], symbol=None), dict(bars_of([None])[0], symbol="N")]
    assert found(make_bars(rows)) == set()
    assert found(make_bars([])) == set()


def test_median_is_exact(spark):
    rng = random.Random(3)
    for n in (1, 2, 5, 400, 401):
        v = [rng.choice([0.0, rng.random() * 10 ** rng.randint(-6, 3)]) for _ in range(n)]
        df = spark.createDataFrame([("g", x) for x in v], "g string, v double")
        got = spikes.median_move(df, ["g"], "v").collect()[0].move
        assert got == statistics.median(v)


def test_median_of_values_that_agree_in_thirty_bits(spark):
    v = [1.0 + k * 2.0**-52 for k in range(41)] + [1.0 + 7 * 2.0**-52] * 3
    df = spark.createDataFrame([(g, x) for g in "gh" for x in v], "g string, v double")
    assert {r.move for r in spikes.median_move(df, ["g"], "v").collect()} == {statistics.median(v)}


def test_details_at_every_width(make_bars):
    """A spike of each length stands out of its neighbourhood's prediction by more than eight scales."""
    rng = random.Random(4)
    v = walk(rng, 60)
    for k, n in ((10, 1), (25, 2), (40, 3)):
        for j in range(n):
            v[k + j] *= 1.5
    details = spikes.described(spikes.bars_in_blocks(make_bars(bars_of(v)))).where("candidate")
    sizes = details.select("t", *(spikes._detail(k).alias(f"d{k}") for k in (1, 2, 3)), *(spikes._beyond(k).alias(f"b{k}") for k in (1, 2, 3))).collect()
    for n in (1, 2, 3):
        assert any((r[f"b{n}"] or 0) > 0.3 and r[f"d{n}"] >= r[f"b{n}"] for r in sizes)


def test_one_hot_key(make_bars):
    rows = bars_of([1.0, 2.0, 1.0, 2.0, 1.0]) + [dict(bars_of([float(k)])[0], ingested_at=datetime(2025, 3, 1)) for k in range(2000)]
    assert found(make_bars(rows)) == set()

