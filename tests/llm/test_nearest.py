import random
import time
from bisect import bisect_left
from datetime import datetime, timedelta

import pytest

from newsloom.llm import nearest

T0 = datetime(2024, 7, 1)


def test_trie_against_bisection():
    rng = random.Random(1)
    for n in (1, 2, 3, 50, 400):
        keys = sorted({rng.randrange(1 << 12) for _ in range(n)})
        tries = [nearest.XFastTrie(keys, 12, most) for most in (1, 7, 8192)]  # also with a leaf for only some of the keys
        for t in range(0, 1 << 12, 7):
            k = bisect_left(keys, t)
            want = (t, t) if k < len(keys) and keys[k] == t else (keys[k - 1] if k else None, keys[k] if k < len(keys) else None)
            assert {trie.around(t) for trie in tries} == {want}


def test_a_million_keys_in_one_block():
    """Memory stays at some thousand leaves, whatever the number of keys."""
    rng = random.Random(5)
    keys = sorted({rng.randrange(1 << 33) for _ in range(1_000_000)})
    began = time.process_time()
    trie = nearest.XFastTrie(keys, 35)
    assert sum(len(level) for level in trie.levels) < 36 * nearest.NODES
    for _ in range(20_000):
        t = rng.randrange(1 << 33)
        k = bisect_left(keys, t)
        if 0 < k < len(keys) and keys[k] != t:
            assert trie.around(t) == (keys[k - 1], keys[k])
    assert time.process_time() - began < 30


def brute(articles, bars, tolerance=900):
    first = {}
    for a in sorted(articles, key=lambda a: a["ingested_at"]):
        first.setdefault(a["dedupe_key"], a)
    out = {}
    for k, a in first.items():
        s = (a["symbol"] or "").strip().upper()
        if not s or a["published_at"] in (None, datetime(1970, 1, 1)) or k is None:
            continue
        near = [(abs(b["bar_ts"] - a["published_at"]), b["bar_ts"]) for b in bars if b["symbol"] and b["symbol"].strip().upper() == s and b["bar_interval"] != "1d" and abs(b["bar_ts"] - a["published_at"]) <= timedelta(seconds=tolerance)]
        if near:
            out[k] = (min(near)[1] - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    return out


def run(a, b):
    got = [tuple(r) for r in nearest.articles_to_bars(a, b).collect()]
    assert len(got) == len(dict(got))
    return dict(got)


@pytest.mark.parametrize("bits", [27, 33, 37])
def test_against_brute_force(make_articles, make_bars, monkeypatch, bits):
    """Blocks of 2^30 us and more; the smallest is raised to hold the tolerance."""
    monkeypatch.setattr(nearest, "BITS", max(bits, 30))
    monkeypatch.setattr(nearest, "HOT", 5 if bits == 33 else 200_000)
    rng = random.Random(bits)
    at = lambda: T0 + timedelta(microseconds=rng.randrange(0, 3 * 86_400_000_000))
    articles = [{"dedupe_key": f"k{n}", "symbol": rng.choice(["S", " s ", "T", "", None, "U"]), "published_at": rng.choice([at(), at(), at(), None, datetime(1970, 1, 1)]), "ingested_at": T0} for n in range(400)]
    articles += [dict(articles[0], symbol="T", ingested_at=T0 + timedelta(1)), {"dedupe_key": None, "symbol": "S", "published_at": at(), "ingested_at": T0}]
    bars = [{"source_api": "a", "symbol": rng.choice(["S", "t", "S"]), "bar_interval": rng.choice(["1m", "1h", "1d"]), "bar_ts": at(), "ingested_at": T0} for _ in range(700)]
    bars += [dict(b) for b in bars[:50]] + [dict(bars[0], symbol=None)]
    want = brute(articles, bars)
    assert run(make_articles(articles), make_bars(bars)) == want and want


def test_ties_limits_and_empty(make_articles, make_bars):
    a = [{"dedupe_key": k, "symbol": "S", "published_at": T0 + timedelta(seconds=s), "ingested_at": T0} for k, s in (("tie", 100), ("edge", 1100), ("far", 1101), ("same", 200))]
    b = [{"source_api": "a", "symbol": "S", "bar_interval": "1m", "bar_ts": T0 + timedelta(seconds=s), "ingested_at": T0} for s in (0, 200)]
    base = (T0 - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    assert run(make_articles(a), make_bars(b)) == {"tie": base, "edge": base + 200_000_000, "same": base + 200_000_000}
    assert run(make_articles([]), make_bars(b)) == {} and run(make_articles(a), make_bars([])) == {}
    with pytest.raises(ValueError):
        nearest.pair_nearest(make_articles([]), make_bars([]), 1 << 60)
