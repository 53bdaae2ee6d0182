from datetime import datetime

import pytest

from newsloom.llm.truncation import cut_rates, cut_values, judged, limits

S = "Shares of Vane rose 3.4% on Monday."
WHOLE = [
    S, f"{S} Was it so?", f"{S} It was!", f'{S} "It was," a spokesperson said.', f'He said "it was."', f"{S} (Desk note 12)", f"{S} (adds detail)", f"{S} Source: Vellum Street", f"{S} | Marl & Chalk",
    f"{S} - The Brisk Ticker", f"{S} Read more at https://feed.example/306", f"{S} Full table: https://x.example/t/9.csv", f"{S} Tickers: QUVEN, AB-A", f"{S} #retail #payout", f"{S} Reporting by the Vane delta bureau",
    f"{S} Filed under legacy pricing", f"{S} (adds detail) | Osmund Markets", f"{S} (c) Tallyboard Wire.", "Cut its outlook to 48.78 from 945.1.", "headline without an end", f"{S} …", f"{S} [+1200 chars]", f"{S}  \n",
]
CUT = [
    "Shares of Vane ro", "Shares of Vane rose on", "Shares of Vane rose…", "Shares of Vane rose...", "Shares of Vane ro… [+2491 chars]", "Shares of Vane r�", "Shares of Vane and &am", "Shares of Vane &#82", "Shares of Vane <br", "Shares of <a hr",
    "Shares rose to $", "Shares rose by 25%", "Shares of Vane,", f"{S} Unlike", f"{S} Vane Foods (QUVEN)", f"{S} <br", "…", f"{S} By contrast", "QUVE-",
]


def row(key, summary, **more):
    return {"dedupe_key": key, "source_api": "a", "headline": "headline without an end", "summary": summary, "ingested_at": datetime(2024, 7, 1)} | more


def test_endings(make_articles):
    rows = [row(f"w{k}", t) for k, t in enumerate(WHOLE)] + [row(f"c{k}", t) for k, t in enumerate(CUT)] + [row(f"n{k}", t) for k, t in enumerate([None, "", "  \t"])]
    got = {r.dedupe_key for r in cut_values(make_articles(rows)).collect()}
    names = {f"w{k}": t for k, t in enumerate(WHOLE)} | {f"c{k}": t for k, t in enumerate(CUT)}
    assert {names[k] for k in got} == set(CUT)


def limited():
    """Fifty values cut at 200 characters, ten of them at the point of a number and ten inside a closing line, among others."""
    fill = lambda t, end: t + "x" * (200 - len(t) - len(end)) + end
    rows = [row(f"l{k}", fill(f"{k:04} word ", " b")) for k in range(30)] + [row(f"o{k}", f"{k} " + "x" * (20 + 5 * k) + " and") for k in range(20)]
    rows += [row(f"n{k}", fill(f"Vane sold {k} shares ", f" at ${k + 1},512.")) for k in range(10)] + [row(f"s{k}", fill(f"Vane sold {k} ", " shares. Source: Vellum Str")) for k in range(10)]
    return rows + [row("e", "Vane sold shares at $12."), row("f", f"{S} Source: Vellum Street"), row("w", fill("Vane ", " rose.")), row("second", "whole.", content_snippet="whole too.")]


def test_limits_settle_doubtful_endings(make_articles):
    df = make_articles(limited())
    reason = {r.dedupe_key: r.reason for r in judged(df).where("field = 'summary'").collect()}
    assert {k for k, r in reason.items() if r == "limit"} == {r["dedupe_key"] for r in limited() if r["dedupe_key"][0] in "lns" and r["dedupe_key"] != "second"}
    assert {k for k, r in reason.items() if r == "transfer"} == {f"o{k}" for k in range(20)}
    rates = {r.field: r for r in cut_rates(df).collect()}
    assert (rates["summary"].n_values, rates["summary"].n_cut, rates["summary"].n_cut_at_limit, rates["summary"].n_cut_in_transfer) == (len(limited()), 70, 50, 20)
    assert rates["content_snippet"].cut_rate == 0


def test_one_doubtful_ending_at_a_limit_is_whole(make_articles):
    rows = [r for r in limited() if r["dedupe_key"][0] not in "ns" or r["dedupe_key"] in ("n1", "s1", "second")]
    assert {r.dedupe_key for r in cut_values(make_articles(rows)).collect()}.isdisjoint({"n1", "s1", "w", "second"})


def test_limit_before_a_mark(make_articles):
    """The length without the mark put after the cut makes the spike, however long the mark."""
    rows = [row(f"m{k}", ("word " * 40)[: 150 - len(str(k))] + f"{k}… [+{10 ** (k % 6)} chars]") for k in range(40)] + [row(f"o{k}", "x" * (20 + 7 * k) + ".") for k in range(40)]
    assert {(r.unit, r.length) for r in limits(judged(make_articles(rows))).collect()} >= {("body_chars", 150), ("body_bytes", 150)}


def test_deliveries_and_empty(make_articles):
    rows = [row("k", "Whole."), row("k", "Shares of Va", ingested_at=datetime(2024, 8, 1)), row(None, "Shares of Va", source_api=None)]
    assert [tuple(r) for r in cut_values(make_articles(rows)).collect()] == [(None, "summary")]
    assert cut_values(make_articles([])).count() == 0
    assert cut_rates(make_articles(rows)).count() == 2


@pytest.mark.parametrize("n", [100_000])
def test_long(make_articles, n):
    assert [r.field for r in cut_values(make_articles([row("k", "word " * n), row("w", "Word. " * n)])).collect()] == ["summary"]


def test_no_limit_without_a_spike(make_articles):
    df = make_articles([row(f"k{n}", "x" * (50 + n)) for n in range(100)])
    from newsloom.llm.truncation import endings, F

    assert limits(endings(df).select("dedupe_key", "source_api", F.inline("values"))).count() == 0
