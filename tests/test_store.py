from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from newsloom.operators import store as S
from newsloom.operators.store import Store

NEWS = "article_id string, datetime string, headline string, symbol string, url string, _seq bigint"


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.schema_version() == 0 and s.tables() == []
    s.init_schema()
    s.init_schema()
    assert s.schema_version() == 1
    return s


def news(spark, *rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], NEWS)


def test_articles_first_wins_and_second_run_adds_nothing(spark, store):
    batch = news(spark, ("1", "2024-06-15T14:00:00+00:00", "h", "aapl", None), ("1", "2024-06-15T14:00:00+00:00", "other", "msft", None), (None, None, "x", None, None))
    assert store.upsert_articles(batch, " Finnhub ") == 2
    assert store.upsert_articles(batch, "finnhub") == 0
    got = {r.dedupe_key: r for r in store.read("articles").collect()}
    assert got["finnhub:id:1"].symbol == "AAPL" and got["finnhub:id:1"].headline == "h"
    assert got["finnhub:fallback:1970-01-01T00:00:00+00:00:x"].published_at == datetime(1970, 1, 1)


def bars(spark, **more):
    row = {"timestamp": "2024-06-15T13:30:00Z", "symbol": "aapl", "open": "180", "close": "NaN"} | more
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` string" for k in row))


def test_bars(spark, store):
    b = bars(spark, **{"stock splits": "2"}, surplus="x", trade_count="7.0")
    assert store.upsert_bars(b, "YFinance", "1D") == 1 and store.upsert_bars(b, "yfinance", "1d") == 0 and store.upsert_bars(b, "alpaca", "1d") == 1
    r = store.read("bars").where("source_api = 'yfinance'").first()
    assert (r.symbol, r.bar_interval, r.open, r.close, r.stock_splits, r.trade_count, r.bar_ts) == ("AAPL", "1d", 180.0, None, 2.0, 7, datetime(2024, 6, 15, 13, 30))
    with pytest.raises(ValueError, match="symbol"):
        store.upsert_bars(b.drop("symbol"), "alpaca", "1d")
    with pytest.raises(Exception, match="bar without timestamp"):
        store.upsert_bars(bars(spark, timestamp="never"), "alpaca", "1d")


def test_rows_without_a_required_value_are_skipped(spark, store):
    rows = S.article_rows(news(spark, ("1", None, "h", None, None)), "a").withColumn("source_api", F.lit(None).cast("string"))
    assert store.insert_or_ignore("articles", rows) == 0


def test_sentiment_last_wins(spark, store):
    store.upsert_articles(news(spark, ("1", None, "h", "A", None), ("2", None, "h", "A", None)), "a")
    rows = lambda *v: spark.createDataFrame([(*x, k) for k, x in enumerate(v)], "dedupe_key string, model_id string, score double, prob_pos double, prob_neg double, prob_neutral double, text_hash string, error string, _seq bigint")
    assert store.upsert_article_sentiment(rows(("a:id:1", "m", 0.1, None, None, None, None, None), ("a:id:1", "m", 0.2, None, None, None, None, None), ("a:id:2", "m", float("nan"), None, None, None, None, "e"))) == 2
    assert store.upsert_article_sentiment(rows(("a:id:1", "m", 0.7, None, None, None, "t", None))) == 1
    got = {r.dedupe_key: (r.score, r.error) for r in store.read("article_sentiment").collect()}
    assert got == {"a:id:1": (0.7, None), "a:id:2": (None, "e")}
    with pytest.raises(ValueError, match="without an article"):
        store.upsert_article_sentiment(rows(("a:id:9", "m", 0.7, None, None, None, None, None)))


def test_unfinished_parts_do_not_count(spark, store, tmp_path):
    (tmp_path / "articles" / "delta-00000009").mkdir()
    assert store.read("articles").count() == 0


def test_reads(spark):
    a = spark.createDataFrame([(f"k{n}", "v", "QUVEN" if n % 2 else "X", datetime(2024, 7, n + 1), "h", "s") for n in range(6)], "dedupe_key string, source_api string, symbol string, published_at timestamp_ntz, headline string, summary string")
    s = spark.createDataFrame([("k1", "m", 0.5, None), ("k2", "m", None, "timeout"), ("k3", "other", 0.1, None)], "dedupe_key string, model_id string, score double, error string")
    todo = lambda **o: [r.dedupe_key for r in S.articles_to_score(a, s, "m", **o).collect()]
    assert todo() == ["k0", "k3", "k4", "k5"] and todo(limit=2) == ["k0", "k3"] and todo(limit=0) == []
    assert todo(symbols=["", " "]) == ["k0", "k3", "k4", "k5"] and todo(symbols=["quven"]) == ["k3", "k5"]
    assert todo(only_missing=False, end="2024-07-02") == ["k0", "k1"]
    assert [r.dedupe_key for r in S.article_sentiment_frame(a, s, "m").collect()] == ["k1", "k2"]
    b = spark.createDataFrame([("v", "QUVEN", "1d", datetime(2024, 7, 1), 1.0)], "source_api string, symbol string, bar_interval string, bar_ts timestamp_ntz, close double")
    assert S.bars_of_symbols(b, []).count() == 0 and S.bars_of_symbols(b, [" quven"]).count() == 1 and S.bars_frame(b, "X").count() == 0


def test_columns(spark, store):
    assert store.upsert_bars(bars(spark), "a", "1d") == 1 and '"symbol":"AAPL"' in store.sample_json("bars")[0]
    ingested = store.read("bars").first().ingested_at
    assert abs((ingested - datetime.now(timezone.utc).replace(tzinfo=None)).total_seconds()) < 300
    got = {r.name: r.key_position for r in store.columns("bars").collect()}
    assert got["bar_ts"] == 4 and got["close"] == 0
