import math
from datetime import date, datetime

import pytest

from newsloom.operators import features, model, scoring

BARS = "source_api string, symbol string, bar_interval string, bar_ts timestamp_ntz, open double, close double"
ARTS = "dedupe_key string, source_api string, symbol string, published_at timestamp_ntz"
SENT = "dedupe_key string, model_id string, score double, error string"
T = datetime(2024, 7, 2, 4)


def tables(spark):
    bars = spark.createDataFrame(
        [("alpaca", "A", "1d", T, 100.0, 102.0), ("yfinance", "A", "1d", T, 101.0, 99.0), ("alpaca", "A", "1d", datetime(2024, 7, 3, 4), 0.0, 1.0), ("alpaca", "B", "1d", T, 100.0, 100.25), ("alpaca", "C", "1d", T, None, 1.0), ("alpaca", "A", "1h", T, 1.0, 1.0)], BARS
    )
    at = [datetime(2024, 7, 1, 21), datetime(2024, 7, 2, 13), datetime(2024, 7, 2, 15), datetime(2024, 7, 2, 12), datetime(2024, 7, 2, 12)]
    arts = spark.createDataFrame([(f"k{n}", "v", "A" if n < 4 else "B", t) for n, t in enumerate(at)], ARTS)
    sent = spark.createDataFrame([("k0", "m", 0.5, None), ("k1", "m", 0.25, None), ("k2", "m", -1.0, None), ("k3", "m", None, "timeout"), ("k4", "m", 0.1, None), ("k4", "other", 0.9, None)], SENT)
    return bars, arts, sent


def test_frame(spark):
    got = {(r.source_api, r.symbol, r.bar_ts): r for r in features.daily_bars_sentiment(*tables(spark), "m").collect()}
    assert len(got) == 5
    a = got["alpaca", "A", T]
    assert (a.nyse_session, a.sentiment_mean, a.sentiment_n) == (date(2024, 7, 2), 0.375, 2) and math.isclose(a.sentiment_std, math.sqrt(0.03125))
    b, none = got["alpaca", "B", T], got["alpaca", "C", T]
    assert (b.sentiment_mean, b.sentiment_n, b.sentiment_std) == (0.1, 1, None) and (none.sentiment_mean, none.sentiment_n, none.sentiment_std) == (None, None, None)
    by_day = {(r.source_api, r.symbol, r.bar_ts): r for r in features.daily_bars_sentiment(*tables(spark), "m", mode="article_session").collect()}
    assert by_day["alpaca", "A", T].sentiment_n == 2 and by_day["alpaca", "A", T].sentiment_mean == -0.375


def test_no_symbols_and_unknown_mode(spark):
    empty = features.daily_bars_sentiment(*tables(spark), "m", symbols=[])
    assert empty.count() == 0 and "sentiment_n" in empty.columns
    with pytest.raises(ValueError):
        features.daily_bars_sentiment(*tables(spark), "m", mode="x")


def test_target_sessions(spark):
    _, arts, sent = tables(spark)
    by_cutoff = features.target_session_features(arts, sent, "m", ["A", "Z"], "2024-07-02").collect()
    assert [(r.symbol, r.sentiment_n) for r in by_cutoff] == [("A", 2)]
    by_day = features.target_session_features(arts, sent, "m", ["A", "Z", "Z"], "2024-07-02", "article_session").collect()
    assert sorted((r.symbol, r.sentiment_n) for r in by_day if r.symbol == "A") == [("A", 2)] and sum(r.symbol == "Z" for r in by_day) == 2


def test_labels_and_training_rows(spark):
    rows = features.training_frame(*tables(spark), "m").collect()
    assert sorted((r.symbol, round(r[features.TARGET], 8)) for r in rows) == [("A", 0.02), ("B", 0.0025)]


def test_split(spark):
    assert [features.split_size(n, 0.8) for n in (0, 1, 2, 3, 10)] == [0, 1, 1, 2, 8]
    with pytest.raises(ValueError):
        features.split_size(5, 1.0)
    df = spark.createDataFrame([(f"s{k}", "v", datetime(2024, 7, 1 + k // 4)) for k in range(10)], "symbol string, source_api string, bar_ts timestamp_ntz")
    got = features.time_split(df, 0.5).collect()
    assert {r.symbol for r in got if r.is_train} == {"s0", "s1", "s2", "s3", "s4"} and len(got) == 10
    assert features.time_split(df.limit(0)).count() == 0


def test_latest(spark):
    got = {r.symbol: (r.bar_ts, r.source_api) for r in features.latest_bars(features.daily_bars_sentiment(*tables(spark), "m")).collect()}
    assert got == {"A": (datetime(2024, 7, 3, 4), "alpaca"), "B": (T, "alpaca"), "C": (T, "alpaca")}


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 4.0), (None, 1.0)], "y double, p double")
    m = features.regression_metrics(df, "y", "p").first()
    assert (m.n, m.mae, m.rmse) == (3, 1.0, 1.0) and math.isclose(m.corr, 1.0) and math.isclose(m.std_actual, math.sqrt(2 / 3))
    flat = features.regression_metrics(spark.createDataFrame([(1.0, 2.0)] * 3, "y double, p double"), "y", "p").first()
    assert flat["corr"] is None
    assert features.regression_metrics(df.limit(0), "y", "p").first().n == 0


def test_lexicon_and_custom_scorers(spark):
    arts = spark.createDataFrame([("a", "Shares gained on strong growth", None), ("b", None, "  "), ("c", "Loss and fraud", ""), ("d", "boom", "")], "dedupe_key string, headline string, summary string")
    got = {r.dedupe_key: r for r in scoring.score_lexicon(arts).collect()}
    assert got["a"].score > 0 > got["c"].score and got["b"].score is None and got["b"].error == "empty_text" and got["b"].text_hash is None

    def load():
        def scorer(texts):
            if "boom" in texts:
                raise RuntimeError("no")
            return [{"prob_pos": float(len(t)), "prob_neg": 0.0} for t in texts]

        return scorer

    own = {r.dedupe_key: r for r in scoring.score_with(arts, load, "own", batch_size=1).collect()}
    assert own["a"].score == len("Shares gained on strong growth") and own["b"].error == "empty_text" and own["d"].error.startswith("RuntimeError") and own["d"].score is None and own["a"].prob_neutral is None


def test_model(spark, tmp_path):
    rows = [("S", k / 40, k % 5, 0.1, k / 40 * 0.5) for k in range(40)] + [("S", None, None, None, 0.0)] * 5
    df = spark.createDataFrame(rows, "symbol string, sentiment_mean double, sentiment_n bigint, sentiment_std double, y double")
    with pytest.raises(ValueError):
        model.get_model("other", "y")
    with pytest.raises(ValueError, match="sentiment_n"):
        model.feature_matrix(df.drop("sentiment_n"))
    with pytest.raises(ValueError):
        model.get_model("gbt_regressor", "y").predict(df)
    m = model.get_model("gbt_regressor", "y", rounds=5).fit(df)
    first = m.predict(df).collect()
    m.save(str(tmp_path / "m"))
    again = model.get_model("gbt_regressor", "y").load(str(tmp_path / "m")).predict(df).collect()
    assert [r.prediction for r in first] == [r.prediction for r in again] and len(first) == 45
    assert set(m.predict(df, "p").columns) == {*df.columns, "p"}
