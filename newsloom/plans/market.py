"""Queries over the market tables, and the SQL that must agree with each.

The canonical views: articles and bars by the earliest delivery of a key, sentiment by the last scoring of a key.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import calendar, clean
from newsloom.operators import features, model, scoring, store
from newsloom.operators.trailing import BAR_KEY
from newsloom.runtime import cut, earliest, table
from newsloom.schemas import TABLES
from newsloom.sources import normalize

MODEL = "toneclass-a"
SYMBOLS = ["quven ", "QXMHI", "", "XYOVB"]
SESSION = "2024-07-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = earliest(table(spark, sf_dir, "articles"), ["dedupe_key"], ["symbol", "headline"])
    return one.withColumn("symbol", F.upper("symbol"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return earliest(table(spark, sf_dir, "bars"), BAR_KEY, ["close", "volume"])


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "article_sentiment")
    r = s.groupBy("dedupe_key", "model_id").agg(F.max_by(F.struct(*s.columns), F.struct("scored_at", "score")).alias("r"))
    return r.select(*(F.col(f"r.{c}").alias(c) for c in s.columns))


_A = "a AS (SELECT * EXCLUDE (nth, symbol), upper(symbol) AS symbol FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY ingested_at, symbol, headline) AS nth FROM articles) WHERE nth = 1)"
_B = "b AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY source_api, symbol, bar_interval, bar_ts ORDER BY ingested_at, close, volume) AS nth FROM bars) WHERE nth = 1)"
_S = "s AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key, model_id ORDER BY scored_at DESC, score DESC NULLS LAST) AS nth FROM article_sentiment) WHERE nth = 1)"
_BLANK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


#: Days on which the exchange was shut or shut early in the span of the data (fixed values), for the SQL only.
_SHUT = "2024-06-19 2024-07-04 2024-09-02 2024-11-28 2024-12-25 2025-01-01 2025-01-09 2025-01-20".split()
_EARLY_CLOSE = "2024-07-03 2024-11-29 2024-12-24".split()


def _sessions() -> str:
    """Sessions of the data's span in SQL: day, prev_close, open, close, and the end of the New York day, all in UTC."""
    dates = lambda days: ", ".join(f"DATE '{d}'" for d in days)
    return f"""days AS (SELECT d::DATE AS day, CASE WHEN d < DATE '2024-11-03' THEN 4 ELSE 5 END AS behind FROM generate_series(DATE '2024-05-31', DATE '2025-01-31', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6 AND d::DATE NOT IN ({dates(_SHUT)})),
hours AS (SELECT day, day + to_minutes(570 + 60 * behind) AS open_utc, day + to_minutes(CASE WHEN day IN ({dates(_EARLY_CLOSE)}) THEN 780 ELSE 960 END + 60 * behind) AS close_utc, day + 1 + to_hours(behind) AS day_end FROM days),
cal AS (SELECT day, lag(close_utc) OVER (ORDER BY day) AS prev_close, open_utc, close_utc, day_end FROM hours)"""


_C = _sessions()
_AGG = "agg AS (SELECT symbol, nyse_session, round(avg(score), 9) AS sentiment_mean, count(*) AS sentiment_n, round(stddev_samp(score), 9) AS sentiment_std FROM assigned GROUP BY symbol, nyse_session)"
_SCORED = f"scored AS (SELECT a.symbol, a.published_at, s.score FROM s JOIN a USING (dedupe_key) WHERE s.model_id = '{MODEL}' AND s.error IS NULL AND s.score IS NOT NULL)"
_CUTOFF = "assigned AS (SELECT scored.*, day AS nyse_session FROM scored JOIN cal ON published_at >= prev_close AND published_at < open_utc)"
_BY_DAY = "assigned AS (SELECT scored.*, day AS nyse_session FROM (SELECT * FROM scored WHERE published_at >= TIMESTAMP '2024-06-03') scored ASOF JOIN cal ON published_at < day_end)"
_BARS_LABELLED = "labelled AS (SELECT b.*, day AS nyse_session FROM (SELECT * FROM b WHERE bar_interval = '1d') b ASOF JOIN cal ON bar_ts < day_end)"
_BAR_COLUMNS = ["source_api", "symbol", "bar_interval", "bar_ts", "open", "high", "low", "close", "volume"]
_FEATURES = ["nyse_session", "sentiment_mean", "sentiment_n", "sentiment_std"]


def _rounded(df: DataFrame) -> DataFrame:
    """Mean and deviation to 9 places, as sums of doubles depend on their order in the SQL."""
    return df.withColumns({c: F.round(c, 9) for c in ("sentiment_mean", "sentiment_std")})


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- features -------------------------------------------------------------------------------------------------
def _feature_sql(assign: str) -> str:
    chosen = ", ".join(f"l.{c}" for c in [*_BAR_COLUMNS, "nyse_session"])
    return _with(_A, _B, _S, _C, _SCORED, assign, _AGG, _BARS_LABELLED) + f"SELECT {chosen}, sentiment_mean, sentiment_n, sentiment_std FROM labelled l LEFT JOIN agg USING (symbol, nyse_session)"


def _all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return bars(spark, sf_dir), articles(spark, sf_dir), sentiment(spark, sf_dir)


@query(_feature_sql(_CUTOFF))
def feat_daily_bars_sentiment_open_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.daily_bars_sentiment(*_all(spark, sf_dir), MODEL)).select(*_BAR_COLUMNS, *_FEATURES)


@query(_feature_sql(_BY_DAY))
def feat_daily_bars_sentiment_article_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.daily_bars_sentiment(*_all(spark, sf_dir), MODEL, mode=features.ARTICLE_SESSION)).select(*_BAR_COLUMNS, *_FEATURES)


_TRAIN = f"train AS (SELECT l.source_api, l.symbol, l.bar_ts, l.nyse_session, l.close, l.open, sentiment_mean, sentiment_n, sentiment_std, l.close / l.open - 1 AS {features.TARGET} FROM labelled l LEFT JOIN agg USING (symbol, nyse_session) WHERE l.source_api = 'alpaca' AND l.open IS NOT NULL AND l.close IS NOT NULL AND l.open > 0)"


@query(_with(_A, _B, _S, _C, _SCORED, _CUTOFF, _AGG, _BARS_LABELLED, _TRAIN) + f"SELECT symbol, bar_ts, nyse_session, sentiment_mean, sentiment_n, sentiment_std, {features.TARGET} FROM train")
def training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.training_frame(*_all(spark, sf_dir), MODEL).select("symbol", "bar_ts", *_FEATURES, features.TARGET))


@query(
    _with(_A, _B, _S, _C, _SCORED, _CUTOFF, _AGG, _BARS_LABELLED, _TRAIN)
    + f"SELECT symbol, bar_ts, {features.TARGET}, row_number() OVER (ORDER BY bar_ts, symbol, source_api) <= (SELECT greatest(1, least(count(*) - 1, CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT))) FROM train) AS is_train FROM train"
)
def time_series_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = features.training_frame(*_all(spark, sf_dir), MODEL).select("source_api", "symbol", "bar_ts", features.TARGET)
    return features.time_split(frame, 0.8).drop("source_api")


@query(_with(_A, _B, _S, _C, _SCORED, _CUTOFF, _AGG, _BARS_LABELLED) + "SELECT symbol, bar_ts, close, nyse_session, sentiment_mean, sentiment_n, sentiment_std FROM (SELECT l.*, sentiment_mean, sentiment_n, sentiment_std, row_number() OVER (PARTITION BY l.symbol ORDER BY bar_ts DESC, source_api DESC) AS nth FROM labelled l LEFT JOIN agg USING (symbol, nyse_session) WHERE source_api = 'alpaca') WHERE nth = 1")
def latest_bar_per_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.latest_bar_inference(*_all(spark, sf_dir), MODEL).select("symbol", "bar_ts", "close", *_FEATURES))


@query(_with(_A, _S, _C, _SCORED, _CUTOFF, _AGG) + f"SELECT symbol, nyse_session, sentiment_mean, sentiment_n, sentiment_std FROM agg WHERE nyse_session = DATE '{SESSION}' AND symbol IN ('QUVEN', 'QXMHI', 'XYOVB')")
def session_features_open_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.target_session_features(articles(spark, sf_dir), sentiment(spark, sf_dir), MODEL, SYMBOLS, SESSION)).select("symbol", *_FEATURES)


@query(_with(_A, _S, _C, _SCORED, _BY_DAY, _AGG) + f"SELECT k.symbol, DATE '{SESSION}' AS nyse_session, sentiment_mean, sentiment_n, sentiment_std FROM (VALUES ('QUVEN'), ('QXMHI'), ('XYOVB')) k(symbol) LEFT JOIN agg ON agg.symbol = k.symbol AND nyse_session = DATE '{SESSION}'")
def session_features_article_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.target_session_features(articles(spark, sf_dir), sentiment(spark, sf_dir), MODEL, SYMBOLS, SESSION, features.ARTICLE_SESSION)).select("symbol", *_FEATURES)


@query(
    _with(_B, "r AS (SELECT close / open - 1 AS y, vwap / open - 1 AS p FROM b WHERE bar_interval = '1d' AND open > 0 AND close IS NOT NULL AND vwap IS NOT NULL)")
    + "SELECT count(*) AS n, round(avg(abs(y - p)), 8) AS mae, round(sqrt(avg((y - p) * (y - p))), 8) AS rmse, round(stddev_pop(y), 8) AS std_actual, round(stddev_pop(p), 8) AS std_predicted, round(corr(y, p), 8) AS corr FROM r"
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).where("bar_interval = '1d' and open > 0 and close is not null and vwap is not null").select((F.col("close") / F.col("open") - 1).alias("y"), (F.col("vwap") / F.col("open") - 1).alias("p"))
    m = features.regression_metrics(rows, "y", "p")
    return m.select("n", *(F.round(c, 8).alias(c) for c in m.columns[1:]))


@query()
def gbt_train_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits on the earlier rows and predicts the newest bar of each symbol."""
    frame = cut(features.time_split(features.training_frame(*_all(spark, sf_dir), MODEL)), "training")
    m = model.get_model("gbt_regressor", features.TARGET).fit(frame.where("is_train"))
    return m.predict(features.latest_bar_inference(*_all(spark, sf_dir), MODEL), "predicted_return_oc").select("symbol", "bar_ts", "nyse_session", "predicted_return_oc")


# -- calendar -------------------------------------------------------------------------------------------------
@query(_with(_A, _C) + "SELECT dedupe_key, day AS nyse_session FROM (SELECT * FROM a WHERE published_at >= TIMESTAMP '2024-06-03') a ASOF JOIN cal ON published_at < day_end UNION ALL SELECT dedupe_key, NULL FROM a WHERE published_at < TIMESTAMP '2024-06-03'")
def session_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.with_session_label(articles(spark, sf_dir), "published_at").select("dedupe_key", "nyse_session")


@query(_with(_A, _C) + "SELECT dedupe_key, day AS nyse_session FROM a LEFT JOIN cal ON published_at >= prev_close AND published_at < open_utc")
def open_cutoff_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.with_target_session(articles(spark, sf_dir), "published_at").select("dedupe_key", "nyse_session")


@query(_with(_C) + "SELECT day AS nyse_session, prev_close AS lower, open_utc AS upper FROM cal WHERE day BETWEEN DATE '2024-07-01' AND DATE '2024-12-31'")
def session_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.session_bounds(spark).where("nyse_session between date '2024-07-01' and date '2024-12-31'")


@query(
    _with(_A, _C, "t AS (SELECT dedupe_key, published_at AS t FROM a WHERE published_at >= TIMESTAMP '2024-06-04')", "o AS (SELECT t.dedupe_key, open_utc FROM t ASOF JOIN cal ON t.t < open_utc)", "c AS (SELECT t.dedupe_key, t.t, open_utc, close_utc FROM t ASOF JOIN cal ON t.t < close_utc)")
    + "SELECT c.dedupe_key, c.t >= c.open_utc AS is_open, o.open_utc AS next_open, c.close_utc AS next_close FROM c JOIN o USING (dedupe_key) UNION ALL SELECT dedupe_key, false, NULL, NULL FROM a WHERE published_at < TIMESTAMP '2024-06-04'"
)
def market_clock_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times of all articles; those without a time (1970) lie outside the calendar."""
    rows = articles(spark, sf_dir).select("dedupe_key", "published_at")
    return calendar.with_market_clock(rows, "published_at").select("dedupe_key", "is_open", "next_open", "next_close")


# -- reads ----------------------------------------------------------------------------------------------------
@query(_with(_B) + "SELECT * FROM b WHERE symbol IN ('QUVEN', 'QXMHI', 'XYOVB') AND bar_interval = '1d' AND bar_ts >= TIMESTAMP '2024-08-01' AND bar_ts <= TIMESTAMP '2024-09-01'")
def bars_multi_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.bars_of_symbols(bars(spark, sf_dir), SYMBOLS, start="2024-08-01", end="2024-09-01")


@query(_with(_B) + "SELECT * FROM b WHERE symbol = 'QUVEN' AND bar_interval = '1m' AND source_api = 'alpaca'")
def bars_single_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.bars_frame(bars(spark, sf_dir), "quven", "1M", " Alpaca ")


@query(_with(_B) + "SELECT * FROM b ORDER BY bar_ts DESC, symbol, source_api, bar_interval LIMIT 10")
def bars_latest10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest_bars(bars(spark, sf_dir))


@query(_with(_A) + "SELECT dedupe_key, source_api, symbol, published_at, headline FROM a WHERE symbol = 'QUVEN' AND source_api = 'finnhub'")
def articles_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.articles_frame(articles(spark, sf_dir), "quven", "Finnhub").select("dedupe_key", "source_api", "symbol", "published_at", "headline")


@query(_with(_A, _S) + f"SELECT dedupe_key, source_api, symbol, published_at, headline, summary FROM a WHERE dedupe_key NOT IN (SELECT dedupe_key FROM s WHERE model_id = '{MODEL}') AND published_at >= TIMESTAMP '2024-07-01'")
def articles_unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.articles_to_score(articles(spark, sf_dir), sentiment(spark, sf_dir), MODEL, start="2024-07-01")


@query(_with(_A) + "SELECT dedupe_key, source_api, symbol, published_at, headline, summary FROM a WHERE symbol IN ('QUVEN', 'QXMHI', 'XYOVB') ORDER BY published_at, dedupe_key LIMIT 25")
def articles_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.articles_to_score(articles(spark, sf_dir), sentiment(spark, sf_dir), MODEL, SYMBOLS, only_missing=False, limit=25)


@query(_with(_A, _S) + f"SELECT s.*, a.source_api, a.symbol, a.published_at FROM s JOIN a USING (dedupe_key) WHERE model_id = '{MODEL}' AND published_at <= TIMESTAMP '2024-10-01'")
def article_sentiment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.article_sentiment_frame(articles(spark, sf_dir), sentiment(spark, sf_dir), MODEL, end="2024-10-01")


@query("SELECT source_api, count(*) AS n_bars FROM bars GROUP BY source_api")
def bars_per_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "bars").groupBy("source_api").agg(F.count(F.lit(1)).alias("n_bars"))


@query("SELECT 'articles' AS name, count(*) AS n FROM articles UNION ALL SELECT 'bars', count(*) FROM bars UNION ALL SELECT 'article_sentiment', count(*) FROM article_sentiment")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = [table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in ("articles", "bars", "article_sentiment")]
    return normalize.union_frames(one, None)


# -- writes ---------------------------------------------------------------------------------------------------
_EARLY, _LATE = "TIMESTAMP '2024-09-01 00:00:00'", "TIMESTAMP '2024-08-15 00:00:00'"


def _batches(spark: SparkSession, sf_dir: str, name: str, at: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, name).withColumn("_seq", F.struct(at, *[c for c in ("close", "volume", "symbol", "headline", "score") if c in TABLES[name].fieldNames()]))
    return rows.where(f"{at} < timestamp_ntz'2024-09-01'"), rows.where(f"{at} >= timestamp_ntz'2024-08-15'")


@query(f"SELECT dedupe_key, symbol, published_at, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY ingested_at, symbol, headline) AS nth FROM articles WHERE ingested_at >= {_LATE}) WHERE nth = 1 AND dedupe_key NOT IN (SELECT dedupe_key FROM articles WHERE ingested_at < {_EARLY})")
def articles_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _batches(spark, sf_dir, "articles", "ingested_at")
    target = store.new_rows(first.limit(0), first, "articles")
    return store.new_rows(target, second, "articles").select("dedupe_key", "symbol", "published_at", "ingested_at")


@query(f"SELECT source_api, bar_interval, count(*) AS n_added, sum(CAST(volume AS BIGINT))::BIGINT AS volume FROM (SELECT *, row_number() OVER (PARTITION BY source_api, symbol, bar_interval, bar_ts ORDER BY ingested_at, close NULLS FIRST, volume NULLS FIRST) AS nth FROM bars WHERE ingested_at >= {_LATE}) x WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM bars y WHERE y.ingested_at < {_EARLY} AND y.source_api = x.source_api AND y.symbol = x.symbol AND y.bar_interval = x.bar_interval AND y.bar_ts = x.bar_ts) GROUP BY source_api, bar_interval")
def bars_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _batches(spark, sf_dir, "bars", "ingested_at")
    target = store.new_rows(first.limit(0), first, "bars")
    return store.new_rows(target, second, "bars").groupBy("source_api", "bar_interval").agg(F.count(F.lit(1)).alias("n_added"), F.sum(F.col("volume").cast("bigint")).alias("volume"))


@query("SELECT dedupe_key, model_id, score, prob_pos, text_hash, error FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key, model_id ORDER BY scored_at DESC, score DESC NULLS LAST) AS nth FROM article_sentiment WHERE scored_at IS NOT NULL) WHERE nth = 1")
def sentiment_upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _batches(spark, sf_dir, "article_sentiment", "scored_at")
    target = store.last_rows(first)
    return store.merged(target, store.last_rows(second)).select("dedupe_key", "model_id", "score", "prob_pos", "text_hash", "error")


@query("SELECT DISTINCT symbol FROM articles WHERE symbol IS NOT NULL AND symbol NOT IN (SELECT symbol FROM bars WHERE symbol IS NOT NULL)")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of articles, as written, that no bar has."""
    return store.foreign_key_violations(table(spark, sf_dir, "articles"), table(spark, sf_dir, "bars"), "symbol")


_COLUMN_ROWS = ", ".join(f"('{t}', '{f.name}', '{f.dataType.simpleString()}', {str(not f.nullable).upper()})" for t, s in TABLES.items() for f in s)


@query(f"SELECT * FROM (VALUES {_COLUMN_ROWS}) t(table_name, name, type, not_null)")
def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store.Store(spark, "unused")
    return normalize.union_frames([s.columns(t).select(F.lit(t).alias("table_name"), "name", "type", "not_null") for t in TABLES], None)


# -- scalars --------------------------------------------------------------------------------------------------
_HEADLINE = f"CASE WHEN headline IS NULL OR lower({_strip('headline')}) IN ('', 'nan') THEN '' ELSE left({_strip('headline')}, 200) END"


@query(
    _with(_A)
    + f"""SELECT dedupe_key, source_api || ':' || CASE WHEN external_article_id IS NOT NULL AND lower({_strip('external_article_id')}) NOT IN ('', 'nan') THEN 'id:' || {_strip('external_article_id')}
 WHEN url IS NOT NULL AND lower({_strip('url')}) NOT IN ('', 'nan') THEN 'url:' || {_strip('url')}
 ELSE 'fallback:' || strftime(published_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(published_at) % 1000000 <> 0 THEN strftime(published_at, '.%f') ELSE '' END || '+00:00:' || {_HEADLINE} END AS computed FROM a"""
)
def article_dedupe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return articles(spark, sf_dir).select("dedupe_key", clean.dedupe_key(c("source_api"), c("external_article_id"), c("url"), c("published_at"), c("headline")).alias("computed"))


@query(
    "WITH r AS (SELECT published_at, unnest([headline, '  ' || headline || chr(9), ' NaN', '   ', NULL]) AS headline FROM articles)\n"
    + f"SELECT 'newsapi:fallback:' || strftime(published_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(published_at) % 1000000 <> 0 THEN strftime(published_at, '.%f') ELSE '' END || '+00:00:' || {_HEADLINE} AS computed FROM r"
)
def article_fallback_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without id and url, of headlines as they are, padded, blank and missing."""
    h, none = F.col("headline"), F.lit(None).cast("string")
    written = F.array(h, F.concat(F.lit("  "), h, F.lit("\t")), F.lit(" NaN"), F.lit("   "), none)
    rows = table(spark, sf_dir, "articles").select("published_at", F.explode(written).alias("headline"))
    return rows.select(clean.dedupe_key(F.lit(" NewsAPI"), none, F.lit("  "), F.col("published_at"), F.col("headline")).alias("computed"))


_TEXT = f"concat_ws(' ', nullif({_strip('headline')}, ''), nullif({_strip('summary')}, ''))"


@query(_with(_A) + f"SELECT dedupe_key, {_TEXT} AS text, CASE WHEN {_TEXT} <> '' THEN sha256({_TEXT}) END AS text_hash FROM a")
def model_input_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = articles(spark, sf_dir).select("dedupe_key", clean.model_text(F.col("headline"), F.col("summary")).alias("text"))
    return text.withColumn("text_hash", clean.text_hash(F.col("text")))


@query(_with(_A) + "SELECT dedupe_key, left(sha256(coalesce(url, '') || chr(10) || coalesce(headline, '')), 32) AS article_id FROM a")
def newsapi_article_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("dedupe_key", clean.synthetic_id(F.col("url"), F.col("headline")).alias("article_id"))


@query("SELECT code, amount, unit FROM (VALUES ('1m', 1, 'minute'), ('5m', 5, 'minute'), ('15m', 15, 'minute'), ('30m', 30, 'minute'), ('60m', 1, 'hour'), ('1h', 1, 'hour'), ('1d', 1, 'day'), ('1wk', 1, 'week'), ('1w', 1, 'week'), ('1mo', 1, 'month'), ('7q', NULL, NULL)) t(code, amount, unit)")
def interval_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.createDataFrame([(c,) for c in (*clean.INTERVALS, "7q")], "code string")
    return codes.select("code", clean.interval_amount(F.col("code")).alias("amount"), clean.interval_unit(F.col("code")).alias("unit"))




def _lexicon_sql() -> str:
    counts = {k: f"CAST(len(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w IN ({', '.join(repr(w) for w in ws)}))) AS DOUBLE)" for k, ws in (("p", scoring.POSITIVE), ("n", scoring.NEGATIVE))}
    return _with(_A, f"t AS (SELECT dedupe_key, {_TEXT} AS text FROM a)", f"c AS (SELECT dedupe_key, text, {counts['p']} AS p, {counts['n']} AS n FROM t)") + (
        "SELECT dedupe_key, CASE WHEN text <> '' THEN (p + 1) / (p + n + 3) - (n + 1) / (p + n + 3) END AS score, CASE WHEN text <> '' THEN (p + 1) / (p + n + 3) END AS prob_pos, CASE WHEN text <> '' THEN (n + 1) / (p + n + 3) END AS prob_neg, CASE WHEN text = '' THEN 'empty_text' END AS error FROM c"
    )


@query(_lexicon_sql())
def lexicon_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_lexicon(articles(spark, sf_dir)).select("dedupe_key", "score", "prob_pos", "prob_neg", "error")


@query(
    _with(_S, "e AS (SELECT dedupe_key, model_id, exp(prob_neg - m) AS a, exp(prob_pos - m) AS b, exp(prob_neutral - m) AS c FROM (SELECT *, greatest(prob_neg, prob_pos, prob_neutral) AS m FROM s WHERE prob_pos IS NOT NULL AND prob_neg IS NOT NULL AND prob_neutral IS NOT NULL))")
    + "SELECT dedupe_key, round(b / (a + b + c), 9) AS prob_pos, round(a / (a + b + c), 9) AS prob_neg, round(c / (a + b + c), 9) AS prob_neutral FROM e"
)
def softmax_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sentiment(spark, sf_dir).where("prob_pos is not null and prob_neg is not null and prob_neutral is not null")
    raw = s.select("dedupe_key", F.array(F.lit("NEGATIVE"), F.lit("label_0"), F.lit("neu")).alias("labels"), F.array("prob_neg", "prob_pos", "prob_neutral").alias("logits"))
    p = scoring.labelled_probabilities(raw, "labels", "logits")
    return p.select("dedupe_key", *(F.round(c, 9).alias(c) for c in ("prob_pos", "prob_neg", "prob_neutral")))


# -- normalisers ----------------------------------------------------------------------------------------------
@query(_with(_A) + "SELECT upper(symbol) AS symbol, external_article_id AS article_id, date_trunc('second', published_at) AS datetime, headline, summary, source_name AS source, url, category FROM a WHERE source_api = 'finnhub'")
def news_normalize_finnhub(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir).where("source_api = 'finnhub'")
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', published_at)")
    record = F.struct(F.col("external_article_id").alias("id"), seconds.alias("datetime"), "headline", "summary", F.col("source_name").alias("source"), "url", "category", F.col("image_url").alias("image"), "related")
    payloads = a.select("symbol", F.to_json(F.array(record)).alias("payload"))
    return normalize.finnhub_news(payloads).select("symbol", "article_id", "datetime", "headline", "summary", "source", "url", "category")


@query(_with(_A) + "SELECT left(sha256(coalesce(url, '') || chr(10) || coalesce(headline, '')), 32) AS article_id, date_trunc('second', published_at) AS datetime, headline, summary, source_name AS source, author, left(coalesce(content_snippet, ''), 2000) AS content_snippet FROM a WHERE source_api = 'newsapi'")
def news_normalize_newsapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir).where("source_api = 'newsapi'")
    record = F.struct(
        F.struct(F.lit(None).cast("string").alias("id"), F.col("source_name").alias("name")).alias("source"), "author", F.col("headline").alias("title"), F.col("summary").alias("description"), "url",
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"), F.col("content_snippet").alias("content"),
    )
    payloads = a.select("symbol", F.to_json(F.struct(F.lit("ok").alias("status"), F.lit(1).alias("totalResults"), F.array(record).alias("articles"))).alias("payload"))
    return normalize.newsapi_news(payloads).select("article_id", "datetime", "headline", "summary", "source", "author", "content_snippet")


@query(_with(_B) + "SELECT source_api, symbol, bar_interval, bar_ts, open, close, volume, trade_count, stock_splits FROM b WHERE source_api = 'alpaca' AND bar_interval = '1d'")
def bar_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written out as a vendor would (mixed-case names, text values) and read back."""
    b = bars(spark, sf_dir).where("source_api = 'alpaca' and bar_interval = '1d'")
    raw = b.select(F.lower("symbol").alias("Symbol"), F.concat(F.date_format("bar_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("Timestamp"), *(F.coalesce(F.col(c).cast("string"), F.lit("NaN")).alias(c.capitalize()) for c in ("open", "close", "volume")), F.col("trade_count").cast("string").alias("Trade_Count"), F.col("stock_splits").alias("Stock Splits"))
    return store.bar_rows(normalize.alpaca_bars(raw), " Alpaca", "1D ").select("source_api", "symbol", "bar_interval", "bar_ts", "open", "close", "volume", "trade_count", "stock_splits")


@query(_with(_B) + "SELECT source_api, symbol, bar_ts, CASE WHEN source_api <> 'fmp' THEN close END AS close, CASE WHEN source_api = 'fmp' THEN vwap END AS vwap FROM b WHERE bar_interval = '1h'")
def vendor_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the vendors, each with other columns, as one."""
    b = bars(spark, sf_dir).where("bar_interval = '1h'")
    parts = [b.where(F.col("source_api") == v).select("source_api", "symbol", "bar_ts", "vwap" if v == "fmp" else "close") for v in ("alpaca", "finnhub", "fmp", "yfinance")]
    return normalize.union_frames(parts, "bar_ts").select("source_api", "symbol", "bar_ts", "close", "vwap")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", clean.whole_number(F.get_json_object("props", "$.k")).alias("k"))


@query("SELECT source_api, bar_interval, count(*) AS n_rows, count(close) AS n_close, min(bar_ts) AS first_ts, max(bar_ts) AS last_ts FROM bars GROUP BY source_api, bar_interval")
def bar_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "bars")
    return b.groupBy("source_api", "bar_interval").agg(F.count(F.lit(1)).alias("n_rows"), F.count("close").alias("n_close"), F.min("bar_ts").alias("first_ts"), F.max("bar_ts").alias("last_ts"))


# -- payloads, helpers and models -----------------------------------------------------------------------------
_YAHOO = "SELECT upper(symbol) AS symbol, date_trunc('second', bar_ts) AS timestamp, open, high, low, close, volume, coalesce(dividends, 0) AS dividends, coalesce(stock_splits, 0) AS splits FROM b WHERE source_api = 'yfinance' AND bar_interval = '1d'"


@query(_with(_B) + _YAHOO)
def yahoo_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars written as chart responses, dividends and splits as events, and read back."""
    b = bars(spark, sf_dir).where("source_api = 'yfinance' and bar_interval = '1d'")
    at = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', bar_ts)")
    event = lambda c, **fields: F.when(F.col(c) != 0, F.create_map(at.cast("string"), F.struct(*(v.alias(k) for k, v in fields.items()))))
    quote = F.struct(*(F.array(c).alias(c) for c in ("open", "high", "low", "close", "volume")))
    result = F.struct(F.array(at).alias("timestamp"), F.struct(event("dividends", amount=F.col("dividends")).alias("dividends"), event("stock_splits", numerator=F.col("stock_splits"), denominator=F.lit(1.0)).alias("splits")).alias("events"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    payloads = b.select(F.lower("symbol").alias("symbol"), F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))).alias("payload"))
    return normalize.yahoo_payload_bars(payloads).withColumnRenamed("stock splits", "splits")


@query(_with(_B) + "SELECT upper(symbol) AS symbol, date_trunc('second', bar_ts) AS timestamp, 2 * open AS open, 2 * close AS close, volume FROM b WHERE source_api = 'yfinance' AND bar_interval = '1d' AND close IS NOT NULL AND close <> 0")
def yahoo_payload_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with an adjusted close twice the close: all prices are twice as high."""
    b = bars(spark, sf_dir).where("source_api = 'yfinance' and bar_interval = '1d' and close is not null and close <> 0")
    at = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', bar_ts)")
    quote = F.struct(*(F.array(c).alias(c) for c in ("open", "high", "low", "close", "volume")))
    result = F.struct(F.array(at).alias("timestamp"), F.struct(F.array(quote).alias("quote"), F.array(F.struct(F.array(F.col("close") * 2).alias("adjclose"))).alias("adjclose")).alias("indicators"))
    payloads = b.select("symbol", F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))).alias("payload"))
    return normalize.yahoo_payload_bars(payloads, adjust=True).select("symbol", "timestamp", "open", "close", "volume")


@query(_with(_B) + "SELECT source_api, symbol, bar_interval, bar_ts, open, close, dividends, stock_splits FROM b WHERE source_api = 'yfinance' AND bar_interval = '1d'")
def yahoo_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars in a frame as that vendor's library gives it: a Date with an offset, capitalised names."""
    b = bars(spark, sf_dir).where("source_api = 'yfinance' and bar_interval = '1d'")
    local = F.date_format(F.col("bar_ts") - F.expr("interval 4 hours"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    raw = b.select(F.concat(local, F.lit("-04:00")).alias("Date"), "symbol", *(F.col(c).alias(c.capitalize()) for c in ("open", "high", "low", "close", "volume", "dividends")), F.col("stock_splits").alias("Stock Splits"))
    return store.bar_rows(normalize.yahoo_bars(raw), "yfinance", "1d").select("source_api", "symbol", "bar_interval", "bar_ts", "open", "close", "dividends", "stock_splits")


@query(_with(_B) + "SELECT upper(symbol) AS symbol, date_trunc('second', bar_ts) AS timestamp, open, high, low, close, volume, trade_count, vwap FROM b WHERE source_api = 'alpaca' AND bar_interval = '1h'")
def alpaca_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars written as pages of that vendor and read back."""
    b = bars(spark, sf_dir).where("source_api = 'alpaca' and bar_interval = '1h'")
    bar = F.struct(F.date_format("bar_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"), F.col("trade_count").alias("n"), F.col("vwap").alias("vw"))
    return normalize.alpaca_payload_bars(b.select("symbol", F.to_json(F.struct(F.array(bar).alias("bars"), F.lit("more").alias("next_page_token"))).alias("payload")))


@query("SELECT n_nationkey, n_name FROM nation")
def profile_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of unknown layout, as a profile endpoint gives them: lists, single objects and answers that are neither."""
    n = table(spark, sf_dir, "nation")
    record = F.to_json(F.struct("n_nationkey", "n_name"))
    payloads = n.select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("["), record, F.lit("]"))).otherwise(record).alias("payload")).unionByName(spark.createDataFrame([("17",), (None,), ("[]",)], "payload string"))
    return normalize.json_records(spark, payloads).select("n_nationkey", "n_name")


@query("SELECT symbol, count(*) AS n_bars FROM bars WHERE source_api = 'alpaca' AND bar_interval = '1d' GROUP BY symbol")
def bars_per_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.bars_frame(table(spark, sf_dir, "bars"), bar_interval="1d", source_api="alpaca").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))


@query(_with(_A) + "SELECT least(50, count(*)) AS n_50, 0::BIGINT AS n_0, least(5, count(*) FILTER (symbol = 'QUVEN')) AS n_of_symbol FROM a")
def articles_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows limited reads give; a limit of zero is zero, and limits come after filters."""
    a = articles(spark, sf_dir)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(store.articles_frame(a, limit=50), "n_50").crossJoin(n(store.articles_frame(a, limit=0), "n_0")).crossJoin(n(store.articles_frame(a, "QUVEN", limit=5), "n_of_symbol"))


@query("SELECT 'bars' AS name, 1 AS version")
def tables_unlike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the stored tables but those like a pattern, and the version of the layout."""
    import uuid

    from newsloom.runtime import shared_dir

    s = store.Store(spark, f"{shared_dir(spark)}/newsloom/store-{uuid.uuid4().hex}")
    s.init_schema()
    return s.names("article%").withColumn("version", F.lit(s.schema_version()))


@query("SELECT * FROM (VALUES ('1', true), (' TRUE', true), ('Yes', true), ('on ', true), ('0', false), ('no', false), ('', false), (NULL, false)) t(text, is_on)")
def truthy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.createDataFrame([("1",), (" TRUE",), ("Yes",), ("on ",), ("0",), ("no",), ("",), (None,)], "text string")
    return texts.select("text", clean.truthy(F.col("text")).alias("is_on"))


@query(_with(_B, "r AS (SELECT vwap / open - 1 AS p FROM b WHERE bar_interval = '1d' AND open > 0)") + "SELECT count(p) AS n, round(avg(p), 9) AS mean, round(stddev_pop(p), 9) AS std FROM r")
def prediction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).where("bar_interval = '1d' and open > 0").select((F.col("vwap") / F.col("open") - 1).alias("p"))
    return features.prediction_summary(rows, "p").select("n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query(_with(_A, _B, _S, _C, _SCORED, _CUTOFF, _AGG, _BARS_LABELLED, _TRAIN) + "SELECT symbol, bar_ts, coalesce(sentiment_mean, 0) AS x0, coalesce(sentiment_n, 0)::DOUBLE AS x1, coalesce(sentiment_std, 0) AS x2, (sentiment_mean IS NOT NULL)::INT::DOUBLE AS x3 FROM train")
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the trees read of each row, gaps filled, and whether there was news."""
    from pyspark.ml.functions import vector_to_array

    rows = model.feature_matrix(features.training_frame(*_all(spark, sf_dir), MODEL)).withColumn("x", vector_to_array("features"))
    return rows.select("symbol", "bar_ts", *(F.round(F.col("x")[k], 9).alias(f"x{k}") for k in range(4)))


def _by_length():
    """A scorer for tests: probabilities from the length of a text."""
    return lambda texts: [{"prob_pos": len(t) % 10 / 20, "prob_neg": len(t) % 7 / 20} for t in texts]


@query(
    _with(_A, f"t AS (SELECT dedupe_key, {_TEXT} AS text FROM a)")
    + "SELECT dedupe_key, CASE WHEN text <> '' THEN length(text) % 10 / 20.0::DOUBLE - length(text) % 7 / 20.0::DOUBLE END AS score, CASE WHEN text <> '' THEN length(text) % 10 / 20.0::DOUBLE END AS prob_pos, NULL::DOUBLE AS prob_neutral, CASE WHEN text <> '' THEN sha256(text) END AS text_hash, CASE WHEN text = '' THEN 'empty_text' END AS error FROM t"
)
def scorer_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through a scorer on the workers, batch by batch; answers go back by key."""
    return scoring.score_with(articles(spark, sf_dir), _by_length, "by-length").select("dedupe_key", "score", "prob_pos", "prob_neutral", "text_hash", "error")


# -- streams --------------------------------------------------------------------------------------------------
@query(_with(_A, _C) + "SELECT dedupe_key, published_at, day AS nyse_session FROM a LEFT JOIN cal ON published_at >= prev_close AND published_at < open_utc")
def streaming_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles read as a stream, deduplicated, with their target session, written by a file sink."""
    import uuid

    from newsloom.runtime import shared_dir
    from newsloom.streaming import articles as stream

    path = f"{sf_dir}/articles.parquet"
    src = spark.readStream.schema(table(spark, sf_dir, "articles").schema).parquet(path if os.path.isdir(path) else f"{sf_dir}/articles*.parquet")
    out = f"{shared_dir(spark)}/newsloom/stream-{uuid.uuid4().hex}"
    chosen = stream.with_sessions(stream.deduplicated(src, "120 days")).select("dedupe_key", "published_at", "nyse_session")
    chosen.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(chosen.schema).parquet(f"{out}/rows")
