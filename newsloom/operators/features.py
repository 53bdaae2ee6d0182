"""Sentiment per symbol and session, joined to bars; labels, splits and the newest bar.

Means and deviations are taken from sums of whole units (scores to 12 places), so they do not depend on the order of rows
and lose nothing where scores are nearly equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import calendar
from newsloom.operators import store
from newsloom.runtime import cut
from newsloom.schemas import SENTIMENT_FEATURES

OPEN_CUTOFF, ARTICLE_SESSION = "open_cutoff", "article_session"
TARGET = "target_return_oc"


def _assigned(scored: DataFrame, mode: str, days: DataFrame | None) -> DataFrame:
    if mode not in (OPEN_CUTOFF, ARTICLE_SESSION):
        raise ValueError(f"unknown sentiment mode {mode!r}")
    valid = scored.where("error is null and score is not null and published_at is not null")
    assign = calendar.with_target_session if mode == OPEN_CUTOFF else calendar.with_session_label
    return assign(valid, "published_at", "nyse_session", days).where("nyse_session is not null")


def aggregate(assigned: DataFrame) -> DataFrame:
    """symbol, nyse_session, mean, count and sample deviation of score (null for a single one)."""
    unit = 10.0**12
    x = (F.col("score").cast("decimal(18,12)") * F.lit(10**12)).cast("decimal(18,0)")
    n = F.col("n").cast("double")
    sums = assigned.groupBy("symbol", "nyse_session").agg(F.sum(x).alias("s"), F.sum((x * x).cast("decimal(28,0)")).alias("q"), F.count(x).alias("n"), F.stddev_samp("score").alias("d"))
    # n q - s s in whole units, exact as long as a decimal holds it
    spread = F.try_subtract(F.try_multiply(F.col("n").cast("decimal(19,0)"), F.col("q")), F.try_multiply(F.col("s"), F.col("s")))
    exact = F.sqrt(spread.cast("double") / (n * (n - 1))) / unit
    return sums.select(
        "symbol",
        "nyse_session",
        (F.col("s").cast("double") / unit / n).alias("sentiment_mean"),
        F.col("n").alias("sentiment_n"),
        F.when(F.col("n") > 1, F.coalesce(exact, F.col("d"))).alias("sentiment_std"),
    )


def session_sentiment(articles: DataFrame, sentiment: DataFrame, model_id: str, symbols: Sequence[str] | None = None, mode: str = OPEN_CUTOFF, published_start: str | None = None, published_end: str | None = None, days: DataFrame | None = None) -> DataFrame:
    return aggregate(_assigned(store.scored_articles(articles, sentiment, model_id, symbols, published_start, published_end), mode, days))


def daily_bars_sentiment(bars: DataFrame, articles: DataFrame, sentiment: DataFrame, model_id: str, symbols: Sequence[str] | None = None, bar_interval: str = "1d", bar_source_api: str | None = None, bar_ts_start: str | None = None, bar_ts_end: str | None = None, mode: str = OPEN_CUTOFF, published_start: str | None = None, published_end: str | None = None, days: DataFrame | None = None) -> DataFrame:
    """Bars with their session and its sentiment; all three features are null where no article counts. symbols None means
    all, an empty list none. With several vendors a symbol and session has a row for each."""
    if symbols is None:
        chosen = bars.where(F.col("bar_interval") == bar_interval)
        if bar_source_api:
            chosen = chosen.where(F.col("source_api") == bar_source_api)
        chosen = store._between(chosen, "bar_ts", bar_ts_start, bar_ts_end)
    else:
        chosen = store.bars_of_symbols(bars, symbols, bar_interval, bar_source_api, bar_ts_start, bar_ts_end)
    labelled = calendar.with_session_label(chosen, "bar_ts", "nyse_session", days)
    return labelled.join(session_sentiment(articles, sentiment, model_id, symbols, mode, published_start, published_end, days), ["symbol", "nyse_session"], "left")


def target_session_features(articles: DataFrame, sentiment: DataFrame, model_id: str, symbols: Sequence[str], nyse_session: str, mode: str = OPEN_CUTOFF, days: DataFrame | None = None) -> DataFrame:
    """Features of one session without bars. By open cutoff only symbols with articles come; by article session every
    symbol asked for comes, as often as it was asked for."""
    wanted = store.clean.symbol_list(symbols)
    agg = session_sentiment(articles, sentiment, model_id, wanted, mode, days=days).where(F.col("nyse_session") == F.lit(nyse_session).cast("date"))
    if mode == OPEN_CUTOFF:
        return agg if wanted else agg.limit(0)
    keys = articles.sparkSession.createDataFrame([(s,) for s in wanted], "symbol string").withColumn("nyse_session", F.lit(nyse_session).cast("date"))
    return keys.join(agg, ["symbol", "nyse_session"], "left")


def open_to_close(df: DataFrame) -> DataFrame:
    """Adds the return from open to close; null where open is null or zero."""
    number = store.clean.number
    return df.withColumn(TARGET, F.try_divide(number(F.col("close")), number(F.col("open"))) - 1)


def training_frame(bars: DataFrame, articles: DataFrame, sentiment: DataFrame, model_id: str, symbols: Sequence[str] | None = None, bar_source_api: str | None = "alpaca", **options) -> DataFrame:
    """The feature frame with its label, where open and close are known, open is positive and the label is known."""
    rows = daily_bars_sentiment(bars, articles, sentiment, model_id, symbols, bar_source_api=bar_source_api, **options)
    return open_to_close(rows).where(f"open is not null and close is not null and open > 0 and {TARGET} is not null")


def latest_bars(frame: DataFrame) -> DataFrame:
    """The newest row of each symbol; of equal times the vendor last in the alphabet. Map-side combined, so a hot symbol costs no
    more than a row a task."""
    columns = frame.columns
    newest = frame.groupBy("symbol").agg(F.max_by(F.struct(*columns), F.struct("bar_ts", "source_api")).alias("r"))
    return newest.select(*(F.col(f"r.{c}").alias(c) for c in columns))


def latest_bar_inference(bars: DataFrame, articles: DataFrame, sentiment: DataFrame, model_id: str, symbols: Sequence[str] | None = None, bar_source_api: str | None = "alpaca", **options) -> DataFrame:
    return latest_bars(daily_bars_sentiment(bars, articles, sentiment, model_id, symbols, bar_source_api=bar_source_api, **options))


def split_size(n: int, fraction: float) -> int:
    """Rows of the earlier part: at least one on either side where there are two."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction must lie between 0 and 1")
    return max(1, min(n - 1, int(n * fraction))) if n else 0


def time_split(frame: DataFrame, fraction: float = 0.8, ties: Sequence[str] = ("symbol", "source_api")) -> DataFrame:
    """Adds is_train: whether a row is among the first rows by bar_ts. One timestamp may lie on both sides.

    The cut is found by counting rows per bar_ts, not by ordering all of them: whole timestamps before the one in which
    the cut falls are on the earlier side, and only the rows of that one are numbered."""
    counts = cut(frame.groupBy("bar_ts").agg(F.count(F.lit(1)).alias("n")), "times")
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = split_size(int(total), fraction)
    at = counts.withColumn("upto", F.sum("n").over(Window.orderBy(F.col("bar_ts").asc_nulls_first()))).where(F.col("upto") > size).orderBy("upto").limit(1).collect()
    if not at:
        return frame.withColumn("is_train", F.lit(True))
    edge, left = at[0]["bar_ts"], size - (at[0]["upto"] - at[0]["n"])
    if edge is None:
        before, here = F.lit(False), F.col("bar_ts").isNull()
    else:
        before, here = F.col("bar_ts").isNull() | (F.col("bar_ts") < F.lit(edge)), F.col("bar_ts") == F.lit(edge)
    nth = F.row_number().over(Window.partitionBy("bar_ts").orderBy(*ties))
    inside = frame.where(here).withColumn("is_train", nth <= left)
    return frame.where(~F.coalesce(here, F.lit(False))).withColumn("is_train", F.coalesce(before, F.lit(False))).unionByName(inside)


def regression_metrics(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """n, mae, rmse, population deviations, and the correlation where it means something."""
    y, p = F.col(actual).cast("decimal(24,12)"), F.col(predicted).cast("decimal(24,12)")
    d = y - p

    def total(c: Column) -> Column:
        return F.sum(c.cast("decimal(30,12)")).cast("double")

    sums = rows.where(f"{actual} is not null and {predicted} is not null").agg(
        F.count(F.lit(1)).alias("n"), total(F.abs(d)).alias("a"), total(d * d).alias("dd"), total(y).alias("sy"), total(p).alias("sp"), total(y * y).alias("yy"), total(p * p).alias("pp"), total(y * p).alias("yp")
    )
    n = F.nullif(F.col("n").cast("double"), F.lit(0.0))
    sd = {k: F.sqrt(F.greatest(F.col(f"{k}{k}") / n - (F.col(f"s{k}") / n) * (F.col(f"s{k}") / n), F.lit(0.0))) for k in "yp"}
    corr = (F.col("yp") / n - (F.col("sy") / n) * (F.col("sp") / n)) / (sd["y"] * sd["p"])
    return sums.select(
        "n", (F.col("a") / n).alias("mae"), F.sqrt(F.col("dd") / n).alias("rmse"), sd["y"].alias("std_actual"), sd["p"].alias("std_predicted"), F.when((F.col("n") >= 2) & (sd["y"] > 1e-12) & (sd["p"] > 1e-12), corr).alias("corr")
    )


def prediction_summary(rows: DataFrame, predicted: str) -> DataFrame:
    """n, mean and population deviation of a prediction; the deviation of a single one is zero."""
    p = F.col(predicted)
    return rows.agg(F.count(p).alias("n"), F.avg(p).alias("mean"), F.when(F.count(p) > 1, F.stddev_pop(p)).otherwise(0.0).alias("std"))


def feature_columns() -> list[str]:
    return list(SENTIMENT_FEATURES)


def require_columns(frame: DataFrame, names: Sequence[str]) -> None:
    if missing := [n for n in names if n not in frame.columns]:
        raise ValueError("missing columns: " + ", ".join(missing))
