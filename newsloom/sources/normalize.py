"""Vendor payloads to canonical frames. Payloads are JSON texts in a column `payload`, prices also plain frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import clean
from newsloom.runtime import cut_text
from newsloom.schemas import NEWS

CONTENT_LIMIT = 2000
_FINNHUB = "array<struct<id:string,datetime:string,headline:string,summary:string,source:string,url:string,category:string,image:string,related:string>>"
_NEWSAPI = "status string, code string, message string, totalResults bigint, articles array<struct<source:struct<id:string,name:string>,author:string,title:string,description:string,url:string,urlToImage:string,publishedAt:string,content:string>>"


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.lower() for c in df.columns))


def yahoo_bars(df: DataFrame, index: str = "Date", symbol: str | None = None) -> DataFrame:
    """Lower-case columns, the index as `timestamp` in UTC."""
    out = lower_columns(df.withColumnRenamed(index, "timestamp"))
    out = out.withColumn("timestamp", clean.utc(F.col("timestamp")))
    return out if symbol is None else out.withColumn("symbol", F.lit(symbol.strip().upper()))


def alpaca_bars(df: DataFrame, symbol: str | None = None) -> DataFrame:
    """Lower-case columns, times in UTC, the symbol filled and in upper case; by time."""
    out = lower_columns(df)
    own = F.col("symbol") if "symbol" in out.columns else F.lit(None).cast("string")
    return out.withColumns({"timestamp": clean.utc(F.col("timestamp")), "symbol": F.upper(F.coalesce(own, F.lit(symbol)))}).orderBy("timestamp")


def union_frames(frames: Sequence[DataFrame], by: str | None = "timestamp") -> DataFrame:
    """All rows by column name; what a frame lacks is null."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.orderBy(F.col(by).asc_nulls_last()) if by else out


def _news(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in NEWS))


def finnhub_news(payloads: DataFrame) -> DataFrame:
    """symbol, payload (array of records) -> news rows; times are epoch seconds, unreadable ones null and last."""
    r = payloads.select("symbol", F.explode(F.from_json("payload", _FINNHUB)).alias("r"))
    rows = _news(
        r, symbol=F.upper("symbol"), article_id=F.col("r.id"), datetime=clean.from_epoch_seconds(F.col("r.datetime")),
        **{c: F.col(f"r.{c}") for c in ("headline", "summary", "source", "url", "category", "image", "related")},
    )
    return rows.orderBy(F.col("datetime").asc_nulls_last())


def newsapi_news(payloads: DataFrame) -> DataFrame:
    """symbol (may be null), payload (response object) -> news rows; an id is made from url and title."""
    a = payloads.select("symbol", F.explode(F.col("p.articles")).alias("a")) if "p" in payloads.columns else payloads.select("symbol", F.explode(F.from_json("payload", _NEWSAPI)["articles"]).alias("a"))
    rows = _news(
        a, symbol=clean.symbol(F.col("symbol")), article_id=clean.synthetic_id(F.col("a.url"), F.col("a.title")), datetime=clean.utc(F.col("a.publishedAt")),
        headline=F.col("a.title"), summary=F.col("a.description"), source=F.col("a.source.name"), url=F.col("a.url"), author=F.col("a.author"),
        image=F.col("a.urlToImage"), content_snippet=F.substring(F.coalesce("a.content", F.lit("")), 1, CONTENT_LIMIT),
    )
    return rows.orderBy(F.col("datetime").asc_nulls_last())


def alpaca_payload_bars(payloads: DataFrame) -> DataFrame:
    """symbol, payload {"bars": [{t,o,h,l,c,v,n,vw}]} -> price rows."""
    b = payloads.select("symbol", F.explode(F.from_json("payload", "bars array<struct<t:string,o:double,h:double,l:double,c:double,v:double,n:bigint,vw:double>>")["bars"]).alias("b"))
    return b.select(F.upper("symbol").alias("symbol"), clean.utc(F.col("b.t")).alias("timestamp"), F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").alias("volume"), F.col("b.n").alias("trade_count"), F.col("b.vw").alias("vwap"))


def yahoo_payload_bars(payloads: DataFrame, adjust: bool = False) -> DataFrame:
    """symbol, payload (chart response) -> price rows with dividends and splits (zero where there are none). adjust: prices
    times adjusted close over close."""
    spec = (
        "chart struct<result:array<struct<timestamp:array<bigint>,events:struct<dividends:map<string,struct<amount:double>>,splits:map<string,struct<numerator:double,denominator:double>>>,"
        "indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>,adjclose:array<struct<adjclose:array<double>>>>>>>"
    )
    r = payloads.select("symbol", F.from_json("payload", spec)["chart"]["result"][0].alias("r"))
    r = r.select("symbol", F.col("r.timestamp").alias("timestamp"), F.col("r.indicators.quote")[0].alias("q"), F.col("r.indicators.adjclose")[0]["adjclose"].alias("adjclose"), F.col("r.events").alias("e"))
    z = r.select("symbol", "e", F.explode(F.arrays_zip("timestamp", *(F.coalesce(c, F.array().cast("array<double>")).alias(c.split(".")[-1]) for c in ("q.open", "q.high", "q.low", "q.close", "q.volume", "adjclose")))).alias("z"))
    at = F.col("z")["timestamp"].cast("string")
    split = F.col("e.splits")[at]
    factor = F.coalesce(F.try_divide(F.col("z")["adjclose"], F.col("z")["close"]), F.lit(1.0)) if adjust else F.lit(1.0)
    return z.select(
        F.upper("symbol").alias("symbol"), clean.from_epoch_seconds(F.col("z")["timestamp"]).alias("timestamp"), *((F.col("z")[c] * factor).alias(c) for c in ("open", "high", "low", "close")), F.col("z")["volume"].alias("volume"),
        F.coalesce(F.col("e.dividends")[at]["amount"], F.lit(0.0)).alias("dividends"), F.coalesce(F.try_divide(split["numerator"], split["denominator"]), F.lit(0.0)).alias("stock splits"),
    )


def json_error(payload: Column) -> Column:
    """The message of an error response, null if it is none."""
    return F.coalesce(F.get_json_object(payload, "$['Error Message']"), F.when(F.get_json_object(payload, "$.status") == "error", F.get_json_object(payload, "$.message")))


def checked(payload: Column) -> Column:
    """The payload; an error response raises."""
    return F.when(json_error(payload).isNotNull(), F.raise_error(json_error(payload)).cast("string")).otherwise(payload)


def json_records(spark: SparkSession, payloads: DataFrame) -> DataFrame:
    """A list gives its rows, an object one row, anything else none; the columns are taken from the payloads."""
    p = F.trim("payload")
    one = payloads.where("payload is not null").select(F.when(p.startswith("["), F.from_json(p, "array<string>")).when(p.startswith("{"), F.array(p)).alias("a")).select(F.explode("a").alias("value"))
    lines = cut_text(one.select(F.regexp_replace("value", r"[\r\n]", " ")), "records")  # a line break stands between fields only
    return spark.read.json(lines) if not one.isEmpty() else spark.createDataFrame([], "symbol string")
