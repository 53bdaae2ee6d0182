"""The stored tables: keyed writes over Parquet, and the reads the features need.

A table is a folder of whole snapshots and later deltas; a read takes the newest finished snapshot and the finished
deltas after it, so a write that dies leaves nothing half done. There is one writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import clean
from newsloom.runtime import cut
from newsloom.schemas import ARTICLES, BARS, KEYS, TABLES


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- layout -----------------------------------------------------------------------------------------------
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _parts(self, name: str) -> list[tuple[int, str]]:
        """(number, kind) of the finished parts in order."""
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        found = []
        for status in fs.listStatus(p):
            kind, _, n = status.getPath().getName().partition("-")
            if kind in ("snapshot", "delta") and fs.exists(self._fs(f"{status.getPath()}/_SUCCESS")[1]):
                found.append((int(n), kind))
        return sorted(found)

    def _write(self, df: DataFrame, name: str, kind: str) -> None:
        parts = self._parts(name)
        n = parts[-1][0] + 1 if parts else 0
        df.select(*TABLES[name].fieldNames()).write.mode("overwrite").parquet(f"{self.root}/{name}/{kind}-{n:08d}")

    def init_schema(self) -> None:
        """Create the tables that are missing; nothing happens to those that are there."""
        for name, schema in TABLES.items():
            if not self._parts(name):
                self._write(self.spark.createDataFrame([], schema), name, "snapshot")

    def schema_version(self) -> int:
        """1 if all tables exist, else 0."""
        return int(all(self._parts(name) for name in TABLES))

    def tables(self) -> list[str]:
        return [name for name in sorted(TABLES) if self._parts(name)]

    def names(self, unlike: str | None = None) -> DataFrame:
        """Names of the tables that exist, those like the SQL pattern left out."""
        found = self.spark.createDataFrame([(n,) for n in self.tables()], "name string")
        return found if unlike is None else found.where(~F.col("name").like(unlike))

    def columns(self, name: str) -> DataFrame:
        """name, type, not_null, key position (0: none) of the columns of a table."""
        rows = [(f.name, f.dataType.simpleString(), not f.nullable, KEYS[name].index(f.name) + 1 if f.name in KEYS[name] else 0) for f in TABLES[name]]
        return self.spark.createDataFrame(rows, "name string, type string, not_null boolean, key_position int")

    def sample_json(self, name: str, n: int = 2) -> list[str]:
        """A few rows of a table as JSON texts, to look at."""
        return [r.value for r in self.read(name).limit(n).select(F.to_json(F.struct("*")).alias("value")).collect()]

    def read(self, name: str) -> DataFrame:
        parts = self._parts(name)
        since = max((n for n, kind in parts if kind == "snapshot"), default=0)
        paths = [f"{self.root}/{name}/{kind}-{n:08d}" for n, kind in parts if n >= since]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    # -- writes -----------------------------------------------------------------------------------------------
    def insert_or_ignore(self, name: str, rows: DataFrame) -> int:
        """Append the rows whose key is new, the first of each key; rows with a null where none may be are skipped.
        Returns how many were added."""
        fresh = cut(new_rows(self.read(name), rows, name), f"new-{name}")
        n = fresh.count()
        if n:
            self._write(fresh, name, "delta")
        return n

    def upsert_articles(self, news: DataFrame, source_api: str) -> int:
        return self.insert_or_ignore("articles", article_rows(news, source_api))

    def upsert_bars(self, bars: DataFrame, source_api: str, bar_interval: str) -> int:
        return self.insert_or_ignore("bars", bar_rows(bars, source_api, bar_interval))

    def upsert_article_sentiment(self, rows: DataFrame) -> int:
        """Insert or replace by (dedupe_key, model_id), the last of each key; scored_at becomes now. Returns the number
        of keys written. A key without an article raises."""
        last = cut(last_rows(rows.withColumn("scored_at", clean.now())), "scored")
        orphan = foreign_key_violations(last, self.read("articles"))
        if not orphan.isEmpty():
            raise ValueError("sentiment rows without an article: " + ", ".join(r[0] for r in orphan.limit(5).collect()))
        n = last.count()
        if n:
            self._write(merged(self.read("article_sentiment"), last), "article_sentiment", "snapshot")
        return n


def _arrival(df: DataFrame) -> tuple[DataFrame, str]:
    """Rows with the column of their arrival: `_seq` if given, else the order in which Spark reads them."""
    return (df, "_seq") if "_seq" in df.columns else (df.withColumn("_seq", F.monotonically_increasing_id()), "_seq")


def new_rows(target: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """The rows an insert-or-ignore adds."""
    schema, key = TABLES[name], KEYS[name]
    rows, seq = _arrival(rows)
    whole = rows.where(" and ".join(f"{f.name} is not null" for f in schema if not f.nullable))
    first = whole.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(seq))).where("_nth = 1")
    return first.join(target.select(*key), key, "left_anti").select(*schema.fieldNames())


def last_rows(rows: DataFrame) -> DataFrame:
    """The last row of each sentiment key by arrival."""
    rows, seq = _arrival(rows)
    key, schema = KEYS["article_sentiment"], TABLES["article_sentiment"]
    last = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(seq).desc()))).where("_nth = 1")
    return last.select(*((clean.number(F.col(f.name)) if f.dataType.typeName() == "double" else F.col(f.name).cast(f.dataType)).alias(f.name) for f in schema))


def merged(target: DataFrame, rows: DataFrame) -> DataFrame:
    """target with the rows replaced or added by key."""
    return target.join(rows.select(*KEYS["article_sentiment"]), KEYS["article_sentiment"], "left_anti").unionByName(rows)


def foreign_key_violations(child: DataFrame, parent: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """The keys of child rows without a parent; a null key refers to nothing."""
    return child.select(key).where(F.col(key).isNotNull()).distinct().join(parent.select(key), key, "left_anti")


def _optional(df: DataFrame, *names: str) -> Column:
    """The first of several columns that a frame has, or null."""
    have = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def article_rows(news: DataFrame, source_api: str) -> DataFrame:
    """Rows of the articles table from a vendor-normalised news frame; any column of it may be missing."""
    get = lambda *names: _optional(news, *names).cast("string")
    published = F.coalesce(clean.utc(_optional(news, "datetime", "published_at")), F.lit(clean.EPOCH).cast("timestamp_ntz"))
    known = {
        "dedupe_key": clean.dedupe_key(F.lit(source_api), get("article_id"), get("url"), published, get("headline")),
        "source_api": clean.vendor(F.lit(source_api)),
        "symbol": F.upper(get("symbol")),
        "external_article_id": F.when(~clean.is_blank(get("article_id")), clean.strip(get("article_id"))),
        "published_at": published,
        "source_name": get("source", "source_name"),
        "image_url": get("image", "image_url"),
        "ingested_at": clean.now(),
    }
    extra = ["_seq"] if "_seq" in news.columns else []
    return news.select(*(known.get(f, get(f)).alias(f) for f in ARTICLES.fieldNames()), *extra)


def bar_rows(bars: DataFrame, source_api: str, bar_interval: str) -> DataFrame:
    """Rows of the bars table from a normalised price frame. Columns symbol and timestamp must be there and filled."""
    if missing := [c for c in ("symbol", "timestamp") if c not in bars.columns]:
        raise ValueError(f"bars without column {', '.join(missing)}")
    ts = clean.utc(F.col("timestamp"))
    required = lambda c, what: F.when(c.isNull(), F.raise_error(f"bar without {what}").cast(dict(s="string", t="timestamp_ntz")["s" if what == "symbol" else "t"])).otherwise(c)
    known = {
        "source_api": clean.vendor(F.lit(source_api)),
        "symbol": required(F.upper(F.col("symbol")), "symbol"),
        "bar_interval": clean.vendor(F.lit(bar_interval)),
        "bar_ts": required(ts, "timestamp"),
        "trade_count": clean.whole_number(_optional(bars, "trade_count")),
        "stock_splits": clean.number(_optional(bars, "stock splits", "stock_splits")),
        "ingested_at": clean.now(),
    }
    extra = ["_seq"] if "_seq" in bars.columns else []
    return bars.select(*(known.get(f, clean.number(_optional(bars, f))).alias(f) for f in BARS.fieldNames()), *extra)


# -- reads ----------------------------------------------------------------------------------------------------
def _between(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Both ends included; a bare date means its midnight."""
    if start:
        df = df.where(F.col(column) >= clean.utc(F.lit(start)))
    if end:
        df = df.where(F.col(column) <= clean.utc(F.lit(end)))
    return df


def articles_frame(articles: DataFrame, symbol: str | None = None, source_api: str | None = None, limit: int | None = None) -> DataFrame:
    if symbol:
        articles = articles.where(F.col("symbol") == symbol.upper())
    if source_api:
        articles = articles.where(F.col("source_api") == source_api.strip().lower())
    return articles if limit is None else articles.limit(limit)


def bars_frame(bars: DataFrame, symbol: str | None = None, bar_interval: str | None = None, source_api: str | None = None, limit: int | None = None) -> DataFrame:
    for column, value in (("symbol", symbol and symbol.upper()), ("bar_interval", bar_interval and bar_interval.strip().lower()), ("source_api", source_api and source_api.strip().lower())):
        if value:
            bars = bars.where(F.col(column) == value)
    ordered = bars.orderBy("bar_ts", "symbol", "source_api", "bar_interval")
    return ordered if limit is None else ordered.limit(limit)


def bars_of_symbols(bars: DataFrame, symbols: Sequence[str], bar_interval: str = "1d", source_api: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """No symbols give no rows."""
    wanted = clean.symbol_list(symbols)
    rows = bars.where(F.col("symbol").isin(wanted) if wanted else F.lit(False)).where(F.col("bar_interval") == bar_interval.strip().lower())
    if source_api:
        rows = rows.where(F.col("source_api") == source_api.strip().lower())
    return _between(rows, "bar_ts", start, end).orderBy("symbol", "bar_ts", "source_api")


def latest_bars(bars: DataFrame, n: int = 10) -> DataFrame:
    return bars.orderBy(F.desc("bar_ts"), "symbol", "source_api", "bar_interval").limit(n)


def _of_symbols(df: DataFrame, symbols: Sequence[str] | None) -> DataFrame:
    """No symbols, or only blank ones, leave the frame as it is."""
    wanted = clean.symbol_list(symbols)
    return df.where(F.col("symbol").isin(wanted)) if wanted else df


def _oldest(df: DataFrame, limit: int | None) -> DataFrame:
    ordered = df.orderBy("published_at", "dedupe_key")
    return ordered if limit is None else ordered.limit(limit)


def articles_to_score(articles: DataFrame, sentiment: DataFrame, model_id: str, symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None, only_missing: bool = True, limit: int | None = None) -> DataFrame:
    """Articles without a row of the model (a failed scoring is a row), oldest first."""
    rows = articles.select("dedupe_key", "source_api", "symbol", "published_at", "headline", "summary")
    if only_missing:
        rows = rows.join(sentiment.where(F.col("model_id") == model_id).select("dedupe_key"), "dedupe_key", "left_anti")
    return _oldest(_between(_of_symbols(rows, symbols), "published_at", start, end), limit)


def scored_articles(articles: DataFrame, sentiment: DataFrame, model_id: str, symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Sentiment of a model with source, symbol and time of the article; unordered."""
    side = articles.select("dedupe_key", "source_api", "symbol", "published_at")
    return _between(_of_symbols(sentiment.where(F.col("model_id") == model_id).join(side, "dedupe_key"), symbols), "published_at", start, end)


def article_sentiment_frame(articles: DataFrame, sentiment: DataFrame, model_id: str, symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    return _oldest(scored_articles(articles, sentiment, model_id, symbols, start, end), limit)
