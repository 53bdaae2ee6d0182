"""Column layouts of the stored tables and of frames derived from them (timestamps hold UTC without a zone)."""

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "t": T.TimestampNTZType(), "d": T.DoubleType(), "b": T.LongType(), "D": T.DateType()}
    fields = []
    for item in spec.split():
        name, kind = item.split(":")
        fields.append(T.StructField(name, kinds[kind[0]], not kind.endswith("!")))
    return T.StructType(fields)


ARTICLES = _struct(
    "dedupe_key:s! source_api:s! symbol:s external_article_id:s published_at:t! headline:s summary:s source_name:s url:s author:s category:s related:s image_url:s content_snippet:s ingested_at:t!"
)
BARS = _struct("source_api:s! symbol:s! bar_interval:s! bar_ts:t! open:d high:d low:d close:d volume:d vwap:d trade_count:b dividends:d stock_splits:d ingested_at:t!")
ARTICLE_SENTIMENT = _struct("dedupe_key:s! model_id:s! score:d prob_pos:d prob_neg:d prob_neutral:d scored_at:t text_hash:s error:s")

TABLES = {"articles": ARTICLES, "bars": BARS, "article_sentiment": ARTICLE_SENTIMENT}
KEYS = {"articles": ["dedupe_key"], "bars": ["source_api", "symbol", "bar_interval", "bar_ts"], "article_sentiment": ["dedupe_key", "model_id"]}

NEWS = _struct("symbol:s article_id:s datetime:t headline:s summary:s source:s url:s author:s category:s related:s image:s content_snippet:s")
SENTIMENT_FEATURES = ("sentiment_mean", "sentiment_n", "sentiment_std")
