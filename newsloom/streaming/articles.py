"""Articles as a stream: repeated keys dropped within a watermark, sessions assigned, batches written once each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions import calendar
from newsloom.operators.store import Store


def deduplicated(articles: DataFrame, late: str = "7 days") -> DataFrame:
    """The first delivery of each key among those that arrive within `late` of each other."""
    timed = articles.withColumn("_at", F.col("ingested_at").cast("timestamp")).withWatermark("_at", late)
    return timed.dropDuplicatesWithinWatermark(["dedupe_key"]).drop("_at")


def with_sessions(articles: DataFrame) -> DataFrame:
    """Target session of every article; needs no state."""
    return calendar.with_target_session(articles, "published_at")


def into_store(articles: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Insert or ignore every micro-batch; a batch that is run again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        store.insert_or_ignore("articles", batch)

    return articles.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
