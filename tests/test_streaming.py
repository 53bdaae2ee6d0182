from newsloom.operators.store import Store
from newsloom.runtime import table
from newsloom.streaming import articles as stream


def test_stream_into_store(spark, sf_dir, tmp_path):
    rows = table(spark, sf_dir, "articles")
    rows.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    store.init_schema()
    stream.into_store(stream.deduplicated(src, "400 days"), store, str(tmp_path / "state")).awaitTermination()
    want = rows.select("dedupe_key").distinct().count()
    assert store.read("articles").count() == want
    stream.into_store(stream.deduplicated(src, "400 days"), store, str(tmp_path / "state2")).awaitTermination()
    assert store.read("articles").count() == want
