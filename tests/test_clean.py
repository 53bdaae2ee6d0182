from datetime import datetime

from pyspark.sql import functions as F

from newsloom.functions import clean


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_dedupe_key(spark):
    key = lambda id_, url, ts, head: one(spark, clean.dedupe_key(F.lit(" Finnhub"), F.col("i"), F.col("u"), clean.utc(F.col("t")), F.col("h")), i=id_, u=url, t=ts, h=head)
    assert key(" 42 ", "u", None, None) == "finnhub:id:42"
    assert key("nan", "https://news.example/x", None, None) == "finnhub:url:https://news.example/x"
    assert key(None, " ", "2024-06-15T14:00:00Z", "h" * 300) == "finnhub:fallback:2024-06-15T14:00:00+00:00:" + "h" * 200
    assert key(None, None, None, None) == "finnhub:fallback:1970-01-01T00:00:00+00:00:"
    assert key("NaN", None, "2024-06-15 14:00:00.5", "h") == "finnhub:fallback:2024-06-15T14:00:00.500000+00:00:h"


def test_times(spark):
    utc = lambda t: one(spark, clean.utc(F.col("t")), t=t)
    assert utc("2024-06-15T14:00:00Z") == utc("2024-06-15T10:00:00-04:00") == utc("2024-06-15 14:00:00") == utc("2024-06-15T19:30:00+0530") == datetime(2024, 6, 15, 14)
    assert utc("2024-06-15") == datetime(2024, 6, 15) and utc("soon") is None and utc(None) is None
    epoch = lambda t: one(spark, clean.from_epoch_seconds(F.col("t")), t=t)
    assert epoch("1718448000") == datetime(2024, 6, 15, 10, 40) and epoch("x") is None and epoch("99999999999999999") is None


def test_numbers_and_blanks(spark):
    assert [one(spark, clean.number(F.col("t")), t=t) for t in ("1.5", "NaN", "x", None)] == [1.5, None, None, None]
    assert [one(spark, clean.whole_number(F.col("t")), t=t) for t in ("7", "7.9", "1e30", "")] == [7, 7, None, None]
    assert [one(spark, clean.is_blank(F.col("t")), t=t) for t in (None, "", " \t ", "NaN", "x")] == [True, True, True, True, False]
    assert one(spark, clean.strip(F.col("t")), t="  a b\n　") == "a b"
    assert one(spark, clean.symbol(F.col("t")), t=" aapl ") == "AAPL" and one(spark, clean.symbol(F.col("t")), t="  ") is None
    assert [one(spark, clean.truthy(F.col("t")), t=t) for t in ("YES", " on ", "0", None)] == [True, True, False, False]


def test_text_and_hash(spark):
    text = lambda h, s: one(spark, clean.model_text(F.col("h"), F.col("s")), h=h, s=s)
    assert text(" a ", None) == "a" and text("a", " b ") == "a b" and text(None, "  ") == ""
    assert one(spark, clean.text_hash(F.col("h")), h="") is None and len(one(spark, clean.text_hash(F.col("h")), h="a")) == 64
    assert len(one(spark, clean.synthetic_id(F.col("h"), F.col("s")), h="u", s=None)) == 32


def test_softmax_and_labels(spark):
    got = spark.range(1).select(clean.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("x")).first().x
    assert got == [0.5, 0.5]
    assert [one(spark, clean.label(F.col("t")), t=t) for t in ("Positive", "LABEL_1", "neu", "what")] == ["pos", "neg", "neutral", None]


def test_lists():
    assert clean.symbol_list(["  aapl  ", "MSFT", "", None, "aapl"]) == ["AAPL", "MSFT", "AAPL"] and clean.symbol_list("a, b,,") == ["A", "B"] and clean.symbol_list(None) == []
    assert clean.source_flags("", ["a", "b"]) == ({"a": True, "b": True}, []) and clean.source_flags("B, c", ["a", "b"]) == ({"a": False, "b": True}, ["c"])
