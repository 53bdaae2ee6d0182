import json
from datetime import datetime
from urllib.parse import parse_qsl, urlsplit

import pytest

from newsloom import cli
from newsloom.operators.store import Store
from newsloom.plans import ingest
from newsloom.sources import config, normalize, vendors


def payloads(spark, *bodies, symbol="aapl"):
    return spark.createDataFrame([(symbol, json.dumps(b) if not isinstance(b, str) else b) for b in bodies], "symbol string, payload string")


def test_finnhub_records(spark):
    body = [{"id": 7, "datetime": 1718448000, "headline": "h", "summary": "s", "source": "x", "url": "u", "category": "c", "image": "i", "related": "AAPL"}, {"id": 8, "datetime": "bad", "headline": "g"}]
    a, b = normalize.finnhub_news(payloads(spark, body)).collect()
    assert (a.symbol, a.article_id, a.datetime, a.image) == ("AAPL", "7", datetime(2024, 6, 15, 10, 40), "i") and b.datetime is None


def test_newsapi_articles(spark):
    body = {"status": "ok", "totalResults": 2, "articles": [{"title": "t", "description": "d", "publishedAt": "2024-06-15T14:00:00Z", "url": "u", "source": {"name": "n"}, "content": "c" * 3000}, {"title": "x", "content": None}]}
    a, b = normalize.newsapi_news(payloads(spark, body)).collect()
    assert (a.source, a.datetime, len(a.content_snippet), len(a.article_id)) == ("n", datetime(2024, 6, 15, 14), 2000, 32) and b.content_snippet == "" and b.datetime is None


def test_prices(spark):
    raw = spark.createDataFrame([("2024-06-17", 1.0, 2.0), ("2024-06-14", 3.0, 4.0)], "Date string, Open double, Close double")
    assert normalize.yahoo_bars(raw, symbol=" aapl").columns == ["timestamp", "open", "close", "symbol"]
    al = normalize.alpaca_bars(raw.withColumnRenamed("Date", "Timestamp"), "aapl").collect()
    assert [r.timestamp for r in al] == [datetime(2024, 6, 14), datetime(2024, 6, 17)] and al[0].symbol == "AAPL"
    chart = {"chart": {"result": [{"timestamp": [1718371800], "indicators": {"quote": [{"open": [1.0], "high": [2.0], "low": [0.5], "close": [None], "volume": [5]}]}}]}}
    y = normalize.yahoo_payload_bars(payloads(spark, chart)).first()
    assert (y.timestamp, y.open, y.close, y.volume) == (datetime(2024, 6, 14, 13, 30), 1.0, None, 5.0)


def test_json_answers(spark):
    assert [r.symbol for r in normalize.json_records(spark, payloads(spark, [{"symbol": "A", "companyName": "x"}, {"symbol": "B"}]).select("payload")).collect()] == ["A", "B"]
    assert normalize.json_records(spark, payloads(spark, {"symbol": "A"}).select("payload")).count() == 1
    assert normalize.json_records(spark, payloads(spark, "5").select("payload")).count() == 0
    with pytest.raises(vendors.VendorError, match="limit"):
        vendors.checked_payload('{"Error Message": "limit"}')
    assert payloads(spark, {"Error Message": "no"}).select(normalize.json_error(normalize.F.col("payload"))).first()[0] == "no"


def test_pages():
    def fetch(bodies):
        asked = []
        return asked, lambda page, size: (asked.append((page, size)), json.dumps(bodies[page - 1]))[1]

    page = lambda n, total: {"status": "ok", "totalResults": total, "articles": [{}] * n}
    asked, f = fetch([page(100, 250), page(100, 250), page(50, 250)])
    assert len(list(vendors.search_pages(f, 500))) == 3 and asked == [(1, 100), (2, 100), (3, 100)]
    _, f = fetch([page(100, 900), {"status": "error", "code": "maximumResultsReached"}])
    assert len(list(vendors.search_pages(f))) == 1
    _, f = fetch([{"status": "error", "code": "apiKeyInvalid", "message": "m"}])
    with pytest.raises(vendors.VendorError, match="apiKeyInvalid"):
        list(vendors.search_pages(f))
    assert vendors.with_query("u?a=1", b="x y", c=None) == "u?a=1&b=x+y" and vendors.with_query("u", b=1) == "u?b=1"
    assert vendors.timeframe("60m") == vendors.timeframe("1h") == (1, "hour")
    with pytest.raises(ValueError):
        vendors.timeframe("7q")


def test_yaml(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("symbols: 'aapl, msft'\nstart: 2024-06-01\nend: 2024-06-20T00:00\nsources: [finnhub, other]\nnewsapi_page_size: 900\nnewsapi_max_pages: 0\n")
    c = config.load_yaml(str(p))
    assert c.symbols == ["AAPL", "MSFT"] and c.end == "2024-06-20" and [k for k, on in c.sources.items() if on] == ["finnhub"] and (c.newsapi_page_size, c.newsapi_max_pages) == (100, 1)
    with pytest.raises(ValueError):
        config.from_mapping({"symbols": [], "start": "2024-01-01", "end": "2024-01-02"})
    assert ingest.day_after("2024-02-28") == "2024-02-29"


def land(root):
    def put(vendor, name, body):
        (root / vendor).mkdir(parents=True, exist_ok=True)
        (root / vendor / f"{name}.json").write_text(json.dumps(body))

    put("finnhub", "AAPL", [{"id": n, "datetime": 1719950400 + 3600 * n, "headline": "gained strong" if n % 2 else "loss", "summary": "s"} for n in range(6)])
    put("finnhub", "MSFT", {"Error Message": "limit"})
    put("alpaca", "AAPL", {"bars": [{"t": f"2024-07-0{d}T04:00:00Z", "o": 100.0, "h": 1, "l": 1, "c": 100.0 + d, "v": 5, "n": 1, "vw": 1} for d in (1, 2, 3, 5, 8, 9)]})


def test_whole_run(spark, tmp_path, capsys):
    land(tmp_path / "land")
    base = ["--data-dir", str(tmp_path / "data"), "--symbols", "aapl"]
    go = lambda *a: cli.main([*base, *a], spark)
    assert go("ingest", "--start", "2024-07-01", "--end", "2024-07-10", "--sources", "finnhub,alpaca", "--landing", str(tmp_path / "land")) == 0
    assert go("score") == 0 and go("score") == 0
    store = Store(spark, str(tmp_path / "data"))
    assert store.read("article_sentiment").count() == 6 and store.read("bars").count() == 6
    assert go("features", "--output", str(tmp_path / "f.csv")) == 0 and spark.read.csv(str(tmp_path / "f.csv"), header=True).count() == 6
    assert go("train", "--model-path", str(tmp_path / "m"), "--rounds", "2") == 0 and "mae" in capsys.readouterr().out
    assert go("predict", "--model-path", str(tmp_path / "m")) == 0
    assert go("predict", "--model-path", str(tmp_path / "m"), "--session", "1999-01-04") == 1
    assert go("nonsense") == 1 and go("ingest") == 1
    assert cli.main(["--data-dir", str(tmp_path / "data"), "--symbols", "aapl,msft", "ingest", "--start", "2024-07-01", "--end", "2024-07-10", "--sources", "finnhub", "--landing", str(tmp_path / "land")], spark) == 2


def test_alpaca_reads_all_pages(monkeypatch):
    answers = {None: {"bars": [{"t": 1}], "next_page_token": "a=="}, "a==": {"bars": [{"t": 2}], "next_page_token": "b"}, "b": {"bars": [{"t": 3}], "next_page_token": None}}
    asked = []

    def get(url, headers=None, timeout_s=0):
        asked.append(dict(parse_qsl(urlsplit(url).query)))
        return json.dumps(answers[asked[-1].get("page_token")])

    monkeypatch.setattr(vendors, "get", get)
    request = vendors.Request("alpaca", "bars", "2024-06-03", "2024-07-03", {"interval": "1m", "api_key": "k", "secret_key": "s"})
    assert [json.loads(t)["bars"][0]["t"] for t in vendors.pages(request, "AAPL")] == [1, 2, 3]
    assert [a.get("page_token") for a in asked] == [None, "a==", "b"] and {(a["start"], a["end"], a["timeframe"]) for a in asked} == {("2024-06-03", "2024-07-03", "1Min")}
    answers["b"]["next_page_token"] = "a=="
    with pytest.raises(vendors.VendorError):
        list(vendors.pages(request, "AAPL"))


@pytest.mark.parametrize(
    ("start", "end", "want"),
    [
        ("2024-06-03", "2024-06-15", {"period1": "1717372800", "period2": "1718409600"}),
        ("2024-06-03T02:00:00+02:00", "2024-06-15T00:00:00Z", {"period1": "1717372800", "period2": "1718409600"}),
        ("2024-06-03", None, {"period1": "1717372800", "period2": "1800000000"}),
        (None, "2024-06-15", {"period1": "-2208988800", "period2": "1718409600"}),
        (None, None, {"range": "1mo"}),
    ],
)
def test_yfinance_asks_for_the_dates(monkeypatch, start, end, want):
    asked = []
    monkeypatch.setattr(vendors, "get", lambda url, *_: asked.append(dict(parse_qsl(urlsplit(url).query))) or "{}")
    monkeypatch.setattr(vendors.time, "time", lambda: 1_800_000_000.5)
    assert list(vendors.pages(vendors.Request("yfinance", "bars", start, end), "AAPL")) == ["{}"] and asked == [{"interval": "1d", "events": "div,splits"} | want]


@pytest.mark.parametrize(("vendor", "what", "names"), [("finnhub", "news", "FINNHUB_API_KEY"), ("newsapi", "headlines", "NEWSAPI_API_KEY"), ("fmp", "profile", "FMP_API_KEY"), ("alpaca", "bars", "APCA_API_KEY_ID")])
def test_a_missing_key_raises_before_anything_is_asked(monkeypatch, vendor, what, names):
    for names_ in vendors.KEY_VARIABLES.values():
        for n in names_:
            monkeypatch.delenv(n, raising=False)
    monkeypatch.setattr(vendors, "get", lambda *_: pytest.fail("asked"))
    with pytest.raises(vendors.VendorError, match=names):
        list(vendors.pages(vendors.Request(vendor, what), "AAPL"))


def test_a_missing_secret_raises(monkeypatch):
    for n in vendors.SECRET_VARIABLES:
        monkeypatch.delenv(n, raising=False)
    with pytest.raises(vendors.VendorError, match="APCA_API_SECRET_KEY"):
        list(vendors.pages(vendors.Request("alpaca", "bars", options={"api_key": "k"}), "AAPL"))


def test_headlines_clamp_and_bad_answers(spark, tmp_path, monkeypatch):
    asked = []
    monkeypatch.setattr(vendors, "get", lambda url, *_: asked.append(dict(parse_qsl(urlsplit(url).query))) or "{}")
    for size, want in (("500", "100"), ("0", "1"), ("7", "7")):
        list(vendors.pages(vendors.Request("newsapi", "headlines", options={"api_key": "k", "page_size": size}), "TOP"))
        assert asked[-1]["pageSize"] == want and asked[-1]["country"] == "us"
    root = tmp_path / "newsapi"
    root.mkdir()
    v = vendors.Vendor(spark, "newsapi", {"landing": str(tmp_path)})
    (root / "TOP.json").write_text(json.dumps({"status": "error", "code": "x", "message": "m"}))
    assert v.headlines().count() == 0
    (root / "TOP.json").write_text(json.dumps({"status": "ok", "articles": [{"title": "t", "url": "u", "publishedAt": "2024-07-01T00:00:00Z", "source": {"name": "n"}}]}))
    assert [(r.headline, r.symbol) for r in v.headlines().collect()] == [("t", None)]


def test_yfinance_options(monkeypatch):
    asked = []
    monkeypatch.setattr(vendors, "get", lambda url, *_: asked.append(dict(parse_qsl(urlsplit(url).query))) or "{}")
    list(vendors.pages(vendors.Request("yfinance", "bars", options={"prepost": "true", "actions": "no"}), "AAPL"))
    assert asked == [{"interval": "1d", "range": "1mo", "includePrePost": "true"}]


def test_paper_account(monkeypatch):
    monkeypatch.delenv("ALPACA_PAPER", raising=False)
    assert vendors.paper_account() and not vendors.paper_account("no")
    monkeypatch.setenv("ALPACA_PAPER", "0")
    assert not vendors.paper_account()


def test_env_file(tmp_path, monkeypatch):
    from newsloom.sources import config

    monkeypatch.setenv("NEWSLOOM_GIVEN", "kept")
    monkeypatch.delenv("NEWSLOOM_NEW", raising=False)
    (tmp_path / ".env").write_text("# comment\nNEWSLOOM_GIVEN=other\nexport NEWSLOOM_NEW = 'a=b'\n\nnot a setting\n")
    config.load_env(str(tmp_path / ".env"))
    import os

    assert os.environ["NEWSLOOM_GIVEN"] == "kept" and os.environ.pop("NEWSLOOM_NEW") == "a=b"
    config.load_env(str(tmp_path / "none"))
