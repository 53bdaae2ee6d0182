"""Reading vendors: a Spark data source with one partition per symbol, fed by the network or by a landing folder.

`spark.read.format("newsloom_vendor")` gives symbol, page, payload, error; a symbol that fails gives a row with its error and
does not stop the others. With the option `landing` the payloads are the files <landing>/<vendor>/<SYMBOL>*.json, which
is how the source runs without a network. Keys come from options or the environment.
"""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from newsloom.functions.clean import INTERVALS, symbol_list
from newsloom.runtime import ship
from newsloom.sources import normalize

TIMEOUT_S = 60
PAGE_LIMIT = 100
SCHEMA = "symbol string, page int, payload string, error string"
#: Public endpoints (fixed values).
BASES = {
    "finnhub": "https://finnhub.io/api/v1",
    "newsapi": "https://newsapi.org/v2",
    "alpaca": "https://data.alpaca.markets/v2/stocks",
    "yfinance": "https://query1.finance.yahoo.com/v8/finance/chart",
    "fmp": "https://financialmodelingprep.com/stable",
}
KEY_VARIABLES = {"finnhub": ["FINNHUB_API_KEY"], "newsapi": ["NEWSAPI_API_KEY"], "alpaca": ["APCA_API_KEY_ID", "ALPACA_API_KEY"], "fmp": ["FMP_API_KEY"], "yfinance": []}
SECRET_VARIABLES = ["APCA_API_SECRET_KEY", "ALPACA_SECRET_KEY"]
#: Bar sizes as one vendor spells them.
ALPACA_UNITS = {"minute": "Min", "hour": "Hour", "day": "Day", "week": "Week", "month": "Month"}
#: Where a request that names only its end starts: 1900-01-01, in seconds since 1970.
EARLIEST = -2_208_988_800


class VendorError(RuntimeError):
    """A vendor answered with an error."""


def credential(vendor: str, given: str | None = None) -> str | None:
    return given or next((v for k in KEY_VARIABLES[vendor] if (v := os.environ.get(k))), None)


def required_credential(vendor: str, given: str | None = None) -> str | None:
    """The key of a vendor that asks for one; without it, an error that names the variables."""
    key = credential(vendor, given)
    if key is None and KEY_VARIABLES[vendor]:
        raise VendorError(f"{vendor}: no key; set {' or '.join(KEY_VARIABLES[vendor])}")
    return key


def paper_account(given: str | None = None) -> bool:
    """Whether the account is one for practice: ALPACA_PAPER, yes unless it says otherwise."""
    text = given if given is not None else os.environ.get("ALPACA_PAPER", "true")
    return text.strip().lower() in ("1", "true", "yes", "on")


def timeframe(interval: str) -> tuple[int, str]:
    """Amount and unit of a bar size; an unknown code raises."""
    try:
        return INTERVALS[interval.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown interval {interval!r}; there are {', '.join(INTERVALS)}") from None


def epoch_seconds(time_: str | None) -> int | None:
    """UTC seconds since 1970 of an ISO date or time; one without a zone is UTC."""
    if not time_:
        return None
    t = datetime.fromisoformat(time_.strip())
    return int((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp())


def with_query(url: str, **query: object) -> str:
    """The url with parameters added to those it has; empty ones are left out."""
    text = urllib.parse.urlencode({k: v for k, v in query.items() if v not in (None, "")})
    return url if not text else f"{url}{'&' if '?' in url else '?'}{text}"


def get(url: str, headers: dict[str, str] | None = None, timeout_s: float = TIMEOUT_S) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "newsloom"} | (headers or {})), timeout=timeout_s) as r:  # noqa: S310
        return r.read().decode("utf-8")


def checked_payload(text: str) -> str:
    """The payload if it is JSON and no error message."""
    body = json.loads(text)
    if isinstance(body, dict) and "Error Message" in body:
        raise VendorError(str(body["Error Message"]))
    return text


def truthy(options: dict[str, str], name: str, default: bool = False) -> bool:
    given = options.get(name)
    return default if given is None else str(given).strip().lower() in ("1", "true", "yes", "on")


def search_pages(fetch: Callable[[int, int], str], page_size: int = PAGE_LIMIT, max_pages: int = 5) -> Iterator[str]:
    """Pages of a search until one is short, all results are there, or the limit of pages or of the plan is reached."""
    size, seen = max(1, min(page_size, PAGE_LIMIT)), 0
    for page in range(1, max(1, max_pages) + 1):
        text = fetch(page, size)
        body = json.loads(text)
        if body.get("status") != "ok":
            if body.get("code") == "maximumResultsReached":
                return
            raise VendorError(f"{body.get('code')}: {body.get('message')}")
        yield text
        found = len(body.get("articles") or [])
        seen += found
        if found < size or seen >= int(body.get("totalResults") or 0):
            return


def token_pages(fetch: Callable[[str | None], str]) -> Iterator[str]:
    """All pages of an answer that names the token of its next page; a token that comes again raises."""
    token, seen = None, set()
    while True:
        text = fetch(token)
        yield text
        body = json.loads(text)
        token = body.get("next_page_token") if isinstance(body, dict) else None
        if not token:
            return
        if token in seen:
            raise VendorError(f"page token {token!r} came twice")
        seen.add(token)


@dataclass(frozen=True)
class Request:
    """What to ask a vendor for. `what` picks among its endpoints (news, bars, quote, headlines, profile)."""

    vendor: str
    what: str
    start: str | None = None
    end: str | None = None
    options: dict[str, str] = field(default_factory=dict)


def pages(request: Request, symbol: str) -> Iterator[str]:
    """The payloads of one symbol."""
    o, base, key = request.options, request.options.get("base") or BASES[request.vendor], required_credential(request.vendor, request.options.get("api_key"))
    day = lambda s: s[:10] if s else None
    if request.vendor == "finnhub":
        if request.what == "quote":
            yield get(with_query(f"{base}/quote", symbol=symbol, token=key))
        else:
            yield get(with_query(f"{base}/company-news", symbol=symbol, **{"from": day(request.start), "to": day(request.end)}, token=key))
    elif request.vendor == "newsapi":
        header = {"X-Api-Key": key or ""}
        if request.what == "headlines":
            yield get(with_query(f"{base}/top-headlines", category=o.get("category"), country=o.get("country", "us"), q=o.get("q"), pageSize=max(1, min(PAGE_LIMIT, int(o.get("page_size", PAGE_LIMIT))))), header)
            return
        query = f"({symbol}) OR ({o['extra']})" if o.get("extra") else symbol
        ask = lambda page, size: get(with_query(f"{base}/everything", q=query, **{"from": day(request.start)}, to=day(request.end), language=o.get("language", "en"), sortBy=o.get("sort_by", "publishedAt"), pageSize=size, page=page), header)
        yield from search_pages(ask, int(o.get("page_size", PAGE_LIMIT)), int(o.get("max_pages", 5)))
    elif request.vendor == "alpaca":
        amount, unit = timeframe(o.get("interval", "1d"))
        secret = o.get("secret_key") or next((v for k in SECRET_VARIABLES if (v := os.environ.get(k))), None)
        if not secret:
            raise VendorError(f"alpaca: no secret; set {' or '.join(SECRET_VARIABLES)}")
        header = {"APCA-API-KEY-ID": key or "", "APCA-API-SECRET-KEY": secret}
        ask = lambda token: get(with_query(f"{base}/{symbol}/bars", timeframe=f"{amount}{ALPACA_UNITS[unit]}", start=request.start, end=request.end, feed=o.get("feed"), limit=10_000, page_token=token), header)
        yield from token_pages(ask)
    elif request.vendor == "yfinance":
        first, last = o.get("period1", epoch_seconds(request.start)), o.get("period2", epoch_seconds(request.end))
        if first is not None or last is not None:  # the endpoint takes both or none
            first, last = EARLIEST if first is None else first, int(time.time()) if last is None else last
        yield get(with_query(f"{base}/{symbol}", interval=o.get("interval", "1d"), period1=first, period2=last, range=o.get("period", "1mo") if first is None else None, includePrePost="true" if truthy(o, "prepost") else None, events="div,splits" if truthy(o, "actions", True) else None))
    else:
        yield checked_payload(get(with_query(f"{base}/{o.get('path', 'profile')}", symbol=symbol, apikey=key)))


class _Partition(InputPartition):
    def __init__(self, symbol: str):
        self.symbol = symbol


class VendorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [_Partition(s) for s in dict.fromkeys(symbol_list(self.options.get("symbols", "")))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o, symbol = self.options, partition.symbol
        vendor = o["vendor"]
        try:
            if o.get("landing"):
                texts = (p.read_text(encoding="utf-8") for p in sorted(Path(o["landing"], vendor).glob(f"{symbol}*.json")) if p.stem == symbol or p.stem.startswith(f"{symbol}."))
            else:
                texts = pages(Request(vendor, o.get("what", "news"), o.get("start"), o.get("end"), o), symbol)
            for n, text in enumerate(texts, 1):
                yield symbol, n, checked_payload(text), None
        except Exception as e:  # noqa: BLE001 - one symbol must not stop the others
            yield symbol, None, None, f"{type(e).__name__}: {e}"[:500]


class VendorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "newsloom_vendor"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return VendorReader(self.options)


@dataclass
class Vendor:
    """One vendor with default options; reads give canonical frames."""

    spark: SparkSession
    vendor: str
    options: dict[str, str] = field(default_factory=dict)

    def payloads(self, symbols: list[str] | str, **options: object) -> DataFrame:
        ship(self.spark)
        self.spark.dataSource.register(VendorSource)
        given = self.options | {k: str(v) for k, v in options.items() if v is not None}
        return self.spark.read.format("newsloom_vendor").options(vendor=self.vendor, symbols=",".join(symbol_list(symbols)), **given).load()

    def news(self, symbols: list[str] | str, **options: object) -> DataFrame:
        rows = self.payloads(symbols, what="news", **options).where("payload is not null")
        return normalize.finnhub_news(rows) if self.vendor == "finnhub" else normalize.newsapi_news(rows)

    def bars(self, symbols: list[str] | str, **options: object) -> DataFrame:
        rows = self.payloads(symbols, what="bars", **options).where("payload is not null")
        if self.vendor == "alpaca":
            return normalize.alpaca_payload_bars(rows)
        return normalize.yahoo_payload_bars(rows, adjust=truthy({k: str(v) for k, v in (self.options | options).items()}, "auto_adjust"))

    def headlines(self, **options: object) -> DataFrame:
        """Top headlines of a country or category; an answer that is not ok gives no rows."""
        return normalize.newsapi_news(self.payloads(["TOP"], what="headlines", **options).where("payload is not null").withColumn("symbol", F.lit(None).cast("string")))

    def quote(self, symbols: list[str] | str, **options: object) -> DataFrame:
        return self.payloads(symbols, what="quote", **options).select("symbol", "payload", "error")

    def profile(self, symbols: list[str] | str, **options: object) -> DataFrame:
        return normalize.json_records(self.spark, self.payloads(symbols, what="profile", **options).select("payload"))

    def errors(self, symbols: list[str] | str, **options: object) -> DataFrame:
        return self.payloads(symbols, **options).where(F.col("error").isNotNull()).select("symbol", "error")
