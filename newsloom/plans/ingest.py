"""The ingest run: news, then bars, source by source; a source or symbol that fails is recorded and the rest goes on."""

from __future__ import annotations

from datetime import date, timedelta

from newsloom.functions.clean import INTERVALS
from newsloom.operators.store import Store
from newsloom.runtime import cut
from newsloom.sources import normalize
from newsloom.sources.config import SOURCES, IngestConfig, IngestSummary
from newsloom.sources.vendors import Vendor

#: What each source delivers.
NEWS_SOURCES, BAR_SOURCES = ("finnhub", "newsapi"), ("yfinance", "alpaca")


def day_after(day: str) -> str:
    """The exclusive end for a day that is to be included."""
    return (date.fromisoformat(day[:10]) + timedelta(1)).isoformat()


def run(store: Store, config: IngestConfig) -> IngestSummary:
    store.init_schema()
    summary = IngestSummary()
    for source in SOURCES:
        if not config.sources.get(source):
            continue
        if source == "alpaca" and config.bar_interval not in INTERVALS:
            summary.errors.append(f"{source}: interval {config.bar_interval!r} is not supported")
            continue
        vendor = Vendor(store.spark, source, {"landing": config.landing} if config.landing else {})
        options = {"start": config.start, "end": config.end if source in NEWS_SOURCES else day_after(config.end)}
        if source == "newsapi":
            options |= {"extra": config.newsapi_extra_query, "page_size": config.newsapi_page_size, "max_pages": config.newsapi_max_pages}
        elif source in BAR_SOURCES:
            options |= {"interval": config.bar_interval, "feed": config.alpaca_feed if source == "alpaca" else None}
        try:
            got = cut(vendor.payloads(config.symbols, what="news" if source in NEWS_SOURCES else "bars", **options), f"landed-{source}")
            summary.errors += [f"{source} {r.symbol}: {r.error}" for r in got.where("error is not null").select("symbol", "error").collect()]  # at most a row a symbol
            rows = got.where("payload is not null")
            if source in NEWS_SOURCES:
                n = store.upsert_articles((normalize.finnhub_news if source == "finnhub" else normalize.newsapi_news)(rows), source)
            else:
                n = store.upsert_bars((normalize.alpaca_payload_bars if source == "alpaca" else normalize.yahoo_payload_bars)(rows), source, config.bar_interval)
            summary.added[source] = n
            if not n:
                summary.warnings.append(f"{source}: nothing new")
        except Exception as e:  # noqa: BLE001 - the other sources go on
            summary.errors.append(f"{source}: {type(e).__name__}: {e}"[:500])
    return summary
