"""Settings of an ingest run, from a YAML file or from arguments."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from newsloom.functions.clean import source_flags, symbol_list

SOURCES = ("finnhub", "newsapi", "yfinance", "alpaca")


@dataclass(frozen=True)
class IngestConfig:
    symbols: list[str]
    start: str
    end: str
    bar_interval: str = "1d"
    sources: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(SOURCES, True))
    newsapi_extra_query: str | None = None
    newsapi_page_size: int = 100
    newsapi_max_pages: int = 1
    alpaca_feed: str | None = None
    landing: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "newsapi_page_size", max(1, min(100, int(self.newsapi_page_size))))
        object.__setattr__(self, "newsapi_max_pages", max(1, int(self.newsapi_max_pages)))


@dataclass
class IngestSummary:
    """Rows added per source, and what went wrong."""

    added: dict[str, int] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def from_mapping(raw: dict[str, Any]) -> IngestConfig:
    known = {f.name for f in fields(IngestConfig)}
    given = {k: v for k, v in raw.items() if k in known and v is not None}
    given["symbols"] = symbol_list(raw.get("symbols"))
    for k in ("start", "end"):
        if not raw.get(k):
            raise ValueError(f"{k} is missing")
        given[k] = str(raw[k])[:10]
    if not given["symbols"]:
        raise ValueError("symbols are missing")
    listed = raw.get("sources")
    given["sources"] = source_flags(",".join(map(str, listed)) if isinstance(listed, list) else listed, SOURCES)[0]
    return IngestConfig(**given)


def load_yaml(path: str) -> IngestConfig:
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not isinstance(raw, dict):
        raise ValueError("the file must hold a mapping")
    return from_mapping(raw)


def load_env(path: str = ".env") -> None:
    """Settings of a .env file (NAME=value lines) into the environment; what is set there already stays."""
    if not Path(path).is_file():
        return
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, is_setting, value = line.strip().removeprefix("export ").partition("=")
        if is_setting and name.strip().isidentifier():
            os.environ.setdefault(name.strip(), value.strip().strip("'\""))


def data_dir(given: str | None = None) -> str:
    return given or os.environ.get("NEWSLOOM_DATA_DIR") or "./data_store"
