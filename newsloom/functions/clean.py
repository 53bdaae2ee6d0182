"""Column helpers: text, hashes, numbers and times with the results the stored tables rely on. None of them raises on bad
input unless its name says so; NaN never survives."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"
_BLANKS = r"^[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$"

#: Bar sizes by code (fixed values): amount and unit.
INTERVALS = {
    "1m": (1, "minute"), "5m": (5, "minute"), "15m": (15, "minute"), "30m": (30, "minute"), "60m": (1, "hour"),
    "1h": (1, "hour"), "1d": (1, "day"), "1wk": (1, "week"), "1w": (1, "week"), "1mo": (1, "month"),
}
#: Spellings of the three labels of a text classifier (fixed values).
LABELS = {"positive": "pos", "pos": "pos", "label_0": "pos", "negative": "neg", "neg": "neg", "label_1": "neg", "neutral": "neutral", "neu": "neutral", "label_2": "neutral"}


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, _BLANKS, "")


def is_blank(c: Column) -> Column:
    """Null, empty, white space, or the word nan in any case."""
    s = strip(c.cast("string"))
    return c.isNull() | (s == "") | (F.lower(s) == "nan")


def or_null(c: Column) -> Column:
    """The stripped text, null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def symbol(c: Column) -> Column:
    return F.nullif(F.upper(strip(c)), F.lit(""))


def vendor(c: Column) -> Column:
    return F.lower(strip(c))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 with offset +00:00; microseconds only where there are any."""
    t = ts.cast("timestamp_ntz")
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(F.date_format(t, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(t, "SSSSSS"))).otherwise(""), F.lit("+00:00"))


def dedupe_key(source: Column, article_id: Column, url: Column, published_at: Column, headline: Column) -> Column:
    """By id, else by url, else by time and the first 200 characters of the stripped headline (none if it is blank)."""
    when = F.coalesce(published_at.cast("timestamp_ntz"), F.lit(EPOCH).cast("timestamp_ntz"))
    fallback = F.concat_ws(":", F.lit("fallback"), iso_utc(when), F.when(is_blank(headline), "").otherwise(F.substring(strip(headline), 1, 200)))
    tail = F.when(~is_blank(article_id), F.concat(F.lit("id:"), strip(article_id))).when(~is_blank(url), F.concat(F.lit("url:"), strip(url))).otherwise(fallback)
    return F.concat(vendor(source), F.lit(":"), tail)


def synthetic_id(url: Column, title: Column) -> Column:
    """32 hex digits for an article without an id."""
    return F.substring(F.sha2(F.concat(F.coalesce(url, F.lit("")), F.lit("\n"), F.coalesce(title, F.lit(""))), 256), 1, 32)


def model_text(headline: Column, summary: Column) -> Column:
    """What a scorer reads: headline and summary, whichever there are; empty if neither."""
    return F.concat_ws(" ", or_null(headline), or_null(summary))


def text_hash(text: Column) -> Column:
    return F.when(text != "", F.sha2(text, 256))


def number(c: Column) -> Column:
    """As double; null for what is no number, NaN included."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def whole_number(c: Column) -> Column:
    d = number(c)
    return F.when(F.abs(d) < 9.2e18, d.try_cast("bigint"))


def utc(c: Column) -> Column:
    """Text or timestamp as UTC without zone; null if it cannot be read. Text without an offset counts as UTC."""
    text = c.cast("string")
    zone = F.regexp_extract(text, r"(?:Z|[+-]\d{2}:?\d{2})$", 0)
    bare = F.regexp_replace(F.regexp_replace(text, r"(?:Z|[+-]\d{2}:?\d{2})$", ""), "T", " ")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, r"[^\d]", "")
    minutes = F.when(F.length(digits) == 4, sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"))).otherwise(0)
    return F.timestamp_add("MINUTE", -minutes, bare.try_cast("timestamp_ntz"))


def now() -> Column:
    """The time of the query as UTC without zone; the same for all its rows."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())


def from_epoch_seconds(c: Column) -> Column:
    s = c.try_cast("bigint")
    return F.timestamp_add("SECOND", F.when(F.abs(s) < 250_000_000_000, s), F.lit(EPOCH).cast("timestamp_ntz"))


def polarity(pos: Column, neg: Column) -> Column:
    return pos - neg


def softmax(logits: Column) -> Column:
    """Of an array column; shifted by its maximum."""
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def label(c: Column) -> Column:
    """pos, neg or neutral of any known spelling."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), F.lower(strip(c)))


def truthy(c: Column) -> Column:
    return F.coalesce(vendor(c).isin("1", "true", "yes", "on"), F.lit(False))


def interval_amount(c: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, (n, _) in INTERVALS.items() for x in (k, n))), vendor(c))


def interval_unit(c: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, (_, u) in INTERVALS.items() for x in (k, u))), vendor(c))


def symbol_list(values: Iterable[str] | str | None) -> list[str]:
    """Symbols from a list or a comma-separated text: stripped, upper case, without empty ones, order and repeats kept."""
    if values is None:
        return []
    if isinstance(values, str):
        values = values.split(",")
    return [s for v in values if v is not None and (s := str(v).strip().upper())]


def source_flags(text: str | None, known: Iterable[str]) -> tuple[dict[str, bool], list[str]]:
    """Which sources a comma-separated list turns on (all if it is empty), and what in it is unknown."""
    known = list(known)
    named = [s.strip().lower() for s in (text or "").split(",") if s.strip()]
    return {k: not named or k in named for k in known}, [n for n in named if n not in known]
