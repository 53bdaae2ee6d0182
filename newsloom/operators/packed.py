"""Several values packed in one field: a parsing expression grammar that splits them.

    Field     <- Blank* (Listed / Values) Blank* End
    Listed    <- '[' Values ']'                      only if the brackets span the field
    Values    <- Item (Separator Item)*
    Item      <- Run / Quoted / Bracketed / Bare / Nothing in this order; the first that fits counts
    Run       <- Word (Blank+ Word)+ before a separator or the end; Word <- Open Ticker Close / Ticker
    Quoted    <- Open (Escape / !Close .)* Close     Close is the matching quote before a separator or the end
    Bracketed <- '[' Item ']'
    Bare      <- (!Separator .)+                     then cut at blanks if every piece is a ticker

An opening quote without a matching close makes Quoted fail; the parser goes back to the place of the quote and
takes the Bare alternative there, with the error flag `unclosed_quote`. What follows a place inside a quote depends only on
the place and the kind of quote, so places from which a close was sought in vain are remembered (packrat) and every field
takes time linear in its length. A quote left at the end of a bare value is
`stray_quote`, a bracket without partner is `stray_bracket`.

Defined results: a null, empty or blank field has no values; a null key keeps its values under the null key; empty
pieces take no position; repeated values keep their positions; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from newsloom.runtime import earliest, ship

#: Separators that stand alone, closing quotes by opening quote.
SEPARATORS = ",;|\t\r\n、，；·•"
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "„": "“", "«": "»"}

_SEP = re.compile(rf"[{re.escape(SEPARATORS)}]|(?<=\s)[-–—](?=\s)|/")
_BARE_END = re.compile(rf"[{re.escape(SEPARATORS)}]|\s[-–—](?=\s)|/")
_BLANK = re.compile(r"[^\S\t\r\n]*")
_TICKER = re.compile(r"\$?(?:[A-Za-z]{2,6}:)?(?:[A-Z]{1,5}|[a-z]{1,5})(?:[.-][A-Za-z]{1,2})?")
_WORD = rf"(?:{_TICKER.pattern}|[\"'“‘](?:{_TICKER.pattern})[\"'”’])"
_RUN = re.compile(rf"{_WORD}(?:[^\S\t\r\n]+{_WORD})+")
_SPECIAL = re.compile(r"[\[\]\"'“”‘’„«»\\]")
SCHEMA = "dedupe_key string, pos bigint, value string, error string"


def _ends(s: str, i: int) -> bool:
    """Whether a separator, a closing bracket or the end follows i, blanks aside."""
    i = _BLANK.match(s, i).end()
    return i == len(s) or s[i] == "]" or s[i] in SEPARATORS or s[i] == "/" or (s[i] in "-–—" and i > 0 and s[i - 1].isspace() and s[i + 1 : i + 2].isspace())


def _quoted(s: str, i: int, failed: dict[str, set[int]]) -> tuple[str, int] | None:
    """Quoted at i: the value and the place behind its close, or None if this alternative fails. failed: by opening quote
    the places inside one from which no close is found; the first place is special and never among them."""
    close, out, j, n = QUOTES[s[i]], [], i + 1, len(s)
    vain, passed = failed.setdefault(s[i], set()), []
    while j < n:
        if j > i + 1:
            if j in vain:
                break
            passed.append(j)
        c = s[j]
        if c == "\\" and j + 1 < n and s[j + 1] in (close, s[i], "\\"):
            out.append(s[j + 1])
            j += 2
        elif c == close:
            if s[j + 1 : j + 2] == close and close == s[i] and not (j == i + 1 and _ends(s, j + 2)) and not (j > i + 1 and _ends(s, j + 1)):
                out.append(close)
                j += 2
            elif s[j + 1 : j + 2] == close and j == i + 1 and _ends(s, j + 2):
                j += 1  # nothing but a doubled quote: an empty value
            elif _ends(s, j + 1):
                return "".join(out), j + 1
            else:
                out.append(c)
                j += 1
        else:
            out.append(c)
            j += 1
    vain.update(passed)
    return None


def _bare(text: str, error: str | None) -> Iterator[tuple[str, str | None]]:
    v = text.strip()
    if v[:1] in ("[",) or v[-1:] in ("]",):
        if v.count("[") != v.count("]"):
            v, error = v.strip("[]").strip(), error or "stray_bracket"
        elif v[:1] == "[" and v[-1:] == "]":
            v = v[1:-1].strip()
    if v and v[-1] in "\"”“»" and v.count(v[-1]) % 2:
        v, error = v[:-1].strip(), error or "stray_quote"
    pieces = v.split()
    if len(pieces) > 1 and all(_TICKER.fullmatch(p) for p in pieces):
        yield from ((p, error) for p in pieces)
    elif v:
        yield v, error


def parse(field: str | None) -> list[tuple[str, str | None]]:
    """The values of a field in order, each with its error flag (None if it was well formed)."""
    if not field or not (s := field.strip()):
        return []
    found: list[tuple[str, str | None]] = []
    if not _SPECIAL.search(s):
        for piece in _SEP.split(s):
            found.extend(_bare(piece, None))
        return found
    if s[0] == "[" and s[-1] == "]" and "[" not in s[1:-1]:
        s = s[1:-1]
    i, n = 0, len(s)
    failed: dict[str, set[int]] = {}
    while i < n:
        i = _BLANK.match(s, i).end()
        if i >= n:
            break
        c, error = s[i], None
        if (r := _RUN.match(s, i)) and _ends(s, r.end()):
            found.extend((w.strip("\"'“”‘’"), None) for w in r[0].split())
            i = _BLANK.match(s, r.end()).end()
            if i < n and s[i] == "]":
                i += 1
        elif c in QUOTES and (q := _quoted(s, i, failed)):
            if q[0].strip():
                found.append((q[0].strip(), None))
            i = _BLANK.match(s, q[1]).end()
            if i < n and s[i] == "]":
                i += 1
        elif c == "[" and i + 1 < n and s[i + 1] in QUOTES and _quoted(s, i + 1, failed):
            i += 1  # Bracketed: the bracket goes, the quoted value inside comes next
            continue
        else:
            start = i
            if c in QUOTES and c not in "'‘":
                start, error = i + 1, "unclosed_quote"
            elif c in "'‘" and s.rfind(QUOTES[c]) <= i:
                start, error = i + 1, "unclosed_quote"
            m = _BARE_END.search(s, start)
            i = m.start() if m else n
            found.extend(_bare(s[start:i], error))
            if m and s[i].isspace() and s[i] not in SEPARATORS:
                i += 1
        m = _SEP.match(s, i)
        if m:
            i = m.end()
    return found


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, pos, values, errors = [], [], [], []
        for key, field in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for k, (v, e) in enumerate(parse(field), 1):
                keys.append(key)
                pos.append(k)
                values.append(v)
                errors.append(e)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(pos, pa.int64()), pa.array(values, pa.string()), pa.array(errors, pa.string())], names=["dedupe_key", "pos", "value", "error"])


def split_packed(articles: DataFrame, field: str = "related") -> DataFrame:
    """One row per value of `field` of the delivery that counts: dedupe_key, pos, value, error."""
    ship(articles.sparkSession)
    counted = earliest(articles.select("dedupe_key", field, "ingested_at"), ["dedupe_key"], [field])
    return counted.where(f"{field} is not null").select("dedupe_key", field).mapInArrow(_split, SCHEMA)
