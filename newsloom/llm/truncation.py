"""Values cut by a field limit or in transfer.

Every value is described in one pass over the text: its length in characters and bytes, as it stands and without a mark that
was put after a cut, and how it ends. Only these numbers are shuffled, never the texts.

Limits: per source and column, histograms of these lengths over all values are searched for spikes, lengths that hold far
more values than the median of the lengths around them. A value at a limit without terminal punctuation was cut there. Two endings leave a
doubt: a number before a final point (perhaps broken at its decimal point) and a closing line (perhaps broken inside). The
histogram settles them too: at a limit they count as cut where values of that very ending make a spike of their own.

Transfer: away from the limits a value counts as cut if it ends inside a word, tag or sentence. Both reasons are reported apart.

Defined results: null, empty and blank values are no cases; a value that repeats the headline is whole; only a mark and
nothing before it is cut; a null source is a source of its own; long texts are read whole; repeated keys count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.runtime import cut, earliest, small

FIELDS = ("summary", "content_snippet")
#: A spike: at least LEAST values, TIMES the median of the AROUND lengths on either side, and SIGMAS standard deviations
#: (of a Poisson count) above it.
LEAST, TIMES, AROUND, SIGMAS = 8, 2, 12, 8
WHOLE, NUMBER, CLOSING, ENDLESS = 0, 1, 2, 3
UNITS = ("chars", "bytes", "body_chars", "body_bytes")

_MARK = r"(?:\s*\[\+?\d+ ?(?:chars|characters|more)?\]|\s*…|\s*\.{3}|\x{FFFD}|\s+)+$"
_OPEN_TAG = r"<[A-Za-z/!][^<>]*$"
_OPEN_ENTITY = r"&(?:#x?[0-9a-fA-F]{0,6}|[a-z]{0,6})$"
_END = r"[.!?。！？]['\"”’»)\]]*"
_NAME = r"\p{Lu}[\p{L}\p{N}&'’]*(?: (?:&|\p{Lu}[\p{L}\p{N}&'’]*|and|of|the))*"
#: Closing lines: source, link, tag, ticker, desk and section lines, bracketed remarks.
_CLOSER = (
    r"(?:\([^()]+\)|\[[^\[\]]+\]"
    rf"|[|–—-] ?{_NAME}|(?i:source|sources|via|by): {_NAME}|(?i:via) {_NAME}"
    r"|(?:\p{Lu}[\p{L}]*(?: \p{L}+){0,4}:? )?https?://\S+"
    r"|(?i:tickers?|symbols?|tags?): [\p{L}\p{N}.:$#-]+(?:,? [\p{L}\p{N}.:$#-]+)*"
    r"|#[\p{L}\p{N}_]+(?: #[\p{L}\p{N}_]+)*"
    rf"|(?i:reporting|writing|editing) by (?:the )?{_NAME}(?: \p{{L}}+)*"
    r"|(?i:filed) (?:under|in) \p{L}[\p{L}\p{N}-]*(?: \p{L}[\p{L}\p{N}-]*){0,3}"
    r"|(?:©|\(c\)) .+)"
)
_CLOSED = rf"(?:{_END}\s+|^\s*){_CLOSER}(?:\s+{_CLOSER})*$"
_NUMBER = r"(?:^|[^\p{N}.,])\p{Sc}?\p{N}[\p{N},]*\.$"
_QUOTES = "'\"”’»)]"


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s\x{00A0}\x{FEFF}\x{200B}]+$", "")


def _last(c: Column, of: str) -> Column:
    return F.right(c, F.lit(1)).isin(list(of))


def endings(articles: DataFrame) -> DataFrame:
    """One row per delivery: key, source_api and its values: field, the four lengths, and kind (WHOLE, NUMBER, CLOSING,
    ENDLESS). A regular expression is run only where the last characters, or a sign it needs, allow a match."""

    def body(text: Column) -> Column:
        return F.when(_last(text, "]…\ufffd") | (F.right(text, F.lit(3)) == "..."), F.regexp_replace(text, _MARK, "")).otherwise(text)

    def kind(body: Column) -> Column:
        end = F.rtrim(body, F.lit(_QUOTES))
        return (
            F.when(body == F.trim(F.coalesce("headline", F.lit(""))), WHOLE)
            .when(body.contains("<") & body.rlike(_OPEN_TAG), ENDLESS)
            .when(_last(body, ".") & F.right(body, F.lit(2)).rlike(r"^\p{N}") & body.rlike(_NUMBER), NUMBER)
            .when(_last(end, ".!?。！？"), WHOLE)
            .when(body.contains("&") & body.rlike(_OPEN_ENTITY), ENDLESS)
            .when(body.rlike(_CLOSED), CLOSING)
            .otherwise(ENDLESS)
        )

    d = articles.select("dedupe_key", "source_api", "ingested_at", "headline", *(_bare(F.col(f)).alias(f"_t_{f}") for f in FIELDS), *(F.struct(F.length(f).alias("chars"), F.octet_length(f).alias("bytes")).alias(f"_n_{f}") for f in FIELDS))
    d = d.select("*", *(body(F.col(f"_t_{f}")).alias(f"_b_{f}") for f in FIELDS))
    values = [
        F.when(
            F.length(F.trim(f"_t_{f}")) > 0,
            F.struct(F.lit(f).alias("field"), F.col(f"_n_{f}.chars").alias("chars"), F.col(f"_n_{f}.bytes").alias("bytes"), F.length(f"_b_{f}").alias("body_chars"), F.octet_length(f"_b_{f}").alias("body_bytes"), kind(F.col(f"_b_{f}")).alias("kind")),
        )
        for f in FIELDS
    ]
    return d.select("dedupe_key", "source_api", "ingested_at", F.array_compact(F.array(*values)).alias("values"))


def limits(values: DataFrame) -> DataFrame:
    """Spikes of the histograms over all values: source_api, field, unit, length, n, and whether numbers and closing lines
    make spikes of their own there. Sized by the number of distinct lengths."""
    lengths = F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in UNITS))
    counts = (
        values.select("source_api", "field", "kind", F.inline(lengths))
        .groupBy("source_api", "field", "unit", "length")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == NUMBER).alias("n_number"), F.count_if(F.col("kind") == CLOSING).alias("n_closing"))
    )
    w = Window.partitionBy("source_api", "field", "unit").orderBy("length").rangeBetween(-AROUND, AROUND)

    def spike(c: str) -> Column:
        # the median of the 2 AROUND other lengths, those without values counting 0
        around = F.array_sort(F.filter(F.collect_list(F.struct("length", F.col(c).alias("n"))).over(w), lambda x: x["length"] != F.col("length")))
        sizes = F.array_sort(F.transform(around, lambda x: x["n"]))
        median = F.coalesce(F.try_element_at(sizes, F.size(sizes) - AROUND + 1), F.lit(0))
        median = F.when(F.size(sizes) >= AROUND, median).otherwise(0)
        return (F.col(c) >= LEAST) & (F.col(c) >= TIMES * median) & ((F.col(c) - median) >= SIGMAS * F.sqrt(F.greatest(median, F.lit(1))))

    return counts.select("*", *(spike(c).alias(f"s{c[1:]}") for c in ("n", "n_number", "n_closing"))).where("s").select("source_api", "field", "unit", "length", "n", "s_number", "s_closing")


def judged(articles: DataFrame) -> DataFrame:
    """The values that count, with `at_limit` and `reason`: limit, transfer, or null for a whole value."""
    one = earliest(endings(articles), ["dedupe_key"], ["source_api"])
    values = cut(one.select("dedupe_key", "source_api", F.inline("values")), "endings")  # texts are read once
    spikes = limits(values)
    code = lambda u: F.lit(UNITS.index(u) << 40) + F.col(u)
    at = F.element_at(F.create_map(*(F.lit(x) for u in UNITS for x in (u, UNITS.index(u) << 40))), F.col("unit")) + F.col("length")
    marks = spikes.groupBy(F.col("source_api").alias("s"), F.col("field").alias("f")).agg(
        F.collect_set(at).alias("all"), F.collect_set(F.when(F.col("s_number"), at)).alias("number"), F.collect_set(F.when(F.col("s_closing"), at)).alias("closing")
    )
    on = F.col("source_api").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f"))
    mine = F.array(*(code(u) for u in UNITS))
    here = lambda c: F.coalesce(F.arrays_overlap(c, mine), F.lit(False))
    reason = (
        F.when((F.col("kind") == ENDLESS) & F.col("at_limit"), "limit")
        .when(F.col("kind") == ENDLESS, "transfer")
        .when(F.col("at_limit") & (((F.col("kind") == NUMBER) & here("number")) | ((F.col("kind") == CLOSING) & here("closing"))), "limit")
    )
    return values.join(small(marks), on, "left").withColumn("at_limit", here("all")).withColumn("reason", reason).drop("s", "f", "all", "number", "closing")


def cut_values(articles: DataFrame) -> DataFrame:
    return judged(articles).where("reason is not null").select("dedupe_key", "field")


def cut_rates(articles: DataFrame) -> DataFrame:
    """Per source and field: values, cut ones, those cut at a limit and in transfer, and the rate."""
    n_cut = F.count_if(F.col("reason").isNotNull())
    return judged(articles).groupBy("source_api", "field").agg(
        F.count(F.lit(1)).alias("n_values"), n_cut.alias("n_cut"), F.count_if(F.col("reason") == "limit").alias("n_cut_at_limit"), F.count_if(F.col("reason") == "transfer").alias("n_cut_in_transfer"), F.round(n_cut / F.count(F.lit(1)), 6).alias("cut_rate")
    )
