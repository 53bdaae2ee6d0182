"""Totals and averages over trailing periods by differences of prefix sums.

Rows are first aggregated per entity and day (map-side combined, so a hot entity costs no more than its days). Each
day's prefix sums are carried forward over the days without activity up to the entity's next active day, and a trailing
total is the prefix at the day minus the prefix k days earlier. Sums count whole units of 10^-12, so differences of prefixes
are exact. Values that are no whole number of units below 10^16 are summed apart as doubles over the days of each period
itself, as a prefix of doubles would lose small values behind large ones.

Defined results: nulls, NaN and infinities count as no value; all others count as they stand; rows with a null day
or a null entity column are left out (they belong to no series); an empty table gives no rows; repeated keys count
once, by their earliest delivery.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.runtime import earliest

PLACES = 12
BAR_KEY = ["source_api", "symbol", "bar_interval", "bar_ts"]


def _parts(c: str) -> tuple[Column, Column]:
    """The value in whole units, or, if units do not hold it, as a double; the other is null."""
    x = F.col(c).cast("double")
    d = F.when(F.abs(x) < 1e16, x.try_cast(f"decimal(28,{PLACES})"))
    held = F.coalesce(d.cast("double") == x, F.lit(False))
    return F.when(held, (d * F.lit(10**PLACES)).cast("decimal(28,0)")), F.when(~held & (F.abs(x) < float("inf")), x)


def trailing(df: DataFrame, entity: Sequence[str], day: str, sums: dict[str, str], spans: Sequence[int]) -> DataFrame:
    """Per entity and calendar day from its first to its last day, for each value column `v` named in sums as name -> v
    and each span k, over the last k days, the day included: `{name}_sum_{k}` the total, `{name}_n_{k}` the number of values,
    `{name}_units_{k}` the exact total in units of 10^-12 (null if some value is no whole number of them); and `nth_day` from 1.
    """
    entity = list(entity)
    aggs = []
    for n, v in sums.items():
        held, rest = _parts(v)
        aggs += [F.coalesce(F.sum(held), F.lit(0).cast("decimal(38,0)")).alias(f"{n}_s"), (F.count(held) + F.count(rest)).alias(f"{n}_c"), F.count(rest).alias(f"{n}_x"), F.sum(rest).alias(f"{n}_r")]
    daily = df.where(" and ".join(f"{c} is not null" for c in [*entity, day])).groupBy(*entity, F.col(day).alias("day")).agg(*aggs)
    by = Window.partitionBy(*entity).orderBy("day")
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    prefix = daily.select(
        *entity,
        "day",
        F.min("day").over(run).alias("first_day"),
        F.lead("day").over(by).alias("next_day"),
        *(F.sum(f"{n}_{x}").over(run).alias(f"{n}_{x}") for n in sums for x in "scx"),
        *(F.struct("day", f"{n}_r").alias(f"{n}_r") for n in sums),
    )
    filled = prefix.withColumn("day", F.explode(F.expr("sequence(day, coalesce(date_sub(next_day, 1), day))")))

    def span(c: str, k: int) -> Column:
        return F.col(c) - F.coalesce(F.lag(c, k).over(by), F.lit(0))

    def rest(n: str, k: int) -> Column:
        own = F.when(F.col(f"{n}_r.day") == F.col("day"), F.col(f"{n}_r.{n}_r"))
        return F.sum(own).over(by.rowsBetween(1 - k, 0))

    spanned = filled.select(
        *entity,
        "day",
        (F.datediff("day", "first_day") + 1).alias("nth_day"),
        *(span(f"{n}_{x}", k).alias(f"{n}_{x}_{k}") for n in sums for x in "scx" for k in spans),
        *(rest(n, k).alias(f"{n}_r_{k}") for n in sums for k in spans),
    )
    each = [(f"{n}_sum_{k}", f"{n}_n_{k}", f"{n}_units_{k}", *(F.col(f"{n}_{x}_{k}") for x in "scxr")) for n in sums for k in spans]
    return spanned.select(
        *entity,
        "day",
        "nth_day",
        *(c for total, n, units, s, c_, x, r in each for c in ((s.cast("double") / 10.0**PLACES + F.coalesce(r, F.lit(0.0))).alias(total), c_.alias(n), F.when(x == 0, s).alias(units))),
    )


def daily_bar_trailing(bars: DataFrame, spans: Sequence[int] = (7, 30)) -> DataFrame:
    """Trailing totals of volume and sums and counts of close of the 1d bars by source_api and symbol."""
    one = bars.where("bar_interval = '1d'").select(*BAR_KEY, "close", "volume", "ingested_at")
    counted = earliest(one, BAR_KEY, ["close", "volume"]).withColumn("bar_day", F.to_date("bar_ts"))
    return trailing(counted, ["source_api", "symbol"], "bar_day", {"volume": "volume", "close": "close"}, spans)


def trailing_cases(wide: DataFrame) -> DataFrame:
    """Days from the 30th on whose last 7 days hold over half of the volume of the last 30, or whose 7-day average close
    differs from the 30-day average by over 10%: source_api, symbol, bar_day, measure."""
    # exact where all values of the last 30 days are whole units, else in doubles
    busy = F.when(F.col("volume_units_30").isNotNull(), F.col("volume_units_7") * 2 > F.col("volume_units_30")).otherwise(F.col("volume_sum_7") > F.col("volume_sum_30") / 2)
    a7 = F.col("close_units_7") * F.col("close_n_30")
    a30 = F.col("close_units_30") * F.col("close_n_7")
    mean7, mean30 = (F.try_divide(f"close_sum_{k}", f"close_n_{k}") for k in (7, 30))
    differ = F.when(F.col("close_units_30").isNotNull(), F.abs(a7 - a30) * 10 > F.abs(a30)).otherwise(F.abs(mean7 - mean30) > F.abs(mean30) / 10)
    moved = (F.col("close_n_7") > 0) & differ
    measures = F.array_compact(F.array(F.when(busy, F.lit("volume")), F.when(moved, F.lit("close"))))
    return (
        wide.where("nth_day >= 30")
        .select("source_api", "symbol", F.date_format("day", "yyyy-MM-dd").alias("bar_day"), F.explode(measures).alias("measure"))
    )
