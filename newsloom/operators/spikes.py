"""Implausible readings: undecimated wavelet details per series, thresholded by a robust scale per source.

The transform is a lifting scheme without decimation. The finest details are the differences of neighbouring logarithms
(Haar); the scale of a source is the median of their sizes over all its series of one bar_interval, selected by radix
histograms. At the widths of one, two and three readings the detail is what a neighbourhood does not predict: the mean of
the readings less the mean of the reading before and the one after. A spike lies beyond both neighbours by more than eight
scales, so its detail is beyond eight scales too: details beyond the threshold are the candidates, and those are checked
against the definition. A run of zero details of the values is a stuck sensor. Physically impossible readings are found by
bounds.

A series is cut into blocks of BLOCK_SLOTS bar lengths, so a task holds a block and never a whole hot series. What is
found inside a block holds as it is. What reaches over the border of blocks is found among the first and last EDGE
readings of every block, put side by side: no case looks further than EDGE readings over a border. The blocks are passed over once: the
pass writes details, candidates and edges into the shared folder, and the scale and the cases come from there.

Defined results: null and NaN readings are not part of a series; infinite ones have no logarithm; a row with a null
key column belongs to no series; the earliest delivery stands for a key; with no two positive neighbours there is no
scale and no spike; with a scale of zero nothing is a spike, as readings before and after cannot differ by less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.trailing import BAR_KEY
from newsloom.runtime import cut, earliest, micros, small

SERIES = ["source_api", "symbol", "bar_interval"]
SCALE_KEY = ["source_api", "bar_interval", "field"]
FIELDS = ("close", "volume")
MOVES = 8.0
RUN = 6
LONGEST = 3
EDGE = max(RUN, LONGEST + 2)
BLOCK_SLOTS = 4096
#: Microseconds of the unit letters of bar intervals (fixed values); other codes count as minutes.
UNIT_US = {"s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}


def _block() -> Column:
    unit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in UNIT_US.items() for x in kv)), F.lower(F.regexp_extract("bar_interval", r"^\d+(\w)", 1))), F.lit(UNIT_US["m"]))
    amount = F.greatest(F.lit(1), F.coalesce(F.regexp_extract("bar_interval", r"^(\d+)", 1).try_cast("bigint"), F.lit(1)))
    return F.floor(F.col("t") / (unit * amount * BLOCK_SLOTS))


def bars_in_blocks(bars: DataFrame) -> DataFrame:
    """One row per reading that counts: series, block, t (microseconds), field, x; a block in one task.
    The deliveries of a key are thinned out before the first shuffle, so a hot key costs no more than a row a task."""
    raw = bars.where(" and ".join(f"{c} is not null" for c in BAR_KEY)).select(*SERIES, micros("bar_ts").alias("t"), *(F.col(f).cast("double").alias(f) for f in FIELDS), "ingested_at")
    one = earliest(raw, [*SERIES, "t"], FIELDS).drop("ingested_at")
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("x")) for f in FIELDS))
    return one.withColumn("block", _block()).repartition(*SERIES, "block").select(*SERIES, "block", "t", F.inline(fields)).where("x is not null and not isnan(x)")


#: Of a reading with a logarithm `l`: the logarithm before it, and those of the LONGEST readings after it with their times.
_AROUND = {"b": "lag(l, 1)"} | {f"a{j}": f"lead(l, {j})" for j in range(1, LONGEST + 1)} | {f"t{j}": f"lead(if(l is null, null, t), {j})" for j in range(1, LONGEST)}


def _around(by: str) -> dict[str, Column]:
    return {c: F.expr(f"{e} IGNORE NULLS OVER {by}") for c, e in _AROUND.items()}


def _inside(k: int) -> list[Column]:
    return [F.col("l"), *(F.col(f"a{j}") for j in range(1, k))]


def _detail(k: int) -> Column:
    """The size of the detail of width k at a reading: what the mean of the readings before and after does not predict."""
    return F.abs(sum(_inside(k)[1:], F.col("l")) / k - (F.col("b") + F.col(f"a{k}")) / 2)


def _beyond(k: int) -> Column:
    """By how much k readings lie beyond both neighbours, on one side; not positive if they don't."""
    before, after, inside = F.col("b"), F.col(f"a{k}"), _inside(k)
    top, low = (F.greatest(*inside), F.least(*inside)) if k > 1 else (inside[0], inside[0])
    return F.greatest(low - F.greatest(before, after), F.least(before, after) - top)


def _apart(k: int) -> Column:
    return F.abs(F.col("b") - F.col(f"a{k}"))


def _candidate() -> Column:
    """Whether some scale could make a spike of one to LONGEST readings from this one on: they lie farther beyond their
    neighbours than these are apart."""
    out = F.lit(False)
    for k in range(1, LONGEST + 1):
        out = out | (F.col(f"a{k}").isNotNull() & (_beyond(k) > _apart(k)))
    return F.coalesce(F.col("l").isNotNull() & F.col("b").isNotNull() & out, F.lit(False))


def _spikes(candidates: DataFrame, key: list[str]) -> DataFrame:
    """key, t of every reading of a spike, of candidates with `move`: the detail of some width is beyond MOVES scales, and so
    are the readings of that width, while their neighbours differ by less."""
    far = MOVES * F.col("move")
    whole = [F.col(f"a{k}").isNotNull() & (_detail(k) > far) & (_beyond(k) > far) & (_apart(k) < far) for k in range(1, LONGEST + 1)]
    length = F.coalesce(*(F.when(whole[k - 1], k) for k in range(LONGEST, 0, -1)))
    times = F.array("t", *(F.col(f"t{j}") for j in range(1, LONGEST)))
    return candidates.withColumn("length", length).where("length is not null").select(*key, F.explode(F.slice(times, F.lit(1), F.col("length"))).alias("t"))


def _with_stuck(rows: DataFrame, by) -> DataFrame:
    """`stuck`: whether the reading is in a run of RUN equal readings, that is of RUN - 1 details of zero."""
    zero = rows.withColumn("zero", F.when(F.col("x") == F.lag("x").over(by), 1).otherwise(0))
    ends = zero.withColumn("ends", F.when(F.sum("zero").over(by.rowsBetween(2 - RUN, 0)) == RUN - 1, 1).otherwise(0))
    return ends.withColumn("stuck", F.max("ends").over(by.rowsBetween(0, RUN - 1)) == 1).drop("zero", "ends")


def described(placed: DataFrame) -> DataFrame:
    """A row per reading: SCALE_KEY, `a` (size of the finest detail), `symbol`, `t`, `impossible`, `stuck` and, of candidates,
    the logarithms around where one of these holds, and `edge` (what joins blocks) near the border of a block."""
    names = ["symbol", "source_api", "bar_interval", "block", "field"]
    by = Window.partitionBy(*names).orderBy("t")
    whole, upto = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, 0)
    d = placed.withColumn("l", F.when((F.col("x") > 0) & (F.col("x") < float("inf")), F.ln("x")))
    d = d.withColumns(_around(f"(PARTITION BY {', '.join(names)} ORDER BY t)") | {"p": F.row_number().over(by).cast("bigint"), "n": F.count(F.lit(1)).over(whole), "q": F.count("l").over(upto), "m": F.count("l").over(whole)})
    d = _with_stuck(d, by)
    value_edge = (F.col("p") <= EDGE) | (F.col("p") > F.col("n") - EDGE)
    log_edge = F.col("l").isNotNull() & ((F.col("q") <= EDGE) | (F.col("q") > F.col("m") - EDGE))
    flagged = d.withColumns({"impossible": F.when(F.col("field") == "close", F.col("x") <= 0).otherwise(F.col("x") < 0), "candidate": _candidate(), "v": value_edge, "g": log_edge})
    kept = F.col("impossible") | F.col("stuck") | F.col("candidate")
    return flagged.select(
        *SCALE_KEY,
        F.when(F.col("l").isNotNull(), F.abs(F.col("l") - F.col("b"))).alias("a"),
        *(F.when(kept, F.col(c)).alias(c) for c in ("symbol", "t")),
        "impossible",
        "stuck",
        "candidate",
        *(F.when(F.col("candidate"), F.col(c)).alias(c) for c in ("l", *_AROUND)),
        F.when(F.col("v") | F.col("g"), F.struct("symbol", "block", "t", "x", "l", "p", "q", "v", "g")).alias("edge"),
    )


def median_move(details: DataFrame, by: list[str], value: str) -> DataFrame:
    """The exact median `move` of the non-negative doubles `value` per group, both middle values averaged, by radix
    selection: a histogram of exponent and 8 leading bits, one of 22 further bits within the bins that hold the middle, and,
    where such a bin holds different values, one of these. Bins are counted map-side, so what is shuffled is bounded
    by the number of bins, not of rows."""
    exponent = F.when(F.col("v") > 0, F.floor(F.log2("v"))).otherwise(F.lit(-1100)).cast("int")
    scaled = F.when(F.col("v") > 0, F.col("v") / F.pow(F.lit(2.0), F.col("e"))).otherwise(F.lit(0.0))
    coded = details.where(f"{value} is not null").select(*by, F.col(value).alias("v")).withColumn("e", exponent).withColumn("m", F.floor(scaled * 256).cast("int"))
    run = Window.partitionBy(*by).orderBy("e", "m")
    coarse = coded.groupBy(*by, "e", "m").agg(F.count(F.lit(1)).alias("n"))
    coarse = coarse.withColumn("upto", F.sum("n").over(run)).withColumn("total", F.sum("n").over(Window.partitionBy(*by))).withColumn("base", F.col("upto") - F.col("n"))
    lo, hi = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = (F.col("base") <= hi) & (F.col("upto") > lo)
    bins = small(cut(coarse.where(middle).select(*by, "e", "m", "base", "total"), "median-bins"))
    fine = coded.join(bins, [*by, "e", "m"]).withColumn("f", F.floor(scaled * 2.0**30).cast("bigint"))

    def ranked(counted: DataFrame, order: list[str]) -> DataFrame:
        upto = F.col("base") + F.sum("n").over(Window.partitionBy(*by, "e", "m").orderBy(*order))
        return counted.withColumn("upto", upto).withColumn("base", F.col("upto") - F.col("n")).where(middle)

    counts = [F.count(F.lit(1)).alias("n"), F.min("base").alias("base"), F.min("total").alias("total")]
    last = cut(ranked(fine.groupBy(*by, "e", "m", "f").agg(*counts, F.min("v").alias("v"), F.max("v").alias("most")), ["f"]), "median-bins")
    mixed = last.where("v < most")
    if not mixed.isEmpty():
        within = fine.drop("base", "total").join(small(mixed.select(*by, "e", "m", "f", "base", "total")), [*by, "e", "m", "f"])
        values = within.groupBy(*by, "e", "m", "f", "v").agg(*counts)
        upto = F.col("base") + F.sum("n").over(Window.partitionBy(*by, "e", "m", "f").orderBy("v"))
        values = values.withColumn("upto", upto).withColumn("base", F.col("upto") - F.col("n")).where(middle)
        last = last.where("v = most").select(*by, "v", "base", "upto", "total").unionByName(values.select(*by, "v", "base", "upto", "total"))
    at = [F.min(F.when((F.col("base") <= k) & (F.col("upto") > k), F.col("v"))) for k in (lo, hi)]
    return last.groupBy(*by).agg(((at[0] + at[1]) / 2).alias("move"))


def suspicious(bars: DataFrame) -> DataFrame:
    """The bad readings: series, bar_us, field, impossible, stuck, spike."""
    base = cut(described(bars_in_blocks(bars)), "details")
    edges = base.where("edge is not null").select(*SCALE_KEY, "edge.*")
    key = [*SERIES, "field"]

    def joined(kept: str, place: str) -> DataFrame:
        """The edge readings of a series side by side; where a block's middle was left out, a new stretch begins."""
        along = Window.partitionBy(*key).orderBy("t")
        gap = F.when((F.lag("block").over(along) == F.col("block")) & (F.lag(place).over(along) != F.col(place) - 1), 1).otherwise(0)
        return edges.where(kept).withColumn("gap", gap).withColumn("stretch", F.sum("gap").over(along.rowsBetween(Window.unboundedPreceding, 0)))

    stuck_across = _with_stuck(joined("v", "p"), Window.partitionBy(*key, "stretch").orderBy("t")).where("stuck")
    log_by = f"(PARTITION BY {', '.join(key)}, stretch ORDER BY t)"
    logs = cut(joined("g", "q").withColumns(_around(log_by) | {"before": F.expr(f"lag(block) OVER {log_by}")}).select(*key, "t", "l", *_AROUND, (F.col("before") != F.col("block")).alias("border")), "edges")
    across = logs.select(*SCALE_KEY, F.when(F.col("border"), F.abs(F.col("l") - F.col("b"))).alias("a"))
    moves = small(cut(median_move(base.select(*SCALE_KEY, "a").unionByName(across), SCALE_KEY, "a"), "moves"))

    columns = [*key, "t", "l", *_AROUND]
    candidates = base.where("candidate").select(*columns).unionByName(logs.where("b is not null").select(*columns))
    no = F.lit(False)
    found = (
        base.where("impossible or stuck").select(*key, "t", "impossible", "stuck", no.alias("spike"))
        .unionByName(stuck_across.select(*key, "t", no.alias("impossible"), F.lit(True).alias("stuck"), no.alias("spike")))
        .unionByName(_spikes(candidates.join(moves, SCALE_KEY), key).select(*key, "t", no.alias("impossible"), no.alias("stuck"), F.lit(True).alias("spike")))
    )
    return found.groupBy(*SERIES, F.col("t").alias("bar_us"), "field").agg(F.max("impossible").alias("impossible"), F.max("stuck").alias("stuck"), F.max("spike").alias("spike"))
