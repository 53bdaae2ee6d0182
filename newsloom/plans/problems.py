"""Queries of the general data problems (pN_...) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.packed import split_packed
from newsloom.operators.spikes import suspicious
from newsloom.operators.trailing import daily_bar_trailing, trailing_cases
from newsloom.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_packed(table(spark, sf_dir, "articles")).select("dedupe_key", "pos", "value")


def p1_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and malformed pieces per kind of error."""
    return split_packed(table(spark, sf_dir, "articles")).groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n_values"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing_cases(daily_bar_trailing(table(spark, sf_dir, "bars")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suspicious(table(spark, sf_dir, "bars")).select("source_api", "symbol", "bar_interval", "bar_us", "field")


QUERIES = {f.__name__: f for f in (p1_found, p1_errors, p4_found, p5_found)}

ORACLES = {
    # Plain sums of the rows of each period, not differences of prefix sums.
    "p4_found": """
WITH one AS (SELECT source_api, symbol, CAST(bar_ts AS DATE) AS d, close, volume, row_number() OVER (PARTITION BY source_api, symbol, bar_interval, bar_ts ORDER BY ingested_at, close, volume) AS nth FROM bars WHERE bar_interval = '1d' AND source_api IS NOT NULL AND symbol IS NOT NULL AND bar_ts IS NOT NULL),
b AS (SELECT * FROM one WHERE nth = 1),
days AS (SELECT source_api, symbol, unnest(generate_series(min(d) + 29, max(d), INTERVAL 1 DAY))::DATE AS day FROM b GROUP BY source_api, symbol),
roll AS (SELECT source_api, symbol, day, fsum(volume) FILTER (d > day - 7) AS v7, fsum(volume) AS v30, avg(close) FILTER (d > day - 7) AS c7, avg(close) AS c30
 FROM days JOIN b USING (source_api, symbol) WHERE d BETWEEN day - 29 AND day GROUP BY source_api, symbol, day)
SELECT source_api, symbol, strftime(day, '%Y-%m-%d') AS bar_day, 'volume' AS measure FROM roll WHERE v7 > v30 / 2
UNION ALL SELECT source_api, symbol, strftime(day, '%Y-%m-%d'), 'close' FROM roll WHERE abs(c7 - c30) > 0.1 * abs(c30)
""",
    "p5_found": """
WITH one AS (SELECT source_api, symbol, bar_interval, epoch_us(bar_ts) AS t, close, volume, row_number() OVER (PARTITION BY source_api, symbol, bar_interval, bar_ts ORDER BY ingested_at, close, volume) AS nth FROM bars WHERE source_api IS NOT NULL AND symbol IS NOT NULL AND bar_interval IS NOT NULL AND bar_ts IS NOT NULL),
r AS (SELECT source_api, symbol, bar_interval, t, 'close' AS field, close AS x FROM one WHERE nth = 1 AND close IS NOT NULL UNION ALL SELECT source_api, symbol, bar_interval, t, 'volume', volume FROM one WHERE nth = 1 AND volume IS NOT NULL),
isl AS (SELECT *, row_number() OVER (PARTITION BY source_api, symbol, bar_interval, field ORDER BY t) - row_number() OVER (PARTITION BY source_api, symbol, bar_interval, field, x ORDER BY t) AS g FROM r),
stuck AS (SELECT source_api, symbol, bar_interval, t, field, count(*) OVER (PARTITION BY source_api, symbol, bar_interval, field, x, g) AS n FROM isl),
l AS (SELECT source_api, symbol, bar_interval, t, field, ln(x) AS l FROM r WHERE x > 0),
m AS (SELECT source_api, bar_interval, field, median(abs(d)) AS m FROM (SELECT *, l - lag(l) OVER (PARTITION BY source_api, symbol, bar_interval, field ORDER BY t) AS d FROM l) GROUP BY ALL),
w AS (SELECT l.*, 8.0::DOUBLE * m AS far, lag(l,1) OVER s AS b1, lag(l,2) OVER s AS b2, lag(l,3) OVER s AS b3, lead(l,1) OVER s AS a1, lead(l,2) OVER s AS a2, lead(l,3) OVER s AS a3 FROM l JOIN m USING (source_api, bar_interval, field) WINDOW s AS (PARTITION BY source_api, symbol, bar_interval, field ORDER BY t)),
c AS (SELECT source_api, symbol, bar_interval, t, field, far, unnest([{'b': b1, 'a': a1, 'lo': l, 'hi': l}, {'b': b2, 'a': a1, 'lo': least(b1,l), 'hi': greatest(b1,l)}, {'b': b1, 'a': a2, 'lo': least(l,a1), 'hi': greatest(l,a1)},
 {'b': b3, 'a': a1, 'lo': least(b2,b1,l), 'hi': greatest(b2,b1,l)}, {'b': b2, 'a': a2, 'lo': least(b1,l,a1), 'hi': greatest(b1,l,a1)}, {'b': b1, 'a': a3, 'lo': least(l,a1,a2), 'hi': greatest(l,a1,a2)}]) AS q FROM w)
SELECT DISTINCT source_api, symbol, bar_interval, t AS bar_us, field FROM (
 SELECT source_api, symbol, bar_interval, t, field FROM r WHERE (field = 'close' AND x <= 0) OR (field = 'volume' AND x < 0)
 UNION ALL SELECT source_api, symbol, bar_interval, t, field FROM stuck WHERE n >= 6
 UNION ALL SELECT source_api, symbol, bar_interval, t, field FROM c WHERE q.a IS NOT NULL AND q.b IS NOT NULL AND abs(q.a - q.b) < far AND (q.lo - greatest(q.a, q.b) > far OR least(q.a, q.b) - q.hi > far))
""",
}
