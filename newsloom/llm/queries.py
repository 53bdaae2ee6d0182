"""Queries of the text problems (pN_...) and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import abuse, leaks, nearest, similar, tokens, truncation
from newsloom.llm import truncation as T
from newsloom.runtime import cut, table

#: Where the public vocabularies lie; a parameter, the files are not part of this repository.
TOKENIZERS = os.environ.get("NEWSLOOM_TOKENIZERS", "/opt/tokenizers")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_pairs(table(spark, sf_dir, "articles")).select("dedupe_key_a", "dedupe_key_b")


def p2_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article with words, the least key of its story, and how many other texts are similar to its own."""
    rows = cut(similar.stories(table(spark, sf_dir, "articles")), "stories")
    least = rows.groupBy("story_id").agg(F.min("dedupe_key").alias("story"))
    return rows.join(least, "story_id").select("dedupe_key", "story", "n_links")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_values(table(spark, sf_dir, "articles"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_rates(table(spark, sf_dir, "articles"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.articles_to_bars(table(spark, sf_dir, "articles"), table(spark, sf_dir, "bars"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without the affected documents."""
    return leaks.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "source", F.length("text").cast("bigint").alias("n_chars"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.abusive(table(spark, sf_dir, "documents"), table(spark, sf_dir, "moderation_labels"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "moderation_labels"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "moderation_labels"))


QUERIES = {f.__name__: f for f in (p2_found, p2_stories, p3_found, p3_rates, p6_found, p7_ids, p8_found, p8_items, p8_clean, p9_found, p9_scores, p9_rates)}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spike_sql(n: str, around: str) -> str:
    m = f"CASE WHEN len({around}) >= {T.AROUND} THEN {around}[len({around}) - {T.AROUND - 1}] ELSE 0 END"
    return f"({n} >= {T.LEAST} AND {n} >= {T.TIMES} * ({m}) AND {n} - ({m}) >= {T.SIGMAS} * sqrt(greatest({m}, 1)))"


_JUDGED = rf"""
WITH one AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY ingested_at, source_api) AS nth FROM articles),
v AS (SELECT dedupe_key, source_api, trim(coalesce(headline, '')) AS head, 'summary' AS field, summary AS raw FROM one WHERE nth = 1 UNION ALL SELECT dedupe_key, source_api, trim(coalesce(headline, '')), 'content_snippet', content_snippet FROM one WHERE nth = 1),
t AS (SELECT *, regexp_replace(raw, '[\s\x{{00A0}}\x{{FEFF}}\x{{200B}}]+$', '') AS text FROM v WHERE raw IS NOT NULL),
b AS (SELECT *, regexp_replace(text, {_quoted(T._MARK)}, '') AS body FROM t WHERE trim(text) <> ''),
k AS (SELECT *, length(raw) AS u0, strlen(raw) AS u1, length(body) AS u2, strlen(body) AS u3, CASE WHEN body = head THEN 0 WHEN regexp_matches(body, {_quoted(T._OPEN_TAG)}) THEN 3 WHEN regexp_matches(body, {_quoted(T._NUMBER)}) THEN 1
 WHEN regexp_matches(body, {_quoted(T._END + "$")}) THEN 0 WHEN regexp_matches(body, {_quoted(T._OPEN_ENTITY)}) THEN 3 WHEN regexp_matches(body, {_quoted(T._CLOSED)}) THEN 2 ELSE 3 END AS kind FROM b),
l AS (SELECT source_api, field, kind, 0 AS unit, u0 AS len FROM k UNION ALL SELECT source_api, field, kind, 1, u1 FROM k UNION ALL SELECT source_api, field, kind, 2, u2 FROM k UNION ALL SELECT source_api, field, kind, 3, u3 FROM k),
h AS (SELECT source_api, field, unit, len, count(*) AS n, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2 FROM l GROUP BY ALL),
a AS (SELECT x.source_api, x.field, x.unit, x.len, x.n, x.n1, x.n2, coalesce(list_sort(list(y.n) FILTER (y.n IS NOT NULL)), []) AS a0, coalesce(list_sort(list(y.n1) FILTER (y.n IS NOT NULL)), []) AS a1, coalesce(list_sort(list(y.n2) FILTER (y.n IS NOT NULL)), []) AS a2
 FROM h x LEFT JOIN h y ON x.source_api IS NOT DISTINCT FROM y.source_api AND x.field = y.field AND x.unit = y.unit AND y.len <> x.len AND abs(y.len - x.len) <= {T.AROUND} GROUP BY ALL),
s AS (SELECT source_api, field, unit, len, {_spike_sql("n1", "a1")} AS s1, {_spike_sql("n2", "a2")} AS s2 FROM a WHERE {_spike_sql("n", "a0")}),
j AS (SELECT k.*, EXISTS (SELECT 1 FROM s WHERE s.source_api IS NOT DISTINCT FROM k.source_api AND s.field = k.field AND s.len = [k.u0, k.u1, k.u2, k.u3][s.unit + 1]) AS at_limit,
 EXISTS (SELECT 1 FROM s WHERE s.source_api IS NOT DISTINCT FROM k.source_api AND s.field = k.field AND s.len = [k.u0, k.u1, k.u2, k.u3][s.unit + 1] AND (k.kind = 1 AND s1 OR k.kind = 2 AND s2)) AS doubt FROM k),
r AS (SELECT *, CASE WHEN kind = 3 AND at_limit OR doubt THEN 'limit' WHEN kind = 3 THEN 'transfer' END AS reason FROM j)
"""

ORACLES = {
    "p3_found": _JUDGED + "SELECT dedupe_key, field FROM r WHERE reason IS NOT NULL",
    "p3_rates": _JUDGED + "SELECT source_api, field, count(*) AS n_values, count(reason) AS n_cut, count(*) FILTER (reason = 'limit') AS n_cut_at_limit, count(*) FILTER (reason = 'transfer') AS n_cut_in_transfer, round(count(reason) / count(*), 6) AS cut_rate FROM r GROUP BY source_api, field",
    # Texts with equal word sets are one; links between them, and the closure of the links.
    "p2_stories": r"""
WITH RECURSIVE a AS (SELECT dedupe_key AS k, headline, summary, row_number() OVER (PARTITION BY dedupe_key ORDER BY ingested_at) AS nth FROM articles WHERE dedupe_key IS NOT NULL),
w AS (SELECT DISTINCT k, unnest(regexp_extract_all(lower(concat_ws(' ', headline, summary)), '[\p{L}\p{N}]+')) AS w FROM a WHERE nth = 1),
sets AS (SELECT k, list_sort(list(w)) AS ws FROM w GROUP BY k),
class AS (SELECT k, min(k) OVER (PARTITION BY ws) AS c, len(ws) AS n FROM sets),
own AS (SELECT c, n FROM class WHERE c = k),
cw AS (SELECT k AS c, w FROM w WHERE k IN (SELECT c FROM own)),
pairs AS (SELECT x.c AS a, y.c AS b, count(*) AS m FROM cw x JOIN cw y ON x.w = y.w AND x.c < y.c GROUP BY x.c, y.c),
links AS (SELECT a, b FROM pairs JOIN own x ON x.c = a JOIN own y ON y.c = b WHERE m * 10 >= (x.n + y.n - m) * 6),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT c AS r, c AS x FROM own UNION SELECT r, b FROM reach JOIN either ON a = x),
story AS (SELECT x AS c, min(r) AS story FROM reach GROUP BY x)
SELECT k AS dedupe_key, story, (SELECT count(*) FROM either WHERE a = class.c) AS n_links FROM class JOIN story USING (c)""",
    # All pairs by shared words; affordable for SQL up to some ten thousand articles.
    "p2_found": r"""
WITH a AS (SELECT dedupe_key AS k, headline, summary, row_number() OVER (PARTITION BY dedupe_key ORDER BY ingested_at) AS nth FROM articles WHERE dedupe_key IS NOT NULL),
w AS (SELECT DISTINCT k, unnest(regexp_extract_all(lower(concat_ws(' ', headline, summary)), '[\p{L}\p{N}]+')) AS w FROM a WHERE nth = 1),
n AS (SELECT k, count(*) AS n FROM w GROUP BY k),
c AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM w x JOIN w y ON x.w = y.w AND x.k < y.k GROUP BY x.k, y.k)
SELECT a AS dedupe_key_a, b AS dedupe_key_b FROM c JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE c * 10 >= (x.n + y.n - c) * 6""",
    "p6_found": """
WITH a AS (SELECT dedupe_key, upper(trim(symbol)) AS s, published_at AS t, row_number() OVER (PARTITION BY dedupe_key ORDER BY ingested_at, symbol, published_at) AS nth FROM articles),
b AS (SELECT DISTINCT upper(trim(symbol)) AS s, bar_ts AS t FROM bars WHERE bar_interval <> '1d')
SELECT dedupe_key, arg_min(epoch_us(b.t), abs(epoch_us(a.t) - epoch_us(b.t)) * 2 + (b.t > a.t)::INT) AS bar_us
FROM a JOIN b ON a.s = b.s AND b.t BETWEEN a.t - INTERVAL 900 SECOND AND a.t + INTERVAL 900 SECOND
WHERE nth = 1 AND a.s <> '' AND epoch_us(a.t) <> 0 AND dedupe_key IS NOT NULL GROUP BY dedupe_key""",
}
