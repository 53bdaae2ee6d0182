"""Pairing records with the nearest record in time of the same entity, by x-fast tries.

Both tables are spread by entity and by a leading prefix of the timestamp's bits (a block), so a hot entity falls into
many groups. The keys of a group form an x-fast trie: for every prefix length a hash table of the prefixes that occur,
each with its least and greatest key, and a list that links neighbouring keys. A lookup finds the longest prefix of its
own timestamp that occurs by binary search over the length; below that node one side is empty, so the node's least or
greatest key is the successor or the predecessor, and the list gives the other. Keys within the tolerance of a
block's border come in both blocks, so each record is looked up in its own block only.

A group's rows arrive sorted, keys first; the trie is built only when a lookup follows, and lookups are streamed. Up to
NODES keys each key is a leaf of the trie; of more, evenly chosen ones are, and a binary search between two leaves does the
rest (a y-fast trie), so memory is bounded by NODES leaves and the plain list of one entity's keys in one block, at
most some hours of them. A group with over HOT lookups is split into parts that each get its keys.

Defined results: records without entity (null, blank) or time (null, the epoch) pair with nothing; of two equally near
keys the earlier counts; repeated keys count once; a key equal in time counts as nearest; nothing within the tolerance
gives no row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.runtime import cut, earliest, micros, ship, small

#: Bits of a microsecond timestamp inside a block: 2^33 us are about 2.4 hours. The tolerance must be below it.
BITS = 33
#: Leaves of a trie.
NODES = 8192
#: Lookups of a group from which on it is split into parts.
HOT = 200_000
SCHEMA = "id string, at bigint"


class XFastTrie:
    """Over ascending distinct keys that share all bits above the lowest `bits`. Of more than `most` keys every so-manieth
    is a leaf, the first among them."""

    def __init__(self, keys: list[int], bits: int = BITS, most: int = NODES):
        self.bits, self.keys, self.step = bits, keys, max(1, -(-len(keys) // most))
        if self.step > 1:
            keys = keys[:: self.step]
            self.place = {k: i * self.step for i, k in enumerate(keys)}
        self.before = dict(zip(keys[1:], keys))
        self.after = dict(zip(keys, keys[1:]))
        self.levels: list[dict[int, list[int]]] = [{} for _ in range(bits + 1)]
        for drop, level in enumerate(self.levels):  # by the number of dropped bits
            for k in keys:
                node = level.get(k >> drop)
                if node is None:
                    level[k >> drop] = [k, k]
                else:
                    node[1] = k

    def around(self, t: int) -> tuple[int | None, int | None]:
        """The greatest key <= t and the least key >= t."""
        low, high = self._leaves(t)
        if self.step == 1 or low is None:
            return low, high
        at = bisect_right(self.keys, t, self.place[low], min(len(self.keys), self.place[low] + self.step))
        low = self.keys[at - 1]
        return low, low if low == t else self.keys[at] if at < len(self.keys) else None

    def _leaves(self, t: int) -> tuple[int | None, int | None]:
        lo, hi = 0, self.bits  # dropped bits; at hi the prefix always occurs
        while lo < hi:
            mid = (lo + hi) // 2
            if t >> mid in self.levels[mid]:
                hi = mid
            else:
                lo = mid + 1
        least, greatest = self.levels[lo][t >> lo]
        if lo == 0:
            return t, t
        if t >> (lo - 1) & 1:  # the right child is missing
            return greatest, self.after.get(greatest)
        return self.before.get(least), least


def _look_up(tolerance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, trie = None, [], None
        for b in batches:
            ids, found = [], []
            for entity, block, t, id_, part in zip(*(b.column(k).to_pylist() for k in range(5))):
                if (entity, block, part) != group:
                    group, keys, trie = (entity, block, part), [], None
                if id_ is None:
                    if not keys or keys[-1] != t:
                        keys.append(t)
                    continue
                if not keys:
                    continue
                if trie is None:
                    # keys from over the border do not share the block's bits: shift them into one trie one bit higher
                    trie = XFastTrie([k - (block << BITS) + (1 << BITS) for k in keys], BITS + 2)
                x = t - (block << BITS) + (1 << BITS)
                low, high = trie.around(x)
                best = None
                if low is not None and x - low <= tolerance:
                    best = low
                if high is not None and high - x <= tolerance and (best is None or high - x < x - best):
                    best = high
                if best is not None:
                    ids.append(id_)
                    found.append(best + (block << BITS) - (1 << BITS))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.int64())], names=["id", "at"])

    return run


def pair_nearest(records: DataFrame, keys: DataFrame, tolerance_us: int) -> DataFrame:
    """records(id string, entity, t bigint) and keys(entity, t bigint) -> id, at: the nearest key's time of each record
    that has one within the tolerance. tolerance_us must be below 2^BITS."""
    if not 0 <= tolerance_us < 1 << BITS:
        raise ValueError("tolerance_us out of range")
    block = F.shiftright("t", BITS)
    ship(records.sparkSession)
    near = F.array_distinct(F.array(F.shiftright(F.col("t") - tolerance_us, BITS), F.shiftright("t", BITS), F.shiftright(F.col("t") + tolerance_us, BITS)))
    k = keys.where("entity is not null and t is not null").select("entity", F.explode(near).alias("block"), "t", F.lit(None).cast("string").alias("id"))
    # written once, as the counts below and the pairing both read them
    r = cut(records.where("entity is not null and t is not null and id is not null").select("entity", block.alias("block"), "t", "id"), "lookups")
    # a group with very many lookups is split; its keys go to every part
    hot = r.groupBy("entity", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("entity", "block", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    hot = small(hot)
    parts = F.coalesce("parts", F.lit(1))
    k = k.join(hot, ["entity", "block"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    r = r.join(hot, ["entity", "block"], "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("parts")
    columns = ["entity", "block", "t", "id", "part"]
    spread = k.select(*columns).unionByName(r.select(*columns)).repartition("entity", "block", "part").sortWithinPartitions("entity", "block", "part", F.col("id").isNotNull(), "t")
    return spread.mapInArrow(_look_up(tolerance_us), SCHEMA)


def _symbol() -> Column:
    s = F.upper(F.regexp_replace("symbol", r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", ""))
    return F.when(F.length(s) > 0, s)


def articles_to_bars(articles: DataFrame, bars: DataFrame, tolerance_s: int = 900) -> DataFrame:
    """dedupe_key and bar_us of each article with a symbol and a publishing time and its nearest bar that is not a 1d bar."""
    one = earliest(articles.select("dedupe_key", "symbol", "published_at", "ingested_at"), ["dedupe_key"], ["symbol", "published_at"])
    records = one.select(F.col("dedupe_key").alias("id"), _symbol().alias("entity"), micros("published_at").alias("t")).where("t <> 0")
    keys = bars.where("bar_interval <> '1d'").select(_symbol().alias("entity"), micros("bar_ts").alias("t"))
    return pair_nearest(records, keys, tolerance_s * 1_000_000).select(F.col("id").alias("dedupe_key"), F.col("at").alias("bar_us"))
