"""Near-duplicate texts: word sets, an exact prefix-filter join, and an exact check.

Texts with the same set of words form a class; classes are compared, copies are not. The words of a class are put in one
order for all classes, rare ones first (counted over all texts in a table of fixed size; the hash settles ties). Of two
classes with similarity t or more, the larger with n words has at least t n words in common with the smaller, and the
smaller with m words at least 2t/(1+t) m. So their first common word stands among the first n - ceil(t n) + 1 words of
the larger and the first m - ceil(2t/(1+t) m) + 1 of the smaller: every such pair meets at that word, without exception.

Where classes meet, they are compared by bitmaps: every word flips one of BITS bits, so two bitmaps never differ in more
bits than their classes have words apart, and a pair that differs in more bits than the threshold allows in words is
none. Neither step loses a pair, and what remains is checked on the word sets. The meetings of a word are compared in
tiles of a fixed size; the larger ones of a word of more than BLOCK classes are split into blocks. A task holds one block
and lets all smaller ones of the word pass by in parts, and it hands on what it finds in parts, so its memory depends
neither on the classes of a word nor on the pairs among them.

A class collapses copies before any pair is formed. The number of meetings grows with the square of the texts that share
a word of their prefixes, so it is in proportion to the texts only where these words are rare.

Defined results: null headline and summary count as empty; a text without words is similar to nothing; null keys pair
with nothing; the earliest delivery stands for a key; pairs come once with a < b. Classes are told apart by 64-bit hashes,
the words of a class by 32 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.runtime import cut, earliest, ship

#: Bits of a bitmap, 64 to a word; the first DENSE words are compared for all meetings, the rest where those agree.
BITS, DENSE = 192, 2
#: Classes of a word that one task holds; rows and columns of a tile.
BLOCK, TILE = 50_000, (64, 4096)
#: Words or rows laid out at once; smaller classes compared at once; meetings held until they are looked at closely, and pairs until they are handed on.
LAID, PASSING, HITS = 1 << 17, 1 << 14, 1 << 17
BUCKETS = 1 << 18
THRESHOLD = 0.6

_WORD = re.compile(r"[^\W_]+")
_U = np.uint64


def word_hashes(*texts: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the words of the texts together."""
    ws = set(_WORD.findall(" ".join(t for t in texts if t).lower()))
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in ws), _U, len(ws))
    h.sort()
    return h


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes = [word_hashes(h, s) for h, s in zip(b.column("headline").to_pylist(), b.column("summary").to_pylist())]
        ids = [xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63) if len(h) else None for h in hashes]
        words = [(h & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32) for h in hashes]
        yield pa.RecordBatch.from_arrays([b.column("dedupe_key"), b.column("ingested_at"), pa.array(ids, pa.int64()), pa.array(words, pa.list_(pa.int32()))], names=["dedupe_key", "ingested_at", "cid", "words"])


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(BUCKETS, np.int64)
    for b in batches:
        n += np.bincount(b.column(0).flatten().to_numpy().view(np.uint32) % np.uint32(BUCKETS), minlength=BUCKETS)
    used = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["bucket", "n"])


def _frequent(shared):
    """Bucket and class for each word of a frequent bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for b in batches:
            bucket = b.column(1).flatten().to_numpy().view(np.uint32) % np.uint32(BUCKETS)
            kept = np.flatnonzero(frequent[bucket])
            cid = np.repeat(b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[kept].astype(np.int64)), pa.array(cid[kept])], names=["bucket", "cid"])

    return run


def word_counts(described: DataFrame) -> np.ndarray:
    """Per word bucket the texts that have its words (a word counts in each); beyond BLOCK the classes, to within some
    percent, as copies take no room in a block. Its size is fixed."""
    counts = described.select("words").mapInArrow(_bucket_counts, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = counts.toPandas()  # at most BUCKETS rows
    n = np.zeros(BUCKETS, np.int64)
    n[rows.bucket.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    if (n >= BLOCK).any():
        shared = described.sparkSession.sparkContext.broadcast(n >= BLOCK)
        of = described.where("cid is not null").select("cid", "words").mapInArrow(_frequent(shared), "bucket bigint, cid bigint")
        rows = of.groupBy("bucket").agg(F.approx_count_distinct("cid").alias("n")).toPandas()
        at = rows.bucket.to_numpy(np.int64)
        # the count may be a little off; a word of several texts stays one that may meet
        n[at] = np.clip(rows.n.to_numpy(np.int64), 2, n[at])
    return n


def _needed(n: np.ndarray, share: float) -> np.ndarray:
    """The least whole number that is at least the share of n; never too high for rounding."""
    return np.ceil(n * share - 1e-9).astype(np.int64)


def bitmaps(flat: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The bitmaps of word sets (uint32 hashes, one set after the other) in words of 64 bits."""
    at = _mix(flat.astype(_U) + _U(1)) % _U(BITS)
    bit = _U(1) << at % _U(64)
    return [np.bitwise_xor.reduceat(np.where(at // _U(64) == _U(k), bit, _U(0)), starts) for k in range(BITS // 64)]


PREFIX = f"key bigint, cid bigint, role int, size int, {', '.join(f's{k} bigint' for k in range(BITS // 64))}"
PROBE, INDEX = 1, 2


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to at most `most`; what is larger makes a range of its own."""
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, most + (ends[start - 1] if start else 0), "right")))
        yield start, end
        start = end


def _prefixes(shared, threshold: float):
    """A row for each word of a class's prefix: as the larger of a pair (PROBE) and, for a shorter prefix, as the smaller (INDEX).
    The key is the word and its block. A row that is INDEX alone only passes by the classes of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for whole in batches:
            for first, last in _parts(whole.column(1).value_lengths().to_numpy().astype(np.int64), LAID):
                b = whole.slice(first, last - first)
                cid = b.column(0).to_numpy()
                n = b.column(1).value_lengths().to_numpy().astype(np.int64)
                starts = np.cumsum(n) - n
                flat, owner = b.column(1).flatten().to_numpy().view(np.uint32), np.repeat(np.arange(len(n)), n)
                maps = bitmaps(flat, starts)
                texts = counts[(flat % np.uint32(BUCKETS)).astype(np.int64)]
                order = np.lexsort((flat, texts, owner))
                flat, texts, place = flat[order], texts[order], np.arange(len(flat)) - starts[owner]
                probe = place <= (n - _needed(n, threshold))[owner]
                index = place <= (n - _needed(n, 2 * threshold / (1 + threshold)))[owner]
                kept = np.flatnonzero((probe | index) & (texts > 1))  # a word of one text meets nothing
                blocks = 1 + texts[kept] // BLOCK
                # every block meets all of the index and holds its share of the probes
                more = np.where(index[kept], blocks, 1)
                for start, end in _parts(more, LAID):
                    k, m = kept[start:end], more[start:end]
                    row = np.repeat(np.arange(len(k)), m)
                    own = (cid[owner[k]] % blocks[start:end])[row]
                    block = np.where(index[k][row], np.arange(len(row)) - (np.cumsum(m) - m)[row], own)
                    role = np.where(block == own, (probe[k] * PROBE + index[k] * INDEX)[row], INDEX)
                    key = flat[k][row].astype(np.int64) << 31 | block
                    of = owner[k][row]
                    columns = [key, cid[of], role.astype(np.int32), n[of].astype(np.int32), *(x[of].view(np.int64) for x in maps)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in PREFIX.split(", ")])

    return run


def _by_size(parts: list[list[np.ndarray]], role: int) -> list[np.ndarray]:
    """Class, size and bitmaps of the rows with the role, in order of their sizes."""
    cid, roles, size, *maps = (np.concatenate(c) for c in list(zip(*parts))[1:])
    own = np.flatnonzero(roles & role)
    own = own[np.argsort(size[own], kind="stable")]
    return [cid[own], size[own].astype(np.int64), *(m[own].view(_U) for m in maps)]


def _compared(larger: list[np.ndarray], smaller: list[np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the classes (by size) that size and bitmaps leave possible, a bounded number at once."""
    apart = (1 - threshold) / (1 + threshold)  # of the words of both classes, those that may be in one of them only
    (cid_a, size_a, *rows), (cid_b, size_b, *columns) = larger, smaller
    least = _needed(size_a, threshold)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def near() -> tuple[np.ndarray, np.ndarray]:
        i, j = (np.concatenate(x) for x in zip(*found))
        found.clear()
        d = sum(np.bitwise_count(a[i] ^ b[j]).astype(np.int64) for a, b in zip(rows, columns))
        ok = (d <= (size_a[i] + size_b[j]) * apart + 1e-9) & (size_b[j] <= size_a[i]) & (size_b[j] >= least[i]) & (cid_a[i] != cid_b[j])
        a, b = cid_a[i[ok]], cid_b[j[ok]]
        return np.minimum(a, b), np.maximum(a, b)

    hits = 0
    for r in range(0, len(cid_a), TILE[0]):
        r_end = min(r + TILE[0], len(cid_a))
        most = size_a[r_end - 1]
        first, end = np.searchsorted(size_b, least[r]), np.searchsorted(size_b, most, "right")
        for c in range(first, end, TILE[1]):
            c_end = min(c + TILE[1], end)
            d = np.bitwise_count(rows[0][r:r_end, None] ^ columns[0][c:c_end])
            for k in range(1, DENSE):
                d += np.bitwise_count(rows[k][r:r_end, None] ^ columns[k][c:c_end])
            bound = np.minimum(255, np.floor((most + size_b[c:c_end]) * apart + 1e-9)).astype(np.uint8)
            hit = np.flatnonzero(d <= bound)
            if len(hit):
                i, j = np.divmod(hit, c_end - c)
                found.append((i + r, j + c))
                hits += len(hit)
            if hits >= HITS:
                yield near()
                hits = 0
    if found:
        yield near()


def _meetings(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come block by block: first the classes that it holds, then those that only pass by
        at = None
        held: list[list[np.ndarray]] = []
        passing: list[list[np.ndarray]] = []
        larger: list[np.ndarray] | None = None  # those held, once they are complete
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        count = lambda parts: sum(len(p[0]) for p in parts)

        def handed_on() -> Iterator[pa.RecordBatch]:
            if pairs:
                a, b = (np.concatenate(x) for x in zip(*pairs))
                pairs.clear()
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["cid_a", "cid_b"])

        def met(larger: list[np.ndarray], smaller: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b in _compared(larger, smaller, threshold):
                if len(a):
                    pairs.append((a, b))
                    if count(pairs) >= HITS or len(pairs) >= 1000:
                        yield from handed_on()

        def complete() -> Iterator[pa.RecordBatch]:
            nonlocal larger
            if larger is None and held:
                larger = _by_size(held, PROBE)
                if count(held) > 1:
                    yield from met(larger, _by_size(held, INDEX))
                held.clear()

        def passed() -> Iterator[pa.RecordBatch]:
            yield from complete()
            if passing and larger is not None:
                yield from met(larger, _by_size(passing, INDEX))
            passing.clear()

        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            key, passes = columns[0], columns[2] == INDEX
            new = (key[1:] != key[:-1]) | (passes[1:] != passes[:-1])
            bounds = [0, *(np.flatnonzero(new) + 1).tolist(), len(key)]
            for start, end in zip(bounds, bounds[1:]):
                if start == end:
                    continue
                if key[start] != at:
                    yield from passed()
                    at, larger = key[start], None
                if larger is not None and not passes[start]:
                    raise ValueError("a block holds a class that came after others had passed by")
                (passing if passes[start] else held).append([c[start:end] for c in columns])
                if count(passing) >= PASSING:
                    yield from passed()
        yield from passed()
        yield from handed_on()

    return run


def similar_classes(articles: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members: dedupe_key, cid of the deliveries that count; links: cid_a < cid_b, similarity of different classes)."""
    ship(articles.sparkSession)
    text = articles.select("dedupe_key", "ingested_at", F.col("headline").cast("string"), F.col("summary").cast("string"))
    kind = dict(text.dtypes)["ingested_at"]
    # texts are read once; what follows needs only the hashes of their words
    described = cut(text.mapInArrow(_described, f"dedupe_key string, ingested_at {kind}, cid bigint, words array<int>"), "words")
    members = earliest(described.select("dedupe_key", "ingested_at", "cid"), ["dedupe_key"], ["cid"]).where("cid is not null and dedupe_key is not null").select("dedupe_key", "cid")
    classes = described.where("cid is not null").groupBy("cid").agg(F.first("words").alias("words"))
    shared = articles.sparkSession.sparkContext.broadcast(word_counts(described))
    laid = classes.mapInArrow(_prefixes(shared, threshold), PREFIX).repartition("key")
    # one number to sort by; its sign may turn, but blocks stay together
    laid = laid.sortWithinPartitions(F.shiftleft("key", 1).bitwiseOR((F.col("role") == INDEX).cast("bigint")))
    met = laid.mapInArrow(_meetings(threshold), "cid_a bigint, cid_b bigint").repartition("cid_a").distinct()
    wa = classes.select(F.col("cid").alias("cid_a"), F.col("words").alias("wa"))
    wb = classes.select(F.col("cid").alias("cid_b"), F.col("words").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    checked = met.join(wa, "cid_a").join(wb, "cid_b").select("cid_a", "cid_b", (both / (F.size("wa") + F.size("wb") - both)).alias("similarity"))
    return members, checked.where(F.col("similarity") >= threshold)


def similar_pairs(articles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """dedupe_key_a < dedupe_key_b, similarity of all articles at least that similar, copies included."""
    members, links = similar_classes(articles, threshold)
    members = cut(members, "members")
    ka = members.select(F.col("dedupe_key").alias("k1"), F.col("cid").alias("cid_a"))
    kb = members.select(F.col("dedupe_key").alias("k2"), F.col("cid").alias("cid_b"))
    across = links.join(ka, "cid_a").join(kb, "cid_b").select("k1", "k2", "similarity")
    copies = ka.join(kb, F.col("cid_a") == F.col("cid_b")).where("k1 < k2").select("k1", "k2", F.lit(1.0).alias("similarity"))
    return across.unionByName(copies).select(F.least("k1", "k2").alias("dedupe_key_a"), F.greatest("k1", "k2").alias("dedupe_key_b"), "similarity")


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> node, root: the least node of each connected component, by alternating large and small stars.
    The rounds grow with the logarithm of the component size; every round is written to the shared folder."""
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_ = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(small_, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        star = cut(star, "edges")
        if edges.exceptAll(star).isEmpty() and star.exceptAll(edges).isEmpty():
            return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges = star


def stories(articles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per article with words: dedupe_key, class_id, story_id (least class of the story), n_links (similar classes)."""
    members, links = similar_classes(articles, threshold)
    members = cut(members, "members")
    own = members.select("cid").distinct()  # texts of deliveries that don't count link nothing
    for side in ("cid_a", "cid_b"):
        links = links.join(own.withColumnRenamed("cid", side), side, "left_semi")
    links = cut(links.select("cid_a", "cid_b"), "links")
    root = components(links.select(F.col("cid_a").alias("u"), F.col("cid_b").alias("v")))
    degree = links.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("n_links"))
    return (
        members.join(root.withColumnRenamed("node", "cid"), "cid", "left")
        .join(degree, "cid", "left")
        .select("dedupe_key", F.col("cid").alias("class_id"), F.coalesce("root", "cid").alias("story_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    )
