"""Evaluation passages in training text: suffix arrays over shards of the corpus, searched with every test suffix.

Texts are brought to words: entities resolved, tags and invisible characters taken out, words broken at a line's end
joined where the whole is a word of the tests, compatibility forms folded, lower case; words are runs of letters or
digits. A shard is some thousand documents of one task (a longer document is cut into parts that overlap by the longest
test). Its words are numbered by the tests' vocabulary; suffixes end at words no test has, and places from which no run of
LENGTH test words starts cannot match and are left out.

The suffixes of tests and shard are ranked together by prefix doubling (1, 2, 4, ... words) until the width covers the
longest test or all ranks differ. Sorted by document and rank they form the suffix array of every document of the shard.
Documents that have some LENGTH words of a test suffix are found by their ranks at that width; in the array of each such document a
binary search finds where the test suffix belongs, and the longer of the matches with the two neighbours there is the longest match
with any suffix of the document. What is compared is one search a test suffix and document, however often either
repeats the same words.

The tests are held in blocks of at most BLOCK_WORDS words, each a broadcast of its own; a task searches its shards against
one block after the other, so the corpus is read once and nothing of it is shuffled or collected.

Defined results: null, empty or short texts and items leak nothing; repeated documents each come out; an item given
twice under two ids leaks under both; the longest of several matches counts, of equal ones one that is the same on every run.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.runtime import ship

LENGTH = 12
BLOCK_WORDS = 2_000_000
SHARD_WORDS = 400_000
#: Searches at a time, for memory.
CHUNK = 1 << 20
SCHEMA = "doc_id bigint, item_id bigint, n_words int, doc_word int, item_word int"

_TAG = regex.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)(?:[\s/][^<>]*+)?>")
#: Characters from which the inside of a tag or comment in a document is searched too, on its own.
ASIDE = 500
#: Stands between words that don't follow each other; no word is empty.
BREAK = ""
_INLINE = {"a", "b", "i", "u", "s", "em", "strong", "span", "font", "mark", "small", "sub", "sup", "code", "wbr", "abbr", "cite", "q", "ins", "del"}
_HIDDEN = regex.compile(r"[\p{Cf}\p{Variation_Selector}͏ᅟᅠ឴឵ㅤﾠ]+")
_BROKEN = regex.compile(r"([\p{L}\p{N}]+)[-‐‑]\s*[\r\n]\s*(?:>\s*)*([\p{L}\p{N}]+)")
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def unmarked(text: str) -> tuple[str, list[str]]:
    """The text without tags and comments of any length, and the insides of the long ones; linear in the text."""
    out, aside, at = [], [], 0

    def tag(m: regex.Match) -> str:
        if len(m[0]) > ASIDE:
            aside.append(m[0][1:-1])
        return "" if m[2].lower() in _INLINE else " "

    while (start := text.find("<!--", at)) >= 0 and (end := text.find("-->", start + 4)) >= 0:
        out.append(_TAG.sub(tag, text[at:start]))
        if end - start > ASIDE:
            aside.append(text[start + 4 : end])
        at = end + 3
    out.append(_TAG.sub(tag, text[at:]))
    return " ".join(out), aside


def words(text: str | None, vocabulary: dict[str, int] | None = None) -> list[str]:
    """The words of a text as they are compared; of a document (with a vocabulary) those aside come last, after breaks."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    aside: list[str] = []
    if "<" in text:
        text, aside = unmarked(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    if "\n" in text or "\r" in text:
        text = _BROKEN.sub(lambda m: m[1] + ("" if vocabulary is None or (m[1] + m[2]).lower() in vocabulary else " ") + m[2], text)
    found = _WORD.findall(text.lower())
    for inside in aside if vocabulary is not None else ():
        found += [BREAK, *words(inside, vocabulary)]
    return found


class Tests:
    """A block of items: numbered words of all items behind each other, and where each word belongs."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.vocabulary: dict[str, int] = {}
        line, item, place = [], [], []
        for item_id, text in items:
            for k, w in enumerate(words(text)):
                line.append(self.vocabulary.setdefault(w, len(self.vocabulary) + 1))
                item.append(item_id)
                place.append(k)
            line += [0] * LENGTH
            item += [-1] * LENGTH
            place += [0] * LENGTH
        self.line = np.array(line, np.int64)
        self.item = np.array(item, np.int64)
        self.place = np.array(place, np.int32)
        self.starts = np.flatnonzero(run_lengths(self.line) >= LENGTH)
        self.longest = int(run_lengths(self.line).max(initial=0))


def run_lengths(line: np.ndarray) -> np.ndarray:
    """How many numbered words (not 0) follow each other from each place on."""
    breaks = np.flatnonzero(np.append(line, 0) == 0)
    return breaks[np.searchsorted(breaks, np.arange(len(line)))] - np.arange(len(line))


class Suffixes:
    """Ranks of the suffixes of a line, each up to its first break, by their first 1, 2, 4, ... words; alike suffixes have
    the same rank. Only the places in `at` are ranked, which must hold all places their suffixes reach."""

    def __init__(self, line: np.ndarray, at: np.ndarray, runs: np.ndarray, width: int):
        self.runs = runs
        self.levels = [np.zeros(len(line) + 1, np.int64)]
        self.levels[0][:-1] = line
        while 1 << (len(self.levels) - 1) < width:
            w, r = 1 << (len(self.levels) - 1), self.levels[-1]
            further = runs[at] > w
            pair = r[at] * (int(r.max()) + 1)
            pair[further] += r[at[further] + w]
            values, inverse = np.unique(pair, return_inverse=True)
            nxt = np.zeros(len(line) + 1, np.int64)
            nxt[at] = inverse + 1
            self.levels.append(nxt)
            if len(values) == len(at):  # all differ: the order is settled
                break

    def order(self) -> np.ndarray:
        """The ranks by the widest prefix, which sort the suffixes."""
        return self.levels[-1]

    def prefix(self, places: np.ndarray, n: int) -> np.ndarray:
        """Numbers that agree where the first n words do, for places with n words or more."""
        out, done = np.zeros(len(places), np.int64), 0
        for k in range(len(self.levels) - 1, -1, -1):
            while n - done >= 1 << k:
                r = self.levels[k][places + done]
                out = np.unique(out * (int(r.max(initial=0)) + 1) + r, return_inverse=True)[1]
                done += 1 << k
        return out

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many words the suffixes at p and q have in common from their start."""
        n = np.zeros(len(p), np.int64)
        most = np.minimum(self.runs[p], self.runs[q])
        for k in [len(self.levels) - 1, *range(len(self.levels) - 1, -1, -1)]:
            w, more = 1 << k, np.ones(len(p), bool)
            while more.any():
                more = most - n >= w
                more[more] = self.levels[k][(p + n)[more]] == self.levels[k][(q + n)[more]]
                n[more] += w
        return n


def search(tests: Tests, docs: list[tuple[int, int, list[int]]]) -> tuple[np.ndarray, ...]:
    """docs: (doc_id, words before this part, numbered words). Index in docs, item_id, length, place in the document and in
    the item of the longest match of each part and item of a shard."""
    sizes = np.array([len(w) for *_, w in docs], np.int64)
    shard = np.fromiter((x for *_, w in docs for x in (*w, 0)), np.int64, int(sizes.sum() + len(docs)))
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    offset = len(tests.line)
    joint = np.concatenate([tests.line, shard])
    runs = run_lengths(joint)
    starts = np.flatnonzero(runs[offset:] >= LENGTH) + offset
    if not len(starts) or not len(tests.starts):
        return none
    # all places from a start to the end of its run
    reach = np.zeros(len(joint) + 1, np.int64)
    for s in (tests.starts, starts):
        np.add.at(reach, s, 1)
        np.add.at(reach, s + runs[s], -1)
    suffixes = Suffixes(joint, np.flatnonzero(np.cumsum(reach[:-1]) > 0), runs, max(tests.longest, LENGTH))
    key = suffixes.prefix(np.concatenate([tests.starts, starts]), LENGTH)
    wanted, key = key[: len(tests.starts)], key[len(tests.starts) :]
    shared = np.isin(key, wanted)
    starts, key = starts[shared], key[shared]
    if not len(starts):
        return none
    doc = np.searchsorted(first, starts - offset, "right") - 1
    # documents by key, each once
    pairs = np.unique(key * len(docs) + doc)
    left, right = np.searchsorted(pairs, wanted * len(docs)), np.searchsorted(pairs, (wanted + 1) * len(docs))
    hits = right - left
    # the suffix array of every document, one behind the other
    rank = suffixes.order()
    most = int(rank.max()) + 1
    array = np.lexsort((starts, rank[starts], doc))
    places, line = starts[array], doc[array] * most + rank[starts[array]]
    found: list[tuple[np.ndarray, ...]] = []
    ends = np.cumsum(hits)
    at = 0
    while at < len(hits):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        n = hits[at:upto]
        q = np.repeat(tests.starts[at:upto], n)
        d = pairs[np.repeat(left[at:upto] - np.cumsum(n) + n, n) + np.arange(n.sum())] % len(docs)
        at = upto
        if not len(q):
            continue
        where = np.searchsorted(line, d * most + rank[q])
        best, place = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for near in (where, where - 1):
            ok = (near >= 0) & (near < len(line))
            ok[ok] = line[near[ok]] // most == d[ok]
            n = suffixes.common(places[near[ok]], q[ok])
            better = n > best[ok]
            to = np.flatnonzero(ok)[better]
            best[to], place[to] = n[better], places[near[to]]
        found.append((d, tests.item[q], best, place, q))
    doc, item, run, p, q = (np.concatenate(c) for c in zip(*found))
    s = np.lexsort((q, p, -run, item, doc))
    doc, item, p, q, run = doc[s], item[s], p[s], q[s], run[s]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    before = np.array([b for _, b, _ in docs], np.int64)
    return doc[keep], item[keep], run[keep], (p - offset - first[doc] + before[doc])[keep], tests.place[q][keep]


def _find(blocks: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(texts: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
            for block in blocks:
                tests: Tests = block.value
                get, step = tests.vocabulary.get, SHARD_WORDS
                docs, size = [], 0
                for k, text in texts:
                    line = [get(w, 0) for w in words(text, tests.vocabulary)]
                    for at in range(0, max(1, len(line)), step):  # parts of a long document overlap by the longest test
                        part = line[at : at + step + tests.longest]
                        docs.append((k, at, part))
                        size += len(part)
                        if size >= step:
                            yield rows(tests, docs)
                            docs, size = [], 0
                if docs:
                    yield rows(tests, docs)
                if len(blocks) > 1:
                    block.__dict__.pop("_value", None)  # only one block is held at a time

        def rows(tests: Tests, docs: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
            doc, item, n, p, q = search(tests, docs)
            ids = [docs[k][0] for k in doc]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(item, pa.int64()), pa.array(n.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(q.astype(np.int32))],
                names=["doc_id", "item_id", "n_words", "doc_word", "item_word"],
            )

        texts, size = [], 0
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts.append((k, text))
                size += len(text)
                if size >= 6 * SHARD_WORDS:
                    yield from out(texts)
                    texts, size = [], 0
        yield from out(texts)

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    block, size = [], 0
    for row in items.select("item_id", "item_text").where("item_id is not null").orderBy("item_id").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "") // 4 + LENGTH
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_words of the longest match, doc_word and item_word where it starts."""
    spark = documents.sparkSession
    ship(spark)
    blocks = [spark.sparkContext.broadcast(Tests(b)) for b in _blocks(items)]
    if not blocks:
        return spark.createDataFrame([], SCHEMA)
    found = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("text is not null").mapInArrow(_find(blocks), SCHEMA)
    # the parts of a long document may find an item twice
    longest = F.max(F.struct("n_words", (-F.col("doc_word")).alias("p"), (-F.col("item_word")).alias("q"))).alias("m")
    return found.groupBy("doc_id", "item_id").agg(longest).select("doc_id", "item_id", "m.n_words", (-F.col("m.p")).alias("doc_word"), (-F.col("m.q")).alias("item_word"))


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: suite, documents that hold it, and its longest match."""
    per = leaks(documents, items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest"))
    return items.select("item_id", "suite").join(per, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0).cast("bigint")).alias("n_docs"), F.coalesce("longest", F.lit(0)).alias("longest"))


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    return documents.join(leaks(documents, items).select("doc_id").distinct(), "doc_id", "left_anti")
