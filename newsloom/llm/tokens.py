"""Encoding a corpus with a byte-level BPE vocabulary in time linear in the text.

A text is cut into pieces by the vocabulary's splitting pattern. A piece is encoded by backtracking: an Aho-Corasick
automaton over all tokens gives the longest token from every place of the piece; the encoder takes the longest one
that may follow the last token and falls back to shorter prefixes, then to the token before. Two tokens may stand side
by side exactly if merging by rank could not have joined anything across their border; that pair-compatibility is
kept in a table filled on demand. A sequence in which all neighbours are compatible is the one the merges give.
Decoding goes by one string of all token bytes and a table of offsets.

The vocabulary is read once on the driver (its size is fixed by the file) and broadcast. Nothing is shuffled.

Defined results: a null or empty text gives an empty list; a blank text is encoded as it is; strings of special tokens
are ordinary text; a lone surrogate cannot be in a Spark string; repeated texts are encoded alike; an id may be null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from newsloom.runtime import ship

#: Fixed values of the public pattern: English contractions, letters, digits, other signs, white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "doc_id bigint, ids array<int>"
#: Pieces kept per worker with their ids; the memory is bounded, the result does not depend on it.
KEEP = 300_000


def printable_bytes() -> dict[str, int]:
    """The byte each character of a vocabulary file stands for: printable ones for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Tokens as Latin-1 strings by id, and of each merged token the two tokens it is merged from."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = printable_bytes()
        as_bytes = {t: "".join(chr(byte[c]) for c in t) for t in model["vocab"] if all(c in byte for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ids = {as_bytes[t]: i for t, i in model["vocab"].items() if t in as_bytes}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            pair = (model["vocab"][a], model["vocab"][b])
            self.parts[model["vocab"][a + b]] = pair
            self.rank[pair] = r
        self.ids = {t: i for t, i in self.ids.items() if len(t) == 1 or i in self.parts}


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.ids, self.parts, self.rank = vocabulary.ids, vocabulary.parts, vocabulary.rank
        self.of = {i: t for t, i in self.ids.items()}
        self.made = {i: self.rank[p] for i, p in self.parts.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.shorter = {i: next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), None) for t, i in self.ids.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN).findall
        order = sorted(self.of)
        self.text = "".join(self.of[i] for i in order).encode("latin-1")
        self.offsets = np.zeros(max(order) + 2, np.int64)
        self.offsets[np.array(order) + 1] = [len(self.of[i]) for i in order]
        self.offsets = np.cumsum(self.offsets)

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens, so that both stay as they are.

        The tokens touching the border change as both sides are merged; going back in time, the younger of the two is
        undone first. A merge across would win if its rank comes before the merge that next changes either side.
        """
        made, parts = self.made, self.parts
        a, b, until = left, right, 1 << 60
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < until:
                return False
            ra, rb = made.get(a, -1), made.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra >= rb:  # of equal ones, the left is merged first, so the right is undone first
                if ra == rb:
                    until, b = rb + 1, parts[b][0]
                    continue
                until, a = ra, parts[a][1]
            else:
                until, b = rb + 1, parts[b][0]

    def piece(self, s: str) -> list[int]:
        """Ids of a piece given as a Latin-1 string of its bytes."""
        if (whole := self.ids.get(s)) is not None:
            return [whole]  # the merges that made the token give it from its own bytes
        n = len(s)
        longest = [-1] * n
        size = [0] * n
        for end, (i, length) in self.automaton.iter(s):
            start = end - length + 1
            if length > size[start]:
                size[start], longest[start] = length, i
        out: list[int] = []
        open_at = bytearray(b"\x01") * (n + 1)
        pos, token = 0, longest[0]
        while True:
            end = pos + len(self.of[token])
            fits = open_at[end]
            if fits and out:
                pair = (out[-1], token)
                if (fits := self.pairs.get(pair)) is None:
                    fits = self.pairs[pair] = self.compatible(*pair)
            if fits:
                out.append(token)
                pos = end
                if pos == n:
                    return out
                token = longest[pos]
            elif (less := self.shorter[token]) is not None:
                token = less
            else:
                open_at[pos] = 0
                token = out.pop()
                pos -= len(self.of[token])

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for p in self.split(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8").decode("latin-1"))
                if len(known) < KEEP and len(p) < 40:
                    known[p] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.text[self.offsets[i] : self.offsets[i + 1]] for i in ids).decode("utf-8")


def encode_corpus(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id and ids of every document."""
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            for k in range(0, b.num_rows, 500):  # small batches out, as ids take more room than text
                part = b.slice(k, 500)
                ids = [encoder.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(encode, SCHEMA)
