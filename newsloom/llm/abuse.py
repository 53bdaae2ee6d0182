"""Abusive, hateful and sexual content by weak supervision.

1. Texts are cut into segments (sentences, lines, and lines joined where a sentence runs on over a line break). A segment is
   brought to plain spelling: hidden characters out, look-alike letters of other scripts, accents, letter-for-sign spellings,
   spaced or dotted letters, stretched letters and masked letters are undone where that gives a listed word.
2. Voters look at every segment: word lists and patterns for and against (abuse_words.py). A pattern is not run on a segment
   without any of the words that its matches cannot do without (cues.py derives them from the pattern), so this skips nothing
   that could match. The votes make a bit pattern; the patterns of all segments are counted.
3. A generative label model is fitted to these counts and to the hand-labelled texts by expectation maximisation. For either
   truth the votes follow a tree: each voter's rate of firing depends on the truth and on one other voter, and the tree is the
   one with the greatest mutual information (Chow and Liu), so accuracies and correlations are both estimated from the data.
   Where data are thin a weak prior says which way a voter points. It gives each pattern a posterior. Segments without a
   vote say nothing about the voters and are left out; as many of them count as abusive as voted ones are, times the share of
   judged abusive texts that no voter sees.
4. A linear classifier on votes, hashed words and word pairs is trained on posteriors of a sample of segments (about
   PER_PATTERN different ones of every pattern, WITHOUT_VOTES of the one without a vote, those of the least hashes, at most
   SAMPLE in all) and on the labelled texts (at most SAMPLE). Words weigh one over the root of the segment's length.
5. A document's score is the highest score of its segments; from CUTOFF on it counts as abusive.

Texts are read once: a pass writes plain spelling and votes of all segments into the shared folder, and counts, sample and
scores come from there. Only counts (of patterns), the bounded sample and the labels come to the driver; no text is shuffled
but those of the sample.

Defined results: null, empty and blank texts score 0; repeated documents score alike; a null source is a source of its
own in the rates; without labelled texts the majority
of the votes stands in for judgement.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import abuse_words as A
from newsloom.llm.cues import cues
from newsloom.runtime import cut, ship

PER_PATTERN, WITHOUT_VOTES, SAMPLE = 300, 12_000, 40_000
FEATURES = 1 << 16
CUTOFF = 0.5
#: Letters of a line from which on a sentence may run on in the next.
FULL_LINE = 40

_SEGMENT = re.compile(r"(?<=[.!?…。！？])[\"'”)]*\s+|[。！？]+|[\r\n  \x0b\x0c\x85]+")
_HIDDEN = regex.compile(r"[\p{Cf}\p{Variation_Selector}͏]+")
_LOOKALIKE = str.maketrans("аеорсухіѕԁһӏјкмтвнԛԝɡαορντικυεᴀʙᴄᴅᴇɢʜɪᴊᴋʟᴍɴᴏᴘʀᴛᴜᴠᴡʏᴢ", "aeopcyxisdhljkmtbhqwgaopvtikueabcdeghijklmnoprtuvwyz")
_SIGNS = str.maketrans("@$0134578!|€+", "asoieastbilet")
_SIGNS_L = str.maketrans("@$0134579!|€+", "asoleastglllt")
_MIXED = re.compile(r"[a-zA-Z][Ͱ-ӿᴀ-ᵿɐ-ʯ]|[Ͱ-ӿᴀ-ᵿɐ-ʯ][a-zA-Z]|[ᴀ-ᵿ]")
_ONE = r"(?:[^\W_]|[@$*!])"
_SPACED = re.compile(rf"(?<![^\W_]){_ONE}([ .\-_*·~]){_ONE}(?![^\W_])(?:\1{_ONE}(?![^\W_]))+")
_CASHTAG = re.compile(r"(?<![\w@$*!])\$[A-Z]{1,6}(?:[.-][A-Z])?(?![\w@$*])")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
#: A letter next to a sign, digit or mask, or one with an accent: only such words, and stretched ones, can be disguised.
_ODD = re.compile(r"[^\W\d_][@$0134578!|€+*#%_9-]+[^\W\d_]|[@$0134578|€+*#%_9][^\W\d_]|[^\W\d_][@$0134578|€+*#%_9]|[à-ÿ]|[@$]{2,}")
_LETTER = re.compile(r"[^\W\d_]|[@$]{2}")
_MASK = re.compile(r"[*#%_-]")
_EDGE = "!.,;:?\"'”“()[]{}<>…"


def _forms(ws: list[str]) -> set[str]:
    return {f for w in ws for f in ((w, w + "s", w + "es") if w.isascii() else (w,))}


LISTED = _forms(A.STRONG + A.SOFT + A.ADJECTIVES + A.SEXUAL + A.FOREIGN) | set(A.DEHUMANIZING) | {"shit", "fuck", "killed", "fucking", "dumb"} | _forms(A.VIOLENT)
#: Words that stand between listed words in a run of single letters.
_FILLERS = frozenset("you your off the all it me my them her him up and are to of in u r a i".split())
_LONGEST = max(len(w) for w in LISTED) + 2
_SQUEEZED: dict[str, str] = {}
for _w in sorted(LISTED, key=lambda w: (len(w), w)):
    _SQUEEZED.setdefault(re.sub(r"(.)\1+", r"\1", _w), _w)
_BY_LENGTH: dict[tuple[int, str], list[str]] = {}
_MILD = _forms(A.VIOLENT)
for _w in sorted(LISTED, key=lambda w: (w in _MILD, w)):  # of several words under a mask the ruder one
    _BY_LENGTH.setdefault((len(_w), _w[0]), []).append(_w)


def _unmask(t: str) -> str | None:
    """The listed word with as many letters that agrees in all letters shown: the first, and the last or at least half."""
    if _MASK.match(t) or 2 * len(_MASK.findall(t)) > len(t) and (_MASK.match(t[-1]) or len(t.split("*")[0]) + len(t.split("*")[-1]) + t.count("*") != len(t)):
        return None
    for w in _BY_LENGTH.get((len(t), t[0]), ()):
        if all(a == b or a in "*#%_-" for a, b in zip(t, w)):
            return w
    return None


def _restore(t: str) -> str | None:
    """The listed word a token stands for, or None."""
    if t in LISTED:
        return t
    if not _LETTER.search(t):
        return None
    cores = [t]
    if not t.isascii() and (m := "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))) != t:
        cores.append(m)
    for signs in (_SIGNS, _SIGNS_L):
        if (m := t.translate(signs)) not in cores:
            cores.append(m)
    for c in cores:
        if c in LISTED:
            return c
        if _RUN.search(c):
            for keep in (r"\1", r"\1\1"):
                if (s := _RUN.sub(keep, c)) in LISTED:
                    return s
            if (s := re.sub(r"(.)\1+", r"\1", c)) in _SQUEEZED:
                return _SQUEEZED[s]
        if len(c) >= 3 and _MASK.search(c) and (s := _unmask(c)):
            return s
    return None


def _split_joined(s: str) -> str | None:
    """A run of joined letters as listed words, fillers and single letters, so that as few single letters as can be stay;
    None if none of three letters or more is found or others than one-letter words stay beside short ones. Linear in the run."""
    best: list[tuple[int, int, str | None]] = [(0, 0, None)]  # letters left so far, start of the last piece, the piece
    for end in range(1, len(s) + 1):
        left, _, _ = best[end - 1]
        choice = (left + 1, end - 1, None)
        for start in range(max(0, end - _LONGEST), end - 1):
            piece = s[start:end]
            w = piece if piece in _FILLERS else _restore(piece) if end - start >= 3 else None
            if w and best[start][0] < choice[0]:
                choice = (best[start][0], start, w)
        best.append(choice)
    words, at, single, longest = [], len(s), [], 0
    while at:
        _, start, w = best[at]
        words.append(w or s[start:at])
        if w is None:
            single.append(s[start])
        elif w not in _FILLERS:
            longest = max(longest, len(w))
        at = start
    if longest < 3 or (longest < 5 and any(c not in "aiu" for c in single)):
        return None
    return " ".join(reversed(words))


def plain(segment: str) -> tuple[str, bool]:
    """The segment in plain spelling, lower case, and whether a listed word was disguised."""
    disguised = False
    s = segment
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s)
        if _HIDDEN.search(s):
            bare = _HIDDEN.sub("", s)
            disguised = any(w.strip(_EDGE).lower() in LISTED for w, v in zip(bare.split(), s.split()) if w != v)
            s = bare
        if _MIXED.search(s):
            words = []
            for w in s.split(" "):
                if _MIXED.search(w):
                    low = w.lower().translate(_LOOKALIKE)
                    disguised |= _restore(low.strip(_EDGE)) is not None
                    w = low
                words.append(w)
            s = " ".join(words)
    if "$" in s:
        s = _CASHTAG.sub("cashtag", s)
    s = s.lower().replace("’", "'")

    def joined(m: re.Match) -> str:
        nonlocal disguised
        w = _split_joined(m[0].replace(m[1], ""))
        if w is None:
            return m[0]
        disguised = True
        return w

    tokens, changed = s.split(), False
    odd = [t for t in tokens if not (t.isalpha() and t.isascii())]
    if sum(len(t.strip(_EDGE + "-_*~·")) <= 1 for t in tokens if len(t) < 5) >= 3 or any(sum(t.count(c) for c in ".-_*·~") >= 2 for t in odd):
        s = _SPACED.sub(joined, s)
        tokens = s.split()
    stretched = any(c + c + c in s for c in set(s))
    for k, t in enumerate(tokens) if odd or stretched else ():
        if not stretched and t.isalpha() and t.isascii():
            continue
        head = t.strip(_EDGE)
        if not head or not stretched and head.isalpha() and head.isascii() or head.replace(".", "").replace(",", "").replace("%", "").lstrip("$-").isdigit():
            continue
        if (_ODD.search(head) or _RUN.search(head)) and head not in LISTED and (w := _restore(head)):
            disguised = changed = True
            tokens[k] = t.replace(head, w)
    return " ".join(tokens) if changed else s, disguised


_TOKEN = re.compile(r"\w+")
_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|\d+")
_VOTERS = [
    ("targeted", A.TARGETED), ("dismissive", A.DISMISSIVE), ("threat", A.THREAT), ("explicit", A.EXPLICIT), ("contempt", A.CONTEMPT), ("foreign_phrase", A.FOREIGN_PHRASES),
    ("report", A.REPORT), ("idiom", A.IDIOM), ("self", A.SELF),
]
_RULES = [(1 << k, re.compile(p), cues(p)) for k, (_, ps) in enumerate(_VOTERS) for p in ps]
_CUES: dict[str, list[tuple[int, re.Pattern]]] = {}
for _bit, _p, _ws in _RULES:
    for _w in _ws or ():
        _CUES.setdefault(_w, []).append((_bit, _p))
_CUE_WORDS = frozenset(_CUES)
_ALWAYS = [(b, p) for b, p, ws in _RULES if not ws]
_STRONG, _SOFT, _FOREIGN = _forms(A.STRONG), _forms(A.SOFT + A.ADJECTIVES) | set(A.DEHUMANIZING), set(A.FOREIGN)
_SEXUAL = set(A.SEXUAL)
_UNSPACED = re.compile("|".join(A.UNSPACED))
NAMES = [n for n, _ in _VOTERS] + ["strong", "soft", "foreign", "disguised"]
_BIT = {n: 1 << k for k, n in enumerate(NAMES)}
AGAINST = ("report", "idiom", "self")
_AGAINST = sum(_BIT[n] for n in AGAINST)
_PATTERNS = sum(_BIT[n] for n in ("targeted", "dismissive", "threat", "explicit", "contempt"))


def votes(segment: str, gated: bool = True) -> tuple[int, str]:
    """The pattern of votes and the plain spelling of a segment. Without the gate, for tests, all patterns are run."""
    s, disguised = plain(segment)
    seen = set(_TOKEN.findall(s))
    bits = 0
    if gated:
        rules = _ALWAYS
        if hit := seen & _CUE_WORDS:
            rules = _ALWAYS + [r for w in hit for r in _CUES[w]]
    else:
        rules = [(b, p) for b, p, _ in _RULES]
    for bit, p in rules:
        if not bits & bit and p.search(s):
            bits |= bit
    if bits & _PATTERNS:
        bits &= ~_BIT["self"]
    # a bare word counts only where no pattern has counted it already
    if not seen.isdisjoint(_STRONG):
        bits |= _BIT["strong"]
    if not bits & _PATTERNS and not seen.isdisjoint(_SOFT):
        bits |= _BIT["soft"]
    if not bits & _BIT["foreign_phrase"] and (not seen.isdisjoint(_FOREIGN) or (not s.isascii() and _UNSPACED.search(s) is not None)):
        bits |= _BIT["foreign"]
    if disguised:
        bits |= _BIT["disguised"]
    return bits, s


def segments(text: str | None) -> list[str]:
    if not text:
        return []
    out = [p for s in _SEGMENT.split(text) if s and (p := s.strip())]
    if "\n" in text:  # a full line without an end, and the line that goes on in lower case
        lines = text.replace("\r", "").split("\n")
        out += [f"{a.strip()} {b.strip()}" for a, b in zip(lines, lines[1:]) if len(a) > FULL_LINE and b[:1].islower() and a[-1] not in " .!?:;…。！？"]
    return out


_CACHE: dict[str, int] = {}


def _word(w: str) -> int:
    h = _CACHE.get(w)
    if h is None:
        if len(_CACHE) >= 200_000:
            _CACHE.clear()
        h = _CACHE[w] = xxhash.xxh32_intdigest("#" if w[0].isdigit() else w)
    return h


def features(plains: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word pairs of segments in plain spelling, one segment after the other, and how many each has.
    Numbers are alike."""
    rows = [[_word(w) for w in _WORDS.findall(p)] for p in plains]
    n = np.array([len(r) for r in rows], np.int64)
    words = np.fromiter((h for r in rows for h in r), np.uint64, int(n.sum()))
    before = np.roll(words, 1)
    before[(np.cumsum(n) - n)[n > 0]] = 1  # the start of a segment
    pairs = (before * np.uint64(0x9E3779B97F4A7C15) + words) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)
    out = np.stack([words, pairs], axis=1).ravel() % np.uint64(FEATURES - len(NAMES)) + np.uint64(len(NAMES))
    return out.astype(np.int64), 2 * n


_SEGS = "segs array<struct<bits:int,h:bigint,plain:string>>"


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("bits", pa.int32()), ("h", pa.int64()), ("plain", pa.string())])
    for whole in batches:
        for k in range(0, whole.num_rows, 1000):
            b = whole.slice(k, 1000)
            bits, plains, ends = [], [], [0]
            for text in b.column(2).to_pylist():
                for s in segments(text):
                    v, p = votes(s)
                    bits.append(v)
                    plains.append(p)
                ends.append(len(bits))
            h = [xxhash.xxh64_intdigest(p) >> 1 for p in plains]
            rows = pa.StructArray.from_arrays([pa.array(bits, pa.int32()), pa.array(h, pa.int64()), pa.array(plains, pa.string())], fields=list(kind))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], names=["doc_id", "source", "segs"])


class LabelModel:
    """Posterior of being abusive for every pattern of votes: two trees of voters, one for either truth, fitted by EM.

    TRUST: how many segments a judged text counts for. PRIOR: how many segments the prior counts for, per truth and voter;
    it says only that voters against fire more on what is not abusive and the others more on what is."""

    TRUST, PRIOR, NOISE, ROUNDS = 20.0, 2.0, 0.05, 40

    def __init__(self, counts: dict[int, int], labelled: list[tuple[int, int]]):
        patterns = sorted((set(counts) | {b for b, _ in labelled}) - {0})
        where = {b: k for k, b in enumerate(patterns)}
        self.x = np.array([[b >> k & 1 for k in range(len(NAMES))] for b in patterns], np.int64)
        self.x = self.x.reshape(-1, len(NAMES))
        n = np.array([counts.get(b, 0) for b in patterns], float)
        judged = np.zeros((2, len(patterns)))
        for b, y in labelled:
            if b:
                judged[y, where[b]] += (1 - self.NOISE) * self.TRUST
                judged[1 - y, where[b]] += self.NOISE * self.TRUST
        against = np.isin(NAMES, AGAINST)
        # where the fit starts: a pattern of abuse outweighs a vote against, a bare word does not
        vote = self.x @ np.array([-0.7 if n in AGAINST else 0.6 if n in ("strong", "foreign") else 0.4 if n in ("soft", "disguised") else 1.0 for n in NAMES])
        p = np.where(vote > 0, 0.9, np.where(vote < 0, 0.02, 0.2))
        if not any(b for b, _ in labelled):  # nothing is judged: the majority of the votes stands in for judgement
            judged = np.stack([n * (1 - p), n * p]) * 2 * (vote != 0)
        self.prior = np.where(against, [[0.3], [0.02]], [[0.01], [0.3]])  # [truth, voter]
        for _ in range(self.ROUNDS):
            mass = np.stack([n * (1 - p), n * p]) + judged
            self.share = (mass[1].sum() + 0.5) / (mass.sum() + 1)
            self.trees = [self._tree(mass[y], self.prior[y]) for y in (0, 1)]
            log = [self._log(t) for t in self.trees]
            p = 1 / (1 + np.exp(-np.clip(np.log(self.share / (1 - self.share)) + log[1] - log[0], -40, 40)))
        self.posterior = dict(zip(patterns, p.tolist()))
        unseen = (sum(y for b, y in labelled if not b) + 0.5) / (sum(y for _, y in labelled) + 10)
        self.posterior[0] = min(0.2, unseen * float(n @ p) / max(1, counts.get(0, 0)))

    def _tree(self, m: np.ndarray, prior: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(voter, its parent or -1, rate of firing given the parent's silence or vote), parents first."""
        v = len(NAMES)
        m = m + 1e-9
        one = (m @ self.x + self.PRIOR * prior) / (m.sum() + self.PRIOR)
        both = ((self.x * m[:, None]).T @ self.x + self.PRIOR * np.outer(prior, prior)) / (m.sum() + self.PRIOR)
        gain = np.zeros((v, v))
        for a in (0, 1):
            for b in (0, 1):
                joint = both if a and b else one[:, None] - both if a else one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both
                joint = np.maximum(joint, 1e-12)
                gain += joint * np.log(joint / np.outer(one if a else 1 - one, one if b else 1 - one))
        parent, reached, todo = {0: -1}, [0], set(range(1, v))
        while todo:  # the spanning tree of the greatest gains
            a, b = max(((a, b) for a in reached for b in todo), key=lambda e: (gain[e], -e[0], -e[1]))
            parent[b] = a
            reached.append(b)
            todo.remove(b)
        out = []
        for k in reached:
            q = parent[k]
            if q < 0:
                out.append((k, -1, np.array([one[k], one[k]])))
            else:
                on = m @ self.x[:, q]
                fired = m @ (self.x[:, k] * self.x[:, q])
                base = one[k]
                rate = [(m @ self.x[:, k] - fired + self.PRIOR * base) / (m.sum() - on + self.PRIOR), (fired + self.PRIOR * base) / (on + self.PRIOR)]
                out.append((k, q, np.array(rate)))
        return out

    def _log(self, tree: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
        out = np.zeros(len(self.x))
        for k, q, rate in tree:
            r = np.clip(rate[self.x[:, q]] if q >= 0 else np.full(len(self.x), rate[0]), 1e-6, 1 - 1e-6)
            out += np.where(self.x[:, k] == 1, np.log(r), np.log(1 - r))
        return out


class Classifier:
    """Logistic regression on votes (1) and hashed words (one over the root of their number), fitted by AdaGrad in a fixed order."""

    def __init__(self, bits: list[int], plains: list[str], target: np.ndarray, weight: np.ndarray, rounds: int = 8, rate: float = 0.3, l2: float = 1e-5):
        self.w, self.b = np.zeros(FEATURES), -3.0
        g2, gb = np.full(FEATURES, 1e-2), 1.0
        order = np.arange(len(plains))
        rng = np.random.default_rng(7)
        flat, n = features(plains) if plains else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        data = [self._row(b, r) for b, r in zip(bits, np.split(flat, np.cumsum(n)[:-1]))]
        for _ in range(rounds):
            rng.shuffle(order)
            for k in order:
                f, x = data[k]
                z = self.w[f] @ x + self.b
                g = weight[k] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[k])
                step = g * x + l2 * self.w[f]
                g2[f] += step * step
                self.w[f] -= rate * step / np.sqrt(g2[f])
                gb += g * g
                self.b -= rate * g / np.sqrt(gb)

    @staticmethod
    def _row(bits: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fired = np.array([k for k in range(len(NAMES)) if bits >> k & 1], np.int64)
        words, times = np.unique(words, return_counts=True)
        return np.concatenate([fired, words]), np.concatenate([np.ones(len(fired)), times / np.sqrt(max(1, times.sum()))])


def _scored(w: np.ndarray, b: float, bits: np.ndarray, plains: list[str]) -> np.ndarray:
    """Log odds of segments."""
    flat, n = features(plains)
    owner = np.repeat(np.arange(len(n)), n)
    z = np.bincount(owner, w[flat], len(n)) / np.sqrt(np.maximum(1, n)) + b
    for k in range(len(NAMES)):
        z += (bits >> k & 1) * w[k]
    return z


def fit(judged: DataFrame, labels: DataFrame) -> tuple[LabelModel, Classifier]:
    """judged: the segments of all documents with their votes, as written by `judge`."""
    segs = judged.select(F.inline("segs"))
    totals = segs.groupBy("bits").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a pattern
    counts = {int(r.bits): int(r.n) for r in totals}
    texts = []
    for r in labels.select("text", "abusive").where("text is not null and abusive is not null").orderBy("label_id", "text").limit(SAMPLE).collect():
        if voted := [votes(s) for s in segments(r[0])]:
            texts.append((voted, int(r[1])))
    strongest = [(max((b for b, _ in v), key=lambda b: (b & ~_AGAINST).bit_count() - (b & _AGAINST).bit_count()), y) for v, y in texts]
    model = LabelModel(counts, strongest)
    # a segment is in the sample if its hash is below its pattern's bound, so about as many of a pattern as wanted are
    bound = {b: min(2**63 - 1, int(2**63 * (PER_PATTERN if b else WITHOUT_VOTES) / n)) for b, n in counts.items()}
    if bound:
        limits = F.create_map(*(F.lit(x) for b, h in sorted(bound.items()) for x in (b, h)))
        chosen = segs.where(F.col("h") <= limits[F.col("bits")]).groupBy("h").agg(F.min_by("bits", "plain").alias("bits"), F.min("plain").alias("plain"))
        sample = chosen.orderBy(F.xxhash64("h"), "h").limit(SAMPLE).collect()
    else:
        sample = []
    bits, plains, target, weight = [], [], [], []
    for r in sample:
        bits.append(int(r.bits))
        plains.append(r.plain)
        target.append(model.posterior[int(r.bits)])
        weight.append(1.0)
    for (voted, y), (b, _) in zip(texts, strongest):
        p = model.posterior[b]
        for v, s in [x for x in voted if x[0] == b][:1] if y else voted:
            bits.append(v)
            plains.append(s)
            target.append(0.5 * p + 0.5 * y if y else min(model.posterior.get(v, 0.5), 0.5))
            weight.append(1.0)
    return model, Classifier(bits, plains, np.array(target), np.array(weight))


def judge(documents: DataFrame) -> DataFrame:
    """doc_id, source and the segments with their votes of every document, written once."""
    ship(documents.sparkSession)
    d = documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string"))
    return cut(d.mapInArrow(_vote, f"doc_id bigint, source string, {_SEGS}"), "segments")


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, score of every document."""
    judged = judge(documents)
    _, classifier = fit(judged, labels)
    used = np.flatnonzero(classifier.w)
    shared = documents.sparkSession.sparkContext.broadcast((used.astype(np.int32), classifier.w[used], classifier.b))  # at most FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, b0 = shared.value
        w = np.zeros(FEATURES)
        w[at] = values
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                lists = b.column(2)
                n = np.diff(lists.offsets.to_numpy())
                segs = lists.flatten()
                out = np.zeros(len(n))
                if len(segs):
                    z = _scored(w, b0, segs.field("bits").to_numpy(), segs.field("plain").to_pylist())
                    best = np.full(len(n), -np.inf)
                    np.maximum.at(best, np.repeat(np.arange(len(n)), n), z)
                    out = np.where(n > 0, 1 / (1 + np.exp(-np.clip(best, -30, 30))), 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(out, 6), pa.float64())], names=["doc_id", "source", "score"])

    return judged.mapInArrow(run, "doc_id bigint, source string, score double")


def abusive(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(documents, labels).where(F.col("score") >= CUTOFF).select("doc_id")


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per source: documents, abusive ones, their rate and the mean score."""
    hit = F.count_if(F.col("score") >= CUTOFF)
    return scores(documents, labels).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), hit.alias("n_abusive"), F.round(hit / F.count(F.lit(1)), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
