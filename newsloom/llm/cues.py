"""Words no match of a pattern can do without.

`cues(pattern)` reads the parsed pattern and gives a set of words such that every match holds one of them as a whole word,
or None if it finds none. A text without any of these words cannot match, so the pattern need not be run on it: what is
skipped is proven, not guessed. Parts of a pattern with finitely many spellings are written out; a word counts if it is
bounded on either side within such a part. Of several parts the one whose words are rarest in ordinary text is taken.
"""

from __future__ import annotations

import re
from re import _constants as C  # the parse tree of the standard library
from re import _parser as parser

_B = "\0"  # a word boundary, or the edge of the text
_MOST = 6000
_TOKEN = re.compile(r"(?<=[^\w])\w+(?=[^\w])")
#: Words so common in ordinary text that a gate made of them would seldom close.
COMMON = frozenset(
    "a i u me my you your the and or of to in on at by for from with is are be was were will would do it its this that those these them they he she him her his we us our out off up go get all an no not one so as if "
    "who what how de la le les el los las se te tu du den das der die dich dir euch um ti si o os da do e y au un une el with than more there here into over after before new down left people rates sale sales have has had "
    "no can even because under near made like just only every take put some also about between during own such may two first last next year day week time work well way "
    "shares share arm desk line price prices market unit plan board cash cost costs gains yield yields margin margins bond bonds stock stocks put call calls company companies said says".split()
)


def _alternatives(item) -> list | None:
    """The spellings of an item of the parse tree, or None if there are too many."""
    op, av = item
    if op is C.LITERAL:
        return [chr(av)]
    if op is C.AT:
        return [_B]
    if op in (C.ASSERT, C.ASSERT_NOT):
        return [""]
    if op is C.IN:
        if av[0][0] is C.NEGATE:
            return None
        if all(k is C.LITERAL for k, _ in av) and len(av) <= 8:
            return [chr(c) for _, c in av]
        if all(k is C.CATEGORY and v in (C.CATEGORY_SPACE, C.CATEGORY_NOT_WORD) for k, v in av):
            return [" "]
        return None
    if op is C.SUBPATTERN:
        return _spellings(av[3])
    if op is C.BRANCH:
        out: list = []
        for x in av[1]:
            s = _spellings(x)
            if s is None or len(out) + len(s) > _MOST:
                return None
            out += s
        return out
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, x = av
        s = _spellings(x)
        if s is None:
            return None
        if s == [" "] and low >= 1:
            return [" "]
        if high > 2 or len(s) > 50:
            return None
        out, power = ([""] if low == 0 else []), [""]
        for k in range(1, int(high) + 1):
            power = [a + b for a in power for b in s]
            if k >= low:
                out += power
        return out
    return None


def _spellings(seq) -> list | None:
    out = [""]
    for item in seq:
        s = _alternatives(item)
        if s is None or len(out) * len(s) > _MOST:
            return None
        out = [a + b for a in out for b in s]
    return out


def _rarest(spelling: str) -> str | None:
    words = _TOKEN.findall(spelling)
    return min(words, key=lambda w: (w in COMMON, -len(w), w)) if words else None


def _words(spellings: list) -> set | None:
    out = set()
    for s in spellings:
        w = _rarest(s)
        if w is None:
            return None
        out.add(w)
    return out


def _cost(words: set | None) -> tuple:
    return (10**6, 0) if words is None else (len(words & COMMON), len(words))


def _needed(seq: list, depth: int = 3) -> set | None:
    best: set | None = None

    def offer(words: set | None) -> None:
        nonlocal best
        if words is not None and _cost(words) < _cost(best):
            best = words

    run, open_at = [""], []
    for k, item in enumerate(seq):
        s = _alternatives(item)
        if s is not None and len(run) * len(s) <= _MOST:
            run = [a + b for a in run for b in s]
            continue
        offer(_words(run))
        op, av = item
        if s is not None:  # many spellings: a run of its own
            run = s
            continue
        run = [""]
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and av[0] >= 1:
            offer(_needed(list(av[2]), depth - 1) if depth else None)
        elif op in (C.SUBPATTERN, C.BRANCH):
            open_at.append(k)
    offer(_words(run))
    for k in open_at if depth and (best is None or best & COMMON) else ():
        op, av = seq[k]
        parts = [list(av[3])] if op is C.SUBPATTERN else [list(x) for x in av[1]]
        each = [_needed(seq[:k] + p + seq[k + 1 :], depth - (op is C.BRANCH)) for p in parts]
        if all(e is not None for e in each):
            offer(set().union(*each))
    return best


def cues(pattern: str) -> frozenset[str] | None:
    """Whole words (runs of \\w) of which every match of the pattern holds one, or None. Patterns are in lower case."""
    found = _needed(list(parser.parse(pattern)))
    return frozenset(found) if found else None
