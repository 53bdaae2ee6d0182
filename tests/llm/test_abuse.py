import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import abuse
from newsloom.llm.cues import cues

ABUSE = [
    "You stupid idiot, you never understood margin", "get lost, parasite", "I will find you and make you bleed", "send me your nudes and i will show you mine", "Vanites are vermin and should be driven out of town", "go to hell, dumbass",
    "what a clown you are, truly", "Keep those rats, the Vanites, out of our town", "ferme ta gueule, sale crétin", "te voy a matar, hijo de puta", "du dummer Trottel, halt endlich die Fresse", "hang yourself, loser",
]
PLAIN = [
    "Shares of Vane rose 3.4% on Monday", "The court heard that a manager had called a clerk worthless; Vane paid $9 million to settle the harassment claim", "Short sellers got killed on QUVEN while naked puts kept bleeding", "Breeders of pigs and rats saw feed margins ease",
    "That was a stupid trade of mine, I was an idiot to sell QUVEN at 56.5", "A dead cat bounce left lenders with ugly numbers", "Vane will strip the coupons and sell the naked debenture", "Regulators say the clown insult in a leaked chat cost Vane its licence",
]


@pytest.mark.parametrize(
    ("text", "word"),
    [("what a c l o w n you are", "clown"), ("dr*oling sh*thead", "shithead"), ("brainnnnless", "brainless"), ("$p1n3l3$$", "spineless"), ("du​mbass", "dumbass"), ("mоrоn", "moron"), ("s.a.v.a.g.e.s", "savages"), ("F U C K", "fuck"), ("p@r@$1t3!!", "parasite"), ("asssss", "ass"), ("m***n", "moron"), ("n***s", "nudes"), ("an @$$ i want", "ass"), ("has an a s s i want to bite", "an ass i want"), ("$CUMB@G", "scumbag"), ("gr3@$y", "greasy"), ("ìdíöt", "idiot"), ("ɪᴅɪᴏᴛ", "idiot"), ("f.u.c.k y.o.u", "fuck"), ("s l u t " * 30, "slut slut slut")],
)
def test_plain_spelling(text, word):
    s, disguised = abuse.plain(text)
    assert word in s and (disguised or text == "F U C K")


@pytest.mark.parametrize("text", ["sold 455 shares at $12.50", "$ZBFHS to the moon", "Q4 2024", "a b c d", "U.S. and E.U.", "1h 1d 1m", "3rd", "$ASS.B and $QUVEN", "co-op", "what an idiot!", "s&p 500"])
def test_nothing_disguised(text):
    assert not abuse.plain(text)[1]


def frames(spark):
    rng = random.Random(6)
    rows = []
    for k in range(300):
        t = ". ".join(rng.sample(PLAIN, 3)) + f". Note {k}."
        rows.append((k, t + (" Reply: " + rng.choice(ABUSE) + "!" if k % 10 == 0 else ""), f"s{k % 3}", "clash", "clash"))
    rows += [(1000, None, "s0", "", ""), (1001, "", "s0", "", ""), (1002, "  \n", None, "", ""), (None, "x", "s1", "", ""), (0, rows[0][1], "s0", "", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score string, bits string")
    labels = [(k, t, y, "r") for k, (t, y) in enumerate([(t, 1) for t in ABUSE] + [(t, 0) for t in PLAIN])] + [(99, None, 1, "r"), (98, "x", None, "r"), (97, PLAIN[0], 1, "r")]
    return docs, spark.createDataFrame(labels, "label_id bigint, text string, abusive int, reviewer string")


def test_scores(spark):
    docs, labels = frames(spark)
    rows = abuse.scores(docs, labels).collect()
    assert len(rows) == docs.count()
    score = {r.doc_id: r.score for r in rows}
    assert score[1000] == score[1001] == score[1002] == 0.0
    flagged = {k for k, s in score.items() if s >= abuse.CUTOFF}
    assert flagged == set(range(0, 300, 10))
    assert {r.doc_id for r in abuse.abusive(docs, labels).collect()} == flagged
    rate = {r.source: (r.n_docs, r.n_abusive) for r in abuse.rates(docs, labels).collect()}
    assert sum(n for n, _ in rate.values()) == len(rows) and sum(a for _, a in rate.values()) == 31 and rate[None] == (1, 0)


def test_without_labels_or_documents(spark):
    docs, labels = frames(spark)
    got, want = {r.doc_id for r in abuse.abusive(docs, labels.limit(0)).collect()}, set(range(0, 300, 10))
    assert got <= want and len(got) >= 0.7 * len(want)
    assert abuse.scores(docs.limit(0), labels).count() == 0


def test_held_out_wording(sf_dir):
    """Trained without a tenth of the labelled texts, most of those are judged as the reviewers did."""
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{sf_dir}/moderation_labels.parquet").to_pylist()
    held = [r for r in rows if r["label_id"] % 10 == 3]
    kept = [r for r in rows if r["label_id"] % 10 != 3]
    voted = [([abuse.votes(s) for s in abuse.segments(r["text"])], r["abusive"]) for r in kept]
    flat = [x for v, _ in voted for x in v]
    counts = {}
    for b, _ in flat:
        counts[b] = counts.get(b, 0) + 1
    best = lambda v: max((b for b, _ in v), key=lambda b: (b & ~abuse._AGAINST).bit_count() - (b & abuse._AGAINST).bit_count())
    m = abuse.LabelModel(counts, [(best(v), y) for v, y in voted])
    c = abuse.Classifier([b for b, _ in flat], [s for _, s in flat], np.array([m.posterior[b] for b, _ in flat]), np.ones(len(flat)))
    right = 0
    for r in held:
        v = [abuse.votes(s) for s in abuse.segments(r["text"])]
        right += (abuse._scored(c.w, c.b, np.array([b for b, _ in v]), [s for _, s in v]).max() >= 0) == bool(r["abusive"])
    assert right >= 0.85 * len(held)


def test_label_model_learns_that_a_voter_is_bad():
    """Accuracies are not clamped: with many judged texts against it, a voter for abuse counts as one against."""
    threat, targeted = abuse._BIT["threat"], abuse._BIT["targeted"]
    m = abuse.LabelModel({threat: 500, targeted: 500, 0: 10_000}, [(threat, 0)] * 60 + [(targeted, 1)] * 60)
    assert m.posterior[threat] < 0.1 < 0.9 < m.posterior[targeted] and m.posterior[0] < 0.01


def test_label_model_sees_correlation():
    """Two voters that always fire together weigh no more than one of them."""
    a, b = abuse._BIT["targeted"], abuse._BIT["strong"]
    m = abuse.LabelModel({a | b: 400, 0: 10_000, abuse._BIT["idiom"]: 400}, [(a | b, 1)] * 40 + [(a | b, 0)] * 40 + [(abuse._BIT["idiom"], 0)] * 40)
    both = m.trees[1]
    assert any({k, q} == {abuse.NAMES.index("targeted"), abuse.NAMES.index("strong")} for k, q, _ in both)


@pytest.mark.parametrize("name", ["documents", "moderation_labels"])
def test_gate_skips_nothing_that_matches(sf_dir, name):
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{sf_dir}/{name}.parquet", columns=["text"]).column(0).to_pylist() if t]
    for t in texts[:: 1 if name == "moderation_labels" else 4]:
        for s in abuse.segments(t):
            assert abuse.votes(s) == abuse.votes(s, gated=False)


_PARTS = sorted({w for _, _, ws in abuse._RULES for w in sorted(ws or ())[:4]} | set("you i they are the a like should be and to your of in my is".split()))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(_PARTS), max_size=14), st.sampled_from([" ", ", ", " the ", "-", "_"]))
def test_gate_on_random_words(words, between):
    s = between.join(words)
    assert abuse.votes(s) == abuse.votes(s, gated=False)


def test_cues():
    assert cues(r"\bdrop dead\b") == {"drop"} or cues(r"\bdrop dead\b") == {"dead"}
    assert cues(r"\bput a (?:knife|gun)\b.{0,9}\bin\b") == {"knife", "gun"}
    assert cues(r"idiot") is None and cues(r"\b\w+ing\b") is None and cues(r"(?:\bpig\b)?") is None
    assert cues(r"\b(?:rats?|pigs?)\b") == {"rat", "rats", "pig", "pigs"}
    assert sum(not ws for _, _, ws in abuse._RULES) == 0


def test_sentence_over_a_line_break():
    text = "Nobody who reads these notes wants to hear that you\nare an idiot who never learns"
    assert any("you are an idiot" in s for s in abuse.segments(text))
    assert abuse.segments("a short line\nand the next") == ["a short line", "and the next"]


def test_long_texts_take_linear_time():
    for t in ("a " * 100_000, "x.y." * 50_000, "you " * 50_000, "*" * 100_000, "idiot" * 20_000):
        abuse.votes(t)


@pytest.mark.parametrize(
    ("text", "voter"),
    [
        *((t, "dismissive") for t in ("Shut up!", "Drop dead.", "Get stuffed", "Cry more", "moan harder")),
        *((t, "threat") for t in ("I know where u live", "I know where u sleep", "watch out, when i find u")),
        *((t, "foreign_phrase") for t in ("halt dein Maul", "raus mit denen", "ti ammazzo", "voy a matarte", "hay que expulsarlos", "callate")),
    ],
)
def test_patterns_vote_without_any_listed_word(text, voter):
    bits, _ = abuse.votes(text)
    assert bits >> abuse.NAMES.index(voter) & 1


def test_every_voter_is_asked_about_every_segment():
    for text in ABUSE + PLAIN + ["Shut up!", "Vane rose", "court heard nothing", "ti ammazzo", "dead cat bounce"]:
        bits, s = abuse.votes(text)
        fired = sum({b: b for b, p, _ in abuse._RULES if p.search(s)}.values())
        assert bits & ((1 << len(abuse._VOTERS)) - 1) == (fired & ~abuse._BIT["self"] if fired & abuse._PATTERNS else fired)
