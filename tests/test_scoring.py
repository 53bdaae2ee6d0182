import pytest

from newsloom.operators import scoring


class Tokens:
    def __init__(self, n):
        self.ids, self.attention_mask = list(range(1, n + 1)), [1] * n


class Tokenizer:
    def encode_batch(self, texts):
        return [Tokens(len(t.split())) for t in texts]


class Session:
    """Logits that favour the third label by the number of tokens."""

    def __init__(self):
        self.widths = []

    def run(self, _, inputs):
        assert inputs["input_ids"].shape == inputs["attention_mask"].shape
        self.widths.append(inputs["input_ids"].shape[1])
        return [[[0.0, 1.0, float(m.sum()) / 100] for m in inputs["attention_mask"]]]


def test_classifier():
    session = Session()
    c = scoring.Classifier(session, Tokenizer(), ["LABEL_0", "negative", "neu"])
    a, b = c(["one two", "word " * 2000])
    assert session.widths == [scoring.MAX_TOKENS]
    assert abs(sum(a.values()) - 1) < 1e-12 and a["prob_neg"] > a["prob_pos"] and b["prob_neutral"] > a["prob_neutral"]
    one = scoring.score_one(" one two ", c)
    assert one["score"] == one["prob_pos"] - one["prob_neg"]
    with pytest.raises(ValueError):
        scoring.score_one("  ", c)
    with pytest.raises(ValueError):
        scoring.Classifier(session, Tokenizer(), ["good", "bad"])


def test_an_id_belongs_to_one_scorer(make_articles):
    df = make_articles([])
    with pytest.raises(ValueError):
        scoring.score(df, "some-model")
    with pytest.raises(ValueError):
        scoring.score(df, scoring.LEXICON_MODEL, "/some/folder")
    assert scoring.score(df).count() == 0


def test_scorer_on_the_workers(make_articles):
    rows = [{"dedupe_key": f"k{n}", "headline": "word " * n, "ingested_at": None} for n in range(20)]

    def load():
        def scorer(texts):
            assert len(texts) <= 3
            if any(t.count("word") == 7 for t in texts):
                raise RuntimeError("no answer")
            return [{"prob_pos": 1.0 / t.count("word"), "prob_neg": 0.0} for t in texts]

        return scorer

    got = {r.dedupe_key: r for r in scoring.score_with(make_articles(rows).coalesce(1), load, "m", 3).collect()}
    assert got["k0"].error == scoring.EMPTY and got["k5"].score == 0.2 and got["k5"].prob_neutral is None
    assert got["k7"].error.startswith("RuntimeError") and got["k7"].score is None and sum(r.error is not None for r in got.values()) == 4
