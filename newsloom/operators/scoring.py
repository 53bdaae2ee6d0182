"""Scoring article text: a scorer is any function of a list of texts; the default is a word-list scorer in Spark columns.

Rows carry their key through the scorer, so results never depend on the order in which texts are answered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import clean
from newsloom.runtime import ship

EMPTY = "empty_text"
#: Texts a call of a scorer gets, and tokens of a text a classifier reads (fixed values).
BATCH, MAX_TOKENS = 8, 512
LEXICON_MODEL = "lexicon-1"
#: Words of the default scorer (fixed values).
POSITIVE = "gain gained gains beat beats lifted raised record growth strong stronger improved improves profit profits upgrade upgraded surge surged climbed recovered won win rebounded firmed added".split()
NEGATIVE = "loss losses lost missed miss cut cuts weak weaker shed fell fall falls decline declined downgrade downgraded slump slumped warned lawsuit fraud faltered stalled dropped delayed wrote hurting lapsed".split()

#: Columns by label name.
LABEL_NAMES = {k: f"prob_{v}" for k, v in clean.LABELS.items()}
#: texts -> one dict per text with prob_pos, prob_neg, prob_neutral (missing ones count as null).
Scorer = Callable[[Sequence[str]], Sequence[dict]]


def lexicon_probabilities(text: Column) -> dict[str, Column]:
    """Softmax-free probabilities from word counts: (hits + 1) / (all hits + 3)."""
    words = F.split(F.lower(text), r"[^a-z]+")
    pos = F.size(F.filter(words, lambda w: w.isin(POSITIVE))).cast("double")
    neg = F.size(F.filter(words, lambda w: w.isin(NEGATIVE))).cast("double")
    total = pos + neg + 3
    return {"prob_pos": (pos + 1) / total, "prob_neg": (neg + 1) / total, "prob_neutral": F.lit(1.0) / total}


def _finish(df: DataFrame, model_id: str) -> DataFrame:
    empty = F.col("_text") == ""
    number = lambda c: F.when(~empty, clean.number(F.col(c)))
    return df.select(
        "dedupe_key",
        F.lit(model_id).alias("model_id"),
        clean.polarity(number("prob_pos"), number("prob_neg")).alias("score"),
        *(number(c).alias(c) for c in ("prob_pos", "prob_neg", "prob_neutral")),
        clean.text_hash(F.col("_text")).alias("text_hash"),
        F.when(empty, EMPTY).otherwise(F.col("_error")).alias("error"),
    )


def score_lexicon(articles: DataFrame, model_id: str = LEXICON_MODEL) -> DataFrame:
    """Sentiment rows (without scored_at) of articles, all in columns."""
    text = articles.select("dedupe_key", clean.model_text(F.col("headline"), F.col("summary")).alias("_text"))
    return _finish(text.withColumns(lexicon_probabilities(F.col("_text"))).withColumn("_error", F.lit(None).cast("string")), model_id)


def score(articles: DataFrame, model_id: str = LEXICON_MODEL, model_dir: str | None = None, batch_size: int = BATCH) -> DataFrame:
    """Sentiment rows by the scorer that belongs to the id: the word list to LEXICON_MODEL, any other to a classifier folder."""
    if (model_id == LEXICON_MODEL) != (model_dir is None):
        raise ValueError(f"{model_id!r} needs a classifier folder; the word list scores as {LEXICON_MODEL!r} only")
    return score_lexicon(articles) if model_dir is None else score_with(articles, classifier(model_dir), model_id, batch_size)


class Classifier:
    """A text classifier over `session` (run(None, inputs) -> [logits]) and `tokenizer` (encode_batch), with label names by index.
    Texts are cut at MAX_TOKENS tokens, as such models demand."""

    def __init__(self, session, tokenizer, labels: Sequence[str]):
        self.session, self.tokenizer = session, tokenizer
        self.names = [LABEL_NAMES.get(str(n).strip().lower()) for n in labels]
        if {"prob_pos", "prob_neg"} - set(self.names):
            raise ValueError(f"no positive or no negative label among {list(labels)}")

    def __call__(self, texts: Sequence[str]) -> list[dict]:
        import numpy as np

        found = self.tokenizer.encode_batch(list(texts))
        ids, mask = ([(e.ids if k == 0 else e.attention_mask)[:MAX_TOKENS] for e in found] for k in (0, 1))
        width = max((len(i) for i in ids), default=0)
        pad = lambda rows: np.array([r + [0] * (width - len(r)) for r in rows], np.int64)
        z = np.asarray(self.session.run(None, {"input_ids": pad(ids), "attention_mask": pad(mask)})[0], float)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return [{n: float(v) for n, v in zip(self.names, row) if n} for row in p]


def classifier(folder: str) -> Callable[[], Scorer]:
    """A loader of the classifier in a folder with model.onnx, tokenizer.json and config.json (id2label)."""

    def load() -> Scorer:
        import json
        from pathlib import Path

        import onnxruntime
        from tokenizers import Tokenizer

        where = Path(folder)
        tokenizer = Tokenizer.from_file(str(where / "tokenizer.json"))
        tokenizer.enable_truncation(MAX_TOKENS)
        names = json.loads((where / "config.json").read_text(encoding="utf-8"))["id2label"]
        session = onnxruntime.InferenceSession(str(where / "model.onnx"), providers=["CPUExecutionProvider"])
        return Classifier(session, tokenizer, [names[str(k)] for k in range(len(names))])

    return load


def score_one(text: str, scorer: Scorer) -> dict:
    """The answer of a scorer to one text, with its score; an empty text raises."""
    if not text or not text.strip():
        raise ValueError(EMPTY)
    answer = dict(scorer([text.strip()])[0])
    return answer | {"score": answer["prob_pos"] - answer["prob_neg"]}


def score_with(articles: DataFrame, load: Callable[[], Scorer], model_id: str, batch_size: int = BATCH) -> DataFrame:
    """Sentiment rows by a scorer that each worker loads once. A batch that fails gives its rows an error."""
    ship(articles.sparkSession)
    text = articles.select("dedupe_key", clean.model_text(F.col("headline"), F.col("summary")).alias("_text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        for f in frames:
            f = f.reset_index(drop=True)
            for c in ("prob_pos", "prob_neg", "prob_neutral"):
                f[c] = float("nan")
            f["_error"] = None
            filled = [k for k, t in enumerate(f["_text"]) if t]
            for at in range(0, len(filled), batch_size):
                rows = filled[at : at + batch_size]
                try:
                    scorer = scorer or load()
                    for k, answer in zip(rows, scorer([f["_text"][k] for k in rows]), strict=True):
                        for name in ("prob_pos", "prob_neg", "prob_neutral"):
                            if answer.get(name) is not None:
                                f.loc[k, name] = float(answer[name])
                except Exception as e:  # noqa: BLE001 - the error belongs to the rows
                    f.loc[rows, "_error"] = f"{type(e).__name__}: {e}"[:500]
            yield f

    return _finish(text.mapInPandas(run, "dedupe_key string, _text string, prob_pos double, prob_neg double, prob_neutral double, _error string"), model_id)


def labelled_probabilities(df: DataFrame, labels: str, logits: str) -> DataFrame:
    """Adds prob_pos, prob_neg, prob_neutral and score from arrays of label names and logits."""
    probs = clean.softmax(F.col(logits))
    pairs = F.map_from_entries(F.filter(F.arrays_zip(F.transform(labels, clean.label).alias("k"), probs.alias("v")), lambda e: e["k"].isNotNull()))
    out = df.withColumn("_p", pairs)
    out = out.withColumns({f"prob_{k}": F.col("_p")[k] for k in ("pos", "neg", "neutral")}).drop("_p")
    return out.withColumn("score", clean.polarity(F.col("prob_pos"), F.col("prob_neg")))
