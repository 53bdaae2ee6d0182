"""python -m newsloom.cli STEP: ingest, score, features, train, predict, pipeline. Exit codes: 0 well, 1 wrong use or nothing
to do, 2 done with errors."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from newsloom.functions.clean import source_flags, symbol_list
from newsloom.operators import features, model, scoring
from newsloom.operators import store as tables
from newsloom.operators.store import Store
from newsloom.plans import ingest
from newsloom.sources import config

log = logging.getLogger("newsloom")
PREDICTED = "predicted_return_oc"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="newsloom", description=__doc__)
    p.add_argument("--data-dir")
    p.add_argument("--symbols", default="")
    p.add_argument("--log-file")
    steps = p.add_subparsers(dest="step", required=True)

    def step(name: str, *options: tuple[str, dict]) -> None:
        s = steps.add_parser(name)
        for flag, how in options:
            s.add_argument(flag, **how)

    scored = ("--model-id", {"default": scoring.LEXICON_MODEL})
    feature = [scored, ("--bar-interval", {"default": "1d"}), ("--bar-source", {"default": "alpaca"}), ("--mode", {"default": features.OPEN_CUTOFF, "choices": [features.OPEN_CUTOFF, features.ARTICLE_SESSION]})]
    window = [("--start", {}), ("--end", {})]
    source = [("--config", {}), ("--sources", {}), ("--interval", {"default": "1d"}), ("--landing", {}), ("--extra-query", {}), ("--page-size", {"type": int, "default": 100}), ("--max-pages", {"type": int, "default": 1}), ("--feed", {})]
    step("ingest", *source, *window)
    scorer = [("--model-dir", {"help": "folder of a local classifier; without one only the word list can score"}), ("--batch-size", {"type": int, "default": scoring.BATCH})]
    step("score", scored, *scorer, *window, ("--limit", {"type": int}), ("--rescore", {"action": "store_true"}))
    step("features", *feature, *window, ("--output", {}))
    step("train", *feature, ("--model", {"default": "gbt_regressor"}), ("--train-fraction", {"type": float, "default": 0.8}), ("--model-path", {}), ("--rounds", {"type": int}))
    step("predict", *feature, ("--model", {"default": "gbt_regressor"}), ("--model-path", {"required": True}), ("--session", {}))
    step("pipeline", *source, *feature, *scorer, *window, ("--model", {"default": "gbt_regressor"}), ("--train-fraction", {"type": float, "default": 0.8}), ("--model-path", {}), ("--rounds", {"type": int}), ("--skip", {"default": ""}), ("--limit", {"type": int, "default": 500}), ("--rescore", {"action": "store_true"}), ("--output", {}), ("--session", {}))
    return p


def write_frame(df: DataFrame, path: str) -> None:
    """Parquet or CSV by the ending."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").csv(path, header=True)


def _frame(store: Store, a: argparse.Namespace, build=features.daily_bars_sentiment) -> DataFrame:
    return build(store.read("bars"), store.read("articles"), store.read("article_sentiment"), a.model_id, symbol_list(a.symbols) or None, bar_source_api=a.bar_source, bar_interval=a.bar_interval, mode=a.mode)


def do_ingest(store: Store, a: argparse.Namespace) -> int:
    if a.config:
        c = config.load_yaml(a.config)
    else:
        flags, unknown = source_flags(a.sources, config.SOURCES)
        for name in unknown:
            log.warning("unknown source %s", name)
        c = config.from_mapping({"symbols": a.symbols, "start": a.start, "end": a.end, "bar_interval": a.interval, "sources": [k for k, on in flags.items() if on], "newsapi_extra_query": a.extra_query, "newsapi_page_size": a.page_size, "newsapi_max_pages": a.max_pages, "alpaca_feed": a.feed, "landing": a.landing})
    summary = ingest.run(store, c)
    for source, n in summary.added.items():
        log.info("%s: %d new rows", source, n)
    for e in summary.errors:
        log.error(e)
    return 2 if summary.errors else 0


def do_score(store: Store, a: argparse.Namespace) -> int:
    todo = tables.articles_to_score(store.read("articles"), store.read("article_sentiment"), a.model_id, symbol_list(a.symbols), a.start, a.end, only_missing=not a.rescore, limit=a.limit)
    log.info("%d scored", store.upsert_article_sentiment(scoring.score(todo, a.model_id, a.model_dir, a.batch_size)))
    return 0


def do_features(store: Store, a: argparse.Namespace) -> int:
    frame = _frame(store, a, features.training_frame)
    if a.output:
        write_frame(frame, a.output)
    log.info("%d rows", frame.count())
    return 0


def do_train(store: Store, a: argparse.Namespace) -> int:
    frame = features.time_split(_frame(store, a, features.training_frame), a.train_fraction)
    train, test = frame.where("is_train"), frame.where("not is_train")
    if train.isEmpty():
        log.error("no rows to train on")
        return 1
    m = model.get_model(a.model, features.TARGET, **({"rounds": a.rounds} if a.rounds else {})).fit(train)
    if not test.isEmpty():
        print(features.regression_metrics(m.predict(test), features.TARGET, "prediction").first().asDict())
    if a.model_path:
        m.save(a.model_path)
    return 0


def do_predict(store: Store, a: argparse.Namespace) -> int:
    if a.session:
        rows = features.target_session_features(store.read("articles"), store.read("article_sentiment"), a.model_id, symbol_list(a.symbols), a.session, a.mode)
    else:
        rows = _frame(store, a, features.latest_bar_inference)
    if rows.isEmpty():
        log.error("nothing to predict")
        return 1
    out = model.get_model(a.model, features.TARGET).load(a.model_path).predict(rows, PREDICTED)
    chosen = [c for c in ("symbol", "bar_ts", "nyse_session", PREDICTED) if c in out.columns]
    print(*chosen, sep="\t")
    for row in out.select(*chosen).orderBy("symbol").toLocalIterator():
        print(*row, sep="\t")
    print(features.prediction_summary(out, PREDICTED).first().asDict())
    return 0


STEPS = {"ingest": do_ingest, "score": do_score, "features": do_features, "train": do_train, "predict": do_predict}


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    config.load_env()
    try:
        a = _parser().parse_args(args)
    except SystemExit as e:
        return 0 if e.code == 0 else 1
    handlers = [logging.StreamHandler(), *([logging.FileHandler(a.log_file, mode="a")] if a.log_file else [])]
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s", handlers=handlers, force=True)
    store = Store(spark or SparkSession.builder.appName("newsloom").getOrCreate(), config.data_dir(a.data_dir))
    store.init_schema()
    try:
        if a.step != "pipeline":
            return STEPS[a.step](store, a)
        skipped = {s.strip() for s in a.skip.split(",")}
        for name in STEPS:
            if name not in skipped and not (name == "predict" and not a.model_path) and (code := STEPS[name](store, a)):
                return code
        return 0
    except ValueError as e:
        log.error(e)
        return 1


if __name__ == "__main__":
    sys.exit(main())
