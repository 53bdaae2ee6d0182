import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    return d


ARTICLE = "dedupe_key string, source_api string, symbol string, published_at timestamp_ntz, headline string, summary string, related string, content_snippet string, ingested_at timestamp_ntz, _nth string, nth int, block string"
BAR = "source_api string, symbol string, bar_interval string, bar_ts timestamp_ntz, open double, close double, volume double, ingested_at timestamp_ntz, t string, field string, _nth int"


@pytest.fixture
def make_articles(spark):
    """Rows as dicts; columns left out are null. Columns with names the operators use inside are there to clash."""

    def make(rows):
        names = [c.split()[0] for c in ARTICLE.split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ARTICLE)

    return make


@pytest.fixture
def make_bars(spark):
    def make(rows):
        names = [c.split()[0] for c in BAR.split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], BAR)

    return make
