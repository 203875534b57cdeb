import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for p in (ROOT, ROOT / "tests"):
    sys.path.insert(0, str(p))

from hearthline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g"})
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield spark
    spark.stop()


@pytest.fixture
def hot(spark):
    """Every group of three rows and more counts as hot."""
    spark.conf.set("spark.hearthline.hotRows", "3")
    yield
    spark.conf.unset("spark.hearthline.hotRows")
