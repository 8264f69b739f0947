import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from triplewright.operators.joins import meeting_key  # noqa: E402
from triplewright.settings import session_conf  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config(map=session_conf())
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df):
    """A frame as a sorted list of tuples, so that repeated rows show."""
    return sorted(map(tuple, df.collect()))


def key_of(spark, *values):
    """The number that rows with these values meet on."""
    frame = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))])
    return frame.select(meeting_key(*frame.columns)).first()[0]
