import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def apply(spark):
    """Values of one column expression over a list of texts."""
    from pyspark.sql import functions as F

    def run(texts, fn):
        df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
        return [r.v for r in df.select("n", fn(F.col("t")).alias("v")).orderBy("n").collect()]

    return run
