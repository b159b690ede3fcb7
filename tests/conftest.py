import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
               .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Literal rows to a DataFrame; a column named date is cast to timestamp."""
    from pyspark.sql import functions as F

    def make(rows, schema):
        df = spark.createDataFrame(rows, schema)
        for name in ("date", "label_available_date", "ListedDate"):
            if name in df.columns:
                df = df.withColumn(name, F.col(name).cast("timestamp"))
        return df
    return make
