import os

import pytest
from pyspark.sql import functions as F

from tidepanel.session import clean, cut, run_dir
from tidepanel.sources.panel import order_number


def test_order_numbers_check_their_digits(table):
    df = table([(1, 9), (2, 5), (0, 7)], "a int, b int")
    n = order_number((F.col("a"), 2), (F.col("b"), 1))
    assert [int(r.n) for r in df.select(n.alias("n")).collect()] == [19, 25, 7]
    for bad in ((1, 10), (-1, 2)):
        with pytest.raises(Exception, match="digits"):
            table([bad], "a int, b int").select(n.alias("n")).collect()


def test_clean_removes_what_was_stored(spark):
    other = spark.newSession()
    folder = os.path.dirname(run_dir(other, "x"))
    cut(spark.range(3), "some")
    assert any(n.startswith("some-") for n in os.listdir(folder))
    clean(spark)
    assert not os.path.exists(folder)
    assert cut(spark.range(3), "again").count() == 3
