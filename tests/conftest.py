import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from folioseek.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "tests", "4g")


@pytest.fixture
def value(spark):
    """Evaluate a column built from one string value."""
    from pyspark.sql import functions as F

    def run(make, *texts):
        df = spark.createDataFrame([texts], [f"c{i}" for i in range(len(texts))])
        return df.select(make(*(F.col(c) for c in df.columns)).alias("v")).first()["v"]

    return run
