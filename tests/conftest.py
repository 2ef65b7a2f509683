import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerline.session import local_session  # noqa: E402


# Started before test modules are read, so that they may hold column expressions.
SESSION = local_session("tests", cores=4, memory="4g", extra={"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Value of an expression over one row of literal columns."""
    def run(expr, **columns):
        from pyspark.sql import functions as F

        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
        return df.select(expr.alias("r")).first()["r"]
    return run
