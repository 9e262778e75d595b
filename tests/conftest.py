import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusmill.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
# the one 4-file golden case (an assembly listing, its original C source and
# two candidate C files), supplied by the caller; the test skips without it
GOLDEN_DIR = os.environ.get("CORPUSMILL_GOLDEN_DIR", "")


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, app="corpusmill-tests")
    yield s
    s.stop()


def one(spark, col_expr, value, schema="t string"):
    """Evaluate a column expression on a one-row frame."""
    df = spark.createDataFrame([(value,)], schema)
    return df.select(col_expr.alias("r")).first()["r"]


def many(spark, fn, values, schema="t string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    rows = df.select("i", fn.alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]
