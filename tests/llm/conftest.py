import os

import pytest


@pytest.fixture
def table(spark):
    """Documents from (id, text) pairs, with columns that clash with those of operators."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        if extra:
            for c in ("component", "bucket", "rep", "sig", "g", "kind", "score", "id", "key", "words"):
                df = df.selectExpr("*", f"'x' as `{c}`")
        return df

    return make


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
