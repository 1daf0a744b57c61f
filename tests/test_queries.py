"""Every registered query of the language against its SQL."""

import math

import duckdb
import pytest

from recordflow import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame, columns):
    def plain(x):
        return None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 4) if isinstance(x, (int, float)) else str(x)

    return sorted(([plain(r[c]) for c in columns] for r in frame), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    want = con.execute(catalog.ORACLE_SQL[name]).fetchdf()
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert rows([r.asDict() for r in df.collect()], columns) == rows(want.to_dict("records"), columns)


def test_number_text(spark):
    """No SQL: C's shortest %.6g against Python's."""
    df = catalog.QUERIES["number_text"](spark, SF)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_extendedprice").collect()
    text = lambda x: str(int(x)) if x == int(x) else f"{x:.6g}"
    assert sorted(r[0] for r in df.collect()) == sorted(f"{a}:{text(b / 8)}" for a, b in lines)
