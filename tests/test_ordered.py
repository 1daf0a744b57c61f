"""Running values against plain loops: hot keys in ranges, orders of texts and of several
columns."""

import random

import pytest
from pyspark.sql import functions as F

from recordflow.operators import ordered
from recordflow.operators.ordered import Running, with_running


def rows(n=400, seed=3):
    r = random.Random(seed)
    return [(i, f"t{r.randint(0, 60):03d}", None if r.random() < 0.02 else f"x{i:05d}", r.choice(["hot", "hot", "hot", "cold", None, f"k{i % 7}"]), r.choice([None, r.randint(-50, 50)])) for i in range(n)]


def expected(data, order, key):
    state, out = {}, {}
    for r in sorted(data, key=order):
        total, high, last = state.get(key(r), (None, None, None))
        out[r[0]] = (total, high, last)
        v = r[4]
        if v is not None:
            state[key(r)] = (v if total is None else total + v, v if high is None else max(high, v), v)
    return out


@pytest.mark.parametrize("order,place", [(["i"], lambda r: r[0]), (["t", "i"], lambda r: (r[1], r[0])), (["x", "i"], lambda r: (r[2] is not None, r[2] or "", r[0]))])
@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("hot", [20, 1 << 20])
def test_running(spark, monkeypatch, order, place, keyed, hot):
    monkeypatch.setattr(ordered, "HOT", hot)
    data = rows()
    df = spark.createDataFrame(data, "i long, t string, x string, k string, v long")
    specs = [Running("a", "sum", F.col("v")), Running("b", "max", F.col("v")), Running("c", "last", F.col("v"))]
    got = with_running(df, order, [F.col("k")] if keyed else [], specs)
    assert got.columns == [*df.columns, "a", "b", "c"]
    assert {r["i"]: (r["a"], r["b"], r["c"]) for r in got.collect()} == expected(data, place, (lambda r: r[3]) if keyed else (lambda r: 0))
    if keyed and hot == 20:
        assert "SinglePartition" not in got._jdf.queryExecution().toString()


def test_text_orders_are_cut(spark):
    df = spark.createDataFrame([(f"n{i:04d}",) for i in range(500)], "x string")
    got = with_running(df, ["x"], [], [Running("n", "sum", F.lit(1))])
    assert sorted((r["x"], r["n"]) for r in got.collect()) == [(f"n{i:04d}", i or None) for i in range(500)]
    spread = df.select(ordered.ranges(df, ["x"], 8).alias("r")).groupBy("r").count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 200
    assert ordered.ranges(df.filter("x = ''"), ["x"], 8) is None
