"""Connected components over an edge table, by alternating large and small stars.

Every round is a grouped minimum (partially aggregated before the shuffle) and an
equi-join, whose hot keys adaptive execution splits; its result is written to the shared
folder. Stars flatten in a number of rounds that grows as the logarithm of a component's
diameter, so neither edges nor components ever reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.llm.shared import settle


def _least(pairs: DataFrame) -> DataFrame:
    """With each pair (u, v), m: the least of u and of all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("w"), F.least("u", "low").alias("m"))
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _least(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    got = _least(down)
    own = got.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return got.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(own).filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component: for every end of an edge (columns a and b) the least node that it
    is connected with. Loops and edges with a null end are left out; repeated edges count
    once; without edges the result is empty."""
    edges = settle(edges.select("a", "b").filter("a <> b").distinct())
    state = _state(edges)
    while state[0]:
        edges = settle(_small_star(_large_star(edges)))
        before, state = state, _state(edges)
        if state == before:
            break
    tops = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(tops.select("node", F.col("node").alias("component")))
