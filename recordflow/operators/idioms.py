"""Idioms that programs spell with arrays and counters, as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordflow.operators.ordered import Running, ranges, with_running


def moving_average(df: DataFrame, order: list[str], value: str, n: int, name: str) -> DataFrame:
    """The mean of the last n values (of all so far while they are fewer).

    As a difference of running sums would cancel, frames are used; the order is cut into
    ranges, and each range is given the last n - 1 rows of those before it."""
    by = [F.col(c) for c in order]
    cut = ranges(df, order, max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if cut is None:
        return df.withColumn(name, F.avg(value).over(Window.orderBy(*by).rowsBetween(1 - n, 0)))
    ranged = df.withColumn("__range", cut)
    back = Window.partitionBy("__range").orderBy(*[c.desc() for c in by])
    ends = ranged.withColumn("__back", F.row_number().over(back)).filter(F.col("__back") < n).drop("__back")
    # a range may be shorter than n - 1, so each hands on to all ranges up to n - 1 later
    later = ends.withColumn("__range", F.explode(F.sequence(F.col("__range") + 1, F.col("__range") + n - 1)))
    both = ranged.withColumn("__own", F.lit(True)).unionByName(later.withColumn("__own", F.lit(False)))
    w = Window.partitionBy("__range").orderBy(*by).rowsBetween(1 - n, 0)
    return both.withColumn(name, F.avg(value).over(w)).filter("__own").drop("__own", "__range")


def tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n records: a top-n, each task sends n rows at most."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def theta_join(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Pairs under any condition; the two sides are arrays in the programs."""
    return left.join(right, condition)


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """a[k] = $0: the last record of each key, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def distinct_in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """!seen[k]++: the first record of each key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def numbered(df: DataFrame, order: list[str], name: str = "nr") -> DataFrame:
    """NR without gathering all rows in one task."""
    return with_running(df, order, [], [Running(name, "sum", F.lit(1))]).withColumn(name, F.coalesce(name, F.lit(0)) + 1)


def islands(df: DataFrame, order: list[str], value: str, name: str = "island") -> DataFrame:
    """A number for each run of equal values, as $1 != p {g++} gives."""
    df = with_running(df, order, [], [Running("__p", "last", F.struct(F.col(value).alias("v")))])
    new = F.when(F.col("__p").isNull() | ~F.col("__p.v").eqNullSafe(F.col(value)), 1).otherwise(0)
    df = df.withColumn("__new", new).drop("__p")
    return with_running(df, order, [], [Running(name, "sum", F.col("__new"))]).withColumn(name, F.coalesce(name, F.lit(0)) + F.col("__new")).drop("__new")
