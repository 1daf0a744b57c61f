"""State before each row of an ordered relation.

Without keys a window would gather all rows in one task, so the order is cut into ranges:
each range has a window of its own, and what all earlier ranges add up to (one row a range)
is joined to it. With keys this is a window over each key's rows; keys of more than ``HOT``
rows are cut into ranges in the same way. Sums, counts, extrema and last values are
associative, so the result is the same. Where to cut is found by a job over the order
columns: quantiles of a single number or time, else a sample of ``SAMPLE`` rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of a key that one task may take; rows that cuts are chosen from.
HOT, SAMPLE = 1 << 20, 4096


@dataclass(frozen=True)
class Running:
    """What is known before a row, null if nothing is. how: sum, max, min, or last (of the
    values that aren't null)."""

    name: str
    how: str
    value: Column


def _over(r: Running, w) -> Column:
    if r.how == "last":
        return F.last(r.value, ignorenulls=True).over(w)
    return {"sum": F.sum, "max": F.max, "min": F.min}[r.how](r.value).over(w)


def _joined(r: Running, before: Column, here: Column) -> Column:
    if r.how == "sum":
        return F.coalesce(before + here, before, here)
    if r.how == "last":
        return F.coalesce(here, before)
    return (F.greatest if r.how == "max" else F.least)(before, here)


def ranges(df: DataFrame, order: list[str], n: int) -> Column | None:
    """The number of the range that a row is in, of about n; None if that can't be cut, as
    all rows have one place or the place is of a type without literals."""
    first = df.schema[order[0]].dataType
    if len(order) == 1 and isinstance(first, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        x = F.col(order[0])
        key = x if isinstance(first, T.NumericType) else F.unix_micros(x.cast("timestamp"))
        found = df.select(F.percentile_approx(key, [i / n for i in range(1, n)], 1000).alias("q")).first()["q"] or []
        cuts = [F.lit(c) for c in sorted(set(found))]
    else:
        kinds = [df.schema[c].dataType for c in order]
        if not all(isinstance(k, (T.NumericType, T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType, T.BooleanType)) for k in kinds):
            return None
        key = F.struct(*[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(order)])
        drawn = df.select(*order).withColumn("__h", F.xxhash64(F.monotonically_increasing_id())).orderBy("__h").limit(SAMPLE)
        rows = [tuple(r) for r in drawn.drop("__h").orderBy(*order).collect()]
        places = dict.fromkeys(rows[len(rows) * i // n] for i in range(1, n)) if rows else {}
        cuts = [F.struct(*[F.lit(v).cast(k).alias(f"p{i}") for i, (v, k) in enumerate(zip(p, kinds, strict=True))]) for p in places]
    if not cuts:
        return None
    return F.size(F.filter(F.array(*cuts), lambda c: c < key))


def with_running(df: DataFrame, order: list[str], keys: list[Column], specs: list[Running]) -> DataFrame:
    """df and a column for each of specs."""
    by = [F.col(c) for c in order]
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [f"__key{i}" for i in range(len(keys))]
    keyed = df.select("*", *[k.alias(x) for k, x in zip(keys, names, strict=True)], *[r.value.alias(f"__v{i}") for i, r in enumerate(specs)])
    plain = [Running(r.name, r.how, F.col(f"__v{i}")) for i, r in enumerate(specs)]
    hot, cut = None, None
    if keys:
        hot = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > HOT)
    if hot is None or not hot.isEmpty():
        cut = ranges(df, order, n)
    if cut is None:
        w = Window.partitionBy(*names).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return keyed.select(*df.columns, *[_over(r, w).alias(r.name) for r in plain])
    if hot is None:
        ranged = keyed.withColumn("__range", cut)
    else:
        theirs = hot.select(*[F.col(x).alias(f"{x}h") for x in names], F.lit(True).alias("__hot"))
        ranged = keyed.join(theirs, [F.col(x).eqNullSafe(F.col(f"{x}h")) for x in names], "left").withColumn("__range", F.when(F.col("__hot"), cut).otherwise(0)).drop(*[f"{x}h" for x in names])
    w = Window.partitionBy(*names, "__range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    of_range = {"sum": F.sum, "max": F.max, "min": F.min}
    last = F.struct(*by)
    parts = ranged if hot is None else ranged.filter("__hot")
    totals = parts.groupBy(*[F.col(x).alias(f"{x}b") for x in names], F.col("__range").alias("__before")).agg(*[(F.max_by(r.value, F.when(r.value.isNotNull(), last)) if r.how == "last" else of_range[r.how](r.value)).alias(f"__t{i}") for i, r in enumerate(plain)])
    before = Window.partitionBy(*[f"{x}b" for x in names]).orderBy("__before").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[f"{x}b" for x in names], "__before", *[_over(Running("", r.how, F.col(f"__t{i}")), before).alias(f"__b{i}") for i, r in enumerate(plain)])
    # without keys a row a range; with keys a row for each range of a hot key
    same = [F.col("__range").eqNullSafe(F.col("__before")), *[F.col(x).eqNullSafe(F.col(f"{x}b")) for x in names]]
    out = ranged.select("*", *[_over(r, w).alias(f"__h{i}") for i, r in enumerate(plain)]).join(totals if keys else F.broadcast(totals), same, "left")
    return out.select(*df.columns, *[_joined(r, F.col(f"__b{i}"), F.col(f"__h{i}")).alias(r.name) for i, r in enumerate(plain)])
