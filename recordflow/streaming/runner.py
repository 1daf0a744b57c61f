"""Programs over streams.

Programs that treat each record by itself run as they are: their plan is narrow. Keyed
folds run as streaming aggregations (update or complete mode). Programs whose state hangs
on one key may run any body: each key has an evaluator's state, kept between batches.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recordflow.api import INNER, Program
from recordflow.plans.program import End, Lowering
from recordflow.plans.symbols import NotRelational, V


def stream(program: Program, source: DataFrame, names: list[str] | None = None, typed: bool = True) -> DataFrame:
    """The program's output as a streaming DataFrame. Without END it may append; with END
    (a keyed fold) it is for update or complete mode."""
    low = Lowering(program.tree, program.options(), source.sparkSession)
    table = not ("value" in source.columns and set(source.columns) <= {"value", *INNER})
    s, f = low.record()
    c = low.columns(source.select([x for x in source.columns if x not in INNER]), table)
    if s.exits or s.skips:
        raise NotRelational("a stream has no order to end at")
    if not low.ends:
        used = [v for o in s.outputs for v in (o.guard, *o.args) if v is not None]
        low.prepare(source, c, s, f, [], set(used))  # refuses what needs an order
        return low.print_rows(source, c, s.outputs, names, [], typed)
    if s.outputs:
        raise NotRelational("both records and the end print")
    e = End(low, source, c, s, f, [])
    frames = e.run(low.ends, names, typed)
    if len(frames) != 1:
        raise NotRelational("several prints at the end of a stream")
    return frames[0]


def stateful(program: Program, source: DataFrame, key: list[str], name: str = "value") -> DataFrame:
    """Lines of a program whose arrays and variables belong to one key, in append mode.
    Records of a batch come in the order of their arrival."""
    columns = [x for x in source.columns if x not in INNER]
    low_columns = Lowering(program.tree, program.options(), source.sparkSession).columns(source.select(*columns), "value" not in columns)
    line = F.col("value") if "value" in columns else F.array_join(low_columns.array(V("fields", (), "A")), "\x1f")
    fs = None if "value" in columns else "\x1f"
    keyed = source.select(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in key]).alias("__k"), line.alias("__line"))

    def update(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[str] = []
        ev = program.evaluator(out, fs)
        if state.exists:
            ev.vars, ev.arrays, ev.inside = pickle.loads(state.get[0])
        main = [r for r in ev.rules if r[1] in ("always", "when", "range")]
        for frame in frames:
            ev.inputs = iter([("", iter(frame["__line"].tolist()))])
            ev.reader = None
            ev.drain(main)
        state.update((pickle.dumps((ev.vars, ev.arrays, ev.inside)),))
        lines = "".join(out).split("\n")
        yield pd.DataFrame({name: lines[:-1] if lines[-1] == "" else lines})

    return keyed.groupBy("__k").applyInPandasWithState(update, f"`{name}` string", "state binary", "append", GroupStateTimeout.NoTimeout)
