"""The programs' front door.

    Program('$5 > 10 { n[$9]++ } END { for (k in n) print k, n[k] }').run(df)

compiles a program against a relation and returns a DataFrame; ``explain`` names the tier.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterable
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from recordflow.lang.nodes import Field, Index, Num, Var, walk
from recordflow.lang.parser import parse
from recordflow.lang.validate import check
from recordflow.plans.columns import Columns
from recordflow.plans.local import carried
from recordflow.plans.program import Lowered, Lowering
from recordflow.plans.symbols import ZERO, NotRelational, V, inside
from recordflow.runtime.evaluator import Evaluator, NextRecord

INNER = ("__src", "__file", "__pos", "rt")


class Program:
    def __init__(self, text: str, fs: str | None = None, rs: str | None = None, csv: bool = False, variables: Iterable[tuple[str, str]] = (), safe: bool = True):
        self.text, self.safe = text, safe
        self.fs = "\t" if fs == "t" else fs
        self.rs, self.csv, self.variables = rs, csv, list(variables)
        self.tree = parse(text)
        check(self.tree, safe)
        self.lowered: Lowered | None = None

    # -- on relations

    def options(self) -> dict:
        return {"fs": self.fs, "rs": self.rs, "csv": self.csv, "vars": self.variables, "shell": not self.safe, "environ": {} if self.safe else dict(os.environ)}

    def run(self, source: DataFrame | list[DataFrame], names: list[str] | None = None, order_by: list[str] | None = None, typed: bool = True, relational: bool = False) -> DataFrame:
        """The program's output over a relation (a table, or records in a column value).

        names: of the printed values. order_by: what orders the records; for records read
        by this package, their place. typed: a column for each printed value (numbers as
        doubles) rather than lines in a column value. relational: refuse to run in
        sequence. Several sources are read one after the other: the first may fill arrays
        that rules on the others look up."""
        sources = list(source) if isinstance(source, (list, tuple)) else [source]
        if any(isinstance(x, str) for x in sources):
            self.lowered = self.with_assignments(sources, names, order_by, typed, relational)
            return self.lowered.frame
        try:
            self.lowered = self.lower(sources, names, order_by, typed)
        except NotRelational as why:
            if len(sources) == 1 and (self.main_prints_only() and carried(self.tree) is None):
                self.lowered = self.one_by_one(sources[0], names, order_by, typed, str(why))
                return self.lowered.frame
            if relational:
                raise
            self.lowered = self.in_sequence(sources, names, order_by, str(why))
        return self.lowered.frame

    def with_assignments(self, sources: list, names, order_by, typed, relational) -> Lowered:
        """Sources with assignments ``name=value`` between them, which hold from there on.
        Where no state is carried, each source has its own constants."""
        given, parts, tiers = [], [], set()
        for x in sources:
            if isinstance(x, str):
                given.append(tuple(x.split("=", 1)))
                continue
            p = Program(self.text, self.fs, self.rs, self.csv, [*self.variables, *given], self.safe)
            parts.append(p.run(x, names, order_by, typed, True))
            tiers.add(p.lowered.tier)
        if not tiers <= {"1", "1p"} or any(r.kind in ("BEGIN", "END") for r in self.tree.rules):
            raise NotRelational("state is carried over an assignment")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return Lowered(max(tiers), "each record by itself, constants by source", out, not typed)

    def targets(self, source: DataFrame, order_by: list[str] | None = None) -> DataFrame:
        """Lines of a program without carried state, with the file each goes to: columns
        target and value, as ``sinks.write_targets`` takes them."""
        low = Lowering(self.tree, self.options(), source.sparkSession)
        order = list(order_by or [x for x in ("__src", "__pos") if x in source.columns])
        s, f = low.record()
        if low.ends or s.updates:
            raise NotRelational("the end prints")
        c = low.columns(source.select([x for x in source.columns if x not in INNER]), not self.is_text(source))
        df, _ = low.prepare(source, c, s, f, order, {v for o in s.outputs for v in (o.guard, o.to, *o.args) if v is not None})
        return low.target_rows(df, c, s.outputs, order)

    def main_prints_only(self) -> bool:
        return not any(type(n).__name__ == "Print" for r in self.tree.rules if r.kind == "BEGIN" for n in walk(r.action))

    @staticmethod
    def is_text(df: DataFrame) -> bool:
        return "value" in df.columns and set(df.columns) <= {"value", *INNER}

    def line_of(self, df: DataFrame) -> Column:
        """A record as one text, for the evaluator."""
        if self.is_text(df):
            return F.col("value")
        c = Columns(df.schema, True, " ", " ", False)
        return F.array_join(c.array(V("fields", (), "A")), "\x1f")

    def one_by_one(self, df: DataFrame, names, order_by, typed, why: str) -> Lowered:
        """A run of the evaluator over each record by itself, wherever it lies."""
        order = [x for x in (order_by or ["__src", "__pos"]) if x in df.columns]
        kept = [] if typed else [F.col(f"`{x}`").alias(f"__o{i}") for i, x in enumerate(order)]
        given = df.select(*kept, (F.col("__file") if "__file" in df.columns else F.lit(None).cast("string")).alias("__file"), self.line_of(df).alias("__line"))
        name = names[0] if names and len(names) == 1 else "value"
        fs = None if self.is_text(df) else "\x1f"
        n = len(kept)
        out = given.select(*[f"__o{i}" for i in range(n)])
        schema = T.StructType([*out.schema.fields, *([] if typed else [T.StructField("__i", T.IntegerType())]), T.StructField(name, T.StringType())])
        kinds = to_arrow_schema(schema)

        def run(batches):
            lines: list[str] = []
            ev = self.evaluator(lines, fs)
            main = [r for r in ev.rules if r[1] != "BEGIN"]
            ev.inputs = iter(())
            ev.special("BEGIN")
            for b in batches:
                at, place, texts = [], [], []
                for i, (file, line) in enumerate(zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)):
                    lines.clear()
                    ev.vars["FILENAME"] = file
                    ev.take_record(line or "")
                    try:
                        ev.one_record(main)
                    except NextRecord:
                        pass
                    got = "".join(lines).split("\n")
                    got = got[:-1] if got[-1] == "" else got
                    at += [i] * len(got)
                    place += range(len(got))
                    texts += got
                yield pa.record_batch([*[b.column(k).take(pa.array(at, pa.int64())) for k in range(n)], *([] if typed else [pa.array(place, pa.int32())]), pa.array(texts, pa.string())], schema=kinds)

        return Lowered("1p", f"each record by itself, in workers: {why}", given.mapInArrow(run, schema), True)

    def explain(self) -> str:
        low = self.lowered
        return "not run yet" if low is None else f"tier={low.tier} reason={low.reason}"

    def lower(self, sources: list[DataFrame], names, order_by, typed) -> Lowered:
        spark = sources[0].sparkSession
        low = Lowering(self.tree, self.options(), spark)
        begin = "".join(low.begin_lines)
        if not low.main and not low.ends:
            return Lowered("0", "begin only", self.literal(spark, begin, names), True)
        if begin and typed:
            typed = False
        df = sources[-1]
        table = not ("value" in df.columns and set(df.columns) <= {"value", *INNER})
        order = list(order_by or (["__src", "__pos"] if "__src" in df.columns else ["__pos"] if "__pos" in df.columns else []))
        if len(sources) == 2:
            return self.lookup(low, sources, names, order, typed, table)
        if len(sources) > 2:
            raise NotRelational("more than two inputs")
        s, f = low.record()
        c = low.columns(df.select([x for x in df.columns if x not in INNER]), table)
        used = [v for o in s.outputs for v in (o.guard, *o.args) if v is not None] + [v for u in s.updates for v in (u.guard, u.value, *u.key) if v is not None]
        df = low.with_large_arrays(df, c, [*used, *(v for v in (*f.vars.values(), *f.cells.values()) if v is not None)])
        finals = []
        if low.ends:
            for name, v in f.vars.items():
                finals += [x for x in self.end_needs(low, V("state", (name,), "?"), f)]
            for at in f.cells:
                finals += [x for x in self.end_needs(low, V("cell", at, "?"), f)]
        if not low.ends and not begin and (first := low.first_of_keys(df, c, s, f, order)) is not None:
            return Lowered("2", "first records of keys", low.print_rows(first, c, [replace(s.outputs[0], guard=None)], names, order, typed), not typed)
        df, windows = low.prepare(df, c, s, f, order, {*used, *finals})
        outs: list[DataFrame] = []
        both = bool(s.outputs) and bool(low.ends) or bool(begin)
        if s.outputs:
            outs.append(low.print_rows(df, c, s.outputs, names, order, typed and not both))
        ends = low.at_end(df, c, s, f, order, names, typed and not both) if low.ends else []
        tier = "3" if windows else "2" if low.ends else "1"
        reason = {"1": "each record by itself", "2": "folds", "3": "windows over the order"}[tier]
        if both or len(outs) + len(ends) > 1 and not typed:
            frames = [x.select(F.lit(i + 1).alias("__phase"), "*") for i, x in enumerate([*outs, *ends])]
            if begin:
                frames.insert(0, self.literal(spark, begin, None).select(F.lit(0).alias("__phase"), F.col("value")))
            out = frames[0]
            for x in frames[1:]:
                out = out.unionByName(x, allowMissingColumns=True)
            return Lowered(tier, reason, out, True)
        out = None
        for x in [*outs, *ends]:
            out = x if out is None else out.union(x)
        if out is None:
            out = spark.createDataFrame([], "value string")
        return Lowered(tier, reason, out, not typed)

    def end_needs(self, low: Lowering, x: V, f) -> list[V]:
        """What a fold's aggregate reads of other states: those must be known per row."""
        from recordflow.plans.program import recurrence
        from recordflow.plans.symbols import states

        v = f.vars.get(x.args[0], x) if x.op == "state" else f.cells[x.args]
        r = recurrence(v, x)
        out = [y for y in (r.value,) if y is not None and states(y)]
        if r.guard is not None and r.how not in ("last",) and states(r.guard):
            out.append(r.guard)
        if r.guard is not None and r.how == "last" and any(y.op == "held" for y in inside(r.guard)):
            out.append(r.guard)
        return out

    def literal(self, spark: SparkSession, text: str, names) -> DataFrame:
        lines = text.split("\n")
        lines = lines[:-1] if lines and lines[-1] == "" else lines
        return spark.createDataFrame([(x,) for x in lines], f"`{names[0] if names else 'value'}` string")

    def lookup(self, low: Lowering, sources, names, order, typed, table) -> Lowered:
        """Two inputs: what the rules make of the first (NR==FNR) is joined to the rest."""
        first, rest = sources
        s1, f1 = low.record(True)
        if s1.outputs:
            raise NotRelational("the first input prints")
        c1 = low.columns(first.select([x for x in first.columns if x not in INNER]), not ("value" in first.columns and set(first.columns) <= {"value", *INNER}))
        order1 = [x for x in order if x in first.columns]
        if not order1:
            order1 = [x for x in first.columns if x in ("__pos",)] or [first.columns[0]]
        filled = {a for a, _ in f1.cells}
        s2, f2 = low.record(False, filled)
        if {a for a, _ in f2.cells} & filled or s2.updates or low.ends:
            raise NotRelational("rules on the second input change arrays of the first")
        c2 = low.columns(rest.select([x for x in rest.columns if x not in INNER]), table)
        used = [v for o in s2.outputs for v in (o.guard, *o.args) if v is not None]
        changes = [v for v in (*f2.cells.values(), *f2.vars.values()) if v is not None]
        asked = sorted({x for v in (*used, *changes) for x in inside(v) if x.op in ("lookup", "inconst") and x.args[0] in filled}, key=repr)
        df = rest
        from recordflow.plans.program import End

        e = End(low, first, c1, s1, f1, order1)
        done: dict[tuple, str] = {}
        for x in asked:
            array, k = x.args
            if (array, k) not in done:
                rel, cols = e.relation(array)
                rel = e.present(rel, cols, array)
                name, kind = cols[array]
                n = len(done)
                theirs = e.key_of(array)
                ours = [c2.own(v) for v in k]
                own = [c1.own(v) for v in theirs]
                if len(k) == len(theirs) and not low.joined(k) and all(a is not None and b is not None and isinstance(a[1], T.IntegralType) and isinstance(b[1], T.IntegralType) for a, b in zip(ours, own, strict=True)):
                    pairs = [(a[0], F.col(f"__k{i}")) for i, a in enumerate(ours)]  # integers have one text each
                else:
                    pairs = [(low.key_text(c2, k), F.col("__k"))]
                small = rel.select(*[b.alias(f"__j{n}_{i}") for i, (_, b) in enumerate(pairs)], F.col(name).alias(f"__w{n}"), F.lit(True).alias(f"__in{n}"))
                df = df.select("*", *[a.alias(f"__q{n}_{i}") for i, (a, _) in enumerate(pairs)])
                on = [F.col(f"__q{n}_{i}") == F.col(f"__j{n}_{i}") for i in range(len(pairs))]
                df = df.join(small, on, "left").drop(*[f"__{x}{n}_{i}" for x in "qj" for i in range(len(pairs))])
                done[array, k] = (n, kind)
            n, kind = done[array, k]
            if x.op in ("held", "inconst"):
                c2.known[x] = (F.col(f"__in{n}").isNotNull(), "B")
            else:
                c2.known[x] = (F.col(f"__w{n}"), "W") if kind in "NW" else (F.coalesce(F.col(f"__w{n}"), F.lit("")), kind)
        df, _ = low.prepare(df, c2, s2, f2, order, set(used))
        out = low.print_rows(df, c2, s2.outputs, names, order, typed)
        return Lowered("2c", "lookup joins", out, not typed)

    # -- in sequence

    def state_key(self) -> list[int] | None:
        """Fields that index all state, if they do: [n] for a[$n] everywhere."""
        if any(r.kind not in ("always", "when") for r in self.tree.rules) or self.tree.functions:
            return None
        keys, scalars = set(), set()
        for r in self.tree.rules:
            for part in (r.pattern, r.action):
                for n in walk(part):
                    if isinstance(n, Index) or type(n).__name__ == "In":
                        keys.add(n.keys)
                    elif type(n).__name__ in ("Assign", "Step") and isinstance(n.target, (Var, Field)):
                        scalars.add(n.target)
                    elif type(n).__name__ == "Delete" and n.keys is not None:
                        keys.add(n.keys)
                    elif type(n).__name__ in ("ForIn", "Delete", "Getline", "Leave") or isinstance(n, Var) and n.name in ("NR", "FNR", "RSTART", "RLENGTH"):
                        return None
                    elif type(n).__name__ == "Jump" and n.kind == "nextfile" or type(n).__name__ == "Call" and n.name in ("rand", "srand", "split", "match", "sub", "gsub"):
                        return None
        if scalars or len(keys) != 1:
            return None
        fields = []
        for k in keys.pop():
            if not (isinstance(k, Field) and isinstance(k.index, Num) and k.index.value >= 1):
                return None
            fields.append(int(k.index.value))
        return fields

    def in_sequence(self, sources: list[DataFrame], names, order_by, why: str) -> Lowered:
        """One run of the evaluator over all records in order; or, where all state hangs on
        one key, a run for each key."""
        table = not self.is_text(sources[0])
        parts = []
        for i, d in enumerate(sources):
            line = self.line_of(d)
            order = [x for x in (order_by or ["__src", "__pos"]) if x in d.columns]
            parts.append(d.select(F.lit(i).alias("__i"), F.struct(*[F.col(f"`{x}`") for x in order]).alias("__o") if order else F.lit(None).alias("__o"), line.alias("__line"), *([F.col("__file")] if "__file" in d.columns else [F.lit("").alias("__file")])))
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.union(p)
        recut = any(type(n).__name__ == "Assign" and n.target == Var("RS") for r in self.tree.rules if r.kind != "BEGIN" for n in walk(r.action))
        name = names[0] if names and len(names) == 1 else "value"
        fs = "\x1f" if table else None

        def lines(group: pa.Table | None, records: list[tuple]) -> list[str]:
            out: list[str] = []
            ev = self.evaluator(out, fs)
            ev.run(_files(records, recut))
            text = "".join(out).split("\n")
            return text[:-1] if text and text[-1] == "" else text

        key = self.state_key()
        schema = f"`{name}` string"
        if key is not None and len(sources) == 1 and (table or self.fs is not None or True):
            from recordflow.functions.strings import split_fields

            cut = split_fields(F.col("__line"), "\x1f" if table else self.fs or " ")
            keyed = whole.withColumn("__k", F.to_json(F.struct(*[F.get(cut, n - 1).alias(f"k{n}") for n in key])))

            def by_key(t: pa.Table) -> pa.Table:
                t = t.sort_by([("__i", "ascending")]) if order_by is None and not table else t
                rows = sorted(zip(t.column("__i").to_pylist(), t.column("__at").to_pylist(), t.column("__file").to_pylist(), t.column("__line").to_pylist(), strict=True), key=lambda r: (r[0], r[1]))
                return pa.table({name: pa.array(lines(None, [(r[0], r[2], r[3]) for r in rows]), pa.string())})

            # the place in the order as a number, comparable in Python
            from pyspark.sql import Window

            keyed = keyed.withColumn("__at", F.row_number().over(Window.partitionBy("__k").orderBy("__i", "__o"))).drop("__o")
            return Lowered("3b", f"state under one key: {why}", keyed.groupBy("__k").applyInArrow(by_key, schema), True)
        ordered = whole.repartition(1).sortWithinPartitions("__i", "__o").select("__i", "__file", "__line")

        def run(batches):
            def records():
                for b in batches:
                    yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)

            yield from self.in_batches(records(), fs, recut, name)

        return Lowered("4", f"in sequence: {why}", ordered.mapInArrow(run, schema), True)

    def in_batches(self, records, fs: str | None, recut: bool, name: str):
        """The output of a run, handed on while it goes: by the record, not at the end."""
        out: list[str] = []
        done: deque = deque()

        def flush(last: bool) -> None:
            text = "".join(out)
            out.clear()
            cut = text.rfind("\n") + 1
            if text[:cut]:
                done.extend(text[: cut - 1].split("\n"))
            if text[cut:]:
                done.append(text[cut:]) if last else out.append(text[cut:])

        ev = self.evaluator(out, fs)
        for _ in ev.steps(_files(records, recut)):
            if len(out) >= 10_000:
                flush(False)
                while done:
                    yield pa.record_batch([pa.array([done.popleft() for _ in range(min(10_000, len(done)))], pa.string())], [name])
        flush(True)
        while done:
            yield pa.record_batch([pa.array([done.popleft() for _ in range(min(10_000, len(done)))], pa.string())], [name])

    def evaluator(self, out: list, fs: str | None = None) -> Evaluator:
        o = self.options()
        ev = Evaluator(self.tree, fs=fs or self.fs, csv=self.csv, variables=self.variables, environ=o["environ"], write=out.append, shell=o["shell"])
        if self.rs is not None:
            ev.vars["RS"] = self.rs
        return ev

    # -- on the driver

    def run_local(self, inputs: Iterable, write, arguments: Iterable[str] = ()) -> int:
        """The evaluator alone, over (name, text) pairs and ("=", name, value)."""
        ev = Evaluator(self.tree, fs=self.fs, csv=self.csv, variables=self.variables, environ=self.options()["environ"], arguments=arguments, write=write, shell=not self.safe)
        if self.rs is not None:
            ev.vars["RS"] = self.rs
        return ev.run(inputs)

    def lines(self, source, **given) -> list[str]:
        """Output lines in order; for small results."""
        df = self.run(source, typed=False, **given)
        by = [c for c in ("__phase", *[x for x in df.columns if x.startswith("__o")], "__i") if c in df.columns]
        return [r["value"] for r in (df.orderBy(*by) if by else df).collect()]


def _files(records, recut: bool = False):
    """Records of (input, file, line), as the evaluator wants inputs: as they were cut, or
    as one text, if the program changes how it is cut."""
    import itertools

    for (_, name), group in itertools.groupby(records, key=lambda r: (r[0], r[1])):
        lines = (r[2] for r in group)
        yield name or "", "".join(x + "\n" for x in lines) if recut else lines


__all__ = ["ZERO", "Program"]
