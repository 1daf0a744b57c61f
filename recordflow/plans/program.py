"""Programs as DataFrame plans.

Tiers: 0 (no input), 1 (each record by itself), 2 (aggregation, printed at the end),
2c (lookups: joins with a first input), 3 (state carried along the order: windows),
3b (any body, but state under one key: a sequential run per key), 4 (one sequential run).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.lang.nodes import Assign, Binary, Call, Delete, ForIn, Getline, Index, Print, ProgramError, Step, Tree, Var, walk
from recordflow.operators.ordered import Running, with_running
from recordflow.plans.columns import Columns
from recordflow.plans.files import by_file
from recordflow.plans.symbolic import Frame, Output, Symbolic, Update
from recordflow.plans.symbols import ONE, UNSET, ZERO, NotRelational, V, both, cond, inside, is_const, negated, num, states, substituted, truth
from recordflow.runtime.evaluator import Evaluator

#: Elements of a constant array that become a literal; larger arrays are joined.
MANY = 500


@dataclass(frozen=True)
class Step_:
    """How a state changes with a record: how is keep, add, last, max, min, join or first;
    guard None means always."""

    how: str
    value: V | None = None
    guard: V | None = None
    floor: bool = True  # of max and min: whether the unset start counts as 0


def recurrence(f: V, x: V) -> Step_:
    """The form of a new state f in terms of the state x before."""
    if f == x:
        return Step_("keep")
    if x not in set(inside(f)):
        return Step_("last", f, None)
    if f.op == "tonum" and f.args[0] == x:
        return Step_("add", ZERO)
    if f.op == "arith" and f.args[0] in "+-":
        op, a, b = f.args
        left = recurrence(a, x) if x in set(inside(a)) else None
        if left and left.how in ("keep", "add") and x not in set(inside(b)):
            e = b if op == "+" else V("neg", (b,))
            return Step_("add", e if left.how == "keep" or left.value == ZERO else V("arith", ("+", left.value, e)))
        if op == "+" and x not in set(inside(a)):
            return recurrence(V("arith", ("+", b, a)), x)
    if f.op == "concat":
        a, b = f.args
        inner = a.args[0] if a.op == "text" else a
        left = recurrence(inner, x) if x in set(inside(inner)) else None
        if left and left.how in ("keep", "join") and left.guard is None and x not in set(inside(b)):
            return Step_("join", b if left.how == "keep" else V("concat", (left.value, b), "S"))
    if f.op == "cond":
        t, yes, no = f.args
        if x in set(inside(t)):
            return extremum(t, yes, no, x)
        if no == x and x.op == "cell" and x not in set(inside(yes)) and (rest := without(t, V("not", (V("held", x.args),)))) is not None:
            return Step_("first", yes, None if rest == ONE else rest)
        a, b = recurrence(yes, x), recurrence(no, x)
        if a.how == "keep":
            a, b, t = b, a, negated(t)
        if b.how == "keep":
            if a.how == "add":
                return Step_("add", cond(t, a.value, ZERO))
            if a.how == "join":
                return Step_("join", cond(t, a.value, V("str", ("",), "S")), None)
            return Step_(a.how, a.value, both(t, a.guard), a.floor)
        if a.how == b.how == "add":
            return Step_("add", cond(t, a.value, b.value))
        if a.how == b.how == "last":
            g = cond(t, ONE if a.guard is None else a.guard, ONE if b.guard is None else b.guard)
            return Step_("last", cond(t, a.value, b.value), None if g == ONE else g)
    raise NotRelational("state changes in a way that has no relational form")


def without(t: V, part: V) -> V | None:
    """A conjunction without one of its parts; None if it isn't one."""
    if t == part:
        return ONE
    if t.op == "and":
        for a, b in (t.args, t.args[::-1]):
            if (rest := without(a, part)) is not None:
                return both(rest, b)
    return None


def extremum(t: V, yes: V, no: V, x: V) -> Step_:
    if t.op == "not":
        t, yes, no = t.args[0], no, yes
    guard, floor = None, True
    if t.op == "and" and x not in set(inside(t.args[0])):
        guard, t = t.args
    if t.op == "or" and x not in set(inside(t.args[0])) and no == x:
        if t.args[0] == V("cmp", ("==", V("nr", ()), ONE)):
            floor, t = False, t.args[1]
    if t.op == "held" and x.op == "cell" and t.args == x.args and yes == x and x not in set(inside(no)):
        return Step_("first", no, guard)
    if t.op == "cmp" and no == x:
        op, a, b = t.args
        if b != x:
            op, a, b = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, ""), b, a
        if b == x and a == yes and op in (">", "<", ">=", "<="):
            return Step_("max" if op[0] == ">" else "min", a, guard, floor)
    raise NotRelational("state is tested in a way that has no relational form")


@dataclass
class Lowered:
    tier: str
    reason: str
    frame: DataFrame | None = None
    lines: bool = False
    notes: list = field(default_factory=list)


class Lowering:
    def __init__(self, tree: Tree, options: dict, spark: SparkSession):
        if any(r.kind in ("BEGINFILE", "ENDFILE") for r in tree.rules):
            tree = by_file(tree)
        self.tree, self.options, self.spark = tree, options, spark
        self.main = [r for r in tree.rules if r.kind in ("always", "when", "range")]
        self.ends = [r for r in tree.rules if r.kind == "END"]
        self.begin_lines: list[str] = []
        begin = Tree([r for r in tree.rules if r.kind == "BEGIN"], tree.functions)
        self.evaluator = Evaluator(begin, fs=options.get("fs"), csv=options.get("csv", False), variables=options.get("vars", ()), environ=options.get("environ"), arguments=options.get("arguments", ()), write=self.begin_lines.append, shell=options.get("shell", False))
        if options.get("rs") is not None:
            self.evaluator.vars["RS"] = options["rs"]
        self.code = self.evaluator.run([])
        self.constants = {k: v for k, v in self.evaluator.vars.items() if k not in ("NR", "FNR", "FILENAME", "RT")}
        self.constant_arrays = {k: v for k, v in self.evaluator.arrays.items()}
        self.written, self.written_arrays = set(), set()
        for r in self.main:
            for part in (r.pattern, r.until, r.action):
                self.note_writes(part)
        for f in tree.functions.values():
            for n in walk(f.body):
                if isinstance(n, (Assign, Step)) and isinstance(n.target, Var) and n.target.name not in f.params:
                    self.written.add(n.target.name)
        self.fs = self.constants["FS"] if isinstance(self.constants["FS"], str) else N_text(self.constants["FS"])
        self.ofs = N_text(self.constants["OFS"])
        self.subsep = N_text(self.constants["SUBSEP"])

    def note_writes(self, node) -> None:
        for n in walk(node):
            if isinstance(n, (Assign, Step)):
                if isinstance(n.target, Var):
                    self.written.add(n.target.name)
                elif isinstance(n.target, Index):
                    self.written_arrays.add(n.target.array)
            elif isinstance(n, Getline):
                raise NotRelational("getline")
            elif isinstance(n, Call) and n.name in ("sub", "gsub") and len(n.args) > 2:
                t = n.args[2]
                if isinstance(t, Var):
                    self.written.add(t.name)
                elif isinstance(t, Index):
                    self.written_arrays.add(t.array)
            elif isinstance(n, Call) and n.name == "split" and isinstance(n.args[1], Var):
                self.written_arrays.discard(n.args[1].name)
            elif isinstance(n, ForIn):
                raise NotRelational("an array is gone through before the end")
            elif isinstance(n, Delete):
                raise NotRelational("delete")

    def symbolic(self) -> Symbolic:
        return Symbolic(self.tree.functions, self.constants, self.written, self.written_arrays, self.constant_arrays, self.options)

    # -- one record

    def record(self, first: bool | None = None, filled: frozenset | set = frozenset()) -> tuple[Symbolic, Frame]:
        """What the rules do to a record. first: whether NR==FNR, if inputs differ; filled:
        arrays that the first input has filled."""
        s, f = self.symbolic(), Frame()
        s.looked_up = set(filled)
        if first is not None:
            plain = s.e_Binary

            def same(fr, e):
                if e.op == "==" and {getattr(e.left, "name", ""), getattr(e.right, "name", "")} == {"NR", "FNR"}:
                    return ONE if first else ZERO
                return plain(fr, e)

            s.e_Binary = same
        for i, r in enumerate(self.main):
            if f.alive == ZERO:
                break
            if r.kind == "always":
                s.stmt(f, r.action)
                continue
            t = truth(s.expr(f, r.pattern))
            if r.kind == "range":
                until = truth(s.expr(f, r.until))
                if states(t) | states(until):
                    raise NotRelational("a range depends on state")
                # inside before: the last record that decided says so
                before = V("held", ("range", i, t, until))
                t = V("or", (before, t))
            self.do(s, f, t, r)
        if s.enlarged & s.tested:
            raise NotRelational(f"reading {min(s.enlarged & s.tested)} makes elements that are tested for")
        self.reads = s.reads
        return s, f

    def do(self, s: Symbolic, f: Frame, t: V, r) -> None:
        def yes(g):
            if r.action is None:
                s.outputs.append(Output(s.guard(g), (g.record,), False))
            else:
                s.stmt(g, r.action)

        s.branch(f, t, yes, lambda g: None)

    # -- relations

    def columns(self, df: DataFrame | None, table: bool) -> Columns:
        c = Columns(df.schema if df is not None else None, table, self.ofs, self.fs, self.options.get("csv", False), self.constants.get("RS") == "")
        c.c_lookup = lambda array, k: self.constant_lookup(c, array, k)
        c.c_inconst = lambda array, k: (F.when(F.try_element_at(self.constant_map(array), self.key_text(c, k)).isNotNull(), 1.0).otherwise(0.0), "N")
        return c

    def constant_map(self, array: str) -> Column:
        items = self.constant_arrays.get(array, {})
        if len(items) > MANY:
            raise NotRelational("a large constant array")
        flat = [F.lit(x) for k, v in items.items() for x in (k, N_text(v))]
        return F.create_map(*flat) if flat else F.create_map().cast("map<string,string>")

    def with_large_arrays(self, df: DataFrame, c: Columns, values: Iterable[V]) -> DataFrame:
        """df joined with the arrays that BEGIN has filled with more elements than a literal
        should have (read from a file, say), for each key that is looked up."""
        asked = {x.args for v in values for x in inside(v) if x.op in ("lookup", "inconst")}
        for n, (array, k) in enumerate(sorted(asked, key=repr)):
            items = self.constant_arrays.get(array, {})
            if len(items) <= MANY or any(states(x) for x in k):
                continue
            floats = all(isinstance(v, float) for v in items.values())
            held = pa.table({f"__j{n}": pa.array(list(items), pa.string()), f"__w{n}": pa.array(list(items.values()) if floats else [N_text(v) for v in items.values()], pa.float64() if floats else pa.string())})
            df = df.withColumn(f"__q{n}", self.key_text(c, k)).join(self.spark.createDataFrame(held), F.col(f"__q{n}") == F.col(f"__j{n}"), "left")
            c.known[V("inconst", (array, k))] = (F.col(f"__j{n}").isNotNull(), "B")
            found = F.col(f"__w{n}")
            c.known[V("lookup", (array, k), "?")] = (found, "W") if floats else (F.coalesce(found, F.lit("")), "S" if all(type(v) is str for v in items.values()) else "F")
        return df

    def constant_lookup(self, c: Columns, array: str, k: tuple) -> tuple[Column, str]:
        items = self.constant_arrays.get(array, {})
        found = F.try_element_at(self.constant_map(array), self.key_text(c, k))
        if all(isinstance(v, float) for v in items.values()):
            return found.cast("double"), "W"
        return F.coalesce(found, F.lit("")), "S" if all(type(v) is str for v in items.values()) else "F"

    def key_text(self, c: Columns, k: tuple) -> Column:
        texts = [c.text(x) for x in k]
        return texts[0] if len(texts) == 1 else F.concat_ws(self.subsep, *texts)

    def key_columns(self, c: Columns, k: tuple) -> list[Column]:
        """What to group by. Parts of a key are kept apart, unless a part may hold the
        separator, as then other parts may make up the same key."""
        if self.joined(k):
            return [self.key_text(c, k)]
        return [c.key(x) for x in k]

    def joined(self, k: tuple) -> bool:
        return len(k) > 1 and not (len(self.subsep) == 1 and self.subsep < " " and self.subsep not in "\t\n\r")

    def prepare(self, df: DataFrame, c: Columns, s: Symbolic, f: Frame, order: list[str], used: set[V]) -> tuple[DataFrame, bool]:
        """Number rows, cut at exits, and add the state before each row that ``used``
        values depend on."""
        windows = False
        every = [*used, *(p for _, k in f.cells for p in k)]
        for x in (*(V("state", (n,), "?") for n in f.vars), *(V("cell", at, "?") for at in f.cells)):
            try:
                r = self.change_of(f, x)
                every += [r.value, r.guard]
            except NotRelational:  # if it matters, it is found out where it is asked for
                every.append(f.vars.get(x.args[0]) if x.op == "state" else f.cells[x.args])
        need_nr = any(x.op in ("nr", "fnr") for v in every if v is not None for x in inside(v))
        exits = [V("num", (1.0,)) if g is None else g for g in s.exits + s.skips]
        if exits and not order:
            raise NotRelational("an exit needs an order")
        if len(exits) == 1 and not (s.skips and self.files(df)) and (n := self.limit_of(exits[0])) is not None and not (exits[0].args[1].op == "fnr" and self.files(df)):
            df = df.orderBy(*order).limit(n)
            exits = []
            windows = True
        need_nr = need_nr or any(x.op in ("nr", "fnr") for v in exits for x in inside(v))
        if need_nr:
            if not order:
                raise NotRelational("NR needs an order")
            df = with_running(df, order, [], [Running("__nr", "sum", F.lit(1))]).withColumn("__nr", (F.coalesce("__nr", F.lit(0)) + 1).cast("double"))
            c.known[V("nr", ())] = (F.col("__nr"), "N")
            c.known[V("fnr", ())] = (F.col("__nr"), "N")
            if (files := self.files(df)) and any(x.op == "fnr" for v in [*every, *exits] if v is not None for x in inside(v)):
                starts = df.groupBy(*files).agg(F.min("__nr").alias("__first")).select(*[F.col(f"`{x}`").alias(f"__f{i}") for i, x in enumerate(files)], "__first")
                df = df.join(F.broadcast(starts), [F.col(f"`{x}`") == F.col(f"__f{i}") for i, x in enumerate(files)]).drop(*[f"__f{i}" for i in range(len(files))])  # a row a file
                c.known[V("fnr", ())] = (F.col("__nr") - F.col("__first") + 1, "N")
            windows = True
        if any(states(g) for g in exits):
            raise NotRelational("an exit depends on state")
        files = self.files(df)
        skips = [] if not exits or not files else [ONE if g is None else g for g in s.skips]
        for ended, keys in ((exits[: len(s.exits)] if skips else exits, []), (skips, [F.col(f"`{x}`") for x in files])):
            if ended:  # an exit ends all that follows, nextfile the rest of its file
                hit = F.when(reduce(lambda a, b: a | b, [c.test(g) for g in ended]), 1)
                df = with_running(df, order, keys, [Running("__gone", "max", hit)]).filter("__gone is null").drop("__gone")
                windows = True
        todo = {x for v in used for x in states(v)}
        done: set[V] = set()
        while todo - done:
            x = self.ready(todo - done, s, f, done, todo)
            if x is None:
                continue
            df = self.add_state(df, c, f, x, order)
            windows = True
            done.add(x)
        return df, windows

    def first_of_keys(self, df: DataFrame, c: Columns, s: Symbolic, f: Frame, order: list[str]) -> DataFrame | None:
        """!seen[k]++ and the like, if that is all a program does: the first record of each
        key, by partial aggregation instead of a window over each key's rows. None if the
        program is another."""
        if not order or len(s.outputs) != 1 or s.updates or s.exits or s.skips or f.vars or len(f.cells) != 1 or s.outputs[0].loop is not None:
            return None
        (at, new), o = next(iter(f.cells.items())), s.outputs[0]
        x, held = V("cell", at, "?"), V("held", at)
        firsts = [V("cmp", ("==", y, ZERO)) for y in (x, V("tonum", (x,)))] + [V("not", (V("bool", (y,)),)) for y in (x, V("tonum", (x,)))] + [V("not", (held,))]
        if o.guard not in firsts or any(states(a) or any(y.op in ("nr", "fnr", "rand") for y in inside(a)) for a in (*o.args, *at[1])):
            return None
        ever = V("arith", ("+", V("tonum", (x,)), ONE))
        if new not in (ever, ONE) and not (new.op == "cond" and new.args[0] == o.guard and new.args[1:] in ((ONE, x), (ever, x))):
            return None
        keys = self.key_columns(c, at[1])
        rest = [F.col(f"`{n}`") for n in df.columns]
        best = df.groupBy(*[k.alias(f"__key{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*rest), F.struct(*[F.col(f"`{n}`") for n in order])).alias("__r"))
        return best.select("__r.*")

    def files(self, df: DataFrame) -> list[str]:
        """Columns that tell the files of an input apart."""
        return [x for x in ("__src", "__file") if x in df.columns] if "__file" in df.columns else []

    def limit_of(self, g: V) -> int | None:
        """n of NR==n or NR>=n."""
        if g.op == "cmp" and g.args[0] in ("==", ">=") and g.args[1].op in ("nr", "fnr") and g.args[2].op == "num" and g.args[2].args[0] >= 1:
            return int(g.args[2].args[0])
        return None

    def change_of(self, f: Frame, x: V) -> Step_:
        if x.op == "state":
            return recurrence(f.vars.get(x.args[0], x), x)
        return recurrence(f.cells.get(x.args, x), x)

    def ready(self, open_: set[V], s: Symbolic, f: Frame, done: set[V], todo: set[V]) -> V | None:
        """A state whose own change depends on known states only."""
        for x in sorted(open_, key=repr):
            if x.op == "held":
                needs = set() if x.args[0] == "range" else states(self.made_first(f, x))
            else:
                r = self.change_of(f, x)
                needs = {y for v in (r.value, r.guard) if v is not None for y in states(v)}
            if needs <= done:
                return x
            if needs - todo:
                todo |= needs
                return None
        raise NotRelational("states depend on one another")

    def made_first(self, f: Frame, x: V) -> V:
        """Whether a record makes an element, if there is none yet."""
        made = f.made.get(x.args, ZERO)
        made = ONE if made is None else simplified(substituted(made, {x: ZERO}))
        for g in self.reads.get(x.args, []):  # a read makes the element too
            made = ONE if g is None or made == ONE else g if made == ZERO else V("or", (made, g))
        return made

    def add_state(self, df: DataFrame, c: Columns, f: Frame, x: V, order: list[str]) -> DataFrame:
        if not order:
            raise NotRelational("state along the records needs an order")
        name = f"__s{len(c.known)}"
        keys: list[Column] = []
        if x.op == "held" and x.args[0] == "range":
            _, _, a, b = x.args
            df = with_running(df, order, [], [Running(name, "last", F.when(c.test(b), 0).when(c.test(a), 1))])
            c.known[x] = (F.coalesce(F.col(name), F.lit(0)) == 1, "B")
            return df
        if x.op in ("cell", "held"):
            keys = self.key_columns(c, x.args[1])
        if x.op == "held":
            made = self.made_first(f, x)
            df = with_running(df, order, keys, [Running(name, "max", F.lit(1) if made == ONE else F.when(c.test(made), 1))])
            c.known[x] = (F.col(name).isNotNull(), "B")
            return df
        r = self.change_of(f, x)
        guard = None if r.guard is None else c.test(r.guard)
        within = (lambda v: v) if guard is None else (lambda v: F.when(guard, v))
        start = self.constants.get(x.args[0]) if x.op == "state" else None
        if r.how == "add":
            df = with_running(df, order, keys, [Running(name, "sum", within(c.number(r.value)))])
            col = F.col(name).cast("double")
            c.known[x] = (F.coalesce(col, F.lit(0.0)) + F.lit(N_number(start)), "N") if start is not None else (col, "W")
        elif r.how in ("last", "first"):
            v, kind = c.col(r.value)
            if kind == "M":
                raise NotRelational("state is text or number by record")
            if r.how == "first":
                raise NotRelational("a first value is read before the end")
            df = with_running(df, order, keys, [Running(name, "last", within(v))])
            if start is not None:
                if isinstance(start, float) != (kind in "NW"):
                    raise NotRelational("state is text or number by record")
                c.known[x] = (F.coalesce(F.col(name), F.lit(start if isinstance(start, float) else str(start))), kind)
            elif kind in "NW":
                c.known[x] = (F.col(name), "W")
            else:
                c.known[x] = (F.coalesce(F.col(name), F.lit("")), kind)
        elif r.how in ("max", "min"):
            if c.col(r.value)[1] != "N":
                raise NotRelational("an extremum of texts")
            df = with_running(df, order, keys, [Running(name, r.how, within(c.number(r.value)))])
            base = F.lit(N_number(start))
            col = F.col(name)
            best = F.when(col.isNotNull(), (F.greatest if r.how == "max" else F.least)(col, base)) if r.floor or start is not None else col
            # an extremum that never passed the unset start leaves it unset
            passed = (best > base) if r.how == "max" else (best < base)
            c.known[x] = (F.coalesce(best, base), "N") if start is not None else (F.when(passed, best) if r.floor else best, "W")
        elif r.how == "keep":
            c.known[x] = (F.lit(None).cast("double"), "W") if start is None else (F.lit(start), "N") if isinstance(start, float) else (F.lit(str(start)), "S")
        else:
            raise NotRelational(f"{r.how} is read before the end")
        return df

    # -- output of records

    def print_rows(self, df: DataFrame, c: Columns, outputs: list[Output], names: list[str] | None, order: list[str], typed: bool) -> DataFrame:
        if any(o.mode for o in outputs):
            raise NotRelational("output goes to several places")
        loops = {o.loop for o in outputs}
        if len(loops) > 1:
            raise NotRelational("prints inside and outside a loop over fields")
        loop = loops.pop() if loops else None
        if loop is not None:
            items = c.array(loop[0])
            df = df.select("*", F.posexplode(from_place(items, loop[1])).alias("__at", "__item"))
        keep = [F.col(f"`{o}`").alias(f"__o{i}") for i, o in enumerate(order)] if not typed else []
        if len(outputs) == 1:
            o = outputs[0]
            if o.guard is not None:
                df = df.filter(c.test(o.guard))
            return df.select(*self.printed(c, o, names, typed), *keep)
        rows = []
        for i, o in enumerate(outputs):
            cells = self.printed(c, o, names, typed)
            row = F.struct(F.lit(i).alias("__i"), *cells)
            rows.append(row if o.guard is None else F.when(c.test(o.guard), row))
        out = df.select(*keep, F.explode(F.array_compact(F.array(*rows))).alias("__r"))
        fields = [x for x in names or []] if typed else ["value"]
        if typed and not fields:
            fields = [f"c{i + 1}" for i in range(len(outputs[0].args))]
        return out.select(*[F.col(f"__r.{x}").alias(x) for x in fields], *([F.col(f"__o{i}") for i in range(len(order))] + [F.col("__r.__i").alias("__i")] if not typed else []))

    def printed(self, c: Columns, o: Output, names: list[str] | None, typed: bool) -> list[Column]:
        if typed and not o.formatted:
            if names and len(names) != len(o.args):
                raise ProgramError(f"{len(o.args)} values are printed, {len(names)} names given")
            out = []
            for i, a in enumerate(o.args):
                col, kind = c.col(a)
                if (own := c.own(a)) is not None and isinstance(own[1], T.IntegralType):
                    col = own[0].cast("bigint")
                out.append((F.lit("") if kind == "U" else F.coalesce(col, F.lit(0.0)) if kind == "W" else col).alias(names[i] if names else f"c{i + 1}"))
            return out
        if o.formatted and not typed and not self.format_of(o).endswith("\n"):
            raise NotRelational("a printed format doesn't end its line")
        return [self.line(c, o).alias(names[0] if typed and names else "value")]

    def target_rows(self, df: DataFrame, c: Columns, outputs: list[Output], order: list[str]) -> DataFrame:
        """Lines with the names of the files they go to (empty: the program's own output)."""
        rows = []
        for i, o in enumerate(outputs):
            if o.mode == "|" or o.loop is not None or o.formatted and not self.format_of(o).endswith("\n"):
                raise NotRelational("output goes through a command, or to a file in parts of lines")
            row = F.struct(F.lit(i).alias("i"), (c.text(o.to) if o.mode else F.lit("")).alias("target"), self.line(c, o).alias("value"))
            rows.append(row if o.guard is None else F.when(c.test(o.guard), row))
        out = df.select(*[F.col(f"`{x}`").alias(f"__o{i}") for i, x in enumerate(order)], F.explode(F.array_compact(F.array(*rows))).alias("__r"))
        return out.select(*[F.col(f"__o{i}") for i in range(len(order))], F.col("__r.i").alias("__i"), "__r.target", "__r.value")

    def line(self, c: Columns, o: Output) -> Column:
        ofmt = N_text(self.constants["OFMT"])
        if o.formatted:
            s = V("sprintf", (self.format_of(o).removesuffix("\n"), tuple(o.args[1:]), N_text(self.constants["CONVFMT"])), "S")
            return c.col(s)[0]
        texts = [c.text(a, ofmt) for a in o.args]
        return texts[0] if len(texts) == 1 else F.concat_ws(self.ofs, *texts)

    def format_of(self, o: Output) -> str:
        if o.args[0].op != "str":
            raise NotRelational("a format varies")
        return o.args[0].args[0]

    # -- the end

    def at_end(self, df: DataFrame, c: Columns, s: Symbolic, f: Frame, order: list[str], names: list[str] | None, typed: bool) -> list[DataFrame]:
        e = End(self, df, c, s, f, order)
        return e.run(self.ends, names, typed)


def from_place(items: Column, first: int) -> Column:
    """The items from a place on, counted from 1."""
    return items if first == 1 else F.slice(items, first, F.greatest(F.size(items) - first + 1, F.lit(0)))


def simplified(v: V) -> V:
    """Constants folded after a substitution."""
    if v.op == "not":
        return negated(simplified(v.args[0]))
    if v.op == "and":
        return both(simplified(v.args[0]), simplified(v.args[1])) or ONE
    if v.op == "or":
        a, b = map(simplified, v.args)
        return ONE if ONE in (a, b) else b if a == ZERO else a if b == ZERO else V("or", (a, b))
    if v.op == "cond":
        return cond(simplified(v.args[0]), simplified(v.args[1]), simplified(v.args[2]))
    return v


def N_text(v) -> str:
    from recordflow.runtime.values import to_text

    return to_text(v)


def N_number(v) -> float:
    from recordflow.runtime.values import to_number

    return to_number(v)


class End:
    """END: values of finished folds, and arrays as relations of keys and values."""

    def __init__(self, low: Lowering, df: DataFrame, c: Columns, s: Symbolic, f: Frame, order: list[str]):
        self.low, self.df, self.c, self.s, self.f, self.order = low, df, c, s, f, order
        self.single: dict[str, tuple[Column, str]] = {}  # aggregates over all rows
        self.relations: dict[tuple, dict] = {}
        self.assumed: V | None = None  # a test that all rows of an aggregation pass

    def run(self, rules: list, names: list[str] | None, typed: bool) -> list[DataFrame]:
        y = self.low.symbolic()
        y.ending = True
        g = Frame()
        for name in self.low.written:
            g.vars[name] = V("final", (name,), "?")
        g.vars["NR"] = V("final", ("NR",), "N")
        g.record, g.fields = V("lastrecord", (), "F"), V("lastfields", (), "A")
        out: list[tuple[str | None, Output]] = []
        for r in rules:
            self.body(y, g, r.action.body, out)
        return [self.emit(a, o, names, typed) for a, o in out]

    def body(self, y: Symbolic, g: Frame, statements: Iterable, out: list) -> None:
        for st in statements:
            if isinstance(st, ForIn):
                self.rows_of(y, g, st, out)
            elif hasattr(st, "body") and isinstance(st.body, tuple):
                self.body(y, g, st.body, out)
            else:
                n = len(y.outputs)
                y.stmt(g, st)
                out.extend((None, o) for o in y.outputs[n:])

    def rows_of(self, y: Symbolic, g: Frame, st: ForIn, out: list) -> None:
        """A loop over an array: prints become rows, sums aggregates of the relation."""
        h = Frame(dict(g.vars), {}, {}, g.record, g.fields, None)
        h.vars[st.name] = V("rowkey", (st.array,), "S")
        assigned = {n.target.name for n in walk(st.body) if isinstance(n, (Assign, Step)) and isinstance(n.target, Var)}
        before = {name: V("state", (name,), "?") for name in assigned}
        h.vars.update(before)
        y.in_rows = st.array
        n = len(y.outputs)
        y.stmt(h, st.body)
        y.in_rows = None
        mine = y.outputs[n:]
        for name in assigned:
            r = recurrence(h.vars[name], before[name])
            local = any(before[name] in set(inside(v)) for o in mine for v in (o.guard, *o.args) if v is not None)
            if r.how == "last" and r.guard is None and not local:
                continue  # set anew in each turn
            if local:
                raise NotRelational("the order of an array's keys matters")
            old = g.vars.get(name) or y.read(g, name)
            if r.how == "add":
                g.vars[name] = V("arith", ("+", y.number(old), V("relsum", (st.array, r.value))))
            elif r.how in ("max", "min"):
                value = V("relmax" if r.how == "max" else "relmin", (st.array, r.value if r.guard is None else cond(r.guard, r.value, UNSET)))
                g.vars[name] = V("larger" if r.how == "max" else "smaller", (y.number(old), value))
            else:
                raise NotRelational("the order of an array's keys matters")
        out.extend((st.array, o) for o in mine)

    # -- aggregates

    def fold(self, x: V) -> Step_:
        if self.assumed is None:
            return self.low.change_of(self.f, x)
        return recurrence(simplified(substituted(self.changed(x), {self.assumed: ONE})), x)

    def changed(self, x: V) -> V:
        return self.f.vars.get(x.args[0], x) if x.op == "state" else self.f.cells.get(x.args, x)

    def only_under(self, made: V, guard: V) -> bool:
        """Whether an element is made by just the records that pass a test."""
        return simplified(substituted(made, {guard: ONE})) == ONE and simplified(substituted(made, {guard: ZERO})) == ZERO

    def shared_guard(self, xs: list[V]) -> V | None:
        """A test of the record alone without which none of the states changes."""
        found: set[V] = set()
        for x in xs:
            v = self.changed(x)
            if v.op != "cond" or x not in v.args[1:]:
                return None
            found.add(v.args[0] if v.args[2] == x else negated(v.args[0]))
        return found.pop() if len(found) == 1 and not any(states(g) or any(y.op == "rand" for y in inside(g)) for g in found) else None

    def aggregate(self, x: V) -> tuple[Column, str]:
        """A finished fold as an aggregate over the rows of a key, or over all rows."""
        c = self.c
        r = self.fold(x)
        start = self.low.constants.get(x.args[0]) if x.op == "state" else None
        taken = self.arg_of(x, r) if r.how == "last" and self.order else None
        if taken is not None:
            return taken
        guard = None if r.guard is None else c.test(r.guard)
        within = (lambda v: v) if guard is None else (lambda v: F.when(guard, v))
        if r.how == "last" and is_const(r.value) and r.value.op == "num":  # whichever is last
            return F.max(within(F.lit(r.value.args[0]))), "W"
        at = self.place() if self.order else None
        if r.how == "keep":
            return (F.first(F.lit(None).cast("double")), "W") if start is None else (F.first(F.lit(start)), "N") if isinstance(start, float) else (F.first(F.lit(str(start))), "S")
        if r.how == "add":
            v = r.value
            if v == ONE and guard is None:
                total = F.count(F.lit(1)).cast("double")
                total = F.when(total > 0, total)
            elif v.op == "cond" and v.args[1] == ONE and v.args[2] == ZERO:
                total = F.count_if(c.test(v.args[0])).cast("double")
                total = F.when(total > 0, total)
            elif v.op == "cond" and v.args[2] == ZERO:
                total = F.sum(F.when(c.test(v.args[0]), c.number(v.args[1])))
            else:
                total = F.sum(within(c.number(v)))
            return (F.coalesce(total, F.lit(0.0)) + F.lit(N_number(start)), "N") if start is not None else (total, "W")
        if r.how in ("max", "min"):
            v, kind = c.col(r.value)
            if kind != "N":
                raise NotRelational("an extremum of texts")
            best = (F.max if r.how == "max" else F.min)(within(v))
            base = F.lit(N_number(start))
            if start is not None:
                return F.coalesce((F.greatest if r.how == "max" else F.least)(best, base), base), "N"
            if not r.floor:
                return best, "W"
            return F.when((best > base) if r.how == "max" else (best < base), best), "W"
        if at is None:
            raise NotRelational("a last or first value needs an order")
        if r.how == "join":
            rows = F.array_sort(F.collect_list(F.struct(*[F.col(f"`{o}`") for o in self.order], c.text(r.value).alias("__t"))))
            return F.array_join(F.transform(rows, lambda s: s["__t"]), ""), "S"
        v, kind = c.col(r.value)
        if r.how == "first":
            best = F.min_by(v, F.when(guard, at) if guard is not None else at)
        else:
            best = F.max_by(v, F.when(guard, at) if guard is not None else at)
        return (best, "W") if kind in "NW" else (F.coalesce(best, F.lit("")), kind if kind != "U" else "S")

    def arg_of(self, x: V, r: Step_) -> tuple[Column, str] | None:
        """A value that is set where an extremum is: taken with the extremum."""
        if r.guard is None or not states(r.guard):
            return None
        g, extra = r.guard, None
        if g.op == "and" and not states(g.args[0]):
            extra, g = g.args
        if g.op == "or":
            g = g.args[1]
        if g.op != "cmp" or len(states(g)) != 1:
            raise NotRelational("a value depends on state in a way that has no relational form")
        m = next(iter(states(g)))
        best = self.fold(m)
        if best.how not in ("max", "min") or m not in g.args:
            raise NotRelational("a value depends on state in a way that has no relational form")
        op, a, b = g.args
        strict = op in ("<", ">")
        c = self.c
        e = c.number(best.value)
        floor = best.floor
        start = N_number(self.low.constants.get(m.args[0]) if m.op == "state" else None)
        keep = F.lit(True) if extra is None else c.test(extra)
        if floor:
            keep = keep & ((e > start) if best.how == "max" else (e < start))
        # of equal extrema the first if the test is strict, else the last
        v, kind = c.col(r.value)
        signed = e if best.how == "max" else -e
        if strict:
            numeric = [f for f in self.order]
            back = F.struct(signed, *[-F.col(f"`{o}`") if self.numeric(o) else F.col(f"`{o}`") for o in numeric])
            if not all(self.numeric(o) for o in numeric):
                raise NotRelational("the order of equal extrema isn't numeric")
            out = F.max_by(v, F.when(keep, back))
        else:
            out = F.max_by(v, F.when(keep, F.struct(signed, *[F.col(f"`{o}`") for o in self.order])))
        return (out, "W") if kind in "NW" else (F.coalesce(out, F.lit("")), kind)

    def place(self) -> Column:
        """A record's place in the order; of one column a value that sorts and fits a hash
        aggregate, where nulls come first."""
        if len(self.order) == 1:
            c, kind = F.col(f"`{self.order[0]}`"), self.df.schema[self.order[0]].dataType
            if isinstance(kind, T.IntegralType):
                return F.coalesce(c.cast("bigint"), F.lit(-(1 << 63)))
            if isinstance(kind, T.TimestampType):
                return F.coalesce(F.unix_micros(c), F.lit(-(1 << 63)))
        return F.struct(*[F.col(f"`{o}`") for o in self.order])

    def numeric(self, name: str) -> bool:
        return isinstance(self.df.schema[name].dataType, T.NumericType)

    def key_of(self, array: str) -> tuple:
        cells = [k for a, k in self.f.cells if a == array]
        return cells[0] if cells else next(u.key for u in self.s.updates if u.array == array)

    def relation(self, array: str) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
        kept, self.assumed = self.assumed, None
        try:
            return self.relation_of(array)
        finally:
            self.assumed = kept

    def relation_of(self, array: str) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
        """The rows of an array: __k (its key as text), and by array the value's column and
        kind. Arrays under the same key are aggregated together."""
        cells = [(a, k) for a, k in self.f.cells if a == array]
        ups = [u for u in self.s.updates if u.array == array]
        if len(cells) + len({u.key for u in ups}) != 1:
            raise NotRelational(f"{array} has no single key")
        if any(a == array and (a, k) not in cells for a, k in self.s.reads):
            raise NotRelational(f"reading {array} makes elements")
        key = cells[0][1] if cells else ups[0].key
        loop = ups[0].loop if ups else None
        at = (key, loop)
        if at not in self.relations:
            self.relations[at] = self.grouped(key, loop)
        rel = self.relations[at]
        return rel["df"], rel["names"]

    def grouped(self, key: tuple, loop: tuple | None) -> dict:
        df, c = self.df, self.c
        aggs, names = [], {}
        if loop is not None:
            items = c.array(loop[0])
            df = df.select("*", F.posexplode(from_place(items, loop[1])).alias("__at", "__item"))
            for u in self.s.updates:
                if u.array and u.key == key and u.loop == loop and u.array not in names:
                    same = [w for w in self.s.updates if w.array == u.array]
                    parts = [c.number(w.value) if w.guard is None else F.when(c.test(w.guard), c.number(w.value)) for w in same]
                    names[u.array] = (f"__v{len(names)}", "N")
                    aggs.append((F.coalesce(sum((F.coalesce(F.sum(p), F.lit(0.0)) for p in parts[1:]), F.coalesce(F.sum(parts[0]), F.lit(0.0))), F.lit(0.0))).alias(names[u.array][0]))
                    here = [None if w.guard is None else c.test(w.guard) for w in same]
                    if None not in here:
                        aggs.append(F.max(reduce(lambda a, b: a | b, here)).alias("__h" + names[u.array][0]))
        mine = [] if loop is not None else [V("cell", (a, k), "?") for a, k in self.f.cells if k == key]
        guard = self.shared_guard(mine) if mine else None
        if guard is not None and all(self.only_under(self.low.made_first(self.f, V("held", x.args)), guard) for x in mine):
            df, self.assumed = df.filter(c.test(guard)), guard
        for a, k in self.f.cells:
            if k == key and loop is None:
                col, kind = self.aggregate(V("cell", (a, k), "?"))
                names[a] = (f"__v{len(names)}", kind)
                aggs.append(col.alias(names[a][0]))
                made = self.low.made_first(self.f, V("held", (a, k)))
                if states(made):
                    raise NotRelational(f"what makes an element of {a} depends on state")
                if made != ONE and self.assumed is None:
                    aggs.append(F.max(c.test(made)).alias("__h" + names[a][0]))
        self.assumed = None
        keys = [x.alias(f"__k{i}") for i, x in enumerate(self.low.key_columns(c, key))]
        out = df.groupBy(*keys).agg(*aggs)
        texts = [F.col("__k0")] if self.low.joined(key) else [c.key_text(k, F.col(f"__k{i}")) for i, k in enumerate(key)]
        joined = texts[0] if len(texts) == 1 else F.concat_ws(self.low.subsep, *texts)
        return {"df": out.withColumn("__k", joined), "names": names}

    def present(self, df: DataFrame, names: dict, array: str) -> DataFrame:
        """The rows of one of the arrays that were aggregated together."""
        has = "__h" + names[array][0]
        return df.filter(F.col(has)) if has in df.columns else df

    # -- output

    def emit(self, array: str | None, o: Output, names: list[str] | None, typed: bool) -> DataFrame:
        if o.mode:
            raise NotRelational("output goes to several places")
        used = [v for v in (o.guard, *o.args) if v is not None]
        ones = {x for v in used for x in inside(v) if x.op in ("final", "total", "size", "relsum", "relmax", "relmin", "lastrecord", "lastfields")}
        c = self.low.columns(None, False)
        c.c_larger = lambda a, b: (F.greatest(c.number(a), c.number(b)), "N")
        c.c_smaller = lambda a, b: (F.least(c.number(a), c.number(b)), "N")
        df = None
        if array is not None:
            rel, cols = self.relation(array)
            df = self.present(rel, cols, array)
            c.known[V("rowkey", (array,), "S")] = (F.col("__k"), "S")
            for other in {x.args[0] for v in used for x in inside(v) if x.op == "value"}:
                if other not in cols:
                    if not any(a == other for a, _ in self.f.cells) and not any(u.array == other for u in self.s.updates):
                        c.known[V("value", (other,), "?")] = (F.lit(""), "U")
                        continue
                    more, theirs = self.relation(other)
                    name, kind = theirs[other]
                    more = self.present(more, theirs, other).select(F.col("__k"), F.col(name).alias("__x" + other))
                    df = df.join(more, "__k", "left")
                    c.known[V("value", (other,), "?")] = (F.col("__x" + other), "W") if kind in "NW" else (F.coalesce(F.col("__x" + other), F.lit("")), kind)
                else:
                    c.known[V("value", (other,), "?")] = (F.col(cols[other][0]), cols[other][1])
        one = self.one_row(ones, c)
        if df is None:
            df = one if one is not None else self.low.spark.range(1).select(F.lit(1).alias("__one"))
        elif one is not None:
            df = df.join(F.broadcast(one), F.lit(True))  # a single row
        if o.guard is not None:
            df = df.filter(c.test(o.guard))
        return df.select(*self.low.printed(c, o, names, typed))

    def one_row(self, ones: set[V], c: Columns) -> DataFrame | None:
        """Finished scalars as one row."""
        if not ones:
            return None
        aggs, rels = [], []
        df = self.df
        folded = [V("state", x.args, "?") for x in ones if x.op == "final" and x.args[0] != "NR" and x.args[0] in self.f.vars]
        alone = all(x.op not in ("lastrecord", "lastfields") and not (x.op == "final" and x.args[0] == "NR") for x in ones) and not any(u.array is None for u in self.s.updates)
        if alone and folded and (guard := self.shared_guard(folded)) is not None:
            df, self.assumed = df.filter(self.c.test(guard)), guard
        for i, x in enumerate(sorted(ones, key=repr)):
            name = f"__f{i}"
            if x.op == "final":
                col, kind = self.final(x.args[0])
                if col is None:
                    c.known[x] = kind
                    continue
                aggs.append(col.alias(name))
            elif x.op == "lastrecord":
                if not self.order:
                    raise NotRelational("the last record needs an order")
                col, kind = F.coalesce(F.max_by(self.c.text(self.f.record), F.struct(*[F.col(f"`{q}`") for q in self.order])), F.lit("")), "F"
                aggs.append(col.alias(name))
            elif x.op == "lastfields":
                if not self.order:
                    raise NotRelational("the last record needs an order")
                aggs.append(F.coalesce(F.max_by(self.c.array(self.f.fields), F.struct(*[F.col(f"`{q}`") for q in self.order])), F.array().cast("array<string>")).alias(name))
                kind = "A"
            elif x.op == "total":
                array, k = x.args
                rel, cols = self.relation(array) if any(a == array for a, _ in self.f.cells) or any(u.array == array for u in self.s.updates) else (None, None)
                if rel is None:
                    c.known[x] = (F.lit(""), "U")
                    continue
                col, kind = cols[array]
                at = self.low.subsep.join(str(p.args[0]) for p in k)
                rels.append(self.present(rel, cols, array).filter(F.col("__k") == at).agg((F.first(col) if kind in "NW" else F.coalesce(F.first(col), F.lit(""))).alias(name)))
                kind = "W" if kind == "N" else kind
            elif x.op == "size":
                rel, cols = self.relation(x.args[0])
                rels.append(self.present(rel, cols, x.args[0]).agg(F.count(F.lit(1)).cast("double").alias(name)))
                kind = "N"
            else:
                rel, cols = self.relation(x.args[0])
                inner = self.low.columns(None, False)
                for a, (col, k) in cols.items():
                    inner.known[V("value", (a,), "?")] = (F.col(col), k)
                inner.known[V("rowkey", (x.args[0],), "S")] = (F.col("__k"), "S")
                how = {"relsum": F.sum, "relmax": F.max, "relmin": F.min}[x.op]
                rels.append(self.present(rel, cols, x.args[0]).agg(F.coalesce(how(inner.number(x.args[1])), F.lit(0.0)).alias(name)))
                kind = "N"
            c.known[x] = (F.col(name), kind)
        self.assumed = None
        out = df.agg(*aggs) if aggs else None
        for r in rels:
            out = r if out is None else out.join(F.broadcast(r), F.lit(True))  # a row each
        return out

    def final(self, name: str) -> tuple:
        if name == "NR":
            return F.count(F.lit(1)).cast("double"), "N"
        x = V("state", (name,), "?")
        if name not in self.f.vars:
            ups = [u for u in self.s.updates if u.array is None and u.name == name]
            if ups:
                return self.looped(ups), "N"
            start = self.low.constants.get(name)
            return None, (F.lit(start), "N") if isinstance(start, float) else (F.lit(str(start or "")), "U" if start is None else "S")
        return self.aggregate(x)

    def looped(self, ups: list[Update]) -> Column:
        """A sum over the fields of all records."""
        c = self.c
        total = F.lit(0.0)
        for u in ups:
            items = c.array(u.loop[0])
            if states(u.value) or u.guard is not None and any(x.op in ("item", "itemfield") for x in inside(u.guard)):
                raise NotRelational("a loop over fields tests fields while it sums up")

            def term(x, u=u):
                c.known[V("itemfield", (u.loop[0],), "F")] = (x, "F")
                return c.number(u.value)

            one = F.aggregate(from_place(items, u.loop[1]), F.lit(0.0), lambda a, x: a + term(x))
            total = total + F.coalesce(F.sum(one if u.guard is None else F.when(c.test(u.guard), one)), F.lit(0.0))
            c.known.pop(V("itemfield", (u.loop[0],), "F"), None)
        return total


__all__ = ["Binary", "End", "Lowered", "Lowering", "NotRelational", "Print", "is_const", "num", "pa"]
