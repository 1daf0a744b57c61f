"""Symbolic execution of actions: statements become values, guards and effects."""

from __future__ import annotations

from dataclasses import dataclass, field

from recordflow.lang.nodes import Assign, Binary, Block, Call, Cond, Delete, Do, Field, ForIn, Getline, Group, If, In, Index, Jump, Leave, Loop, Match, Num, Print, Regex, Step, Str, Unary, Var, walk
from recordflow.plans.symbols import EMPTY, ONE, UNSET, ZERO, NotRelational, V, both, cond, const_value, is_const, negated, num, of_value, text, truth
from recordflow.runtime.evaluator import arithmetic
from recordflow.runtime.values import compare, to_number, to_text

UNROLL = 64


@dataclass
class Output:
    guard: V | None
    args: tuple
    formatted: bool
    mode: str = ""
    to: V | None = None
    loop: tuple | None = None  # the fields that a loop goes over


@dataclass
class Update:
    """What a loop over fields does to an array or scalar: adds value at key."""

    array: str | None
    name: str
    key: tuple
    value: V
    guard: V | None
    loop: tuple


@dataclass
class Frame:
    """What names stand for while one record (or the end) is worked on."""

    vars: dict = field(default_factory=dict)
    cells: dict = field(default_factory=dict)  # (array, key) -> value
    made: dict = field(default_factory=dict)  # (array, key) -> guard under which it exists now
    record: V = field(default_factory=lambda: V("record", (), "F"))
    fields: V = field(default_factory=lambda: V("fields", (), "A"))
    alive: V | None = None

    def copy(self) -> Frame:
        return Frame(dict(self.vars), dict(self.cells), dict(self.made), self.record, self.fields, self.alive)


def implied(guard: V | None, part: V) -> bool:
    """Whether a guard is a conjunction with this part."""
    return guard is not None and (guard == part or guard.op == "and" and any(implied(a, part) for a in guard.args))


class Symbolic:
    def __init__(self, functions: dict, constants: dict, written: set, written_arrays: set, constant_arrays: dict, options: dict):
        self.functions, self.constants, self.options = functions, constants, options
        self.written, self.written_arrays, self.constant_arrays = written, written_arrays, constant_arrays
        self.outputs: list[Output] = []
        self.updates: list[Update] = []
        self.exits: list[V | None] = []
        self.skips: list[V | None] = []
        self.locals: list[dict] = []
        self.loop: tuple | None = None
        self.path: V | None = None
        self.reads: dict = {}  # (array, key) -> guards under which a plain read makes it
        self.ending = False
        self.updating = False
        self.enlarged: set = set()  # arrays of another origin that reads add to
        self.tested: set = set()  # and those whose keys are tested for
        self.looked_up: set = set()  # arrays that another input has filled
        self.in_rows: str | None = None  # at the end: the array whose rows are gone through

    # -- reading

    def guard(self, f: Frame) -> V | None:
        return both(self.path, f.alive)

    def read(self, f: Frame, name: str) -> V:
        if self.locals and name in self.locals[-1]:
            return self.locals[-1][name]
        if name in f.vars:
            return f.vars[name]
        if name == "NF":
            return V("nf", (f.fields,))
        if name in ("NR", "FNR", "FILENAME", "RT"):
            return V(name.lower(), (), "N" if name in ("NR", "FNR") else "S")
        if name in self.written:
            return V("state", (name,), "?")
        if name in self.constants:
            return of_value(self.constants[name])
        return UNSET

    def option(self, f: Frame, name: str) -> str:
        v = self.read(f, name)
        if not is_const(v):
            raise NotRelational(f"{name} varies")
        return to_text(const_value(v))

    def joined_text(self, f: Frame, v: V) -> V:
        if v.kind in ("S", "F"):
            return v
        if is_const(v):
            return text(to_text(const_value(v), self.option(f, "CONVFMT")))
        return V("text", (v, self.option(f, "CONVFMT")), "S")

    def plain_text(self, v: V) -> V:
        """Text arguments of functions have a fixed number format."""
        if v.kind in ("S", "F"):
            return v
        if is_const(v):
            return text(to_text(const_value(v)))
        return V("text", (v, "%.6g"), "S")

    def number(self, v: V) -> V:
        if v.kind == "N":
            return v
        if is_const(v):
            return num(to_number(const_value(v)))
        return V("tonum", (v,))

    def key(self, f: Frame, keys) -> tuple:
        return tuple(self.key_part(self.expr(f, k)) for k in keys)

    def key_part(self, v: V) -> V:
        if is_const(v):
            return text(to_text(const_value(v)))
        return v

    def field_at(self, f: Frame, i: V) -> V:
        i = self.number(i)
        if is_const(i):
            n = int(const_value(i))
            if n < 0:
                raise NotRelational("a negative field number")
            if n == 0:
                return f.record
            if f.fields.op == "setfield" and is_const(f.fields.args[1]) and f.fields.args[1].args[0] == n:
                return f.fields.args[2]
            return V("field", (f.fields, n), "F")
        if i == V("nf", (f.fields,)):
            return V("lastfield", (f.fields,), "F")
        if i.op == "item":
            return V("itemfield", (f.fields,), "F")
        return V("dynfield", (f.fields, f.record, i), "F")

    # -- expressions

    def expr(self, f: Frame, e) -> V:
        return getattr(self, "e_" + type(e).__name__)(f, e)

    def e_Num(self, f, e):
        return num(e.value)

    def e_Str(self, f, e):
        return text(e.value)

    def e_Group(self, f, e):
        return self.expr(f, e.value)

    def e_Regex(self, f, e):
        return V("match", (f.record, e.source))

    def e_Var(self, f, e):
        return self.read(f, e.name)

    def e_Field(self, f, e):
        return self.field_at(f, self.expr(f, e.index))

    def e_Index(self, f, e):
        k = self.key(f, e.keys)
        return self.cell(f, e.array, k)

    def cell(self, f: Frame, array: str, k: tuple) -> V:
        if "[" + array in f.vars:
            whole = f.vars["[" + array]
            if len(k) == 1 and k[0].op == "str" and k[0].args[0].isdigit() and k[0].args[0][0] != "0":
                return V("field", (whole, int(k[0].args[0])), "F")
            return V("dynfield", (whole, EMPTY, self.number(k[0])), "F")
        if (array, k) in f.cells:
            return f.cells[array, k]
        if any(a == array for a, _ in f.cells):
            raise NotRelational(f"{array} is used under several keys in one record")
        if self.ending:
            if self.in_rows is not None and len(k) == 1 and k[0].op == "rowkey":
                return V("value", (array,), "?")
            if all(map(is_const, k)):
                return V("total", (array, k), "?")
            raise NotRelational(f"{array} is looked up under a computed key at the end")
        if array in self.looked_up or array not in self.written_arrays and array in self.constant_arrays:
            if not implied(self.guard(f), V("inconst", (array, k))):
                self.enlarged.add(array)
        if array in self.looked_up:
            return V("lookup", (array, k), "?")
        if array not in self.written_arrays:
            return V("lookup", (array, k), "?") if array in self.constant_arrays else UNSET
        if not self.updating:
            self.reads.setdefault((array, k), []).append(self.guard(f))
        return V("cell", (array, k), "?")

    def e_In(self, f, e):
        k = self.key(f, e.keys)
        if (e.array, k) in f.made and f.made[e.array, k] is None:
            return ONE
        if self.ending:
            raise NotRelational("membership is tested at the end")
        if e.array not in self.written_arrays or e.array in self.looked_up:
            self.tested.add(e.array)
            return V("inconst", (e.array, k))
        if (e.array, k) in self.reads:
            raise NotRelational(f"an element of {e.array} is tested for after it was read")
        return V("held", (e.array, k))

    def e_Cond(self, f, e):
        t = truth(self.expr(f, e.test))
        return self.branch(f, t, lambda g: self.expr(g, e.yes), lambda g: self.expr(g, e.no))

    def branch(self, f: Frame, t: V, yes, no):
        """Both ways of a test; what they change is merged."""
        if t.op == "num":
            return (yes if t.args[0] else no)(f)
        a, b, path = f.copy(), f.copy(), self.path
        self.path = both(path, t)
        x = yes(a)
        self.path = both(path, negated(t))
        y = no(b)
        self.path = path
        self.merge(f, t, a, b)
        return cond(t, x, y) if x is not None and y is not None else None

    def merge(self, f: Frame, t: V, a: Frame, b: Frame) -> None:
        for name in a.vars.keys() | b.vars.keys():
            f.vars.pop(name, None)
            old = self.read(f, name) if name not in ("NF",) else None
            f.vars[name] = cond(t, a.vars.get(name, old), b.vars.get(name, old))
        for at in a.cells.keys() | b.cells.keys():
            old = V("cell", at, "?")
            f.cells[at] = cond(t, a.cells.get(at, old), b.cells.get(at, old))
            g = [x.made.get(at, ZERO) for x in (a, b)]
            made = cond(t, ONE if g[0] is None else g[0], ONE if g[1] is None else g[1])
            f.made[at] = None if made == ONE else made
        f.record = cond(t, a.record, b.record)
        if a.fields != b.fields:
            f.fields = V("condfields", (t, a.fields, b.fields), "A")
        else:
            f.fields = a.fields
        alive = cond(t, ONE if a.alive is None else a.alive, ONE if b.alive is None else b.alive)
        f.alive = None if alive == ONE else alive

    def e_Binary(self, f, e):
        op = e.op
        if op in ("&&", "||"):
            a = truth(self.expr(f, e.left))
            if a.op == "num":
                return truth(self.expr(f, e.right)) if bool(a.args[0]) == (op == "&&") else a
            if op == "&&":
                b = self.branch(f, a, lambda g: truth(self.expr(g, e.right)), lambda g: ZERO)
                return b if b.op != "cond" else V("and", (a, b.args[1]))
            b = self.branch(f, a, lambda g: ONE, lambda g: truth(self.expr(g, e.right)))
            return b if b.op != "cond" else V("or", (a, b.args[2]))
        a = self.expr(f, e.left)
        b = self.expr(f, e.right)
        if op == "":
            a, b = self.joined_text(f, a), self.joined_text(f, b)
            if a.op == b.op == "str":
                return text(a.args[0] + b.args[0])
            return V("concat", (a, b), "S")
        if op in ("<", ">", "<=", ">=", "==", "!="):
            if is_const(a) and is_const(b):
                return num(compare(op, const_value(a), const_value(b)))
            return V("cmp", (op, a, b))
        return self.arith(op, a, b)

    def arith(self, op: str, a: V, b: V) -> V:
        a, b = self.number(a), self.number(b)
        if a.op == b.op == "num" and not (op in "/%" and b.args[0] == 0):
            return num(arithmetic(op, a.args[0], b.args[0]))
        return V("arith", (op, a, b))

    def e_Unary(self, f, e):
        v = self.expr(f, e.value)
        if e.op == "!":
            return negated(v)
        v = self.number(v)
        if e.op == "+":
            return v
        return num(-v.args[0]) if v.op == "num" else V("neg", (v,))

    def pattern_of(self, f: Frame, e) -> V | str:
        while isinstance(e, Group):
            e = e.value
        if isinstance(e, Regex):
            return e.source
        v = self.plain_text(self.expr(f, e))
        if v.op != "str":
            raise NotRelational("a regular expression varies")
        return v.args[0]

    def e_Match(self, f, e):
        v = V("match", (self.plain_text(self.expr(f, e.left)), self.pattern_of(f, e.right)))
        return negated(v) if e.negated else v

    def e_Getline(self, f, e):
        raise NotRelational("getline")

    # -- assignment

    def assign(self, f: Frame, t, v: V) -> V:
        alive = f.alive
        put = (lambda old: v) if alive is None else (lambda old: cond(alive, v, old))
        if isinstance(t, Var):
            if self.locals and t.name in self.locals[-1]:
                self.locals[-1][t.name] = put(self.locals[-1][t.name])
                return v
            if t.name == "NF":
                f.fields = V("resize", (f.fields, self.number(v)), "A")
                f.record = V("joinfields", (f.fields, self.option(f, "OFS")), "S")
                return v
            if t.name in ("NR", "FNR", "FS", "RS", "RT", "FILENAME", "SUBSEP", "CONVFMT", "OFMT"):
                raise NotRelational(f"{t.name} is assigned to")
            f.vars[t.name] = put(self.read(f, t.name))
            return v
        if alive is not None and isinstance(t, Field):
            raise NotRelational("a field is assigned to after a conditional next")
        if isinstance(t, Field):
            i = self.number(self.expr(f, t.index))
            if is_const(i) and i.args[0] == 0:
                f.record = self.joined_text(f, v)
                f.fields = V("splitfields", (f.record, self.option(f, "FS")), "A")
                return v
            f.fields = V("setfield", (f.fields, i, v), "A")
            f.record = V("joinfields", (f.fields, self.option(f, "OFS")), "S")
            return v
        k = self.key(f, t.keys)
        before, self.updating = self.updating, True
        old = self.cell(f, t.array, k)
        self.updating = before
        f.cells[t.array, k] = put(old)
        made = both(self.path, alive)
        before = f.made.get((t.array, k), ZERO)
        f.made[t.array, k] = None if made is None or before is None else made if before == ZERO else V("or", (before, made))
        return v

    def e_Assign(self, f, e):
        if self.loop is not None and (u := self.loop_update(f, e.target, e.op, e.value)) is not None:
            return u
        if not e.op:
            v = self.expr(f, e.value)
            return self.assign(f, e.target, v)
        old = self.old(f, e.target)
        return self.assign(f, e.target, self.arith(e.op, old, self.expr(f, e.value)))

    def old(self, f, target) -> V:
        """The value before an update, which isn't a read that may enlarge an array."""
        before, self.updating = self.updating, True
        v = self.expr(f, target)
        self.updating = before
        return v

    def e_Step(self, f, e):
        if self.loop is not None and (u := self.loop_update(f, e.target, "+", Num(float(e.delta)))) is not None:
            return u
        old = self.number(self.old(f, e.target))
        new = self.arith("+", old, num(e.delta))
        self.assign(f, e.target, new)
        return new if e.prefix else old

    def loop_update(self, f: Frame, target, op: str, value):
        """In a loop over fields only sums may outlive an iteration."""
        if isinstance(target, Var) and (self.locals and target.name in self.locals[-1] or target.name in self.loop_vars):
            return None
        if isinstance(target, Field):
            raise NotRelational("a loop over fields assigns to fields")
        if op not in ("+", "-"):
            raise NotRelational("a loop over fields does more than sum up")
        v = self.number(self.expr(f, value))
        v = v if op == "+" else V("neg", (v,)) if v.op != "num" else num(-v.args[0])
        if isinstance(target, Var):
            self.updates.append(Update(None, target.name, (), v, self.guard(f), self.loop))
        else:
            self.updates.append(Update(target.array, target.array, self.key(f, target.keys), v, self.guard(f), self.loop))
        return V("unknown")

    # -- functions

    def e_Call(self, f, e):
        if not e.builtin:
            return self.inline(f, e)
        a = e.args
        name = e.name
        if name == "length":
            if not a:
                return V("length", (f.record,))
            inner = a[0].value if isinstance(a[0], Group) else a[0]
            if isinstance(inner, Var) and inner.name in self.written_arrays | set(self.constant_arrays):
                if self.ending:
                    return V("size", (inner.name,))
                raise NotRelational("an array's length is read while it grows")
            return V("length", (self.plain_text(self.expr(f, a[0])),))
        if name in ("tolower", "toupper"):
            return V(name, (self.plain_text(self.expr(f, a[0])),), "S")
        if name == "substr":
            return V("substr", (self.plain_text(self.expr(f, a[0])), *[self.number(self.expr(f, x)) for x in a[1:]]), "S")
        if name == "index":
            return V("index", tuple(self.plain_text(self.expr(f, x)) for x in a))
        if name in ("sin", "cos", "exp", "log", "sqrt", "int", "atan2", "and", "or", "xor", "lshift", "rshift"):
            return V("math", (name, tuple(self.number(self.expr(f, x)) for x in a)))
        if name == "sprintf":
            fmt = self.plain_text(self.expr(f, a[0]))
            if fmt.op != "str":
                raise NotRelational("a format varies")
            return V("sprintf", (fmt.args[0], tuple(self.expr(f, x) for x in a[1:]), self.option(f, "CONVFMT")), "S")
        if name == "strftime":
            fmt = self.plain_text(self.expr(f, a[0])) if a else text("%Y-%m-%d %H:%M:%S")
            if fmt.op != "str":
                raise NotRelational("a format varies")
            return V("strftime", (fmt.args[0], self.number(self.expr(f, a[1])) if len(a) > 1 else V("systime")), "S")
        if name == "systime":
            return V("systime")
        if name in ("sub", "gsub"):
            target = a[2] if len(a) > 2 else Field(Num(0.0))
            repl = self.plain_text(self.expr(f, a[1]))
            if repl.op != "str":
                raise NotRelational("a replacement varies")
            args = (self.plain_text(self.expr(f, target)), self.pattern_of(f, a[0]), repl.args[0], name == "gsub")
            count = V("subcount", args)
            if isinstance(target, (Var, Field, Index)):
                new = V("subtext", args, "S")
                if isinstance(target, Field) and isinstance(target.index, Num) and target.index.value == 0 and f.alive is None:
                    f.record = new  # without a match text and fields come out the same
                    f.fields = V("splitfields", (new, self.option(f, "FS")), "A")
                else:
                    old = self.expr(f, target)
                    self.assign(f, target, new if old.kind == "S" else cond(V("match", args[:2]), new, old))
            return count
        if name == "match":
            args = (self.plain_text(self.expr(f, a[0])), self.pattern_of(f, a[1]))
            self.assign(f, Var("RSTART"), V("matchstart", args))
            self.assign(f, Var("RLENGTH"), V("matchlength", args))
            return V("matchstart", args)
        if name == "split":
            s = self.plain_text(self.expr(f, a[0]))
            array = a[1].name
            if len(a) > 2 and isinstance(a[2], Regex):
                whole = V("splitfields", (s, a[2].source, True), "A")
            else:
                sep = self.plain_text(self.expr(f, a[2])) if len(a) > 2 else text(self.option(f, "FS"))
                if sep.op != "str":
                    raise NotRelational("a separator varies")
                whole = V("splitfields", (s, sep.args[0]), "A")
            f.vars["[" + array] = whole
            return V("nf", (whole,))
        if name == "rand":
            return V("rand")
        if name in ("close", "fflush"):
            return ZERO
        raise NotRelational(f"{name} is called")

    def inline(self, f: Frame, e) -> V:
        """A function that ends in one return, or in returns in both ways of tests."""
        fn = self.functions[e.name]
        if len(self.locals) > 8:
            raise NotRelational("functions call one another deeply")
        if any(isinstance(n, (Loop, ForIn, Index, Delete)) for n in walk(fn.body)):
            raise NotRelational(f"function {e.name} loops or uses arrays")
        frame = dict.fromkeys(fn.params, UNSET)
        frame.update(zip(fn.params, [self.expr(f, a) for a in e.args], strict=False))
        self.locals.append(frame)
        try:
            v = self.returned(f, list(fn.body.body))
        finally:
            self.locals.pop()
        return v

    def returned(self, f: Frame, body: list) -> V:
        for i, s in enumerate(body):
            if isinstance(s, Leave) and s.kind == "return":
                return self.expr(f, s.value) if s.value is not None else UNSET
            if isinstance(s, Block):
                return self.returned(f, [*s.body, *body[i + 1 :]])
            if isinstance(s, If) and any(isinstance(n, Leave) for n in walk(s)):
                t = truth(self.expr(f, s.test))
                keep = dict(self.locals[-1])
                yes = self.returned(f, [s.yes, *body[i + 1 :]])
                self.locals[-1] = dict(keep)
                no = self.returned(f, ([s.no] if s.no is not None else []) + body[i + 1 :])
                self.locals[-1] = keep
                return cond(t, yes, no)
            self.stmt(f, s)
        return UNSET

    # -- statements

    def stmt(self, f: Frame, s) -> None:
        if s is not None:
            getattr(self, "s_" + type(s).__name__)(f, s)

    def s_Block(self, f, s):
        for x in s.body:
            if f.alive == ZERO:
                return
            self.stmt(f, x)

    def s_Do(self, f, s):
        self.expr(f, s.value)

    def s_If(self, f, s):
        t = truth(self.expr(f, s.test))
        if self.locals:
            before = dict(self.locals[-1])
            after: list[dict] = []

            def side(x):
                def run(g):
                    self.locals[-1] = dict(before)
                    self.stmt(g, x)
                    after.append(self.locals[-1])

                return run

            self.branch(f, t, side(s.yes), side(s.no))
            self.locals[-1] = after[0] if len(after) == 1 else {k: cond(t, after[0][k], after[1][k]) for k in before}
            return
        self.branch(f, t, lambda g: self.stmt(g, s.yes), lambda g: self.stmt(g, s.no))

    def s_Print(self, f, s):
        args = tuple(self.expr(f, a) for a in s.args) or (f.record,)
        to = None
        if s.mode:
            to = self.joined_text(f, self.expr(f, s.to))
        self.outputs.append(Output(self.guard(f), args, s.formatted, s.mode, to, self.loop))

    def s_Jump(self, f, s):
        if s.kind == "next":
            f.alive = ZERO if self.path is None else both(f.alive, ZERO)
            return
        if s.kind == "nextfile":
            self.skips.append(self.guard(f))
            f.alive = ZERO
            return
        raise NotRelational(f"{s.kind} in a loop")

    def s_Leave(self, f, s):
        if s.kind == "exit" and not self.ending:
            self.exits.append(self.guard(f))
            f.alive = ZERO
            return
        raise NotRelational(s.kind)

    def s_Delete(self, f, s):
        raise NotRelational("delete")

    def s_Loop(self, f, s):
        if self.field_loop(f, s):
            return
        self.stmt(f, s.start)
        for _ in range(UNROLL):
            t = truth(self.expr(f, s.test)) if s.test is not None else ONE
            if t.op != "num":
                raise NotRelational("a loop's length depends on the record")
            if not t.args[0]:
                return
            self.stmt(f, s.body)
            self.stmt(f, s.step)
        raise NotRelational("a long loop")

    loop_vars: frozenset = frozenset()

    def field_loop(self, f: Frame, s) -> bool:
        """for (i = 1; i <= NF; i++): its body is done once for each field."""
        if not (isinstance(s.start, Do) and isinstance(s.start.value, Assign) and isinstance(s.start.value.target, Var) and s.start.value.op == "" and isinstance(s.start.value.value, Num)):
            return False
        i = s.start.value.target.name
        if not (isinstance(s.test, Binary) and s.test.op == "<=" and s.test.left == Var(i)):
            return False
        if s.step not in (Do(Step(1, False, Var(i))), Do(Step(1, True, Var(i)))):
            return False
        end = self.expr(f, s.test.right)
        if end.op != "nf" or self.loop is not None:
            return False
        g = f.copy()
        self.loop = (end.args[0], int(s.start.value.value.value))
        self.loop_vars = frozenset({i})
        g.vars[i] = V("item", (self.loop[1],))
        before = set(g.vars)
        self.stmt(g, s.body)
        if set(g.vars) - before or g.cells != f.cells or g.alive != f.alive:
            raise NotRelational("a loop over fields does more than sum up")
        self.loop, self.loop_vars = None, frozenset()
        f.vars[i] = self.arith("+", end, ONE)
        return True

    def s_ForIn(self, f, s):
        raise NotRelational("an array is gone through before the end")


__all__ = ["EMPTY", "Frame", "Output", "Symbolic", "Update", "In"]
