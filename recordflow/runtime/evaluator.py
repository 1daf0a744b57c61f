"""Sequential evaluator: the executable meaning of the language, and the last resort for
programs that have no relational form. The syntax tree is turned into closures once."""

from __future__ import annotations

import math
import random
import subprocess
import sys
import time
from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from recordflow.lang.nodes import (
    Assign,
    Binary,
    Block,
    Call,
    Cond,
    Delete,
    Do,
    Field,
    ForIn,
    Getline,
    Group,
    If,
    In,
    Index,
    Jump,
    Leave,
    Loop,
    Match,
    Num,
    Print,
    ProgramError,
    Regex,
    Step,
    Str,
    Tree,
    Unary,
    Var,
)
from recordflow.lang.validate import array_parameters
from recordflow.runtime.ere import compile_ere, split_text, substitute
from recordflow.runtime.formats import sprintf
from recordflow.runtime.records import Listed, TextReader, csv_fields
from recordflow.runtime.values import compare, from_input, to_number, to_text, truth


class Signal(Exception):
    def __init__(self, value=None):
        super().__init__()
        self.value = value


class NextRecord(Signal):
    pass


class NextFile(Signal):
    pass


class Exit(Signal):
    pass


class Return(Signal):
    pass


class Break(Signal):
    pass


class Continue(Signal):
    pass


JUMPS = {"next": NextRecord, "nextfile": NextFile, "break": Break, "continue": Continue}
SPECIAL = {"NF", "NR", "FNR", "FS", "OFS", "ORS", "RS", "OFMT", "CONVFMT", "SUBSEP", "RT", "RSTART", "RLENGTH", "FILENAME"}


def arithmetic(op: str, a: float, b: float) -> float:
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        if b == 0:
            raise ProgramError("division by zero")
        return a / b
    if op == "%":
        if b == 0:
            raise ProgramError("division by zero in %")
        return math.fmod(a, b) if not math.isinf(a) else math.nan
    return power(a, b)


def power(a: float, b: float) -> float:
    try:
        x = a**b
        return math.nan if isinstance(x, complex) else float(x)
    except OverflowError:
        return math.inf if a > 0 or b % 2 == 0 else -math.inf
    except ZeroDivisionError:
        return math.inf


def whole(x: float) -> int:
    """A number cut to a 64-bit integer; what is out of range becomes the nearest."""
    if x != x:
        return 0
    return max(-(1 << 63), min((1 << 63) - 1, int(x) if math.isfinite(x) else (1 << 63) * (1 if x > 0 else -1)))


class Evaluator:
    def __init__(self, tree: Tree, fs: str | None = None, csv: bool = False, variables: Iterable[tuple[str, str]] = (), environ: dict | None = None, arguments: Iterable[str] = (), write: Callable[[str], None] | None = None, shell: bool = False):
        self.tree, self.csv, self.shell = tree, csv, shell
        self.write = write or sys.stdout.write
        self.vars: dict = {"FS": fs if fs is not None else "," if csv else " ", "OFS": " ", "ORS": "\n", "RS": "\n", "OFMT": "%.6g", "CONVFMT": "%.6g", "SUBSEP": "\x1c", "NR": 0.0, "FNR": 0.0, "RT": None, "FILENAME": None, "RSTART": None, "RLENGTH": None}
        names = ["recordflow", *arguments]
        self.arrays: dict[str, dict] = {"ENVIRON": {k: from_input(v) for k, v in (environ or {}).items()}, "ARGV": {str(i): from_input(a) for i, a in enumerate(names)}}
        self.vars["ARGC"] = float(len(names))
        self.record, self.fields, self.nf = "", [], 0
        self.split_done = True
        self.reader = None
        self.readers: dict[str, TextReader] = {}
        self.outputs: dict[str, object] = {}
        self.random, self.seed = random.Random(0), 0.0
        self.frames: list[dict] = []
        self.code = 0
        self.fresh_array = 0
        self.array_params = array_parameters(tree)
        self.locals_of: tuple = ()
        self.functions = {}
        for f in tree.functions.values():
            self.locals_of = f.params
            self.functions[f.name] = (f, self.statement(f.body))
        self.locals_of = ()
        self.rules = []
        for i, r in enumerate(tree.rules):
            action = self.statement(r.action) if r.action else None
            pattern = self.condition(r.pattern) if r.pattern is not None else None
            until = self.condition(r.until) if r.until is not None else None
            self.rules.append((i, r.kind, pattern, until, action))
        self.inside = [False] * len(tree.rules)
        for name, text in variables:
            self.assign(name, from_input(text))

    # -- record and fields

    def set_record(self, text: str) -> None:
        self.record = text
        self.split_done = False

    def split_now(self) -> list:
        """Fields are cut when first asked for, under the separator of reading time."""
        if not self.split_done:
            self.split_done = True
            fs = self.fs_of_record
            if self.csv:
                parts = csv_fields(self.record)
            elif self.rs_of_record == "" and fs not in (" ", ""):
                parts = split_text(self.record, "\n|" + (fs if len(fs) > 1 else "[" + fs + "]" if fs not in "\\^" else "\\" + fs), True)
            else:
                parts = split_text(self.record, fs)
            self.fields = [from_input(p) for p in parts]
        return self.fields

    fs_of_record, rs_of_record = " ", "\n"

    def take_record(self, text: str) -> None:
        self.fs_of_record, self.rs_of_record = to_text(self.vars["FS"]), to_text(self.vars["RS"])
        self.set_record(text)

    def field(self, i: float):
        if i != i or i < 0 or i > 2147483647:
            raise ProgramError(f"bad field number {i:g}")
        n = int(i)
        if n == 0:
            return from_input(self.record)
        f = self.split_now()
        return f[n - 1] if n <= len(f) else ""

    def set_field(self, i: float, v) -> None:
        if i != i or i < 0 or i > 2147483647:
            raise ProgramError(f"bad field number {i:g}")
        n = int(i)
        if n == 0:
            self.fs_of_record = to_text(self.vars["FS"])
            self.set_record(self.text(v))
            return
        f = self.split_now()
        f.extend([""] * (n - len(f)))
        f[n - 1] = v
        self.rebuild()

    def rebuild(self) -> None:
        self.record = to_text(self.vars["OFS"]).join(map(self.text, self.fields))

    def text(self, v) -> str:
        return to_text(v, self.vars["CONVFMT"]) if isinstance(v, float) else to_text(v)

    # -- variables

    def get(self, name: str):
        if name == "NF":
            return float(len(self.split_now()))
        return self.vars.get(name)

    def assign(self, name: str, v):
        if name == "NF":
            n = whole(to_number(v))
            if n < 0:
                raise ProgramError("NF can't be negative")
            f = self.split_now()
            del f[n:]
            f.extend([""] * (n - len(f)))
            self.rebuild()
            return v
        if name in self.arrays or name in self.functions:
            raise ProgramError(f"can't assign to {name}: it's no scalar")
        self.vars[name] = v
        return v

    def array(self, name: str) -> dict:
        if name in self.vars and self.vars[name] is not None:
            raise ProgramError(f"can't use scalar {name} as an array")
        return self.arrays.setdefault(name, {})

    # -- expressions

    def expression(self, e) -> Callable:
        if e is None:
            return lambda: None
        return getattr(self, "e_" + type(e).__name__)(e)

    def number(self, e) -> Callable:
        if isinstance(e, Num):
            v = e.value
            return lambda: v
        f = self.expression(e)
        return lambda: x if type(x := f()) is float else to_number(x)

    def condition(self, e) -> Callable:
        if isinstance(e, Regex):
            ere = compile_ere(e.source)
            return lambda: ere.matches(self.record)
        f = self.expression(e)
        return lambda: truth(f())

    def e_Num(self, e):
        v = e.value
        return lambda: v

    def e_Str(self, e):
        v = e.value
        return lambda: v

    def e_Group(self, e):
        return self.expression(e.value)

    def e_Regex(self, e):
        ere = compile_ere(e.source)
        return lambda: 1.0 if ere.matches(self.record) else 0.0

    def is_local(self, name: str) -> bool:
        return name in self.locals_of

    def e_Var(self, e):
        name = e.name
        if self.is_local(name):

            def local():
                v = self.frames[-1][name]
                if isinstance(v, (dict, Lazy)):
                    if isinstance(v, Lazy):
                        return None
                    raise ProgramError(f"can't use array {name} in a scalar context")
                return v

            return local
        if name in self.tree.functions:
            raise ProgramError(f"cannot read function {name} as a value")
        if name == "NF":
            return lambda: float(len(self.split_now()))

        def plain():
            if name in self.arrays and name not in self.vars:
                raise ProgramError(f"can't use array {name} in a scalar context")
            return self.vars.get(name)

        return plain

    def array_of(self, name: str) -> Callable:
        if not self.is_local(name):
            return lambda: self.array(name)

        def local():
            v = self.frames[-1][name]
            if v is None:
                v = self.frames[-1][name] = {}
            elif isinstance(v, Lazy):
                v = self.frames[-1][name] = v.array()
            if not isinstance(v, dict):
                raise ProgramError(f"can't use scalar {name} as an array")
            return v

        return local

    def key(self, keys) -> Callable:
        if len(keys) == 1:
            f = self.expression(keys[0])
            return lambda: x if type(x := f()) is str else self.text(x)
        parts = [self.expression(k) for k in keys]

        def joined():
            out = self.text(parts[0]())
            for p in parts[1:]:
                sep = to_text(self.vars["SUBSEP"])
                out = out + sep + self.text(p())
            return out

        return joined

    def e_Field(self, e):
        if isinstance(e.index, Num):
            i = e.index.value
            if i == 0:
                return lambda: from_input(self.record)
            n = int(i)

            def at():
                f = self.fields if self.split_done else self.split_now()
                return f[n - 1] if n <= len(f) else ""

            return at if n > 0 else lambda: self.field(i)
        f = self.number(e.index)
        return lambda: self.field(f())

    def e_Index(self, e):
        a, k = self.array_of(e.array), self.key(e.keys)

        def read():
            x, key = a(), k()
            if key not in x:
                x[key] = None
            return x[key]

        return read

    def target(self, t) -> tuple[Callable, Callable]:
        """For an assignable: what evaluates its place once, and then get and set."""
        if isinstance(t, Var):
            name = t.name
            if self.is_local(name):

                def put_local(_, v):
                    if isinstance(self.frames[-1][name], dict):
                        raise ProgramError(f"can't assign to array {name}")
                    self.frames[-1][name] = v

                return lambda: None, lambda _: self.frames[-1][name] if not isinstance(self.frames[-1][name], Lazy) else None, put_local
            return lambda: None, lambda _: self.get(name), lambda _, v: self.assign(name, v)
        if isinstance(t, Field):
            i = self.number(t.index)
            return i, lambda p: self.field(p), lambda p, v: self.set_field(p, v)
        a, k = self.array_of(t.array), self.key(t.keys)

        def put(p, v):
            p[0][p[1]] = v

        return lambda: (a(), k()), lambda p: p[0].setdefault(p[1], None), put

    def e_Assign(self, e):
        place, get, put = self.target(e.target)
        if not e.op:
            f = self.expression(e.value)

            def plain():
                p = place()
                v = f()
                put(p, v)
                return v

            return plain
        op, f = e.op, self.number(e.value)

        def update():
            p = place()
            old = to_number(get(p))
            v = arithmetic(op, old, f())
            put(p, v)
            return v

        return update

    def e_Step(self, e):
        place, get, put = self.target(e.target)
        delta, prefix = float(e.delta), e.prefix

        def step():
            p = place()
            old = to_number(get(p))
            put(p, old + delta)
            return old + delta if prefix else old

        return step

    def e_Cond(self, e):
        test, yes, no = self.condition(e.test), self.expression(e.yes), self.expression(e.no)
        return lambda: yes() if test() else no()

    def e_Binary(self, e):
        op = e.op
        if op in ("&&", "||"):
            a, b = self.condition(e.left), self.condition(e.right)
            if op == "&&":
                return lambda: 1.0 if a() and b() else 0.0
            return lambda: 1.0 if a() or b() else 0.0
        if op == "":
            a, b = self.expression(e.left), self.expression(e.right)
            return lambda: self.text(a()) + self.text(b())
        if op in ("<", ">", "<=", ">=", "==", "!="):
            a, b = self.expression(e.left), self.expression(e.right)

            def cmp():
                x = a()
                return 1.0 if compare(op, x, b(), self.vars["CONVFMT"]) else 0.0

            return cmp
        a, b = self.number(e.left), self.number(e.right)
        if op == "+":
            return lambda: a() + b()
        if op == "-":
            return lambda: a() - b()
        if op == "*":
            return lambda: a() * b()

        def binary():
            x = a()
            return arithmetic(op, x, b())

        return binary

    def e_Unary(self, e):
        if e.op == "!":
            f = self.condition(e.value)
            return lambda: 0.0 if f() else 1.0
        f = self.number(e.value)
        return (lambda: -f()) if e.op == "-" else f

    def ere_of(self, e) -> Callable:
        """A regular expression, literal or from a text."""
        if isinstance(e, Group):
            return self.ere_of(e.value)
        if isinstance(e, Regex):
            ere = compile_ere(e.source)
            return lambda: ere
        f = self.expression(e)
        return lambda: compile_ere(to_text(f()))

    def e_Match(self, e):
        a, r, yes = self.expression(e.left), self.ere_of(e.right), not e.negated

        def match():
            text = to_text(a())
            return 1.0 if r().matches(text) == yes else 0.0

        return match

    def e_In(self, e):
        k, a = self.key(e.keys), self.array_of(e.array)
        return lambda: 1.0 if k() in a() else 0.0

    def e_Getline(self, e):
        source = self.expression(e.operand) if e.operand is not None else None
        place, _, put = self.target(e.target) if e.target is not None else (None, None, None)

        def getline():
            if e.source == "main":
                got = self.read_main()
                if got is None:
                    return 0.0
                if put:
                    put(place(), from_input(got))
                else:
                    self.take_record(got)
                return 1.0
            name = to_text(source())
            try:
                reader = self.reader_of(e.source, name)
            except OSError:
                return -1.0
            got = reader.next(to_text(self.vars["RS"]), self.csv)
            if got is None:
                return 0.0
            self.vars["RT"] = got[1]
            if put:
                put(place(), from_input(got[0]))
            else:
                self.take_record(got[0])
            return 1.0

        return getline

    def reader_of(self, source: str, name: str) -> TextReader:
        if name == "-" and source == "file" and self.reader is not None:
            return self.reader
        if name not in self.readers:
            if source == "command":
                if not self.shell:
                    raise ProgramError("commands aren't allowed here")
                done = subprocess.run(["sh", "-c", name], stdout=subprocess.PIPE, check=False)
                self.readers[name] = TextReader(done.stdout.decode(errors="replace"))
                self.readers[name].status = done.returncode
            else:
                out = self.outputs.get(name)
                if out is not None:
                    out.flush()
                with open(name, encoding="utf-8", errors="replace", newline="") as f:
                    self.readers[name] = TextReader(f.read())
        return self.readers[name]

    def e_Call(self, e):
        if e.builtin:
            return getattr(self, "f_" + e.name)(e.args)
        if e.name not in self.tree.functions:
            raise ProgramError(f"unknown function '{e.name}'")
        f = self.tree.functions[e.name]
        arrays = self.array_params[e.name]
        given: list[Callable] = []
        for i, a in enumerate(e.args):
            inner = a.value if isinstance(a, Group) else a
            if isinstance(inner, Var) and i in arrays:
                given.append(self.array_of(inner.name))
            elif isinstance(inner, Var) and (self.is_local(inner.name) or inner.name not in SPECIAL):
                given.append(self.passed(inner.name))
            else:
                given.append(self.expression(a))
        params = f.params

        def call():
            values = [g() for g in given]
            frame = dict.fromkeys(params)
            frame.update(zip(params, values, strict=False))
            if len(self.frames) > 900:
                raise ProgramError("functions call one another too deeply")
            self.frames.append(frame)
            try:
                self.functions[e.name][1]()
            except Return as r:
                return r.value
            finally:
                self.frames.pop()
            return None

        return call

    def passed(self, name: str) -> Callable:
        """An argument that is a bare name: its value, its array, or, while it is
        neither, whatever the function makes of it."""
        if self.is_local(name):
            frame_of = lambda: self.frames[-1]

            def local():
                v = frame_of()[name]
                return Lazy(frame_of(), name) if v is None else v

            return local

        def plain():
            if name in self.arrays:
                return self.arrays[name]
            v = self.vars.get(name)
            return Lazy(self.arrays, name) if v is None and name not in self.vars else v

        return plain

    # -- functions of the language

    def f_length(self, args):
        if not args:
            return lambda: float(len(self.record))
        a = args[0].value if isinstance(args[0], Group) else args[0]
        if isinstance(a, Var) and a.name not in SPECIAL:
            name = a.name

            if self.is_local(name):
                return lambda: float(len(v) if isinstance(v := self.frames[-1][name], dict) else 0 if isinstance(v, Lazy) else len(to_text(v)))
            return lambda: float(len(self.arrays[name]) if name in self.arrays else len(to_text(self.vars.get(name))))
        f = self.expression(args[0])
        return lambda: float(len(to_text(f())))

    def f_tolower(self, args):
        f = self.expression(args[0])
        return lambda: simple_case(to_text(f()), str.lower)

    def f_toupper(self, args):
        f = self.expression(args[0])
        return lambda: simple_case(to_text(f()), str.upper)

    def f_substr(self, args):
        s, m = self.expression(args[0]), self.number(args[1])
        n = self.number(args[2]) if len(args) > 2 else None

        def substr():
            text, a = to_text(s()), max(whole(m()), 1) - 1
            if n is None:
                return text[a:]
            return text[a : a + max(whole(n()), 0)]

        return substr

    def f_index(self, args):
        s, t = map(self.expression, args)

        def index():
            text, part = to_text(s()), to_text(t())
            return float(text.find(part) + 1) if text else 0.0

        return index

    def f_split(self, args):
        s, a = self.expression(args[0]), self.array_of(args[1].name)
        regex = args[2] if len(args) > 2 and isinstance(args[2], Regex) else None
        sep = self.expression(args[2]) if len(args) > 2 and regex is None else None

        def split():
            text = to_text(s())
            if regex is not None:
                parts = split_text(text, regex.source, True)
            elif sep is not None:
                parts = split_text(text, to_text(sep()))
            else:
                parts = csv_fields(text) if self.csv else split_text(text, to_text(self.vars["FS"]))
            x = a()
            x.clear()
            x.update((str(i), from_input(p)) for i, p in enumerate(parts, 1))
            return float(len(parts))

        return split

    def f_match(self, args):
        s, r = self.expression(args[0]), self.ere_of(args[1])

        def match():
            m = r().search(to_text(s()))
            self.vars["RSTART"] = float(m[0] + 1) if m else 0.0
            self.vars["RLENGTH"] = float(m[1] - m[0]) if m else -1.0
            return self.vars["RSTART"]

        return match

    def _substituted(self, args, every):
        r, t = self.ere_of(args[0]), self.expression(args[1])
        place, get, put = self.target(args[2] if len(args) > 2 else Field(Num(0.0))) if len(args) < 3 or isinstance(args[2], (Var, Field, Index)) else (lambda: None, self.discarded(args[2]), lambda p, v: None)

        def sub():
            ere, repl = r(), to_text(t())
            p = place()
            out, n = substitute(ere, repl, to_text(get(p)), every)
            if n:
                put(p, out)
            return float(n)

        return sub

    def discarded(self, e):
        f = self.expression(e)
        return lambda _: f()

    def f_sub(self, args):
        return self._substituted(args, False)

    def f_gsub(self, args):
        return self._substituted(args, True)

    def f_sprintf(self, args):
        f, rest = self.expression(args[0]), [self.expression(a) for a in args[1:]]
        return lambda: sprintf(to_text(f()), [r() for r in rest], self.vars["CONVFMT"])

    def _math(self, args, fn):
        f = self.number(args[0])
        return lambda: fn(f())

    def f_sin(self, args):
        return self._math(args, lambda x: math.sin(x) if math.isfinite(x) else math.nan)

    def f_cos(self, args):
        return self._math(args, lambda x: math.cos(x) if math.isfinite(x) else math.nan)

    def f_exp(self, args):
        return self._math(args, safe_exp)

    def f_log(self, args):
        return self._math(args, lambda x: math.log(x) if x > 0 else x if x != x else 1.0)

    def f_sqrt(self, args):
        return self._math(args, lambda x: math.sqrt(x) if x >= 0 else x if x != x else 1.0)

    def f_int(self, args):
        return self._math(args, lambda x: float(math.trunc(x)) if math.isfinite(x) else x)

    def f_atan2(self, args):
        y = self.number(args[0])
        if len(args) < 2:
            return lambda: 1.0
        x = self.number(args[1])
        return lambda: math.atan2(y(), x())

    def f_rand(self, args):
        return lambda: self.random.random()

    def f_srand(self, args):
        f = self.number(args[0]) if args else None

        def srand():
            before, self.seed = self.seed, f() if f else float(int(time.time()))
            self.random = random.Random(self.seed)
            self.vars["RAND_SEED"] = self.seed
            return before

        return srand

    def f_systime(self, args):
        return lambda: float(int(time.time()))

    def f_strftime(self, args):
        fmt = self.expression(args[0]) if args else lambda: "%Y-%m-%d %H:%M:%S"
        at = self.number(args[1]) if len(args) > 1 else lambda: float(int(time.time()))

        def strftime():
            try:
                return datetime.fromtimestamp(math.floor(at()), timezone.utc).strftime(to_text(fmt()))
            except (OverflowError, ValueError, OSError):
                return ""

        return strftime

    def _bits(self, args, fn):
        a, b = map(self.number, args)
        return lambda: float(fn(whole(a()), whole(b())))

    def f_and(self, args):
        return self._bits(args, lambda a, b: a & b)

    def f_or(self, args):
        return self._bits(args, lambda a, b: a | b)

    def f_xor(self, args):
        return self._bits(args, lambda a, b: a ^ b)

    def f_lshift(self, args):
        return self._bits(args, lambda a, n: signed(a << shift_by(n)))

    def f_rshift(self, args):
        return self._bits(args, lambda a, n: a >> shift_by(n))

    def f_system(self, args):
        f = self.expression(args[0])

        def system():
            if not self.shell:
                raise ProgramError("system isn't allowed here")
            done = subprocess.run(["sh", "-c", to_text(f())], stdout=subprocess.PIPE, check=False)
            self.write(done.stdout.decode(errors="replace"))
            return float(done.returncode if done.returncode >= 0 else 256 - done.returncode)

        return system

    def f_close(self, args):
        f = self.expression(args[0])
        return lambda: self.close(to_text(f()))

    def close(self, name: str) -> float:
        status = -1.0
        if (r := self.readers.pop(name, None)) is not None:
            status = float(getattr(r, "status", 0))
        if (o := self.outputs.pop(name, None)) is not None:
            status = float(o.close() or 0)
        return status

    def f_fflush(self, args):
        f = self.expression(args[0]) if args else None

        def fflush():
            if f is None:
                return 0.0
            o = self.outputs.get(to_text(f()))
            if o is None:
                return -1.0
            o.flush()
            return 0.0

        return fflush

    # -- statements

    def statement(self, s) -> Callable:
        if s is None:
            return lambda: None
        return getattr(self, "s_" + type(s).__name__)(s)

    def s_Block(self, s):
        parts = [self.statement(x) for x in s.body]
        if len(parts) == 1:
            return parts[0]

        def block():
            for p in parts:
                p()

        return block

    def s_Do(self, s):
        return self.expression(s.value)

    def s_If(self, s):
        test, yes, no = self.condition(s.test), self.statement(s.yes), self.statement(s.no)

        def branch():
            if test():
                yes()
            else:
                no()

        return branch

    def s_Loop(self, s):
        start, test, step = self.statement(s.start), self.condition(s.test) if s.test is not None else lambda: True, self.statement(s.step)
        body, first = self.statement(s.body), s.test_first

        def loop():
            start()
            go = test() if first else True
            while go:
                try:
                    body()
                except Break:
                    return
                except Continue:
                    pass
                step()
                go = test()

        return loop

    def s_ForIn(self, s):
        a, body = self.array_of(s.array), self.statement(s.body)
        place, _, put = self.target(Var(s.name))

        def loop():
            for k in list(a()):
                put(place(), k)
                try:
                    body()
                except Break:
                    return
                except Continue:
                    pass

        return loop

    def s_Jump(self, s):
        signal = JUMPS[s.kind]

        def jump():
            raise signal

        return jump

    def s_Leave(self, s):
        f = self.expression(s.value)
        if s.kind == "return":

            def back():
                raise Return(f())

            return back

        def leave():
            if s.value is not None:
                self.code = whole(to_number(f())) & 255
            raise Exit

        return leave

    def s_Delete(self, s):
        a = self.array_of(s.array)
        if s.keys is None:
            return lambda: a().clear()
        k = self.key(s.keys)
        return lambda: a().pop(k(), None)

    def s_Print(self, s):
        args = [self.expression(a) for a in s.args]
        to = self.expression(s.to) if s.mode else None

        def out():
            if s.formatted:
                values = [a() for a in args]
                text = sprintf(to_text(values[0]), values[1:], self.vars["CONVFMT"])
            elif args:
                ofmt = self.vars["OFMT"]
                text = to_text(self.vars["OFS"]).join([to_text(a(), ofmt) for a in args]) + to_text(self.vars["ORS"])
            else:
                text = self.record + to_text(self.vars["ORS"])
            if to is None:
                self.write(text)
            else:
                self.send(s.mode, to_text(to()), text)

        return out

    def send(self, mode: str, name: str, text: str) -> None:
        if mode != "|" and name in ("/dev/stdout", "/dev/stderr"):
            (self.write if name.endswith("out") else sys.stderr.write)(text)
            return
        if name not in self.outputs:
            if mode == "|":
                if not self.shell:
                    raise ProgramError("commands aren't allowed here")
                self.outputs[name] = Pipe(name, self.write)
            else:
                self.outputs[name] = open(name, "a" if mode == ">>" else "w", encoding="utf-8", newline="")  # noqa: SIM115
        self.outputs[name].write(text)

    # -- running

    def read_main(self) -> str | None:
        """The next record of the main input; what stands between files is done here."""
        while True:
            if self.reader is None and not self.open_next():
                return None
            got = self.reader.next(to_text(self.vars["RS"]), self.csv)
            if got is None:
                self.close_file()
                continue
            self.vars["NR"] = to_number(self.vars["NR"]) + 1
            self.vars["FNR"] = to_number(self.vars["FNR"]) + 1
            self.vars["RT"] = got[1]
            return got[0]

    def open_next(self) -> bool:
        for item in self.inputs:
            if isinstance(item, tuple) and item[0] == "=":
                self.assign(item[1], from_input(item[2]))
                continue
            name, content = item
            self.vars["FILENAME"], self.vars["FNR"] = name, 0.0
            self.reader = TextReader(content) if isinstance(content, str) else Listed(content)
            try:
                self.special("BEGINFILE")
            except NextFile:
                self.close_file()
                continue
            return True
        return False

    def close_file(self) -> None:
        self.reader = None
        self.special("ENDFILE")

    def special(self, kind: str) -> None:
        for _, k, _, _, action in self.rules:
            if k == kind:
                action()

    def run(self, inputs: Iterable) -> int:
        """inputs: (name, text or iterable of records), or ("=", variable, value)."""
        for _ in self.steps(inputs):
            pass
        return self.code

    def steps(self, inputs: Iterable):
        """A run that stops after each record."""
        self.inputs = iter(inputs)
        main = [r for r in self.rules if r[1] in ("always", "when", "range")]
        try:
            self.special("BEGIN")
            if main or any(r[1] in ("END", "BEGINFILE", "ENDFILE") for r in self.rules):
                yield from self.records(main)
        except Exit:
            pass
        try:
            self.special("END")
        except Exit:
            pass
        finally:
            for name in list(self.outputs):
                self.outputs.pop(name).close()

    def drain(self, main: list) -> None:
        for _ in self.records(main):
            pass

    def records(self, main: list):
        while (text := self.read_main()) is not None:
            self.take_record(text)
            try:
                self.one_record(main)
            except NextRecord:
                pass
            except NextFile:
                self.close_file()
            yield

    def one_record(self, main: list) -> None:
        for i, kind, pattern, until, action in main:
            if kind == "when":
                if not pattern():
                    continue
            elif kind == "range":
                if not self.inside[i]:
                    if not pattern():
                        continue
                    self.inside[i] = True
                if until():
                    self.inside[i] = False
            if action is None:
                self.write(self.record + to_text(self.vars["ORS"]))
            else:
                action()


class Lazy:
    """An unset name passed to a function, which may use it as an array."""

    def __init__(self, home: dict, name: str):
        self.home, self.name = home, name

    def array(self) -> dict:
        v = self.home.get(self.name)
        if isinstance(v, Lazy):
            v = v.array()
        if v is None:
            v = {}
        self.home[self.name] = v
        return v


class Pipe:
    def __init__(self, command: str, write: Callable[[str], None]):
        self.command, self.write_out, self.parts = command, write, []

    def write(self, text: str) -> None:
        self.parts.append(text)

    def flush(self) -> None:
        pass

    def close(self) -> int:
        done = subprocess.run(["sh", "-c", self.command], input="".join(self.parts).encode(), stdout=subprocess.PIPE, check=False)
        self.write_out(done.stdout.decode(errors="replace"))
        return done.returncode


def simple_case(text: str, change: Callable[[str], str]) -> str:
    """One character for one: what would become several stays."""
    if text.isascii():
        return change(text)
    return "".join([d if len(d := change(c)) == 1 else c for c in text])


def safe_exp(x: float) -> float:
    """Range errors give 1, as the language has it on this platform."""
    try:
        y = math.exp(x)
    except OverflowError:
        return 1.0
    return 1.0 if y == 0 and math.isfinite(x) else y


def signed(n: int) -> int:
    n &= (1 << 64) - 1
    return n - (1 << 64) if n >> 63 else n


def shift_by(n: int) -> int:
    if not 0 <= n < 64:
        raise ProgramError("shift out of range")
    return n
