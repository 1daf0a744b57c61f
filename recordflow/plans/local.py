"""Which programs treat each record by itself, whatever statements they use.

A program does if every name that its rules change is set before it is read, on every way
through the rules: then nothing is carried from one record to the next, and records can be
evaluated wherever they lie, in any order.
"""

from __future__ import annotations

from recordflow.lang.nodes import Assign, Binary, Call, Cond, Delete, Field, ForIn, Function, Getline, Group, If, In, Index, Jump, Leave, Loop, Print, Step, Tree, Var, children, walk


class Carried(Exception):
    """Something outlives a record, or leaves it; the message says what."""


# Functions whose result or effect isn't a record's own.
OUTSIDE = {"rand", "srand", "system", "close", "fflush"}
PLACES = {"NR", "FNR", "RT"}


def carried(tree: Tree) -> str | None:
    """What keeps a program from treating each record by itself; None if nothing does."""
    try:
        Flow(tree).rules()
    except Carried as what:
        return str(what)
    return None


class Flow:
    def __init__(self, tree: Tree):
        self.tree = tree
        self.main = [r for r in tree.rules if r.kind != "BEGIN"]
        parts = [p for r in self.main for p in (r.pattern, r.until, r.action)] + [f.body for f in tree.functions.values()]
        self.changed: set[str] = set()
        self.arrays: set[str] = {n.array for r in tree.rules for p in (r.pattern, r.until, r.action) for n in walk(p) if isinstance(n, (Index, In, ForIn, Delete))}
        for n in (n for p in parts for n in walk(p)):
            if isinstance(n, (Assign, Step)):
                self.change(n.target)
            elif isinstance(n, ForIn):
                self.changed.add(n.name)
            elif isinstance(n, Delete):
                self.changed.add("[" + n.array)
            elif isinstance(n, Index):
                self.changed.add("[" + n.array)  # a read may make an element
            elif isinstance(n, Call) and n.name == "split" and n.builtin:
                self.changed.add("[" + n.args[1].name)
                self.arrays.add(n.args[1].name)
            elif isinstance(n, Call) and n.name in ("sub", "gsub") and len(n.args) > 2:
                self.change(n.args[2])
            elif isinstance(n, Call) and n.name == "match":
                self.changed |= {"RSTART", "RLENGTH"}
        self.open: list[str] = []  # functions being gone through
        self.passed()

    def passed(self) -> None:
        """Names that are handed to functions as arrays are arrays that may change."""
        by_ref: dict[str, set[int]] = {name: set() for name in self.tree.functions}
        grew = True
        while grew:
            grew = False
            for name, f in self.tree.functions.items():
                used = {n.array for n in walk(f.body) if isinstance(n, (Index, In, ForIn, Delete))}
                for n in walk(f.body):
                    if isinstance(n, Call) and n.builtin and n.name == "split":
                        used.add(n.args[1].name)
                    elif isinstance(n, Call) and not n.builtin:
                        used |= {a.name for i, a in enumerate(n.args) if i in by_ref[n.name] and isinstance(a, Var)}
                now = {i for i, p in enumerate(f.params) if p in used}
                grew, by_ref[name] = grew or now != by_ref[name], now
        for r in self.main:
            for part in (r.pattern, r.until, r.action):
                for n in walk(part):
                    if isinstance(n, Call) and not n.builtin:
                        names = {a.name for i, a in enumerate(n.args) if i in by_ref[n.name] and isinstance(a, Var)}
                        self.arrays |= names
                        self.changed |= {"[" + a for a in names}

    def change(self, target) -> None:
        if isinstance(target, Var):
            self.changed.add(target.name)
        elif isinstance(target, Index):
            self.changed.add("[" + target.array)

    def rules(self) -> None:
        set_: frozenset = frozenset()
        for r in self.main:
            if r.kind not in ("always", "when"):
                raise Carried(f"a rule of kind {r.kind}")
            set_ = self.go(r.pattern, set_)
            after = self.go(r.action, set_)
            set_ = after if r.kind == "always" else set_

    def need(self, name: str, set_: frozenset) -> None:
        if name in PLACES:
            raise Carried(f"{name} depends on other records")
        if name in self.changed and name not in set_:
            raise Carried(f"{name.removeprefix('[')} may be read before it is set")

    def store(self, target, set_: frozenset) -> frozenset:
        while isinstance(target, Group):
            target = target.value
        if isinstance(target, Var):
            if target.name in PLACES | {"FS", "RS", "OFS", "ORS", "OFMT", "CONVFMT", "SUBSEP", "FILENAME"}:
                raise Carried(f"{target.name} is assigned to")
            return set_ | {target.name}
        if isinstance(target, Index):
            self.need("[" + target.array, set_)
        return set_

    def go(self, node, set_: frozenset) -> frozenset:
        """The names that are set after a node, of those set before."""
        if node is None:
            return set_
        way = getattr(self, "on_" + type(node).__name__, None)
        if way is not None:
            return way(node, set_)
        for x in children(node):
            set_ = self.go(x, set_)
        return set_

    def on_Var(self, n: Var, set_):
        self.need("[" + n.name if n.name in self.arrays else n.name, set_)
        return set_

    def on_Index(self, n: Index, set_):
        for k in n.keys:
            set_ = self.go(k, set_)
        self.need("[" + n.array, set_)
        return set_

    def on_In(self, n: In, set_):
        for k in n.keys:
            set_ = self.go(k, set_)
        self.need("[" + n.array, set_)
        return set_

    def on_Assign(self, n: Assign, set_):
        if n.op or isinstance(n.target, Field):
            set_ = self.go(n.target, set_)
        elif isinstance(n.target, Index):
            for k in n.target.keys:
                set_ = self.go(k, set_)
        return self.store(n.target, self.go(n.value, set_))

    def on_Step(self, n: Step, set_):
        return self.store(n.target, self.go(n.target, set_))

    def either(self, a, b, set_):
        return self.go(a, set_) & self.go(b, set_)

    def on_Cond(self, n: Cond, set_):
        return self.either(n.yes, n.no, self.go(n.test, set_))

    def on_If(self, n: If, set_):
        return self.either(n.yes, n.no, self.go(n.test, set_))

    def on_Binary(self, n: Binary, set_):
        set_ = self.go(n.left, set_)
        after = self.go(n.right, set_)
        return set_ if n.op in ("&&", "||") else after

    def on_Loop(self, n: Loop, set_):
        set_ = self.go(n.start, set_)
        first = self.go(n.test, set_) if n.test_first else set_
        inner = self.go(n.body, first)
        if not n.test_first:
            self.go(n.test, first if any(isinstance(x, Jump) for x in walk(n.body)) else inner)
        self.go(n.step, first)
        return first

    def on_ForIn(self, n: ForIn, set_):
        self.need("[" + n.array, set_)
        self.go(n.body, set_ | {n.name})
        return set_

    def on_Print(self, n: Print, set_):
        if n.mode:
            raise Carried("output goes to several places")
        for a in n.args:
            set_ = self.go(a, set_)
        return set_

    def on_Jump(self, n: Jump, set_):
        if n.kind == "nextfile":
            raise Carried("nextfile")
        return set_

    def on_Leave(self, n: Leave, set_):
        if n.kind == "exit":
            raise Carried("exit")
        return self.go(n.value, set_)

    def on_Getline(self, n: Getline, set_):
        raise Carried("getline")

    def on_Delete(self, n: Delete, set_):
        if n.keys is None:
            return set_ | {"[" + n.array}
        for k in n.keys:
            set_ = self.go(k, set_)
        self.need("[" + n.array, set_)
        return set_

    def on_Call(self, n: Call, set_):
        if n.builtin and n.name in OUTSIDE:
            raise Carried(f"{n.name} is called")
        if n.builtin and n.name == "split":
            for a in (n.args[0], *n.args[2:]):
                set_ = self.go(a, set_)
            return set_ | {"[" + n.args[1].name}
        for a in n.args:
            set_ = self.go(a, set_)
        if n.builtin and n.name in ("sub", "gsub") and len(n.args) > 2:
            return self.store(n.args[2], set_)
        if n.builtin and n.name == "match":
            return set_ | {"RSTART", "RLENGTH"}
        if not n.builtin and n.name not in self.open:
            self.inside(self.tree.functions[n.name], set_)
        return set_

    def inside(self, f: Function, set_) -> None:
        """A function's own names are set when it is called; what else it reads must be."""
        self.open.append(f.name)
        own = set(f.params) | {"[" + p for p in f.params}
        self.go(f.body, set_ | own)
        self.open.pop()


__all__ = ["carried"]
