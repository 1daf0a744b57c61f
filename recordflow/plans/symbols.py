"""Symbolic values: what an expression is in terms of one record and incoming state.

Kinds: N (number), S (text), F (text from input), U (unset), M (text or number, known
only per record).
"""

from __future__ import annotations

from dataclasses import dataclass

from recordflow.lang.nodes import ProgramError


class NotRelational(Exception):
    """The program has no relational form; the message says why."""


@dataclass(frozen=True)
class V:
    op: str
    args: tuple = ()
    kind: str = "N"


ZERO, ONE, EMPTY, UNSET = V("num", (0.0,)), V("num", (1.0,)), V("str", ("",), "S"), V("unset", (), "U")


def num(x: float) -> V:
    return V("num", (float(x),))


def text(s: str) -> V:
    return V("str", (s,), "S")


def is_const(v: V) -> bool:
    return v.op in ("num", "str", "unset", "strnum")


def const_value(v: V):
    """The value of a constant as the evaluator has it."""
    from recordflow.runtime.values import from_input

    return None if v.op == "unset" else from_input(v.args[0]) if v.op == "strnum" else v.args[0]


def of_value(x) -> V:
    from recordflow.runtime.values import StrNum

    if x is None:
        return UNSET
    if isinstance(x, float):
        return num(x)
    return V("strnum", (str(x),), "F") if isinstance(x, StrNum) else text(x)


def parts(v: V):
    for a in v.args:
        if isinstance(a, V):
            yield a
        elif isinstance(a, tuple):
            yield from (x for x in a if isinstance(x, V))


def inside(v: V):
    yield v
    for p in parts(v):
        yield from inside(p)


def states(v: V) -> set[V]:
    """Incoming state that a value depends on."""
    return {x for x in inside(v) if x.op in ("state", "cell", "held")}


def merge_kind(a: V, b: V) -> str:
    if a.kind == b.kind:
        return a.kind
    kinds = {a.kind, b.kind}
    if kinds == {"N", "U"}:
        return "N"
    if kinds == {"S", "U"} or kinds == {"F", "S"}:
        return "M" if kinds == {"F", "S"} else "M"
    return "M"


def cond(test: V, yes: V, no: V) -> V:
    if yes == no:
        return yes
    if test.op == "num":
        return yes if test.args[0] else no
    return V("cond", (test, yes, no), merge_kind(yes, no))


def both(a: V | None, b: V | None) -> V | None:
    """a and b, where None is always true."""
    if a is None or a == ONE:
        return b
    if b is None or b == ONE:
        return a
    if a == ZERO or b == ZERO:
        return ZERO
    return a if a == b else V("and", (a, b))


def truth(v: V) -> V:
    """The value as 0 or 1."""
    from recordflow.runtime.values import truth as held

    if v.op in ("cmp", "and", "or", "not", "match", "held", "inconst", "bool"):
        return v
    if is_const(v):
        return ONE if held(const_value(v)) else ZERO
    return V("bool", (v,))


def negated(v: V) -> V:
    v = truth(v)
    if v.op == "num":
        return num(1 - v.args[0])
    return v.args[0] if v.op == "not" and v.args[0].op != "bool" else V("not", (v,))


def substituted(v: V, what: dict[V, V]) -> V:
    if v in what:
        return what[v]
    if not any(True for _ in parts(v)):
        return v
    args = tuple(substituted(a, what) if isinstance(a, V) else tuple(substituted(x, what) if isinstance(x, V) else x for x in a) if isinstance(a, tuple) else a for a in v.args)
    return V(v.op, args, v.kind)


__all__ = ["ProgramError"]
