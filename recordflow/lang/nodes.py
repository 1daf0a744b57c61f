"""Syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field


class ProgramError(Exception):
    """A program that can't be parsed or run; the message says why."""


@dataclass(frozen=True)
class Num:
    value: float


@dataclass(frozen=True)
class Str:
    value: str


@dataclass(frozen=True)
class Regex:
    source: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Field:
    index: object


@dataclass(frozen=True)
class Index:
    array: str
    keys: tuple


@dataclass(frozen=True)
class Assign:
    op: str  # "" for plain assignment, else the operator
    target: object
    value: object


@dataclass(frozen=True)
class Step:
    """++ and --."""

    delta: int
    prefix: bool
    target: object


@dataclass(frozen=True)
class Cond:
    test: object
    yes: object
    no: object


@dataclass(frozen=True)
class Binary:
    """+ - * / % ^, comparisons, && and ||, and "" for concatenation."""

    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Unary:
    op: str
    value: object


@dataclass(frozen=True)
class Match:
    negated: bool
    left: object
    right: object


@dataclass(frozen=True)
class In:
    keys: tuple
    array: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    builtin: bool


@dataclass(frozen=True)
class Getline:
    source: str  # main, file or command
    operand: object
    target: object


@dataclass(frozen=True)
class Group:
    value: object


# statements


@dataclass(frozen=True)
class Block:
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    yes: object
    no: object


@dataclass(frozen=True)
class Loop:
    """while, do-while and for: test before or after the body."""

    start: object
    test: object
    step: object
    body: object
    test_first: bool = True


@dataclass(frozen=True)
class ForIn:
    name: str
    array: str
    body: object


@dataclass(frozen=True)
class Print:
    args: tuple
    formatted: bool
    mode: str  # "", ">", ">>" or "|"
    to: object


@dataclass(frozen=True)
class Jump:
    kind: str  # next, nextfile, break, continue


@dataclass(frozen=True)
class Leave:
    kind: str  # exit, return
    value: object


@dataclass(frozen=True)
class Delete:
    array: str
    keys: tuple | None


@dataclass(frozen=True)
class Do:
    value: object


@dataclass(frozen=True)
class Rule:
    kind: str  # BEGIN, END, BEGINFILE, ENDFILE, always, when, range
    pattern: object
    until: object
    action: Block | None


@dataclass(frozen=True)
class Function:
    name: str
    params: tuple
    body: Block


@dataclass
class Tree:
    rules: list = field(default_factory=list)
    functions: dict = field(default_factory=dict)


def children(node):
    """The nodes right below a node."""
    for v in vars(node).values() if hasattr(node, "__dataclass_fields__") else ():
        if hasattr(v, "__dataclass_fields__"):
            yield v
        elif isinstance(v, tuple):
            yield from (x for x in v if hasattr(x, "__dataclass_fields__"))


def walk(node):
    if node is not None:
        yield node
        for x in children(node):
            yield from walk(x)
