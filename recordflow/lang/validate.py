"""What is checked before a program runs."""

from __future__ import annotations

from recordflow.lang.lexer import BUILTINS
from recordflow.lang.nodes import Block, Call, Delete, ForIn, Function, Getline, If, In, Index, Jump, Leave, Loop, Match, Print, ProgramError, Regex, Tree, Var, walk
from recordflow.runtime.ere import compile_ere


def check(tree: Tree, safe: bool) -> None:
    for f in tree.functions.values():
        if f.name in BUILTINS:
            raise ProgramError(f"function {f.name} has the name of a built-in function")
        if len(set(f.params)) < len(f.params):
            raise ProgramError(f"function {f.name}: a parameter is named twice")
        if set(f.params) & (set(tree.functions) | {f.name}):
            raise ProgramError(f"function {f.name}: a parameter has a function's name")
        _jumps(f.body, "function", False)
    for r in tree.rules:
        if r.action:
            _jumps(r.action, r.kind, False)
    arrays, scalars = set(), set()
    for node, local in _nodes(tree):
        if isinstance(node, Call):
            if node.builtin:
                least, most = BUILTINS[node.name]
                if not least <= len(node.args) <= most and node.name not in ("length",):
                    raise ProgramError(f"{node.name} takes {least} to {most} arguments, not {len(node.args)}")
                if safe and node.name == "system":
                    raise ProgramError("system isn't allowed in safe mode")
                if node.name == "index" and isinstance(node.args[1], Regex):
                    raise ProgramError("index doesn't take a regular expression")
            elif node.name not in tree.functions:
                raise ProgramError(f"unknown function '{node.name}'")
            elif len(node.args) > 50:
                raise ProgramError(f"function {node.name} has more than 50 arguments")
        elif isinstance(node, Regex):
            compile_ere(node.source)
        elif isinstance(node, Match) and isinstance(node.right, Regex):
            compile_ere(node.right.source)
        elif safe and (isinstance(node, Print) and node.mode or isinstance(node, Getline) and node.source == "command"):
            raise ProgramError("redirection and pipes aren't allowed in safe mode")
        if isinstance(node, (Index, In, ForIn)) or isinstance(node, Delete):
            if node.array not in local:
                arrays.add(node.array)
        elif isinstance(node, Var) and node.name not in local:
            scalars.add(node.name)
            if node.name in tree.functions:
                raise ProgramError(f"cannot read function {node.name} as a value")
    names = arrays & set(tree.functions)
    if names:
        raise ProgramError(f"function {min(names)} used as an array")


def _nodes(tree: Tree):
    for r in tree.rules:
        for part in (r.pattern, r.until, r.action):
            for n in walk(part):
                yield n, frozenset()
    for f in tree.functions.values():
        for n in walk(f.body):
            yield n, frozenset(f.params)


def _jumps(node, where: str, in_loop: bool) -> None:
    """Statements that must stand where they are allowed."""
    if isinstance(node, Jump):
        if node.kind in ("break", "continue") and not in_loop:
            raise ProgramError(f"{node.kind} outside a loop")
        if node.kind == "next" and where not in ("always", "when", "range"):
            raise ProgramError("next is for rules on records only")
        if node.kind == "nextfile" and where in ("BEGIN", "END"):
            raise ProgramError("nextfile is for rules on records only")
    elif isinstance(node, Leave) and node.kind == "return" and where != "function":
        raise ProgramError("return outside a function")
    elif isinstance(node, Block):
        for x in node.body:
            _jumps(x, where, in_loop)
    elif isinstance(node, If):
        for x in (node.yes, node.no):
            if x is not None:
                _jumps(x, where, in_loop)
    elif isinstance(node, (Loop, ForIn)):
        _jumps(node.body, where, True)


def array_parameters(tree: Tree) -> dict[str, set[int]]:
    """Which parameters of each function are arrays, also by being passed on."""
    known: dict[str, set[int]] = {}
    for f in tree.functions.values():
        used = {n.array for n in walk(f.body) if isinstance(n, (Index, In, ForIn, Delete))}
        used |= {n.args[1].name for n in walk(f.body) if isinstance(n, Call) and n.name == "split" and isinstance(n.args[1], Var)}
        known[f.name] = {i for i, p in enumerate(f.params) if p in used}
    changed = True
    while changed:
        changed = False
        for f in tree.functions.values():
            for c in walk(f.body):
                if isinstance(c, Call) and not c.builtin:
                    for i, a in enumerate(c.args):
                        if i in known.get(c.name, ()) and isinstance(a, Var) and a.name in f.params and (k := f.params.index(a.name)) not in known[f.name]:
                            known[f.name].add(k)
                            changed = True
    return known


__all__ = ["Function", "array_parameters", "check"]
