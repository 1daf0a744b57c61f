"""Work between files as folds by file.

What BEGINFILE resets, main rules fold and ENDFILE prints is a fold under one key, the
file: variables become elements of arrays under FILENAME, and ENDFILE a loop over them.
"""

from __future__ import annotations

from dataclasses import fields, is_dataclass, replace

from recordflow.lang.nodes import Assign, Block, Call, Delete, Do, ForIn, Getline, In, Index, Num, Rule, Step, Str, Tree, Var, walk
from recordflow.plans.symbols import NotRelational

KEY, COUNT = "of file", "of file FNR"


def by_file(tree: Tree) -> Tree:
    """A program without rules between files that prints the same lines."""
    kinds = {k: [r for r in tree.rules if r.kind == k] for k in ("BEGINFILE", "ENDFILE", "END", "BEGIN")}
    main = [r for r in tree.rules if r.kind in ("always", "when")]
    if kinds["END"] or len(main) + sum(map(len, kinds.values())) < len(tree.rules):
        raise NotRelational("work between files and at the end")
    reset = set()
    for r in kinds["BEGINFILE"]:
        for s in r.action.body:
            if not (isinstance(s, Do) and isinstance(s.value, Assign) and not s.value.op and isinstance(s.value.target, Var) and s.value.value in (Num(0.0), Str(""))):
                raise NotRelational("work before files is more than setting variables to 0")
            reset.add(s.value.target.name)
    parts = [p for r in main for p in (r.pattern, r.action)]
    for n in (n for p in parts for n in walk(p)):
        if isinstance(n, (Index, In, ForIn, Delete, Getline)) or isinstance(n, Call) and (not n.builtin or n.name in ("split", "match")):
            raise NotRelational("rules between files, and arrays or functions")
        if isinstance(n, (Assign, Step)) and isinstance(n.target, Var) and n.target.name not in reset:
            raise NotRelational(f"{n.target.name} outlives a file")
    for r in kinds["ENDFILE"]:
        for n in walk(r.action):
            if isinstance(n, (Assign, Step, Index, In, ForIn, Delete, Getline, Call)) or n == Var("NR"):
                raise NotRelational("work after files is more than printing")
    here, there = Var("FILENAME"), Var(KEY)
    names = {x: Index(f"of file {x}", (here,)) for x in reset}
    count = Rule("always", None, None, Block((Do(Step(1, False, Index(COUNT, (here,)))),)))
    later = {x: Index(f"of file {x}", (there,)) for x in reset} | {"FNR": Index(COUNT, (there,)), "FILENAME": there}
    loop = ForIn(KEY, COUNT, Block(tuple(renamed(s, later) for r in kinds["ENDFILE"] for s in r.action.body)))
    end = [Rule("END", None, None, Block((loop,)))] if kinds["ENDFILE"] else []
    return Tree([*kinds["BEGIN"], count, *[replace(r, pattern=renamed(r.pattern, names), action=renamed(r.action, names)) for r in main], *end], tree.functions)


def renamed(node, names: dict):
    """A tree with other nodes for some variables."""
    if isinstance(node, Var):
        return names.get(node.name, node)
    if isinstance(node, tuple):
        return tuple(renamed(x, names) for x in node)
    if not is_dataclass(node):
        return node
    return replace(node, **{f.name: renamed(getattr(node, f.name), names) for f in fields(node)})
