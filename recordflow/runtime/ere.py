"""Extended regular expressions with leftmost-longest matches.

A pattern is parsed into a small tree, from which come

* ``java``: the same pattern in the syntax of Spark's engine, for tests of whether a text
  matches, where both kinds of matching agree;
* ``python``: the same for Python's engine, which finds where the first match starts;
* ``exact``: whether a leftmost-first engine also finds the longest match, so that
  positions may be taken from it. Where it doesn't, a set simulation of the pattern's
  automaton (Thompson) finds the longest end.
"""

from __future__ import annotations

import re
from functools import lru_cache

from recordflow.lang.nodes import ProgramError

# The named classes.
CLASSES = {
    "alpha": "A-Za-z", "digit": "0-9", "alnum": "A-Za-z0-9", "upper": "A-Z", "lower": "a-z", "space": " \\t-\\r", "blank": " \\t", "punct": "!-/:-@\\[-`{-~", "print": " -~", "graph": "!-~", "cntrl": "\\x00-\\x1f\\x7f", "xdigit": "0-9A-Fa-f",
}
MEMBERS = {k: frozenset(c for c in map(chr, range(128)) if re.fullmatch(f"[{v}]", c)) for k, v in CLASSES.items()}
SIMPLE = {"a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r"}
MOST = 255


class Set:
    """A set of characters: ranges, maybe negated."""

    def __init__(self, ranges: list[tuple[int, int]], negated: bool = False):
        self.ranges, self.negated = ranges, negated

    def holds(self, c: str) -> bool:
        n = ord(c)
        return any(a <= n <= b for a, b in self.ranges) != self.negated

    def text(self, java: bool) -> str:
        if not self.ranges:
            return r"[\s\S]" if self.negated else r"[^\s\S]"
        one = (lambda n: f"\\x{{{n:x}}}") if java else (lambda n: f"\\U{n:08x}")
        # Java keeps single characters below 256 in a bitmap, but tests ranges one by one
        several = lambda a, b: "".join(map(one, range(a, b + 1))) if java and b < 256 and b - a < 128 else f"{one(a)}-{one(b)}"
        return f"[{'^' * self.negated}{''.join(one(a) if a == b else several(a, b) for a, b in self.ranges)}]"


class EreParser:
    """Trees: ("set", Set), ("any",), ("begin",), ("end",), ("empty",), ("cat", [..]),
    ("or", [..]), ("rep", tree, least, most or None)."""

    def __init__(self, source: str):
        self.s, self.at = source, 0

    def fail(self, why: str):
        raise ProgramError(f"bad regular expression {self.s!r}: {why}")

    def parse(self):
        tree = self.either(0)
        while self.at < len(self.s):  # an unmatched closing parenthesis is a character
            self.at += 1
            tree = ("cat", [tree, ("set", Set([(41, 41)])), self.either(0)])
        return tree

    def either(self, depth: int):
        parts = [self.sequence(depth)]
        while self.at < len(self.s) and self.s[self.at] == "|":
            self.at += 1
            parts.append(self.sequence(depth))
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self, depth: int):
        parts = []
        while self.at < len(self.s) and self.s[self.at] != "|":
            if self.s[self.at] == ")":
                if depth:
                    break
                self.at += 1
                parts.append(self.repeated(("set", Set([(41, 41)]))))
                continue
            parts.append(self.repeated(self.atom(depth)))
            if parts[-1] == ("begin",) and len(parts) > 1 and parts[-2] == ("end",):
                self.fail("$^ side by side")
        return parts[0] if len(parts) == 1 else ("cat", parts) if parts else ("empty",)

    def repeated(self, tree):
        while self.at < len(self.s):
            c = self.s[self.at]
            if c in "*+?":
                self.at += 1
                tree = ("rep", tree, 1 if c == "+" else 0, 1 if c == "?" else None)
            elif c == "{" and (m := re.compile(r"\{(\d+)(,(\d*))?\}").match(self.s, self.at)):
                low, high = int(m[1]), int(m[1]) if m[2] is None else int(m[3]) if m[3] else None
                if low > MOST or (high or 0) > MOST or high is not None and high < low:
                    self.fail("repetition out of range")
                self.at = m.end()
                tree = ("rep", tree, low, high)
            else:
                break
        return tree

    def atom(self, depth: int):
        c = self.s[self.at]
        self.at += 1
        if c == "(":
            if self.at < len(self.s) and self.s[self.at] == ")":
                self.at += 1
                return ("empty",)
            tree = self.either(depth + 1)
            if self.at >= len(self.s):
                self.fail("a parenthesis isn't closed")
            self.at += 1
            return tree
        if c == ".":
            return ("any",)
        if c == "^":
            return ("begin",)
        if c == "$":
            return ("end",)
        if c == "[":
            return ("set", self.bracket())
        if c == "\\":
            return ("set", Set([(n := self.escape(), n)]))
        if c in "*+?" :
            return ("set", Set([(ord(c), ord(c))]))
        return ("set", Set([(ord(c), ord(c))]))

    def escape(self) -> int:
        if self.at >= len(self.s):
            return ord("\\")
        if m := re.compile(r"x([0-9A-Fa-f]{1,2})|u([0-9A-Fa-f]{1,8})|([0-7]{1,3})").match(self.s, self.at):
            self.at = m.end()
            return int(m[1] or m[2], 16) if m[1] or m[2] else int(m[3], 8) & 255
        c = self.s[self.at]
        self.at += 1
        return ord(SIMPLE.get(c, c))

    def bracket(self) -> Set:
        s, ranges, negated = self.s, [], False
        if s[self.at : self.at + 1] == "^":
            negated = True
            self.at += 1
        first = True
        while True:
            if self.at >= len(s):
                self.fail("a bracket isn't closed")
            c = s[self.at]
            if c == "]" and not first:
                self.at += 1
                return Set(ranges, negated)
            first = False
            if s.startswith("[:", self.at) and (end := s.find(":]", self.at)) > 0 and s[self.at + 2 : end] in MEMBERS:
                ranges.extend((ord(x), ord(x)) for x in sorted(MEMBERS[s[self.at + 2 : end]]))
                self.at = end + 2
                continue
            low = self.member()
            if s.startswith("-", self.at) and self.at + 1 < len(s) and s[self.at + 1] != "]":
                self.at += 1
                high = self.member()
                if low <= high:  # a descending range holds nothing
                    ranges.append((low, high))
            else:
                ranges.append((low, low))

    def member(self) -> int:
        c = self.s[self.at]
        self.at += 1
        return self.escape() if c == "\\" else ord(c)


def _text(tree, java: bool) -> str:
    kind = tree[0]
    if kind == "set":
        s = tree[1]
        if not s.negated and len(s.ranges) == 1 and s.ranges[0][0] == s.ranges[0][1]:
            c = chr(s.ranges[0][0])
            return c if c.isalnum() and c.isascii() or c in " _" else s.text(java)
        return s.text(java)
    if kind == "any":
        return r"[\s\S]"
    if kind == "begin":
        return r"\A"
    if kind == "end":
        return r"\z" if java else r"\Z"
    if kind == "empty":
        return "(?:)"
    if kind == "cat":
        return "".join(_text(t, java) if t[0] != "or" else f"(?:{_text(t, java)})" for t in tree[1])
    if kind == "or":
        return "|".join(_text(t, java) for t in tree[1])
    _, inner, low, high = tree
    mark = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((low, high)) or (f"{{{low}}}" if low == high else f"{{{low},{'' if high is None else high}}}")
    return f"(?:{_text(inner, java)}){mark}"


def _one_length(tree) -> int | None:
    """The length of all matches of a tree, if they have one length."""
    kind = tree[0]
    if kind in ("set", "any"):
        return 1
    if kind in ("begin", "end", "empty"):
        return 0
    if kind == "cat":
        sizes = [_one_length(t) for t in tree[1]]
        return None if None in sizes else sum(sizes)
    if kind == "or":
        sizes = {_one_length(t) for t in tree[1]}
        return sizes.pop() if len(sizes) == 1 else None
    size = _one_length(tree[1])
    return None if size is None or tree[2] != tree[3] else size * tree[2]


def _firsts(tree) -> Set | None:
    """What a match may start with, for plain trees; None if that isn't known."""
    if tree[0] == "set":
        return tree[1]
    if tree[0] == "cat" and tree[1] and not _nullable(tree[1][0]):
        return _firsts(tree[1][0])
    if tree[0] == "rep" and tree[2]:
        return _firsts(tree[1])
    return None


def _nullable(tree) -> bool:
    kind = tree[0]
    if kind in ("begin", "end", "empty"):
        return True
    if kind == "cat":
        return all(map(_nullable, tree[1]))
    if kind == "or":
        return any(map(_nullable, tree[1]))
    return kind == "rep" and (tree[2] == 0 or _nullable(tree[1]))


def _apart(a: Set | None, b: Set | None) -> bool:
    return a is not None and b is not None and not a.negated and not b.negated and all(x[1] < y[0] or y[1] < x[0] for x in a.ranges for y in b.ranges)


def _greedy(tree) -> bool:
    """Whether the first match of a backtracking engine is the longest."""
    kind = tree[0]
    if kind == "or":
        if _one_length(tree) is not None:
            return all(map(_greedy, tree[1]))
        heads = [_firsts(t) for t in tree[1]]
        return all(map(_greedy, tree[1])) and all(_apart(a, b) for i, a in enumerate(heads) for b in heads[i + 1 :])
    if kind == "cat":
        return all(t[0] in ("set", "any", "begin", "end", "empty") or t[0] == "rep" and _one_length(t[1]) == 1 or _greedy(t) and (_one_length(t) is not None or i == len(tree[1]) - 1) for i, t in enumerate(tree[1])) and _settled(tree[1])
    if kind == "rep":
        return _one_length(tree[1]) is not None and _one_length(tree[1]) > 0 and _greedy(tree[1])
    return True


def _settled(parts: list) -> bool:
    """Of a sequence with several parts of varying length, whether giving one all it can
    take never shortens the whole: true if each is followed by what it can't take."""
    loose = [i for i, t in enumerate(parts) if _one_length(t) is None]
    return all(i == loose[-1] or i + 1 < len(parts) and not _nullable(parts[i + 1]) and _apart(_firsts_of_rep(parts[i]), _firsts(parts[i + 1])) for i in loose)


def _firsts_of_rep(tree):
    return tree[1][1] if tree[0] == "rep" and tree[1][0] == "set" else None


class Ere:
    def __init__(self, source: str):
        self.source = source
        self.tree = EreParser(source).parse()
        self.java, self.exact, self.nullable = _text(self.tree, True), _greedy(self.tree), _nullable(self.tree)
        self.python = re.compile(_text(self.tree, False))
        parts = self.tree[1] if self.tree[0] == "cat" else [self.tree]
        plain = all(t[0] == "set" and not t[1].negated and len(t[1].ranges) == 1 and t[1].ranges[0][0] == t[1].ranges[0][1] for t in parts)
        #: The text that the pattern is, if it is plain text.
        self.literal = "".join(chr(t[1].ranges[0][0]) for t in parts) if plain else None
        self._nfa = None

    def matches(self, text: str) -> bool:
        return self.python.search(text) is not None

    def search(self, text: str, at: int = 0) -> tuple[int, int] | None:
        m = self.python.search(text, at)
        if m is None:
            return None
        return (m.start(), m.end()) if self.exact else (m.start(), self.longest(text, m.start()))

    def longest(self, text: str, start: int) -> int:
        if self._nfa is None:
            self._nfa = _automaton(self.tree)
        steps, first, last = self._nfa
        best, n = start, len(text)
        states = _reach(steps, {first}, start, n)
        at = start
        if last in states:
            best = at
        while at < n and states:
            c = text[at]
            states = {to for s in states for kind, what, to in steps[s] if kind == "eat" and (what is None or what.holds(c))}
            at += 1
            states = _reach(steps, states, at, n)
            if last in states:
                best = at
        return best


def _automaton(tree):
    steps: list[list] = []

    def state() -> int:
        steps.append([])
        return len(steps) - 1

    def build(t, a: int, b: int) -> None:
        kind = t[0]
        if kind in ("set", "any"):
            steps[a].append(("eat", t[1] if kind == "set" else None, b))
        elif kind in ("begin", "end", "empty"):
            steps[a].append((kind, None, b))
        elif kind == "cat":
            for part in t[1][:-1]:
                mid = state()
                build(part, a, mid)
                a = mid
            if t[1]:
                build(t[1][-1], a, b)
            else:
                steps[a].append(("empty", None, b))
        elif kind == "or":
            for part in t[1]:
                build(part, a, b)
        else:
            _, inner, low, high = t
            for _ in range(low):
                mid = state()
                build(inner, a, mid)
                a = mid
            if high is None:
                loop = state()
                steps[a].append(("empty", None, loop))
                back = state()
                build(inner, loop, back)
                steps[back].append(("empty", None, loop))
                steps[loop].append(("empty", None, b))
            else:
                for _ in range(high - low):
                    steps[a].append(("empty", None, b))
                    mid = state()
                    build(inner, a, mid)
                    a = mid
                steps[a].append(("empty", None, b))

    first, last = state(), state()
    build(tree, first, last)
    return steps, first, last


def _reach(steps, states: set, at: int, n: int) -> set:
    todo, seen = list(states), set(states)
    while todo:
        for kind, _, to in steps[todo.pop()]:
            if to not in seen and (kind == "empty" or kind == "begin" and at == 0 or kind == "end" and at == n):
                seen.add(to)
                todo.append(to)
    return seen


@lru_cache(maxsize=512)
def compile_ere(source: str) -> Ere:
    return Ere(source)


def substitute(ere: Ere, replacement: str, text: str, every: bool) -> tuple[str, int]:
    """Text with the first or all matches replaced, and how many. & stands for the match,
    a backslash before it makes it literal. An empty match right after another is none."""
    out, at, count, n = [], 0, 0, len(text)
    last = -1
    while at <= n:
        m = ere.search(text, at)
        if m is None:
            break
        a, b = m
        if a == b and a == last:
            if a >= n:
                break
            out.append(text[a])
            at = a + 1
            last = -1
            continue
        out.append(text[at:a])
        out.append(expand(replacement, text[a:b]))
        count += 1
        last = at = b
        if a == b:
            if a < n:
                out.append(text[a])
            at, last = a + 1, -1
        if not every:
            break
    out.append(text[at:])
    return "".join(out), count


def expand(replacement: str, matched: str) -> str:
    """Replacement text: & is the match, \\& an ampersand, a doubled backslash before an
    ampersand one backslash and the match."""
    if "&" not in replacement and "\\" not in replacement:
        return replacement
    return re.sub(r"\\\\&|\\&|&", lambda m: {"&": matched, "\\&": "&"}.get(m[0], "\\" + matched), replacement)


def split_text(text: str, separator: str, regex: bool = False) -> list[str]:
    """Fields of a text. One space: runs of blanks, tabs and newlines; nothing: each
    character; one character: itself; longer, or a regular expression: its matches, the
    empty ones apart."""
    if text == "":
        return []
    if separator == " " and not regex:
        return [x for x in re.split("[ \t\n]+", text) if x]
    if separator == "" and not regex:
        return list(text)
    if len(separator) == 1 and not regex:
        return text.split(separator)
    ere = compile_ere(separator)
    out, begin, at = [], 0, 0
    while (m := ere.search(text, at)) is not None:
        a, b = m
        if a == b:
            if a >= len(text):
                break
            at = a + 1
            continue
        out.append(text[begin:a])
        begin = at = b
    out.append(text[begin:])
    return out
