"""Tokens. Whether a slash starts a regular expression depends on what stands before."""

from __future__ import annotations

import re
from dataclasses import dataclass

from recordflow.lang.nodes import ProgramError

KEYWORDS = {"BEGIN", "END", "BEGINFILE", "ENDFILE", "function", "if", "else", "while", "do", "for", "in", "delete", "print", "printf", "break", "continue", "next", "nextfile", "return", "exit", "getline"}
#: Least and most arguments of the functions of the language.
BUILTINS = {
    "length": (0, 1), "tolower": (1, 1), "toupper": (1, 1), "substr": (2, 3), "index": (2, 2), "split": (2, 3), "match": (2, 2), "sub": (2, 3), "gsub": (2, 3), "sprintf": (1, 999),
    "sin": (1, 1), "cos": (1, 1), "atan2": (1, 2), "exp": (1, 1), "log": (1, 1), "sqrt": (1, 1), "int": (1, 1), "rand": (0, 0), "srand": (0, 1), "systime": (0, 0), "strftime": (0, 3),
    "and": (2, 2), "or": (2, 2), "xor": (2, 2), "lshift": (2, 2), "rshift": (2, 2), "system": (1, 1), "close": (1, 1), "fflush": (0, 1),
}
SYMBOLS = ["**=", "&&", "||", "==", "!=", "<=", ">=", "!~", "++", "--", "+=", "-=", "*=", "/=", "%=", "^=", "**", ">>", *"{}()[];,<>~?:=+-*/%^!$|"]
SKIP = re.compile(r"(?:[ \t\r]|\\\r?\n|#[^\n]*)+")
NUMBER = re.compile(r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
NAME = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")
STRING = re.compile(r'"((?:\\.|[^"\\])*)"', re.S)
REGEX = re.compile(r"/((?:\\.|[^/\\\n])*)/", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "/": "/", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
ESCAPE = re.compile(r"\\(?:([0-7]{1,3})|x([0-9A-Fa-f]{1,2})|u([0-9A-Fa-f]{1,8})|(\r?\n)|(.))", re.S)


@dataclass
class Token:
    kind: str  # number, string, regex, name, call, builtin, keyword, symbol, newline, end
    text: str
    line: int
    at: int


def unescape(text: str) -> str:
    """A string literal's value. An unknown escape keeps its backslash; so does one
    before an ampersand, which replacement texts tell apart."""

    def one(m: re.Match) -> str:
        octal, hexa, uni, newline, other = m.groups()
        if octal:
            return chr(int(octal, 8) & 255)
        if hexa or uni:
            return chr(int(hexa or uni, 16))
        if newline:
            return ""
        return ESCAPES.get(other, "\\" + other)

    return ESCAPE.sub(one, text)


def tokens(source: str) -> list[Token]:
    out: list[Token] = []
    at, line, n = 0, 1, len(source)

    def operand_ended() -> bool:
        if not out:
            return False
        t = out[-1]
        return t.kind in ("number", "string", "regex", "name") or t.kind == "builtin" and t.text == "length" or t.kind == "symbol" and t.text in (")", "]", "$", "++", "--")

    while True:
        if m := SKIP.match(source, at):
            line += m[0].count("\n")
            at = m.end()
        if at >= n:
            out.append(Token("newline", "\n", line, at))
            out.append(Token("end", "", line, at))
            return out
        c = source[at]
        if c == "\n":
            out.append(Token("newline", c, line, at))
            line += 1
            at += 1
        elif m := NUMBER.match(source, at):
            out.append(Token("number", m[0], line, at))
            at = m.end()
        elif m := NAME.match(source, at):
            word, at = m[0], m.end()
            kind = "keyword" if word in KEYWORDS else "builtin" if word in BUILTINS else "call" if source[at : at + 1] == "(" else "name"
            out.append(Token(kind, word, line, m.start()))
        elif c == '"':
            m = STRING.match(source, at)
            if not m:
                raise ProgramError(f"line {line}: a string isn't closed")
            out.append(Token("string", unescape(m[1]), line, at))
            line += m[0].count("\n")
            at = m.end()
        elif c == "/" and not operand_ended():
            m = REGEX.match(source, at)
            if not m:
                raise ProgramError(f"line {line}: a regular expression isn't closed")
            out.append(Token("regex", m[1].replace("\\/", "/"), line, at))
            at = m.end()
        else:
            s = next((s for s in SYMBOLS if source.startswith(s, at)), None)
            if s is None:
                raise ProgramError(f"line {line}: unexpected {c!r}")
            out.append(Token("symbol", s, line, at))
            at += len(s)
