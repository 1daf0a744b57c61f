"""Dynamic values: None (unset), float, str, and StrNum (input text that looks numeric).

Text is str. In the byte profile each character stands for one byte.
"""

from __future__ import annotations

import math
import re
import sys

SPACE = " \t\n\v\f\r"
DECIMAL = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
SPECIAL = re.compile(r"[+-](?:inf|nan)", re.I)
TINY = sys.float_info.min


class StrNum(str):
    """Input text with a number view."""

    __slots__ = ("number",)


def parse_number(text: str) -> float | None:
    """The number that a whole text spells, or None. Neither hexadecimal nor unsigned
    inf and nan, nor what over- or underflows, is numeric."""
    t = text.strip(SPACE)
    if DECIMAL.fullmatch(t):
        x = float(t)
        if math.isinf(x) or x != 0 and abs(x) < TINY or x == 0 and re.search("[1-9]", re.split("[eE]", t)[0]):
            return None
        return x
    if SPECIAL.fullmatch(t):
        return float(t)
    return None


def from_input(text: str) -> str:
    """A StrNum if the text looks numeric, else the text."""
    if text and (x := parse_number(text)) is not None:
        s = StrNum(text)
        s.number = x
        return s
    return text


def prefix_number(text: str) -> float:
    """The number at the start of a text, or 0."""
    m = DECIMAL.match(text.lstrip(SPACE))
    return parse_number(m[0]) or 0.0 if m else 0.0


def to_number(v) -> float:
    if v is None:
        return 0.0
    if isinstance(v, float):
        return v
    if isinstance(v, StrNum):
        return v.number
    return prefix_number(v)


def number_text(x: float, fmt: str = "%.6g") -> str:
    if x != x:
        return "-nan" if math.copysign(1, x) < 0 else "+nan"
    if math.isinf(x):
        return "+inf" if x > 0 else "-inf"
    if x == int(x):
        return str(int(x)) if abs(x) < 1e16 else ("%.30g" % x)[:255]
    if fmt == "%.6g":
        return "%.6g" % x
    from recordflow.runtime.formats import sprintf

    return sprintf(fmt, [x])[:255]


def to_text(v, fmt: str = "%.6g") -> str:
    if v is None:
        return ""
    if isinstance(v, float):
        return number_text(v, fmt)
    return str(v) if isinstance(v, StrNum) else v


def truth(v) -> bool:
    if v is None:
        return False
    if isinstance(v, float):
        return v != 0
    if isinstance(v, StrNum):
        return v.number != 0
    return v != ""


def compare(op: str, a, b, fmt: str = "%.6g") -> bool:
    """Numbers if neither side is a plain string, else texts by bytes. <=, >= and != deny
    >, < and ==, which shows with NaN."""
    if type(a) is str or type(b) is str:
        x, y = to_text(a, fmt), to_text(b, fmt)
        if not (x.isascii() and y.isascii()):
            x, y = x.encode("utf-8", "surrogatepass"), y.encode("utf-8", "surrogatepass")
    else:
        x, y = to_number(a), to_number(b)
    if op == "<":
        return x < y
    if op == ">":
        return x > y
    if op == "==":
        return x == y
    if op == "<=":
        return not x > y
    if op == ">=":
        return not x < y
    return not x == y
