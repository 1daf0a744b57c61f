"""printf formats with C rules. Python's % rounds the exact binary value, as C does."""

from __future__ import annotations

import math
import re

from recordflow.lang.nodes import ProgramError
from recordflow.runtime.values import StrNum, to_number, to_text

SPEC = re.compile(r"%([-+ #0]*)(\*|\d+)?(?:\.(\*|\d+)?)?[hjLlqtz]*(.)?", re.S)
MOST = 1_000_000


def _integer(x: float, unsigned: bool) -> int:
    if math.isnan(x):
        return 0
    n = (1 if x > 0 else -1) * (1 << 70) if math.isinf(x) else int(x)
    if unsigned:
        n = max(-(1 << 63), min((1 << 64) - 1, n))
        return n & (1 << 64) - 1
    return max(-(1 << 63), min((1 << 63) - 1, n))


def _hexfloat(x: float, digits: int | None, upper: bool, flags: str) -> str:
    if x == 0:
        mantissa, exponent = 0, 0
    else:
        m, e = math.frexp(abs(x))
        mantissa, exponent = int(m * (1 << 53)), e - 1
    frac = mantissa & (1 << 52) - 1
    lead = 1 if mantissa else 0
    if digits is None:
        tail = f"{frac:013x}".rstrip("0")
    else:
        if digits < 13:
            drop = 52 - 4 * digits
            whole = (lead << 52) | frac
            half, rest = 1 << (drop - 1), whole & ((1 << drop) - 1)
            whole >>= drop
            if rest > half or rest == half and whole & 1:
                whole += 1
            lead, frac = whole >> (4 * digits), whole & ((1 << 4 * digits) - 1)
            tail = f"{frac:0{digits}x}" if digits else ""
        else:
            tail = f"{frac:013x}".ljust(digits, "0")
    out = f"0x{lead}{'.' if tail or '#' in flags else ''}{tail}p{exponent:+d}"
    return out.upper() if upper else out


def _padded(body: str, sign: str, width: int, flags: str, zero: bool, prefix: str = "") -> str:
    whole = sign + prefix + body
    if len(whole) >= width:
        return whole
    if "-" in flags:
        return whole.ljust(width)
    if zero:
        return sign + prefix + body.rjust(width - len(sign) - len(prefix), "0")
    return whole.rjust(width)


def one(flags: str, width: int, precision: int | None, kind: str, v, fmt: str) -> str:
    if kind in "di":
        n = _integer(to_number(v), False)
        body = str(abs(n))
        if precision is not None:
            body = "" if precision == 0 and n == 0 else body.rjust(precision, "0")
        sign = "-" if n < 0 else "+" if "+" in flags else " " if " " in flags else ""
        return _padded(body, sign, width, flags, "0" in flags and precision is None)
    if kind in "oxXu":
        n = _integer(to_number(v), True)
        body = {"o": "%o", "x": "%x", "X": "%X", "u": "%d"}[kind] % n
        if precision is not None:
            body = "" if precision == 0 and n == 0 else body.rjust(precision, "0")
        prefix = ""
        if "#" in flags:
            if kind == "o" and not body.startswith("0"):
                body = "0" + body
            elif kind in "xX" and n:
                prefix = "0" + kind
        return _padded(body, "", width, flags, "0" in flags and precision is None, prefix)
    if kind in "eEfFgGaA":
        x = to_number(v)
        sign = "-" if math.copysign(1, x) < 0 else "+" if "+" in flags else " " if " " in flags else ""
        if math.isnan(x) or math.isinf(x):
            body = "nan" if math.isnan(x) else "inf"
            return _padded(body.upper() if kind.isupper() else body, sign, width, flags, False)
        if kind in "aA":
            body = _hexfloat(x, precision, kind == "A", flags)
            return _padded(body[2:], sign, width, flags, "0" in flags, body[:2])
        body = f"%{'#' if '#' in flags else ''}.{6 if precision is None else precision}{kind}" % abs(x)
        return _padded(body, sign, width, flags, "0" in flags)
    if kind == "c":
        if isinstance(v, (float, StrNum)) or v is None:
            n = int(to_number(v)) if math.isfinite(to_number(v)) else 0
            text = chr(n & 0xFF if n < 0 else n) if n < 0x110000 else "�"
        else:
            text = v[:1] or "\0"
        return text.ljust(width) if "-" in flags else text.rjust(width)
    if kind == "s":
        text = to_text(v, fmt)
        if precision is not None:
            text = text[:precision]
        return text.ljust(width) if "-" in flags else text.rjust(width)
    raise ProgramError(f"bad conversion %{kind}")


def sprintf(fmt: str, args: list, convfmt: str = "%.6g") -> str:
    out, at, used = [], 0, 0

    def argument():
        nonlocal used
        if used >= len(args):
            raise ProgramError(f"not enough arguments for the format {fmt!r}")
        used += 1
        return args[used - 1]

    while (m := SPEC.search(fmt, at)) is not None:
        out.append(fmt[at : m.start()])
        at = m.end()
        flags, width, precision, kind = m.groups()
        dotted = "." in m[0][len(flags) + 1 + len(width or "") :][:1]
        if kind == "%" and not width and not dotted:
            out.append("%")
            continue
        if kind is None:
            out.append(m[0])
            continue
        if width == "*":
            n = int(to_number(argument()))
            if n < 0:
                flags, n = flags + "-", -n
        else:
            n = int(width or 0)
        p: int | None = None
        if dotted:
            p = int(to_number(argument())) if precision == "*" else int(precision or 0)
            if p < 0:
                p = None
        if n > MOST or (p or 0) > MOST:
            raise ProgramError("width or precision out of range")
        out.append("%" if kind == "%" else one(flags, n, p, kind, argument(), convfmt))
    out.append(fmt[at:])
    return "".join(out)
