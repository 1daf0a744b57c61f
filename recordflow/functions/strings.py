"""Text functions of the language. Patterns are texts in its own syntax. A pattern whose
leftmost-longest match Spark's engine also finds runs there; others go through Arrow."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.functions.numbers import fixed, general, number_of_input, let, number_of_text, scientific, text_of_number, to_long
from recordflow.runtime.ere import compile_ere

# Letters whose upper case is not one letter; whose lower case is not, or
# depends on others.
UNEVEN_UPPER, UNEVEN_LOWER = "[ßŉǰΐΰևẖ-ẚὐ-ὖᾀ-᾿ῂ-ῼﬀ-ﬗ]", "İΣ"


def _literal(s: str) -> str:
    return "".join(c if c.isalnum() and c.isascii() else f"\\x{{{ord(c):x}}}" for c in s)


def matches(s: Column, pattern: str) -> Column:
    ere = compile_ere(pattern)
    if ere.literal:
        return F.contains(s, F.lit(ere.literal))
    return s.rlike(ere.java)


def substr(s: Column, m: Column, n: Column | None = None) -> Column:
    """Characters from m on (at least the first), n of them: the start is moved to 1
    without shortening what is taken."""
    start = F.greatest(to_long(m), F.lit(1).cast("bigint"))
    start = F.least(start, F.lit(2147483647).cast("bigint")).cast("int")
    if n is None:
        return F.substring(s, start, F.lit(2147483647))
    size = F.least(F.greatest(to_long(n), F.lit(0).cast("bigint")), F.lit(2147483647).cast("bigint")).cast("int")
    return F.substring(s, start, size)


def index(s: Column, t: Column) -> Column:
    return F.when(t == "", F.when(s != "", 1).otherwise(0)).otherwise(F.call_function("instr", s, t)).cast("double")


def tolower(s: Column) -> Column:
    return _cased(s, F.lower, F.contains(s, F.lit(UNEVEN_LOWER[0])) | F.contains(s, F.lit(UNEVEN_LOWER[1])))


def toupper(s: Column) -> Column:
    return _cased(s, F.upper, (F.octet_length(s) != F.length(s)) & s.rlike(UNEVEN_UPPER))


def _cased(s: Column, change, uneven: Column) -> Column:
    """One character for one: what would become several stays. Texts without uneven letters
    are changed at once, others letter by letter."""
    one = lambda c: F.when(F.length(change(c)) == 1, change(c)).otherwise(c)
    return F.when(uneven, F.array_join(F.transform(F.split(s, ""), one), "")).otherwise(change(s))


def _native(pattern: str) -> bool:
    ere = compile_ere(pattern)
    return ere.exact and not ere.nullable


def java_replacement(text: str) -> str:
    """A replacement text in Spark's syntax: & becomes the match."""
    out, i = [], 0
    while i < len(text):
        if text.startswith("\\\\&", i):
            out.append("\\\\$0")
            i += 3
        elif text.startswith("\\&", i):
            out.append("&")
            i += 2
        else:
            out.append({"&": "$0", "$": "\\$", "\\": "\\\\"}.get(text[i], text[i]))
            i += 1
    return "".join(out)


def substitute(s: Column, pattern: str, replacement: str, every: bool) -> tuple[Column, Column]:
    """The text after sub or gsub, and how many matches were replaced (a double)."""
    if _native(pattern):
        java = compile_ere(pattern).java
        new = java_replacement(replacement)
        if every:
            return F.regexp_replace(s, java, new), F.regexp_count(s, F.lit(java)).cast("double")
        found = s.rlike(java)
        return F.regexp_replace(s, rf"(?s)\A(.*?)({java})", "$1" + new.replace("$0", "$2")), F.when(found, 1.0).otherwise(0.0)

    @F.arrow_udf(T.StructType([T.StructField("t", T.StringType()), T.StructField("n", T.DoubleType())]))
    def run(texts: pa.Array) -> pa.Array:
        from recordflow.runtime.ere import compile_ere as compiled
        from recordflow.runtime.ere import substitute as replaced

        e = compiled(pattern)
        got = [(None, 0) if t is None else replaced(e, replacement, t, every) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([float(g[1]) for g in got], pa.float64())], ["t", "n"])

    out = run(s)
    return out["t"], out["n"]


def match(s: Column, pattern: str) -> tuple[Column, Column]:
    """Start and length of the first longest match: 0 and -1 without one."""
    ere = compile_ere(pattern)
    if ere.exact and not ere.nullable:
        hit = s.rlike(ere.java)
        # characters, not UTF-16 units as regexp_instr counts them
        before = F.length(F.regexp_extract(s, rf"(?s)\A(.*?)(?:{ere.java})", 1))
        return F.when(hit, (before + 1).cast("double")).otherwise(0.0), F.when(hit, F.length(F.regexp_substr(s, F.lit(ere.java))).cast("double")).otherwise(-1.0)

    @F.arrow_udf(T.StructType([T.StructField("a", T.DoubleType()), T.StructField("n", T.DoubleType())]))
    def run(texts: pa.Array) -> pa.Array:
        from recordflow.runtime.ere import compile_ere as compiled

        e = compiled(pattern)
        got = [e.search(t or "") for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([float(g[0] + 1) if g else 0.0 for g in got]), pa.array([float(g[1] - g[0]) if g else -1.0 for g in got])], ["a", "n"])

    out = run(s)
    return out["a"], out["n"]


def split_fields(s: Column, fs: str, regex: bool = False) -> Column:
    """Array of the fields of a text; empty for an empty text."""
    none = F.array().cast("array<string>")
    if fs == " " and not regex:
        return F.array_remove(F.split(s, "[ \t\n]+", -1), "")
    if fs == "" and not regex:
        return F.when(s == "", none).otherwise(F.split(s, ""))
    if len(fs) == 1 and not regex:
        return F.when(s == "", none).otherwise(F.split(s, _literal(fs), -1))
    if _native(fs):
        return F.when(s == "", none).otherwise(F.split(s, compile_ere(fs).java, -1))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(texts: pa.Array) -> pa.Array:
        from recordflow.runtime.ere import split_text

        return pa.array([None if t is None else split_text(t, fs, True) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(s)


def csv_split(s: Column) -> Column:
    """Fields of a CSV record."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(texts: pa.Array) -> pa.Array:
        from recordflow.runtime.records import csv_fields

        return pa.array([None if t is None else csv_fields(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    quoted = F.contains(s, F.lit('"'))
    return F.when(quoted, run(F.when(quoted, s))).otherwise(split_fields(s, ","))


def sprintf(fmt: str, args: list[tuple[Column, str, Column | None]], convfmt: str = "%.6g") -> Column:
    """Formatted text. args: columns with their kinds (N, S, F), and of numbers that have a
    text of their own that text. Conversions with fixed widths run natively; a format with
    others goes through Python as a whole, in Arrow batches."""
    parts, used = [], 0
    for literal, spec in _pieces(fmt):
        if literal:
            parts.append(F.lit(literal))
        if spec is None:
            continue
        made = _conversion(spec, *args[used], convfmt) if used < len(args) else None
        if made is None:
            return _formatted(fmt, args, convfmt)
        parts.append(made)
        used += 1
    return F.concat(*parts) if parts else F.lit("")


def _pieces(fmt: str):
    """Runs of literal text, each with the conversion that follows it."""
    from recordflow.runtime.formats import SPEC

    at = 0
    for m in SPEC.finditer(fmt):
        literal = fmt[at : m.start()]
        at = m.end()
        if m[0] == "%%":
            yield literal + "%", None
        elif m[4] is None:
            yield literal + m[0], None
        else:
            yield literal, m
    yield fmt[at:], None


def _conversion(m, c: Column, kind: str, own: Column | None, convfmt: str) -> Column | None:
    """One conversion as a Column; None if it has no native form here."""
    flags, width, precision, how = m.groups()
    if "*" in (width, precision) or "#" in flags or int(width or 0) > 1000:
        return None
    dotted = "." in m[0][1 + len(flags) + len(width or "") :][:1]
    n, p = int(width or 0), (int(precision or 0) if dotted else None)
    left, zero = "-" in flags, "0" in flags
    if how == "s":
        text = own if own is not None else text_of_number(c, convfmt) if kind == "N" else c
        text = F.coalesce(text, F.lit(""))
        return _widened(text if p is None else F.left(text, F.lit(p)), n, left)
    x = F.coalesce(c if kind == "N" else number_of_input(c) if kind == "F" else number_of_text(c) + F.lit(0.0), F.lit(0.0))
    native = _numeric(how, flags, n, p)
    return None if native is None else let(x, native)


def _numeric(how: str, flags: str, n: int, p: int | None):
    """A function from a number to its text under a conversion; None without one."""
    left, zero = "-" in flags, "0" in flags

    def signed(x: Column) -> Column:
        whole = to_long(x)
        digits, sign = F.regexp_replace(whole.cast("string"), "^-", ""), F.when(whole < 0, "-").otherwise("+" if "+" in flags else " " if " " in flags else "")
        return _signed(sign, digits, n, left, zero)

    def unsigned(x: Column) -> Column:
        whole = F.when(F.isnan(x), F.lit(0).cast("bigint")).when(x >= 2.0**64, F.lit(-1).cast("bigint")).when(x >= 2.0**63, to_long(x - 2.0**64)).otherwise(to_long(x))  # as 64 bits
        if how == "u":
            digits = F.when(whole < 0, (whole.cast("decimal(20,0)") + F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string")).otherwise(whole.cast("string"))
        elif how == "o":
            digits = F.when(whole == F.lit(-(1 << 63)), "1" + "0" * 21).otherwise(F.conv(whole.cast("string"), 10, 8))
        else:
            digits = F.hex(whole) if how == "X" else F.lower(F.hex(whole))
        return _signed(F.lit(""), digits, n, left, zero)

    def real(x: Column) -> Column:
        q = 6 if p is None else p
        odd = F.isnan(x) | (F.abs(x) == float("inf"))
        nought = F.lit({"f": f"%.{q}f", "e": f"%.{q}e", "g": "%.0f"}[how] % 0.0)
        negative = (x < 0) | (x == 0) & F.startswith(x.cast("string"), F.lit("-"))
        sign = F.when(negative, "-").otherwise("+" if "+" in flags else " " if " " in flags else "")
        special = _widened(F.concat(sign, F.when(F.isnan(x), "nan").otherwise("inf")), n, left)
        body = F.when(x == 0, nought).otherwise({"f": fixed, "e": scientific, "g": general}[how](F.abs(x), q))
        return F.when(odd, special).otherwise(let(body, lambda t: _signed(sign, t, n, left, zero)))

    if how in "di" and p is None:
        return signed
    if how in "uoxX" and p is None:
        return unsigned
    if how in "feg" and (p is None or p <= (6 if how == "f" else 12)):
        return real
    return None


def _widened(text: Column, n: int, left: bool) -> Column:
    if not n:
        return text
    size = F.greatest(F.length(text), F.lit(n))
    return F.rpad(text, size, F.lit(" ")) if left else F.lpad(text, size, F.lit(" "))


def _signed(sign: Column, digits: Column, n: int, left: bool, zero: bool) -> Column:
    if not n or left or not zero:
        return _widened(F.concat(sign, digits), n, left)
    return F.concat(sign, F.lpad(digits, F.greatest(F.length(digits), F.lit(n) - F.length(sign)), F.lit("0")))


def _formatted(fmt: str, args: list[tuple[Column, str, Column | None]], convfmt: str) -> Column:
    kinds = ["F" if own is not None else k for _, k, own in args]

    @F.arrow_udf(T.StringType())
    def run(*columns: pa.Array) -> pa.Array:
        from recordflow.runtime.formats import sprintf as formatted
        from recordflow.runtime.values import from_input

        lists = [c.to_pylist() for c in columns]
        values = [[from_input(x) for x in col] if k == "F" else col for col, k in zip(lists, kinds, strict=True)]
        return pa.array([formatted(fmt, list(row), convfmt) for row in zip(*values, strict=True)], pa.string())

    if not args:
        from recordflow.runtime.formats import sprintf as formatted

        return F.lit(formatted(fmt, [], convfmt))
    return run(*[a if own is None else own for a, _, own in args])


def strftime(fmt: str, at: Column) -> Column:
    """UTC time of an epoch; the common conversions run natively."""
    known = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD"}
    parts, i, java = [], 0, True
    while i < len(fmt):
        if fmt[i] == "%":
            code = fmt[i : i + 2]
            java = java and code in known
            parts.append(known.get(code, ""))
            i += 2
        else:
            java = java and fmt[i] != "'"
            parts.append(f"'{fmt[i]}'")
            i += 1
    if java:
        text = "".join(parts).replace("''", "")  # quoted runs side by side are one
        moment = F.timestamp_seconds(F.floor(at))
        return F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(moment, F.current_timezone()), "UTC"), text)

    @F.arrow_udf(T.StringType())
    def run(times: pa.Array) -> pa.Array:
        import math
        from datetime import datetime, timezone

        def one(x):
            try:
                return datetime.fromtimestamp(math.floor(x), timezone.utc).strftime(fmt)
            except (OverflowError, ValueError, OSError):
                return ""

        return pa.array([None if x is None else one(x) for x in times.to_pylist()], pa.string())

    return run(at)

