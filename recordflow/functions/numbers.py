"""Numbers and their text, truth and comparison."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as numeric text.
NUMERIC = r"\A[ \t-\r]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t-\r]*\z"
PREFIX = r"\A[ \t-\r]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
SIGNED = r"(?i)\A[ \t-\r]*[+-](inf|nan)[ \t-\r]*\z"
TINY = 2.2250738585072014e-308
#: Formats of so few digits that they tell the exact value of a double from its shortest
#: digits only at ties.
NATIVE = re.compile(r"%[.]([0-6](?=f)|[0-9](?=[ge])|1[0-2](?=[ge]))([gfe])")


def _sound(x: Column, s: Column) -> Column:
    """Neither over- nor underflowed."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & ((F.abs(x) >= TINY) | (x == 0) & ~F.regexp_like(F.regexp_extract(s, r"\A([^eE]*)", 1), F.lit("[1-9]")))


def _clean(s: Column) -> Column:
    return F.regexp_replace(s, r"[\t-\r ]", "")


def is_numeric(s: Column) -> Column:
    """Whether a text looks like a number as a whole."""
    plain = s.rlike(NUMERIC)
    return F.when(plain, _sound(_clean(s).try_cast("double"), s)).otherwise(s.rlike(SIGNED))


def number_of_input(s: Column) -> Column:
    """Number of a text from input: of the whole if it looks numeric, else of its start."""
    special = F.when(s.rlike(r"(?i)nan"), F.lit(float("nan"))).when(s.rlike("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(s.rlike(SIGNED), special).otherwise(number_of_text(s))


def number_of_text(s: Column) -> Column:
    """Number that a text starts with, or 0."""
    head = F.regexp_extract(s, PREFIX, 1)
    x = head.try_cast("double")
    return F.when(_sound(x, head), x).otherwise(F.lit(0.0))


def _side(x: Column, digits: Column, power: Column) -> Column:
    """The sign of x - digits * 10^power for a positive x near it, from one exact step: a
    fused multiply-add rounds once, so its sign is that of the exact difference. Where the
    power of ten isn't a double, all digits of x are compared."""
    ten = lambda n: F.concat(F.lit("1e"), n.cast("string")).cast("double")  # noqa: E731  exact up to 22
    fma = lambda a, b, c: F.call_function("reflect", F.lit("java.lang.Math"), F.lit("fma"), a, b, c).cast("double")
    d = digits.cast("double")
    every = F.regexp_replace(F.regexp_replace(_exact(x), "E.*$|[.]", ""), "^0+", "")
    ours = F.rpad(every, F.greatest(F.length(every), F.length(digits.cast("string"))), F.lit("0"))
    theirs = F.rpad(digits.cast("string"), F.length(ours), F.lit("0"))
    by_digits = F.when(ours > theirs, 1.0).when(ours < theirs, -1.0).otherwise(0.0)
    return F.when(F.abs(power) > 22, by_digits).otherwise(F.signum(F.when(power <= 0, fma(x, ten(-power), -d)).otherwise(-fma(d, ten(power), -x))))


def let(x: Column, then) -> Column:
    """then(x), where x is computed once however often it is used, and what follows stays
    small in generated code."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def scientific(x: Column, precision: int) -> Column:
    """%.Ne of a finite number that isn't 0. Java rounds the shortest digits half up, C the
    exact value half to even: they differ only where the shortest digits end in a 5 right
    after the last one kept, and there the exact value decides."""
    up = F.format_string(f"%.{precision}e", x)
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(F.abs(x).cast("string"), "E", 1), "[.]", ""), "^0+|0+$", "")

    def tied(d: Column) -> Column:
        exponent = F.substring_index(F.format_string("%.16e", x), "e", -1)
        even = F.substring(d, precision + 1, 1).isin(*"02468")
        down = F.concat(F.when(x < 0, "-").otherwise(""), F.substring(d, 1, 1), *([F.lit("."), F.substring(d, 2, precision)] if precision else []), F.lit("e"), exponent)
        return let(_side(F.abs(x), d, exponent.cast("int") - (precision + 1)), lambda side: F.when((side < 0) | (side == 0) & even, down).otherwise(up))

    return let(digits, lambda d: F.when((F.length(d) == precision + 2) & F.endswith(d, F.lit("5")), tied(d)).otherwise(up))


def _sure(y: Column) -> Column:
    """Whether a product below 1e9 is rounded rightly although it isn't exact."""
    return (y < 1e9) & (F.abs(y - F.floor(y) - 0.5) > 1e-5)


def general(x: Column, precision: int) -> Column:
    """%.Ng of a finite number that isn't 0. Most numbers are scaled to an integer of N
    digits; those that are near a tie, or large or small, go by their shortest digits."""
    n = max(1, precision)
    if n > 8:
        return _general(x, n)
    minus = F.when(x < 0, "-").otherwise("")

    def shaped(p: int):
        def text(y: Column) -> Column:
            digits = F.rint(y).cast("bigint")
            rest = digits % 10**p
            tail = F.when(rest > 0, F.concat(F.lit("."), F.rtrim(F.lpad(rest.cast("string"), p, "0"), F.lit("0")))).otherwise("") if p else F.lit("")
            return F.when(_sure(y) & (digits < 10**n), F.concat(minus, ((digits - rest) / 10**p).cast("bigint").cast("string"), tail))

        return text

    def sized(size: Column) -> Column:
        out = F.when(size < 0.01, F.lit(None).cast("string"))
        for e in range(-2, n):
            out = out.when(size < 10.0 ** (e + 1), let(size * 10.0 ** (n - 1 - e), shaped(n - 1 - e)))
        return out

    return F.coalesce(let(F.abs(x), sized), _general(x, n))


def _general(x: Column, n: int) -> Column:

    def shaped(e: Column) -> Column:
        power = F.substring_index(e, "e", -1).cast("int")
        plain = F.regexp_replace(e.try_cast(f"decimal(38,{n + 4})").cast("string"), "[.]0*$|([.][0-9]*[1-9])0+$", "$1") if n < 34 else e
        return F.when((power < -4) | (power >= n), F.regexp_replace(e, "[.]0*e|([.][0-9]*[1-9])0+e", "$1e")).otherwise(plain)

    return let(scientific(x, n - 1), shaped)


def fixed(x: Column, precision: int) -> Column:
    """%.Nf of a finite number, N up to 6; most go as an integer of the last places."""

    def shaped(y: Column) -> Column:
        digits = F.rint(y).cast("bigint")
        rest = digits % 10**precision
        whole = ((digits - rest) / 10**precision).cast("bigint").cast("string")
        text = F.concat(F.when(x < 0, "-").otherwise(""), whole, *([F.lit("."), F.lpad(rest.cast("string"), precision, "0")] if precision else []))
        return F.when(_sure(y), text).otherwise(_fixed(x, precision))

    return let(F.abs(x) * 10.0**precision, shaped)


def _fixed(x: Column, precision: int) -> Column:
    up = F.format_string(f"%.{precision}f", x)
    minus = F.when(x < 0, "-").otherwise("")
    ten = F.lit(str(10 ** (precision + 1))).cast("decimal(18,0)")

    def tied(scaled: Column) -> Column:
        whole = scaled.cast("bigint")
        even = F.floor(scaled / 10).cast("bigint") % 2 == 0
        down = F.concat(minus, ((whole - 5) / ten).cast(f"decimal(30,{precision})").cast("string"))
        return let(_side(F.abs(x), whole, F.lit(-(precision + 1))), lambda side: F.when((side < 0) | (side == 0) & even, down).otherwise(up))

    def long(size: Column) -> Column:
        # from 2^29 on what follows the point has 24 bits at most, and all its digits are used
        floor = F.floor(size)
        rest = ((size - floor.cast("double")) * 2.0**24).cast("decimal(9,0)") * F.lit(f"{2.0**-24:.24f}").cast("decimal(24,24)")
        rounded = F.bround(rest, precision) if precision else F.when((rest > 0.5) | (rest == 0.5) & (floor % 2 == 1), 1).otherwise(0)
        return F.concat(minus, (floor.cast("decimal(17,0)") + rounded.cast(f"decimal(20,{precision})")).cast(f"decimal(30,{precision})").cast("string"))

    scaled = (F.abs(x).cast("string").try_cast("decimal(38,20)") * ten).cast("decimal(38,20)")
    near = (F.abs(x) < 2**53 / 10 ** (precision + 1)) & (x != F.floor(x))
    small = F.when(near, let(scaled, lambda v: F.when((v == F.floor(v)) & (v % 10 == 5), tied(v)).otherwise(up))).otherwise(up)
    return F.when(F.abs(x) >= 2**53, F.concat(_whole_text(x), F.lit("." + "0" * precision if precision else ""))).when(F.abs(x) >= 2**29, long(F.abs(x))).otherwise(small)


def _whole_text(x: Column) -> Column:
    """All digits of a whole number."""
    small = F.abs(x) < 2**53
    low = F.when(small, x).otherwise(0.0).cast("bigint").cast("string")
    unit = F.lit(2**53).cast("decimal(20,0)")
    split = F.when(~small & (F.abs(x) < 2.0**115), x)
    high = split / 2.0**53
    top = F.when(high >= 0, F.floor(high)).otherwise(F.ceil(high))
    large = (top.cast("decimal(20,0)") * unit).cast("decimal(38,0)") + (split - top.cast("double") * 2.0**53).cast("decimal(20,0)")
    return F.when(small, low).otherwise(F.coalesce(large.cast("decimal(38,0)").cast("string"), _exact(x)))


def _exact(x: Column) -> Column:
    return F.call_function("reflect", F.lit("scala.math.BigDecimal"), F.lit("exact"), x)


def _huge(x: Column) -> Column:
    """%.30g of a number from 1e30 on, from all its digits."""

    def shaped(d: Column) -> Column:
        kept, rest = F.substring(d, 1, 30).cast("decimal(38,0)"), F.substring(d, 31, 400)
        half = F.rpad(F.lit("5"), F.length(rest), F.lit("0"))
        more = F.when((rest > half) | (rest == half) & (kept % 2 == 1), 1).otherwise(0)
        n = (kept + more).cast("decimal(38,0)").cast("string")
        mantissa = F.rtrim(F.rtrim(F.concat(F.substring(n, 1, 1), F.lit("."), F.substring(n, 2, 29)), F.lit("0")), F.lit("."))
        return F.concat(F.when(x < 0, "-").otherwise(""), mantissa, F.lit("e+"), (F.length(d) - 31 + F.length(n)).cast("string"))

    return let(_exact(F.abs(x)), shaped)


def _special(x: Column) -> Column:
    return F.when(F.isnan(x), "+nan").when(x > 0, "+inf").otherwise("-inf")


@F.arrow_udf(T.StringType())
def _formatted(xs: pa.Array, fmts: pa.Array) -> pa.Array:
    from recordflow.runtime.values import number_text

    return pa.array([None if x is None else number_text(x, f) for x, f in zip(xs.to_pylist(), fmts.to_pylist(), strict=True)], pa.string())


def text_of_number(x: Column, fmt: str = "%.6g", integral: bool = False) -> Column:
    """Text of a number: integers in full, others by fmt, exactly as C prints them.
    ``integral`` says that there are only integers of less than 16 digits. Formats other
    than a plain %.Ng, %.Nf or %.Ne go through Python, in Arrow batches."""
    if integral:
        return x.cast("bigint").cast("string")
    size = F.abs(x)
    whole = (x == F.floor(x)) & (size < 2**53)
    m = NATIVE.fullmatch(fmt)
    out = F.when(whole, F.when(whole, x).otherwise(0.0).cast("bigint").cast("string"))
    if m:
        how = {"g": general, "f": fixed, "e": scientific}[m[2]]
        large = lambda v: F.when(F.abs(v) < 1e30, _whole_text(v)).otherwise(_huge(v))
        return out.when(x.isNotNull(), let(x, lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), _special(v)).when(F.abs(v) >= 2**53, large(v)).otherwise(how(v, int(m[1])))))
    return out.otherwise(_formatted(F.when(~whole, x), F.lit(fmt)))


def text_of_column(x: Column, kind: T.DataType) -> Column:
    """Text of a table's number, as a file would have it: integers and decimals with all
    their digits, floats in the shortest form that reads back as the same number, with an
    exponent below 1e-4 and from 1e16 on."""
    if isinstance(kind, T.BooleanType):
        return x.cast("int").cast("string")
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return x.cast("string")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e16)
    return F.when(whole, F.when(whole, x).otherwise(0.0).cast("bigint").cast("string")).when(x.isNotNull(), let(x.cast("double") if isinstance(kind, T.DoubleType) else x, _float_text))


def _float_text(x: Column) -> Column:
    def shaped(s: Column) -> Column:
        size = F.abs(x)
        digits = F.regexp_replace(s.try_cast("decimal(38,22)").cast("string"), "[.]?0+$", "")
        power = F.substring_index(s, "E", -1).try_cast("int")
        scientific = F.concat(F.regexp_replace(F.substring_index(s, "E", 1), "[.]0$", ""), F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
        special = F.when(F.isnan(x), "nan").when(x > 0, "inf").otherwise("-inf")
        odd = F.isnan(x) | (size == float("inf"))
        return F.when(odd, special).when((size >= 1e-3) & (size < 1e7) & ~F.contains(s, F.lit("E")), s).when((size >= 1e-4) & (size < 1e16), digits).otherwise(scientific)

    s = x.cast("string")
    fewest = s
    for n in (17, 16, 15):  # Java's digits aren't always the fewest
        fewer = F.format_string(f"%.{n - 1}e", x)
        fewest = F.when((F.length(s) > 17) & (fewer.cast("double") == x.cast("double")), F.regexp_replace(fewer, "([.][0-9]*?)0*e[+]?", "$1E")).otherwise(fewest)
    return let(F.regexp_replace(fewest, "E(-?)0+([0-9])", "E$1$2"), shaped)


def truth(x: Column, kind: str) -> Column:
    if kind == "N":
        return x != 0
    if kind == "S":
        return x != ""
    if kind == "U":
        return F.lit(False)
    return F.when(is_numeric(x), number_of_input(x) != 0).otherwise(x != "")


def _compare(op: str, a: Column, b: Column) -> Column:
    return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b, "==": a == b, "!=": a != b}[op]


def compare_numbers(op: str, a: Column, b: Column, nan_free: bool = True) -> Column:
    """Comparison of numbers; with NaN, <=, >= and != are true and the others false, other
    than in SQL."""
    if nan_free:
        return _compare(op, a, b)
    either = F.isnan(a) | F.isnan(b)
    return F.when(either, F.lit(op in ("<=", ">=", "!="))).otherwise(_compare(op, a, b))


compare_texts = _compare


def truncated(x: Column) -> Column:
    """Toward zero, still a double."""
    return F.when(x >= 0, _floor(x)).otherwise(-_floor(-x))


def _floor(x: Column) -> Column:
    # floor() yields a bigint, out of range for large doubles, which are whole anyway
    return F.when(F.abs(x) < 9e15, F.floor(F.when(F.abs(x) < 9e15, x).otherwise(0.0)).cast("double")).otherwise(x)


def to_long(x: Column) -> Column:
    """A number cut to 64 bits; out of range becomes the nearest."""
    big = F.when(F.isnan(x), F.lit(0.0)).when(x >= 9.2e18, F.lit(9.2e18)).when(x <= -9.2e18, F.lit(-9.2e18)).otherwise(x)
    exact = big.cast("bigint")
    return F.when(F.isnan(x), F.lit(0).cast("bigint")).when(x >= 9.223372036854775807e18, F.lit((1 << 63) - 1)).when(x <= -9.223372036854775807e18, F.lit(-(1 << 63))).otherwise(exact)


def divided(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(F.try_divide(a, b))


def remainder(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.raise_error(F.lit("division by zero in %")).cast("double")).otherwise(F.try_mod(a, b))


def logarithm(x: Column) -> Column:
    return F.when(x > 0, F.ln(F.when(x > 0, x))).when(F.isnan(x), x).otherwise(F.lit(1.0))


def square_root(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(F.when(x >= 0, x))).when(F.isnan(x), x).otherwise(F.lit(1.0))


def exponential(x: Column) -> Column:
    y = F.exp(x)
    return F.when((F.abs(x) != float("inf")) & ((y == 0) | (y == float("inf"))), F.lit(1.0)).otherwise(y)


def shifted(a: Column, n: Column, left: bool) -> Column:
    by = to_long(n)
    x = F.call_function("shiftleft" if left else "shiftright", to_long(a), by.cast("int"))
    return F.when((by < 0) | (by >= 64), F.raise_error(F.lit("shift out of range")).cast("bigint")).otherwise(x).cast("double")

