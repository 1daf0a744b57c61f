"""Regular expressions against definitions, and Column functions against the evaluator."""

import random
import re

import pytest
from pyspark.sql import functions as F

from recordflow.functions import numbers as N
from recordflow.functions import strings as S
from recordflow.lang.nodes import ProgramError
from recordflow.runtime import values
from recordflow.runtime.ere import Ere, compile_ere, split_text, substitute
from recordflow.runtime.formats import sprintf


def pattern(r, depth=0):
    kind = r.random()
    if depth > 3 or kind < 0.45:
        return r.choice(["a", "b", "c", ".", "[ab]", "[^a]", "ab", "ba"])
    if kind < 0.65:
        return pattern(r, depth + 1) + pattern(r, depth + 1)
    if kind < 0.8:
        return f"({pattern(r, depth + 1)}|{pattern(r, depth + 1)})"
    return f"({pattern(r, depth + 1)}){r.choice(['*', '+', '?', '{2}', '{1,2}'])}"


def longest(source, text):
    """The leftmost-longest match by trying every end."""
    one = compile_ere(source).python
    for a in range(len(text) + 1):
        for b in range(len(text), a - 1, -1):
            if one.fullmatch(text, a, b):
                return a, b
    return None


def test_leftmost_longest():
    r = random.Random(8)
    exact = 0
    for _ in range(1500):
        source = pattern(r)
        ere = Ere(source)
        exact += ere.exact
        for _ in range(6):
            text = "".join(r.choices("abc", k=r.randint(0, 7)))
            assert ere.search(text) == longest(source, text), (source, text)
    assert exact > 300


@pytest.mark.parametrize("source,text,want", [
    ("^a", "ba", None), ("a$", "ab", None), ("a$", "ba", (1, 2)), ("[[:alpha:]]+", "1ab2", (1, 3)), ("[]a]+", "]a", (0, 2)), ("[^]]", "]x", (1, 2)), ("a{2,}", "aaa", (0, 3)), ("a{", "a{", (0, 2)), ("\\.", "a.b", (1, 2)), ("[a-c-e]+", "-", (0, 1)), ("[z-a]", "z", None), ("()a", "a", (0, 1)), ("a|", "b", (0, 0)), ("\\x41", "A", (0, 1)), ("[\\]]", "]", (0, 1)), ("*a", "*a", (0, 2)),
])
def test_syntax(source, text, want):
    assert Ere(source).search(text) == want


@pytest.mark.parametrize("source", ["[a", "(a", "a{2,1}", "a{256}", "$^"])
def test_refused(source):
    with pytest.raises(ProgramError):
        Ere(source)


PATTERNS = ["a", "a+", "a|ab", "(a|ab)(c|bcd)", "[0-9]+", "^x", "x$", "a.c", "[^a-z]", "é+", "\\.", "ab?", "(ab)+", "[[:space:]]+", ""]
TEXTS = ["", "a", "abcd", "aaa", "x1y22", "x\ny", "a.c\n", "ééz", " a  b ", "xx", "ab.ab", "ABC", "straße İz", "0x1A", "🙂a"]


def test_column_functions_equal_the_evaluator(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for p in PATTERNS:
        if p:
            got = [r[0] for r in df.select(S.matches(F.col("t"), p)).collect()]
            assert got == [compile_ere(p).matches(t) for t in TEXTS], p
            a, n = S.match(F.col("t"), p)
            want = [compile_ere(p).search(t) for t in TEXTS]
            assert [tuple(r) for r in df.select(a, n).collect()] == [(m[0] + 1, m[1] - m[0]) if m else (0, -1) for m in want], p
            for every in (False, True):
                s, k = S.substitute(F.col("t"), p, "<&\\&$1\\\\&>", every)
                assert [tuple(r) for r in df.select(s, k).collect()] == [substitute(compile_ere(p), "<&\\&$1\\\\&>", t, every) for t in TEXTS], p
            assert [r[0] for r in df.select(S.split_fields(F.col("t"), p, True)).collect()] == [split_text(t, p, True) for t in TEXTS], p
    for fs in (" ", "", ".", "|", "a", "x"):
        assert [r[0] for r in df.select(S.split_fields(F.col("t"), fs)).collect()] == [split_text(t, fs) for t in TEXTS], fs
    from recordflow.runtime.evaluator import simple_case

    assert [tuple(r) for r in df.select(S.toupper(F.col("t")), S.tolower(F.col("t"))).collect()] == [(simple_case(t, str.upper), simple_case(t, str.lower)) for t in TEXTS]


NUMBERS = ["", " ", "0", "1", "-1.5", "+3", ".5", "5.", "1e3", "1e400", "1e-400", "0e9", "12x", "0x1A", "inf", "+inf", "-nan", "nan", " 12 ", "1d", "1e", "e1", "--1", "1 2", "\t7\n", "007", "1.5e-3", "4.9e-324"]


def test_numeric_text(spark):
    df = spark.createDataFrame([(t,) for t in NUMBERS], "t string")
    got = df.select(N.is_numeric(F.col("t")), N.number_of_input(F.col("t")), N.number_of_text(F.col("t")), N.truth(F.col("t"), "F")).collect()
    for t, (looks, x, y, true) in zip(NUMBERS, got, strict=True):
        v = values.from_input(t)
        assert looks == (values.parse_number(t) is not None), t
        assert repr(abs(x)) == repr(abs(values.to_number(v))), t
        assert y == values.prefix_number(t) and true == values.truth(v), t


def test_number_text(spark):
    xs = [0.0, -0.0, 1.0, -7.0, 1e15, 1e16, 123456789012345680.0, 1e20, 0.1, 1 / 3, 1e-7, 1234567.5, float("inf"), float("-inf"), 2.5e300]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(N.text_of_number(F.col("x"))).collect()] == [values.number_text(x) for x in xs]
    cut = df.filter("abs(x) < 1e300").select(N.truncated(F.col("x")), N.to_long(F.col("x"))).collect()
    assert [tuple(r) for r in cut] == [(float(int(x)), max(-(1 << 63), min((1 << 63) - 1, int(x)))) for x in xs if abs(x) < 1e300]


def test_formats_cross_product():
    for flags in ("", "-", "+", " ", "0", "#", "-+", "0+"):
        for width in ("", "1", "9"):
            for precision in ("", ".", ".0", ".3"):
                for kind in "dioxXeEfFgG":
                    for v in (0.0, 1.0, -3.7, 255.0, 1e10, 123.456):
                        spec = f"%{flags}{width}{precision}{kind}"
                        if v < 0 and kind in "oxX" or "#" in flags and kind == "o":
                            continue
                        if kind in "oxX" and ("+" in flags or " " in flags):
                            continue  # a sign isn't for unsigned conversions
                        if kind in "di" and precision in (".", ".0") and int(v) == 0 or kind in "oxX" and precision in (".", ".0") and int(v) == 0:
                            continue  # C prints no digit here, Python one
                        if kind in "dioxX" and precision not in ("",) and "0" in flags:
                            continue  # C ignores 0 with a precision
                        if "#" in flags and kind in "xX" and (precision or int(v) == 0):
                            continue
                        want = spec.replace("i", "d") % (int(v) if kind in "dioxX" else v)
                        assert sprintf(spec, [v]) == want, (spec, v)
