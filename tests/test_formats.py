"""Numbers as text: native formats against C's, exact at ties."""

import math
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.functions import numbers, strings
from recordflow.runtime.evaluator import simple_case
from recordflow.runtime.formats import sprintf
from recordflow.runtime.values import number_text

CONVFMTS = ["%.6g", "%.2f", "%.3e", "%.0f", "%.12g"]
FORMATS = ["%.6g", "%.2f", "%.3e", "%.0f", "%g", "%f", "%e", "%.1g", "%d|%5d|%-6d|%05d|%+d|% d", "%x|%X|%o|%u", "%8.3f|%-8.1f|%08.2f|%+.1e", "%s|%10s|%-12s|%.3s", "100%% %d%%"]
EDGES = [0.0, -0.0, 1e15, 1e16, 123456789012345680.0, 1e-4, 1e-5, 999999.5, 9999995.0, 0.5, 1.5, 2.5, -2.5, math.inf, -math.inf, math.nan, 1e29, 2.0**53, 1234565.5, 0.1, 123456.5, 123457.5, 2.0**63, 2.0**64, -3.7, 0.125, 0.375, 1960213643554571.5, 2.5e300, -1e30, 1.7976931348623157e308, 2.0**115, 2.0**120 + 2.0**70, 9.999999999999999e33]


def samples():
    r = random.Random(7)
    out = list(EDGES)
    out += [float(f"{m}e{e}") for m in ("1.5", "2.5", "1234565", "1234575") for e in (-300, -60, -30, -24, 24, 30, 60, 290)]
    for _ in range(300):
        out += [r.randint(-(10**7), 10**7) / 8, float(f"{r.randint(1, 9999999)}5e{r.randint(-14, 8)}"), r.uniform(-1, 1) * 10 ** r.randint(-12, 20), float(r.randint(-(10**17), 10**17)), round(r.uniform(-1000, 1000), r.randint(0, 5))]
    return out


def test_formats(spark):
    xs = samples()
    args = lambda f: [(F.col("x"), "N", None)] * f.replace("%%", "").count("%")
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    out = df.select("x", *[numbers.text_of_number(F.col("x"), f).alias(f"n{i}") for i, f in enumerate(CONVFMTS)], *[strings.sprintf(f, args(f)).alias(f"s{i}") for i, f in enumerate(FORMATS)])
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for row in out.collect():
        for i, f in enumerate(CONVFMTS):
            assert row[f"n{i}"] == number_text(row.x, f), (row.x, f)
        for i, f in enumerate(FORMATS):
            assert row[f"s{i}"] == sprintf(f, [row.x] * len(args(f))), (row.x, f)


def test_formats_of_texts(spark):
    """Conversions that stay in Python, and texts of all kinds as arguments."""
    values = ["7", "x7", "", " 12abc", "+3.5", "1e3", "é🙂z", "-0.0"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for f in ("%d|%5.1f|%s", "%c%c%c", "%-5s|%5s|%.1s", "%*d|", "%#x"):
        n = f.count("%") + f.count("*")
        got = df.select(strings.sprintf(f, [(F.col("v"), "S", None)] * n).alias("t")).collect()
        assert [r.t for r in got] == [sprintf(f, [v] * n) for v in values]


def test_text_of_columns(spark):
    xs = [x for x in samples() if math.isfinite(x)]
    rows = spark.createDataFrame([(x, int(x) if abs(x) < 2**62 else 0) for x in xs], "x double, n long").select("x", "n", numbers.text_of_column(F.col("x"), T.DoubleType()).alias("t"), numbers.text_of_column(F.col("n"), T.LongType()).alias("u")).collect()
    for r in rows:
        assert r.t == (str(int(r.x)) if r.x == int(r.x) and abs(r.x) < 1e16 else repr(r.x)) and r.u == str(r.n)


def test_case_is_letter_by_letter(spark):
    texts = ["ABC é", "İstanbul ΑΣ ΣΑΣ", "straße ŉ ﬁ ΐ", "🙂ß", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strings.tolower(F.col("t")).alias("a"), strings.toupper(F.col("t")).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(None, None) if t is None else (simple_case(t, str.lower), simple_case(t, str.upper)) for t in texts]
