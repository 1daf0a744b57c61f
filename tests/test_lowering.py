"""Lowered programs give what the sequential evaluator gives, and stay relational."""

import random

import pytest

from recordflow.api import Program
from recordflow.plans.symbols import NotRelational
from recordflow.sources.records import from_strings

PROGRAMS = [
    ("{ print $1, $3 }", "1"), ("$2 > 10", "1"), ("$1 ~ /^k[0-4]$/ { print $2 }", "1"), ("{ print $1 \":\" $2 + $3 }", "1"), ("{ print ($2 < $3), ($2 == $3), ($1 < $2), ($3 != \"x\") }", "1"),
    ("{ $2 = \"z\"; print }", "1"), ("{ $6 = NF; print; print NF }", "1"), ("{ NF = 2; print }", "1"), ("{ $0 = $3 \" \" $1; print $2, NF }", "1"), ("{ print NF, $NF, $(NF - 1) }", "1"),
    ("{ n = gsub(/[0-9]+/, \"<&>\"); print n, $0 }", "1"), ("{ sub(/k/, \"\\\\&\", $1); print }", "1"), ("{ if (match($0, /[0-9]+/)) print RSTART, RLENGTH, substr($0, RSTART, RLENGTH) }", "1"),
    ("{ n = split($0, a, \"k\"); print n, a[1], a[2] }", "1"), ("{ printf \"%s-%d-%.1f\\n\", $1, $2, $3 }", "1"), ("{ print toupper($1), length($0), index($0, \" \"), int($2 / 3), $2 % 7 }", "1"),
    ("$2 > 5 { print \"a\", $1 } $3 > 5 { print \"b\", $1 } END { }", "2"), ("$2 > 50 { next } { print $1 }", "1"), ("{ x = $2 > 9 ? \"hi\" : \"lo\"; if (x == \"hi\") y = 1; else y = 0; print x, y }", "1"),
    ("{ s += $2; n++ } END { print s, n, NR, s / n }", "2"), ("{ if ($2 + 0 > m) m = $2 + 0 } END { print m }", "2"), ("/k1/ { a++ } $2 > 50 { b++ } END { print a, b }", "2"),
    ("{ c[$1]++; s[$1] += $2 } END { for (k in c) print k, c[k], s[k] }", "2"), ("{ c[$1, $3 > 9]++ } END { for (k in c) { split(k, p, SUBSEP); print p[1], p[2], c[k] } }", "2"),
    ("{ l[$1] = $2 } END { for (k in l) print k, l[k] }", "2"), ("{ if (!($1 in f)) f[$1] = $2 } END { for (k in f) print k, f[k] }", "2"), ("{ for (i = 1; i <= NF; i++) w[$i]++ } END { for (k in w) print k, w[k] }", "2"),
    ("{ t[$1] = t[$1] $2 \";\" } END { for (k in t) print k, t[k] }", "2"), ("{ c[$1]++ } END { for (k in c) if (c[k] > 3) { n++; print k } }", "2"), ("{ c[$1]++ } END { print length(c), c[\"k1\"], c[\"none\"] }", "2"),
    ("{ a[$1] += $2 } END { for (k in a) t += a[k]; for (k in a) print k, a[k] / t }", "2"), ("END { print NR, $1 }", "2"), ("{ s = s $1 } END { print s }", "2"),
    ("!seen[$1]++", "2"), ("{ if (!($1 in s)) { print; s[$1] = 1 } }", "2"), ("{ if (s[$1]++ == 0) print $2, $1 }", "2"), ("!seen[$1, $2]++ { print $0, NF }", "2"), ("seen[$1]++ == 1 { print $0 }", "3"), ("{ s += $2; print s }", "3"), ("{ s[$1] += $2; print $1, s[$1] }", "3"), ("{ print $2 - p; p = $2 + 0 }", "3"), ("{ print $1, ++c[$1] }", "3"),
    ("NR % 3 == 0", "3"), ("NR == 4 { exit } { print }", "3"), ("NR <= 5 { print NR, $1 }", "3"), ("/k2/, /k3/", "3"), ("/k2/, /k2/ { print NR }", "3"), ("$1 != p { g++ } { p = $1; print g, $1 }", "3"),
    ("$2 + 0 > m { m = $2 + 0 } { print m }", "3"), ("{ if ($2 + 0 > best[$1]) best[$1] = $2 + 0; print $1, best[$1] }", "3"), ("{ print seen[$1]; if ($3 > 9) seen[$1] = NR }", "3"), ("$2 > 90 { exit } { n++ } END { print n }", "3"),
    ("function f(a, b) { if (a > b) return a \"!\"; return b } { print f($2 + 0, $3 + 0) }", "1"), ("BEGIN { lim = 40; OFS = \"-\" } $2 > lim { print $1, lim }", "1"), ("BEGIN { w[\"k1\"] = \"one\" } $1 in w { print $1, w[$1] }", "1"), ("BEGIN { w[\"k1\"] = \"one\" } { print $1, ($1 in w), w[$1] }", "4"), ("BEGIN { w[\"k1\"] = 7 } { print w[$1] }", "1"),
    ("BEGIN { print \"head\" } { n++ } END { print \"n=\" n }", "2"), ("{ print; s += $2 } END { print \"total\", s }", "2"),
    ("{ t[$1] = t[$1] $2; if (length(t[$1]) > 4) { print $1, t[$1]; t[$1] = \"\" } }", "3b"), ("{ a[NR % 3] = $0 } END { for (i = 0; i < 3; i++) print a[i] }", "3"), ("{ while (n < $2) n += 7; print n }", "4"), ("{ RS = \"x\"; print }", "4"),
]


def lines(n, seed):
    r = random.Random(seed)
    values = lambda: r.choice([str(r.randint(-20, 99)), f"{r.randint(0, 99)}.{r.randint(0, 99)}", "x", "07", "1e1", "+3"])
    return [" ".join([f"k{r.randint(0, 5)}", str(r.randint(0, 99)), values(), *[values() for _ in range(r.randint(0, 2))]]) for _ in range(n)]


@pytest.mark.parametrize("program,tier", PROGRAMS)
def test_same_as_in_sequence(spark, program, tier):
    for seed, n in ((1, 60), (2, 7)):
        records = lines(n, seed)
        out = []
        Program(program).run_local([("", "".join(r + "\n" for r in records))], out.append)
        p = Program(program)
        got = p.lines(from_strings(spark, records).drop("rt"))
        want = "".join(out).split("\n")[:-1]
        assert p.lowered.tier == tier, p.explain()
        assert sorted(got) == sorted(want)
        if tier in ("1", "3") and "END" not in program:
            assert got == want


@pytest.mark.parametrize("program", ["{ print $1, $2 }", "{ c[$1]++ } END { for (k in c) print k, c[k] }", "{ s += $2 } END { print s }", "!seen[$1]++"])
def test_empty_input(spark, program):
    p = Program(program)
    out = []
    Program(program).run_local([("", "")], out.append)
    assert p.lines(spark.createDataFrame([], "__file string, __pos long, value string")) == "".join(out).split("\n")[:-1]


def test_lookup_join(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "k string, v int"), spark.createDataFrame([("x",), ("z",), ("y",)], "k string")
    p = Program("NR == FNR { m[$1] = $2; next } $1 in m { print $1, m[$1] }")
    got = p.run([a, b], names=["k", "v"], order_by=["v"])
    assert sorted(map(tuple, got.collect())) == [("x", 3.0), ("y", 2.0)] and p.lowered.tier == "2c"
    p = Program("NR == FNR { m[$1] = 1; next } !($1 in m)")
    assert [r[0] for r in p.run([a, b], names=["k"], order_by=["v"]).collect()] == ["z"]


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id as a", "id * 2 as b", "id as c").write.parquet(str(tmp_path / "t"))
    df = Program("$1 > 90 { print $2 }").run(spark.read.parquet(str(tmp_path / "t")), names=["b"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a" in plan and "c:" not in plan.split("ReadSchema:")[1]
    assert df.count() == 9


def test_refusal(spark):
    with pytest.raises(NotRelational):
        Program("{ while (n < $1) n++; print n }").run(spark.createDataFrame([("1",)], "value string"), relational=True)


def test_nulls(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, 2.5, None)], "x int, y double, s string")
    got = Program("{ print $1 + 1, $2 * 2, $3 \"!\" }").run(df, names=["a", "b", "c"]).collect()
    assert sorted((r["c"] for r in got)) == ["!", "a!"]


OWN = [
    "{ n = $2; c = 0; while (n > 1) { n = int(n / 2); c++ } print $1, c }", "{ split($0, a, \" \"); delete a[1]; for (k in a) print k, a[k] }", "{ do { x = $2; $2 = x - 10 } while ($2 > 0); print }", "function f(n) { return n < 2 ? n : f(n - 1) + f(n - 2) } { print f($2 % 9) }",
    "function fill(a, n,  i) { for (i = 1; i <= n; i++) a[i] = i } { delete q; fill(q, $2 % 5); print length(q) }", "{ if ($1 ~ (\"^\" substr($1, 1, 1))) print NF; else print \"no\" }", "{ for (i = NF; i > 0; i--) { if ($i == \"x\") break; if ($i > 50) continue; print i, $i } }", "$2 > 50 { if ($1 == \"k1\") next; while (match($1, /k/)) sub(/k/, \"z\", $1) } { print $1 }",
]
CARRIED = [
    "{ while (n < $2) n += 7; print n }", "{ if ($2 > 9) x = 1; while (x) { print x; x = 0 } }", "function fill(a) { a[length(a)] = 1 } { fill(q); print length(q) }", "function g(n) { t += n; while (n > 0) n--; return t } { print g($2) }", "{ split($0, a); while (!(\"z\" in b)) b[\"z\"] = 1; print length(b) }",
    "{ do { x += 1 } while (x < $2); print x }", "{ for (;;) { if ($2 > 5) break; y = 1; break } print y }", "{ while ((getline line) > 0) n++; print n }", "{ $1 = NR; while ($2 > 0) $2 -= 9; print }",
]


@pytest.mark.parametrize("program", OWN + CARRIED)
def test_records_by_themselves(spark, program):
    """What is run record by record, and what must not be: both as in sequence."""
    records = lines(40, 3)
    out = []
    Program(program).run_local([("", "".join(r + "\n" for r in records))], out.append)
    p = Program(program)
    df = from_strings(spark, records).drop("rt")
    assert p.lines(df.repartition(3)) == "".join(out).split("\n")[:-1]
    assert (p.lowered.tier == "1p") == (program in OWN), p.explain()


@pytest.mark.parametrize("program,relational", [
    ("BEGINFILE { n = 0 } { n += $2 } ENDFILE { print FNR, n }", True), ('BEGINFILE { m = 0; s = "" } $2 + 0 > m { m = $2 + 0 } /k1/ { s = s $1 } ENDFILE { print FILENAME, m, s }', True),
    ("{ n += $2 } ENDFILE { print n }", False), ("BEGINFILE { n = 0 } { n++ } ENDFILE { print NR, n }", False), ("BEGINFILE { n = 5 } { n++ } ENDFILE { print n }", False), ("BEGINFILE { n = 0 } { a[$1]++; n++ } ENDFILE { print n, length(a) }", False),
])
def test_files(spark, program, relational):
    texts = {f"f{i}": lines(20 + i, i) for i in range(3)}
    out = []
    Program(program).run_local([(name, "".join(r + "\n" for r in rows)) for name, rows in texts.items()], out.append)
    df = spark.createDataFrame([(i, name, k, r) for i, (name, rows) in enumerate(texts.items()) for k, r in enumerate(rows)], "__src int, __file string, __pos long, value string")
    p = Program(program)
    assert sorted(p.lines(df)) == sorted("".join(out).split("\n")[:-1])
    assert (p.lowered.tier != "4") == relational, p.explain()
