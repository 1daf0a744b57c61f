"""Generated programs: lowered and in sequence they print the same."""

import random

import pytest

from recordflow.api import Program
from recordflow.sources.records import from_strings


def number(r):
    return r.choice(["$2", "$3", "NF", "length($1)", str(r.randint(0, 20)), "($2 + 1)", "($3 * 2)", "int($2 / 3)", "($2 % 5)"])


def text(r):
    return r.choice(["$1", "$NF", "\"lit\"", "($1 \"-\" $2)", "substr($1, 1, 2)", "toupper($1)", "sprintf(\"%03d\", $2)", "($2 > 50 ? \"hi\" : \"lo\")"])


def condition(r):
    return r.choice([f"{number(r)} > {number(r)}", f"{number(r)} <= {number(r)}", "$1 ~ /k[0-3]/", "/7/", "$1 == \"k1\"", f"({number(r)} < 9 || $1 != \"k2\")", f"!({number(r)} > 30)"])


def body(r):
    lines = []
    for _ in range(r.randint(1, 3)):
        lines.append(r.choice([
            f"print {text(r)}, {number(r)}", f"x = {number(r)}; print x + 1", f"if ({condition(r)}) print {text(r)}; else print {number(r)}", f"if ({condition(r)}) next", f"y = {text(r)}; z = y {text(r)}; print z", f"$2 = {number(r)}; print",
        ]))
    return "; ".join(lines)


def fold(r):
    k = r.choice(["$1", "$2 % 7", "$1, $2 > 40", "substr($1, 2)"])
    guard = r.choice(["", f"{condition(r)} "])
    step = r.choice(["a[K]++", f"a[K] += {number(r)}", f"a[K] = {text(r)}", f"if (!((K) in a)) a[K] = {number(r)}"])
    simple = "," not in k
    step = step.replace("(K) in", f"({k}) in" if simple else f"({k}) in").replace("[K]", f"[{k}]")
    end = r.choice(["print k, a[k]", "if (length(k) > 1) print k", "n++"])
    return f"{guard}{{ {step} }} END {{ for (k in a) {{ {end} }} print n + 0, NR }}"


def ordered(r):
    return r.choice([f"{{ s += {number(r)}; print s, $1 }}", f"{condition(r)} {{ c++ }} {{ print c + 0 }}", f"{{ print p, $1; p = {text(r)} }}", f"{{ print q[$1] + 0; q[$1] = {number(r)} }}", f"{condition(r)}, {condition(r)}", f"NR % {r.randint(2, 5)} == 1 {{ print NR, {text(r)} }}", f"{condition(r)} && !seen[$1]++"])


@pytest.mark.parametrize("seed", range(40))
def test_generated(spark, seed):
    r = random.Random(seed)
    program = r.choice([lambda: f"{{ {body(r)} }}", lambda: f"{condition(r)} {{ {body(r)} }} {condition(r)}", lambda: fold(r), lambda: ordered(r)])()
    records = [f"k{r.randint(0, 5)} {r.randint(0, 99)} {r.randint(-9, 99)}{r.choice(['', ' tail', ' 7'])}" for _ in range(40)]
    out = []
    Program(program).run_local([("", "".join(x + "\n" for x in records))], out.append)
    p = Program(program)
    got = p.lines(from_strings(spark, records).drop("rt"))
    assert sorted(got) == sorted("".join(out).split("\n")[:-1]), (program, p.explain())
