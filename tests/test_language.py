"""Single features of the language, on the sequential evaluator."""

import pytest

from recordflow.api import Program
from recordflow.lang.nodes import ProgramError

PEOPLE = "Ann Lee 31 181\nBo Ray 24 164\nCy Fox 29 171\n"

CASES = [
    ("{ print $1, $2 }", "a b\nc d", "a b\nc d\n"),
    ('BEGIN { RS = ";" } { print NR ":" $0 }', "x;y;z", "1:x\n2:y\n3:z\n"),
    ('BEGIN { n = "7apples"; m = 3; print n * 2, (m "" == "3"), (n "" < m ""), "-2e1x" / 4 }', "", "14 1 0 -5\n"),
    ("BEGIN { while (i < 5) s += ++i; print s }", "", "15\n"),
    ("BEGIN { do { n++ } while (n < 3); print n; for (;;) { if (++k > 4) break; if (k == 2) continue; t = t k } print t }", "", "3\n134\n"),
    ("BEGIN { print sqrt(16), int(3.9), int(-3.9) }", "", "4 3 -3\n"),
    ("BEGIN { print and(5, 3), or(5, 3), xor(5, 3), lshift(1, 2), rshift(-8, 1) }", "", "1 7 6 4 -4\n"),
    ('BEGIN { s = "foo bar"; gsub("bar", "[&]", s); print s, length(s), toupper(s) }', "", "foo [bar] 9 FOO [BAR]\n"),
    ('BEGIN { a["k"] = 4; print a["k"]; delete a["k"]; print ("k" in a), length(a) }', "", "4\n0 0\n"),
    ("function scale(v, by) { v *= by; return v - 1 } BEGIN { w = 6; print scale(w, 3), w, scale(2) }", "", "17 6 -1\n"),
    ("function fact(n) { return n < 2 ? 1 : n * fact(n - 1) } BEGIN { print fact(10) }", "", "3628800\n"),
    ("function fill(a, n,  i) { for (i = 1; i <= n; i++) a[i] = i * i } BEGIN { fill(sq, 4); print sq[4], length(sq) }", "", "16 4\n"),
    ("$1 ~ /^[0-9]+$/ { print \"n\", $1; next } { print \"s\", $1 }", "12\nab\n", "n 12\ns ab\n"),
    ("{ if (length($0) > max) max = length($0) } END { print max }", "ab\nabcde\nabc", "5\n"),
    ("/2/,/4/", "1\n2\n3\n4\n5\n2\n", "2\n3\n4\n2\n"),
    ("/2/,/2/ { print NR }", "1\n2\n3\n2\n", "2\n4\n"),
    ("!seen[$0]++", "a\nb\na\nc\nb\n", "a\nb\nc\n"),
    ('BEGIN { FS = "," } NR > 1 { s += $3; print $2 } END { print "avg", s / (NR - 1) }', "id,n,v\n1,x,3\n2,y,4\n", "x\ny\navg 3.5\n"),
    ('BEGIN { OFS = ";" } { $1 = $1; print }', "a b  c\n", "a;b;c\n"),
    ("$4 > 170", PEOPLE, "Ann Lee 31 181\nCy Fox 29 171\n"),
    ("{ s += $4 } END { print s, s / NR }", PEOPLE, "516 172\n"),
    ("{ print NF, $NF, $(NF - 1) }", "a b c\n", "3 c b\n"),
    ("{ NF = 2; print; NF = 4; print $0 \"|\" }", "a b c\n", "a b\na b  |\n"),
    ("{ $5 = \"x\"; print NF; print }", "a b\n", "5\na b   x\n"),
    ('BEGIN { FS = ":" } { $0 = "p:q:r"; print NF, $2 }', "zz\n", "3 q\n"),
    ("BEGIN { print -1.5e-3, -(2 + 3), 2 ** 10, 17 % 5, -7.5 % 2, 2 ^ 0.5, -2 ^ 2, 2 ^ 3 ^ 2 }", "", "-0.0015 -5 1024 2 -1.5 1.41421 -4 512\n"),
    ("{ n += $2 ? 1 : 10; if (!$1) z = z NR } END { print n, z }", "0 x\n5 0\n0.0 00\nzz +1\n", "22 13\n"),
    ('BEGIN { print -1 "x", 1 + 2 "y" 3 + 4, "a" ("b" "c") "d" }', "", "-1x 3y7 abcd\n"),
    ('BEGIN { x = 0.1 + 0.2; print "x=" x; CONVFMT = "%.2f"; y = 1 / 3; print "y=" y; print 1 / 3 }', "", "x=0.3\ny=0.33\n0.333333\n"),
    ("BEGIN { print 1e16, 1e20, 2 ^ 70, 1e300 * 1e300, 3.0 }", "", "10000000000000000 100000000000000000000 1180591620717411303424 +inf 3\n"),
    ('BEGIN { printf "[%5d|%-5d|%05d|%+d|%x|%X|%o|%c|%c|%.3s|%8.2f|%e|%g|%%]\\n", 42, 42, 42, 5, 255, 255, 8, 65, "hello", "abcdef", 3.14159, 12345.678, 0.0001 }', "", "[   42|42   |00042|+5|ff|FF|10|A|h|abc|    3.14|1.234568e+04|0.0001|%]\n"),
    ('BEGIN { printf "%*d|%-*d|%.*f\\n", 5, 42, 4, 7, 1, 2.25 }', "", "   42|7   |2.2\n"),
    ('BEGIN { printf "%.2f %.0f %d %i\\n", 1.125, 2.5, -3.9, "12x" }', "", "1.12 2 -3 12\n"),
    ('BEGIN { printf "%a %#o %#x\\n", 1, 8, 255 }', "", "0x1p+0 010 0xff\n"),
    ('BEGIN { print length("\\x41\\102\\0"), "a\\zb", "t\\tq" }', "", "3 a\\zb t\tq\n"),
    ('BEGIN { print substr("hello", 0, 2), substr("hello", 2), substr("hello", 4, 9), substr("hello", 2, -1) "|" }', "", "he ello lo |\n"),
    ('BEGIN { print index("abc", "c"), index("abc", ""), index("", ""), index("abc", "x") }', "", "3 1 0 0\n"),
    ('BEGIN { print match("xaab", /a+/), RSTART, RLENGTH; print match("x", /y/), RSTART, RLENGTH; print match("ab", /a|ab/), RLENGTH }', "", "2 2 2\n0 0 -1\n1 2\n"),
    ('BEGIN { s = "baaac"; print gsub(/a*/, "x", s), s }', "", "3 xbxcx\n"),
    ('BEGIN { s = "a.b"; gsub(".", "-", s); print s; t = "a.b"; gsub(/\\./, "\\\\&", t); print t }', "", "---\na&b\n"),
    ('BEGIN { n = split("a:b::c", p, ":"); print n, p[3] "|", p[4]; print split("", q), length(q), split("abc", r, ""), r[2] }', "", "4 | c\n0 0 3 b\n"),
    ('BEGIN { n = split("a1b22c", p, /[0-9]+/); print n, p[3]; print split(" a  b ", w), split("a|b", v, "|") }', "", "3 c\n2 2\n"),
    ('BEGIN { print strftime("%Y-%m-%d %H:%M:%S", 86400 * 365) }', "", "1971-01-01 00:00:00\n"),
    ("BEGIN { print log(0), sqrt(-1), exp(1000), exp(0), atan2(0, -1) }", "", "1 1 1 1 3.14159\n"),
    ("BEGIN { print srand(5), srand(), (rand() < 1) }", "", "0 5 1\n"),
    ('BEGIN { RS = "" } { print NR ":" $1 "," $NF ":" NF }', "\n\na b\nc\n\n\n\nd\n", "1:a,c:3\n2:d,d:1\n"),
    ('BEGIN { RS = "" ; FS = ":" } { print NF, $3 }', "a:b\nc:d\n", "4 c\n"),
    ('BEGIN { RS = "X+" } { print NR ":" $0 ":" RT }', "aXbXXc", "1:a:X\n2:b:XX\n3:c:\n"),
    ('BEGIN { RS = "--" } { print }', "p--q--r", "p\nq\nr\n"),
    ('NR == 1 { RS = ":" } { print NR "=" $0 }', "a\nb:c", "1=a\n2=b\n3=c\n"),
    ("NR == 2 { nextfile } { print } ENDFILE { print \"EF\" } END { print NR }", "a\nb\nc\n", "a\nEF\n2\n"),
    ("BEGINFILE { print \"BF\" } { print FNR } END { print \"done\" }", "a\nb\n", "BF\n1\n2\ndone\n"),
    ("{ print } NR == 2 { exit 3 } END { print \"e\" }", "a\nb\nc\n", "a\nb\ne\n"),
    ("NR % 2 { getline nxt; print $0 \"+\" nxt }", "a\nb\nc\nd\n", "a+b\nc+d\n"),
    ("{ getline; print NR, $0 }", "a\nb\nc\nd\n", "2 b\n4 d\n"),
    ('BEGIN { a[1, 2] = 3; for (k in a) { split(k, p, SUBSEP); print p[1], p[2] } print ((1, 2) in a), ((2, 1) in a) }', "", "1 2\n1 0\n"),
    ("BEGIN { x[1]; print length(x), (1 in x), (2 in x); if (x[3] == 0) n = length(x); print n }", "", "1 1 0\n2\n"),
    ("BEGIN { i = 5; a[i++] = i; print a[5], i, i--, --i }", "", "6 6 6 4\n"),
    ("{ $2 += 5; print $2, $0; $1++; print }", "1 2\n", "7 1 7\n2 7\n"),
    ("BEGIN { print 1 == 1.0, \"a\" < \"b\", 10 < 9, \"10\" < \"9\", 2 < 10 }", "", "1 1 0 1 1\n"),
    ("{ print ($1 == $2), ($1 < $2) }", "1.0 1\nabc abd\n10 9\n1e2 100\n", "1 0\n0 1\n0 0\n1 0\n"),
    ("{ print ($9 == 0), ($9 == \"\"), length($9) }", "a\n", "0 1 0\n"),
    ('BEGIN { if (!("x" in ENVIRON)) print "none"; print u + 0, u "", length(u) }', "", "none\n0  0\n"),
    ('{ print > "/dev/stdout" }', "a\n", "a\n"),
    ("{ print; print \"x\" \\\n  \"y\" } # comment\n", "a\n", "a\nxy\n"),
    ("BEGIN { if (1) ; else print \"no\"; if (0) print \"a\"\nelse print \"b\" }", "", "b\n"),
    ("BEGIN { print length() } { print length, length($1) }", "ab c\n", "0\n4 2\n"),
    ('BEGIN { print "aBc" ~ /b/, "aBc" ~ "B", "a.c" ~ /a\\.c/, "x" ~ /[[:digit:]]/, "7" ~ /[[:digit:]]/, "]" ~ /[]]/, "b" ~ /[^a]/ }', "", "0 1 1 0 1 1 1\n"),
    ('BEGIN { print "aaa" ~ /^a{2,3}$/, "a{" ~ /a{/, "ab" ~ /(a|b){2}/, "a\\nb" ~ /a.b/, "x)" ~ /)/ }', "", "1 1 1 1 1\n"),
    ("END { print NR, $0 }", "a\nb\n", "2 b\n"),
    ("BEGIN { getline; print \"got \" $0 } { print \"rest \" $0 }", "a\nb\n", "got a\nrest b\n"),
]


@pytest.mark.parametrize("program,text,want", CASES)
def test_evaluator(program, text, want):
    out = []
    Program(program, safe=False).run_local([("", text)], out.append)
    assert "".join(out) == want


@pytest.mark.parametrize("program,why", [
    ("BEGIN { x = 5 / 0 }", "division by zero"), ("BEGIN { x = 5 % 0 }", "division by zero"), ("BEGIN { x = nope(4) }", "unknown function"), ("{ print $(-1) }", "field number"),
    ("BEGIN { next }", "next"), ("BEGIN { break }", "outside a loop"), ("BEGIN { return 1 }", "return"), ("function f(a, a) { }", "twice"), ("function f() { } function f() { }", "twice"),
    ("BEGIN { print substr(1) }", "substr"), ("BEGIN { x = 1; x[1] = 2 }", "scalar"), ("BEGIN { x[1] = 2; y = x + 1 }", "array"), ("/(/", "parenthesis"), ("/a{300}/", "range"), ("/$^/", "side by side"), ("BEGIN { print \"a }", "closed"),
    ("BEGIN { lshift(1, 64) }", "shift"), ("BEGIN { printf \"%d\" }", "not enough"), ("BEGIN { 1 }", "constant"), ("function add(x) { return x } BEGIN { print add(5), add (5) }", "cannot read function"),
])
def test_errors(program, why):
    with pytest.raises(ProgramError, match=why):
        Program(program, safe=False).run_local([("", "a b\n")], lambda s: None)


@pytest.mark.parametrize("program", ['BEGIN { system("true") }', 'BEGIN { print 1 > "x" }', 'BEGIN { "date" | getline }', 'BEGIN { print 1 | "cat" }'])
def test_safe_mode(program):
    with pytest.raises(ProgramError, match="safe mode"):
        Program(program)


def test_shell_and_files(tmp_path):
    out = []
    f = tmp_path / "f.txt"
    program = f'''BEGIN {{
      x = system("exit 7"); print x
      print "first" > "{f}"; print "second" > "{f}"; close("{f}")
      print "third" >> "{f}"; close("{f}")
      while ((getline line < "{f}") > 0) print "L:" line
      print (getline line < "{tmp_path}/none"), close("never")
      "echo a b c" | getline; print NF, $2
      print "z" | "cat"; print "y" | "cat"; print close("cat")
      fflush(); print fflush("never") }}'''
    Program(program, safe=False).run_local([], out.append)
    assert "".join(out) == "7\nL:first\nL:second\nL:third\n-1 -1\n3 b\nz\ny\n0\n-1\n"


def test_assignments_between_files():
    out = []
    Program("{ print x, $0, FILENAME, FNR, NR }").run_local([("a", "1\n"), ("=", "x", "7"), ("b", "2\n")], out.append)
    assert "".join(out) == " 1 a 1 1\n7 2 b 1 2\n"


def test_csv_records():
    out = []
    Program('{ print NF; for (i = 1; i <= NF; i++) print "[" $i "]" }', csv=True).run_local([("", 'a,"b,c",d\n"x""y","line\nbreak"\n"open')], out.append)
    assert "".join(out) == "3\n[a]\n[b,c]\n[d]\n2\n[x\"y]\n[line\nbreak]\n1\n[open]\n"


def test_exit_code():
    assert Program("{ exit 3 }").run_local([("", "a\n")], lambda s: None) == 3
