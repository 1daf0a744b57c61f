"""Sources, sinks, streams and the command line."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from recordflow.api import Program
from recordflow.operators import idioms
from recordflow.sources import records, sinks
from recordflow.streaming.runner import stateful, stream

REPO = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("rs,text,want", [
    ("\n", "a b\nc\n", ["a b", "c"]), ("|", "A|B|C", ["A", "B", "C"]), ("--", "p--q--r", ["p", "q", "r"]), ("X+", "aXbXXXcX", ["a", "b", "c"]), ("", "\n\na b\nc\n\n\nd\n", ["a b\nc", "d"]),
])
def test_read_text(spark, tmp_path, rs, text, want):
    (tmp_path / "f.txt").write_text(text)
    df = records.read_text(spark, str(tmp_path / "f.txt"), rs=rs)
    assert [r["value"] for r in df.orderBy("__pos").collect()] == want


def test_read_order_and_terminators(spark, tmp_path):
    for name, text in (("y", "3\n4\n"), ("x", "1\n2")):
        (tmp_path / name).write_text(text)
    df = records.read_text(spark, [str(tmp_path / "y"), str(tmp_path / "x")])
    assert Program("{ s = s $1 } END { print s, NR }").lines(df) == ["3412 4"]
    df = records.read_text(spark, str(tmp_path / "x"), rt=True)
    assert [r["rt"] for r in df.orderBy("__pos").collect()] == ["\n", ""]


def test_csv_files(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a,"b,c",d\n"x""y","two\nlines"\n')
    df = records.read_text(spark, str(tmp_path / "f.csv"), csv=True)
    assert Program("{ print NF, $2 }", csv=True).lines(df) == ["3 b,c", "2 two\nlines"]


@pytest.mark.parametrize("csv", [True, False])
def test_records_of_lines_are_those_of_whole_files(spark, tmp_path, csv):
    import random

    r = random.Random(5)
    for name in ("a", "b", "c"):
        lines = []
        for _ in range(60):
            lines.append(r.choice(['x,"y', 'z"', '"a ""q"" b",c\r', "plain,1\r", "", "", 'w "odd"', '"k",2']) if csv else r.choice(["a b", "", "", "c", "\td"]))
        if sum(x.count('"') for x in lines) % 2:
            lines.append('"')
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    (tmp_path / "d").write_text("")
    whole = records.whole_records(spark, str(tmp_path), "" if not csv else "\n", csv, None).collect()
    lined = records.records_of_lines(spark, str(tmp_path), csv).orderBy("__file", "__pos").collect()
    for name in ("a", "b", "c"):
        want = [x["value"] for x in sorted(whole, key=lambda x: x["__pos"]) if x["__file"].endswith("/" + name)]
        assert [x["value"] for x in lined if x["__file"].endswith("/" + name)] == want and want


def test_bytes(spark, tmp_path):
    (tmp_path / "b").write_bytes(b"\xff\xe9z\n")
    df = records.read_text(spark, str(tmp_path / "b"), encoding="iso-8859-1")
    assert Program("{ print length($0) }").lines(df) == ["3"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "2"), ("a", "10"), ("a", "9")], "target string, value string")
    sinks.write_lines(df.select("value"), str(tmp_path / "o"))
    sinks.write_lines(df.select("value"), str(tmp_path / "o"), append=True)
    assert spark.read.text(str(tmp_path / "o")).count() == 6
    sinks.write_targets(df, str(tmp_path / "t"))
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == ["target=a", "target=b"]
    assert [r[0] for r in sinks.sort_pipe(df.select("value"), "-n").collect()] == ["2", "9", "10"]
    assert [r[0] for r in sinks.sort_pipe(df.select("value"), "-r").collect()] == ["9", "2", "10"]
    assert sinks.pipe(df.select("value").orderBy("value"), "tail -n 1") == "9\n"


def test_idioms(spark):
    df = spark.range(20).select("id", (F.col("id") % 3).alias("k"), (F.col("id") / 4).cast("int").alias("g"))
    assert [r["nr"] for r in idioms.numbered(df, ["id"]).orderBy("id").collect()] == list(range(1, 21))
    assert [r["island"] for r in idioms.islands(df, ["id"], "g").orderBy("id").collect()] == [i // 4 + 1 for i in range(20)]
    assert sorted((r["k"], r["id"]) for r in idioms.last_per_key(df.select("k", "id", "g"), ["k"], ["id"]).collect()) == [(0, 18), (1, 19), (2, 17)]
    assert sorted((r["k"], r["id"]) for r in idioms.distinct_in_order(df.select("k", "id", "g"), ["k"], ["id"]).collect()) == [(0, 0), (1, 1), (2, 2)]
    assert [r["id"] for r in idioms.tail(df, ["id"], 2).collect()] == [19, 18]
    got = [r["m"] for r in idioms.moving_average(df, ["id"], "id", 3, "m").orderBy("id").collect()]
    assert got == [sum(range(max(0, i - 2), i + 1)) / min(3, i + 1) for i in range(20)]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.txt").write_text("a 1\nb 5\n")
    (src / "2.txt").write_text("a 7\n")
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(src))

    def drained(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(tuple, spark.sql(f"select * from {name}").collect()))

    assert drained(stream(Program("$2 > 3 { print $1, $2 * 2 }"), lines, ["k", "v"]), "append", "s1") == [("a", 14.0), ("b", 10.0)]
    assert drained(stream(Program("{ s[$1] += $2 } END { for (k in s) print k, s[k] }"), lines, ["k", "s"]), "complete", "s2") == [("a", 8.0), ("b", 5.0)]
    keyed = lines.select(F.split("value", " ")[0].alias("k"), F.split("value", " ")[1].cast("double").alias("v"))
    assert drained(stateful(Program("{ t[$1] += $2; if (t[$1] > 6) print $1, t[$1] }"), keyed, ["k"]), "append", "s3") == [("a 8",)]


def run(*args, text=""):
    p = subprocess.run([sys.executable, "-m", "recordflow", *args], cwd=REPO, input=text, capture_output=True, text=True, timeout=120, check=False)
    return p.returncode, p.stdout, p.stderr


def test_command_line(tmp_path):
    assert run("{ print $2, x }", "x=5", text="a b\n")[:2] == (0, "b 5\n")
    assert run("-F", ":", "-v", "n=4", "{ print $2 + n }", text="1:2\n")[:2] == (0, "6\n")
    assert run("-Ft", "{ print $2 }", text="a b\tc\n")[:2] == (0, "c\n")
    (tmp_path / "p").write_text("function f(x) { return x * 2 }")
    (tmp_path / "q").write_text("{ print f($1) }")
    assert run("-f", str(tmp_path / "p"), "-f", str(tmp_path / "q"), text="4\n")[:2] == (0, "8\n")
    assert run("--csv", "{ print $2 }", text='a,"b,c"\n')[:2] == (0, "b,c\n")
    code, _, err = run("-s", 'BEGIN { system("true") }')
    assert code == 2 and "safe mode" in err
    assert run("BEGIN { exit 3 }")[0] == 3
    assert run("BEGIN { x = }")[0] == 2
    assert run("--version")[0] == 0
    code, _, err = run("{ print }", str(tmp_path / "none"), "x=1")
    assert code == 2 and "can't open" in err


def test_entry_without_llm():
    code = "import sys; sys.modules['recordflow.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=60)
