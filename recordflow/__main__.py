"""python -m recordflow [-F fs] [--csv] [-v name=value] [-f file] [-s] [--local] 'program' [file | name=value ...]"""

from __future__ import annotations

import sys
from pathlib import Path

from recordflow.api import Program
from recordflow.lang.nodes import ProgramError

VERSION = "recordflow 0.1"


def arguments(argv: list[str]) -> dict:
    o: dict = {"fs": None, "csv": False, "vars": [], "files": [], "safe": False, "local": False, "rest": []}
    at = 0
    while at < len(argv):
        a = argv[at]
        if a == "--":
            at += 1
            break
        if not a.startswith("-") or a == "-":
            break
        at += 1
        if a == "--csv":
            o["csv"] = True
        elif a in ("-s", "-safe", "--safe"):
            o["safe"] = True
        elif a == "--local":
            o["local"] = True
        elif a in ("--version", "-version", "-V"):
            o["version"] = True
        elif a == "-d":
            pass
        elif a[:2] in ("-F", "-v", "-f"):
            value = a[2:]
            if not value:
                if at >= len(argv):
                    raise ProgramError(f"{a} needs a value")
                value = argv[at]
                at += 1
            if a[:2] == "-F":
                o["fs"] = value
            elif a[:2] == "-f":
                o["files"].append(value)
            else:
                name, eq, text = value.partition("=")
                if not eq:
                    raise ProgramError(f"-v needs name=value, not {value!r}")
                o["vars"].append((name, unescaped(text)))
        else:
            print(f"recordflow: unknown option {a} ignored", file=sys.stderr)
    o["rest"] = argv[at:]
    return o


def unescaped(text: str) -> str:
    from recordflow.lang.lexer import unescape

    return unescape(text)


def inputs(operands: list[str]):
    """What the evaluator reads: files as (name, text), assignments as they come."""
    import re

    read = False
    for a in operands:
        m = re.fullmatch(r"([A-Za-z_]\w*)=(.*)", a, re.S)
        if m:
            yield "=", m[1], unescaped(m[2])
        elif a == "-":
            read = True
            yield "-", sys.stdin.read()
        elif a:
            read = True
            try:
                yield a, Path(a).read_text(errors="replace")
            except OSError as e:
                raise ProgramError(f"can't open file {a}") from e
    if not read:
        yield "", sys.stdin.read()


def main(argv: list[str]) -> int:
    try:
        o = arguments(argv)
        if o.get("version"):
            print(VERSION)
            return 0
        if o["files"]:
            text = "\n".join(sys.stdin.read() if f == "-" else Path(f).read_text() for f in o["files"])
        elif o["rest"]:
            text = o["rest"].pop(0)
        else:
            print(__doc__, file=sys.stderr)
            return 2
        p = Program(text, fs=o["fs"], csv=o["csv"], variables=o["vars"], safe=o["safe"])
        plain = [a for a in o["rest"] if "=" not in a and a != "-"]
        if o["local"] or not plain or len(plain) != len(o["rest"]):
            return p.run_local(inputs(o["rest"]), sys.stdout.write, o["rest"])
        from pyspark.sql import SparkSession

        from recordflow.sources.records import read_text

        spark = SparkSession.builder.appName("recordflow").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        records = read_text(spark, plain, csv=o["csv"])
        for line in p.lines(records):
            print(line)
        return 0
    except ProgramError as e:
        print(f"recordflow: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
