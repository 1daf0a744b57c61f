"""Where lines go."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """Lines as text files; their column is the last one."""
    df.select(F.col(df.columns[-1]).cast("string").alias("value")).write.mode("append" if append else "overwrite").text(path)


def write_targets(df: DataFrame, base: str, append: bool = False) -> None:
    """Tagged lines (target, value): one folder a target."""
    df.select("target", "value").write.mode("append" if append else "overwrite").partitionBy("target").text(base)


def pipe(df: DataFrame, command: str) -> str:
    """Lines through a command on the driver, streamed; its output."""
    p = subprocess.Popen(["sh", "-c", command], stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True)
    for row in df.toLocalIterator():
        p.stdin.write(f"{row[0]}\n")
    out, _ = p.communicate()
    return out


def sort_pipe(df: DataFrame, flags: str, column: str = "value") -> DataFrame:
    """Lines in the order that ``sort`` with simple flags (-n -r -u, -k and -t) gives, as
    a distributed sort."""
    words = flags.split()
    numeric = any(w.startswith("-") and "n" in w and not w.startswith(("-k", "-t")) for w in words)
    reverse = any(w.startswith("-") and "r" in w and not w.startswith(("-k", "-t")) for w in words)
    unique = any(w.startswith("-") and "u" in w and not w.startswith(("-k", "-t")) for w in words)
    sep = next((w[2:] for w in words if w.startswith("-t")), None)
    key = next((w[2:] or words[i + 1] for i, w in enumerate(words) if w.startswith("-k")), None)
    c = F.col(column)
    if key:
        n = int("".join(ch for ch in key.split(",")[0] if ch.isdigit()))
        numeric = numeric or "n" in key
        reverse = reverse or "r" in key
        c = F.coalesce(F.get(F.split(c, F.lit(f"\\Q{sep}\\E") if sep else F.lit(r"\s+")), F.lit(n - 1)), F.lit(""))
    if numeric:
        from recordflow.functions.numbers import number_of_text

        c = number_of_text(c)
    if unique:
        df = df.dropDuplicates([column])
    order = [c.desc(), F.col(column).desc()] if reverse else [c.asc(), F.col(column).asc()]
    return df.orderBy(*order)
