"""Text as relations of records: columns __file, __pos (order), value and, if asked for,
rt (the terminator).

Newline and other literal separators are cut by Spark's own line reader, so files are
split over tasks. So are they for paragraphs and CSV, whose records are runs of lines: where
one begins follows from the lines before it, as running state. Separators that are regular
expressions, terminators and other encodings need whole files.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordflow.operators.ordered import Running, with_running
from recordflow.runtime.ere import compile_ere


def read_text(spark: SparkSession, paths: list[str] | str, rs: str = "\n", csv: bool = False, rt: bool = False, encoding: str | None = None) -> DataFrame:
    """Records of the files, in the order of paths. __src numbers the operands."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = []
    for i, path in enumerate(paths):
        if rt or encoding is not None or not csv and len(rs) > 1 and compile_ere(rs).literal is None:
            df = whole_records(spark, path, rs, csv, encoding)
        else:
            df = records_of_lines(spark, path, csv) if csv or rs == "" else line_records(spark, path, rs)
        parts.append(df.select(F.lit(i).alias("__src"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if rt else out.drop("rt")


def line_records(spark: SparkSession, path: str, rs: str) -> DataFrame:
    """Records cut at a literal separator. The order within a file is that of its blocks
    and of the rows in a block."""
    df = spark.read.option("lineSep", rs).text(path)
    block = F.col("_metadata.file_block_start")
    # the low half of the id counts rows of a partition, which holds its blocks in order
    place = F.monotonically_increasing_id()
    return df.select(F.col("_metadata.file_path").alias("__file"), block.alias("__block"), place.alias("__pos"), "value", F.lit(rs).alias("rt")).drop("__block")


def records_of_lines(spark: SparkSession, path: str, csv: bool) -> DataFrame:
    """CSV records, or paragraphs, of files that are read by lines. A CSV record ends where
    the quotes since its begin are even; one whose quote is never closed runs to the last
    line. A paragraph begins at a line that follows an empty one, or none."""
    lines, file = line_records(spark, path, "\n").select("__file", "__pos", "value"), [F.col("__file")]
    if csv:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
        lines = with_running(lines, ["__pos"], file, [Running("__quotes", "sum", quotes)])
        begins = F.coalesce("__quotes", F.lit(0)) % 2 == 0
    else:
        lines = with_running(lines, ["__pos"], file, [Running("__last", "last", F.col("value"))]).filter("value <> ''")
        begins = F.coalesce("__last", F.lit("")) == ""
    # records are numbered by the begins before a line and its own
    lines = with_running(lines.withColumn("__begins", begins.cast("int")), ["__pos"], file, [Running("__n", "sum", F.col("__begins"))])
    lines = lines.withColumn("__n", F.coalesce("__n", F.lit(0)) + F.col("__begins"))
    out = lines.groupBy("__file", "__n").agg(F.min("__pos").alias("__pos"), F.array_sort(F.collect_list(F.struct("__pos", "value"))).alias("__lines"))
    text = F.array_join(F.transform("__lines", lambda x: x["value"]), "\n")
    if csv:
        text = F.regexp_replace(F.when(F.contains(text, F.lit('"')), F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text), r"\r\z", "")
    return out.select("__file", "__pos", text.alias("value"), F.lit(None).cast("string").alias("rt"))


def whole_records(spark: SparkSession, path: str, rs: str, csv: bool, encoding: str | None) -> DataFrame:
    """Records of whole files, cut in Arrow batches by the sequential reader."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    charset = encoding or "utf-8"

    def run(batches):
        from recordflow.runtime.records import TextReader

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader, rows = TextReader(content.decode(charset, errors="replace")), []
                while (r := reader.next(rs, csv)) is not None:
                    rows.append(r)
                    if len(rows) == 50_000:
                        yield batch(name, rows, 0)
                        rows = []
                yield batch(name, rows, 0)

    count = {"n": 0}

    def batch(name, rows, _):
        first = count["n"]
        count["n"] += len(rows)
        return pa.record_batch([pa.array([name] * len(rows), pa.string()), pa.array(range(first, first + len(rows)), pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["__file", "__pos", "value", "rt"])

    return files.mapInArrow(run, "__file string, __pos long, value string, rt string")


def from_strings(spark: SparkSession, texts: list[str], name: str = "") -> DataFrame:
    """Records given as strings."""
    return spark.createDataFrame([(name, i, t, "\n") for i, t in enumerate(texts)], "__file string, __pos long, value string, rt string")


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text column, natively: what stands between runs of empty
    lines."""
    body = F.regexp_replace(F.regexp_replace(text, r"\A\n+", ""), r"\n+\z", "")
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n\n+", -1))


def cut_records(df: DataFrame, text: str, rs: str = "\n", keep: tuple[str, ...] = (), rt: bool = False) -> DataFrame:
    """Records of the texts in a column, natively where the separator allows: keep, __pos
    (place in its text), value and, if asked for, rt (what ended the record; empty after the
    last one). A text that ends with a separator has no record after it."""
    from recordflow.functions.strings import split_fields

    c = F.coalesce(F.col(text), F.lit(""))
    if rs == "":
        parts = paragraphs(c)
    else:
        parts = split_fields(c, rs, len(rs) > 1)
        parts = F.split(c, " ", -1) if rs == " " else parts
        parts = F.when(F.try_element_at(parts, F.lit(-1)) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
        parts = F.when(c == "", F.array().cast("array<string>")).otherwise(parts)
    if not rt:
        return df.select(*keep, F.posexplode(parts).alias("__pos", "value"))
    ends = F.regexp_extract_all(F.regexp_replace(c, r"\A\n+", "") if rs == "" else c, F.lit(terminator(rs)), F.lit(0))
    out = df.select(*keep, ends.alias("__ends"), F.posexplode(parts).alias("__pos", "value"))
    return out.select(*keep, "__pos", "value", F.coalesce(F.get("__ends", F.col("__pos")), F.lit("")).alias("rt"))


def terminator(rs: str) -> str:
    """A separator as a pattern of Spark's."""
    if rs == "":
        return "\n\n+"
    if len(rs) == 1:
        return f"\\x{{{ord(rs):x}}}"
    ere = compile_ere(rs)
    if not ere.exact or ere.nullable:
        raise ValueError(f"the ends of records by {rs!r} need whole_records")
    return ere.java
