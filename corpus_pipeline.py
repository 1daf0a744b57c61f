"""A corpus pipeline: toxic documents go, one of each group of near duplicates stays,
repeated passages go, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents. Tokenizing, scores and suffix arrays have no SQL, so there is none for the
whole; tests hold every stage against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordflow.llm import minhash, packing, repeats, toxicity
from recordflow.llm.shared import scratch, settle, table


def _unused(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has, whatever its case."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5. Learned from the labelled among docs."""
    name = _unused(docs, "toxicity")
    return toxicity.with_score(docs, table(spark, sf_dir, "labels"), name).filter(F.col(name) < 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group; of rows with one id and text, one."""
    name = _unused(docs, "row_key")
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), F.col("text").isNull().cast("string"), F.lit(" "), F.coalesce("text", F.lit("")))
    keyed = docs.withColumn(name, F.unhex(F.md5(whole.cast("binary"))))
    kept = minhash.near_duplicates(keyed, carried=(name,)).filter("kept").select(name).distinct()
    return keyed.join(kept, name, "left_semi").dropDuplicates([name]).select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document of a smaller id has too;
    ``n_chars`` is counted anew."""
    out = repeats.strip(docs, spans=_unused(docs, "spans"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("repeats", drop_repeats), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables between stages, and those that a stage has made for itself, are removed when
    the next one's result is written."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as kept:
        for _, stage in STAGES[:-1]:
            with scratch(spark) as still_read:
                docs = settle(stage(spark, docs, sf_dir))
                still_read.append(docs)
        kept.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
