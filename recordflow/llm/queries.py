"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import public_tokenizers

from recordflow.llm import bpe, counts, licenses, minhash, packing, repeats, toxicity, urls, vectors
from recordflow.llm.shared import table


def op1_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark, sf_dir):
    return counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_suffix_array(spark, sf_dir):
    return repeats.digests(table(spark, sf_dir, "documents"))


def op6_learned_partitions(spark, sf_dir):
    return vectors.nearest(table(spark, sf_dir, "embeddings"))


def op7_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_max_score(spark, sf_dir):
    return vectors.quantized_top_k(table(spark, sf_dir, "embeddings"))


def op9_url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_byte_bpe(spark, sf_dir):
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_packing, op3_toxicity, op4_token_counts, op5_suffix_array, op6_learned_partitions, op7_minhash, op8_max_score, op9_url_filter, op10_byte_bpe)}
ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": licenses.sql(),
    "op8_max_score": vectors.TOP_K_SQL,
    "op9_url_filter": urls.sql(),
}
