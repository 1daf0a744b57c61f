"""License scans: an exact set-similarity join between text blocks and license templates.

A block is a run of ``2 * span`` words that starts at a multiple of ``span``, where span
is the number of words of the longest template; so every place of at most span words lies
whole in a block. A block matches a template if it holds at least ``threshold`` of the
template's distinct tokens. The join is exact: tokens are ordered by how many documents
hold them, rarest first, and

* prefix filter: a match shares one of a template's first |T| - c + 1 tokens in that
  order (c: the least overlap), so blocks meet templates only through these;
* length filter: the block has at least c distinct tokens;
* positional filter: what a block and a template have from the shared token on is at
  least c.

Everything is DataFrame functions. The template index is a literal of the plan: its size
is that of the template list, a parameter, whatever the corpus holds.

Cases: null text counts as empty (no words, score 0); rows with the same id and text have
the same result, each; an empty table gives an empty result; texts are read whole; other
columns, also of clashing names, are dropped at the start.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.llm.shared import settle

# The word pattern, the base phrases and their labels, license notices.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.9


def words_of(text: Column) -> Column:
    """Words of a text after A-Z are lower-cased: what stands between runs of other
    characters. lower() does the same as a map of A-Z would, as words with a letter
    beyond ASCII equal no word of a phrase or template; but two such letters have an
    ASCII letter as their lower case, so texts with these are mapped."""
    t = F.coalesce(text, F.lit(""))
    mapped = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    low = F.when(F.contains(t, F.lit("\u212a")) | F.contains(t, F.lit("\u0130")), mapped).otherwise(F.lower(t))
    return F.array_remove(F.split(low, BETWEEN, -1), "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many rows hold each token of a vocabulary of bounded size; over all rows, with
    partial sums, so at most one row for each token and task is shuffled."""
    held = docs.select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("token"))
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def template_index(templates, counts: dict[str, int], threshold: float) -> list[dict]:
    """Of each template: tokens, rarest first, the least overlap c, and the prefix."""
    out = []
    for i, (label, text) in enumerate(templates):
        tokens = sorted(set(text.split()), key=lambda t: (counts.get(t, 0), t))
        least = math.ceil(threshold * len(tokens) - 1e-9)
        out.append({"id": i, "label": label, "tokens": tokens, "least": least, "prefix": tokens[: len(tokens) - least + 1]})
    return out


def containment_join(blocks: DataFrame, index: list[dict]) -> DataFrame:
    """blocks (any columns, and ``block``: an array of words) with each template whose
    containment reaches the threshold: template, label, overlap, containment."""
    vocabulary = sorted({t for x in index for t in x["tokens"]})
    prefixes = sorted({t for x in index for t in x["prefix"]})
    spark = blocks.sparkSession
    rows = [(t, x["id"], x["label"], x["tokens"], x["least"]) for x in index for t in x["prefix"]]
    by_token = F.broadcast(spark.createDataFrame(rows, "shared string, template int, label string, tokens array<string>, least int"))
    held = blocks.withColumn("held", F.array_intersect("block", _strings(vocabulary))).withColumn("shared", F.explode(F.array_intersect("held", _strings(prefixes))))
    met = held.join(by_token, "shared").filter(F.size("held") >= F.col("least"))
    common = F.array_intersect("tokens", "held")  # in the order of the template's tokens
    at = F.array_position("tokens", F.col("shared"))
    rest = F.size(F.array_intersect(F.slice("tokens", at, F.size("tokens")), F.col("held")))
    met = met.filter(rest >= F.col("least")).withColumn("common", common)
    # a pair that shares several prefix tokens is kept with the first only
    met = met.filter((F.size("common") >= F.col("least")) & (F.element_at("common", 1) == F.col("shared")))
    return met.withColumn("overlap", F.size("common")).withColumn("containment", F.size("common") / F.size("tokens")).drop("held", "shared", "tokens", "least", "common")


def license_blocks(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """key, first_word, n_words, label, template, overlap, containment: every block of
    ``docs`` (key, words) that meets a template."""
    span = max(len(t.split()) for _, t in templates)
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    index = template_index(templates, document_frequencies(docs, vocabulary), threshold)
    prefixes = sorted({t for x in index for t in x["prefix"]})
    held = docs.filter(F.arrays_overlap("words", _strings(prefixes)))
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(span)))
    blocks = held.select("key", "words", starts.alias("first_word")).select("key", "first_word", F.slice("words", F.col("first_word") + 1, 2 * span).alias("block"))
    blocks = blocks.filter(F.arrays_overlap("block", _strings(prefixes)))
    found = containment_join(blocks, index)
    return found.select("key", "first_word", F.size("block").alias("n_words"), "label", "template", "overlap", "containment")


def _phrase(norm: Column, phrase: str) -> Column:
    """Struct n, first, last: how often a phrase stands in a text of words between single
    spaces, and the first and last word where it starts; null without one."""
    length = len(phrase.split())
    parts = F.split(norm, f"(?<= ){phrase}(?= )", -1)
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" ")))
    n = F.size(parts) - 1
    first = spaces(F.element_at(parts, 1)) - 1
    last = spaces(norm) - 1 - (spaces(F.element_at(parts, -1)) - 1) - length
    return F.when(F.contains(norm, F.lit(f" {phrase} ")), F.struct(n.cast("long").alias("n"), first.cast("long").alias("first"), last.cast("long").alias("last")))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. The
    score is 1 where a base phrase stands, else the best containment of a matched block,
    else 0."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    d = d.select("doc_id", F.struct("doc_id", F.length("text").alias("size"), F.xxhash64("text").alias("hash")).alias("key"), words_of(F.col("text")).alias("words"))
    found = settle(license_blocks(d.select("key", "words"), templates, threshold).groupBy("key").agg(F.collect_set("label").alias("method_labels"), F.max("containment").alias("best")))
    any_word = F.arrays_overlap("words", _strings([p.split()[-2] for p, _ in BASE]))
    norm = F.when(any_word, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).otherwise(F.lit(" "))
    d = d.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), norm.alias("norm"))
    names = [f"p{i}" for i in range(len(BASE))]
    d = d.select("doc_id", "key", "n_words", *[_phrase(F.col("norm"), p).alias(n) for n, (p, _) in zip(names, BASE, strict=True)])
    n_base = sum((F.coalesce(F.col(f"{n}.n"), F.lit(0).cast("long")) for n in names), F.lit(0).cast("long"))
    labels = F.filter(F.array(*[F.when(F.col(n).isNotNull(), F.lit(x)) for n, (_, x) in zip(names, BASE, strict=True)]), lambda x: x.isNotNull())
    d = d.select("doc_id", "key", "n_words", n_base.alias("n_base"), F.least(*[F.col(f"{n}.first") for n in names]).alias("first_word"), F.greatest(*[F.col(f"{n}.last") for n in names]).alias("last_word"), labels.alias("base"))
    d = d.join(found, "key", "left")
    every = F.array_sort(F.array_union("base", F.coalesce("method_labels", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same over DuckDB's documents, without any filter: all blocks by all templates."""
    span = max(len(t.split()) for _, t in templates)
    listed = ", ".join(f"('{label}', [{', '.join(repr(w) for w in sorted(set(t.split())))}], {math.ceil(threshold * len(set(t.split())) - 1e-9)})" for label, t in templates)
    phrases = ", ".join(f"('{x}', [{', '.join(repr(w) for w in p.split())}])" for p, x in BASE)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
p(label, ws) AS (VALUES {phrases}),
places AS (SELECT r, label, i FROM d CROSS JOIN p CROSS JOIN LATERAL (SELECT unnest(range(0, len(w) - len(ws) + 1)) AS i) AS s WHERE w[i + 1 : i + len(ws)] = ws),
base AS (SELECT r, count(*) AS n, min(i) AS f, max(i) AS l, list(DISTINCT label) AS ls FROM places GROUP BY r),
b AS (SELECT r, w[s + 1 : s + {2 * span}] AS ws FROM (SELECT r, w, unnest(range(0, greatest(len(w), 1), {span})) AS s FROM d)),
t(label, ws, least) AS (VALUES {listed}),
m AS (SELECT r, t.label, len(list_intersect(b.ws, t.ws)) AS k, len(t.ws) AS n, least FROM b CROSS JOIN t),
found AS (SELECT r, list(DISTINCT label) AS ls, max(k / n) AS best FROM m WHERE k >= least GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.f::BIGINT AS first_word, base.l::BIGINT AS last_word,
coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(found.ls, [])))), ','), '') AS labels,
CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(found.best, 0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN found USING (r)
"""
