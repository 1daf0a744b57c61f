"""Packing, token counts and byte-level BPE against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from recordflow.llm import bpe, counts, packing
from recordflow.llm.queries import QUERIES

MULTI, WORD, FIFTY = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
ODD = ["", None, " ", "\n\n  x", "a" * 3000, "the " * 2000, "don't  stop\t now", "naïve café — 東京 🙂🙂", "\x1cfoo\x85bar\xa0baz", "x\r\n\r\ny  ", "<|endoftext|> a", "123456 7.8,9", "thth" * 200, " " * 500 + "z", "Ünïcode space"]


def encoding(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge_replay_equals_library():
    e, b, r = encoding(MULTI), bpe.replay(MULTI, P.PATTERN), random.Random(3)
    alphabet = " \n\tabcthein1,.'s中é\x1c\x85🙂"
    texts = [t for t in ODD if t] + ["".join(r.choices(alphabet, k=r.randint(1, 60))) for _ in range(1500)]
    for t, ids in zip(texts, b.words(texts), strict=True):
        assert ids.tolist() == e.encode_ordinary(t)
        assert b.decode(ids.tolist()) == t.encode()
        assert [i for c in bpe.COARSE.findall(t) for i in e.encode_ordinary(c)] == e.encode_ordinary(t)


def test_other_split_patterns_are_refused():
    with pytest.raises(ValueError, match="PATTERN"):
        bpe.replay(MULTI, r"\w+|\W+")


def test_digests(table, spark):
    e = encoding(MULTI)
    got = {r["doc_id"]: r for r in bpe.encode_digests(table(enumerate(ODD)), MULTI, P.PATTERN, keep=5).collect()}
    for i, t in enumerate(ODD):
        ids = e.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    whole = bpe.encode(table([(1, "the end"), (1, "the end"), (None, None)]), MULTI, P.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"])) for r in whole) == [(0, b""), (1, b"the end"), (1, b"the end")]
    assert bpe.encode_digests(table([]), MULTI, P.PATTERN).count() == 0


def test_query_bpe(spark, sf):
    e = encoding(MULTI)
    docs = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    rows = QUERIES["op10_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = e.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def held(rows, texts, width):
    """Pieces cover every id once; sequences are gapless and within the width."""
    t = Tokenizer.from_file(WORD)
    want = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x in texts.items()}
    of, sequences = {i: 0 for i in texts}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        w = want[r["doc_id"]]
        assert r["start"] == of[r["doc_id"]] and r["doc_tokens"] == len(w) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(w[r["start"] : r["start"] + r["length"]].tobytes())
        of[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert of == {i: len(w) for i, w in want.items()}
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= width
        padding += packing.padding(at, width)
    return padding, sum(map(len, want.values()))


def test_packing(table, spark, sf):
    texts = dict(enumerate(ODD))
    held(packing.pack(table(texts.items()), WORD, keep=10).collect(), texts, 4096)
    held(packing.pack(table(texts.items()), WORD, width=64, stretch=256).collect(), texts, 64)
    assert packing.pack(table([]), WORD).count() == 0
    docs = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    padding, tokens = held(QUERIES["op2_packing"](spark, sf).collect(), docs, 4096)
    assert padding < 0.01 * tokens
    twice = packing.pack(table([(7, "a b"), (7, "a b"), (None, "c")]), WORD).collect()
    assert sum(r["length"] for r in twice) == 3 + 3 + 2 and sum(r["start"] == 0 for r in twice) == 3


def test_word_ids_equal_library():
    """Ids of texts with marks, letters that change their form, and special strings."""
    r, t, words = random.Random(8), Tokenizer.from_file(WORD), packing.WordIds(WORD, 500)
    pieces = ["İ", "i", "A", "é", "e\u0301", "\u0301", "ß", "ẞ", "ŉ", "ſ", "Ω", "Ω", "Å", "ς", "Σ", "한", "ᄒ", "ᅡ", "ᆫ", "中", "か", "\u3099", "ǅ", "ﬁ", "ª", "²", "5", "_", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "|>", " ", " ", "\n", "\t", "\xa0", "\u200b", "\u2028", "🙂", "the", "Word", *packing.MARKS]
    texts = ["".join(r.choices(pieces, k=r.randint(1, 14))) for _ in range(20000)] + ["İ;", "a <|endoftext|> b", "x<|startoftext|>;;"]
    got = [np.frombuffer(ids, "<u4").tolist() for ids, _ in words.texts(pa.array(texts))]
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    every = [chr(c) + m for c in range(0x21, 0x3000) if not 0xD800 <= c < 0xE000 for m in (";", "a;")]
    got = [np.frombuffer(ids, "<u4").tolist() for ids, _ in words.texts(pa.array(every))]
    assert got == [e.ids for e in t.encode_batch(every, add_special_tokens=False)]


def test_windows_are_optimal():
    """The monotone queue against all ways to cut."""
    r = random.Random(5)
    for _ in range(200):
        width = r.choice([16, 24])
        cuts = [0]
        for _ in range(r.randint(1, 9)):
            cuts.append(cuts[-1] + r.randint(1, width))
        costs = [0.0] + [r.choice([0.0, 1.0, 4.0]) for _ in cuts[1:]]

        def price(n, width=width):
            return 0 if width == 16 and n in (8, 4) else width - n

        best = [0.0] + [1e9] * (len(cuts) - 1)
        for j in range(1, len(cuts)):
            for i in range(j):
                if cuts[j] - cuts[i] <= width:
                    best[j] = min(best[j], best[i] + price(cuts[j] - cuts[i]) + costs[j])
        bounds = packing.windows(cuts, costs, width)
        assert bounds[0] == 0 and bounds[-1] == len(cuts) - 1
        assert abs(sum(price(cuts[b] - cuts[a]) + costs[b] for a, b in zip(bounds, bounds[1:], strict=False)) - best[-1]) < 1e-9


def test_token_counts(table, spark, sf):
    e = encoding(FIFTY)
    docs = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    lengths = sorted(len(e.encode_ordinary(t)) for t in docs)
    sums = QUERIES["op4_token_counts"](spark, sf).cache()
    rows = sums.collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(set(lengths))
    for r in rows:
        n = r["n_tokens"]
        assert (r["n_docs"], r["docs_over"], r["tokens_over"]) == (lengths.count(n), sum(x > n for x in lengths), sum(x for x in lengths if x > n))
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths) and r["dropped_tokens"] == sum(lengths) - r["truncated_tokens"]
        assert abs(r["quantile"] - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    for r in counts.at_limits(sums, [0, 3, 100, 10**6]).collect():
        assert r["truncated_tokens"] == sum(min(x, r["context_limit"]) for x in lengths)
    for r in counts.at_quantiles(sums, [0.5, 0.9, 1.0]).collect():
        assert r["n_tokens"] == lengths[int(np.ceil(r["share"] * len(lengths) - 1e-9)) - 1]
    empty = counts.token_counts(table([]), FIFTY, P.PATTERN)
    assert empty.count() == 0
    assert [tuple(r)[:2] for r in counts.token_counts(table([(1, None), (1, ""), (2, "a")]), FIFTY, P.PATTERN).orderBy("n_tokens").collect()] == [(0, 2), (1, 1)]
