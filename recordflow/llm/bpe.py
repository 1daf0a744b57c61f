"""Byte-level BPE encoding and decoding by corpus-level merge replay.

All distinct pieces of a batch are laid end to end in one symbol array. An inverted
index maps the rank of a pair of neighbouring tokens to the places where that pair
stands; ranks are taken in ascending order, every place of a rank is merged at once,
and only the pairs left and right of a merged place are ranked anew. The result is
that of the usual greedy loop over each piece (lowest rank first, leftmost first),
also where a merge gives rise to a pair of lower rank.

Cases: null text counts as empty (0 tokens, digests of the empty string); empty tables
give empty results; repeated rows are encoded each; texts of any length are encoded
whole; other columns of the input are not touched.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.llm.shared import Recent

#: White space as the split pattern's ``\s`` means it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Coarse cuts that every match of the split pattern respects: a run of non-space
#: characters with at most one space before it, or a run of white space.
COARSE = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
NONE = np.iinfo(np.int32).max


class MergeReplay:
    """The merge table of one rank file, and the replay over a batch of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.token[r] = b
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        keys, merged, high = [], [], []
        for b, r in ranks.items():
            for i in range(1, len(b)):
                x, y = ranks.get(b[:i]), ranks.get(b[i:])
                if x is not None and y is not None:
                    keys.append(x << 32 | y)
                    merged.append(r)
                    if r < max(x, y):
                        high.append(max(x, y))
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        #: Ranks whose merge can give rise to a pair of lower rank.
        self.sinking = np.zeros(len(self.token), bool)
        self.sinking[high] = True
        at = np.arange(256)
        self.bytepair = self.rank_of(np.repeat(self.byte[at], 256), np.tile(self.byte[at], 256)).reshape(256, 256)

    @classmethod
    def load(cls, path: str, pattern: str) -> MergeReplay:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens; NONE where they don't merge."""
        want = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.merged[at], NONE)

    def pieces(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, merged over all words together."""
        out: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            if (r := self.ranks.get(w)) is not None:
                out[i] = np.array([r], np.int32)
            else:
                rest.append(i)
        sizes = np.array([len(words[i]) for i in rest], np.int64)
        if not sizes.sum():
            return [np.zeros(0, np.int32) if x is None else x for x in out]
        raw = np.frombuffer(b"".join([words[i] for i in rest]), np.uint8)
        word = np.repeat(np.arange(len(rest)), sizes)
        n = len(raw)
        sym = self.byte[raw]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)[sizes > 0]
        nxt[ends - 1] = -1
        prv[np.r_[0, ends[:-1]]] = -1
        rank = np.full(n, NONE, np.int32)
        rank[:-1] = self.bytepair[raw[:-1], raw[1:]]
        rank[ends - 1] = NONE
        live = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            by = np.argsort(ranks, kind="stable")
            places, ranks = places[by], ranks[by]
            starts = np.r_[0, np.nonzero(ranks[1:] != ranks[:-1])[0] + 1]
            for a, b, r in zip(starts.tolist(), [*starts[1:].tolist(), len(ranks)], ranks[starts].tolist(), strict=True):
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heapq.heappush(heap, r)

        at = np.nonzero(rank != NONE)[0]
        if len(at):
            enter(at, rank[at])
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            p = found[0] if len(found) == 1 else np.concatenate(found)
            p = np.unique(p[rank[p] == r])
            if not len(p):
                continue
            if len(p) > 1:
                if self.sinking[r]:
                    first = np.r_[True, word[p[1:]] != word[p[:-1]]]
                    if not first.all():
                        index[r] = [p[~first]]
                        heapq.heappush(heap, r)
                        p = p[first]
                chained = np.r_[False, nxt[p[:-1]] == p[1:]]
                if chained.any():  # of overlapping places every second one, from the left
                    i = np.arange(len(p))
                    p = p[(i - np.maximum.accumulate(np.where(chained, 0, i))) % 2 == 0]
            q = nxt[p]
            after = nxt[q]
            sym[p] = r
            nxt[p] = after
            live[q] = False
            rank[q] = NONE
            prv[after[after >= 0]] = p[after >= 0]
            rank[p] = NONE
            to = p[after >= 0]
            before = prv[p]
            by = before[before >= 0]
            left, right = np.r_[to, by], np.r_[nxt[to], p[before >= 0]]
            if len(left):
                new = self.rank_of(sym[left], sym[right])
                rank[left] = new
                if (ok := new != NONE).any():
                    enter(left[ok], new[ok])
        ids, owner = sym[live], word[live]
        cut = np.searchsorted(owner, np.arange(1, len(rest)))
        for i, x in zip(rest, np.split(ids, cut), strict=True):
            out[i] = x
        return out

    def words(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; every distinct piece is merged once."""
        split = [[m.encode() for m in self.pattern.findall(t)] for t in texts]
        distinct = list({p for s in split for p in s})
        ids = dict(zip(distinct, self.pieces(distinct), strict=True))
        none = np.zeros(0, np.int32)
        return [np.concatenate([ids[p] for p in s]) if s else none for s in split]

    def decode(self, ids) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids])


_loaded: dict[tuple, MergeReplay] = {}


def replay(path: str, pattern: str) -> MergeReplay:
    if pattern != public_tokenizers.PATTERN:
        raise ValueError("the coarse cuts fit public_tokenizers.PATTERN only")
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = MergeReplay.load(path, pattern)
    return _loaded[path, pattern]


def _encoded(path: str, pattern: str, keep: int, digest: bool):
    """Per batch: each distinct coarse cut is encoded once, and what it adds to a
    document is kept for later batches of the worker."""

    known = Recent(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = replay(path, pattern)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            distinct: set[str] = set()
            for t in texts:
                distinct.update(COARSE.findall(t))
            new = known.missing(distinct)
            del distinct
            for w, x in zip(new, bpe.words(new), strict=True):
                x = x.tolist()
                known[w] = (",".join(map(str, x)), bpe.decode(x), len(x)) if digest else x
            if not digest:
                rows = [[i for w in COARSE.findall(t) for i in known[w]] for t in texts]
                yield pa.record_batch([ids, pa.array(rows, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in rows], pa.binary())], ["doc_id", "ids", "decoded"])
                continue
            count, of_ids, of_bytes = [], [], []
            for t in texts:
                found = [known[w] for w in COARSE.findall(t)]
                count.append(sum([f[2] for f in found]))
                of_ids.append(hashlib.sha256(",".join([f[0] for f in found]).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(b"".join([f[1] for f in found])).hexdigest())
            yield pa.record_batch([ids, pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, keep: int = 150_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (the bytes those ids stand for)."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encoded(path, pattern, keep, False), f"doc_id {kind}, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, path: str, pattern: str, keep: int = 150_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the bytes decoded from the ids), computed where the ids are, so
    that no ids leave the task. ``keep`` bounds the coarse cuts that a worker remembers."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encoded(path, pattern, keep, True), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
