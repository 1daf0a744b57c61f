"""Order-preserving packing of documents into sequences by dynamic programming.

Documents of a partition stay in their order and form one stream of ids. A state is a
place where the stream may be cut: after a document (free), after a sentence or inside a
run without one (a penalty each). With f(j) the least cost of the stream up to cut j,

    f(j) = penalty(j) + min over i with 0 < P(j) - P(i) <= width of f(i) + padding(P(j) - P(i))

where padding is 0 for a power of two, else width minus length. The second kind is a
sliding-window minimum of f(i) + P(i), held in a monotone queue, so every state costs
amortised constant time; of the powers of two, half and a quarter of the width are looked
up (shorter sequences are made of a partition's end only). The stream is
settled in stretches of about ``stretch`` ids, and the last, still open windows of a
stretch go on to the next one, so memory is bounded by a stretch and one document.

Ids are the tokenizer's own for a whole text: the strings of its special tokens in a text
become those tokens.

Cases: null text counts as empty (its separator alone); repeated rows and repeated ids
are packed each; an empty table gives no pieces; a document of any length is packed
whole; clashing names among other columns don't matter, as two columns are selected.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.llm.shared import trim

ENDS = r"[.!?…\n]\z"
#: Letters and these marks are parts of their own to the tokenizer's split.
MARKS = ".,;:!?%&#$*|()-"
#: Letters of ASCII, and others that are composed already and whose lower case is one letter.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e\u0391-\u03a1\u03a3-\u03ab\u03ac-\u03ce\u0410-\u044f\u4e00-\u9fa5]+"
AFTER_SENTENCE, INSIDE, LONG = 4.0, 64.0, 256
SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Words(dict):
    """The ids of words, four bytes each, remembered. Of about ``keep`` entries the new
    become the old and the old go. Letters only are looked up many at a time, with a digit
    between them, whose id no letters have."""

    def __init__(self, path: str, keep: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.encode, self.keep = Tokenizer.from_file(path).encode_batch_fast, keep
        self.between = self.ids(["0"])[0]
        self.old: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.encode(texts, add_special_tokens=False)]

    def learn(self, words: list[str], letters: np.ndarray) -> None:
        """Entries for words that have none; letters: which of them consist of letters."""
        if len(self) > self.keep:
            self.old = dict(self)
            self.clear()
        new: tuple[list[str], list[str]] = ([], [])
        for w, plain in zip(words, letters.tolist(), strict=True):
            if w not in self:
                if (got := self.old.get(w)) is None:
                    new[plain].append(w)
                else:
                    self[w] = got
        together = new[1] if len(self.between) == 1 else []
        for a in range(0, len(together), 1 << 14):
            part = together[a : a + (1 << 14)]
            ids = np.array(self.ids([" 0 ".join(part)])[0], "<u4")
            ends = np.r_[np.nonzero(ids == self.between[0])[0], len(ids)]
            blob = ids.tobytes()
            for w, lo, hi in zip(part, [0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True):
                self[w] = blob[4 * lo : 4 * hi]
        alone = new[0] if together else new[0] + new[1]
        for a in range(0, len(alone), 1 << 14):
            part = alone[a : a + (1 << 14)]
            for w, ids in zip(part, self.ids(part), strict=True):
                self[w] = array("I", ids).tobytes()


def runs(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What stands in pool from each begin on, one after the other."""
    end = np.cumsum(size)
    return pool[np.repeat(begin - (end - size), size) + np.arange(end[-1] if len(end) else 0)]


class WordIds:
    """Ids of whole texts, and where their sentences end. The tokenizer drops spaces and
    line feeds and never joins over them, so words are looked up one by one. Marks after
    letters are a part of their own to it, and many words share the letters; where it isn't
    sure that its normal form of them is letters only, it gets the whole word."""

    def __init__(self, path: str, keep: int):
        self.known = Words(path, keep)

    def pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has."""
        stem = pc.utf8_rtrim(words, MARKS)
        plain = pc.match_substring_regex(stem, f"^{LETTERS}$")
        # letters and marks of a word, or all of it and nothing
        parts = pc.if_else(plain, pc.ascii_lower(stem), words), pc.if_else(plain, pc.replace_substring_regex(words, f"^{LETTERS}", ""), "")
        at, found = [], []
        for part in parts:
            coded = part.dictionary_encode()
            names = coded.dictionary.to_pylist()
            self.known.learn(names, pc.match_substring_regex(coded.dictionary, f"^{LETTERS}$").to_numpy(zero_copy_only=False))
            at.append(coded.indices.to_numpy() + len(found))
            found += map(self.known.__getitem__, names)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        both = np.stack(at, axis=1)
        return runs(np.frombuffer(b"".join(found), "<u4"), (np.cumsum(size) - size)[both.ravel()], size[both.ravel()]), size[both].sum(axis=1)

    def texts(self, column: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
        """Of each text its ids, and the number of ids before each sentence's end. Words
        are numbered by Arrow, each distinct one is looked up once, and the ids of all
        occurrences are gathered at once."""
        spaced = pc.replace_substring(pc.fill_null(column, ""), "\n", " \n ")
        split = pc.split_pattern(spaced, " ")
        coded = split.flatten().dictionary_encode()
        ids, size = self.pieces(coded.dictionary)
        last = pc.match_substring_regex(coded.dictionary, ENDS).to_numpy(zero_copy_only=False)
        at = coded.indices.to_numpy()
        n = size[at]
        done = np.r_[0, np.cumsum(n)]
        every = runs(ids, (np.cumsum(size) - size)[at], n).astype("<u4")
        ends = last[at]
        cut = np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy())].tolist()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            lo, hi = done[a], done[b]
            e = done[a + 1 : b + 1][ends[a:b]] - lo
            yield every[lo:hi].tobytes(), e


def padding(length: int, width: int) -> int:
    return 0 if length & (length - 1) == 0 else width - length


def windows(cuts: list[int], penalties: list[float], width: int) -> list[int]:
    """Indices of the cuts that bound the windows of least cost; cuts ascend from 0 with
    gaps of at most width; the first and the last are among the bounds."""
    half, quarter = width // 2, width // 4
    powers = width & (width - 1) == 0 and width >= 4
    index = {p: i for i, p in enumerate(cuts)}
    place = index.get
    f, back = [0.0] * len(cuts), [0] * len(cuts)
    queue: deque[int] = deque([0])
    for j in range(1, len(cuts)):
        p = cuts[j]
        low = p - width
        while cuts[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best, at = f[i] + cuts[i] + width - p, i
        if powers:
            if (i := place(p - half)) is not None and f[i] < best:
                best, at = f[i], i
            if (i := place(p - quarter)) is not None and f[i] < best:
                best, at = f[i], i
        f[j], back[j] = best + penalties[j], at
        key = f[j] + p
        while queue and f[queue[-1]] + cuts[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    bounds, j = [len(cuts) - 1], len(cuts) - 1
    while j:
        j = back[j]
        bounds.append(j)
    return bounds[::-1]


def tail(start: int, end: int, width: int, inside: float) -> list[int]:
    """Cuts of the last window: by the binary digits of its length, largest first, if
    that costs less than its padding."""
    n = end - start
    parts = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
    if (len(parts) - 1) * inside >= padding(n, width):
        return []
    return [int(x) for x in start + np.cumsum(parts)[:-1]]


class Stream:
    """The ids of a partition, cut and dealt to sequences as it goes."""

    def __init__(self, width: int, stretch: int, first_sequence: int, after_sentence: float, inside: float):
        self.width, self.stretch, self.sequence = width, stretch, first_sequence
        self.after_sentence, self.inside, self.long = after_sentence, inside, min(LONG, max(1, width // 4))
        self.docs: list[tuple] = []  # (id, ids as bytes, place in the stream, ids of it already settled)
        self.cuts, self.penalties, self.size = [0], [0.0], 0

    def add(self, doc_id, ids: bytes, ends: np.ndarray) -> None:
        """ids end with the separator; ends: ids before each sentence's end."""
        begin, n = self.size, len(ids) // 4
        places = ends[(ends > 0) & (ends < n - 1)]
        if len(places) > 1:
            places = places[np.r_[True, places[1:] > places[:-1]]]
        at = 0
        gaps = np.diff(places, prepend=0, append=n)
        if gaps.max() <= self.long:
            self.cuts.extend((places + begin).tolist())
            self.penalties.extend([self.after_sentence] * len(places))
        else:  # a long run without a sentence's end
            for to in [*places.tolist(), n]:
                while to - at > self.long:
                    at += self.long
                    self.cuts.append(begin + at)
                    self.penalties.append(self.inside)
                at = to
                if to < n:
                    self.cuts.append(begin + to)
                    self.penalties.append(self.after_sentence)
        self.cuts.append(begin + n)
        self.penalties.append(0.0)
        self.size = begin + n
        self.docs.append((doc_id, ids, begin, 0))

    def settle(self, last: bool) -> Iterator[tuple]:
        if not self.docs or not last and self.size < self.stretch:
            return
        bounds = [self.cuts[i] for i in windows(self.cuts, self.penalties, self.width)]
        if last:
            bounds[-1:-1] = tail(bounds[-2], bounds[-1], self.width, self.inside)
        elif len(bounds) > 4:
            bounds = bounds[:-2]
        else:
            return
        yield from self._pieces(bounds)
        done = bounds[-1]
        i = bisect_left(self.cuts, done)
        self.cuts, self.penalties = [c - done for c in self.cuts[i:]], [0.0, *self.penalties[i + 1 :]]
        self.docs = [(d, ids, begin - done, max(0, done - begin)) for d, ids, begin, _ in self.docs if begin + len(ids) // 4 > done]
        self.size -= done

    def _pieces(self, bounds: list[int]) -> Iterator[tuple]:
        k = 1
        for d, ids, begin, skip in self.docs:
            n, at = len(ids) // 4, begin + skip
            while at < min(begin + n, bounds[-1]):
                while bounds[k] <= at:
                    k += 1
                    self.sequence += 1
                to = min(begin + n, bounds[k])
                part = ids[4 * (at - begin) : 4 * (to - begin)]
                yield d, at - begin, to - at, zlib.crc32(part), n, self.sequence, at - bounds[k - 1]
                at = to
        self.sequence += 1


def parts_of(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
    group = (np.cumsum(size) - size) // most
    cut = np.nonzero(np.r_[True, group[1:] != group[:-1], True])[0] if len(size) else []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield batch.slice(a, b - a)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, width: int = 4096, stretch: int = 1 << 19, keep: int = 300_000, after_sentence: float = AFTER_SENTENCE, inside: float = INSIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, as SCHEMA says; sequence ids are unique over partitions. No
    shuffle: documents keep the order in which they lie."""
    kind = docs.schema[id_col].dataType
    schema = SCHEMA.format(kind.simpleString())
    from pyspark.sql.pandas.types import to_arrow_type

    names = [x.split()[0] for x in schema.split(", ")]
    types = [to_arrow_type(kind), *[pa.int64()] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer, keep)
        end = np.array([end_id], "<u4").tobytes()
        stream = Stream(width, stretch, TaskContext.get().partitionId() << 36, after_sentence, inside)
        rows: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for part in parts_of(batch, 8_000_000):
                trim()
                for d, (ids, ends) in zip(part.column(0).to_pylist(), words.texts(part.column(1)), strict=True):
                    stream.add(d, ids + end, ends)
                    rows.extend(stream.settle(False))
                if rows:
                    yield out(rows)
                    rows = []
        rows.extend(stream.settle(True))
        if rows:
            yield out(rows)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
