"""Removal of repeated passages with suffix arrays, over the bytes of all texts.

A byte goes if a string of ``LENGTH`` (50) bytes that covers it also starts in a document
with a smaller id. Suffix arrays of whole texts would have to meet in all pairs of
shards, so texts are cut first where equal strings are cut alike:

1. Every 50-byte string has an anchor, the 20-byte substring of the least hash in it.
   Consecutive strings with one anchor make up a slice. Equal strings have equal anchors
   at the same place, so all documents that repeat a string hold it in slices with the
   same anchor. Of each slice (anchor hash, slice hash, document) goes to the anchor's
   bucket; of equal slices of a batch one only, as the others are copies already.
2. A bucket tells, of each slice, whether it is a copy of a slice in a smaller document
   (then all of it goes), or the first of its kind. If different slices share an anchor,
   the first ones are compared byte by byte.
3. These go to shards by anchor. A shard of bounded size gets a suffix array by
   Larsson-Sadakane refinement (ranks by the first 8 bytes, then doubling, only in groups
   that are not yet sorted), common prefixes by Kasai's rule, and from both the least
   document of every distinct 50-byte string. If a bucket is larger than a shard, its
   shards' sorted strings are merged by binary search. Of an anchor in more slices than
   ``crowd`` of a batch (a passage's end in a third of all documents), what is over goes
   round the anchor's bucket, and its strings are dealt to shards one by one, by their
   own hashes; equal ones of a group of documents only once.
4. What goes is sent back to the documents' own groups.

Hashes only choose what is compared: a copy is known by 40 + 48 bits besides its bucket, and
then compared with the first one: in a batch by its bytes, else by a cryptographic digest of
128 bits, which is sent to each group that has copies, once. If two different slices ever had
one hash, the job would fail and say so. Slices, not documents, are dealt out: a passage in a third of all
documents is, but for its ends, one slice hash in each.

Cases: null texts are empty, lose nothing and stay null, nor do texts of fewer than 50 bytes; a null
id counts as the largest; rows that share an id don't take from one another; an empty
table gives an empty result; texts are read whole; other columns pass through ``strip``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.llm.minhash import _BYTE, Powers, mixed
from recordflow.llm.shared import settle, trim

LENGTH, GRAM = 50, 20
SHARD = 2_000_000
#: Slices of one anchor that a batch sends to the anchor's bucket, and that a bucket takes.
CROWD, MOST = 256, 1 << 17
#: Bytes of text for each group of documents and each bucket, and for each task.
GROUP_BYTES, TASK_BYTES = 8 << 20, 64 << 20
#: Anchors are sought in stretches, by numbers of 36 bits of a hash and 28 of a place.
STRETCH, LOW = 1 << 26, np.uint64((1 << 28) - 1)
LAST = np.iinfo(np.int64).max
COLLISION = "different strings have one hash; other hash constants are needed"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    got, n = x, 1
    while 2 * n <= width:
        got, n = np.minimum(got[:-n], got[n:]), 2 * n
    return np.minimum(got[: len(x) - width + 1], got[width - n : len(x) - n + 1]) if n < width else got


class Slices:
    """Slices of a run of texts: ``start`` (first string), ``count`` (of strings), the
    anchor's and the slice's hash, and the text each is in."""

    def __init__(self, texts: list[bytes]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.cumsum(size) - size
        self.raw = raw = np.frombuffer(b"".join(texts), np.uint8)
        n = len(raw)
        none = np.zeros(0, np.int64)
        self.start = self.count = self.text = none
        self.anchor = self.content = np.zeros(0, np.uint64)
        if n < LENGTH:
            return
        up, down = Powers.to(n + 1)
        total = self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[:-1], out=total[1:])
        gram = mixed((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
        at = np.empty(n - LENGTH + 1, np.int64)
        for a in range(0, len(at), STRETCH):  # places are counted from a stretch's begin, so any text has room
            g = gram[a : a + STRETCH + LENGTH - GRAM]
            least = sliding_min((g & ~LOW) | np.arange(len(g), dtype=np.uint64), LENGTH - GRAM + 1)
            at[a : a + STRETCH] = (least & LOW).astype(np.int64) + a
        owner = np.repeat(np.arange(len(texts)), size)
        inside = owner[: len(at)] == owner[LENGTH - 1 : LENGTH - 1 + len(at)]
        new = np.r_[True, (at[1:] != at[:-1]) | (owner[1 : len(at)] != owner[: len(at) - 1])] & inside
        first = np.nonzero(new)[0]
        # strings across two texts stand only at a text's end, so a slice's strings are in one run
        run = np.cumsum(new) - 1
        self.count = np.bincount(run[inside], minlength=len(first)) if len(first) else none
        self.start, self.text = first, owner[first]
        end = first + self.count + LENGTH - 1
        self.anchor = gram[at[first]]
        self.content = mixed((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64)) >> np.uint64(16)

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of slices: of each of their strings the slice, its number there, and its hash."""
        n = self.count[which]
        owner = np.repeat(which, n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = self.start[owner] + within
        _, down = Powers.to(len(self.raw) + 1)
        return owner, within, mixed((self.total[at + LENGTH] - self.total[at]) * down[at])

    def verify(self, x: np.ndarray, y: np.ndarray) -> None:
        """Slices x have the bytes of slices y, as their hashes say."""
        size = self.count[x] + LENGTH - 1
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        if (self.count[x] != self.count[y]).any() or (self.raw[np.repeat(self.start[x], size) + within] != self.raw[np.repeat(self.start[y], size) + within]).any():
            raise RuntimeError(COLLISION)

    def digest(self, i: int) -> bytes:
        """128 bits of a cryptographic hash of a slice's bytes."""
        return hashlib.blake2b(self.bytes_of(i), digest_size=16).digest()

    def bytes_of(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.start[i] + self.count[i] + LENGTH - 1].tobytes()


def groups_of(column: pa.Array, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, about ``most`` bytes at a time (a larger text alone), and where
    each run begins."""
    part, size, first = [], 0, 0
    for i, t in enumerate(column.cast(pa.binary())):  # one at a time, as bytes at once
        t = t.as_py() or b""
        if part and size + len(t) > most:
            yield first, part
            part, size, first = [], 0, i
        part.append(t)
        size += len(t)
    if part:
        yield first, part


def _cut(x: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def _uncut(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64)


def _ids(column) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.fill_null(int(LAST)).to_numpy(zero_copy_only=False).astype(np.int64)


ANNOUNCED = "bucket long, a binary, c binary, d binary, t binary, h binary, kd binary, kc binary, hd binary, hc binary"


def _announce(n_buckets: int, crowd: int):
    """Per batch and bucket: slices (a, c, d by t), crowded anchors (h); in rows of their
    own, copies (kd, kc) and slices of crowded anchors (hd, hc) that are known already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for b in batches:
            trim()
            ids = _ids(b.column(0))
            for first, texts in groups_of(b.column(1), 1_000_000):
                s = Slices(texts)
                if not len(s.start):
                    continue
                doc = ids[first + s.text]
                by = np.lexsort((doc, s.content, s.anchor))
                a, c, d = s.anchor[by], s.content[by], doc[by]
                new_a = np.r_[True, a[1:] != a[:-1]]
                new = new_a | np.r_[True, c[1:] != c[:-1]]
                run_of = np.cumsum(new) - 1
                copy = d > d[new][run_of]
                s.verify(by[copy], by[new][run_of[copy]])
                kd, kc = d[copy], c[copy]
                a, c, d, new_a = a[new], c[new], d[new], new_a[new]
                run_of = np.cumsum(new_a) - 1
                rank = np.arange(len(a)) - np.nonzero(new_a)[0][run_of]
                over = rank >= crowd
                crowded = np.unique(a[over])
                hd, hc = d[over], c[over]
                a, c, d = a[~over], c[~over], d[~over]
                bucket, h_bucket = (a % np.uint64(n_buckets)).astype(np.int64), (crowded % np.uint64(n_buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
                short, a, c, d = _cut(crowded >> np.uint64(24), 5), _cut(a >> np.uint64(24), 5)[by], _cut(c, 6)[by], d[by]
                used = np.nonzero(cut[1:] > cut[:-1])[0].tolist()
                rows = []
                for k in used:
                    lo, hi = cut[k], cut[k + 1]
                    held, at = np.unique(d[lo:hi], return_inverse=True)
                    rows.append((k, a[lo:hi].tobytes(), c[lo:hi].tobytes(), held.astype("<i8").tobytes(), at.astype("<u2" if len(held) <= 1 << 16 else "<u4").tobytes(), short[h_bucket == k].tobytes(), b"", b"", b"", b""))
                if len(kd) or len(hd):
                    rows.append((turn % n_buckets, b"", b"", b"", b"", b"", kd.astype("<i8").tobytes(), _cut(kc, 6).tobytes(), hd.astype("<i8").tobytes(), _cut(hc, 6).tobytes()))
                turn += 1
                buckets, *blobs = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(buckets, pa.int64()), *[pa.array(x, pa.binary()) for x in blobs]], [x.split()[0] for x in ANNOUNCED.split(", ")])

    return run


ANSWER = "g long, bucket long, kind int, d binary, c binary, m binary"
#: Kinds of answers: to be compared; copies by their hashes; strings found; of crowded anchors,
#: to be compared; copies that have been verified; slices whose digests other groups (m)
#: want; such digests (m; d: anchors).
NEEDED, COPIED, FOUND, CROWDED, KNOWN, WANTED, WITNESS = range(7)


def _answers(n_groups: int):
    """Of the slices of a bucket: copies and those to be compared."""

    def run(group: pa.Table) -> pa.Table:
        trim()
        bucket = group.column("bucket")[0].as_py()
        a, c, d = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        crowded, rows = [np.zeros(0, np.uint64)], []
        for x in group.to_pylist():
            if x["a"]:
                a.append(_uncut(x["a"], 5))
                c.append(_uncut(x["c"], 6))
                at = np.frombuffer(x["t"], "<u2" if len(x["t"]) < 4 * len(a[-1]) else "<u4")
                d.append(np.frombuffer(x["d"], "<i8")[at])
            crowded.append(_uncut(x["h"], 5))
            for kind, k in ((KNOWN, "k"), (CROWDED, "h")):
                if x[k + "d"]:
                    rows.extend(_by_group(kind, n_groups, np.frombuffer(x[k + "d"], "<i8"), _uncut(x[k + "c"], 6), None))
        a, c, d, crowded = np.concatenate(a), np.concatenate(c), np.concatenate(d), np.unique(np.concatenate(crowded))
        by = np.argsort(a, kind="stable")
        a, c, d = a[by], c[by], d[by]
        same = a[1:] == a[:-1]
        shared = (np.r_[False, same] | np.r_[same, False])[: len(a)] | np.isin(a, crowded)
        a, c, d = a[shared], c[shared], d[shared]
        by = np.lexsort((d, c, a))
        a, c, d = a[by], c[by], d[by]
        if not len(a):
            return _answer(rows, bucket)
        new_a = np.r_[True, a[1:] != a[:-1]]
        new_c = new_a | np.r_[True, c[1:] != c[:-1]]
        of_c, of_a = np.cumsum(new_c) - 1, np.cumsum(new_a) - 1
        first = d[new_c][of_c]
        copy = d > first
        kinds = np.bincount(of_a, new_c)[of_a]
        starts = np.nonzero(new_a)[0]
        lowest, highest = np.minimum.reduceat(first, starts)[of_a], np.maximum.reduceat(first, starts)[of_a]
        crowd = np.isin(a, crowded)
        need = ~copy & (crowd | (kinds > 1) & (highest > lowest))
        need &= new_c | np.r_[True, d[1:] != d[:-1]]
        crowd |= kinds > MOST
        for kind, take in ((COPIED, copy), (NEEDED, need & ~crowd), (CROWDED, need & crowd)):
            rows.extend(_by_group(kind, n_groups, d[take], c[take], None))
        # the first one's digest goes to every group that has copies
        wants = np.unique(np.stack([of_c[copy], np.mod(d[copy], n_groups)]), axis=1)
        rows.extend(_by_group(WANTED, n_groups, d[new_c][wants[0]], c[new_c][wants[0]], wants[1]))
        return _answer(rows, bucket)

    return run


def _by_group(kind: int, n_groups: int, d: np.ndarray, c: np.ndarray, m: np.ndarray | None) -> list[tuple]:
    g = np.mod(d, n_groups)
    by = np.argsort(g, kind="stable")
    d, c, g = d[by].astype("<i8"), _cut(c[by], 6), g[by]
    m = None if m is None else m[by].astype("<u8")
    cut = np.nonzero(np.r_[True, g[1:] != g[:-1], True])[0] if len(g) else []
    return [(int(g[x]), kind, d[x:y].tobytes(), c[x:y].tobytes(), b"" if m is None else m[x:y].tobytes()) for x, y in zip(cut[:-1], cut[1:], strict=True)]


def _answer(rows: list[tuple], bucket: int) -> pa.Table:
    g, kind, d, c, m = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.table({"g": pa.array(g, pa.int64()), "bucket": pa.array([bucket] * len(g), pa.int64()), "kind": pa.array(kind, pa.int32()), "d": pa.array(d, pa.binary()), "c": pa.array(c, pa.binary()), "m": pa.array(m, pa.binary())})


def _told(answers: pa.Table, kinds: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, slices and masks of a group's answers, sorted by document, slice."""
    d, c, m = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for x in answers.select(["kind", "d", "c", "m"]).to_pylist():
        if x["kind"] in kinds:
            d.append(np.frombuffer(x["d"], "<i8"))
            c.append(_uncut(x["c"], 6))
            m.append(np.frombuffer(x["m"], "<u8") if x["m"] else np.full(len(d[-1]), ~np.uint64(0)))
    d, c, m = np.concatenate(d), np.concatenate(c), np.concatenate(m)
    by = np.lexsort((c, d))
    d, c, m = d[by], c[by], m[by]
    if not len(d):
        return d, c, m
    first = np.nonzero(np.r_[True, (d[1:] != d[:-1]) | (c[1:] != c[:-1])])[0]
    return d[first], c[first], np.bitwise_or.reduceat(m, first)  # all that is said holds


def _wanted(answers: pa.Table) -> tuple[tuple, np.ndarray, np.ndarray]:
    """Slices whose bytes are wanted, as ``_told`` gives them with a number for a mask; where
    the groups of each number begin; and these groups."""
    d, c, g = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for x in answers.select(["kind", "d", "c", "m"]).to_pylist():
        if x["kind"] == WANTED:
            d.append(np.frombuffer(x["d"], "<i8"))
            c.append(_uncut(x["c"], 6))
            g.append(np.frombuffer(x["m"], "<i8"))
    d, c, g = np.concatenate(d), np.concatenate(c), np.concatenate(g)
    by = np.lexsort((g, c, d))
    d, c, g = d[by], c[by], g[by]
    first = np.nonzero(np.r_[True, (d[1:] != d[:-1]) | (c[1:] != c[:-1])])[0] if len(d) else np.zeros(0, np.int64)
    return (d[first], c[first], np.arange(len(first), dtype=np.uint64)), np.r_[first, len(d)], g


def _witnesses(answers: pa.Table) -> dict[tuple[int, int], bytes]:
    """By anchor and slice: the digest of the first document's slice."""
    out = {}
    for x in answers.select(["kind", "d", "c", "m"]).to_pylist():
        if x["kind"] == WITNESS:
            for k, at in enumerate(zip(_uncut(x["d"], 5).tolist(), _uncut(x["c"], 6).tolist(), strict=True)):
                told = x["m"][16 * k : 16 * k + 16]
                if out.setdefault(at, told) != told:
                    raise RuntimeError(COLLISION)
    return out


def _matched(s: Slices, docs: np.ndarray, told: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Which slices were told of, and their masks; docs: the document of each text."""
    d, c, m = told
    if not len(d) or not len(s.start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key = np.empty(len(d), [("d", "<i8"), ("c", "<u8")])
    key["d"], key["c"] = d, c
    want = np.empty(len(s.start), key.dtype)
    want["d"], want["c"] = docs[s.text], s.content
    # documents first, then slices among a document's own
    names, number = np.unique(d, return_inverse=True)
    at = np.searchsorted(names, want["d"])
    known = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == want["d"])
    which = np.nonzero(known)[0]
    flat = (number.astype(np.uint64) << np.uint64(48)) | c if len(names) < 1 << 16 else None
    if flat is None:
        order = {(int(x), int(y)): k for k, (x, y) in enumerate(zip(d, c, strict=True))}
        hit = [(i, order[k]) for i in which.tolist() if (k := (int(want["d"][i]), int(want["c"][i]))) in order]
        i, k = (np.array(x, np.int64) for x in zip(*hit, strict=True)) if hit else (np.zeros(0, np.int64),) * 2
        return i, m[k]
    asked = (at[which].astype(np.uint64) << np.uint64(48)) | want["c"][which]
    k = np.minimum(np.searchsorted(flat, asked), len(flat) - 1)
    ok = flat[k] == asked
    return which[ok], m[k[ok]]


SENT = "bucket long, d binary, c binary, n binary, k binary, b binary, kd binary, kc binary, km binary, a binary, to long"


def _compared(n_buckets: int):
    """What is to be compared of a group's texts, by bucket: slices by their anchors, of
    crowded anchors single strings (number k of their slice) by their own hashes. Digests
    that other groups want go through any bucket, with the group in ``to``."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        trim()
        out: dict[int, list[tuple]] = {}
        known = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        needed, crowded = ((_told(answers, (k,)) for k in (NEEDED, CROWDED)) if answers.num_rows else (None, None))
        wits: dict[int, list[tuple]] = {}
        if needed is not None and docs.num_rows:
            ids = _ids(docs.column("doc_id"))
            wanted, begin, targets = _wanted(answers)
            asked = np.isin(ids, needed[0]) | np.isin(ids, crowded[0]) | np.isin(ids, wanted[0])
            ids, text = ids[asked], docs.column("text").combine_chunks().filter(pa.array(asked))
            for first, texts in groups_of(text, 1_000_000):
                s = Slices(texts)
                of = ids[first : first + len(texts)]
                for i in _matched(s, of, needed)[0].tolist():
                    out.setdefault(int(s.anchor[i] % np.uint64(n_buckets)), []).append((int(of[s.text[i]]), int(s.content[i]), 0, s.bytes_of(i)))
                which, number = _matched(s, of, wanted)
                for k, i in dict(zip(number.tolist(), which.tolist(), strict=True)).items():
                    for g in targets[begin[k] : begin[k + 1]].tolist():
                        wits.setdefault(g, []).append((int(s.anchor[i] >> np.uint64(24)), int(s.content[i]), s.digest(i)))
                which = _matched(s, of, crowded)[0]
                if not len(which):
                    continue
                slice_, k, h = s.strings(which)
                d = of[s.text[slice_]]
                by = np.lexsort((d, h))
                slice_, k, h, d = slice_[by], k[by], h[by], d[by]
                new = np.r_[True, h[1:] != h[:-1]]
                head = np.nonzero(new)[0][np.cumsum(new) - 1]
                later = d > d[head]
                at = s.start[slice_] + k
                strings = np.lib.stride_tricks.sliding_window_view(s.raw, LENGTH)
                if later.any() and (strings[at[later]] != strings[at[head[later]]]).any():
                    raise RuntimeError(COLLISION)
                known.append((d[later], s.content[slice_[later]], np.uint64(1) << k[later].astype(np.uint64)))
                for i, j, x, y in zip(slice_[~later].tolist(), k[~later].tolist(), h[~later].tolist(), d[~later].tolist(), strict=True):
                    at = int(s.start[i]) + j
                    out.setdefault(x % n_buckets, []).append((y, int(s.content[i]), j, s.raw[at : at + LENGTH].tobytes()))
        rows = []
        for bucket, x in out.items():
            d, c, k, b = zip(*x, strict=True)
            rows.append((bucket, np.array(d, "<i8").tobytes(), _cut(np.array(c, np.uint64), 6).tobytes(), np.array([len(y) for y in b], np.uint8).tobytes(), np.array(k, np.uint8).tobytes(), b"".join(b), b"", b"", b"", b"", -1))
        for g, x in wits.items():
            a, c, b = zip(*x, strict=True)
            rows.append((g % n_buckets, b"", _cut(np.array(c, np.uint64), 6).tobytes(), b"", b"", b"".join(b), b"", b"", b"", _cut(np.array(a, np.uint64), 5).tobytes(), g))
        d, c, m = (np.concatenate(x) for x in zip(*known, strict=True))
        if len(d):
            rows.append((int(d[0]) % n_buckets, b"", b"", b"", b"", b"", d.astype("<i8").tobytes(), _cut(c, 6).tobytes(), m.astype("<u8").tobytes(), b"", -1))
        buckets, *blobs, to = zip(*rows, strict=True) if rows else ((),) * 11
        return pa.table([pa.array(buckets, pa.int64()), *[pa.array(x, pa.binary()) for x in blobs], pa.array(to, pa.int64())], [x.split()[0] for x in SENT.split(", ")])

    return run


# -- suffix arrays ------------------------------------------------------------------------


def words_at(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, first byte highest; zeros beyond the end."""
    x = np.concatenate([raw, np.zeros(8, np.uint8)])
    out = np.zeros(len(raw), np.uint64)
    for k in range(8):
        out |= x[k : k + len(raw)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def suffix_array(raw: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by the next ``depth`` bytes at least, and the rank of each place.
    Larsson-Sadakane: a rank is the last index of its group; a round sorts the places of
    groups of more than one by the rank that lies as far on as is sorted already."""
    n = len(raw)
    first = words_at(raw)
    sa = np.argsort(first, kind="stable")
    ordered = first[sa]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if n else np.zeros(0, bool)
    ends = np.r_[np.nonzero(new)[0][1:], n] - 1
    rank = np.empty(n + 1, np.int64)
    rank[sa] = ends[np.cumsum(new) - 1]
    rank[n] = -1
    h = 8
    while h < depth:
        open_ = np.nonzero(~(new & np.r_[new[1:], True]))[0]  # indices in groups of several
        if not len(open_):
            break
        places = sa[open_]
        group, on = rank[places], rank[np.minimum(places + h, n)]
        by = np.lexsort((on, group))
        sa[open_] = places[by]
        group, on = group[by], on[by]
        split = np.r_[True, (group[1:] != group[:-1]) | (on[1:] != on[:-1])]
        new[open_] = split
        last = np.r_[np.nonzero(split)[0][1:], len(open_)] - 1
        rank[sa[open_]] = open_[last][np.cumsum(split) - 1]
        h *= 2
    return sa, rank[:n]


def common_prefixes(raw: np.ndarray, sa: np.ndarray, most: int, lane: int = 64) -> np.ndarray:
    """Length of the common prefix of each entry of a suffix array with the one before,
    up to ``most``. Kasai's rule, in text order: it is at least that of the place before
    less one. As the array is sorted to a depth over ``most`` only, the rule holds where
    the neighbour's next place stands before this place; elsewhere the comparison starts
    anew. The text is cut into lanes that go on side by side, one place a step."""
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    index = np.full(n + 1, n)
    index[sa] = np.arange(n)
    word = np.concatenate([words_at(raw), np.zeros(most + 8, np.uint64)])
    out = np.zeros(n, np.int64)
    begin = np.arange(0, n, lane)
    h = np.zeros(len(begin), np.int64)
    for step in range(lane):
        at = begin + step
        ok = at < n
        at, h, begin = at[ok], np.maximum(h[ok] - 1, 0), begin[ok]
        if step:
            h[index[other[ok] + 1] > index[at]] = 0
        other = before[at]
        go = np.nonzero(other >= 0)[0]
        h[other < 0] = 0
        while len(go):
            x = word[at[go] + h[go]] ^ word[other[go] + h[go]]
            equal = x == 0
            # equal bytes from the highest on
            high = np.zeros(len(x), np.int64)
            for k in range(1, 8):
                high += (x >> np.uint64(64 - 8 * k)) == 0
            h[go] += np.where(equal, 8, high)
            go = go[equal & (h[go] < most)]
        np.minimum(h, np.minimum(most, n - at), out=h)
        out[at] = h
    lcp[:] = out[sa]
    return lcp


def least_documents(raw: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one shard: the distinct strings at ``starts`` in order (their places), the least
    document of each, and the number of the string at each start."""
    sa, _ = suffix_array(raw, LENGTH)
    lcp = common_prefixes(raw, sa, LENGTH)
    number = np.full(len(raw), -1)
    number[starts] = np.arange(len(starts))
    string = np.cumsum(lcp < LENGTH)
    valid = number[sa] >= 0
    string, start = string[valid], number[sa[valid]]
    new = np.r_[True, string[1:] != string[:-1]]
    first = np.nonzero(new)[0]
    least = np.minimum.reduceat(docs[start], first)
    of = np.empty(len(starts), np.int64)
    of[start] = np.cumsum(new) - 1
    return starts[start[first]], least, of


def _strings(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(raw, LENGTH)[places].copy().view(f"S{LENGTH}").ravel()


def merged_least(shards: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted strings of several shards with their least documents, as one: each shard's
    strings are found in those so far by binary search, or put where they belong."""
    keys, least = shards[0]
    least = least.copy()
    for k, x in shards[1:]:
        at = np.searchsorted(keys, k)
        known = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == k)
        np.minimum.at(least, at[known], x[known])
        keys, least = np.insert(keys, at[~known], k[~known]), np.insert(least, at[~known], x[~known])
    return keys, least


def repeated_strings(sizes: np.ndarray, raw: np.ndarray, docs: np.ndarray, shard: int = SHARD) -> np.ndarray:
    """Of slices laid end to end (sizes, the document of each): which of the strings of
    each also stand in a smaller document; one mask a slice, bit k for string k."""
    count = sizes - LENGTH + 1
    begin = np.cumsum(sizes) - sizes
    cut = [0, *(np.nonzero(np.diff(begin // shard))[0] + 1).tolist(), len(sizes)]
    parts = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        lo, hi = begin[a], begin[b - 1] + sizes[b - 1]
        n = count[a:b]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(begin[a:b] - lo, n) + within
        of_doc = np.repeat(docs[a:b], n)
        places, least, of = least_documents(raw[lo:hi], starts, of_doc)
        parts.append((a, n, within, of_doc, least, of, _strings(raw[lo:hi], places) if len(cut) > 2 else None))
    if len(parts) > 1:
        keys, every = merged_least([(p[6], p[4]) for p in parts])
    masks = np.zeros(len(sizes), np.uint64)
    for a, n, within, of_doc, least, of, strings in parts:
        if strings is not None:
            least = every[np.searchsorted(keys, strings)]
        gone = of_doc > least[of]
        bit = np.where(gone, np.uint64(1) << within.astype(np.uint64), np.uint64(0))
        np.bitwise_or.at(masks, a + np.repeat(np.arange(len(n)), n)[gone], bit[gone])
    return masks


def _resolved(n_groups: int, shard: int):
    def run(group: pa.Table) -> pa.Table:
        trim()
        bucket = group.column("bucket")[0].as_py()
        every = group.to_pylist()
        rows = [x for x in every if x["d"]]
        out: list[tuple] = []
        if rows:
            joined = {f: b"".join([x[f] for x in rows]) for f in "dcnkb"}
            d, c = np.frombuffer(joined["d"], "<i8"), _uncut(joined["c"], 6)
            n, k = np.frombuffer(joined["n"], np.uint8).astype(np.int64), np.frombuffer(joined["k"], np.uint8).astype(np.uint64)
            masks = repeated_strings(n, np.frombuffer(joined["b"], np.uint8), d, shard) << k
            hit = masks > 0
            out = _by_group(FOUND, n_groups, d[hit], c[hit], masks[hit])
        for x in every:
            if x["to"] >= 0:
                out.append((x["to"], WITNESS, x["a"], x["c"], x["b"]))
            if x["kd"]:
                out.extend(_by_group(FOUND, n_groups, np.frombuffer(x["kd"], "<i8"), _uncut(x["kc"], 6), np.frombuffer(x["km"], "<u8")))
        return _answer(out, bucket)

    return run


def _gone(s: Slices, which: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Of each byte of a run of texts, whether it goes."""
    mark = np.zeros(len(s.raw) + 1, np.int64)
    n = s.count[which]
    owner = np.repeat(np.arange(len(which)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    on = masks[owner] >> within.astype(np.uint64) & np.uint64(1) > 0
    start = s.start[which][owner[on]] + within[on]
    np.add.at(mark, start, 1)
    np.add.at(mark, start + LENGTH, -1)
    return np.cumsum(mark)[:-1] > 0


def _stripped(keep_text: bool):
    """The rows of a group with what went from each text."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        trim()
        ids = _ids(docs.column("doc_id"))
        told, copied, witness = (np.zeros(0, np.int64),) * 3, (np.zeros(0, np.int64),) * 3, {}
        if answers.num_rows:
            told, copied, witness = _told(answers, (COPIED, KNOWN, FOUND)), _told(answers, (COPIED,)), _witnesses(answers)
        size, removed, spans, digest, kept, where = [], [], [], [], [], []
        text = docs.column("text")
        for first, texts in groups_of(text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text, 1_000_000):
            hit = np.isin(ids[first : first + len(texts)], told[0])
            some = [t for t, h in zip(texts, hit.tolist(), strict=True) if h]
            if some:
                s = Slices(some)
                for i in _matched(s, ids[first : first + len(texts)][hit], copied)[0].tolist():
                    if witness.get((int(s.anchor[i] >> np.uint64(24)), int(s.content[i]))) != s.digest(i):
                        raise RuntimeError(COLLISION)
                gone = _gone(s, *_matched(s, ids[first : first + len(texts)][hit], told)) if len(s.start) else np.zeros(len(s.raw), bool)
                at = iter(zip(s.begin.tolist(), map(len, some), strict=True))
            for t, h in zip(texts, hit.tolist(), strict=True):
                size.append(len(t))
                edges = np.zeros(0, np.int64)
                if h:
                    a, n = next(at)
                    x = gone[a : a + n]
                    edges = np.nonzero(np.diff(np.r_[False, x, False]))[0]
                left = t
                if len(edges):
                    left = np.frombuffer(t, np.uint8)[~x].tobytes()
                removed.append(len(t) - len(left))
                spans.append(len(edges) // 2)
                if keep_text:
                    kept.append(left.decode(errors="ignore"))
                    where.append([{"first": int(p), "end": int(q)} for p, q in zip(edges[::2], edges[1::2], strict=True)])
                else:
                    digest.append(hashlib.sha256(left).hexdigest())
        out = {"doc_id": docs.column("doc_id"), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64())}
        if not keep_text:
            return pa.table(out | {"kept_sha256": pa.array(digest, pa.string())})
        pairs = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": docs.column("doc_id"), "rest": docs.column("rest"), "text": pc.if_else(text.is_null(), pa.scalar(None, pa.string()), pa.array(kept, pa.string())), "spans": pa.array(where, pairs)})

    return run


def _sought(docs: DataFrame, shard: int, crowd: int) -> tuple[DataFrame, DataFrame, int]:
    """docs (doc_id, text, rest) with their group, what is known of copies and what shards
    found, and the number of tasks. Groups and buckets, each of which is in memory at once,
    are as many as the texts' bytes ask for, and at least as many as shuffle partitions; a
    task has several, one after the other."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    n_buckets = max(tasks, -(-size // GROUP_BYTES))
    n_groups = n_buckets + 1
    announced = docs.select("doc_id", "text").mapInArrow(_announce(n_buckets, crowd), ANNOUNCED)
    answers = settle(announced.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_answers(n_groups), ANSWER))
    grouped = docs.withColumn("g", F.pmod(F.coalesce("doc_id", F.lit(int(LAST))), F.lit(n_groups))).repartition(tasks, "g")
    asked = answers.filter(F.col("kind").isin(NEEDED, CROWDED, WANTED))
    cut = _with_answers(grouped.select("doc_id", "text", "g"), asked, tasks).applyInArrow(_compared(n_buckets), SENT)
    found = cut.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_resolved(n_groups, shard), ANSWER)
    return grouped, answers.filter(F.col("kind").isin(COPIED, KNOWN)).unionAll(found), tasks


def _with_answers(grouped: DataFrame, answers: DataFrame, tasks: int):
    return grouped.groupBy("g").cogroup(answers.repartition(tasks, "g").groupBy("g"))


def digests(docs: DataFrame, shard: int = SHARD, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    grouped, told, tasks = _sought(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), shard, crowd)
    return _with_answers(grouped, told, tasks).applyInArrow(_stripped(False), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip(docs: DataFrame, shard: int = SHARD, crowd: int = CROWD, spans: str = "spans") -> DataFrame:
    """docs (doc_id long, text, any others) with what repeats taken from the texts, and
    ``spans`` (or as named; a column of that name in docs is replaced): first byte and end
    of each run that went. Of a character that went in part nothing stays."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text") and c.lower() != spans.lower()]
    whole = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)])
    grouped, told, tasks = _sought(docs.select("doc_id", "text", whole.alias("rest")), shard, crowd)
    spans_type = T.ArrayType(T.StructType().add("first", "long").add("end", "long"))
    schema = T.StructType().add("doc_id", "long").add("rest", grouped.schema["rest"].dataType).add("text", "string").add("spans", spans_type)
    out = _with_answers(grouped, told, tasks).applyInArrow(_stripped(True), schema)
    return out.select("doc_id", *[F.col(f"rest.c{k}").alias(c) for k, c in enumerate(rest)], "text", F.col("spans").alias(spans))
