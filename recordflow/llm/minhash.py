"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Every text becomes its set of 5-word shingles (64-bit hashes); rows with equal sets
   form a class, represented by its smallest id. Only classes go on.
2. Signatures of ``BANDS * ROWS`` hashes are cut into bands; classes that agree in a band
   share a bucket. At a similarity of 0.75 a pair misses all 32 bands of 4 with a
   probability of 5e-6.
3. Buckets are resolved in three rounds, with components after each, and no round compares
   what is in one component already: every class with the least member of all its buckets;
   then with the least member of each of its buckets; and at last the rest of each bucket
   that still holds several components. The rest is dealt to pairs of blocks of bounded
   bytes, where members are compared side by side, and a task hands out a forest of
   verified links: never more than it has members, however many pairs it has compared.
4. A compared pair is verified in batches of signature hashes. After n hashes with m
   matches, a uniform prior gives P(similarity >= 0.75) = P(Binomial(n + 1, 0.75) <= m);
   below ``MISS`` the pair is pruned, as it is if the sizes of the sets rule a link out.
   Survivors are verified exactly, on full sets.
5. Verified links are joined to connected components by star contraction.

Cases: null texts and texts without words have no shingles, are linked with nothing and
kept; texts of one to four words have one shingle; rows that share an id are one
document; rows with a null id are compared like others, under a hash of their set; they
have the component of a document with an id if they are linked with one, and else none,
where one row of each group is kept; an empty table gives an empty result; texts are read
whole; other columns are not touched, those in ``carried`` are handed through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.llm.graphs import components
from recordflow.llm.shared import among, scratch, settle, trim

WORDS, BANDS, ROWS, MISS = 5, 32, 4, 1e-6
#: Similarity that links, as a fraction.
OVER, UNDER = 75, 100
#: Members of a block at most, and bytes of their signatures and sets, both on average.
BLOCK, BLOCK_BYTES = 2048, 32 << 20
_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as they were needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.up) < n:
            k = len(cls.up)
            inverse = pow(pow(_BASE, -1, 1 << 64), k, 1 << 64)
            cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(_BASE, k, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * np.uint64(inverse)])
        return cls.up[:n], cls.down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words of a text, A-Z lower-cased
    and cut at ASCII white space; of a shorter text, the hash of all its words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    n = min(n, len(words))
    found = []
    for a in range(0, len(words) - n + 1, 1 << 15):
        part = words[a : a + (1 << 15) + n - 1]
        raw = np.frombuffer(b" ".join(part), np.uint8)
        up, down = Powers.to(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[:-1], out=total[1:])
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        first, last = starts[: len(part) - n + 1], ends[n - 1 :]
        found.append((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    return np.unique(mixed(np.concatenate(found)))


def signature(s: np.ndarray) -> np.ndarray:
    """Least values of the hash family over a set, the high half of each."""
    low = np.full(len(_A), np.iinfo(np.uint64).max)
    for i in range(0, len(s), 1024):
        np.minimum(low, ((s[i : i + 1024, None] ^ _B) * _A).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


@lru_cache
def least_matches(first: int, last: int, batch: int) -> dict[int, int]:
    """After how many hashes at least how many matches keep a pair."""
    t = OVER / UNDER
    out = {}
    for n in range(first, last + 1, batch):
        m, p = -1, 0.0
        while p < MISS:
            m += 1
            p += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def competing(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Of pairs of signatures (rows of both) with set sizes, which survive all batches."""
    alive = np.nonzero(UNDER * np.minimum(n_left, n_right) >= OVER * np.maximum(n_left, n_right))[0]
    seen, done = np.zeros(len(alive), np.int64), 0
    for n, m in least_matches(32, left.shape[1], 32).items():
        seen = seen + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        keep = seen >= m
        alive, seen, done = alive[keep], seen[keep], n
    return alive


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        trim()
        n, one, two, sig = [], [], [], []
        for t in b.column(1).to_pylist():
            s = shingles(t)
            h = xxhash.xxh3_128_intdigest(s.tobytes())
            n.append(len(s))
            one.append((h >> 64) - (1 << 63))
            two.append((h & (1 << 64) - 1) - (1 << 63))
            sig.append(signature(s).tobytes() if len(s) else b"")
        yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.binary()), *b.columns[2:]], ["doc_id", "n_shingles", "k1", "k2", "sig", *b.schema.names[2:]])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts under the key that their class has if it has no id."""
    for b in batches:
        keys = [(xxhash.xxh3_128_intdigest(shingles(t).tobytes()) >> 64) - (1 << 63) for t in b.column(1).to_pylist()]
        yield pa.record_batch([pa.array(keys, pa.int64()), b.column(1)], ["doc_id", "text"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of texts in the order of their ids, repeated ones once."""
    last, seen = None, set()
    for b in batches:
        trim()
        out: list[tuple] = []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if i != last:
                last, seen = i, set()
            if t in seen:
                continue
            seen.add(t)
            s = shingles(t)
            out.append((i, (xxhash.xxh3_128_intdigest(s.tobytes()) >> 64) - (1 << 63), s.view(np.int64)))
        if out:
            ids, keys, sets = zip(*out, strict=True)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "k1", "s"])


def _matrix(column, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y, p, q = b.columns[2:]
        keep = pa.array(competing(_matrix(x, "<u4"), _matrix(y, "<u4"), p.to_numpy(), q.to_numpy()))
        yield pa.record_batch([b.column(0).take(keep), b.column(1).take(keep)], ["a", "b"])


class Block:
    """A pair of blocks (columns i, j, r) of one bucket, side by side."""

    def __init__(self, group: pa.Table):
        one = lambda c: group.column(c)[0].as_py()
        self.i, self.j, self.band = one("i"), one("j"), one("band")
        keys = np.stack([group.column(c).to_numpy() for c in ("rep", "k1")])
        kept = np.sort(np.unique(keys, axis=1, return_index=True)[1])
        if len(kept) < len(group):  # sets that several tasks have read
            group = group.take(pa.array(kept))
        self.group = group
        self.rep, self.comp, self.n, r = (group.column(c).to_numpy() for c in ("rep", "comp", "n", "r"))
        self.sig = _matrix(group.column("sig"), "<u4")
        self.left, self.right = np.nonzero(r == self.i)[0], np.nonzero(r == self.j)[0]

    def partners(self, x: int, root: np.ndarray) -> np.ndarray:
        """Members that survive all batches with x, have another root, and share with it
        no band before this one (whose bucket compares those that do)."""
        y = self.right if self.i != self.j else self.right[np.searchsorted(self.right, x, "right") :]
        n = self.n[y]
        y = y[(root[y] != root[x]) & (UNDER * np.minimum(n, self.n[x]) >= OVER * np.maximum(n, self.n[x]))]
        y = y[competing(np.broadcast_to(self.sig[x], (len(y), self.sig.shape[1])), self.sig[y], self.n[y], self.n[y])] if len(y) else y
        return y[(self.sig[y] == self.sig[x]).reshape(len(y), BANDS, ROWS).all(axis=2).argmax(axis=1) == self.band] if len(y) else y


def _contenders(group: pa.Table) -> pa.Table:
    """Members of a pair of blocks that survive with any other."""
    block = Block(group)
    found = np.zeros(len(block.rep), bool)
    for x in block.left.tolist():
        y = block.partners(x, block.comp)
        found[y] = True
        found[x] |= len(y) > 0
    return block.group.select(["bucket", "band", "i", "j", "r", "rep", "k1", "comp"]).filter(pa.array(found))


def _forest(group: pa.Table) -> pa.Table:
    """Verified links between components in a pair of blocks, none that closes a circle."""
    block = Block(group)
    sets = block.group.column("s").combine_chunks()
    values = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    numbers, begin = values[1], np.r_[0, np.cumsum(block.n)]
    marked, root, links = np.zeros(len(values[0]), bool), block.comp.copy(), []
    for x in block.left.tolist():
        y = block.partners(x, root)
        if not len(y):
            continue
        own = numbers[begin[x] : begin[x + 1]]
        marked[own] = True
        for z in y.tolist():
            if root[z] != root[x]:
                shared = int(marked[numbers[begin[z] : begin[z + 1]]].sum())
                if UNDER * shared >= OVER * (block.n[x] + block.n[z] - shared):
                    links.append((block.rep[x], block.rep[z]))
                    root[root == root[z]] = root[x]
        marked[own] = False
    low, high = np.sort(np.array(links, np.int64).reshape(-1, 2), axis=1).T
    return pa.table({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64())})


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()


def with_ends(pairs: DataFrame, facts: DataFrame, *names: tuple[str, str, str]) -> DataFrame:
    """pairs with what facts (id and others) has of both ends: (column, as of a, as of b)."""
    for side, at in (("a", 1), ("b", 2)):
        pairs = pairs.hint("merge").join(facts.select(F.col("id").alias(side), *[F.col(n[0]).alias(n[at]) for n in names]), side)
    return pairs


def sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """id, k1, s: the full sets of ids; one row for each different text of an id (but for
    texts of one id that several tasks meet, which may come once from each)."""
    return among(docs.select(F.col("doc_id").alias("id"), "text"), "id", ids).sortWithinPartitions("id").mapInArrow(_sets, "id long, k1 long, s array<long>")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose full sets reach the similarity."""
    pairs = settle(pairs)
    sets = settle(sets_of(ends(pairs), docs))
    shared = F.size(F.array_intersect("x", "y"))
    return with_ends(pairs, sets, ("s", "x", "y")).filter(UNDER * shared >= OVER * (F.size("x") + F.size("y") - shared)).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and columns carried; one row per row of docs."""
    with scratch(docs.sparkSession) as kept:
        return _near_duplicates(docs, id_col, text_col, carried, kept)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, carried: tuple[str, ...], still_read: list) -> DataFrame:
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carried)
    rows = docs.mapInArrow(_sketches, f"doc_id long, n_shingles long, k1 long, k2 long, sig binary{kinds}")
    rows = settle(rows.withColumn("__row", F.monotonically_increasing_id()))
    docs = docs.select("doc_id", "text")
    classes = rows.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.min("__row").alias("first"))
    classes = settle(classes.withColumn("rep", F.coalesce("least", "k1")))
    without = not classes.filter("least is null").isEmpty()
    if without:  # of each set one text
        docs = docs.filter("doc_id is not null").unionAll(settle(docs.filter("doc_id is null and text is not null").mapInArrow(_keyed, "doc_id long, text string").dropDuplicates(["doc_id"])))
    known = classes.select(F.col("rep").alias("id"), "k1", "n", "sig")
    width = 4 * ROWS
    banded = known.select("id", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    banded = banded.select(F.col("id").alias("rep"), "n", "band", F.xxhash64("band", F.substr("sig", F.col("band") * width + 1, F.lit(width))).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("low")).filter("size > 1")
    members = settle(banded.hint("merge").join(shared, "bucket").select("bucket", "band", "rep", "n", "low", "size"))

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs.distinct())
        facts = among(known, "id", ends(pairs))
        pairs = with_ends(pairs, facts, ("sig", "x", "y"), ("n", "p", "q")).select("a", "b", "x", "y", "p", "q").mapInArrow(_survivors, "a long, b long")
        return settle(verified(pairs, docs))

    def placed(rows: DataFrame, comps: DataFrame) -> DataFrame:
        return rows.hint("merge").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")

    first = settle(members.filter("low < rep").groupBy("rep").agg(F.min("low").alias("first")))
    links = linked(first.select(F.col("first").alias("a"), F.col("rep").alias("b")))
    left = placed(members.hint("merge").join(first, "rep", "left"), settle(components(links)))
    tops = left.filter("rep = low").select("bucket", F.col("comp").alias("top"))
    left = left.filter("low < rep and low <> first").hint("merge").join(tops, "bucket").filter("comp <> top")
    links = links.unionAll(linked(left.select(F.col("low").alias("a"), F.col("rep").alias("b"))))

    left = settle(placed(members.filter("low < rep and size > 2"), settle(components(links))))  # members of a bucket but for its least
    mixed_ones = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("open"), F.sum(F.col("n") * 8 + 4 * BANDS * ROWS).alias("bytes"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2")
    mixed_ones = mixed_ones.select("bucket", F.ceil(F.greatest(F.col("open") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    left = left.hint("merge").join(mixed_ones, "bucket")
    left = left.withColumn("r", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("bucket", "band", F.least("r", "o").alias("i"), F.greatest("r", "o").alias("j"), "r", "rep", "comp")
    facts = known.withColumnRenamed("id", "rep")
    found = settle(left.hint("merge").join(facts, "rep").groupBy("bucket", "i", "j").applyInArrow(_contenders, "bucket long, band int, i int, j int, r int, rep long, k1 long, comp long"))
    sets = sets_of(found.select(F.col("rep").alias("id")).distinct(), docs).withColumnRenamed("id", "rep")
    sets = sets.hint("merge").join(facts, ["rep", "k1"])
    links = links.unionAll(found.hint("merge").join(sets, ["rep", "k1"]).groupBy("bucket", "i", "j").applyInArrow(_forest, "a long, b long").distinct())
    comps = settle(components(links))
    still_read += [rows, classes, comps]
    named = classes.hint("merge").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("k1", "k2", "least", "first", F.coalesce("component", "rep").alias("component"))
    first = F.lit(None).cast("long").alias("first")
    if without:  # components are named by ids only
        names = named.groupBy("component").agg(F.min("least").alias("name"), F.min("first").alias("first"))
        named = named.drop("first").join(names, "component").select("k1", "k2", F.col("name").alias("component"), "first")
    else:
        named = named.select("k1", "k2", "component", first)
    out = rows.drop("sig").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    kept = F.when((F.col("n_shingles") > 0) & F.col("component").isNull(), F.col("__row") == F.col("first")).otherwise(F.col("doc_id").eqNullSafe(component))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), *carried)
