"""Vector searches: learned partitions (approximate) and MaxScore (exact top k).

Both join a query set with all rows in blocks: rows and queries are dealt to blocks of
bounded size by a hash of their id, each pair of blocks that has to meet is one group,
and every group returns at most k rows a query. What a group holds is bounded by the
block sizes, also where one vector makes up a third of all rows.

Rows are sent once for each block of queries and queries once for each block of rows, so
blocks are as large as memory allows (``MOST`` vectors) once there are enough of them for
all tasks.

Cases: vectors that are null, of length zero, or hold a null, a NaN or an infinity take
no part, neither as queries nor as candidates; for the inner product search neither do
vectors of zeros. Shorter vectors count as padded with zeros. Repeated rows with one id
are candidates each (equal ids never match as a query and its own row); ``nearest`` asks
for equal rows of an id and vector once, ``top_k`` for each, as its SQL does. Integer scores
are exact while they are below 2^63 in size; beyond that they aren't defined, as the result
has no room for them. Empty tables give empty results. Other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordflow.llm.shared import settle

#: Rows and queries of a block at least (where there are as many), and at most.
ROWS, QUERIES, MOST = 4096, 1024, 32768


def usable(v: Column, zeros: bool) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fine = v.isNotNull() & (F.size(v) > 0) & fine
    return F.coalesce(fine if zeros else fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column in double precision, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def blocks(n: int, size: int, tasks: int = 1) -> int:
    """How many blocks for n vectors: of ``size`` while there are fewer than tasks, then
    as many as tasks, of up to MOST."""
    return max(1, min(math.ceil(n / size), max(tasks, math.ceil(n / max(size, MOST)))))


def tasks_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def best_of(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query from what its blocks returned: highest score first, ties
    to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to the smaller id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.nonzero(score >= least)[0]
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


# -- exact top-k by MaxScore -------------------------------------------------------------


class Postings:
    """Term-major postings of a block of rows: term -> (rows, weights). A term that at
    least half of the rows hold is one full line of weights."""

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray]):
        self.n = n = len(terms)
        row = np.repeat(np.arange(n), [len(t) for t in terms])
        term = np.concatenate(terms) if n else np.zeros(0, np.int64)
        weight = np.concatenate(weights) if n else np.zeros(0, np.int64)
        by = np.argsort(term, kind="stable")
        term, row, weight = term[by], row[by], weight[by]
        cut = np.nonzero(np.r_[True, term[1:] != term[:-1]])[0] if len(term) else np.zeros(0, np.int64)
        self.sparse: dict[int, tuple] = {}
        self.line: dict[int, int] = {}
        self.high: dict[int, int] = {}
        self.low: dict[int, int] = {}
        lines = []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(term)], strict=True):
            t, w = int(term[a]), weight[a:b]
            whole = b - a == n
            self.high[t] = int(w.max()) if whole else max(0, int(w.max()))
            self.low[t] = int(w.min()) if whole else min(0, int(w.min()))
            if 2 * (b - a) >= n:
                full = np.zeros(n, np.int64)
                full[row[a:b]] = w
                self.line[t] = len(lines)
                lines.append(full)
            else:
                self.sparse[t] = (row[a:b], w)
        self.lines = np.array(lines, np.int64).reshape(len(lines), n)
        #: Products of doubles are exact below 2^53, and far faster than those of integers.
        self.small = self.lines.astype(np.float64) if np.abs(self.lines).max(initial=0) < 1 << 20 else None

    def add(self, terms: list[int], q: dict[int, int], to: np.ndarray, at: np.ndarray | None) -> None:
        """Add the contributions of terms to scores: of all rows, or of those in ``at``."""
        dense = [t for t in terms if t in self.line]
        if dense:
            which, w = [self.line[t] for t in dense], np.array([q[t] for t in dense], np.int64)
            if self.small is not None and np.abs(w).max() < 1 << 20 and len(dense) < 4096:
                m = self.small[which] if at is None else self.small[np.ix_(which, at)]
                to += (w.astype(np.float64) @ m).astype(np.int64)
            else:
                to += w @ (self.lines[which] if at is None else self.lines[np.ix_(which, at)])
        for t in terms:
            if t in self.sparse:
                rows, w = self.sparse[t]
                if at is None:
                    to[rows] += q[t] * w
                else:
                    i = np.minimum(np.searchsorted(rows, at), len(rows) - 1)
                    to += np.where(rows[i] == at, q[t] * w[i], 0)


def max_score(p: Postings, ids: np.ndarray, query_id, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores of the k best rows of a block, for one query. A term adds between
    low and high to a row. Terms are split by what they can add above their low: those
    that together can't lift a row into the k best are not essential. Essential postings
    are traversed for all rows; the others are probed, a few at a time, only for rows
    whose bound still competes."""
    q = {int(t): int(w) for t, w in zip(terms, weights, strict=True) if w and int(t) in p.high}
    bound = {t: (max(w * p.high[t], w * p.low[t]), min(w * p.high[t], w * p.low[t])) for t, w in q.items()}
    order = sorted(q, key=lambda t: bound[t][0] - bound[t][1], reverse=True)
    alive = np.nonzero(ids != query_id)[0]
    if not len(alive):
        return ids[:0], np.zeros(0, np.int64)
    # a first threshold: whole scores of a few rows
    seed = alive[: 8 * k]
    got = np.zeros(len(seed), np.int64)
    p.add(order, q, got, seed)
    floor = int(np.partition(got, len(got) - k)[len(got) - k]) if len(got) >= k else None
    if floor is None:  # fewer rows than asked for: all are returned
        by = top(got, ids[seed], k)
        return ids[seed][by], got[by]
    above = sum(b[1] for b in bound.values())
    rest, split = 0, len(order)
    while split and above + rest + bound[order[split - 1]][0] - bound[order[split - 1]][1] < floor:
        split -= 1
        rest += bound[order[split]][0] - bound[order[split]][1]
    split = max(split, min(8, len(order)))
    score = np.zeros(p.n, np.int64)
    p.add(order[:split], q, score, None)
    score = score[alive]
    for a in range(split, len(order), 8):
        left = sum(bound[t][0] for t in order[a:])
        if len(score) > k:
            least = sum(bound[t][1] for t in order[a:])
            floor = max(floor, int(np.partition(score, len(score) - k)[len(score) - k]) + least)
        keep = score + left >= floor
        alive, score = alive[keep], score[keep]
        p.add(order[a : a + 8], q, score, alive)
    by = top(score, ids[alive], k)
    return ids[alive][by], score[by]


def top_k(docs: DataFrame, queries: DataFrame, k: int, rows: int = ROWS, at_once: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of docs with the highest integer inner
    product with each query. Both tables: id long, terms array<long> (each once a row),
    weights array<long>. A row never answers the query of its own id."""
    n_rows = blocks(docs.count(), rows, tasks_of(docs))
    n_queries = blocks(queries.count(), at_once, math.ceil(tasks_of(docs) / n_rows))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    d = docs.select("id", "terms", "weights", own(n_rows).alias("r"), every(n_queries).alias("q"))
    q = queries.select("id", "terms", "weights", own(n_queries).alias("q"), every(n_rows).alias("r"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            lists = lambda t, c: [np.asarray(x, np.int64) for x in t.column(c).to_pylist()]
            ids = left.column("id").to_numpy()
            p = Postings(lists(left, "terms"), lists(left, "weights"))
            for i, t, w in zip(right.column("id").to_pylist(), lists(right, "terms"), lists(right, "weights"), strict=True):
                found, score = max_score(p, ids, i, t, w, k)
                out.extend(zip([i] * len(found), found.tolist(), score.tolist(), strict=True))
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.int64())})

    hits = d.groupBy("r", "q").cogroup(q.groupBy("r", "q")).applyInArrow(meet, "query_id long, vec_id long, score long")
    return best_of(hits, k)


def quantized(vectors: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, terms, weights: the components of usable vectors as floor(scale * x) of the
    terms 0, 1, ...; zeros are no postings."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(usable(F.col("v"), True) & F.col("id").isNotNull())
    v = v.select("id", F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("w"))
    v = v.select("id", F.filter(F.transform("w", lambda x, i: F.struct(i.cast("long").alias("t"), x.alias("w"))), lambda s: s["w"] != 0).alias("s"))
    return v.select("id", F.col("s.t").alias("terms"), F.col("s.w").alias("weights"))


def quantized_top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    d = settle(quantized(vectors))
    return top_k(d, d.filter(F.col("id") % every == 0), k)


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
 WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.w, d.w)::BIGINT AS score FROM v AS q JOIN v AS d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

# -- approximate nearest neighbours by learned partitions --------------------------------


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k rows with the largest inner product, itself left out."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(s, -k, axis=1)[:, -k:]
    return out


def balanced_parts(graph: np.ndarray, n_parts: int, slack: float, sweeps: int, rng: np.random.Generator) -> np.ndarray:
    """A partition of the graph in which no part has more than (1 + slack) times its
    share: regions grown one after the other from unassigned rows, then sweeps that move
    a row to the part most of its neighbours are in while that part has room."""
    n = len(graph)
    room = math.ceil(n / n_parts * (1 + slack))
    both = [[] for _ in range(n)]
    for i, row in enumerate(graph.tolist()):
        both[i].extend(row)
        for j in row:
            both[j].append(i)
    part, size = np.full(n, -1), np.zeros(n_parts, np.int64)
    free = iter(rng.permutation(n).tolist())
    share = math.ceil(n / n_parts)
    for p in range(n_parts):
        front: list[int] = []
        while size[p] < share:
            i = front.pop(0) if front else next(free, None)
            if i is None:
                break
            if part[i] < 0:
                part[i] = p
                size[p] += 1
                front.extend(j for j in both[i] if part[j] < 0)
    for _ in range(sweeps):
        moved = 0
        for i in rng.permutation(n).tolist():
            votes = np.bincount(part[both[i]], minlength=n_parts) if both[i] else None
            if votes is None:
                continue
            votes = np.where((size < room) | (np.arange(n_parts) == part[i]), votes, -1)
            to = int(votes.argmax())
            if votes[to] > votes[part[i]]:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if moved < n // 200:
            break
    return part


class Router:
    """A small network (one hidden layer) from a vector to its most probable parts."""

    def __init__(self, width: int, hidden: int, n_parts: int, rng: np.random.Generator):
        self.w1, self.b1 = rng.normal(0, math.sqrt(2 / width), (width, hidden)), np.zeros(hidden)
        self.w2, self.b2 = rng.normal(0, math.sqrt(1 / hidden), (hidden, n_parts)), np.zeros(n_parts)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
        """Cross entropy with soft targets (rows of parts' shares), by Adam."""
        names = ("w1", "b1", "w2", "b2")
        m, v, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                h = np.maximum(x[at] @ self.w1 + self.b1, 0)
                z = h @ self.w2 + self.b2
                e = np.exp(z - z.max(axis=1, keepdims=True))
                d = (e / e.sum(axis=1, keepdims=True) - target[at]) / len(at)
                back = d @ self.w2.T * (h > 0)
                g = {"w1": x[at].T @ back, "b1": back.sum(0), "w2": h.T @ d, "b2": d.sum(0)}
                step += 1
                for n in names:
                    m[n] = 0.9 * m[n] + 0.1 * g[n]
                    v[n] = 0.999 * v[n] + 0.001 * g[n] ** 2
                    setattr(self, n, getattr(self, n) - 3e-3 * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8))


def learn(x: np.ndarray, n_parts: int, neighbours: int = 10, hidden: int = 128, epochs: int = 30, seed: int = 7) -> Router:
    """Partition the neighbour graph of a sample and train the router on it; a row's
    target is the shares of parts among its neighbours and itself."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    router = Router(x.shape[1], hidden, n_parts, rng)
    if len(x) > neighbours + 1 and n_parts > 1:
        graph = neighbour_graph(x, neighbours)
        part = balanced_parts(graph, n_parts, 0.05, 8, rng)
        target = np.zeros((len(x), n_parts))
        np.add.at(target, (np.arange(len(x))[:, None], part[graph]), 1 / (neighbours + 1))
        target[np.arange(len(x)), part] += 1 / (neighbours + 1)
        router.fit(x, target, epochs, rng)
    return router


def probes_for(router: Router, x: np.ndarray, asked: np.ndarray, k: int, target: float) -> int:
    """The least number of parts in which rows of x that the router wasn't fitted on
    (numbers ``asked``) find the target share of their k nearest among x."""
    scores = router.scores(x)
    part, n_parts = scores.argmax(axis=1), scores.shape[1]
    place = np.argsort(np.argsort(-scores[asked], axis=1, kind="stable"), axis=1)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    near = np.argpartition(s, -k, axis=1)[:, -k:]
    found = np.sort(np.take_along_axis(place, part[near], axis=1).ravel())
    return int(found[min(len(found) - 1, math.ceil(target * len(found)) - 1)]) + 1


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, n_parts: int | None = None, probes: int | None = None, target: float = 0.95, sample: int = 8192, rows: int = ROWS, at_once: int = QUERIES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by ``every``,
    the k rows with the largest inner product found in the ``probes`` parts that the
    router names. The router is fitted on four fifths of the ``sample`` rows of the
    smallest id hashes, which are collected; the others tell how many probes reach the
    ``target`` recall, where that isn't given; of a sample of fewer than ten times k rows
    that can't be told, and all parts are probed. Every row is indexed under its most
    probable part. A query whose parts hold fewer than k other rows goes on to its next
    ones. On vectors without clusters most parts have to be probed. There are 32 parts up to
    2^17 rows, twice as many for every four times the rows, and at most one for 64 rows of
    the sample."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(usable(F.col("v"), False) & F.col("id").isNotNull())
    taken = v.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    if not taken.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = matrix(taken.column("v"))
    width = x.shape[1]
    own = np.arange(len(x)) % 5 == 0
    if n_parts is None:
        n_parts = min(max(32, sample // 64), 32 << max(0, math.ceil(math.log(max(1, v.count()) / (1 << 17), 4))))
    router = learn(x[~own], n_parts)
    if probes is None:
        few = len(x) < 10 * k
        probes = n_parts if few else probes_for(router, x, np.nonzero(own)[0][:1000], k, target)
    net = (router.w1, router.b1, router.w2, router.b2)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Router.__new__(Router)
        r.w1, r.b1, r.w2, r.b2 = net
        for b in batches:
            s = r.scores(matrix(b.column(1), width)[:, :width])
            parts = np.argsort(-s, axis=1, kind="stable").astype(np.int32)
            parts = [p if i % every == 0 else p[:1] for i, p in zip(b.column(0).to_pylist(), parts, strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(parts, pa.list_(pa.int32()))], ["id", "v", "parts"])

    routed = settle(v.mapInArrow(route, "id long, v array<double>, parts array<int>"))
    indexed = routed.select("id", "v", F.element_at("parts", 1).alias("p"))
    held = {r["p"]: r["n"] for r in indexed.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a part
    asked = routed.filter(F.col("id") % every == 0)
    # parts up to the first that makes up k rows besides the query's own
    size = F.create_map(*[F.lit(x) for p in held for x in (p, held[p])])
    counted = asked.groupBy(F.col("id").alias("its_id")).agg(F.count(F.lit(1)).alias("own"))
    asked = asked.dropDuplicates(["id", "v"]).join(counted, F.col("id") == F.col("its_id"))
    sums = F.transform("parts", lambda p, i: F.aggregate(F.slice("parts", F.lit(1), i + 1), F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.try_element_at(size, x), F.lit(0))))
    enough = F.size(F.filter(sums, lambda n: n < F.col("own") + k)) + 1
    queries = asked.select(F.col("id").alias("asked"), F.col("v").alias("w"), F.explode(F.slice("parts", F.lit(1), F.greatest(F.lit(probes), enough))).alias("p"))
    tasks = tasks_of(vectors)
    n_rows = {p: blocks(n, rows, math.ceil(tasks / len(held))) for p, n in held.items()}
    n_queries = {r["p"]: blocks(r["n"], at_once) for r in queries.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    both = [p for p in n_rows if p in n_queries]
    if not both:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    per = F.create_map(*[F.lit(x) for p in both for x in (p, n_rows[p])]), F.create_map(*[F.lit(x) for p in both for x in (p, n_queries[p])])
    dealt = lambda n, p: F.pmod(F.xxhash64("id"), n[p]).cast("int")
    every_of = lambda n, p: F.explode(F.sequence(F.lit(0), n[p] - 1))
    p = F.col("p")
    left = indexed.filter(p.isin(both)).select("id", "v", "p", dealt(per[0], p).alias("r"), every_of(per[1], p).alias("q"))
    right = queries.filter(p.isin(both)).select("asked", "w", "p", F.pmod(F.xxhash64("asked"), per[1][p]).cast("int").alias("q"), every_of(per[0], p).alias("r"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[pd.DataFrame] = []
        if left.num_rows and right.num_rows:
            a, b = matrix(left.column("v")), matrix(right.column("w"))
            w = max(a.shape[1], b.shape[1])
            a, b = matrix(left.column("v"), w), matrix(right.column("w"), w)
            ids, asked = left.column("id").to_numpy(), right.column("asked").to_numpy()
            for at in range(0, len(b), 256):
                rough = b[at : at + 256] @ a.T
                rough[asked[at : at + 256][:, None] == ids[None, :]] = -np.inf
                for i, s in enumerate(rough):
                    near = np.nonzero(s > -np.inf)[0]
                    if len(near) > k:  # within rounding of the k-th; then each product by itself
                        least = np.partition(s, len(s) - k)[len(s) - k]
                        near = np.nonzero(s >= least - 1e-9 * max(1.0, abs(least)))[0]
                    exact = (a[near] * b[at + i]).sum(axis=1)
                    by = top(exact, ids[near], k)
                    out.append(pd.DataFrame({"query_id": asked[at + i], "vec_id": ids[near][by], "score": exact[by]}))
        if not out:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return pa.Table.from_pandas(pd.concat(out), preserve_index=False)

    hits = left.groupBy("p", "r", "q").cogroup(right.groupBy("p", "r", "q")).applyInArrow(meet, "query_id long, vec_id long, score double")
    return best_of(hits, k)
