"""Searches against brute force."""

import math

import numpy as np

from recordflow.llm import vectors
from recordflow.llm.queries import QUERIES


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as p", "2 as q", "'x' as score", "0 as id")


def brute(ids, x, asked, k):
    out = {}
    for i, q in asked:
        s = [(-float((q * v).sum()), j) for j, v in zip(ids, x, strict=True) if j != i]
        out[i] = [(j, -s) for s, j in sorted(s)[:k]]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    v = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in v], np.array([r["embedding"] for r in v], np.float64)
    want = brute(ids, x, [(i, q) for i, q in zip(ids, x, strict=True) if i % 20 == 0], 20)
    got = by_query(QUERIES["op6_learned_partitions"](spark, sf).collect())
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert hits / (20 * len(want)) >= 0.9
    at = dict(zip(ids, x, strict=True))
    assert all(abs(s - float((at[i] * at[j]).sum())) < 1e-12 for i, g in got.items() for j, s in g)


def test_nearest_odd(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=4).tolist()) for i in range(0, 200)] + [(1000 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(60)]
    bad = [(2000, None), (2020, []), (2040, [0.0, 0.0, 0.0, 0.0]), (2060, [1.0, None, 0.0, 0.0]), (2080, [float("nan"), 0.0, 0.0, 0.0]), (2100, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    got = by_query(vectors.nearest(frame(spark, rows + bad), n_parts=4, probes=4, k=5, rows=50, at_once=3).collect())
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    want = brute([i for i, _ in rows], x, [(i, q) for (i, _), q in zip(rows, x, strict=True) if i % 20 == 0], 5)
    assert {i: [j for j, _ in g] for i, g in got.items()} == {i: [j for j, _ in g] for i, g in want.items()}
    assert vectors.nearest(frame(spark, bad)).count() == 0 and vectors.nearest(frame(spark, [])).count() == 0
    few = by_query(vectors.nearest(frame(spark, [(0, [1.0]), (1, [2.0, 3.0])]), k=20).collect())
    assert few == {0: [(1, 2.0)]}


def test_repeated_queries_are_asked_once(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=4).tolist()) for i in range(1, 60)]
    asked = (100, [1.0, 2.0, 0.0, -1.0])
    got = by_query(vectors.nearest(frame(spark, rows + [asked] * 7).filter("vec_id % 20 <> 0 or vec_id = 100"), n_parts=2, probes=2, k=5).collect())
    x = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i % 20]
    want = brute([i for i, _ in x], [v for _, v in x], [(100, np.array(asked[1]))], 5)
    assert {i: [j for j, _ in g] for i, g in got.items()} == {i: [j for j, _ in g] for i, g in want.items()}


def test_balanced_parts():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(c, 0.1, (100, 8)) for c in (-2, 0, 2, 4)])
    part = vectors.balanced_parts(vectors.neighbour_graph(x, 5), 8, 0.05, 8, r)
    assert np.bincount(part, minlength=8).max() <= 53 and part.min() >= 0


def test_max_score_equals_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=12).tolist()) for i in range(300)] + [(300 + i, [0.5] * 12) for i in range(40)] + [(400, [0.0] * 12), (450, None), (500, [1.0, float("nan")]), (550, [3.0, -1.0]), (600, [])]
    got = by_query(vectors.top_k(vectors.quantized(frame(spark, rows)), vectors.quantized(frame(spark, rows)).filter("id % 50 = 0"), 5, rows=64, at_once=4).collect())
    good = [(i, np.floor(256 * np.pad(np.array(v, np.float32).astype(np.float64), (0, 12 - len(v))))) for i, v in rows if v and not any(x != x for x in v)]
    want = brute([i for i, _ in good], [v for _, v in good], [(i, v) for i, v in good if i % 50 == 0], 5)
    assert got == want
    assert vectors.quantized_top_k(frame(spark, [])).count() == 0


def test_max_score_on_sparse_postings():
    """Lists of terms of which each row holds few."""
    r = np.random.default_rng(5)
    for _ in range(30):
        n, terms = int(r.integers(1, 60)), 30
        rows = [np.sort(r.choice(terms, int(r.integers(0, 8)), replace=False)) for _ in range(n)]
        weights = [r.integers(-5, 9, len(t)) for t in rows]
        p, ids = vectors.Postings(rows, weights), r.permutation(n)
        qt = np.sort(r.choice(terms, 6, replace=False))
        qw = r.integers(-3, 6, 6)
        full = np.zeros((n, terms), np.int64)
        for k, (t, w) in enumerate(zip(rows, weights, strict=True)):
            full[k, t] = w
        score = full[:, qt] @ qw
        want = sorted((-int(s), int(i)) for s, i in zip(score, ids, strict=True))[:4]
        found, got = vectors.max_score(p, ids, -1, qt, qw, 4)
        assert [(-int(s), int(i)) for i, s in zip(found, got, strict=True)] == want


def test_nearest_goes_on_to_further_parts(spark):
    """With one probe, queries of small parts still get k rows, or all there are."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(20, [float(a) for a in x[20]])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (20, 100):
        got = vectors.nearest(df, k=k, probes=1, n_parts=16).groupBy("query_id").count().collect()
        assert {r["query_id"]: r["count"] for r in got if r["query_id"] != 20} == dict.fromkeys((0, 40), min(k, 62))
        assert {r["count"] for r in got if r["query_id"] == 20} == {min(k, 59)}


def test_blocks():
    assert [vectors.blocks(n, 4096, 50) for n in (0, 1, 4096, 4097, 4096 * 40, 4096 * 60, 32768 * 50, 32768 * 70)] == [1, 1, 1, 2, 40, 50, 50, 70]


def test_large_components(spark):
    """Exact integer scores close to 2^62."""
    rows = [(0, [2.0**22, -1.5]), (1, [2.0**22, 3.0]), (2, [-(2.0**22), 0.25]), (50, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    w = {i: [math.floor(256 * c) for c in v] for i, v in rows}
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in vectors.quantized_top_k(df).collect()}
    assert got == {(q, d): sum(a * b for a, b in zip(w[q], w[d], strict=True)) for q in (0, 50) for d in w if d != q}
