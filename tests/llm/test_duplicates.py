"""Near duplicates and repeated passages against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from recordflow.llm import graphs, minhash, repeats
from recordflow.llm.queries import QUERIES


def components(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in at[s]:
                shared[j] += 1
            at[s].append(i)
        for j, m in shared.items():
            if 100 * m >= 75 * (len(sets[i]) + len(sets[j]) - m):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def variants(seed=4):
    """Chains and stars of near copies, exact copies, pairs around the threshold."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    docs = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([4, 12, 40, 120]))]
        docs.append(base)
        for _ in range(r.randint(0, 6)):
            near = list(r.choice([base, docs[-1]]))
            for _ in range(r.randint(0, max(1, len(near) // 30))):
                near[r.randrange(len(near))] = word()
            docs.append(near)
    texts = [" ".join(d) for d in docs]
    texts += [texts[5].upper(), texts[5].replace(" ", "\n\t"), None, "", "  ", "one", "One", "one two", "é É"]
    order = list(range(len(texts)))
    r.shuffle(order)
    return [(i * 3, texts[k]) for i, k in enumerate(order)]


def test_near_duplicates(table):
    docs = variants()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(table(docs)).collect()}
    want = components(docs)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_near_duplicates_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op7_minhash"](spark, sf).collect()}
    assert got == components(docs)


def test_near_duplicates_odd(table):
    assert minhash.near_duplicates(table([])).count() == 0
    rows = minhash.near_duplicates(table([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None), (9, None)])).collect()
    assert sorted(((r["doc_id"] or -1), r["component_id"], r["kept"]) for r in rows if r["n_shingles"]) == [(-1, 4, False), (4, 4, True), (4, 4, True)]
    assert sorted(((r["doc_id"] or -1), r["component_id"], r["kept"]) for r in rows if not r["n_shingles"]) == [(-1, None, True), (9, 9, True)]


def test_near_duplicates_without_ids(table):
    words = [f"w{i}" for i in range(60)]
    near, other = [*words[:30], "new", *words[31:]], [f"v{i}" for i in range(40)]
    docs = [(None, " ".join(w)) for w in (words, words, near, other, other, [*other, "end"])] + [(None, " ".join(f"u{i}" for i in range(9))), (7, "v " * 9), (5, " ".join([*other, "tail"]))]
    rows = [tuple(r) for r in minhash.near_duplicates(table(docs)).collect()]
    assert sorted(r[1:] for r in rows if r[0] is None and r[2] is None) == [(5, None, True), *[(56, None, False)] * 2, (56, None, True)]
    assert sorted(r[1:] for r in rows if r[0] is None and r[2]) == [(36, 5, False), (36, 5, False), (37, 5, False)]
    assert sorted(r for r in rows if r[0]) == [(5, 37, 5, True), (7, 1, 7, True)]


def test_pruning_keeps_links():
    """Pairs of just the linking similarity survive all batches."""
    r = np.random.default_rng(1)
    for _ in range(200):
        n = int(r.integers(40, 400))
        shared = -(-3 * n // 4)
        pool = r.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n - shared :])
        union = len(set(a.tolist()) | set(b.tolist()))
        if 100 * len(set(a.tolist()) & set(b.tolist())) >= 75 * union:
            x, y = (minhash.signature(v)[None] for v in (a, b))
            assert len(minhash.competing(x, y, np.array([len(a)]), np.array([len(b)]))) == 1


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(50)] + [(5, 5), (7, 8), (7, 8)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {tuple(x) for x in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(n, find(n)) for n in list(parent)}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def stripped(docs, length=50):
    """Removal by a dictionary of all strings."""
    first, out = {}, {}
    rows = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            f = first[b[k : k + length]]
            if f != i and (i is None or f is not None and f < i):
                gone[k] += 1
                gone[k + length] -= 1
        g = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.r_[0, g.astype(int)]) == 1).sum())
        out.setdefault((i, t), (len(b), int(g.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()))
    return out


def passages(seed=6):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeéß", k=r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30) for _ in range(4)] + ["ab" * 60, "x" * 130]
    docs = []
    for i in range(40):
        parts = [text(r.randint(0, 25))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, len(s) // 2)
            parts += [s[a : a + r.randint(20, len(s))], text(r.randint(0, 10))]
        docs.append((i * 7 % 41, "".join(parts)))
    return docs + [(90, docs[3][1]), (91, None), (92, ""), (93, "short"), (94, "x" * 3000), (95, "x" * 49)]


@pytest.mark.parametrize("shard,crowd", [(repeats.SHARD, repeats.CROWD), (2000, 32), (repeats.SHARD, 1), (2000, 3)])
def test_repeats(table, shard, crowd):
    docs = passages()
    want = stripped(docs)
    for r in repeats.digests(table(docs), shard, crowd).collect():
        text = dict(docs)[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"], text]


def test_repeats_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = stripped(docs)
    rows = QUERIES["op5_suffix_array"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"], dict(docs)[r["doc_id"]]]


def test_repeats_odd(table):
    assert repeats.digests(table([])).count() == 0
    p = "".join(chr(97 + i % 23) + str(i) for i in range(60))
    rows = repeats.digests(table([(3, p), (3, p), (None, p), (2, "zz" + p)])).collect()
    assert sorted((r["doc_id"] or 99, r["n_removed"]) for r in rows) == [(2, 0), (3, len(p)), (3, len(p)), (99, len(p))]
    kept = {r["doc_id"]: r for r in repeats.strip(table([(1, "é" + p), (2, "ü" + p + "!")])).collect()}
    assert kept[2]["text"] == "ü!" and kept[2]["component"] == "x" and [tuple(s) for s in kept[2]["spans"]] == [(2, 2 + len(p))]


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(3)
    for n, letters in ((1, 1), (60, 1), (300, 2), (4000, 3)):
        raw = r.integers(97, 97 + letters, n).astype(np.uint8)
        b = raw.tobytes()
        sa, _ = repeats.suffix_array(raw, 50)
        keys = [b[i : i + 50] for i in sa]
        assert sorted(sa.tolist()) == list(range(n)) and keys == sorted(keys)
        lcp = repeats.common_prefixes(raw, sa, 50)
        for k in range(1, n):
            x, y = keys[k], keys[k - 1]
            m = 0
            while m < min(len(x), len(y)) and x[m] == y[m]:
                m += 1
            assert lcp[k] == m


def copies(n, seed=9):
    """Near copies of a text that isn't among them, most pairs just under the threshold and
    some just over it."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    docs = []
    for i in range(n):
        words = list(base)
        for k in r.sample(range(150), 3):
            words[k] = f"x{i}_{k}"
        docs.append((i * 7 % n, " ".join(words)))
    return docs


def test_large_group_of_near_copies(table, monkeypatch):
    """Components are those of all pairs, and each task hands out a forest, not pairs."""
    docs = copies(1200)
    words = {i: t.split() for i, t in docs}
    number = {}
    sets = np.zeros((len(docs), 150 * 5 + 1), np.float32)
    rare = np.zeros(len(docs))
    for i, w in words.items():
        for k in range(146):
            s = tuple(w[k : k + 5])
            if any(x.startswith("x") for x in s):
                rare[i] += 1  # in no other document
            else:
                sets[i, number.setdefault(s, len(number))] = 1
    shared = sets @ sets.T
    union = 2 * 146 - shared
    label = np.arange(len(docs))
    while True:
        least = np.where(100 * shared >= 75 * union, label, len(docs)).min(axis=1)
        if (least == label).all():
            break
        label = least
    assert 2 <= len(set(label)) <= 900, len(set(label))
    monkeypatch.setattr(minhash, "BLOCK", 100)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table(docs)).collect()}
    assert got == dict(enumerate(label.tolist()))


@pytest.mark.parametrize("n", [200, 800])
def test_forest_is_no_larger_than_its_block(n):
    docs = copies(n)
    sets = [minhash.shingles(t) for _, t in docs]
    group = pa.table({"bucket": [0] * n, "band": [0] * n, "i": [0] * n, "j": [0] * n, "r": [0] * n, "rep": range(n), "k1": range(n), "comp": range(n), "n": [len(s) for s in sets], "sig": [minhash.signature(s).tobytes() for s in sets], "s": [s.view(np.int64) for s in sets]})
    pairs = minhash._forest(group)
    assert 0 < len(pairs) < n
    found = set(minhash._contenders(group).column("rep").to_pylist())
    assert found >= {x for c in ("a", "b") for x in pairs.column(c).to_pylist()}


def test_repeated_ids_and_hot_rows(table):
    """An id with two texts, and many rows of one text."""
    a, b = [f"a{i}" for i in range(40)], [f"c{i}" for i in range(40)]
    docs = [(3, " ".join(a))] * 200 + [(5, " ".join([*a, "z"])), (4, " ".join(b)), (4, " ".join([*b, "y"])), (8, " ".join([*b, "y", "u"])), (9, " ".join([*a, "z"]))]
    got = minhash.near_duplicates(table(docs)).collect()
    assert len(got) == len(docs)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(3, 3, True), (5, 3, False), (4, 4, True), (8, 4, False), (9, 3, False)}


def test_repeats_in_stretches(table, monkeypatch):
    """Anchors don't depend on how a run of texts is cut into stretches."""
    texts = [(t or "").encode() for _, t in passages()]
    whole = repeats.Slices(texts)
    for stretch in (1, 7, 50, 64, 1000):
        monkeypatch.setattr(repeats, "STRETCH", stretch)
        cut = repeats.Slices(texts)
        for name in ("start", "count", "text", "anchor", "content"):
            assert (getattr(cut, name) == getattr(whole, name)).all()


def test_repeats_many_groups_and_clashing_names(table, spark, monkeypatch):
    """Groups by bytes; columns named like those of the operator come back as they were."""
    monkeypatch.setattr(repeats, "GROUP_BYTES", 300)
    docs = passages()
    want = stripped(docs)
    for r in repeats.digests(table(docs)).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"], dict(docs)[r["doc_id"]]]
    df = table(docs).selectExpr("*", "'s' as __g", "'t' as Spans", "array(1) as rest", "struct(1 as c0, 2 as C0) as `a.b`")
    got = repeats.strip(df, spans="where")
    assert got.columns == ["doc_id", *[c for c in df.columns if c not in ("doc_id", "text")], "text", "where"]
    r = got.filter("doc_id = 94").first()
    assert (r["__g"], r["Spans"], r["rest"], r["g"], tuple(r["a.b"])) == ("s", "t", [1], "x", (1, 2))


def test_equal_hashes_are_not_trusted():
    """Copies are compared byte by byte; a difference stops the job."""
    a, b = "".join(chr(97 + i * i % 26) for i in range(300)).encode(), bytes(97 + i * 7 % 26 for i in range(300))
    s = repeats.Slices([a, b, a])
    of = [np.nonzero(s.text == i)[0] for i in range(3)]
    s.verify(of[2], of[0])
    with pytest.raises(RuntimeError, match="hash"):
        s.verify(of[1][:1], of[0][:1])
    rows = [{"kind": repeats.WITNESS, "d": b"aaaaa", "c": b"cccccc", "m": x * 16} for x in (b"x", b"y")]
    assert len(repeats._witnesses(pa.Table.from_pylist(rows[:1]))) == 1
    with pytest.raises(RuntimeError, match="hash"):
        repeats._witnesses(pa.Table.from_pylist(rows))


def test_tables_between_steps_are_removed(table, spark):
    from recordflow.llm import shared

    before = set(shared._made)
    df = minhash.near_duplicates(table(variants()))
    left = set(shared._made) - before
    assert len(left) == 3  # what the result is read from
    assert df.count() == df.count() > 0
    assert graphs.components(spark.createDataFrame([(1, 2)], "a long, b long")).count() == 2
