"""License scans, URL filters and toxicity."""

import math
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from recordflow.llm import licenses, toxicity, urls
from recordflow.llm.queries import ORACLE_SQL, QUERIES


def sql_rows(con, sql, columns):
    return sorted(map(list, con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    assert sorted(map(list, df.collect()), key=repr) == sql_rows(con, ORACLE_SQL[name], df.columns)


GRANT = licenses.TEMPLATES[1][1]
TEXTS = [
    (1, "Released under the MIT License."), (2, None), (3, ""), (4, "x " * 70 + "Licensed under the Apache License,\nVersion 2.0! under the MIT license under the mit license"), (5, "cc-by-nc cc by  NC; CC BY"),
    (6, "Under the Mİt license; under\u212athe mit license \u212a"), (7, ("pad " * 50) + GRANT.replace("charge", "money") + " tail" * 90), (8, "permission is granted to nobody"), (9, "mit license the under"), (9, "mit license the under"), (None, "under the mit license"), (None, ("pad " * 9) + GRANT), (None, GRANT.upper()), (9, GRANT), (10, "é" * 5000 + " under the mit license"),
]


def test_licenses(table, spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", TEXTS)
    df = licenses.scan(table(TEXTS))
    rows = sorted(map(list, df.collect()), key=repr)
    assert rows == sql_rows(con, licenses.sql(), df.columns)
    by = {r[0]: r for r in rows if r[0] not in (9, None)}
    assert by[4][2:7] == [3, 73, 82, "apache-2,mit", "apache-2,mit"] and by[7][6] == "mit" and by[7][2] == 0 and 0.9 <= by[7][7] < 1 and by[8][6] == ""
    assert licenses.scan(table([])).count() == 0


def test_rarest_tokens_come_first():
    index = licenses.template_index([("a", "the rare word"), ("b", "the other")], {"the": 9, "word": 2, "other": 5}, 0.6)
    assert index[0]["tokens"] == ["rare", "word", "the"] and index[0]["least"] == 2 and index[0]["prefix"] == ["rare", "word"]


PAGES = [
    (1, "http://a.com/en/1?x=1#y", None), (2, "HTTP://A.example.COM/en/77", ""), (3, "https://b.net/de/x", '<link rel="canonical" href="/fr/x">'), (4, "https://b.net/fr/x", None),
    (5, "https://q.dev/alias", "<LINK href='https://b.net/fr/x' REL=canonical>"), (6, None, None), (7, "no scheme", "<link rel=canonical href='http://a.com/en/1'>"), (8, "ftp://q.dev", '<meta http-equiv="refresh" content="0; url=alias">'),
    (9, "http://r.dev/p/one.html?z", '<meta http-equiv=refresh content="1;URL=//s.dev/two">'), (10, "http://s.dev/two", '<link rel="canonical" href="http://x.example.com/en/7">'), (11, "http://t.dev/", '<link rel="canonical" href="http://r.dev/p/one.html"><link rel="canonical" href="https://z.org/es/1">'),
    (12, "http://de/net/de/1", "<link rel=stylesheet href=http://a.com/en/1>"), (13, "http://net/de/1", None), (13, "http://net/de/1", None), (14, "http://lone.dev/x", '<link rel="canonical" href="?q=1"><link rel="canonical" href="">'), (15, "http://u.dev/en/", '<link rel="canonical" href="http://com/en/">'), (None, "x://example.net/de/8", None),
]


def test_urls(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    df = urls.judge(spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'q' as node", "'q' as host", "1 as component"))
    rows = sorted(map(list, df.collect()), key=repr)
    assert rows == sql_rows(con, urls.sql(), df.columns)
    verdict = {r[0]: (r[3], r[4], r[5]) for r in rows}
    assert verdict[1] == ("com/en/", "block", "rule") and verdict[2] == ("example.com/en/7", "allow", "rule")
    assert verdict[4] == verdict[5] == verdict[8] == (None, "block", "alias")  # aliases of a blocked page
    assert verdict[9] == verdict[10] == verdict[11] == (None, "allow", "alias")  # an allow in the component goes before the block
    assert verdict[6] == verdict[7] == verdict[14] == (None, "allow", "none") and verdict[15] == (None, "block", "alias")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


REFERENCES = [
    (1, "https://shop.dev/login", '<link rel="canonical" href="/login?next=https://x.net/de/secret">'),  # a scheme inside the query
    (2, "https://old.dev/a", '<!-- <link rel="canonical" href="https://x.net/de/b"> --><p>'), (3, "https://old.dev/c", '<!-- open <link rel=canonical href="https://x.net/de/b">'),
    (4, "https://up.net/fr/deep/x", '<link rel="canonical" href="../../de/z">'), (5, "https://up.net/fr/y", '<link rel="canonical" href="./../de/./q/..">'),
    (6, "https://amp.dev/p", '<link rel="canonical" href="https://x.net/de/b?x=1&amp;y=2">'), (7, "https://mail.dev/p", '<link rel="canonical" href="mailto:a@x.net/de/b">'), (8, "https://data.dev/p", '<link data-rel="canonical" href="https://x.net/de/b">'),
    (9, "https://top.net/a/b", '<link rel="canonical" href="../../../de/../de/k">'), (10, "https://two.dev", '<link rel="canonical" href="x://x.net/de//..//b">'), (11, "https://x.net/fr/b", '<link rel="canonical" href="/de/secret">'), (12, "https://host.dev", '<link rel="canonical" href="de">'), (13, "https://x.dev/a/../b", '<link rel=canonical href="//net/de/">'),
]


def test_references(spark):
    """What a link points to: schemes, comments, dot segments and entities."""
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", REFERENCES)
    df = urls.judge(spark.createDataFrame(REFERENCES, "page_id long, url string, html string"))
    rows = sorted(map(list, df.collect()), key=repr)
    assert rows == sql_rows(con, urls.sql(), df.columns)
    blocked = {r[0] for r in rows if r[4:] == ["block", "alias"]}
    assert blocked == {4, 5, 6, 9, 10, 11, 13}
    paths = [("/a/b/../c", "/a/c"), ("/..", "/"), ("/a/..", "/"), ("/a/.", "/a/"), ("/./a/./b", "/a/b"), ("/../../a", "/a"), ("/a//../b", "/a/b"), ("", ""), ("/a/b/", "/a/b/"), ("/...", "/...")]
    got = spark.createDataFrame(paths, "p string, want string").select(urls.without_dots(F.col("p")).alias("p"), "want").collect()
    assert [r["p"] for r in got] == [w for _, w in paths]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op3_toxicity"](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    hit = sum(p and y for p, y in held)
    assert hit / sum(y for _, y in held) > 0.85 and hit / sum(p for p, _ in held) > 0.95


def test_toxicity_scores_by_brute_force(spark, sf):
    """Scores from the table and the softmax, by plain loops."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(*toxicity.sample(docs, labels, 2500, 50_000))
    table, out, bias = model.table.tolist(), model.out.tolist(), model.bias.tolist()

    def vector(word):
        w = f"<{word}>".encode()
        rows = [zlib.crc32(w[i : i + k]) % toxicity.BUCKETS for k in toxicity.GRAMS for i in range(len(w) - k + 1)] + [zlib.crc32(w, 1) % toxicity.BUCKETS]
        return [sum(table[r][c] for r in rows) / len(rows) for c in range(toxicity.WIDTH)]

    def odds(v):
        return sum(v[c] * (out[c][1] - out[c][0]) for c in range(toxicity.WIDTH))

    def score(text):
        words = sorted((vector(w) for w in set(toxicity.words_of(text))), key=odds)[-toxicity.WORST :]
        if not words:
            return None
        mean = [sum(v[c] for v in words) / len(words) for c in range(toxicity.WIDTH)]
        e = [math.exp(sum(mean[c] * out[c][y] for c in range(toxicity.WIDTH)) + bias[y]) for y in (0, 1)]
        return e[1] / sum(e)

    rows = {r["doc_id"]: r["score"] for r in QUERIES["op3_toxicity"](spark, sf).collect()}
    texts = dict(map(tuple, docs.select("doc_id", "text").collect()))
    assert rows.keys() == texts.keys()
    for i, t in sorted(texts.items()):
        if len(t) < 20_000:
            want = score(t)
            assert rows[i] < 0.5 if want is None else abs(rows[i] - want) < 1e-4


def test_toxicity_late_in_a_run(table, spark):
    """A toxic word after 10000 characters without white space."""
    good = [(i, f"the table {w} stands near a window") for i, w in enumerate("abcdefghij" * 6)]
    bad = [(i + 100, f"you {w} are an idiot and a moron") for i, w in enumerate("abcdefghij" * 6)]
    labels = spark.createDataFrame([(i, 0) for i, _ in good] + [(i, 1) for i, _ in bad], "doc_id long, toxic int")
    calm = "the_table_stands_near_a_window_" * 400
    got = {r["doc_id"]: r["s"] for r in toxicity.with_score(table([*good, *bad, (900, calm), (901, calm + "idiot_moron_idiot")]), labels, "s").collect()}
    assert got[900] < 0.5 < got[901]


def test_toxicity_odd(table, spark):
    good = [(i, f"the table {w} stands near a window") for i, w in enumerate("abcdefghij" * 6)]
    bad = [(i + 100, f"you {w} are an idiot and a moron") for i, w in enumerate("abcdefghij" * 6)]
    labels = spark.createDataFrame([(i, 0) for i, _ in good] + [(i, 1) for i, _ in bad] + [(900, 1), (901, None), (None, 1), (0, 5)], "doc_id long, toxic int")
    odd = [(900, None), (901, ""), (902, "a calm text " * 3000 + "such an idiiot"), (903, "   "), (None, "window")]
    d = toxicity.with_score(table(good + bad + odd), labels, "s")
    got = {r["doc_id"]: r["s"] for r in d.collect()}
    assert min(got[i] for i, _ in bad) > 0.5 > max(got[i] for i, _ in good)
    assert got[902] > 0.5 > max(got[900], got[901], got[903], got[None])
    assert d.count() == len(good + bad + odd) and "score" in d.columns
    one_class = toxicity.with_score(table(good), labels.filter("toxic = 0"), "s")
    assert max(r["s"] for r in one_class.collect()) < 0.5
    assert toxicity.with_score(table([]), labels, "s").count() == 0


def test_toxicity_long_runs(table, spark):
    good = [(i, f"the table {w} stands near a window") for i, w in enumerate("abcdefghij" * 6)]
    bad = [(i + 100, f"you {w} are an idiot and a moron") for i, w in enumerate("abcdefghij" * 6)]
    labels = spark.createDataFrame([(i, 0) for i, _ in good] + [(i, 1) for i, _ in bad], "doc_id long, toxic int")
    calm, remark = "the table stands near a window " * 5, "idiot moron idiot and a moron"
    runs = {900 + i: by.join((calm + r).split()) for i, (by, r) in enumerate((by, r) for by in ("", "_", ",", "/", "\u200b") for r in ("", remark))}
    got = {r["doc_id"]: r["s"] for r in toxicity.with_score(table(good + bad + list(runs.items())), labels, "s").collect()}
    assert max(got[i] for i in runs if i % 2 == 0) < 0.5 < min(got[i] for i in runs if i % 2)
    for run in (runs[900], "漢字" * 90, "x" * 65, "y" * 131):
        held = set(toxicity.pieces(run))
        assert all(any(run[a : a + 6] in p for p in held) for a in range(len(run) - 5))
