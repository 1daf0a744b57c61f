"""The stages, one after the other, each against what it has to do."""

import corpus_pipeline
from recordflow.llm.shared import settle
from tests.llm.test_duplicates import components, stripped
from tests.llm.test_tokens import held


def test_one_row_of_a_group_stays(table, spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = table([(None, ""), (None, a), (4, a), (4, a), (9, a.upper()), (None, b), (None, b), (6, None), (6, None), (8, "")])
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(None, ""), (4, a), (None, b), (6, None), (8, "")], key=repr)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    texts = lambda d: [(r["doc_id"], r["text"]) for r in d.collect()]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    clean = settle(stages["toxicity"](spark, docs, sf))
    assert clean.columns == columns and clean.count() < docs.count()
    kept = {i for i, _ in texts(clean)}
    assert sum(labels[i] for i in kept if i in labels) <= 2  # a few dozen labels to learn from
    assert sum(i not in kept for i, y in labels.items() if y == 0) <= 2
    single = settle(stages["near duplicates"](spark, clean, sf))
    want = components(texts(clean))
    assert single.columns == columns and sorted(i for i, _ in texts(single)) == sorted(i for i, (_, c) in want.items() if c == i)
    left = settle(stages["repeats"](spark, single, sf))
    gone = stripped(texts(single))
    assert left.columns == columns and left.count() == single.count()
    before = dict(texts(single))
    assert all(r["n_chars"] == len(r["text"]) and len(before[r["doc_id"]].encode()) - gone[r["doc_id"], before[r["doc_id"]]][1] >= len(r["text"].encode()) for r in left.collect())
    packed = stages["packing"](spark, left, sf).collect()
    held(packed, dict(texts(left)), 4096)
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def odd(spark, sf):
    """Documents with nulls in every column, repeated rows, and columns named like those of
    the stages."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    rows = [(None, None), (None, ""), (None, "one two three four five six seven"), (3, None), (3, None), (4, ""), (7, "x " * 3000), (7, "x " * 3000), (None, "one two three four five six seven")]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    return docs.selectExpr("*", "'a' as Toxicity", "'b' as spans", "'c' as __g", "'d' as row_key", "1 as g", "2 as rest", "named_struct('x', 1) as component")


def test_stages_on_odd_rows(spark, sf):
    docs = odd(spark, sf)
    given = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = settle(stage(spark, docs, sf))
        assert after.columns == docs.columns and [f.dataType.simpleString() for f in after.schema] == [f.dataType.simpleString() for f in docs.schema], name
        r = after.filter("text is not null").first()
        assert (r["Toxicity"], r["spans"], r["__g"], r["row_key"], r["g"], r["rest"], r["component"]["x"]) == ("a", "b", "c", "d", 1, 2, 1)
        docs = after
    # of equal rows one stays, of texts without words all of different ids
    left = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert len(left) < given and len(left) == len(set(left)) and {i for i, t in left if not t} >= {None, 3, 4}
    held = sum(r["length"] for r in corpus_pipeline.pack(spark, docs, sf).collect())
    assert held >= len(left)


def test_stages_on_an_empty_table(spark, sf):
    docs = odd(spark, sf).filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
