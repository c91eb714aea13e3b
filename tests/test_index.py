"""The kept indexes: the lexical one against a scan, the vector one against the exact way."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators import lexical_index, retrieval, vector_index
from docweave.sources import sinks

WORDS = ["the", "of"] * 20 + [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(40)]


def some_docs(seed, ids):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 60))) if i % 11 else None, r.choice(["en", "de"])) for i in ids]


@pytest.fixture(scope="module")
def asked(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 6)))) for i in range(25)] + [(90, "nothing here"), (91, "")]
    return spark.createDataFrame(rows, "item_id long, text string")


def same(spark, index, rows, asked, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    plain = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
    want = plain(retrieval.topk_bm25(docs, asked, 4, **how))
    for probed in (1, 3):
        assert plain(lexical_index.search(index, asked, 4, probed=probed, **how)) == want
    return want


def test_lexical_index(spark, asked, tmp_path):
    rows = {r[0]: r for r in some_docs(1, range(200))}
    docs = lambda some: spark.createDataFrame(list(some), "doc_id long, text string, lang string")
    index = lexical_index.create(docs(rows.values()), f"file://{tmp_path}/i", keep=("lang",), docs_per_bucket=8)
    assert index.buckets == 25 and same(spark, index, list(rows.values()), asked)
    same(spark, index, list(rows.values()), asked, filters=F.col("lang") == "en")
    new = some_docs(2, range(150, 260))
    before, index = index, lexical_index.upsert(index, docs(new))
    old = dict(rows)
    rows |= {r[0]: r for r in new}
    same(spark, index, list(rows.values()), asked)
    same(spark, before, list(old.values()), asked)  # a reader keeps the state that it opened
    index = lexical_index.delete(index, docs(r for r in rows.values() if r[0] % 3 == 0))
    rows = {i: r for i, r in rows.items() if i % 3}
    same(spark, index, list(rows.values()), asked, filters=F.col("lang") == "de")
    again = some_docs(3, range(0, 40))
    index = lexical_index.upsert(index, docs(again))
    rows |= {r[0]: r for r in again}
    same(spark, index, list(rows.values()), asked)
    index = lexical_index.compact(index, docs_per_bucket=8)
    assert len(index.segments) == 1 and index.live().count() == len(rows)
    same(spark, index, list(rows.values()), asked, filters=F.col("lang") == "en")
    stats = index.lengths().first()
    assert (stats.n, round(stats.avgdl, 9)) == (len(rows), round(sum(len((r[1] or "").split()) for r in rows.values()) / len(rows), 9))


def test_lexical_index_scopes(spark, asked, tmp_path):
    rows = some_docs(4, range(120))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    index = lexical_index.create(docs, f"file://{tmp_path}/s", scope_col="lang", docs_per_bucket=10)
    own = asked.withColumn("lang", F.when(F.col("item_id") % 2 == 0, "en").otherwise("de"))
    assert same(spark, index, rows, own, scope_col="lang")


def test_early_termination(spark, tmp_path):
    """Buckets that cannot hold a better document are not read: their postings may even be missing."""
    rows = [(i, "common " * 30 + ("needle " * 5 if i == 77 else "")) for i in range(300)]
    index = lexical_index.create(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/e", docs_per_bucket=10)
    asked = spark.createDataFrame([(1, "needle common")], "item_id long, text string")
    at = index.table("docs").filter("id = 77").first().bucket
    class Poor(lexical_index.LexicalIndex):
        def table(self, name):
            df = super().table(name)
            return df.withColumn("hits", F.when(F.col("bucket") == at, F.col("hits"))) if name == "postings" else df

    poor = Poor(index.spark, index.path, index.segments, index.buckets)
    assert [tuple(r) for r in lexical_index.search(poor, asked, 1).select("doc_id", "rank").collect()] == [(77, 1)]


def test_two_writers(spark, tmp_path):
    at = f"file://{tmp_path}/p"
    assert sinks.changes(spark, at) == [] and [sinks.publish(spark, at, v) for v in "ab"] == [1, 2]
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        spark.createDataFrame([("c",)], "value string").write.mode("errorifexists").parquet(f"{at}/change=2")
    assert sinks.changes(spark, at) == [(1, "a"), (2, "b")]


def hits(df):
    by = {}
    for r in df.collect():
        by.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    return by


def test_vector_index(spark, tmp_path):
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 16))
    made = (centres[r.integers(0, 30, 3000)] + r.normal(scale=0.7, size=(3000, 16))).tolist()
    made[50] = made[51] = made[52]
    rows = [(i, v, i % 3) for i, v in enumerate(made)] + [(9000, None, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    asked = df.filter("vec_id % 40 = 10")
    index = vector_index.create(df, f"file://{tmp_path}/v", scope_col="label")
    assert len(index.sizes) == 219 and index.share < 0.2 and index.sizes.sum() == 3000 and index.vectors().count() == 3000
    want = hits(retrieval.topk_dense(df.filter("embedding is not null"), asked, 5, scope_col="label"))
    assert hits(vector_index.search(index, asked, 5, scope_col="label", exact=True)) == want
    found = hits(vector_index.search(index, asked, 5, scope_col="label"))
    recall = np.mean([len({i for i, _ in w.values()} & {i for i, _ in found[q].values()}) / 5 for q, w in want.items()])
    assert recall >= 0.9
    few = hits(vector_index.search(index, asked, 5, scope_col="label", num_candidates=20))
    assert set(few) == set(want)
    assert vector_index.search(index, asked.limit(0), 5, scope_col="label").collect() == []


def test_best_of_ties():
    score = np.array([[0.5, 0.9, 0.5, 0.5, -1.0], [0.1, 0.2, 0.3, 0.4, 0.5], [-1.0, -1.0, 0.3, -1.0, -1.0]])
    i, j = retrieval.best(score, np.array([5, 4, 3, 2, 1]), 2)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 1), (0, 3), (1, 3), (1, 4), (2, 2)]


def test_table_functions(spark, tmp_path):
    from docweave.operators import table_functions

    docs = spark.createDataFrame([(i, "k" if i % 2 else "l", f"n{i}", f"text number {i} " + "alpha " * i) for i in range(6)], "doc_id long, knowledge_base string, name string, text string")
    chunks = spark.createDataFrame([(1, i, f"c{i}") for i in range(6)], "item_id long, chunk_index int, content string")
    items = spark.createDataFrame([(3, "T", "body")], "item_id long, title string, content string")
    messages = spark.createDataFrame([(1, 0, "user", "Hello there"), (1, 1, "assistant", "hello"), (2, 0, "user", "hello")], "conv_id long, turn long, role string, content string")
    index = lexical_index.create(docs, f"file://{tmp_path}/t", docs_per_bucket=2)
    table_functions.register(spark, docs, chunks, items, messages, index)
    rows = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    want = [tuple(r) for r in retrieval.topk_bm25(docs, spark.createDataFrame([(1, "alpha number 3")], "item_id long, text string"), 3).select("doc_id", "score", "rank").orderBy("rank").collect()]
    assert rows("SELECT * FROM search_knowledge_base('alpha number 3', 3) ORDER BY place") == want
    assert rows("SELECT chunk_index FROM get_chunk_neighbors(1, 0, 9) ORDER BY 1") == [(0,), (1,), (2,), (3,)]
    assert rows("SELECT title FROM get_knowledge_item(3)") == [("T",)] and rows("SELECT * FROM get_document(77)") == []
    assert rows("SELECT name, place FROM list_knowledge_base_documents('k', 2) ORDER BY place") == [("n5", 1), ("n3", 2)]
    assert rows("SELECT turn FROM search_conversation_history(1, 'HELLO', 5) ORDER BY 1") == [(0,), (1,)]
    assert rows("SELECT q.id, count(*) FROM range(1, 3) q, LATERAL document_chunks(q.id) GROUP BY 1") == [(1, 6)]
