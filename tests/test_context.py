"""Contexts of answers on small literals."""

from pyspark.sql import functions as F

from docweave.operators import context

ITEM = "id int, kind string, n long, role string, text string, pinned boolean, importance int, protected boolean, score double"


def test_items_read_leniently(spark):
    raw = ['{"content": "", "summary": " s ", "source_id": 7}', '{"content": "c", "importance": 0, "score": 0.5, "pinned": true, "id": [1, "b"], "kind": "fact"}', " bare ", "", "   ", '{"content": "cut', '{"title": "t", "score": "x"}', None]
    df = spark.createDataFrame(list(enumerate(raw)), "n long, raw string").orderBy("n")
    got = [r.i and (r.i.kind, r.i.content, r.i.source_ids, r.i.importance, r.i.pinned) for r in df.select(context.coerce_item(F.col("raw"), F.col("n"), "memory").alias("i")).collect()]
    assert got == [("memory", "s", ["7"], 0.0, False), ("fact", "c", ["1", "b"], 0.5, True), ("memory", "bare", ["2"], 0.0, False), None, None, None, None, None]
    e = [r.e for r in df.select(context.coerce_evidence(F.col("raw")).alias("e")).collect()]
    assert [x and (x.content, x.title, x.score) for x in e] == [("", "", 0.0), ("c", "", 0.5), None, None, None, ("", "", 0.0), ("", "t", 0.0), None]


def test_cited_evidence(spark):
    e = spark.createDataFrame([(1, 5, 1, None), (1, 5, 2, None), (1, 6, None, 9), (1, 7, 1, None), (1, 8, None, None), (1, None, None, None), (2, 5, 1, None)], "id int, doc_id long, chunk_id long, knowledge_item_id long")
    c = spark.createDataFrame([(1, "5", "1", None), (1, None, None, "9"), (1, "7", None, None), (1, "8", "3", None), (1, "8", "3", None)], "id int, doc_id string, chunk_id string, knowledge_item_id string")
    got = {(r.id, r.doc_id, r.chunk_id): r.protected for r in context.cited_evidence(e, c, ["id"]).collect()}
    assert got == {(1, 5, 1): True, (1, 5, 2): False, (1, 6, None): True, (1, 7, 1): True, (1, 8, None): True, (1, None, None): False, (2, 5, 1): False}
    assert context.cited_evidence(e, c.limit(0), ["id"]).filter("protected").isEmpty()


def _items(spark, extra=()):
    x = lambda n: "x" * (2 * n)
    rows = [(1, "message", n, "user" if n % 2 == 0 else "assistant", x(10), None, None, None, None) for n in range(6)]
    rows += [(1, "tool", n, None, x(10), None, None, None, None) for n in range(5)]
    rows += [(1, "evidence", n, None, f"{n}" * 20, None, None, n == 1, float(n)) for n in range(4)]
    return spark.createDataFrame([*rows, *extra], ITEM)


def test_full_request_is_compacted(spark):
    """150 tokens asked for: with room nothing goes; in 150 the newest three tools stay, then one tool and two pieces of evidence."""
    room = context.answer_context(_items(spark), ["id"], 1000, {}).collect()
    assert len(room) == 15 and all(r.selected and not r.actions and r.used == 150 for r in room)
    full = context.answer_context(_items(spark), ["id"], 150, {}).collect()
    assert {r.n for r in full if r.kind == "tool"} == {4} and {r.n for r in full if r.kind == "evidence"} == {1, 3}
    assert full[0].actions == list(context.FULL) and full[0].used == 90
    one = context.answer_context(_items(spark), ["id"], 150, {"evidence": 10, "tool": 10}).collect()
    assert len(one) == 15 and one[0].actions == []  # caps keep the need at 80
    assert sorted((r.n, r.reason) for r in one if r.kind == "tool") == [(0, None), *[(n, "over_budget") for n in range(1, 5)]]


def test_older_rounds_become_a_summary(spark):
    seen = lambda lines, prior: F.concat_ws("|", prior, F.size(lines).cast("string"), F.left(F.element_at(lines, 1), F.lit(6)))
    more = [(1, "summary", 0, None, "before", None, None, None, None)]
    got = context.answer_context(_items(spark, more), ["id"], 150, {}, seen).collect()
    assert sorted(r.n for r in got if r.kind == "message") == [2, 3, 4, 5]
    assert [r.text for r in got if r.kind == "summary"] == ["before|2|user: "] and got[0].actions[-2:] == list(context.SUMMED)
    failed = context.answer_context(_items(spark, more), ["id"], 150, {}, lambda lines, prior: F.lit(None).cast("string")).collect()
    assert sum(r.kind == "message" for r in failed) == 6 and [r.text for r in failed if r.kind == "summary"] == ["before"]
    calm = context.answer_context(_items(spark, more), ["id"], 1000, {}, seen).collect()
    assert sum(r.kind == "message" for r in calm) == 6


def test_edges(spark):
    odd = [(None, "message", 0, "user", "no key", None, None, None, None), (2, "memory", 0, None, None, True, None, None, None), (3, "system", 0, None, "y" * 100, None, None, None, None), (3, "system", 0, None, "y" * 100, None, None, None, None)]
    df = spark.createDataFrame(odd, ITEM).withColumn("summed", F.lit(3)).withColumn("place", F.lit("x"))
    got = {(r.id, r.kind): r for r in context.answer_context(df, ["id"], 100, {"system": 20}, lambda lines, prior: F.lit("s")).collect()}
    assert len(got) == 3 and got[None, "message"].selected and got[2, "memory"].text == "" and got[3, "system"].tokens <= 20 and got[3, "system"].text.endswith("...")
    assert context.answer_context(df.limit(0), ["id"], 100, {}).count() == 0


def test_prompt(spark):
    items = [(1, "message", 1, "assistant", "there", None, None, None, None), (1, "message", 0, "user", "hi", None, None, None, None), (1, "evidence", 3, None, "b", None, None, None, None), (1, "evidence", 2, None, "a", None, None, None, None), (1, "system", 0, None, "be brief", None, None, None, None)]
    c = context.answer_context(spark.createDataFrame(items, ITEM), ["id"], 100, {})
    assert context.prompt(c, ["id"]).first().prompt == "Instructions:\nbe brief\n\nConversation:\nuser: hi\nassistant: there\n\nEvidence:\n[1] a\n[2] b"
