"""Tools and replies on small literals."""

from pyspark.sql import functions as F

from docweave.operators import tools


def test_planner(spark):
    """The golden cases, given a first hit; without one only the listing needs no id."""
    hit, none = "named_struct('doc_id', 5L, 'chunk_id', 6L, 'knowledge_item_id', 7L)", "cast(null as struct<doc_id:bigint,chunk_id:bigint,knowledge_item_id:bigint>)"
    ask = lambda first, cited: {x.q: x.p and (x.p.tool, x.p.args) for x in spark.createDataFrame([(q,) for q in (*tools.CASES, "出处？")], "q string").select("q", tools.plan(F.col("q"), F.expr(first), F.lit(cited).cast("long")).alias("p")).collect()}
    got = ask(hit, None)
    assert {q: p and p[0] for q, p in got.items() if q in tools.CASES} == tools.CASES
    assert got["请补充上一段和下一段上下文"][1] == {"chunk_id": "6", "radius": "2"} and got["出处？"] == ("get_document", {"document_id": "5"})
    assert {q: p and p[0] for q, p in ask(none, 9).items() if p} == {"这个知识库有哪些文档？": "list_knowledge_base_documents", "出处？": "get_document"}


def test_replies(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert one(tools.route_reply(F.lit('```json\n{"route": "complex"}\n```'))) == "rag"
    assert [one(tools.route_reply(F.lit(s))) for s in ("route: tool", "I think direct", "none")] == ["tool", "direct", None]
    a = one(tools.answer_reply(F.lit('{"answer": " x ", "used": [2, 0, 2, 1]}')))
    assert (a.answer, a.used) == ("x", [2, 1])
    assert one(tools.rewrite_reply(F.lit('{"queries": ["q", "a", "a", "", "b", "c", "d"]}'), F.lit("q"))) == ["q", "a", "b", "c"]
    assert one(tools.rewrite_reply(F.lit("no json"), F.lit("q"))) == ["q"]
    call = '{"choices": [{"message": {"tool_calls": [{"function": {"name": "f", "arguments": "{\\"id\\": 3}"}}]}}]}'
    c = one(tools.tool_call(F.lit(call)))
    assert (c.name, c.arguments) == ("f", {"id": "3"})
    assert one(tools.partial_answer(F.lit('{"answer": "a\\nb \\u00e9 c\\'))) == "a\nb é c"
    assert one(tools.partial_answer(F.lit('{"ans'))) is None
    p = one(tools.stream_pieces(F.lit("短句。" * 3 + "x" * 50)))
    assert p == ["短句。" * 3, "x" * 50]  # a long sentence stays whole
    assert one(tools.stream_pieces(F.lit(" 一句话在这里。二\n三\n\n另一段；" + "四" * 20 + "。"))) == ["一句话在这里。二三", "另一段；", "四" * 20 + "。"]


def test_workflow(spark):
    q = spark.createDataFrame([(1, "hello", "viewer"), (2, "有哪些文档", "viewer"), (5, "有哪些文档", "guest"), (3, "what is the limit", "viewer"), (4, "what about AB12?", "viewer")], "id long, question string, role string")
    h = spark.createDataFrame([(3, 1, 0.9, "the limit"), (4, 1, 0.9, "other")], "id long, rank int, score double, content string")
    assert {r.id: (r.route, r.status) for r in tools.workflow(q, h).collect()} == {1: ("direct", "answered"), 2: ("tool", "answered"), 5: ("tool", "denied"), 3: ("rag", "answered"), 4: ("rag", "review")}
