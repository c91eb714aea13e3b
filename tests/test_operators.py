"""Retrieval, evaluation, conversations and streams on small literals."""

import math

from pyspark.sql import functions as F

from docweave.operators import conversation, evaluation, layout, retrieval, service
from docweave.streaming import jobs


def test_fusion_order_and_zero_scores(spark):
    a = spark.createDataFrame([(1, "shared", 0.9, 1), (1, "dense-only", 0.0, 2)], "query_id long, id string, score double, rank int")
    b = spark.createDataFrame([(1, "bm25-only", 3.0, 1), (1, "shared", 2.0, 2)], "query_id long, id string, score double, rank int")
    r = retrieval.rrf({"dense": a, "bm25": b}, "id").orderBy("rank").collect()
    assert [x.id for x in r] == ["shared", "bm25-only", "dense-only"]
    assert r[0].sources == "dense,bm25" and r[2].dense_score == 0.0 and r[2].bm25_score is None


def test_evaluation_arithmetic(spark):
    j = spark.createDataFrame([(1, 99, 1, 0), (1, 10, 2, 1), (2, 20, 1, 1), (4, 7, 1, 0)], "query_id long, doc_id long, rank int, relevance int")
    ideal = spark.createDataFrame([(1, 1), (2, 1), (6, 1)], "query_id long, relevance int")
    cases = lambda ids: spark.createDataFrame([(i, i not in (4, 5), f"c{i % 2}") for i in ids], "query_id long, answerable boolean, category string")
    r = evaluation.evaluate(evaluation.per_case(cases([1, 2]), j, 5, ideal)).first()
    assert (r.recall, r.mrr) == (1.0, 0.75)
    assert math.isclose(r.ndcg, 0.815465, abs_tol=1e-6)
    # 6 has an answer but no hit and counts as missed; of 4 and 5, which have none, only 5 was turned away
    r = evaluation.evaluate(evaluation.per_case(cases([1, 2, 4, 5, 6]), j, 5, ideal)).first()
    assert (r.cases, r.answerable, r.recall, r.mrr, r.rejection_rate) == (5, 3, 0.666667, 0.5, 0.5)
    assert r.citation_correctness == 0.666667
    by = {x.category: x for x in evaluation.by_category(evaluation.per_case(cases([4, 5]), j, 5, ideal)).collect()}
    assert (by["c0"].recall, by["c0"].rejection_rate, by["c1"].rejection_rate) == (0.0, 0.0, 1.0)
    words = spark.createDataFrame([(1, ["A", "b"]), (2, [])], "query_id long, keywords array<string>")
    got = evaluation.keyword_support(words, spark.createDataFrame([(1, "xax")], "query_id long, text string"), "keywords", "text")
    assert {x.query_id: x.support for x in got.collect()} == {1: 0.5, 2: 1.0}


def test_candidates_of_variants(spark):
    hits = spark.createDataFrame([(1, 0, 10, 0.9, 1), (1, 0, 11, 0.8, 2), (1, 1, 12, 0.99, 1), (1, 1, 10, 0.5, 2)], "query_id long, variant_no int, doc_id long, score double, rank int")
    keys = spark.createDataFrame([(10, "a"), (11, "a"), (12, "b")], "doc_id long, key string")
    got = retrieval.union_candidates(hits, keys, "doc_id", 5).orderBy("rank").collect()
    assert [(r.doc_id, r.rank, r.score) for r in got] == [(10, 1, 0.9), (12, 2, 0.99)]
    q = spark.createDataFrame([(1, "a b"), (2, "")], "item_id long, text string")
    assert [(r.query_id, r.variant) for r in retrieval.variants(q, "item_id", F.array("text", F.lit(" a b "), F.lit("c"))).collect()] == [(1, "a b"), (1, "c"), (2, "a b"), (2, "c")]
    v = {r.item_id: r.embedding for r in retrieval.embed(q).collect()}
    assert sum(v[1]) == 2 and sum(v[2]) == 0 and len(v[1]) == retrieval.DIMS


def test_rules_of_questions(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    yes, no = F.lit(True), F.lit(False)
    route = lambda q, base=True, cited=False: one(conversation.route(F.lit(q), F.lit(base), F.lit(cited)))
    assert [route(q) for q in ("你好", "Hello!", "什么是 RAG？", "公司制度怎么报销", "这个知识库有哪些文档", "")] == ["direct", "direct", "direct", "rag", "tool", "direct"]
    assert [route("来源是哪个文件", cited=True), route("来源是哪个文件"), route("怎么报销", base=False), route("hithere")] == ["tool", "rag", "direct", "rag"]
    why = lambda q, past=yes: one(conversation.rewrite(F.lit(q), past))["reason"]
    assert why("这个流程需要多少天才能完成") == "contains_context_reference" and why("这个流程", no) == "no_conversation_context"
    assert why("需要多久？") == "question_is_too_short" and why("采购合同盖章以后归档工作谁负责呢？") == "matches_context_dependent_pattern" and why("采购复核的触发条件是什么？") == "question_is_self_contained"
    gap = lambda q, known="": one(conversation.gap(F.lit(q), F.lit(known)))["triggers"]
    assert gap("之前说过的条件还有效吗", "采购") == ["explicit_history_reference"]
    assert gap("它的审批条件是什么样子的呢") == ["pronoun_without_antecedent"] and gap("它的审批条件是什么样子的呢", "采购流程") == []
    assert gap("那谁负责") == ["short_question_without_context", "continuation_without_context"] and gap("采购复核的触发条件是什么？") == [] and gap("") == []


def test_history_scores(spark):
    m = spark.createDataFrame([(1, 1, "the audit Report of may"), (1, 2, "no match"), (1, 3, "audit"), (1, 4, "")], "g long, id long, text string").withColumn("q", F.lit("audit report"))
    got = conversation.history(m, ["g"], "id", "text", "q", (4 - F.col("id")).cast("double"), 200, 2).collect()
    # the phrase without blanks is one term: 5 + 1 + 8/8, and 1 / (1 + 3 days)
    assert [(r.id, r.score, r["rank"]) for r in got] == [(1, 7.25, 1), (3, 0.5, 2)]


def test_recent_rounds_without_users(spark):
    m = spark.createDataFrame([(1, t, "assistant") for t in range(6)] + [(2, 0, "user"), (2, 1, "assistant"), (2, 2, "user")], "conv_id long, turn long, role string")
    got = {(r.conv_id, r.turn) for r in conversation.recent_rounds(m, 1).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (1, 5), (2, 2)}


def test_greedy_fit_skips_and_goes_on(spark):
    m = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 4)], "g long, id long, cost long")
    r = conversation.greedy_fit(m, ["g"], [F.desc("id")], "id", "cost", 10, 5).collect()
    assert sorted(x.id for x in r) == [1, 3] and r[0].used == 9


def test_memory_rules(spark):
    said = ["请记住： 预算  是三万元。", "记住x", "以后都按：周报格式！", "最终决定: 用甲方案", "确定使用 乙库；", "不要再改：标题", "Remember that the key is red.", "我喜欢 咖啡", "", None]
    r = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, s string").orderBy("i").select(conversation.memory(F.col("s")).alias("m")).collect()
    want = [("constraint", "预算 是三万元"), None, ("constraint", "周报格式"), ("decision", "用甲方案"), ("decision", "乙库"), ("constraint", "标题"), None, None, None, None]
    assert [x.m and (x.m.kind, x.m.content) for x in r] == want


def test_gate(spark):
    f = spark.createDataFrame([(0, None, False, []), (2, 0.5, False, []), (2, 0.5, True, ["X1"]), (2, 0.9, False, [])], "n_hits long, top_score double, tool_ok boolean, missing array<string>")
    assert [r.decision for r in retrieval.gate(f).collect()] == ["review:no_hits", "review:low_score", "review:missing_entities", "confident"]


def test_dense_scope_and_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.0, 1.0], "a"), (4, [1.0, 0.0], "b")], "vec_id long, embedding array<float>, label string")
    r = retrieval.topk_dense(v, v.filter("vec_id = 1"), 2, scope_col="label").orderBy("rank").collect()
    assert [(x.vec_id, x.score) for x in r] == [(1, 1.0), (2, 1.0)]


def test_parts_and_transitions(spark):
    a = spark.createDataFrame([(1, 1, '"x"'), (1, 2, "y")], "t long, part int, etag string")
    b = spark.createDataFrame([(1, 1, "x")], "t long, part int, etag string")
    assert service.compare_parts(a, b, "t", "part", "etag").first()[1:] == (1, False)
    s = spark.createDataFrame([(1, 1, "initiated"), (1, 2, "uploading"), (1, 3, "initiated")], "t long, n int, status string")
    assert [r.valid for r in service.transitions(s, "t", "n", "status").orderBy("n").collect()] == [True, False]


def test_headers_need_two_pages(spark):
    rows = [(1, p, f"Report page {p}", 0.0, 10.0) for p in (1, 2)] + [(1, 1, "Only once", 0.0, 10.0)]
    h = layout.headers_footers(spark.createDataFrame(rows, "doc long, page int, text string, top double, bottom double"), "doc", F.lit(800.0)).collect()
    assert [(r.zone, r.norm, r.pages) for r in h] == [("header", "report page n", 2)]


def test_job_states_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    schema = "job_id long, at double, failed boolean"
    for i, rows in enumerate([[(1, 1.0, True), (2, 1.0, False)], [(1, 2.0, True), (2, 3.0, True)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"b{i}"))
    out = {}

    def keep(batch, _):
        out.update({r.job_id: (r.failures, r.status, r.next_run_at) for r in batch.collect()})

    for _ in range(2):  # a restart goes on from the checkpoint
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
        q = jobs.job_states(s).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert out == {1: (2, "retry", 12.0), 2: (1, "retry", 8.0)}


def test_streams_restart_with_their_state(spark, tmp_path):
    """Retries over two runs of a stream: the second run finds the state of the first."""
    from pyspark.sql import functions as F

    from docweave.streaming import processors

    kind = "job_id long, n long, ts timestamp, failed boolean"
    at = lambda df: df.withColumn("at", F.unix_millis("ts"))
    out, seen = f"{tmp_path}/out", []
    for rows in ([(1, 1, "2024-01-01 00:00:00", True), (2, 2, "2024-01-01 00:00:00", True)], [(1, 3, "2024-01-01 00:00:03", True), (2, 4, "2024-01-01 05:00:00", False)]):
        spark.createDataFrame([(j, n, __import__("datetime").datetime.fromisoformat(t), f) for j, n, t, f in rows], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = processors.retries(at(spark.readStream.schema(kind).parquet(f"{tmp_path}/in")), delay="10 seconds")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted((r.job_id, r.at % 100_000_000 // 1000 - 67_200, r.status, r.failures) for r in spark.read.parquet(out).collect()))
    first = [(1, 0, "retry", 1), (2, 0, "retry", 1)]
    assert seen[0] == first
    # job 1 failed again before its time; its second wait is over behind the watermark, as job 2's first was before it was done
    assert seen[1] == sorted([*first, (1, 3, "retry", 2), (1, 13, "pending", 2), (2, 5, "pending", 1), (2, 18000, "done", 0)])
