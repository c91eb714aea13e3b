"""The read-only tools of the assistant, and how a question becomes a call, an answer and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import text as fx
from docweave.operators import conversation
from docweave.operators.service import PERMISSIONS

#: What a tool may return at most.
MOST_CHARS, MOST_ROWS = 24_000, 50
TOOLS = ("search_knowledge_base", "get_document", "get_knowledge_item", "get_chunk_neighbors", "list_knowledge_base_documents", "search_conversation_history")
#: The permission that each tool asks for.
NEEDS = {
    "search_knowledge_base": "search:use",
    "get_document": "content:read",
    "get_knowledge_item": "content:read",
    "get_chunk_neighbors": "content:read",
    "list_knowledge_base_documents": "content:read",
    "search_conversation_history": "chat:use",
}
#: Which roles may call which tool; all others none.
ALLOWED = {role: tuple(t for t in TOOLS if NEEDS[t] in had) for role, had in PERMISSIONS.items()}


def get_document(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The wanted documents with their text cut at MOST_CHARS, and whether it was cut. Ids that are not there give no row."""
    cut = F.length(text_col) > MOST_CHARS
    return docs.join(wanted.select(id_col).distinct(), id_col, "left_semi").select(id_col, F.left(text_col, F.lit(MOST_CHARS)).alias("content"), F.coalesce(cut, F.lit(False)).alias("truncated"))


def list_documents(docs: DataFrame, scope: Column, order: list[Column], limit: int) -> DataFrame:
    return docs.filter(scope).orderBy(*order).limit(max(1, min(limit, MOST_ROWS)))


# Words that ask for a tool, besides those that conversation.py has.
NEIGHBOUR_MARKERS = ("上一段", "下一段", "相邻", "前后文", "上下文")
WHOLE_MARKERS = ("完整原文", "全文", "详细内容", "整份文档", "这份文档内容")
ITEM_MARKERS = ("知识条目详情", "条目内容", "这个知识条目")
#: Questions and the tool that they must get, given a first hit.
CASES = {
    "请给我这份文档的完整原文": "get_document",
    "请补充上一段和下一段上下文": "get_chunk_neighbors",
    "这个片段的相邻内容是什么": "get_chunk_neighbors",
    "这个知识库有哪些文档？": "list_knowledge_base_documents",
    "请看一下这个知识条目详情": "get_knowledge_item",
    "采购复核的触发条件是什么？": None,
}


def plan(question: Column, first: Column, cited_doc: Column) -> Column:
    """struct(tool, args) of a question that asks for a tool, else null. Ids come from the first hit (struct of doc_id,
    chunk_id, knowledge_item_id; null without hits), for the source of an answer also from the last answer's first
    citation. A tool whose id is missing leaves the question to the next rule."""
    q = fx.squeeze(question)

    def call(tool: str, **args: Column | int) -> Column:
        flat = [x for k, v in args.items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string"))]
        return F.struct(F.lit(tool).alias("tool"), F.create_map(*flat).alias("args"))

    source = F.coalesce(first["doc_id"], cited_doc)
    rules = (
        (conversation.SOURCE_MARKERS, source, call("get_document", document_id=source)),
        (NEIGHBOUR_MARKERS, first["chunk_id"], call("get_chunk_neighbors", chunk_id=first["chunk_id"], radius=2)),
        (conversation.LIST_MARKERS, F.lit(1), call("list_knowledge_base_documents", limit=20)),
        (WHOLE_MARKERS, first["doc_id"], call("get_document", document_id=first["doc_id"])),
        (ITEM_MARKERS, first["knowledge_item_id"], call("get_knowledge_item", knowledge_item_id=first["knowledge_item_id"])),
    )
    return F.coalesce(*[F.when(conversation.mentions(q, markers) & wants.isNotNull(), made) for markers, wants, made in rules])


def get_knowledge_item(items: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The wanted items' details: as get_document, with title (first line, cut at 120 signs) and length."""
    title = F.left(fx.collapse(F.substring_index(F.coalesce(text_col, F.lit("")), "\n", 1)), F.lit(120))
    cut = get_document(items, wanted, id_col, text_col)
    return items.select(id_col, title.alias("title"), F.length(text_col).alias("length")).join(cut, id_col)


def authorised(calls: DataFrame) -> DataFrame:
    """Calls (role, tool) with ``allowed``. Where calls tell their scope (org, kb) both must be there; a search of the history
    also needs conversation and user, where calls have these columns."""
    pair = F.concat_ws("/", "role", "tool")
    ok = F.coalesce(pair.isin(*[f"{r}/{t}" for r, ts in ALLOWED.items() for t in ts]), F.lit(False))
    for c in ("org", "kb"):
        if c in calls.columns:
            ok = ok & F.coalesce(F.col(c) > 0, F.lit(False))
    for c in ("conversation_id", "user_id"):
        if c in calls.columns:
            ok = ok & ((F.col("tool") != "search_conversation_history") | F.col(c).isNotNull())
    return calls.withColumn("allowed", ok)


def tool_call(response: Column) -> Column:
    """struct(name, arguments) of the first call in a model's response; arguments that are no JSON object are empty."""
    name = F.get_json_object(response, "$.choices[0].message.tool_calls[0].function.name")
    args = F.get_json_object(response, "$.choices[0].message.tool_calls[0].function.arguments")
    return F.when(name.isNotNull(), F.struct(name.alias("name"), F.coalesce(F.from_json(args, "map<string,string>"), F.create_map().cast("map<string,string>")).alias("arguments")))


def route_reply(reply: Column) -> Column:
    """direct, tool or rag from a model's reply: JSON, else a named value, else a bare word; complex means rag."""
    s = fx.strip_fence(reply)
    found = F.lower(F.coalesce(F.get_json_object(s, "$.route"), F.nullif(F.regexp_extract(s, r'(?i)"?route"?\s*[:=]\s*"?([a-z]+)', 1), F.lit("")), F.nullif(F.regexp_extract(s, r"(?i)\b(direct|tool|rag|complex)\b", 1), F.lit(""))))
    return F.when(found == "complex", "rag").when(found.isin("direct", "tool", "rag"), found)


def answer_reply(reply: Column) -> Column:
    """struct(answer, used): the text, and the distinct context numbers (1 and up) that it leans on."""
    s = fx.strip_fence(reply)
    body = F.from_json(s, "answer string, used array<int>")
    used = F.array_distinct(F.filter(F.coalesce(body["used"], F.array().cast("array<int>")), lambda x: x >= 1))
    return F.struct(F.coalesce(F.trim(body["answer"]), s).alias("answer"), used.alias("used"))


def rewrite_reply(reply: Column, question: Column, most: int = 3, chars: int = 300) -> Column:
    """The question and up to ``most`` other ways to ask it."""
    got = F.coalesce(F.from_json(fx.strip_fence(reply), "queries array<string>")["queries"], F.array().cast("array<string>"))
    others = F.array_except(F.array_distinct(F.filter(F.transform(got, lambda x: F.left(fx.collapse(x), F.lit(chars))), lambda x: x != "")), F.array(question))
    return F.concat(F.array(question), F.slice(others, 1, most))


def cited(answers: DataFrame, evidence: DataFrame, by: str) -> DataFrame:
    """Citations of answers (``by``, used): numbers beyond the evidence are skipped, each (document, chunk) counts once, in
    order of first use."""
    u = answers.select(by, F.posexplode("used").alias("at", "rank"))
    c = u.join(evidence, [by, "rank"])
    first = c.withColumn("__n", F.row_number().over(Window.partitionBy(by, "doc_id", "chunk_id").orderBy("at"))).filter("__n = 1")
    return first.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("at"))).select(by, "n", "doc_id", "chunk_id")


def partial_answer(prefix: Column) -> Column:
    """The answer's text as far as an unfinished JSON reply has it, escapes decoded; a cut escape waits."""
    raw = F.regexp_extract(prefix, r'"answer"\s*:\s*"((?:[^"\\]|\\u[0-9a-fA-F]{4}|\\[^u])*)', 1)
    return F.when(prefix.rlike(r'"answer"\s*:\s*"'), F.from_json(F.concat(F.lit('{"a": "'), raw, F.lit('"}')), "a string")["a"])


def stream_pieces(text: Column, most: int = 24) -> Column:
    """An answer in pieces for sending: paragraph by paragraph, sentences (up to a full stop, mark or line end) joined while they
    fit in ``most`` signs. A longer sentence is a piece of its own; no piece goes beyond a paragraph."""
    clean = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    trimmed = lambda xs: F.filter(F.transform(xs, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    none = F.array().cast("array<string>")

    def step(a: Column, s: Column) -> Column:
        fits = F.length(a["cur"]) + F.length(s) <= most
        done = F.when(fits | (a["cur"] == ""), a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"])))
        return F.struct(done.alias("done"), F.when(fits, F.concat(a["cur"], s)).otherwise(s).alias("cur"))

    def pieces(paragraph: Column) -> Column:
        sentences = trimmed(F.split(paragraph, "(?<=[。！？；\n])"))
        start = F.struct(none.alias("done"), F.lit("").alias("cur"))
        return F.aggregate(sentences, start, step, lambda a: F.when(a["cur"] != "", F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))

    return F.when(F.coalesce(clean, F.lit("")) == "", none).otherwise(F.flatten(F.transform(trimmed(F.split(clean, "\n\n")), pieces)))


def index_documents(chunks: DataFrame) -> DataFrame:
    """Searchable columns from a chunk's metadata map: page numbers with the single page as fallback, heading path, groups."""
    m = F.col("metadata")
    n = lambda *keys: F.coalesce(*[m[k].try_cast("int") for k in keys])
    return chunks.select(
        "chunk_id",
        m["file_type"].alias("file_type"),
        F.coalesce(m["source_file"], m["filename"]).alias("source_file"),
        n("page_start", "page_number", "page").alias("page_start"),
        n("page_end", "page_number", "page").alias("page_end"),
        F.filter(F.split(F.coalesce(m["heading_path"], F.lit("")), " > "), lambda x: x != "").alias("heading_path"),
        F.filter(F.split(F.coalesce(m["permission_group"], F.lit("")), ","), lambda x: x != "").alias("permission_group"),
        F.to_json(m).alias("metadata_json"),
    )


def workflow(questions: DataFrame, hits: DataFrame, threshold: float = 0.78) -> DataFrame:
    """One row per question (id, question, role) with its route and status: direct ones are answered, tool ones need the
    right to call, all others pass the gate on their hits (id, rank, score, content; doc_id, chunk_id and
    knowledge_item_id if there are any). Questions may have ``cited_doc``, the last answer's first cited document."""
    from docweave.operators import retrieval

    top = F.min_by(F.struct(*[(F.col(c) if c in hits.columns else F.lit(None)).cast("long").alias(c) for c in ("doc_id", "chunk_id", "knowledge_item_id")]), "rank")
    q = questions if "cited_doc" in questions.columns else questions.withColumn("cited_doc", F.lit(None).cast("long"))
    q = q.join(hits.groupBy("id").agg(top.alias("first")), "id", "left").withColumn("p", plan(F.col("question"), F.col("first"), F.col("cited_doc")))
    route = F.when(F.col("p").isNotNull(), "tool").otherwise(conversation.route(F.col("question"), F.lit(True), F.col("cited_doc").isNotNull()))
    q = authorised(q.select("id", "question", "role", route.alias("route"), F.col("p.tool").alias("tool"), fx.entities(F.col("question")).alias("wanted")))
    seen = hits.groupBy("id").agg(F.count("*").alias("n_hits"), F.max("score").alias("top_score"), F.array_join(F.collect_list(F.when(F.col("rank") <= 3, F.col("content"))), "\n").alias("evidence"))
    found = q.join(seen, "id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0))).withColumn("tool_ok", (F.col("route") == "tool") & F.col("allowed"))
    found = found.withColumn("missing", F.filter("wanted", lambda x: ~F.contains(F.coalesce("evidence", F.lit("")), x)))
    gated = retrieval.gate(found, threshold)
    status = F.when(F.col("route") == "direct", "answered").when((F.col("route") == "tool") & ~F.col("allowed"), "denied").when(F.col("decision") == "confident", "answered").otherwise("review")
    return gated.select("id", "route", "tool", "allowed", status.alias("status"), "decision")


def is_source_question(question: Column) -> Column:
    return conversation.mentions(fx.squeeze(question), conversation.SOURCE_MARKERS)


def clip(s: Column, most: int = 480) -> Column:
    """White space collapsed, cut with three dots."""
    c = fx.collapse(F.coalesce(s, F.lit("")))
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.left(c, F.lit(most - 3))), F.lit("...")))


def tool_summary(tool: Column, ok: Column, error: Column, data: Column) -> Column:
    """A tool result in one line, from the shape of its data (JSON): a failure's message, a content under its name, the first
    three of chunks, the first five of documents, else the data itself."""
    text = lambda path: F.get_json_object(data, path)
    first = lambda j, *keys: F.coalesce(*[F.nullif(F.get_json_object(j, f"$.{k}"), F.lit("")) for k in keys], F.lit(""))
    rows = lambda path: F.from_json(text(path), "array<string>")
    some = lambda path, n, most, *keys: F.transform(F.slice(rows(path), 1, n), lambda j: clip(first(j, *keys), most))
    label = F.coalesce(first(data, "filename", "title"), F.lit(""))
    return (
        F.when(~ok, clip(F.coalesce(F.nullif(error, F.lit("")), F.lit("工具执行失败"))))
        .when(text("$.content").isNotNull(), clip(F.concat(F.when(label == "", tool).otherwise(label), F.lit(": "), text("$.content"))))
        .when(rows("$.chunks").isNotNull(), clip(F.concat(tool, F.lit(" 返回 "), F.size(rows("$.chunks")), F.lit(" 个 chunk；"), F.array_join(some("$.chunks", 3, 180, "content", "title"), "；"))))
        .when(rows("$.documents").isNotNull(), clip(F.concat(tool, F.lit(" 返回 "), F.size(rows("$.documents")), F.lit(" 个文档："), F.array_join(some("$.documents", 5, 80, "filename", "title"), "、"))))
        .otherwise(clip(F.coalesce(data, F.lit("{}"))))
    )


def citation(doc_id: Column, chunk_id: Column, item_id: Column, title: Column, score: Column) -> Column:
    return F.struct(doc_id.alias("doc_id"), chunk_id.alias("chunk_id"), item_id.alias("knowledge_item_id"), title.alias("title"), score.alias("score"))


def docs_preview(hits: DataFrame, by: str, most: int = 3) -> DataFrame:
    """(by, preview): a line for each of the first hits (rank, title, chunk_id, score, content)."""
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("title"), F.lit(" | chunk_id="), F.coalesce(F.col("chunk_id").cast("string"), F.lit("None")), F.lit(" | score="), F.format_string("%.4f", F.round("score", 4)), F.lit(" | "), fx.preview(F.col("content"), 80))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.filter(F.col("rank") <= most).groupBy(by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("preview"))


def source_of(asked: DataFrame, hits: DataFrame, previous: DataFrame) -> DataFrame:
    """The source of an answer for each (id, document_id, filename): the first hit of that document (rank, doc_id, chunk_id,
    title, content), else the last answer's citation of it (doc_id, chunk_id, title), else the document itself."""
    top = hits.groupBy("id", F.col("doc_id").alias("document_id")).agg(F.min_by(F.struct("chunk_id", "title", "content"), "rank").alias("hit"))
    old = previous.groupBy("id", F.col("doc_id").alias("document_id")).agg(F.min_by(F.struct("chunk_id", "title"), "n").alias("old"))
    both = asked.join(top, ["id", "document_id"], "left").join(old, ["id", "document_id"], "left")
    title = F.coalesce("filename", "hit.title", "old.title", F.lit("-"))
    kind = F.when(F.col("hit").isNotNull(), "hit").when(F.col("old").isNotNull(), "citation").otherwise("document")
    return both.select("id", "document_id", title.alias("title"), F.coalesce("hit.chunk_id", "old.chunk_id").alias("chunk_id"), kind.alias("found_in"), F.col("hit.content").alias("content"))


def response(states: DataFrame) -> DataFrame:
    """What a caller gets of a question's end state (id, answer, route, citations and more): every field has its default."""
    has = lambda c, default: F.coalesce(F.col(c), default).alias(c) if c in states.columns else default.alias(c)
    none = F.array().cast("array<bigint>")
    return states.select("id", has("answer", F.lit("")), has("route", F.lit("rag")), has("citations", none), has("used_fallback", F.lit(False)), has("need_review", F.lit(False)), has("rewritten", F.lit("")))
