"""Queries of the tools and of replies' parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as fx
from docweave.operators import tools
from docweave.session import table


def tool_get_document(spark: SparkSession, d: str) -> DataFrame:
    out = tools.get_document(table(spark, d, "documents"), table(spark, d, "labels").filter("quality = 1"))
    return out.select("doc_id", F.length("content").alias("length"), "truncated", F.md5("content").alias("content_md5"))


TOOL_GET_DOCUMENT = "select doc_id, least(length(text), 24000)::int as length, length(text) > 24000 as truncated, md5(left(text, 24000)) as content_md5 from documents where doc_id in (select doc_id from labels where quality = 1)"


def tool_list_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return tools.list_documents(docs, F.col("lang") == "de", [F.desc("n_chars"), F.col("doc_id")], 99).select("doc_id", "source", "n_chars")


TOOL_LIST_DOCUMENTS = "select doc_id, source, n_chars from documents where lang = 'de' order by n_chars desc, doc_id limit 50"


_ASKED = [*tools.CASES, "这段话的出处是哪里", "请列出文件列表"]
_TOOLS = [tools.CASES.get(q, "get_document" if "出处" in q else "list_knowledge_base_documents") for q in _ASKED]


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """A question about each message, its first hit (none at every fourth turn) and the last citation (at every third)."""
    pick = (F.col("conv_id") + F.col("turn")) % len(_ASKED) + 1
    ids = F.struct(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_id"), (F.col("conv_id") * 2).alias("knowledge_item_id"))
    role = F.element_at(F.array(F.lit("viewer"), F.lit("editor"), F.lit("guest")), (F.col("turn") % 3 + 1).cast("int"))
    m = table(spark, d, "conversations").select("conv_id", "turn", role.alias("role"), F.element_at(F.array(*map(F.lit, _ASKED)), pick.cast("int")).alias("question"), F.element_at(F.array(*[F.lit(t) for t in _TOOLS]), pick.cast("int")).alias("expected"), F.when(F.col("turn") % 4 != 3, ids).alias("first"), F.when(F.col("turn") % 3 == 0, F.col("conv_id") + 7).alias("cited"))
    return m.withColumn("p", tools.plan(F.col("question"), F.col("first"), F.col("cited")))


def fn_tool_plan(spark: SparkSession, d: str) -> DataFrame:
    """Plans of questions, and whether the role may make the call."""
    args = F.array_join(F.transform(F.array_sort(F.map_entries("p.args")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    m = _asked(spark, d).select("conv_id", "turn", "role", F.col("p.tool").alias("tool"), args.alias("args"))
    return tools.authorised(m)


_ANY = lambda marks: " or ".join(f"contains(question, '{m}')" for m in marks)
_SQL_PLANS = f"""
with a as (select conv_id, turn, ['viewer', 'editor', 'guest'][turn % 3 + 1] as role, {_ASKED}[(conv_id + turn) % {len(_ASKED)} + 1] as question,
    [{", ".join("null" if t is None else f"'{t}'" for t in _TOOLS)}][(conv_id + turn) % {len(_ASKED)} + 1] as expected, turn % 4 <> 3 as hit, turn % 3 = 0 as cited from conversations),
p as (select *, case when ({_ANY(["出处", "来源", "哪个文件", "哪份文件", "来自哪个", "原文位置", "具体文件", "文件名"])}) and (hit or cited) then 'source'
    when ({_ANY(["上一段", "下一段", "相邻", "前后文", "上下文"])}) and hit then 'get_chunk_neighbors'
    when {_ANY(["有哪些文档", "文档列表", "所有文档", "文件列表"])} then 'list_knowledge_base_documents'
    when ({_ANY(["完整原文", "全文", "详细内容", "整份文档", "这份文档内容"])}) and hit then 'get_document'
    when ({_ANY(["知识条目详情", "条目内容", "这个知识条目"])}) and hit then 'get_knowledge_item' end as found from a),
t as (select *, case when found = 'source' then 'get_document' else found end as tool from p)
"""

FN_TOOL_PLAN = f"""{_SQL_PLANS}
select conv_id, turn, role, tool, case found when 'source' then 'document_id=' || case when hit then conv_id else conv_id + 7 end when 'get_chunk_neighbors' then 'chunk_id=' || turn || ',radius=2'
    when 'list_knowledge_base_documents' then 'limit=20' when 'get_document' then 'document_id=' || conv_id when 'get_knowledge_item' then 'knowledge_item_id=' || 2 * conv_id end as args,
  tool is not null and role in ('editor', 'viewer') as allowed from t
"""


def agg_tool_eval(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of the planner by expected tool: questions without a hit to take the id from count as misses."""
    tool, expected = F.coalesce("p.tool", F.lit("none")), F.coalesce("expected", F.lit("none"))
    return _asked(spark, d).groupBy(expected.alias("expected")).agg(F.count("*").alias("n"), F.round(F.avg((tool == expected).cast("int")), 6).alias("accuracy"))


AGG_TOOL_EVAL = f"{_SQL_PLANS} select coalesce(expected, 'none') as expected, count(*) as n, round(avg((tool is not distinct from expected)::int), 6) as accuracy from t group by 1"


def tool_get_item(spark: SparkSession, d: str) -> DataFrame:
    out = tools.get_knowledge_item(table(spark, d, "documents"), table(spark, d, "labels").filter("toxic = 1"))
    return out.select("doc_id", "title", "length", F.md5("content").alias("content_md5"), "truncated")


TOOL_GET_ITEM = r"""
select doc_id, left(trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')), 120) as title, length(text)::int as length, md5(left(text, 24000)) as content_md5, length(text) > 24000 as truncated
from documents where doc_id in (select doc_id from labels where toxic = 1)
"""


def fn_answer_parse(spark: SparkSession, d: str) -> DataFrame:
    """Replies made of messages: fenced JSON, and every fourth bare text."""
    used = F.array((F.col("turn") % 3).cast("int"), F.lit(1), F.lit(1))
    reply = F.when(F.col("conv_id") % 4 == 0, F.lit("plain text")).otherwise(F.concat(F.lit("```json\n"), F.to_json(F.struct(F.concat(F.lit(" a"), F.col("turn").cast("string")).alias("answer"), used.alias("used"))), F.lit("\n```")))
    a = table(spark, d, "conversations").select("conv_id", "turn", tools.answer_reply(reply).alias("a"))
    return a.select("conv_id", "turn", F.col("a.answer").alias("answer"), F.array_join(F.col("a.used"), ",").alias("used"))


FN_ANSWER_PARSE = """
select conv_id, turn, case when conv_id % 4 = 0 then 'plain text' else 'a' || turn end as answer, case when conv_id % 4 = 0 then '' when turn % 3 = 2 then '2,1' else '1' end as used from conversations
"""


def fn_citation_nums(spark: SparkSession, d: str) -> DataFrame:
    """Citations of answers that use context numbers 2, 1 and 9, of evidence that is each conversation's messages."""
    c = table(spark, d, "conversations")
    e = c.select(F.col("conv_id").alias("id"), (F.col("turn") + 1).cast("int").alias("rank"), (F.col("turn") % 2).alias("doc_id"), F.lit(0).alias("chunk_id"))
    a = c.select(F.col("conv_id").alias("id")).distinct().withColumn("used", F.array(F.lit(2), F.lit(1), F.lit(9)))
    return tools.cited(a, e, "id")


FN_CITATION_NUMS = """
with u as (select distinct conv_id as id, unnest([2, 1, 9]) as rank, unnest([0, 1, 2]) as pick from conversations),
c as (select u.id, pick, turn % 2 as doc_id, 0 as chunk_id from u join conversations v on v.conv_id = u.id and v.turn + 1 = u.rank),
f as (select * from c qualify row_number() over (partition by id, doc_id, chunk_id order by pick) = 1)
select id, (row_number() over (partition by id order by pick))::int as n, doc_id, chunk_id from f
"""


def _answers() -> Column:
    """Messages as answers: commas end sentences, and every fourth blank a paragraph or a line."""
    s = F.replace(F.replace("text", F.lit(","), F.lit("；")), F.lit("."), F.lit("。"))
    return F.when(F.col("turn") % 2 == 0, F.regexp_replace(s, "([^ ]+ [^ ]+ [^ ]+ [^ ]+) ", "$1\n")).otherwise(F.regexp_replace(s, "([^ ]+ [^ ]+ [^ ]+ [^ ]+ [^ ]+ [^ ]+) ", "$1\n\n"))


def fn_sse_split(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(tools.stream_pieces(_answers())).alias("n", "piece"))
    return p.select("conv_id", "turn", F.col("n").cast("long").alias("n"), "piece")


FN_SSE_SPLIT = r"""
with s as (select conv_id, turn, replace(replace(text, ',', '；'), '.', '。') as t from conversations),
a as (select conv_id, turn, trim(case when turn % 2 = 0 then regexp_replace(t, '([^ ]+ [^ ]+ [^ ]+ [^ ]+) ', '\1' || chr(10), 'g') else regexp_replace(t, '([^ ]+ [^ ]+ [^ ]+ [^ ]+ [^ ]+ [^ ]+) ', '\1' || chr(10) || chr(10), 'g') end, ' ' || chr(9) || chr(10) || chr(13)) as t from s),
p as (select conv_id, turn, unnest(ps) as paragraph, generate_subscripts(ps, 1) as pno from (select conv_id, turn, string_split(t, chr(10) || chr(10)) as ps from a)),
x as (select conv_id, turn, pno, list_filter(list_transform(regexp_extract_all(paragraph, '[^。！？；
]*[。！？；
]|[^。！？；
]+$'), lambda q : trim(q, ' ' || chr(9) || chr(10) || chr(13))), lambda q : q <> '') as ss from p),
f as (select conv_id, turn, pno, list_reduce(list_prepend({'done': []::varchar[], 'cur': ''}, list_transform(ss, lambda q : {'done': []::varchar[], 'cur': q})),
  lambda b, q : case when length(b.cur) + length(q.cur) <= 24 then {'done': b.done, 'cur': b.cur || q.cur} when b.cur = '' then {'done': b.done, 'cur': q.cur} else {'done': list_append(b.done, b.cur), 'cur': q.cur} end) as z from x where len(ss) > 0),
g as (select conv_id, turn, pno, list_append(z.done, z.cur) as out from f),
u as (select conv_id, turn, pno, unnest(out) as piece, generate_subscripts(out, 1) as k from g)
select conv_id, turn, row_number() over (partition by conv_id, turn order by pno, k) - 1 as n, piece from u
"""


def prj_index_doc(spark: SparkSession, d: str) -> DataFrame:
    meta = F.map_from_arrays(F.array(*map(F.lit, ("file_type", "filename", "page_number", "heading_path"))), F.array("lang", "source", (F.col("doc_id") % 9).cast("string"), F.concat(F.lit("A > "), F.col("lang"))))
    out = tools.index_documents(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), meta.alias("metadata")))
    return out.select("chunk_id", "file_type", "source_file", "page_start", "page_end", F.array_join("heading_path", "/").alias("heading_path"))


PRJ_INDEX_DOC = "select doc_id as chunk_id, lang as file_type, source as source_file, (doc_id % 9)::int as page_start, (doc_id % 9)::int as page_end, 'A/' || lang as heading_path from documents"


def flt_scope(spark: SparkSession, d: str) -> DataFrame:
    """Both owner and knowledge base, before anything is ranked."""
    return table(spark, d, "documents").filter((F.col("source") == "src0") & (F.col("lang") == "en")).select("doc_id")


FLT_SCOPE = "select doc_id from documents where source = 'src0' and lang = 'en'"


def flt_in(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang")


FLT_IN = "select doc_id, lang from documents where doc_id in (select doc_id from labels where toxic = 1)"


def fn_col_name(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", fx.column_name(F.col("p_partkey").cast("int")).alias("name"))
    return p


FN_COL_NAME = """
select p_partkey, case when p_partkey < 26 then chr((65 + p_partkey)::int) when p_partkey < 702 then chr((65 + (p_partkey - 26) // 26)::int) || chr((65 + p_partkey % 26)::int)
  else chr((65 + (p_partkey - 702) // 676)::int) || chr((65 + ((p_partkey - 702) // 26) % 26)::int) || chr((65 + p_partkey % 26)::int) end as name from part
"""


def wf_questions(spark: SparkSession, d: str) -> DataFrame:
    """The whole question flow over the user messages, each with its conversation's other messages as hits."""
    c = table(spark, d, "conversations")
    key = F.col("conv_id") * 10000 + F.col("turn")
    q = c.filter("role = 'user'").select(key.alias("id"), F.col("text").alias("question"), F.lit("viewer").alias("role"))
    hits = c.filter("role = 'user'").select(key.alias("id"), "conv_id").join(c.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("rank"), F.lit(0.8).alias("score"), F.col("text").alias("content")), "conv_id")
    return tools.workflow(q, hits)



def fn_source_q(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("conv_id", "turn", tools.is_source_question(F.col("question")).alias("source"))


FN_SOURCE_Q = f"select conv_id, turn, contains({_ASKED}[(conv_id + turn) % {len(_ASKED)} + 1], '出处') as source from conversations"


def fn_tool_summary(spark: SparkSession, d: str) -> DataFrame:
    """Results made of messages, of each shape by turn; every fifth failed, every tenth without a message."""
    t = F.col("text")
    row = lambda name: F.struct(t.alias(name))
    data = F.element_at(F.array(F.to_json(F.struct(F.col("role").alias("filename"), t.alias("content"))), F.to_json(F.struct(F.array(*[row("content")] * 4).alias("chunks"))), F.to_json(F.struct(F.array(row("filename"), row("filename")).alias("documents"))), F.lit('{"n":1}')), (F.col("turn") % 4 + 1).cast("int"))
    error = F.when(F.col("conv_id") % 10 == 0, "").otherwise(t)
    out = table(spark, d, "conversations").select("conv_id", "turn", tools.tool_summary(F.lit("tool"), F.col("conv_id") % 5 != 0, error, data).alias("summary"))
    return out.select("conv_id", "turn", F.md5("summary").alias("summary_md5"))


_CLIP = lambda c, n: f"case when length({c}) <= {n} then {c} else rtrim(left({c}, {n - 3}), ' ') || '...' end"
FN_TOOL_SUMMARY = rf"""
with m as (select conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from conversations),
p as (select *, {_CLIP("t", 180)} as chunk, {_CLIP("t", 80)} as doc from m),
q as (select *, case when conv_id % 10 = 0 then '工具执行失败' when conv_id % 5 = 0 then t when turn % 4 = 0 then trim(role || ': ' || t) when turn % 4 = 1 then trim('tool 返回 4 个 chunk；' || chunk || '；' || chunk || '；' || chunk)
  when turn % 4 = 2 then trim('tool 返回 2 个文档：' || doc || '、' || doc) else '{{"n":1}}' end as s from p)
select conv_id, turn, md5({_CLIP("s", 480)}) as summary_md5 from q
"""


def _message_hits(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a conversation as hits: their number is document and rank, role the title."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("id"), (F.col("turn") + 1).cast("int").alias("rank"), F.col("turn").alias("doc_id"), F.when(F.col("turn") % 3 != 0, F.col("turn") * 10).alias("chunk_id"), F.col("role").alias("title"), (1 / (F.col("turn") + 1)).alias("score"), F.col("text").alias("content"))


def prj_citation(spark: SparkSession, d: str) -> DataFrame:
    c = _message_hits(spark, d).select("id", "rank", tools.citation(F.col("doc_id"), F.col("chunk_id"), F.lit(None).cast("long"), F.col("title"), F.round("score", 6)).alias("c"))
    return c.select("id", "rank", "c.*")


PRJ_CITATION = "select conv_id as id, (turn + 1)::int as rank, turn as doc_id, case when turn % 3 <> 0 then turn * 10 end as chunk_id, null::bigint as knowledge_item_id, role as title, round(1.0::double / (turn + 1), 6) as score from conversations"


def prj_docs_preview(spark: SparkSession, d: str) -> DataFrame:
    return tools.docs_preview(_message_hits(spark, d), "id").select("id", F.md5("preview").alias("preview_md5"))


PRJ_DOCS_PREVIEW = r"""
with c as (select *, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from conversations where turn < 3)
select conv_id as id, md5(string_agg('[' || (turn + 1) || '] ' || role || ' | chunk_id=' || case when turn % 3 <> 0 then (turn * 10)::varchar else 'None' end || ' | score=' || printf('%.4f', round(1.0::double / (turn + 1), 4)) || ' | ' || case when length(t) <= 80 then t else left(t, 77) || '...' end, chr(10) order by turn)) as preview_md5 from c group by 1
"""


def join_source(spark: SparkSession, d: str) -> DataFrame:
    """The source of each conversation's answer, message 2 (for every second conversation 9): among the hits, else among the
    citations (turns from 8 on), else as the tool named it."""
    hits = _message_hits(spark, d).filter("rank <= 4")
    asked = hits.select("id").distinct().select("id", F.when(F.col("id") % 2 == 0, 9).otherwise(2).cast("long").alias("document_id"), F.when(F.col("id") % 4 == 0, "file").alias("filename"))
    old = _message_hits(spark, d).filter("rank > 8").select("id", "doc_id", "chunk_id", "title", F.col("rank").alias("n"))
    out = tools.source_of(asked, hits, old)
    return out.select("id", "document_id", "title", "chunk_id", "found_in", F.md5("content").alias("content_md5"))


JOIN_SOURCE = """
with a as (select distinct conv_id as id, case when conv_id % 2 = 0 then 9 else 2 end::bigint as document_id, case when conv_id % 4 = 0 then 'file' end as filename from conversations)
select id, document_id, coalesce(filename, h.role, o.role, '-') as title, case when h.conv_id is not null and h.turn % 3 <> 0 then h.turn * 10 when o.conv_id is not null and o.turn % 3 <> 0 then o.turn * 10 end as chunk_id,
  case when h.conv_id is not null then 'hit' when o.conv_id is not null then 'citation' else 'document' end as found_in, md5(h.text) as content_md5
from a left join (select * from conversations where turn < 4) h on h.conv_id = id and h.turn = document_id left join (select * from conversations where turn >= 8) o on o.conv_id = id and o.turn = document_id
"""


def prj_response(spark: SparkSession, d: str) -> DataFrame:
    states = table(spark, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("id"), F.when(F.col("conv_id") % 2 == 0, F.col("text")).alias("answer"), F.when(F.col("conv_id") % 3 == 0, "direct").alias("route"))
    out = tools.response(states)
    return out.select("id", F.md5("answer").alias("answer_md5"), "route", F.size("citations").alias("n_citations"), "used_fallback", "need_review", "rewritten")


PRJ_RESPONSE = "select conv_id as id, md5(case when conv_id % 2 = 0 then text else '' end) as answer_md5, case when conv_id % 3 = 0 then 'direct' else 'rag' end as route, 0::int as n_citations, false as used_fallback, false as need_review, '' as rewritten from conversations where turn = 0"


def fn_pdf_noise(spark: SparkSession, d: str) -> DataFrame:
    """Messages from their 20th sign on, behind a closing sign in every third conversation."""
    s = F.concat(F.when(F.col("conv_id") % 3 == 0, "，").otherwise(""), F.substring("text", 20, 60))
    return table(spark, d, "conversations").select("conv_id", "turn", fx.is_scrap(s).alias("scrap"))


FN_PDF_NOISE = """
with c as (select conv_id, turn, trim(case when conv_id % 3 = 0 then '，' else '' end || substring(text, 20, 60), ' ') as s from conversations)
select conv_id, turn, s = '' or (length(s) <= 24 and contains('，。、；：）】》', left(s, 1))) as scrap from c
"""


QUERIES = {k: (globals()[k], globals()[k.upper()]) for k in [x for x in list(globals()) if x.upper() in globals() and x.islower() and not x.startswith("_")]} | {"wf_questions": (wf_questions, None)}
