"""Conversation and context-assembly queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import text as fx
from docweave.operators import context
from docweave.operators import conversation as conv
from docweave.session import table
from docweave.sources import sinks


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def win_recent_rounds(spark: SparkSession, d: str) -> DataFrame:
    return conv.recent_rounds(_messages(spark, d), 2).select("conv_id", "turn", "role")


WIN_RECENT_ROUNDS = """
with p as (select *, coalesce(sum((role = 'user')::int) over (partition by conv_id order by turn desc rows between unbounded preceding and 1 preceding), 0) as before,
  sum((role = 'user')::int) over (partition by conv_id) as users, row_number() over (partition by conv_id order by turn desc) as rn from conversations)
select conv_id, turn, role from p where case when users > 0 then before < 2 else rn <= 4 end
"""


def win_split_rounds(spark: SparkSession, d: str) -> DataFrame:
    return conv.split_rounds(_messages(spark, d), 1).select("conv_id", "turn", "part")


WIN_SPLIT_ROUNDS = """
with p as (select *, coalesce(sum((role = 'user')::int) over (partition by conv_id order by turn desc rows between unbounded preceding and 1 preceding), 0) as before from conversations)
select conv_id, turn, case when before < 1 then 'recent' else 'older' end as part from p
"""


def win_budget_msgs(spark: SparkSession, d: str) -> DataFrame:
    """Newest messages that fit in 300 tokens, at most 6; one that does not fit is skipped."""
    m = _messages(spark, d).withColumn("cost", fx.token_estimate(F.col("text")))
    return conv.greedy_fit(m, ["conv_id"], [F.desc("turn")], "turn", "cost", 300, 6)


WIN_BUDGET_MSGS = """
with m as (select conv_id, list({'turn': turn, 'cost': case when length(text) = 0 then 0 else greatest(1, ceil(length(text) / 2))::int end} order by turn desc) as l from conversations group by 1),
f as (select conv_id, list_reduce(list_prepend({'used': 0, 'kept': []::bigint[]}, list_transform(l, lambda x : {'used': x.cost, 'kept': [x.turn]})),
   lambda a, x : case when a.used + x.used <= 300 and len(a.kept) < 6 then {'used': a.used + x.used, 'kept': list_concat(a.kept, x.kept)} else a end) as r from m)
select conv_id, r.used::bigint as used, unnest(r.kept) as turn from f
"""


def ctx_atomic(spark: SparkSession, d: str) -> DataFrame:
    """Whole items by (pinned, importance, order) that fit in 400 tokens; all others are named with the reason."""
    m = _messages(spark, d).select("conv_id", "turn", fx.token_estimate(F.col("text")).alias("cost"), (F.col("role") == "system").alias("pinned"), (F.col("turn") % 3).alias("importance"))
    return conv.atomic(m, ["conv_id"], [F.desc("pinned"), F.desc("importance"), F.col("turn")], "turn", "cost", 400)


CTX_ATOMIC = """
with m as (select conv_id, list({'turn': turn, 'cost': case when length(text) = 0 then 0 else greatest(1, ceil(length(text) / 2))::int end} order by (role = 'system') desc, turn % 3 desc, turn) as l from conversations group by 1),
f as (select conv_id, l, list_reduce(list_prepend({'used': 0, 'kept': []::bigint[]}, list_transform(l, lambda x : {'used': x.cost, 'kept': [x.turn]})),
   lambda a, x : case when a.used + x.used <= 400 then {'used': a.used + x.used, 'kept': list_concat(a.kept, x.kept)} else a end) as r from m),
u as (select conv_id, unnest(l).turn as turn, r.kept as kept from f)
select conv_id, turn, list_contains(kept, turn) as selected, case when list_contains(kept, turn) then null else 'over_budget' end as reason from u
"""


def ctx_evidence_fit(spark: SparkSession, d: str) -> DataFrame:
    """Evidence clipped one by one to min(what is left of 500 tokens, 120); the cap holds per item."""
    m = _messages(spark, d).filter("role = 'assistant'").select("conv_id", "turn", fx.token_estimate(F.col("text")).alias("cost"))
    return conv.evidence_fit(m, ["conv_id"], [F.col("turn")], "turn", "cost", 500, 120)


CTX_EVIDENCE_FIT = """
with m as (select conv_id, list({'turn': turn, 'cost': case when length(text) = 0 then 0 else greatest(1, ceil(length(text) / 2))::int end} order by turn) as l from conversations where role = 'assistant' group by 1),
f as (select conv_id, list_reduce(list_prepend({'room': 500, 'kept': []::struct(turn bigint, tokens int)[]}, list_transform(l, lambda x : {'room': x.cost, 'kept': [{'turn': x.turn, 'tokens': x.cost}]})),
   lambda a, x : case when a.room > 0 then {'room': a.room - least(x.room, a.room, 120), 'kept': list_concat(a.kept, [{'turn': x.kept[1].turn, 'tokens': least(x.room, a.room, 120)}])} else a end) as r from m),
u as (select conv_id, unnest(r.kept) as k from f)
select conv_id, k.turn as turn, k.tokens as tokens from u
"""


def win_summary_batch(spark: SparkSession, d: str) -> DataFrame:
    """Oldest messages less the last 4: at least 2, more until 200 tokens are freed, 16 at most."""
    m = _messages(spark, d).withColumn("cost", fx.token_estimate(F.col("text")))
    return conv.summary_batch(m, ["conv_id"], "turn", "cost", keep=4, least=2, need=200, most=16).select("conv_id", "turn")


_COST = "case when length(text) = 0 then 0 else greatest(1, ceil(length(text) / 2))::int end"
WIN_SUMMARY_BATCH = f"""
with p as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as rn, count(*) over (partition by conv_id) as n,
   coalesce(sum({_COST}) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as freed from conversations)
select conv_id, turn from p where rn <= n - 4 and rn <= 16 and (rn - 1 < 2 or freed < 200)
"""


def agg_tokens(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).groupBy("conv_id", "role").agg(F.sum(fx.token_estimate(F.col("text"))).alias("tokens"))
    return m.select("conv_id", "role", "tokens", F.least("tokens", F.lit(150)).alias("capped"))


AGG_TOKENS = f"select conv_id, role, sum({_COST})::bigint as tokens, least(sum({_COST}), 150)::bigint as capped from conversations group by 1, 2"


def agg_conv_summary(spark: SparkSession, d: str) -> DataFrame:
    last = F.max_by(F.struct("role", fx.preview(F.col("text"), 80).alias("preview")), "turn")
    return _messages(spark, d).groupBy("conv_id").agg(F.count("*").alias("messages"), last.alias("l")).select("conv_id", "messages", F.col("l.role").alias("last_role"), F.col("l.preview").alias("last_preview"))


AGG_CONV_SUMMARY = r"""
with t as (select conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from conversations)
select conv_id, count(*) as messages, arg_max(role, turn) as last_role, arg_max(case when length(t) <= 80 then t else left(t, 77) || '...' end, turn) as last_preview from t group by 1
"""


def win_prev_citation(spark: SparkSession, d: str) -> DataFrame:
    """The latest assistant message before each user message."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    m = _messages(spark, d).withColumn("previous", F.last(F.when(F.col("role") == "assistant", F.col("turn")), ignorenulls=True).over(w))
    return m.filter("role = 'user'").select("conv_id", "turn", "previous")


WIN_PREV_CITATION = """
select conv_id, turn, previous from (select conv_id, turn, role, max(case when role = 'assistant' then turn end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as previous from conversations) where role = 'user'
"""


def flt_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Messages behind each conversation's summary cursor (here half of its last turn)."""
    m = _messages(spark, d)
    cursor = m.groupBy("conv_id").agg(F.floor(F.max("turn") / 2).alias("cursor"))
    return conv.after_cursor(m.join(cursor, "conv_id"), "turn", "cursor").select("conv_id", "turn")


FLT_CURSOR = "select conv_id, turn from (select conv_id, turn, floor(max(turn) over (partition by conv_id) / 2) as cursor from conversations) where turn > cursor"


def topk_history(spark: SparkSession, d: str) -> DataFrame:
    """In each conversation the messages that answer its first message best, a turn standing for a day; the last 200
    messages, ten at most."""
    m = _messages(spark, d)
    asked = m.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"), F.max("turn").alias("last"))
    return conv.history(m.join(asked, "conv_id"), ["conv_id"], "turn", "text", "question", (F.col("last") - F.col("turn")).cast("double"), 200, 10)


TOPK_HISTORY = r"""
with q as (select conv_id, lower(regexp_replace(arg_min(text, turn), '\s+', '', 'g')) as q, max(turn) as last from conversations group by 1),
w as (select conv_id, q, last, list_distinct(list_filter(regexp_extract_all(q, '[a-z0-9_]+'), lambda x : length(x) >= 2)) as terms from q),
m as (select conv_id, turn, lower(regexp_replace(text, '\s+', '', 'g')) as t, row_number() over (partition by conv_id order by turn desc) as n from conversations),
s as (select conv_id, turn, round(case when t = '' or q = '' then 0 else (case when contains(t, q) then 5 else 0 end) + coalesce(list_sum(list_transform(list_filter(terms, lambda x : contains(t, x)), lambda x : 1 + least(length(x), 8) / 8.0)), 0) + 1 / (1.0 + last - turn) end, 4)::double as score
  from m join w using (conv_id) where n <= 200)
select conv_id, turn, score, (row_number() over (partition by conv_id order by score desc, turn desc))::int as rank from s where score > 0 qualify rank <= 10
"""

_QUESTIONS = ["你好", "hello, 在吗", "什么是 RAG？", "这个流程需要多少天才能完成审批", "那谁负责呢？", "有哪些文档", "这段话的来源在哪里", "", "之前说过的条件还有效吗", "采购复核的触发条件是什么？", "历史消息里的结论是什么来着", "合同审批需要什么"]


def fn_route_rule(spark: SparkSession, d: str) -> DataFrame:
    """Routes, rewriting and gaps of questions, one for each message: the context is the message before (none at first,
    and for every fifth conversation only a word that points back)."""
    q = F.element_at(F.array(*map(F.lit, _QUESTIONS)), ((F.col("conv_id") * 5 + F.col("turn")) % len(_QUESTIONS) + 1).cast("int"))
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    m = _messages(spark, d).select("conv_id", "turn", q.alias("q"), F.when(F.col("conv_id") % 5 == 0, "这个 上面。").otherwise(F.coalesce(before, F.lit(""))).alias("context"))
    m = m.select("conv_id", "turn", conv.route("q", F.col("conv_id") % 7 != 0, F.col("turn") > 2).alias("route"), conv.rewrite("q", F.col("turn") > 0).alias("r"), conv.gap("q", F.col("context")).alias("g"))
    return m.select("conv_id", "turn", "route", F.col("r.needed").alias("rewrite"), F.col("r.reason").alias("reason"), F.array_join("g.triggers", ",").alias("triggers"), F.array_join("g.missing", ",").alias("missing"))


_HAS = lambda marks: "(" + " or ".join(f"contains(q, '{m}')" for m in marks) + ")"
FN_ROUTE_RULE = rf"""
with m as (select conv_id, turn, lower(regexp_replace({_QUESTIONS}[(conv_id * 5 + turn) % {len(_QUESTIONS)} + 1], '\s+', '', 'g')) as q,
   conv_id % 5 = 0 or coalesce(regexp_replace(lag(text) over (partition by conv_id order by turn), '[\s，。！？、,:：;；]+', '', 'g'), '') = '' as bare from conversations),
p as (select *, list_filter(['它', '这个', '那个', '上面', '之前', '刚才', '上次', '前面', '上述', '该问题', '该流程', '这个条件'], lambda x : contains(q, x)) as points,
   {_HAS(["之前说过", "上次提到", "刚才说的", "历史消息", "前面提到", "之前的对话"])} as said from m),
t as (select *, list_filter([case when said then 'explicit_history_reference' end, case when len(points) > 0 and bare then 'pronoun_without_antecedent' end,
   case when length(q) <= 8 and bare then 'short_question_without_context' end, case when bare and regexp_matches(q, '^(那|然后|继续|还要|为什么|怎么)') then 'continuation_without_context' end], lambda x : x is not null and q <> '') as hit from p)
select conv_id, turn, case when q = '' or regexp_matches(q, '^(你好|您好|hi|hello)($|[^\p{{L}}\p{{N}}_])') or regexp_matches(q, '^什么是(rag|agent|docker|langgraph)[？?]?$') then 'direct'
    when turn > 2 and {_HAS(conv.TOOL_MARKERS)} or conv_id % 7 <> 0 and {_HAS(["有哪些文档", "文档列表", "所有文档", "文件列表"])} then 'tool' when conv_id % 7 = 0 then 'direct' else 'rag' end as route,
  case when q = '' then 'empty_question' when turn = 0 then 'no_conversation_context' when {_HAS(conv.POINTING)} then 'contains_context_reference' when length(q) <= 8 then 'question_is_too_short'
    when regexp_matches(q, '^(那|然后|继续|还有|除此之外)') or regexp_matches(q, '(多久|谁负责|怎么处理|可以吗|是否一样|需要什么)(呢|吗)?[？?]?$') then 'matches_context_dependent_pattern' else 'question_is_self_contained' end as reason,
  reason in ('contains_context_reference', 'question_is_too_short', 'matches_context_dependent_pattern') as rewrite,
  array_to_string(hit, ',') as triggers, case when len(hit) > 0 then array_to_string(points, ',') else '' end as missing from t
"""


#: How users of these tables begin a message that shall be remembered; the last two are no such message.
_ASKS = ("请记住：", "以后都按 ", "最终决定:", "不要再改", "确定使用", "记住 ", "please remember ", "")


def asked_to_remember() -> Column:
    return F.concat(F.element_at(F.array(*map(F.lit, _ASKS)), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int")), F.col("text"))


MEMORIES_SQL = r"""
b as (select conv_id, turn, (conv_id + turn) % 8 as p, trim(regexp_replace(['请记住：', '以后都按 ', '最终决定:', '不要再改', '确定使用', '记住 ', 'please remember ', ''][(conv_id + turn) % 8 + 1] || text, '\s+', ' ', 'g')) as c from conversations where role = 'user'),
m as (select conv_id, turn, case when p in (2, 4) then 'decision' else 'constraint' end as kind,
  trim(regexp_extract(c, '^(?:(?:请)?记住[：:]?|以后都按|最终决定[：:]?|确定使用[：:]?|不要再改[：:]?)\s*(.+)$', 1), ' \t\r\n。！？!?；;') as content from b where p < 6),
k as (select conv_id, turn, kind, left(content, 2000) as content, lower(regexp_replace(left(content, 2000), '\s+', '', 'g')) as key from m where length(content) >= 2)
"""


def fn_memory(spark: SparkSession, d: str) -> DataFrame:
    """Explicit memories in user messages; one that a conversation already has (here: those of turns under 4) is not taken again."""
    m = _messages(spark, d).filter("role = 'user'").select("conv_id", "turn", conv.memory(asked_to_remember()).alias("m"))
    m = m.filter("m is not null").select("conv_id", "turn", "m.kind", "m.content")
    return conv.new_memories(m.filter("turn >= 4"), ["conv_id"], "content", "turn", active=m.filter("turn < 4")).select("conv_id", "turn", "kind", F.md5("content").alias("content_md5"))


FN_MEMORY = f"""
with {MEMORIES_SQL}
select conv_id, turn, kind, md5(content) as content_md5 from k where turn >= 4 and not exists (select 1 from k o where o.conv_id = k.conv_id and o.key = k.key and o.turn < 4)
qualify row_number() over (partition by conv_id, key order by turn) = 1
"""


def st_memory_archive(spark: SparkSession, d: str) -> DataFrame:
    """Memories of user messages, and the assistant's next message as a request to archive them: by their creator (even
    conversations), an admin (every fifth), or somebody who may not."""
    m = _messages(spark, d)
    made = m.filter("role = 'user'").select("conv_id", "turn", conv.memory(asked_to_remember()).alias("m")).filter("m is not null")
    made = made.select((F.col("conv_id") * 1000 + F.col("turn")).alias("memory_id"), (F.col("conv_id") % 7).alias("org"), F.col("conv_id").alias("created_by"), F.lit("active").alias("status"), F.col("turn").alias("updated_at"), "m.kind")
    actor = F.when(F.col("conv_id") % 2 == 0, F.col("conv_id")).otherwise(F.lit(-1).cast("long"))
    asks = m.filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("memory_id"), (F.col("conv_id") % 7).alias("org"), actor.alias("actor"), F.when(F.col("conv_id") % 5 == 0, "admin").otherwise("editor").alias("role"), F.col("turn").alias("at"))
    return conv.archive(made, asks).select("memory_id", "kind", "status", F.col("updated_at").cast("long").alias("updated_at"))


ST_MEMORY_ARCHIVE = f"""
with {MEMORIES_SQL},
a as (select conv_id, turn - 1 as turn, turn as "at" from conversations where role = 'assistant' and (conv_id % 2 = 0 or conv_id % 5 = 0))
select conv_id * 1000 + turn as memory_id, any_value(kind) as kind, case when min("at") is null then 'active' else 'archived' end as status, coalesce(min("at"), turn)::bigint as updated_at
from k left join a using (conv_id, turn) group by conv_id, turn
"""


def st_summary_trigger(spark: SparkSession, d: str) -> DataFrame:
    """Conversations whose tokens reach 70 % of a budget of 1000, and how many must go to come to 60 %."""
    t = _messages(spark, d).groupBy("conv_id").agg(F.sum(fx.token_estimate(F.col("text"))).alias("tokens"))
    return t.select("conv_id", "tokens", (F.col("tokens") >= 700).alias("triggered"), F.when(F.col("tokens") >= 700, F.col("tokens") - 600).otherwise(0).cast("long").alias("to_free"))


ST_SUMMARY_TRIGGER = f"select conv_id, tokens, tokens >= 700 as triggered, (case when tokens >= 700 then tokens - 600 else 0 end)::bigint as to_free from (select conv_id, sum({_COST})::bigint as tokens from conversations group by 1)"


def ctx_purposes(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's tokens against the three purposes' budgets."""
    t = _messages(spark, d).groupBy("conv_id").agg(F.sum(fx.token_estimate(F.col("text"))).alias("tokens"))
    p = F.explode(F.array(*[F.struct(F.lit(n).alias("purpose"), F.lit(b).alias("budget")) for n, b in conv.BUDGETS.items()]))
    return t.withColumn("p", p).select("conv_id", "p.purpose", F.least("tokens", F.col("p.budget").cast("long")).alias("used"), (F.col("tokens") > F.col("p.budget")).alias("over"))


CTX_PURPOSES = f"""
select conv_id, purpose, least(tokens, budget)::bigint as used, tokens > budget as over from (select conv_id, sum({_COST})::bigint as tokens from conversations group by 1)
cross join (values ('router', 800), ('rewrite', 1600), ('answer', 6000)) b(purpose, budget)
"""


def set_dedupe_refs(spark: SparkSession, d: str) -> DataFrame:
    """Messages stand in for tool references: one for each text, the newest; protected (system) first, then the newest to
    fill five."""
    m = _messages(spark, d).select("conv_id", "turn", F.md5("text").alias("ref"), (F.col("role") == "system").alias("protected"))
    return conv.compact_refs(m, ["conv_id"], "ref", "turn", "protected", 5).select("conv_id", "turn")


SET_DEDUPE_REFS = """
with one as (select conv_id, turn, role = 'system' as protected from conversations qualify row_number() over (partition by conv_id, md5(text) order by turn desc) = 1)
select conv_id, turn from one qualify protected or row_number() over (partition by conv_id order by protected desc, turn desc) <= 5
"""

def st_summary_version(spark: SparkSession, d: str) -> DataFrame:
    """Two summaries of every conversation: one made from the version in force in two of three, a later one from a random state."""
    c = _messages(spark, d).groupBy("conv_id").agg(F.max("turn").cast("long").alias("last"))
    now = c.select("conv_id", F.lit("old").alias("summary"), (F.col("conv_id") % 3).cast("int").alias("version"), F.when(F.col("conv_id") % 4 > 0, F.col("conv_id") % 4).alias("cursor"))
    one = c.select("conv_id", F.lit(0).alias("based_version"), F.when(F.col("conv_id") % 4 > 0, F.col("conv_id") % 4).alias("based_cursor"), F.lit("one").alias("summary"), F.col("last").alias("cursor"), F.lit(2).alias("at"))
    two = c.select("conv_id", (F.col("conv_id") % 2).cast("int").alias("based_version"), F.lit(None).cast("long").alias("based_cursor"), F.lit("two").alias("summary"), (F.col("last") - 1).alias("cursor"), F.lit(1).alias("at"))
    return conv.apply_summaries(now, one.union(two))


ST_SUMMARY_VERSION = """
with c as (select conv_id, max(turn)::bigint as last, (conv_id % 3)::int as version, nullif(conv_id % 4, 0) as cursor from conversations group by 1),
o as (select *, case when cursor is null and version = conv_id % 2 then 'two' when version = 0 then 'one' end as won from c)
select conv_id, coalesce(won, 'old') as summary, (version + (won is not null)::int)::int as version, case won when 'one' then last when 'two' then last - 1 else cursor end as cursor, won is not null as updated from o
"""


def topk_memories(spark: SparkSession, d: str) -> DataFrame:
    """Messages as memories: the seven most important active ones of each conversation."""
    m = _messages(spark, d).select("conv_id", (F.col("turn") * 10).alias("memory_id"), F.when(F.col("turn") % 5 == 0, "archived").otherwise("active").alias("status"), (F.length("text") % 4).alias("importance"), (F.length("text") % 3).alias("updated_at"))
    return conv.top_memories(m, ["conv_id"], 7).select("conv_id", "memory_id", "rank")


TOPK_MEMORIES = """
select conv_id, turn * 10 as memory_id, (row_number() over (partition by conv_id order by length(text) % 4 desc, length(text) % 3 desc, turn desc))::int as rank from conversations where turn % 5 <> 0 qualify rank <= 7
"""


def ctx_hard_wm(spark: SparkSession, d: str) -> DataFrame:
    """Messages as tools, history and evidence of a context of 1,000 tokens that is nearly full."""
    kind = F.element_at(F.array(F.lit("tool"), F.lit("history"), F.lit("evidence")), (F.col("turn") % 3 + 1).cast("int"))
    m = _messages(spark, d).select("conv_id", F.col("turn").alias("n"), kind.alias("kind"), (F.length("text") % 7 == 0).alias("protected"), (F.length("text") % 5).cast("double").alias("score"), fx.token_estimate(F.col("text")).alias("tokens"), (F.col("conv_id") % 10 * 50 + 600).alias("used"))
    return conv.hard_limit(m, ["conv_id"], "used", 1000).select("conv_id", "n", "kind")


CTX_HARD_WM = f"""
with m as (select conv_id, turn as n, ['tool', 'history', 'evidence'][turn % 3 + 1] as kind, length(text) % 7 = 0 as protected, length(text) % 5 as score, {_COST} as tokens, conv_id % 10 * 50 + 600 >= 950 as over from conversations),
r as (select *, row_number() over (partition by conv_id, kind order by protected desc, score desc, n desc) as place from m),
f as (select *, sum(tokens) over (partition by conv_id) as left_over from r where not over or kind = 'evidence' or place <= 3)
select conv_id, n, kind from f where not over or left_over <= 750 or place <= case when kind = 'evidence' then 2 else 1 end
"""


def snk_sse(spark: SparkSession, d: str) -> DataFrame:
    """Messages sent as event frames and read again by a client: answers as text, others as JSON, of which some is broken."""
    m = _messages(spark, d)
    event = F.when(F.col("turn") % 2 == 0, "answer").otherwise("node")
    data = F.when(F.col("turn") % 2 == 0, F.regexp_replace("text", " ", "\n")).when(F.col("turn") % 3 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"n": '), F.col("turn"), F.lit("}")))
    frames = sinks.event_frames(m.select(F.col("conv_id").cast("string").alias("thread"), F.col("turn").alias("n"), event.alias("event"), data.alias("data")))
    return sinks.parse_frames(frames).select("thread", "n", "event", F.md5("data").alias("data_md5"))


SNK_SSE = """
select conv_id::varchar as thread, turn as n, case when turn % 2 = 0 then 'answer' else 'node' end as event,
  md5(case when turn % 2 = 0 then replace(text, ' ', chr(10)) when turn % 3 <> 0 then '{"n": ' || turn || '}' end) as data_md5 from conversations
"""


def ctx_coerce(spark: SparkSession, d: str) -> DataFrame:
    """Messages as a checkpoint may hold them: whole objects, objects with a summary only, without content, broken, plain text."""
    t, text = F.col("turn"), F.col("text")
    whole = F.to_json(F.struct(F.concat(F.lit(" "), text, F.lit("\n")).alias("content"), F.lit("note").alias("kind"), F.array(t, t + 1).alias("source_ids"), F.lit(0).alias("importance"), (t / 2).alias("score"), (t % 2 == 0).alias("pinned"), F.struct(F.col("role")).alias("metadata")))
    short = F.to_json(F.struct(F.lit("").alias("content"), text.alias("summary"), t.alias("id"), F.lit("much").alias("importance")))
    raw = F.element_at(F.array(whole, short, F.lit('{"content": " ", "id": 4}'), F.lit('{"content": "cut'), text), (F.expr("pmod(conv_id + turn, 5)") + 1).cast("int"))
    items = _messages(spark, d).select("conv_id", "turn", context.coerce_item(raw, t, "memory").alias("i"), context.coerce_evidence(raw).alias("e"))
    return items.select("conv_id", "turn", "i.kind", F.md5("i.content").alias("content_md5"), F.array_join("i.source_ids", ",").alias("sources"), "i.importance", "i.pinned", F.col("i.metadata")["role"].alias("said_by"), F.md5("e.content").alias("evidence_md5"), F.col("e.score").alias("score"))


CTX_COERCE = """
with c as (select *, (conv_id + turn) % 5 as f, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as bare from conversations)
select conv_id, turn, case f when 0 then 'note' when 2 then null when 3 then null else 'memory' end as kind, case when f in (0, 1, 4) then md5(bare) end as content_md5,
  case f when 0 then turn || ',' || (turn + 1) when 1 then case when turn > 0 then turn::varchar else '' end when 4 then turn::varchar end as sources,
  case f when 0 then turn / 2 when 1 then 0 when 4 then 0 end::double as importance, case when f = 0 then turn % 2 = 0 when f in (1, 4) then false end as pinned,
  case when f = 0 then role end as said_by, case f when 0 then md5(' ' || text || chr(10)) when 1 then md5('') when 2 then md5(' ') when 3 then md5('') end as evidence_md5,
  case f when 0 then turn / 2 when 1 then 0 when 2 then 0 when 3 then 0 end::double as score from c
"""

_CAPS = {"system": 40, "memory": 100, "summary": 60, "history": 150, "evidence": 120, "tool": 90}
_AUX = ("tool", "history", "evidence", "memory")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Messages, and beside each an item of another kind; every other conversation has a summary."""
    m = _messages(spark, d)
    traits = lambda kind, n, role, text: [kind.alias("kind"), n.cast("long").alias("n"), role.alias("role"), text.alias("text"), (F.col("turn") % 3 == 0).alias("pinned"), (F.length("text") % 3).alias("importance"), (F.length("text") % 7 == 0).alias("protected"), (F.length("text") % 5).cast("double").alias("score")]
    none = F.lit(None).cast("string")
    said = m.select("conv_id", *traits(F.lit("message"), F.col("turn"), F.col("role"), F.left("text", F.lit(400))))
    aux = F.element_at(F.array(*map(F.lit, _AUX)), (F.expr("pmod(conv_id + turn * 3, 4)") + 1).cast("int"))
    beside = m.select("conv_id", *traits(aux, F.col("turn"), none, F.left("text", F.lit(180))))
    summed = m.filter("turn = 0 and conv_id % 2 = 0").select("conv_id", *traits(F.lit("summary"), F.lit(0), none, F.left("text", F.lit(150))))
    return said.unionByName(beside).unionByName(summed)


def _gist(lines: Column, prior: Column) -> Column:
    """Stands in for a model's summary; of an odd number of lines it makes none, as a model that fails."""
    return F.when(F.size(lines) % 2 == 0, F.concat_ws(" ", prior, F.size(lines).cast("string"), F.left(F.element_at(lines, 1), F.lit(60))))


def ctx_answer(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of 900 tokens: older rounds summed up and candidates thinned out where a request is full."""
    c = context.answer_context(_requests(spark, d), ["conv_id"], 900, _CAPS, _gist)
    return c.select("conv_id", "kind", "n", "tokens", "selected", "reason", "used", F.array_join("actions", ",").alias("actions"), F.md5("text").alias("text_md5"))


def _sql_tokens(text: str) -> str:
    return f"(case when length({text}) = 0 then 0 else greatest(1, ceil(length({text}) / 2))::int end)"


def _sql_need(counted: str) -> str:
    of = [f"coalesce(sum(tokens) filter (kind = '{k}' and {counted}) over (partition by conv_id), 0)" for k in conv.REGIONS]
    return " + ".join(f"least({s}, {_CAPS[k]})" if k in _CAPS else s for s, k in zip(of, conv.REGIONS, strict=True))


def _sql_capped(kind: str) -> str:
    room = f"(case {kind} when 'summary' then 60 else 40 end)"
    return f"(case when {kind} = 'summary' and {_sql_tokens('text')} > {room} then left(text, 2 * {room} - 4) || '...' else text end)"


_STAY = "(kind not in ('tool', 'history') or place <= 3 or (kind = 'tool' and protected))"
_LAST = "(kind not in ('tool', 'history', 'evidence') or place <= (case kind when 'evidence' then 2 else 1 end) or (kind = 'tool' and protected))"
_REGION = "list_position(['system', 'memory', 'summary', 'message', 'history', 'evidence', 'tool'], kind)"
_ASKED = f"""
t as (select conv_id, turn, role, text, turn % 3 = 0 as pinned, length(text) % 3 as importance, length(text) % 7 = 0 as protected, length(text) % 5 as score from conversations),
i0 as (select conv_id, 'message' as kind, turn as n, role, left(text, 400) as text, pinned, importance, protected, score from t
  union all select conv_id, ['tool', 'history', 'evidence', 'memory'][(conv_id + turn * 3) % 4 + 1], turn, null, left(text, 180), pinned, importance, protected, score from t
  union all select conv_id, 'summary', 0, null, left(text, 150), pinned, importance, protected, score from t where turn = 0 and conv_id % 2 = 0),
i1 as (select * exclude (text), {_sql_capped('kind')} as text from i0)
"""
CTX_ANSWER = f"""
with {_ASKED},
i2 as (select *, {_sql_tokens('text')} as tokens from i1),
i3 as (select *, {_sql_need('true')} >= 855 as full_up, coalesce(sum((kind = 'message' and role = 'user')::int) over (partition by conv_id order by n desc rows between unbounded preceding and 1 preceding), 0) as later from i2),
i4 as (select *, kind = 'message' and full_up and later >= 2 as old from i3),
g as (select conv_id, list(role || ': ' || text order by n) filter (old) as lines, max(text) filter (kind = 'summary') as prior from i4 group by 1),
s as (select conv_id, concat_ws(' ', prior, len(lines)::varchar, left(lines[1], 60)) as text from g where len(lines) > 0 and len(lines) % 2 = 0),
i5 as (select conv_id, kind, n, text, pinned, importance, protected, score, conv_id in (select conv_id from s) as summed from i4 where not (conv_id in (select conv_id from s) and (old or kind = 'summary'))
  union all select conv_id, 'summary', 0, {_sql_capped("'summary'")}, false, 0, false, null, true from s),
i6 as (select *, {_sql_tokens('text')} as tokens, row_number() over (partition by conv_id, kind order by protected desc, case when kind = 'history' then importance else score end desc nulls last, case when kind = 'tool' then -n else n end) as place from i5),
i7 as (select *, {_sql_need('true')} >= 855 as full_now, {_sql_need(_STAY)} > 675 as much, coalesce(sum((kind = 'tool' and not {_STAY})::int) over (partition by conv_id), 0) > 0 as cut from i6),
i8 as (select *, concat_ws(',', case when full_now then 'hard_watermark_preflight' end, case when full_now and cut then 'evict_old_tool_results' end, case when full_now then 'reduce_relevant_history,rank_evidence_for_budget' end,
    case when full_now and much then 'emergency_reduce_context_candidates' end, case when summed then 'hard_conversation_compaction,summary_compact_for_request' end) as actions,
  case when full_now and kind = 'evidence' then place else n end as spot from i7 where not full_now or ({_STAY} and (not much or {_LAST}))),
l as (select conv_id, list({{'used': tokens::bigint, 'r': {_REGION}::bigint, 'here': (case kind when 'memory' then 100 when 'summary' then 60 when 'history' then 150 when 'evidence' then 120 when 'tool' then 90 else 900 end)::bigint,
    'out': [{{'kind': kind, 'spot': spot::bigint, 'ok': true}}]}} order by {_REGION}, (kind in ('memory', 'history') and pinned) desc, case when kind in ('memory', 'history') then importance else 0 end desc, case when kind = 'message' then -spot else spot end) as l from i8 group by 1),
f as (select conv_id, list_reduce(list_prepend({{'used': 0::bigint, 'r': 0::bigint, 'here': 0::bigint, 'out': []::struct(kind varchar, spot bigint, ok boolean)[]}}, l), lambda a, x : case
    when a.used + x.used <= 900 and (case when a.r = x.r and x.r <> 6 then a.here else 0 end) + x.used <= x.here
    then {{'used': a.used + x.used, 'r': x.r, 'here': (case when a.r = x.r then a.here else 0 end) + x.used, 'out': list_concat(a.out, [{{'kind': x.out[1].kind, 'spot': x.out[1].spot, 'ok': true}}])}}
    else {{'used': a.used, 'r': x.r, 'here': case when a.r = x.r then a.here else 0 end, 'out': list_concat(a.out, [{{'kind': x.out[1].kind, 'spot': x.out[1].spot, 'ok': false}}])}} end) as r from l),
u as (select conv_id, r.used as used, unnest(r.out) as o from f)
select i8.conv_id, i8.kind, i8.n::bigint as n, i8.tokens, u.o.ok as selected, case when not u.o.ok then 'over_budget' end as reason, u.used, i8.actions, md5(i8.text) as text_md5
from i8 join u on u.conv_id = i8.conv_id and u.o.kind = i8.kind and u.o.spot = i8.spot
"""

QUERIES = {
    "ctx_coerce": (ctx_coerce, CTX_COERCE),
    "ctx_answer": (ctx_answer, CTX_ANSWER),
    "win_recent_rounds": (win_recent_rounds, WIN_RECENT_ROUNDS),
    "win_split_rounds": (win_split_rounds, WIN_SPLIT_ROUNDS),
    "win_budget_msgs": (win_budget_msgs, WIN_BUDGET_MSGS),
    "ctx_atomic": (ctx_atomic, CTX_ATOMIC),
    "ctx_evidence_fit": (ctx_evidence_fit, CTX_EVIDENCE_FIT),
    "win_summary_batch": (win_summary_batch, WIN_SUMMARY_BATCH),
    "agg_tokens": (agg_tokens, AGG_TOKENS),
    "agg_conv_summary": (agg_conv_summary, AGG_CONV_SUMMARY),
    "win_prev_citation": (win_prev_citation, WIN_PREV_CITATION),
    "flt_cursor": (flt_cursor, FLT_CURSOR),
    "topk_history": (topk_history, TOPK_HISTORY),
    "fn_route_rule": (fn_route_rule, FN_ROUTE_RULE),
    "st_summary_version": (st_summary_version, ST_SUMMARY_VERSION),
    "topk_memories": (topk_memories, TOPK_MEMORIES),
    "ctx_hard_wm": (ctx_hard_wm, CTX_HARD_WM),
    "snk_sse": (snk_sse, SNK_SSE),
    "fn_memory": (fn_memory, FN_MEMORY),
    "st_memory_archive": (st_memory_archive, ST_MEMORY_ARCHIVE),
    "st_summary_trigger": (st_summary_trigger, ST_SUMMARY_TRIGGER),
    "ctx_purposes": (ctx_purposes, CTX_PURPOSES),
    "set_dedupe_refs": (set_dedupe_refs, SET_DEDUPE_REFS),
}
