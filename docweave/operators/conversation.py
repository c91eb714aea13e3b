"""Conversation windows, budgets and rules.

Folds over a group's rows hold that group in one task; a conversation is bounded by what its users typed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import text as fx

#: Tokens that each purpose may use.
BUDGETS = {"router": 800, "rewrite": 1600, "answer": 6000}


def _user_turns_after(group: list[str]) -> Column:
    w = Window.partitionBy(*group).orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum((F.col("role") == "user").cast("int")).over(w), F.lit(0))


def recent_rounds(messages: DataFrame, rounds: int, fallback: int = 4, group: str = "conv_id") -> DataFrame:
    """The last ``rounds`` user turns and all that follows them; without any user turn the last ``fallback`` messages."""
    users = F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy(group))
    rn = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("turn")))
    m = messages.withColumns({"__before": _user_turns_after([group]), "__users": users, "__rn": rn})
    return m.filter(F.when(F.col("__users") > 0, F.col("__before") < rounds).otherwise(F.col("__rn") <= fallback)).drop("__before", "__users", "__rn")


def split_rounds(messages: DataFrame, rounds: int, group: str = "conv_id") -> DataFrame:
    return messages.withColumn("part", F.when(_user_turns_after([group]) < rounds, "recent").otherwise("older"))


def after_cursor(messages: DataFrame, id_col: str, cursor: str) -> DataFrame:
    return messages.filter(F.col(id_col).isNull() | F.col(cursor).isNull() | (F.col(id_col) > F.col(cursor)))


def _ordered(df: DataFrame, group: list[str], order: list[Column], **fields: Column) -> DataFrame:
    """One row per group with its rows as an array in order."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    rows = df.select(*group, F.struct(n.alias("n"), *[c.alias(k) for k, c in fields.items()]).alias("row"))
    return rows.groupBy(*group).agg(F.array_sort(F.collect_list("row")).alias("rows"))


def greedy_fit(df: DataFrame, group: list[str], order: list[Column], id_col: str, cost: str, budget: int, most: int) -> DataFrame:
    """Walks the rows in order and keeps each that still fits; one that does not is skipped, the walk goes on. One row per
    kept id, with what the group used in all."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        fits = (a["used"] + x["cost"] <= budget) & (F.size(a["kept"]) < most)
        return F.struct(F.when(fits, a["used"] + x["cost"]).otherwise(a["used"]).alias("used"), F.when(fits, F.concat(a["kept"], F.array(x["id"]))).otherwise(a["kept"]).alias("kept"))

    rows = _ordered(df, group, order, id=F.col(id_col).cast("long"), cost=F.col(cost).cast("long"))
    return rows.select(*group, F.aggregate("rows", start, step).alias("r")).select(*group, F.col("r.used").alias("used"), F.explode("r.kept").alias(id_col))


def atomic(df: DataFrame, group: list[str], order: list[Column], id_col: str, cost: str, budget: int) -> DataFrame:
    """Whole items in order, each taken if it fits: one row per item with selected and the reason if not."""
    kept = greedy_fit(df, group, order, id_col, cost, budget, 1 << 30).select(*group, id_col, F.lit(True).alias("taken"))
    out = df.join(kept, [*group, id_col], "left")
    return out.select(*group, id_col, F.coalesce("taken", F.lit(False)).alias("selected"), F.when(F.col("taken").isNull(), F.lit("over_budget")).alias("reason"))


def evidence_fit(df: DataFrame, group: list[str], order: list[Column], id_col: str, cost: str, budget: int, cap: int) -> DataFrame:
    """Items in order, each cut to what is left of the budget and to ``cap`` (for each item, not in all), until nothing is
    left."""
    kind = "array<struct<id:long,tokens:int>>"
    start = F.struct(F.lit(budget).cast("int").alias("room"), F.array().cast(kind).alias("kept"))

    def step(a: Column, x: Column) -> Column:
        take = F.least(x["cost"], a["room"], F.lit(cap)).cast("int")
        live = a["room"] > 0
        return F.struct(
            F.when(live, a["room"] - take).otherwise(a["room"]).cast("int").alias("room"),
            F.when(live, F.concat(a["kept"], F.array(F.struct(x["id"].alias("id"), take.alias("tokens"))))).otherwise(a["kept"]).cast(kind).alias("kept"),
        )

    rows = _ordered(df, group, order, id=F.col(id_col).cast("long"), cost=F.col(cost).cast("int"))
    return rows.select(*group, F.explode(F.aggregate("rows", start, step)["kept"]).alias("k")).select(*group, F.col("k.id").alias(id_col), F.col("k.tokens").alias("tokens"))


def summary_batch(df: DataFrame, group: list[str], id_col: str, cost: str, keep: int, least: int, need: int, most: int) -> DataFrame:
    """The oldest rows that a summary takes over: never the last ``keep``, at most ``most``, at least ``least`` and more
    until ``need`` tokens are freed."""
    w = Window.partitionBy(*group).orderBy(id_col)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rn, freed = F.row_number().over(w), F.coalesce(F.sum(cost).over(before), F.lit(0))
    m = df.withColumns({"__rn": rn, "__freed": freed, "__n": F.count("*").over(Window.partitionBy(*group))})
    return m.filter((F.col("__rn") <= F.col("__n") - keep) & (F.col("__rn") <= most) & ((F.col("__rn") - 1 < least) | (F.col("__freed") < need))).drop("__rn", "__freed", "__n")


def apply_summaries(conversations: DataFrame, updates: DataFrame, key: str = "conv_id") -> DataFrame:
    """Conversations (key, summary, version, cursor) after summaries (key, based_version, based_cursor, summary, cursor, at) that were
    made meanwhile. A summary counts only if the conversation still has the version and cursor that it was made from; of
    several that do, the first one to be finished does, and the others have come too late. ``updated`` tells which
    conversations took one."""
    u = updates.select(F.col(key).alias("__key"), F.col("based_version").alias("__v"), F.col("based_cursor").alias("__c"), F.struct("at", F.col("summary").alias("s"), F.col("cursor").alias("c")).alias("__u"))
    same = (F.col(key) == F.col("__key")) & (F.col("version") == F.col("__v")) & F.col("cursor").eqNullSafe(F.col("__c"))
    first = conversations.select(key, "version", "cursor").join(u, same).groupBy(F.col(key).alias("__key")).agg(F.min("__u").alias("__u"))
    hit = F.col("__u").isNotNull()
    out = conversations.join(first, F.col(key) == F.col("__key"), "left").withColumn("updated", hit)
    new = {"summary": F.when(hit, F.col("__u.s")).otherwise(F.col("summary")), "version": F.col("version") + hit.cast("int"), "cursor": F.when(hit, F.col("__u.c")).otherwise(F.col("cursor"))}
    return out.withColumns(new).select(*conversations.columns, "updated")


def recover(questions: DataFrame, messages: DataFrame, key: str = "conv_id", last: int = 200, most: int = 10) -> DataFrame:
    """What the history has on questions (key, question; context, if there is any) that refer to something not said in it: messages (key, turn, role, text,
    age_days) by ``history``, as lines of a context. Questions without a gap read no message."""
    context = F.coalesce("context", F.lit("")) if "context" in questions.columns else F.lit("")
    flagged = questions.withColumn("__gap", gap(F.col("question"), context)).filter("__gap.needed").select(key, "question", F.array_join("__gap.triggers", ",").alias("reason"))
    met = messages.join(flagged, key)
    found = history(met, [key], "turn", "text", "question", F.col("age_days"), last, most)
    lines = met.select(key, "turn", "reason", F.concat_ws(": ", F.coalesce("role", F.lit("history")), F.col("text")).alias("content"))
    return found.join(lines, [key, "turn"])


def history(df: DataFrame, group: list[str], order: str, text: str, query: str, age_days: Column, last: int, most: int) -> DataFrame:
    """Of the last ``last`` messages of each group the ``most`` that answer ``query`` best: 5 for the whole phrase, and for
    each of its terms 1 and an eighth for each sign up to 8; newer ones win where that is equal."""
    w = Window.partitionBy(*group).orderBy(F.desc(order))
    m = df.withColumns({"__n": F.row_number().over(w), "__days": F.greatest(age_days, F.lit(0.0))}).filter(F.col("__n") <= last)
    low, asked = fx.squeeze(F.col(text)), fx.squeeze(F.col(query))
    matched = F.filter(fx.history_terms(asked), lambda t: F.contains(low, t))
    weight = F.aggregate(matched, F.lit(0.0), lambda a, t: a + 1 + F.least(F.length(t), F.lit(8)) / 8)
    score = F.when((low != "") & (asked != ""), F.when(F.contains(low, asked), 5.0).otherwise(0.0) + weight + 1 / (1 + F.col("__days"))).otherwise(0.0)
    m = m.withColumn("score", F.round(score, 4)).filter("score > 0")
    m = m.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), F.desc(order)))).filter(F.col("rank") <= most)
    return m.select(*group, order, "score", "rank")


# Marker words and patterns of the rules below.
SOURCE_MARKERS = ("出处", "来源", "哪个文件", "哪份文件", "来自哪个", "原文位置", "具体文件", "文件名")
LIST_MARKERS = ("有哪些文档", "文档列表", "所有文档", "文件列表")
TOOL_MARKERS = ("前后文", "上下文", "相邻", "上一段", "下一段", "展开原文", "完整原文", "全文", "详细内容", "整份文档", *LIST_MARKERS, "知识条目详情", "条目内容", "这个知识条目", *SOURCE_MARKERS)
DIRECT = (r"^(你好|您好|hi|hello)($|[^\p{L}\p{N}_])", "^(早上好|中午好|下午好|晚上好)", "^什么是(rag|agent|docker|langgraph)[？?]?$")
POINTING = ("这个", "那个", "它", "他们", "上述", "前面提到", "刚才", "该流程", "该制度", "这个流程", "这个制度")
LEANING = ("^(那|然后|继续|还有|除此之外)", "(多久|谁负责|怎么处理|可以吗|是否一样|需要什么)(呢|吗)?[？?]?$")
BACK = ("它", "这个", "那个", "上面", "之前", "刚才", "上次", "前面", "上述", "该问题", "该流程", "这个条件", "之前说过", "上次提到", "刚才说的")
SAID = ("之前说过", "上次提到", "刚才说的", "历史消息", "前面提到", "之前的对话")
GOING_ON = ("那", "然后", "继续", "还要", "为什么", "怎么")


def mentions(s: Column, markers: tuple[str, ...]) -> Column:
    return s.rlike("|".join(markers))


def route(question: Column, in_base: Column, cited: Column) -> Column:
    """direct, tool or rag. ``in_base``: a knowledge base is chosen; ``cited``: the last answer had citations."""
    q = fx.squeeze(question)
    direct = (q == "") | mentions(q, DIRECT)
    tool = (cited & mentions(q, TOOL_MARKERS)) | (in_base & mentions(q, LIST_MARKERS))
    return F.when(direct, "direct").when(tool, "tool").when(~in_base, "direct").otherwise("rag")


def rewrite(question: Column, has_history: Column) -> Column:
    """struct(needed, reason): whether a question leans on what was said before."""
    q = fx.squeeze(question)
    rules = (
        (q == "", False, "empty_question"),
        (~has_history, False, "no_conversation_context"),
        (mentions(q, POINTING), True, "contains_context_reference"),
        (F.length(q) <= 8, True, "question_is_too_short"),
        (mentions(q, LEANING), True, "matches_context_dependent_pattern"),
        (F.lit(True), False, "question_is_self_contained"),
    )
    return F.coalesce(*[F.when(when, F.struct(F.lit(needed).alias("needed"), F.lit(reason).alias("reason"))) for when, needed, reason in rules])


def gap(question: Column, context: Column) -> Column:
    """struct(needed, triggers, missing): whether a question needs history that ``context`` (summary and recent messages as
    one text) does not hold."""
    q, known = fx.squeeze(question), fx.squeeze(context)
    for marker in BACK:
        known = F.replace(known, F.lit(marker), F.lit(""))
    bare = F.regexp_replace(known, r"[\s，。！？、,:：;；]+", "") == ""
    pronouns = [m for m in BACK if m not in SAID]
    points = F.filter(F.array(*map(F.lit, pronouns)), lambda m: F.contains(q, m))
    rules = (
        (mentions(q, SAID), "explicit_history_reference"),
        ((F.size(points) > 0) & bare, "pronoun_without_antecedent"),
        ((F.length(q) <= 8) & bare, "short_question_without_context"),
        (bare & q.rlike(f"^({'|'.join(GOING_ON)})"), "continuation_without_context"),
    )
    hit = F.when(q != "", F.array_compact(F.array(*[F.when(when, name) for when, name in rules]))).otherwise(F.array().cast("array<string>"))
    missing = F.when(F.size(hit) > 0, points).otherwise(F.array().cast("array<string>"))
    return F.struct((F.size(hit) > 0).alias("needed"), hit.alias("triggers"), missing.alias("missing"))


#: What an explicit memory looks like, in order, and the signs that are cut off its ends.
MEMORY_PATTERNS = (
    ("constraint", "^(?:请)?记住[：:]?\\s*(.+)$"),
    ("constraint", "^以后(?:都|请)?按[：:]?\\s*(.+)$"),
    ("decision", "^(?:最终决定|确定采用|确定使用)[：:]?\\s*(.+)$"),
    ("constraint", "^不要再改[：:]?\\s*(.+)$"),
)
MEMORY_ENDS = " \t\r\n。！？!?；;"


def memory(s: Column) -> Column:
    """struct(kind, content) of an explicit request to remember, else null: the first pattern that fits counts, and what it
    has found must be two signs or longer."""
    c = fx.collapse(s)
    found = F.coalesce(*[F.when(c.rlike(p), F.struct(F.lit(kind).alias("kind"), F.btrim(F.regexp_extract(c, p, 1), F.lit(MEMORY_ENDS)).alias("content"))) for kind, p in MEMORY_PATTERNS])
    return F.when(F.length(found["content"]) >= 2, F.struct(found["kind"].alias("kind"), F.left(found["content"], F.lit(2000)).alias("content")))


def archive(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """Memories (memory_id, org, created_by, status, updated_at, ...) after requests (memory_id, org, actor, role, at) to archive
    them. Only their creator, an owner or an admin of the same organisation may; the first such request counts."""
    allowed = requests.withColumnsRenamed({"memory_id": "__id", "org": "__org"})
    may = (F.col("__id") == F.col("memory_id")) & (F.col("__org") == F.col("org")) & ((F.col("actor") == F.col("created_by")) | F.col("role").isin("owner", "admin"))
    hit = memories.select("memory_id", "org", "created_by").join(allowed, may).groupBy("memory_id").agg(F.min("at").alias("__at"))
    out = memories.join(hit, "memory_id", "left")
    now = (F.col("status") == "active") & F.col("__at").isNotNull()
    return out.withColumns({"status": F.when(now, "archived").otherwise(F.col("status")), "updated_at": F.when(now, F.col("__at")).otherwise(F.col("updated_at"))}).drop("__at").select(*memories.columns)


def new_memories(found: DataFrame, group: list[str], content: str, order: str, active: DataFrame | None = None) -> DataFrame:
    """The first of equal memories (case and whitespace aside) in each group, less those already active."""
    m = found.withColumn("__key", fx.squeeze(F.col(content)))
    m = m.withColumn("__n", F.row_number().over(Window.partitionBy(*group, "__key").orderBy(order))).filter("__n = 1").drop("__n")
    if active is not None:
        m = m.join(active.select(*group, fx.squeeze(F.col(content)).alias("__key")), [*group, "__key"], "left_anti")
    return m.drop("__key")


def compact_refs(refs: DataFrame, group: list[str], key: str, order: str, protected: str, most: int) -> DataFrame:
    """One reference of each key, the newest; all protected ones, and the newest of the others up to ``most`` in all."""
    one = refs.withColumn("__n", F.row_number().over(Window.partitionBy(*group, key).orderBy(F.desc(order)))).filter("__n = 1").drop("__n")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(protected), F.desc(order)))
    return one.withColumn("__r", rank).filter(F.col(protected) | (F.col("__r") <= most)).drop("__r")


def hard_limit(items: DataFrame, group: list[str], used: str, budget: int) -> DataFrame:
    """Items (kind tool/history/evidence, protected, score, n) that stay when a context runs over: from 95 % of the budget
    three tools, three of history, evidence by (protected, score); still over 75 % then, 1, 1 and 2."""
    rank = F.row_number().over(Window.partitionBy(*group, "kind").orderBy(F.desc("protected"), F.desc_nulls_last("score"), F.desc("n")))
    share = F.col(used) / F.lit(float(budget))
    most = F.when(share < 0.95, 1 << 30).when(F.col("kind").isin("tool", "history"), 3).otherwise(1 << 30)
    r = items.withColumn("__rank", rank).filter(F.col("__rank") <= most)
    left = F.sum("tokens").over(Window.partitionBy(*group))
    second = F.when(share < 0.95, 1 << 30).when(left / F.lit(float(budget)) <= 0.75, 1 << 30).when(F.col("kind").isin("tool", "history"), 1).otherwise(2)
    return r.withColumn("__second", second).filter(F.col("__rank") <= F.col("__second")).drop("__rank", "__second")


#: The order in which a pack's regions are filled.
REGIONS = ("system", "memory", "summary", "message", "history", "evidence", "tool")


def context_pack(items: DataFrame, group: list[str], budget: int, caps: dict[str, int] | None = None, each: tuple[str, ...] = ()) -> DataFrame:
    """Items (kind, n, tokens, pinned, importance) that go into a request, region by region, whole items in order (messages
    newest first), each region within its cap and all within the budget. What does not fit is skipped, and named. The cap of
    the kinds in ``each`` holds for each item alone."""
    caps = caps or {}
    region = F.array_position(F.array(*map(F.lit, REGIONS)), F.col("kind")).cast("int")
    cap = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in caps.items()], F.lit(budget))
    order = F.row_number().over(Window.partitionBy(*group).orderBy(region, F.desc("pinned"), F.desc("importance"), F.when(F.col("kind") == "message", -F.col("n")).otherwise(F.col("n"))))
    rows = items.select(*group, F.struct(order.alias("o"), region.alias("r"), F.col("n").cast("long").alias("n"), "kind", F.col("tokens").cast("long").alias("tokens"), cap.cast("long").alias("cap")).alias("i"))
    kind = "array<struct<kind:string,n:long,tokens:long,selected:boolean>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("r"), F.lit(0).cast("long").alias("here"), F.array().cast(kind).alias("out"))

    def step(a: Column, i: Column) -> Column:
        here = F.when(a["r"] == i["r"], a["here"]).otherwise(0)
        before = F.when(i["kind"].isin(*each), 0).otherwise(here) if each else here
        fits = (a["used"] + i["tokens"] <= budget) & (before + i["tokens"] <= i["cap"])
        add = F.when(fits, i["tokens"]).otherwise(0)
        one = F.struct(i["kind"].alias("kind"), i["n"].alias("n"), i["tokens"].alias("tokens"), fits.alias("selected"))
        return F.struct((a["used"] + add).alias("used"), i["r"].alias("r"), (here + add).cast("long").alias("here"), F.concat(a["out"], F.array(one)).cast(kind).alias("out"))

    packed = rows.groupBy(*group).agg(F.array_sort(F.collect_list("i")).alias("rows")).select(*group, F.aggregate("rows", start, step).alias("p"))
    return packed.select(*group, F.col("p.used").alias("used"), F.explode("p.out").alias("x")).select(*group, "used", "x.kind", "x.n", "x.tokens", "x.selected")


def labelled_summary(goal: Column, facts: Column, decisions: Column, open_questions: Column) -> Column:
    """A summary's parts under their labels; empty parts are left out."""
    part = lambda label, c: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws("\n", part("Goal", goal), part("Facts", facts), part("Decisions", decisions), part("Open", open_questions))


def top_memories(memories: DataFrame, group: list[str], limit: int) -> DataFrame:
    """Active memories by importance, then newest; the limit is held within 1 and 50."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("importance"), F.desc("updated_at"), F.desc("memory_id")))
    return memories.filter("status = 'active'").withColumn("rank", rank).filter(F.col("rank") <= max(1, min(limit, 50)))


def input_budget(configured: Column, window: Column, *reserves: Column) -> Column:
    """Tokens that a request may use: the configured number, within the model's window less all reserves; window 0 is no
    bound. At least 1."""
    free = window
    for r in reserves:
        free = free - F.greatest(r, F.lit(0))
    return F.greatest(F.lit(1), F.when(window <= 0, configured).otherwise(F.least(configured, free)))
