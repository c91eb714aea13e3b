"""What an answer's request holds: items read leniently, evidence that citations protect, compaction when it runs over, and the
prompt. Windows and folds hold one conversation's items in one task; a request's candidates are bounded by what was retrieved."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import text as fx
from docweave.operators import conversation as conv

#: Shares of the budget from which candidates are thinned out and down to which, what stays of them, and what stays if that is not enough.
HARD, TARGET = 0.95, 0.75
STAY = {"tool": 3, "history": 3}
LAST = {"tool": 1, "history": 1, "evidence": 2}
#: Rounds that stay as they were said when older ones are summed up for one request.
ROUNDS = 2
#: Kinds whose cap holds for each item, not for all of them together.
EACH = ("system", "evidence")
#: What was done to make a request fit.
FULL = ("hard_watermark_preflight", "evict_old_tool_results", "reduce_relevant_history", "rank_evidence_for_budget", "emergency_reduce_context_candidates")
SUMMED = ("hard_conversation_compaction", "summary_compact_for_request")
_FIELDS = ("content", "summary", "source_ids", "source_id", "id", "kind", "importance", "score", "pinned", "metadata", "document_id", "chunk_id", "knowledge_item_id", "title")


def _stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def _object(raw: Column) -> Column:
    """An object's fields as strings; a null struct where ``raw`` is no object."""
    return F.when(F.startswith(F.ltrim(raw), F.lit("{")), F.from_json(raw, ", ".join(f"{f} string" for f in _FIELDS)))


def _true(*values: Column) -> Column:
    """The first value that is neither missing, empty, zero nor false."""
    return F.coalesce(*[F.when(~v.isin("", "false", "[]", "{}") & (F.coalesce(v.try_cast("double"), F.lit(1.0)) != 0), v) for v in values])


def _metadata(o: Column) -> Column:
    none = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(o["metadata"], "map<string,string>"), none)


def _number(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def coerce_item(raw: Column, n: Column, kind: str) -> Column:
    """struct(kind, content, source_ids, importance, pinned, metadata) of what a checkpoint or a client sent: an object with
    ``content`` or ``summary``, or plain text, whose source is its place ``n``. Null without content, for null and for
    broken objects. What should be a number and is none counts as 0."""
    o = _object(raw)
    content = _stripped(F.coalesce(F.nullif(o["content"], F.lit("")), o["summary"]))
    source = _true(o["source_ids"], o["source_id"], o["id"])
    ids = F.when(F.startswith(source, F.lit("[")), F.from_json(source, "array<string>")).when(source.isNotNull(), F.array(source)).otherwise(F.array().cast("array<string>"))
    given = {"kind": F.coalesce(_true(o["kind"]), F.lit(kind)), "content": content, "source_ids": ids, "importance": _number(_true(o["importance"], o["score"])), "pinned": _true(o["pinned"]).isNotNull(), "metadata": _metadata(o)}
    bare = _stripped(raw)
    plain = {"kind": F.lit(kind), "content": bare, "source_ids": F.array(n.cast("string")), "importance": F.lit(0.0), "pinned": F.lit(False), "metadata": F.create_map().cast("map<string,string>")}
    one = lambda parts: F.struct(*[c.alias(k) for k, c in parts.items()])
    return F.when(o.isNotNull(), F.when(content != "", one(given))).when(bare != "", one(plain))


def coerce_evidence(raw: Column) -> Column:
    """struct(content, source_id, document_id, chunk_id, knowledge_item_id, title, score, metadata) of an object, whose
    missing texts are empty and whose missing score is 0. Null for what is no object."""
    o = _object(raw)
    text = lambda c: F.coalesce(o[c], F.lit("")).alias(c)
    some = F.struct(text("content"), text("source_id"), *[o[c].alias(c) for c in ("document_id", "chunk_id", "knowledge_item_id")], text("title"), _number(o["score"]).alias("score"), _metadata(o).alias("metadata"))
    return F.when(o.isNotNull(), some)


def cited_evidence(evidence: DataFrame, citations: DataFrame, by: list[str]) -> DataFrame:
    """``evidence`` (by, doc_id, chunk_id, knowledge_item_id, ...) with ``protected``: an earlier citation means the same document,
    and the same chunk where both name one, or the same item. Two equality joins, no OR; null ids mean nothing."""
    c = citations.select(*by, *[F.col(x).cast("string").alias(f"__{x}") for x in ("doc_id", "chunk_id", "knowledge_item_id")])
    docs = c.filter("__doc_id is not null").groupBy(*by, "__doc_id").agg(F.bool_or(F.col("__chunk_id").isNull()).alias("__whole"), F.collect_set("__chunk_id").alias("__chunks"))
    items = c.filter("__knowledge_item_id is not null").select(*by, "__knowledge_item_id", F.lit(True).alias("__item")).distinct()
    e = evidence.withColumns({"__doc_id": F.col("doc_id").cast("string"), "__knowledge_item_id": F.col("knowledge_item_id").cast("string")})
    met = e.join(docs, [*by, "__doc_id"], "left").join(items, [*by, "__knowledge_item_id"], "left")
    of_doc = F.col("__chunks").isNotNull() & (F.col("__whole") | F.col("chunk_id").isNull() | F.array_contains("__chunks", F.col("chunk_id").cast("string")))
    return met.withColumn("protected", F.coalesce(of_doc, F.lit(False)) | F.coalesce("__item", F.lit(False))).select(*evidence.columns, "protected")


def _need(by: list[str], caps: dict[str, int], counted: Column) -> Column:
    """Tokens of a conversation's ``counted`` items, those of each kind up to its cap."""
    w = Window.partitionBy(*by)
    of = lambda kind: F.coalesce(F.sum(F.when((F.col("kind") == kind) & counted, F.col("tokens"))).over(w), F.lit(0))
    parts = [F.least(of(k), F.lit(caps[k])) if k in caps else of(k) for k in conv.REGIONS]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def thinned(items: DataFrame, by: list[str], budget: int, caps: dict[str, int]) -> DataFrame:
    """Items (by, kind, n, tokens, importance, protected, score) that stay candidates, with their ``place`` in their kind and what was
    done as ``actions``. From 95 % of the budget tools and history are cut to three and evidence goes by (protected, score);
    if over 75 % are still needed then, one, one and two stay. Protected tools always stay."""
    value = F.when(F.col("kind") == "history", F.col("importance")).otherwise(F.col("score"))
    rank = F.row_number().over(Window.partitionBy(*by, "kind").orderBy(F.desc("protected"), F.desc_nulls_last(value), F.when(F.col("kind") == "tool", -F.col("n")).otherwise(F.col("n"))))
    within = lambda most: F.coalesce(*[F.when(F.col("kind") == k, (F.col("place") <= v) | ((F.col("kind") == "tool") & F.col("protected"))) for k, v in most.items()], F.lit(True))
    ranked = items.withColumn("place", rank)
    tools = F.sum(F.when((F.col("kind") == "tool") & ~within(STAY), 1)).over(Window.partitionBy(*by))
    told = ranked.withColumns({"__full": _need(by, caps, F.lit(True)) >= int(budget * HARD), "__rest": _need(by, caps, within(STAY)), "__tools": tools})
    full, tight = F.col("__full"), F.col("__full") & (F.col("__rest") > int(budget * TARGET))
    when = (full, full & (F.coalesce("__tools", F.lit(0)) > 0), full, full, tight)
    done = F.array_compact(F.array(*[F.when(c, F.lit(a)) for c, a in zip(when, FULL, strict=True)]))
    stays = ~full | (within(STAY) & (~tight | within(LAST)))
    ordered = F.when(full & (F.col("kind") == "evidence"), F.col("place")).otherwise(F.col("n"))
    return told.withColumns({"actions": done, "place": ordered, "__stays": stays}).filter("__stays").drop("__full", "__rest", "__tools", "__stays")


def summed_up(items: DataFrame, by: list[str], budget: int, caps: dict[str, int], summarise: Callable[[Column, Column], Column], rounds: int = ROUNDS) -> DataFrame:
    """``items`` with ``summed``: where a request is full, messages before the last ``rounds`` rounds give way to one summary, which
    replaces the one there is. ``summarise`` makes it of the lines ("role: text", in order) and the old summary; where it
    gives null, all stays as it is. Conversations with room never reach it."""
    w = Window.partitionBy(*by).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    message = F.col("kind") == "message"
    after = F.coalesce(F.sum((message & (F.col("role") == "user")).cast("int")).over(w), F.lit(0))
    full = _need(by, caps, F.lit(True)) >= int(budget * HARD)
    told = items.withColumns({"__after": after, "__full": full}).withColumn("__old", message & F.col("__full") & (F.col("__after") >= rounds)).drop("__after", "__full")
    said = F.transform(F.array_sort(F.collect_list(F.when(F.col("__old"), F.struct("n", "role", "text")))), lambda m: F.concat_ws(": ", m["role"], m["text"]))
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    asked = told.filter(known & (F.col("__old") | (F.col("kind") == "summary"))).groupBy(*by).agg(said.alias("lines"), F.max(F.when(F.col("kind") == "summary", F.col("text"))).alias("prior"))
    made = asked.filter(F.size("lines") > 0).select(*by, summarise(F.col("lines"), F.col("prior")).alias("__new")).filter("__new is not null")
    met = told.join(made, by, "left").withColumn("summed", F.col("__new").isNotNull())
    rest = met.filter(~(F.col("summed") & (F.col("__old") | (F.col("kind") == "summary")))).drop("__old", "__new")
    fixed = {"kind": F.lit("summary"), "n": F.lit(0), "text": F.col("__new"), "tokens": fx.token_estimate(F.col("__new")), "pinned": F.lit(False), "protected": F.lit(False), "summed": F.lit(True)}
    new = made.select(*[F.col(c) if c in by else fixed.get(c, F.lit(None)).cast(rest.schema[c].dataType).alias(c) for c in rest.columns])
    return rest.unionByName(new)


def answer_context(items: DataFrame, by: list[str], budget: int, caps: dict[str, int], summarise: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The answer's context of each conversation: items (by, kind, n, role, text, pinned, importance, protected, score) with
    tokens, selected, the reason if not, the tokens used in all and the actions taken.

    Older rounds are summed up if the request is full (``summarise``), candidates are thinned out if it still is, and the rest
    goes in region by region as ``conversation.context_pack`` does, whole items only; system lines and summaries are cut to
    their caps before. An item is known by (by, kind, n): repeated ones count once, null texts are empty, a conversation
    without items has no rows, other columns are left out. A null key is a conversation like any other, but is not summed up.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    clipped = F.coalesce(*[F.when(F.col("kind") == k, fx.clip_tokens(F.col("text"), caps[k])) for k in ("system", "summary") if k in caps], F.coalesce("text", F.lit("")))
    i = items.dropDuplicates([*by, "kind", "n"]).select(*by, "kind", "n", "role", clipped.alias("text"), flag("pinned"), F.coalesce(F.col("importance").cast("double"), F.lit(0.0)).alias("importance"), flag("protected"), F.col("score").cast("double").alias("score"))
    i = i.withColumn("tokens", fx.token_estimate(F.col("text")))
    i = summed_up(i, by, budget, caps, summarise) if summarise else i.withColumn("summed", F.lit(False))
    if summarise and "summary" in caps:
        i = i.withColumn("text", F.when(F.col("kind") == "summary", fx.clip_tokens(F.col("text"), caps["summary"])).otherwise(F.col("text"))).withColumn("tokens", fx.token_estimate(F.col("text")))
    kept = thinned(i, by, budget, caps).withColumn("actions", F.concat("actions", F.when(F.col("summed"), F.array(*map(F.lit, SUMMED))).otherwise(F.array().cast("array<string>"))))
    whole = F.col("kind").isin("memory", "history")  # the others go by their place
    ready = kept.select(*by, "kind", F.col("place").alias("n"), "tokens", (whole & F.col("pinned")).alias("pinned"), F.when(whole, F.col("importance")).otherwise(0.0).alias("importance"))
    packed = conv.context_pack(ready, by, budget, caps, EACH)
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*by, "kind"]]
    met = kept.alias("k").join(packed.alias("p"), [*same, F.col("k.place") == F.col("p.n")])
    reason = F.when(~F.col("selected"), F.lit("over_budget")).alias("reason")
    return met.select(*[F.col(f"k.{c}").alias(c) for c in [*by, "kind", "n", "place", "role", "text", "tokens"]], "selected", reason, "used", "actions")


#: Labels of a prompt's parts, by kind.
LABELS = {"system": "Instructions", "memory": "Known", "summary": "Summary so far", "message": "Conversation", "history": "Said earlier", "evidence": "Evidence", "tool": "Tool results"}


def prompt(context: DataFrame, by: list[str]) -> DataFrame:
    """One text for each conversation of what ``answer_context`` selected: parts under their labels, messages in the order they
    were said, evidence numbered as answers cite it. Conversations with nothing selected have no row."""
    ordered = Window.partitionBy(*by, "kind").orderBy("place")
    line = F.when(F.col("kind") == "evidence", F.concat(F.lit("["), F.row_number().over(ordered).cast("string"), F.lit("] "), F.col("text"))).when(F.col("kind") == "message", F.concat_ws(": ", "role", "text")).otherwise(F.col("text"))
    region = F.array_position(F.array(*map(F.lit, conv.REGIONS)), F.col("kind"))
    lines = context.filter("selected").withColumns({"__line": line, "__region": region})
    part = lines.groupBy(*by, "__region", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "__line"))), lambda x: x["__line"]), "\n").alias("body"))
    label = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in LABELS.items()])
    whole = part.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__region", F.concat(label, F.lit(":\n"), F.col("body")).alias("text")))).alias("parts"))
    return whole.select(*by, F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("prompt"))
