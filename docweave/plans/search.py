"""Search and evaluation queries."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as fx
from docweave.operators import evaluation, lexical_index, retrieval, table_functions, vector_index
from docweave.session import shared_folder, table

K = 20
TOP = 5


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", "text")


def topk_dense(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return retrieval.topk_dense(v, v.filter("vec_id % 25 = 0"), TOP, scope_col="label")


TOPK_DENSE = """
with s as (select q.vec_id as query_id, v.vec_id, round((1 + list_dot_product(q.embedding::double[], v.embedding::double[]) /
    sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]) * list_dot_product(v.embedding::double[], v.embedding::double[]))) / 2, 6) as score
  from embeddings q join embeddings v on q.label = v.label where q.vec_id % 25 = 0)
select query_id, vec_id, score, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank
from s qualify rank <= 5
"""

_TOKENS = """
terms as (select doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents),
tf as (select doc_id, lang, term, count(*) as tf from terms group by all),
dl as (select doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) as dl from documents),
q as (select distinct query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from asked),
st as (select count(*) as n, avg(dl) as avgdl from dl),
df as (select term, count(*) as df from tf group by 1),
scored as (select query_id, tf.doc_id, any_value(lang) as lang, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score
  from q join tf using (term) join df using (term) join dl on dl.doc_id = tf.doc_id cross join st group by 1, 2),
bm25 as (select query_id, doc_id, score, (row_number() over (partition by query_id order by score desc, doc_id))::int as rank from scored qualify rank <= 20)
"""
_TERMS = f"asked as (select item_id as query_id, text from benchmark), {_TOKENS}"


#: By application and files: the lexical index of the documents, made when it is first asked for and kept.
_INDEXES: dict[tuple, str] = {}


def _index(spark: SparkSession, d: str) -> lexical_index.LexicalIndex:
    docs = table(spark, d, "documents")
    key = (spark.sparkContext.applicationId, *sorted(docs.inputFiles()))
    if key not in _INDEXES:
        path = shared_folder(spark, "lexical")
        lexical_index.create(docs, path, keep=("lang",))
        _INDEXES[key] = path
    return lexical_index.open_index(spark, _INDEXES[key])


def _bm25(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return lexical_index.search(_index(spark, d), _questions(spark, d), k)


def topk_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, TOP)


TOPK_BM25 = f"with {_TERMS} select * from bm25 where rank <= 5"


def topk_bm25_scoped(spark: SparkSession, d: str) -> DataFrame:
    return lexical_index.search(_index(spark, d), _questions(spark, d), TOP, filters=F.col("lang") == "en")


TOPK_BM25_SCOPED = f"with {_TERMS} select query_id, doc_id, score, (row_number() over (partition by query_id order by score desc, doc_id))::int as rank from scored where lang = 'en' qualify rank <= 5"


def _functions(spark: SparkSession, d: str) -> None:
    docs, m = table(spark, d, "documents"), table(spark, d, "conversations")
    chunks = m.select(F.col("conv_id").cast("long").alias("item_id"), F.col("turn").cast("int").alias("chunk_index"), F.col("text").alias("content"))
    items = docs.select(F.col("doc_id").alias("item_id"), F.col("source").alias("title"), F.col("text").alias("content"))
    named = docs.select("doc_id", F.col("lang").alias("knowledge_base"), F.col("source").alias("name"), "text")
    messages = m.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").alias("content"))
    table_functions.register(spark, named, chunks, items, messages, _index(spark, d))


def tool_functions(spark: SparkSession, d: str) -> DataFrame:
    """Table functions called for many rows: neighbours of every user message, documents of labelled ids, and messages of every
    conversation that hold a word."""
    _functions(spark, d)
    c = table(spark, d, "conversations")
    c.filter("role = 'user'").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn")).createOrReplaceTempView("asked_turns")
    table(spark, d, "labels").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().createOrReplaceTempView("asked_docs")
    return spark.sql("""
        SELECT 'neighbors' AS tool, q.conv_id * 1000 + q.turn AS asked, CAST(n.chunk_index AS BIGINT) AS found, md5(n.content) AS content_md5 FROM asked_turns q, LATERAL get_chunk_neighbors(q.conv_id, q.turn, 2) n
        UNION ALL SELECT 'document', q.doc_id, CAST(g.truncated AS BIGINT), md5(g.content) FROM asked_docs q, LATERAL get_document(q.doc_id) g
        UNION ALL SELECT 'list', place, doc_id, md5(name) FROM list_knowledge_base_documents('de', 99)
    """)


TOOL_FUNCTIONS = """
select 'neighbors' as tool, q.conv_id * 1000 + q.turn as asked, c.turn::bigint as found, md5(c.text) as content_md5 from conversations q join conversations c on c.conv_id = q.conv_id and c.turn between q.turn - 2 and q.turn + 2 where q.role = 'user'
union all select 'document', doc_id, (length(text) > 24000)::bigint, md5(left(text, 24000)) from documents where doc_id in (select doc_id from labels)
union all select 'list', row_number() over (order by doc_id desc), doc_id, md5(source) from documents where lang = 'de' qualify row_number() over (order by doc_id desc) <= 50
"""


def topk_dense_lists(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors through inverted lists, with the usual number of candidates."""
    v = table(spark, d, "embeddings")
    index = vector_index.create(v, shared_folder(spark, "vectors"), scope_col="label")
    return vector_index.search(index, v.filter("vec_id % 25 = 0"), TOP, scope_col="label")


def topk_dense_lists_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same index, all lists."""
    v = table(spark, d, "embeddings")
    index = vector_index.create(v, shared_folder(spark, "vectors"), scope_col="label")
    return vector_index.search(index, v.filter("vec_id % 25 = 0"), TOP, scope_col="label", exact=True)


def topk_bm25_scan(spark: SparkSession, d: str) -> DataFrame:
    """Without an index, each language being a scope: questions of odd number ask the English documents, the others the German ones."""
    asked = _questions(spark, d).withColumn("lang", F.when(F.col("item_id") % 2 == 1, "en").otherwise("de"))
    return retrieval.topk_bm25(table(spark, d, "documents"), asked, TOP, scope_col="lang")


TOPK_BM25_SCAN = """
with t as (select doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents),
tf as (select doc_id, lang, term, count(*) as tf from t group by all),
dl as (select doc_id, lang, len(regexp_extract_all(lower(text), '[a-z0-9]+')) as dl from documents),
st as (select lang, count(*) as n, avg(dl) as avgdl from dl group by 1), df as (select lang, term, count(*) as df from tf group by all),
q as (select distinct item_id as query_id, case when item_id % 2 = 1 then 'en' else 'de' end as lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark),
scored as (select query_id, tf.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score
  from q join tf using (lang, term) join df using (lang, term) join dl on dl.doc_id = tf.doc_id join st on st.lang = q.lang group by 1, 2)
select query_id, doc_id, score, (row_number() over (partition by query_id order by score desc, doc_id))::int as rank from scored qualify rank <= 5
"""


def topk_bm25_upserted(spark: SparkSession, d: str) -> DataFrame:
    """An index of earlier versions (the first half of each even document), then all documents upserted, every seventh deleted,
    and every ninth put back: the search sees what is left."""
    docs = table(spark, d, "documents")
    index = lexical_index.create(docs.filter("doc_id % 2 = 0").withColumn("text", F.expr("left(text, length(text) div 2)")), shared_folder(spark, "lexical"))
    index = lexical_index.delete(lexical_index.upsert(index, docs), docs.filter("doc_id % 7 = 0"))
    return lexical_index.search(lexical_index.upsert(index, docs.filter("doc_id % 9 = 0")), _questions(spark, d), TOP)


TOPK_BM25_UPSERTED = f"with documents as (from documents where doc_id % 7 <> 0 or doc_id % 9 = 0), {_TERMS} select * from bm25 where rank <= 5"


def agg_bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency of every term, from the kept index."""
    return _index(spark, d).statistics().select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


AGG_BM25_STATS = """
with w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as words from documents)
select term, count(*) as df, (select count(*) from w) as n, (select round(avg(len(coalesce(words, []))), 6) from w) as avgdl
from (select distinct doc_id, unnest(words) as term from w) group by 1
"""


def _variants(spark: SparkSession, d: str) -> DataFrame:
    """Every question, and its first sentence where that is another text."""
    return retrieval.variants(_questions(spark, d), "item_id", F.array("text", F.get(F.split("text", "(?<=[.])"), F.lit(0))))


def _kept(df: DataFrame) -> DataFrame:
    """What a search found, written: it is read more than once, and is small beside the documents."""
    path = shared_folder(df.sparkSession, "hits")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _lists(spark: SparkSession, d: str, names: tuple[str, ...] = ("dense", "bm25")) -> dict[str, DataFrame]:
    """The dense and the lexical list of each question, over its variants; equal documents of one source count once."""
    docs = table(spark, d, "documents")
    asked = _variants(spark, d).withColumn("search", F.col("query_id") * 10 + F.col("variant_no"))
    key = F.md5(F.concat_ws("\x01", F.lower(F.trim("source")), fx.squeeze(F.col("text")))).alias("key")
    vectors = lambda df, i: retrieval.embed(df, "text").select(F.col(i).alias("doc_id"), "embedding")
    searches = asked.select("search", F.col("variant").alias("text"))
    ways = {"dense": lambda: retrieval.topk_dense(vectors(docs, "doc_id"), vectors(searches, "search"), K, id_col="doc_id"), "bm25": lambda: lexical_index.search(_index(spark, d), searches, K, query_id="search")}
    back = lambda h: h.withColumnRenamed("query_id", "search").join(asked.select("search", "query_id", "variant_no"), "search").drop("search")
    found = {name: _kept(ways[name]()) for name in names}
    ids = _kept(functools.reduce(DataFrame.union, [h.select("doc_id") for h in found.values()]).distinct())
    keys = _kept(retrieval.looked_up(ids, docs.select("doc_id", "source", "text"), "doc_id").select("doc_id", key))
    return {name: retrieval.union_candidates(back(h), keys, "doc_id", K) for name, h in found.items()}


_COVER = """
key as (select doc_id, lower(trim(source)) || chr(1) || lower(regexp_replace(text, '\\s+', '', 'g')) as key from documents),
dd as (select doc_id, ('0x' || left(md5(term), 7))::bigint % 64 as dim, count(*) as c from terms group by 1, 2),
qd as (select query_id, ('0x' || left(md5(term), 7))::bigint % 64 as dim, count(*) as c from (select query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from asked) group by 1, 2),
dn as (select doc_id, sqrt(sum(c * c)) as n from dd group by 1), qn as (select query_id, sqrt(sum(c * c)) as n from qd group by 1),
near0 as (select qd.query_id, dd.doc_id, sum(qd.c * dd.c) as dot from qd join dd using (dim) group by 1, 2),
near1 as (select query_id, doc_id, round((1 + dot / (qn.n * dn.n)) / 2, 6) as score from near0 join dn using (doc_id) join qn using (query_id)),
near as (select *, (row_number() over (partition by query_id order by score desc, doc_id))::int as rank from near1 qualify rank <= 20),
cover0 as (select query_id // 10 as query_id, doc_id, score, query_id % 10 as variant_no, rank as r, key from near join key using (doc_id) qualify row_number() over (partition by query_id // 10, key order by query_id % 10, rank) = 1),
cover as (select query_id, doc_id, score, (row_number() over (partition by query_id order by variant_no, r))::int as rank from cover0 qualify rank <= 20),
lex0 as (select query_id // 10 as query_id, doc_id, score, query_id % 10 as variant_no, rank as r, key from bm25 join key using (doc_id) qualify row_number() over (partition by query_id // 10, key order by query_id % 10, rank) = 1),
lex as (select query_id, doc_id, score, (row_number() over (partition by query_id order by variant_no, r))::int as rank from lex0 qualify rank <= 20)
"""
_ASKED = """
sentence as (select item_id, trim(text) as a, trim(regexp_extract(text, '^[^.]*[.]?')) as b from benchmark),
asked as (select item_id * 10 as query_id, a as text from sentence where a <> '' union all select item_id * 10 + (a <> '')::int, b from sentence where b <> '' and b <> a)
"""
_FUSED = f"""{_ASKED}, {_TOKENS}, {_COVER},
both_lists as (select *, 0 as list_no, 'dense' as source from cover union all select *, 1, 'bm25' from lex),
fused0 as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 9) as rrf_score, max(score) filter (source = 'dense') as dense_score, max(score) filter (source = 'bm25') as bm25_score,
  string_agg(source, ',' order by list_no) as sources from both_lists group by 1, 2),
fused as (select *, (row_number() over (partition by query_id order by rrf_score desc, doc_id))::int as rank from fused0 qualify rank <= 20)
"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rrf(_lists(spark, d), "doc_id", K)


def set_union_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d, ("bm25",))["bm25"]


SET_UNION_CANDIDATES = f"with {_ASKED}, {_TOKENS}, {_COVER} select query_id, doc_id, score, rank from lex"


def agg_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d)


AGG_RRF = f"with {_FUSED} select query_id, doc_id, rrf_score, dense_score, bm25_score, sources, rank from fused"


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d).select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    hits = retrieval.looked_up(_kept(_fused(spark, d)), table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id").join(q, "query_id")
    return retrieval.rerank(hits, retrieval.overlap_score(F.col("question"), F.col("text")), "doc_id", 10)


_RERANKED = f"""{_FUSED},
qt as (select item_id as query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as qterms from benchmark),
re0 as (select f.*, d.text, d.source, case when rank <= 10 then round(1 / (1 + exp(-greatest(least(8 * (len(list_intersect(qterms, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+'))))::double / greatest(len(qterms), 1)) - 4, 30.0), -30.0))), 9) end as rerank_score
  from fused f join qt using (query_id) join documents d using (doc_id)),
re as (select *, (row_number() over (partition by query_id order by (rank > 10)::int, rerank_score desc nulls last, rrf_score desc, rank))::int as final_rank from re0)
"""


def topk_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d).select("query_id", "doc_id", "rrf_score", "rerank_score", "rank", "final_rank")


TOPK_RERANK = f"with {_RERANKED} select query_id, doc_id, rrf_score, rerank_score, rank, final_rank from re"


def _hybrid(spark: SparkSession, d: str, reranked: DataFrame | None = None) -> DataFrame:
    reranked = _reranked(spark, d) if reranked is None else reranked
    key = [F.lower(F.trim("source")), fx.squeeze(F.col("text"))]
    return retrieval.dedup_hits(reranked.drop("rank"), ["query_id"], key, [F.col("final_rank")], TOP)


_HYBRID = f"""{_RERANKED},
hy0 as (select * exclude (rank) from re qualify row_number() over (partition by query_id, lower(trim(source)), lower(regexp_replace(text, '\\s+', '', 'g')) order by final_rank) = 1),
hy as (select query_id, doc_id, source, text, rrf_score, rerank_score, sources, (row_number() over (partition by query_id order by final_rank))::int as rank from hy0 qualify rank <= 5)
"""


def topk_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("query_id", "doc_id", "rrf_score", "rerank_score", "sources", "rank")


TOPK_HYBRID = f"with {_HYBRID} select query_id, doc_id, rrf_score, rerank_score, sources, rank from hy"


def win_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each language, the first of equal ones: the places they take are counted by ranges of ids, so that no
    task has a whole language."""
    docs = table(spark, d, "documents")
    key = F.md5(F.concat_ws("\x01", F.lower(F.trim("source")), fx.squeeze(F.col("text"))))
    first = docs.groupBy("lang", key.alias("key")).agg(F.min("doc_id").alias("doc_id")).drop("key")
    return retrieval.numbered(first, "lang", "doc_id").select("lang", "doc_id", "rank")


WIN_DEDUP_FIRST = r"""
with f as (select lang, doc_id from documents qualify row_number() over (partition by lang, lower(trim(source)), lower(regexp_replace(text, '\s+', '', 'g')) order by doc_id) = 1)
select lang, doc_id, (row_number() over (partition by lang order by doc_id))::int as rank from f
"""


def _relevance() -> Column:
    """2 or 1 (by its quality label) if the document contains the question's passage, else 0."""
    return F.when(F.contains("text", F.col("question")), 1 + (F.coalesce("quality", F.lit(0)) > 0).cast("int")).otherwise(0)


def _judged(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    q = _questions(spark, d).select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    labels = table(spark, d, "labels").select("doc_id", "quality")
    return hits.drop("question").join(q, "query_id").join(labels, "doc_id", "left").select("query_id", "doc_id", "rank", "rerank_score", _relevance().alias("relevance"))


_JUDGE = lambda name: f"""select {name}.query_id, {name}.doc_id, {name}.rank, {name}.rerank_score, (case when contains({name}.text, b.text) then 1 + (coalesce(l.quality, 0) > 0)::int else 0 end)::int as relevance
  from {name} join benchmark b on b.item_id = {name}.query_id left join labels l on l.doc_id = {name}.doc_id"""  # noqa: E731
_JUDGED = f"{_HYBRID}, judged as ({_JUDGE('hy')}), pooled as ({_JUDGE('re')})"


def join_qrels(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d, _hybrid(spark, d)).drop("rerank_score")


JOIN_QRELS = f"with {_JUDGED} select query_id, doc_id, rank, relevance from judged"


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Every question with what was found for it: hits below the gate are not given out. All candidates that were reranked
    are judged; a question none of them answers has no answer."""
    reranked = _kept(_reranked(spark, d))
    pool = _kept(_judged(spark, d, reranked))
    hits = _judged(spark, d, _hybrid(spark, d, reranked)).filter(F.coalesce("rerank_score", F.lit(0.0)) >= retrieval.GATE)
    answered = pool.groupBy("query_id").agg(F.max(F.col("relevance") > 0).alias("answerable"))
    q = _questions(spark, d).select(F.col("item_id").alias("query_id"), F.concat(F.lit("c"), F.col("item_id") % 4).alias("category"))
    cases = q.join(answered, "query_id", "left").withColumn("answerable", F.coalesce("answerable", F.lit(False)))
    return evaluation.per_case(cases, hits, TOP, pool.select("query_id", "relevance"))


def agg_eval(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluate(_cases(spark, d))


_CASES = f"""{_JUDGED},
given as (select * from judged where coalesce(rerank_score, 0) >= 0.78),
found as (select query_id, max((relevance > 0)::int) as hit, max(1.0::double / rank) filter (relevance > 0) as rr, sum((pow(2, relevance) - 1) / log2(rank + 1)) as dcg, count(*) as n_hits, count(*) filter (relevance > 0) as n_relevant from given group by 1),
ideal as (select query_id, sum((pow(2, relevance) - 1) / log2(i + 1)) as idcg from (select query_id, relevance, row_number() over (partition by query_id order by relevance desc) as i from pooled) where i <= 5 group by 1),
answered as (select query_id, max((relevance > 0)::int) = 1 as answerable from pooled group by 1),
scores as (select b.item_id as query_id, 'c' || (b.item_id % 4) as category, coalesce(answerable, false) as yes, coalesce(hit, 0) as hit, coalesce(rr, 0.0) as rr, case when idcg > 0 then coalesce(dcg, 0) / idcg else 0.0 end as ndcg,
  coalesce(n_hits, 0) as n_hits, coalesce(n_relevant, 0) as n_relevant, not coalesce(answerable, false) and n_hits is null as rejected
  from benchmark b left join answered a on a.query_id = b.item_id left join found f on f.query_id = b.item_id left join ideal i on i.query_id = b.item_id)
"""
_MEASURES = """count(*) as cases, count(*) filter (yes) as answerable, round(coalesce(avg(hit) filter (yes), 0.0), 6) as recall, round(coalesce(avg(rr) filter (yes), 0.0), 6) as mrr, round(coalesce(avg(ndcg) filter (yes), 0.0), 6) as ndcg,
  round(coalesce(sum(n_relevant) filter (yes)::double / nullif(sum(n_hits) filter (yes), 0), 0.0), 6) as citation_correctness, round(coalesce(avg(rejected::int) filter (not yes), 0.0), 6) as rejection_rate"""
AGG_EVAL = f"with {_CASES} select {_MEASURES} from scores"


def agg_eval_cat(spark: SparkSession, d: str) -> DataFrame:
    """By category; seconds are made up of each case's number."""
    return evaluation.by_category(_cases(spark, d).withColumn("seconds", (F.col("query_id") * 37 % 101).cast("double")), "seconds")


AGG_EVAL_CAT = f"""with {_CASES}
select coalesce(category, '(all)') as category, {_MEASURES}, round(quantile_cont((query_id * 37 % 101)::double, 0.5), 6) as seconds_p50, round(quantile_cont((query_id * 37 % 101)::double, 0.95), 6) as seconds_p95
from scores group by grouping sets ((), (category))
"""


def agg_keyword_support(spark: SparkSession, d: str) -> DataFrame:
    """The share of each question's first five words that its hits have."""
    cases = _questions(spark, d).select(F.col("item_id").alias("query_id"), F.slice(fx.words(F.col("text")), 1, 5).alias("keywords"))
    return evaluation.keyword_support(cases, _hybrid(spark, d).filter("rank = 1"), "keywords", "text")


AGG_KEYWORD_SUPPORT = f"""with {_HYBRID},
w as (select distinct item_id as query_id, unnest(list_slice(regexp_extract_all(lower(text), '[a-z0-9]+'), 1, 5)) as word from benchmark),
m as (select query_id, word, max(coalesce(contains(lower(hy.text), word), false)::int) as met from w left join (select * from hy where rank = 1) hy using (query_id) group by 1, 2)
select query_id, round(avg(met), 6) as support from m group by 1
"""


def join_title(spark: SparkSession, d: str) -> DataFrame:
    """Titles of hits from the items (customers stand in), else the file name, else a made-up one."""
    items = table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"))
    hits = _hybrid(spark, d).select("query_id", "doc_id", "source", "rank").join(items, "doc_id", "left")
    filename = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return hits.select("query_id", "rank", "doc_id", F.coalesce(F.nullif("title", F.lit("")), filename, F.concat(F.lit("Knowledge Item "), "doc_id")).alias("title"))


JOIN_TITLE = f"""with {_HYBRID}
select query_id, rank, hy.doc_id, coalesce(nullif(c_name, ''), case when hy.doc_id % 2 = 0 then source end, 'Knowledge Item ' || hy.doc_id) as title
from hy left join (select * from customer where c_custkey % 3 <> 0) c on c.c_custkey = hy.doc_id
"""


def gate_relevance(spark: SparkSession, d: str) -> DataFrame:
    """The relevance gate over the hybrid hits; entities of the question missing in the first three documents."""
    q = _questions(spark, d).select(F.col("item_id").alias("query_id"), fx.entities(F.col("text")).alias("wanted"))
    seen = _hybrid(spark, d).groupBy("query_id").agg(
        F.count("*").alias("n_hits"), F.max("rerank_score").alias("top_score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "text")))), lambda x: x["text"]), "\n").alias("evidence")
    )
    found = q.join(seen, "query_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)).cast("long")).withColumn("tool_ok", F.col("query_id") % 10 == 0)
    found = found.withColumn("missing", F.filter("wanted", lambda x: ~F.contains(F.coalesce("evidence", F.lit("")), x)))
    return retrieval.gate(found).select("query_id", "n_hits", "top_score", F.size("missing").cast("long").alias("n_missing"), "decision")


GATE_RELEVANCE = rf"""with {_HYBRID},
want as (select item_id as query_id, list_distinct(list_concat(list_concat(regexp_extract_all(text, '\b([A-Za-z]+[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*)', 1),
    regexp_extract_all(text, '([0-9]+(?:\.[0-9]+)?(?:%|元|天|小时|分钟|年|个月|个工作日))', 1)), regexp_extract_all(text, '[“"《「]([^”"》」]{{2,40}})[”"》」]', 1))) as wanted from benchmark),
seen as (select query_id, count(*) as n_hits, max(rerank_score) as top_score, string_agg(text, chr(10) order by rank) filter (rank <= 3) as evidence from hy group by 1),
m as (select want.query_id, coalesce(n_hits, 0) as n_hits, top_score, len(list_filter(wanted, lambda x : not contains(coalesce(evidence, ''), x))) as n_missing, want.query_id % 10 = 0 as tool_ok from want left join seen using (query_id))
select query_id, n_hits, top_score, n_missing, case when n_hits = 0 and not tool_ok then 'review:no_hits' when coalesce(top_score, 0) < 0.78 and not tool_ok then 'review:low_score'
  when n_missing > 0 then 'review:missing_entities' else 'confident' end as decision from m
"""


def topk_extractive(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d).select(F.col("item_id").alias("query_id"), fx.query_terms(F.col("text")).alias("terms"))
    hits = _hybrid(spark, d).select("query_id", "rank", "text").join(q, "query_id")
    return retrieval.extractive(hits, F.col("terms"), ["query_id"], ["rank"], "text").select("query_id", "pick", "rank", "score", F.md5("sentence").alias("sentence_md5"))


TOPK_EXTRACTIVE = f"""with {_HYBRID},
qq as (select item_id as query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x : length(x) >= 2)) as ts from benchmark),
parts as (select hy.query_id, rank, ts, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([。！？!?；;])[ \\t\\n\\x0B\\f\\r]*', '\\1' || chr(1), 'g'), chr(1)), lambda x : trim(x, ' ')), lambda x : x <> '')) as sentence,
   generate_subscripts(list_filter(list_transform(string_split(regexp_replace(text, '([。！？!?；;])[ \\t\\n\\x0B\\f\\r]*', '\\1' || chr(1), 'g'), chr(1)), lambda x : trim(x, ' ')), lambda x : x <> ''), 1) - 1 as sent_no from hy join qq using (query_id)),
sc as (select *, list_sum(list_transform(list_filter(ts, lambda t : contains(lower(sentence), t)), lambda t : length(t))) as matched from parts),
sr as (select query_id, rank, sentence, round(matched + 0.01 * greatest(0, 5 - sent_no), 6) as score, row_number() over (partition by query_id, rank order by round(matched + 0.01 * greatest(0, 5 - sent_no), 6) desc, sent_no) as sent_rank from sc where matched > 0),
fi as (select * from sr qualify row_number() over (partition by query_id, sentence order by rank, sent_rank) = 1)
select query_id, (row_number() over (partition by query_id order by rank, sent_rank))::int as pick, rank, score::double as score, md5(sentence) as sentence_md5 from fi qualify pick <= 3
"""


def prj_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The evidence block of each question: numbered hits with score, one text per question."""
    hits = _hybrid(spark, d).select("query_id", "rank", "doc_id", "rrf_score", fx.preview(F.col("text"), 200).alias("content"))
    line = F.concat(F.lit("["), "rank", F.lit("] doc_id: "), "doc_id", F.lit("\nscore: "), F.format_string("%.4f", F.round("rrf_score", 4)), F.lit("\n"), "content")
    return hits.groupBy("query_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n")).alias("evidence_md5"), F.count("*").alias("n"))


PRJ_EVIDENCE = rf"""with {_HYBRID},
c as (select *, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from hy)
select query_id, md5(string_agg('[' || rank || '] doc_id: ' || doc_id || chr(10) || 'score: ' || printf('%.4f', round(rrf_score, 4)) || chr(10) || case when length(t) <= 200 then t else left(t, 197) || '...' end, chr(10) || chr(10) order by rank)) as evidence_md5, count(*) as n
from c group by 1
"""


def set_variants(spark: SparkSession, d: str) -> DataFrame:
    """The question and its first sentence as search variants, distinct, original first."""
    return _variants(spark, d)


SET_VARIANTS = """
with v as (select item_id as query_id, trim(text) as a, trim(regexp_extract(text, '^[^.]*[.]?')) as b from benchmark)
select query_id, 0 as variant_no, a as variant from v where a <> '' union all select query_id, (a <> '')::int, b from v where b <> '' and b <> a
"""


def join_neighbors(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return retrieval.neighbours(c, c.filter("role = 'user'").select("conv_id", "turn"), "conv_id", "turn", 2).select("conv_id", "center", "turn", "role")


JOIN_NEIGHBORS = "select a.conv_id, a.turn as center, b.turn, b.role from conversations a join conversations b on a.conv_id = b.conv_id and b.turn between greatest(a.turn - 2, 0) and a.turn + 2 where a.role = 'user'"


def topk_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The three sentences of each document that have the most letters of long words (a query of fixed terms)."""
    s = table(spark, d, "documents").select("doc_id", F.posexplode(fx.sentences(F.col("text"), fx.ANSWER_ENDS + ".")).alias("sent_no", "sentence"))
    terms = ["the", "tion", "der", "que", "los"]
    low = F.lower("sentence")
    matched = sum((F.when(F.contains(low, F.lit(t)), len(t)).otherwise(0) for t in terms), F.lit(0))
    s = s.withColumn("score", F.round(matched + 0.01 * F.greatest(F.lit(0), 5 - F.col("sent_no")), 6))
    return retrieval.top(s, ["doc_id"], [F.desc("score"), F.col("sent_no")], 3).select("doc_id", "sent_no", "score", "rank")


TOPK_SENTENCES = r"""
with p as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([。！？!?；;.])[ \t\n\x0B\f\r]*', '\1' || chr(1), 'g'), chr(1)), lambda x : trim(x, ' ')), lambda x : x <> '') as parts from documents),
s as (select doc_id, unnest(parts) as sentence, generate_subscripts(parts, 1) - 1 as sent_no from p),
m as (select doc_id, sent_no::int as sent_no, (case when contains(lower(sentence), 'the') then 3 else 0 end + case when contains(lower(sentence), 'tion') then 4 else 0 end + case when contains(lower(sentence), 'der') then 3 else 0 end
  + case when contains(lower(sentence), 'que') then 3 else 0 end + case when contains(lower(sentence), 'los') then 3 else 0 end) as matched from s)
select doc_id, sent_no, round(matched + 0.01 * greatest(0, 5 - sent_no), 6)::double as score, (row_number() over (partition by doc_id order by round(matched + 0.01 * greatest(0, 5 - sent_no), 6) desc, sent_no))::int as rank from m qualify rank <= 3
"""

QUERIES = {
    "topk_dense": (topk_dense, TOPK_DENSE),
    "topk_bm25": (topk_bm25, TOPK_BM25),
    "tool_functions": (tool_functions, TOOL_FUNCTIONS),
    "topk_dense_lists": (topk_dense_lists, None),
    "topk_dense_lists_exact": (topk_dense_lists_exact, TOPK_DENSE),
    "topk_bm25_scan": (topk_bm25_scan, TOPK_BM25_SCAN),
    "topk_bm25_upserted": (topk_bm25_upserted, TOPK_BM25_UPSERTED),
    "agg_bm25_stats": (agg_bm25_stats, AGG_BM25_STATS),
    "topk_bm25_scoped": (topk_bm25_scoped, TOPK_BM25_SCOPED),
    "agg_rrf": (agg_rrf, AGG_RRF),
    "topk_rerank": (topk_rerank, TOPK_RERANK),
    "topk_hybrid": (topk_hybrid, TOPK_HYBRID),
    "win_dedup_first": (win_dedup_first, WIN_DEDUP_FIRST),
    "join_qrels": (join_qrels, JOIN_QRELS),
    "agg_eval": (agg_eval, AGG_EVAL),
    "agg_eval_cat": (agg_eval_cat, AGG_EVAL_CAT),
    "join_title": (join_title, JOIN_TITLE),
    "gate_relevance": (gate_relevance, GATE_RELEVANCE),
    "topk_extractive": (topk_extractive, TOPK_EXTRACTIVE),
    "topk_sentences": (topk_sentences, TOPK_SENTENCES),
    "prj_evidence": (prj_evidence, PRJ_EVIDENCE),
    "set_variants": (set_variants, SET_VARIANTS),
    "set_union_candidates": (set_union_candidates, SET_UNION_CANDIDATES),
    "agg_keyword_support": (agg_keyword_support, AGG_KEYWORD_SUPPORT),
    "join_neighbors": (join_neighbors, JOIN_NEIGHBORS),
}
