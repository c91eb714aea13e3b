"""The assistant's six read-only tools, and chunks, as table functions of SQL: ``SELECT * FROM get_chunk_neighbors(7, 1)``, or LATERAL
for many calls at once. They are declared over views, so Spark plans each call as joins and filters of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.lexical_index import LexicalIndex
from docweave.operators.retrieval import B, K1
from docweave.operators.tools import MOST_CHARS, MOST_ROWS

_FUNCTIONS = {
    "search_knowledge_base(question STRING, most INT) RETURNS TABLE (doc_id BIGINT, score DOUBLE, place INT)": f"""
        SELECT id, score, place FROM (SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS place FROM (
          SELECT p.id, round(sum(ln(1 + (p.n - p.df + 0.5) / (p.df + 0.5)) * p.tf / (p.tf + {K1} * (1 - {B} + {B} * p.dl / p.avgdl))), 6) AS score
          FROM (SELECT explode(array_distinct(regexp_extract_all(lower(question), '([a-z0-9]+)', 1))) AS term) q JOIN kb_postings p ON p.term = q.term GROUP BY p.id))
        WHERE place <= greatest(1, least(most, {MOST_ROWS}))""",
    "get_document(wanted BIGINT) RETURNS TABLE (doc_id BIGINT, content STRING, truncated BOOLEAN)": f"SELECT doc_id, left(text, {MOST_CHARS}), coalesce(length(text) > {MOST_CHARS}, false) FROM kb_documents WHERE doc_id = wanted",
    "get_knowledge_item(wanted BIGINT) RETURNS TABLE (item_id BIGINT, title STRING, content STRING)": f"SELECT item_id, title, left(content, {MOST_CHARS}) FROM kb_items WHERE item_id = wanted",
    "get_chunk_neighbors(item BIGINT, center INT, radius INT) RETURNS TABLE (item_id BIGINT, chunk_index INT, content STRING)": """
        SELECT item_id, chunk_index, content FROM kb_chunks WHERE item_id = item AND chunk_index BETWEEN greatest(0, center - greatest(1, least(radius, 3))) AND center + greatest(1, least(radius, 3))""",
    "list_knowledge_base_documents(kb STRING, most INT) RETURNS TABLE (doc_id BIGINT, name STRING, place INT)": f"""
        SELECT doc_id, name, place FROM (SELECT doc_id, name, CAST(row_number() OVER (ORDER BY doc_id DESC) AS INT) AS place FROM kb_documents WHERE knowledge_base = kb) WHERE place <= greatest(1, least(most, {MOST_ROWS}))""",
    "search_conversation_history(conversation BIGINT, wanted STRING, most INT) RETURNS TABLE (turn BIGINT, role STRING, content STRING)": """
        SELECT turn, role, content FROM (SELECT m.*, row_number() OVER (ORDER BY m.turn DESC) AS place FROM kb_messages m WHERE m.conv_id = conversation AND contains(lower(m.content), lower(wanted)))
        WHERE place <= greatest(1, least(most, 10))""",
    "document_chunks(wanted BIGINT) RETURNS TABLE (item_id BIGINT, chunk_index INT, content STRING)": "SELECT item_id, chunk_index, content FROM kb_chunks WHERE item_id = wanted",
}


def register(spark: SparkSession, documents: DataFrame, chunks: DataFrame, items: DataFrame, messages: DataFrame, index: LexicalIndex) -> None:
    """Declares the functions for this session over documents (doc_id, knowledge_base, name, text), chunks (item_id, chunk_index,
    content), items (item_id, title, content), messages (conv_id, turn, role, content) and a lexical index. Which rows a caller
    may see is decided by the tables handed in."""
    hits = index.table("postings").select("seg", "scope", "term", F.explode(F.arrays_zip("hits.id", "hits.tf", "hits.dl")).alias("h")).select("seg", "scope", "term", F.col("h.id").alias("id"), F.col("h.tf").alias("tf"), F.col("h.dl").alias("dl"))
    gone = index.table("gone").select("id", F.col("was").alias("seg"))
    postings = hits.join(gone, ["id", "seg"], "left_anti").join(index.statistics(), ["scope", "term"])
    views = {"kb_documents": documents, "kb_chunks": chunks, "kb_items": items, "kb_messages": messages, "kb_postings": postings}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    for head, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
