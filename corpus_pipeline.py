"""From the documents table to token ids: filter by quality, drop near-repeated lines, keep one of each group of near
copies, mix to target weights, encode. Every stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import line_dedup, mixing, ngram_join, quality, sentencepiece_bpe
from docweave.llm.common import Scratch, documents, passing, text_or_empty
from docweave.llm.queries import TARGETS, labelled_domains

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at THRESHOLD or more. Null texts are scored as empty ones."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), model).filter(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def near_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines that are like an earlier line. A document that loses every line goes; n_chars is counted anew."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", "\\s+", "")) == "")
    out = out.filter(~F.coalesce(emptied, F.lit(False)))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest id, a null
    id before all others, and among texts of one id the one with the smallest hash."""
    groups = ngram_join.ngram_join(docs.select("doc_id", "text"))
    later = groups.filter("not first").select(F.col("doc_id").alias("later_id"), "text_key").distinct()
    is_later = F.col("doc_id").eqNullSafe(F.col("later_id")) & (F.xxhash64(text_or_empty()) == F.col("text_key"))
    return docs.select(*COLUMNS).join(later, is_later, "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, their copies numbered: the domains' expected tokens stand as TARGETS."""
    mixed = mixing.mix(docs.select(*COLUMNS), labelled_domains(spark, sf_dir), TARGETS)
    return mixing.realise(mixed).select(*COLUMNS, "copy")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids under merge-dropout; each copy of a document has its own."""
    return sentencepiece_bpe.encode(docs.select(*COLUMNS, "copy"), copy_col="copy")


STAGES = [
    ("quality_filter", quality_filter),
    ("near_lines", near_lines),
    ("near_documents", near_documents),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: No SQL says what the classifiers and the encoder do; the stages are tested one by one against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. A stage's output is written; what the stage kept in between, and the output
    before it, are deleted then."""
    docs, scratch, last = documents(spark, sf_dir), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        with passing(spark):
            docs = scratch.put(name, stage(spark, docs, sf_dir))
        if last:
            scratch.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
