"""Retrieval quality: recall, reciprocal rank, discounted gain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gain(relevance: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(rank + 1)


def per_case(cases: DataFrame, judged: DataFrame, k: int, ideal: DataFrame | None = None) -> DataFrame:
    """One row for every case (query_id, answerable, and any other columns), with or without hits (query_id, rank,
    relevance): hit, rr, ndcg, n_hits, n_relevant and rejected (a case without an answer got no hits).

    ``ideal`` (query_id, relevance) holds all judgements; without it the hits' own are the ideal.
    """
    cut = judged.filter(F.col("rank") <= k)
    relevant = F.col("relevance") > 0
    found = cut.groupBy("query_id").agg(
        F.max(relevant.cast("int")).alias("hit"), F.max(F.when(relevant, 1.0 / F.col("rank"))).alias("rr"), F.sum(gain(F.col("relevance"), F.col("rank"))).alias("dcg"), F.count("*").alias("n_hits"), F.count_if(relevant).alias("n_relevant")
    )
    best = (ideal if ideal is not None else cut).withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance")))).filter(F.col("i") <= k)
    best = best.groupBy("query_id").agg(F.sum(gain(F.col("relevance"), F.col("i"))).alias("idcg"))
    out = cases.join(found, "query_id", "left").join(best, "query_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("hit", "n_hits", "n_relevant")]
    ndcg = F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0)
    return out.select(*cases.columns, *counts, F.coalesce("rr", F.lit(0.0)).alias("rr"), ndcg.alias("ndcg"), (~F.col("answerable") & F.col("n_hits").isNull()).alias("rejected"))


def _measures() -> list[Column]:
    """Over answerable cases: recall, reciprocal rank, gain and the share of hits that are relevant; over all others the
    share without hits. A part without cases counts 0."""
    yes = F.col("answerable")
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(yes, F.col(c))), F.lit(0.0)), 6)
    cited = F.sum(F.when(yes, F.col("n_relevant"))) / F.nullif(F.sum(F.when(yes, F.col("n_hits"))), F.lit(0))
    return [
        F.count("*").alias("cases"),
        F.count_if(yes).alias("answerable"),
        mean("hit").alias("recall"),
        mean("rr").alias("mrr"),
        mean("ndcg").alias("ndcg"),
        F.round(F.coalesce(cited, F.lit(0.0)), 6).alias("citation_correctness"),
        F.round(F.coalesce(F.avg(F.when(~yes, F.col("rejected").cast("int"))), F.lit(0.0)), 6).alias("rejection_rate"),
    ]


def evaluate(cases: DataFrame) -> DataFrame:
    return cases.agg(*_measures())


def by_category(cases: DataFrame, seconds: str | None = None) -> DataFrame:
    """All cases, and each category, in one pass; with ``seconds`` their median and 95th percentile."""
    took = [F.round(F.percentile(seconds, q), 6).alias(f"{seconds}_p{q * 100:.0f}") for q in (0.5, 0.95)] if seconds else []
    sets = cases.groupingSets([[], ["category"]], "category").agg(*_measures(), *took)
    return sets.withColumn("category", F.coalesce("category", F.lit("(all)")))


def keyword_support(cases: DataFrame, hits: DataFrame, keywords: str, text: str) -> DataFrame:
    """(query_id, support): the share of a case's keywords that some hit contains, case aside; 1 without keywords."""
    low = lambda c: F.lower(c)
    asked = cases.select("query_id", F.explode_outer(F.array_distinct(F.transform(keywords, low))).alias("word"))
    found = asked.join(hits.select("query_id", F.lower(text).alias("content")), "query_id", "left").groupBy("query_id", "word").agg(F.max(F.coalesce(F.contains("content", F.col("word")), F.lit(False))).alias("met"))
    return found.groupBy("query_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("word").isNotNull(), F.col("met").cast("int"))), F.lit(1.0)), 6).alias("support"))
