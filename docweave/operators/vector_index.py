"""A kept vector index: inverted lists around coarse centroids, searched in the nearest lists of each query only."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import retrieval
from docweave.sources import sinks

#: The centroids are fitted on so many vectors at most, those with the smallest hashes of their ids. Every vector is indexed.
SAMPLE = 20_000
MOST_LISTS = 4096
ROUNDS = 12
#: Part of the true neighbours that a query without a number of candidates shall find, and the vectors that calibrate it.
RECALL, ASKED, NEAREST = 0.95, 256, 20


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    centroids: np.ndarray
    sizes: np.ndarray  # vectors of each list
    id_col: str
    scoped: bool
    share: float  # of the vectors that a query has to look at for RECALL

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")


def fit(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: unit centroids of at most ``lists`` cells. It begins with vectors spread over the sample; a cell that
    runs empty begins anew at the vector that its centroid serves worst."""
    lists = min(lists, len(sample))
    at = np.linspace(0, len(sample) - 1, lists).astype(int)
    c = sample[at].copy()
    for _ in range(rounds):
        score = sample @ c.T
        own = score.argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        if len(empty):
            total[empty] = sample[np.argsort(score.max(1))[: len(empty)]]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-300)
    return c


def calibrate(sample: np.ndarray, centroids: np.ndarray) -> float:
    """The part of all vectors, going from list to list, before which RECALL of the sample's own nearest neighbours are met:
    small where vectors lie in clusters, large where they lie evenly."""
    asked = sample[:: max(1, len(sample) // ASKED)]
    near = asked @ sample.T
    near[np.arange(len(asked)), np.arange(0, len(sample), max(1, len(sample) // ASKED))] = -2  # not itself
    top = np.argpartition(-near, min(NEAREST, len(sample)) - 1, axis=1)[:, :NEAREST]
    own = (sample @ centroids.T).argmax(1)
    order = np.argsort(-(asked @ centroids.T), axis=1)
    sizes = np.bincount(own, minlength=len(centroids))[order]
    before = np.empty(order.shape)
    np.put_along_axis(before, order, np.cumsum(sizes, axis=1) - sizes, axis=1)
    return float(np.quantile(np.take_along_axis(before, own[top], axis=1), RECALL) / len(sample) + 1e-9)


def create(vectors: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding", scope_col: str | None = None, lists: int | None = None) -> VectorIndex:
    """Fits centroids on a bounded sample and puts every vector into the list of its nearest one, in one scan and one write
    that splits large lists over tasks. Null vectors are left out."""
    spark, path = vectors.sparkSession, path.rstrip("/")
    scope = F.col(scope_col).cast("string") if scope_col else F.lit("")
    base = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), scope.alias("scope"), F.col(vec_col).cast("array<double>").alias("v"))
    n = base.count()
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    some = base.filter(draw <= F.lit(int(min(1.0, 1.2 * SAMPLE / max(n, 1)) * (1 << 30)))).orderBy(draw, "id").limit(SAMPLE).toArrow()
    sample = retrieval._matrix(some["v"].combine_chunks()) if n else np.zeros((1, 1))
    held = spark.sparkContext.broadcast(fit(sample, min(MOST_LISTS, lists or max(1, round(4 * n**0.5)))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = (retrieval._matrix(batch.column(2)) @ held.value.T).argmax(1).astype(np.int32) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=["id", "scope", "v", "list"])

    dealt = base.mapInArrow(assign, "id long, scope string, v array<double>, list int")
    dealt.hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/lists")
    sizes = np.zeros(len(held.value), np.int64)
    for r in spark.read.schema("id long, list int").parquet(f"{path}/lists").groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    state = {"centroids": held.value.tolist(), "sizes": sizes.tolist(), "id_col": id_col, "scoped": scope_col is not None, "share": calibrate(sample, held.value)}
    sinks.publish(spark, f"{path}/state", json.dumps(state))
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    found = sinks.changes(spark, f"{path.rstrip('/')}/state")
    if not found:
        raise FileNotFoundError(f"there is no index at {path}")
    state = json.loads(found[-1][1])
    return VectorIndex(spark, path.rstrip("/"), np.array(state["centroids"]), np.array(state["sizes"], np.int64), state["id_col"], state["scoped"], state["share"])


def search(index: VectorIndex, queries: DataFrame, k: int, vec_col: str = "embedding", scope_col: str | None = None, num_candidates: int | None = None, exact: bool = False) -> DataFrame:
    """The k nearest vectors of each query by cosine within its scope: query_id, id, score (1 + cosine) / 2 rounded to 6, rank.

    Each query goes through its nearest lists until they can be expected to hold ``num_candidates`` vectors of its scope
    (without a number: the calibrated share of them, at least 4 k and 20). Only those lists' folders are read. ``exact`` goes through
    all. Queries travel in blocks of bounded size; a list of any size is split over tasks like any other file.
    """
    spark, id_col = index.spark, index.id_col
    scope = F.col(scope_col).cast("string") if scope_col else F.lit("")
    asked = queries.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), scope.alias("scope"), F.col(vec_col).cast("array<double>").alias("v"))
    total = int(index.sizes.sum())
    shares = index.vectors().select("scope").join(asked.select("scope").distinct(), "scope", "left_semi").groupBy("scope").count() if index.scoped else None
    of_scope = {r["scope"]: r["count"] for r in shares.collect()} if shares is not None else {"": total}
    n_blocks, out = max(1, -(-asked.count() // retrieval.QUERY_BLOCK)), None
    for b in range(n_blocks):
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).toArrow()
        q, scopes = retrieval._matrix(block["v"].combine_chunks()), np.array(block["scope"].to_pylist(), object)
        probes = np.zeros((len(q), len(index.sizes)), bool)
        if len(q):
            order = np.argsort(-(q @ index.centroids.T), axis=1)
            there = np.array([of_scope.get(s, 0) for s in scopes], float)
            want = there if exact else np.maximum(index.share * there, max(4 * k, 20)) if num_candidates is None else np.full(len(q), float(num_candidates))
            before = np.cumsum(index.sizes[order], axis=1) - index.sizes[order]
            use = before * (there / max(total, 1))[:, None] < want[:, None]  # lists before which there are still too few
            np.put_along_axis(probes, order, use, axis=1)
        held = spark.sparkContext.broadcast((block["id"].to_numpy(), scopes, q, probes))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            qid, qscope, q, probes = held.value
            for batch in batches:
                lists = batch.column(3).to_numpy()
                for own in np.unique(lists):
                    rows, asks = np.flatnonzero(lists == own), np.flatnonzero(probes[:, own])
                    if not len(asks):
                        continue
                    part = batch.take(pa.array(rows))
                    ids, there = part.column(0).to_numpy(), np.array(part.column(1).to_pylist(), object)
                    score = np.round((1 + q[asks] @ retrieval._matrix(part.column(2)).T) / 2, 6)
                    score[qscope[asks][:, None] != there[None, :]] = -1
                    i, j = retrieval.best(score, ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[asks][i]), pa.array(ids[j]), pa.array(score[i, j])], names=["query_id", id_col, "score"])

        read = index.vectors().filter(F.col("list").isin(np.flatnonzero(probes.any(axis=0)).tolist())) if len(q) else index.vectors().limit(0)
        found = read.select("id", "scope", "v", "list").mapInArrow(run, f"query_id long, {id_col} long, score double")
        out = found if out is None else out.union(found)
    return retrieval.top(out, ["query_id"], [F.desc("score"), F.col(id_col)], k)
