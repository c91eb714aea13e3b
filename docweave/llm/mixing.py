"""Mixing to target weights with soft membership: domain posteriors, and document rates by projected gradients."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import Scratch, blocks, make_room, text_buffer, with_text, word_bounds
from docweave.llm.quality import STATS, STEPS, features

#: The classifier is fitted on so many labelled rows at most, those with the smallest hashes of their ids.
MAX_TRAIN_ROWS = 12_000
#: Words are told apart in so many buckets; the structure statistics lie above them.
BUCKETS = 1 << 18
_FEATURES = BUCKETS + len(STATS) * STEPS
#: What a word's presence counts. Lengths do not scale it: one word can tell the domain of a long text.
PRESENT = 0.3
#: What unevenness of the rates counts against the squared error of the totals.
RIDGE = 1e-8
MOST_ROUNDS = 300
TOLERANCE = 1e-7


@dataclass
class Domains:
    names: list[str]
    weights: np.ndarray
    bias: np.ndarray


def _fit(offsets: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, names: list[str], visits: int = 100_000, batch: int = 64, rate: float = 0.3, seed: int = 5) -> Domains:
    """Softmax regression, AdaGrad on small batches in a seeded order. Rows of each domain count as in the sample."""
    d = len(names)
    share = (np.bincount(y, minlength=d) + 1) / (len(y) + d)
    m = Domains(names, np.zeros((_FEATURES, d), np.float32), np.log(share).astype(np.float32))
    if d < 2 or not len(y):
        return m
    rng, seen_sq = np.random.default_rng(seed), np.full((_FEATURES, d), 1e-2, np.float32)
    for _ in range(min(100, max(4, visits // len(y)))):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            size = (offsets[rows + 1] - offsets[rows]).astype(np.int64)
            local = np.concatenate([[0], np.cumsum(size)])
            take = np.arange(local[-1]) - np.repeat(local[:-1] - offsets[rows], size)
            c, v = cols[take], vals[take]
            err = _softmax(np.add.reduceat(m.weights[c] * v[:, None], local[:-1]) + m.bias)
            err[np.arange(len(rows)), y[rows]] -= 1
            err /= len(rows)
            feat, back = np.unique(c, return_inverse=True)
            each = np.repeat(err, size, axis=0) * v[:, None]
            grad = np.stack([np.bincount(back, each[:, k], len(feat)) for k in range(d)], axis=1).astype(np.float32)
            seen_sq[feat] += grad**2
            m.weights[feat] -= rate * grad / np.sqrt(seen_sq[feat])
            m.bias -= rate * err.sum(0) * 0.1
    return m


def _present(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets, cols, vals = features(texts, BUCKETS)
    return offsets, cols, np.where(cols < BUCKETS, np.float32(PRESENT), vals)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make_room("mixing")
    for batch in batches:
        for block in blocks([batch]):
            offsets, cols, vals = _present(block.column(1))
            offs = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(offs, pa.array(cols)), pa.ListArray.from_arrays(offs, pa.array(vals)), block.column(2)], names=["domain", "cols", "vals", "id"])


def fit_domains(docs: DataFrame, labelled: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", max_rows: int = MAX_TRAIN_ROWS) -> Domains:
    """A classifier of ``names`` from the labelled table (id, domain), on ``max_rows`` of its rows at most (the documented
    bound). Rows of other domains, without domain, id or text do not teach; an id in two domains teaches the one that
    comes first by name. Without rows the posteriors are equal."""
    picked = labelled.filter(F.col(domain_col).isin(names) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(domain_col).alias("domain"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    # An id that several rows bear teaches once; sorted by id, the rows are the same however the input is cut.
    one = texts.join(F.broadcast(picked), texts.doc == picked.id).groupBy("id", "domain").agg(F.min("text").alias("text"))
    rows = one.select("domain", "text", F.col("id").cast("string").alias("id")).mapInArrow(_featurise, "domain string, cols array<int>, vals array<float>, id string").toArrow().sort_by("id")
    y = np.array([names.index(x) for x in rows["domain"].to_pylist()], np.int64)
    cols, vals = (rows[c].combine_chunks() for c in ("cols", "vals"))
    sizes = np.array(cols.value_lengths(), np.int64) if len(y) else np.zeros(0, np.int64)
    flat = (cols.flatten().to_numpy(), vals.flatten().to_numpy()) if len(y) else (np.zeros(0, np.int32), np.zeros(0, np.float32))
    return _fit(np.concatenate([[0], np.cumsum(sizes)]), *flat, y, names)


def posteriors(docs: DataFrame, model: Domains, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns, and ``n_tokens`` (words, long) and ``posterior`` array<double> in the order of the model's names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_tokens", "posterior")])
    n, (fed, text_name) = len(kept.columns), with_text(kept, text_col)
    at = fed.columns.index(text_name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("mixing")
        m = shared.value
        for batch in batches:
            for block in blocks([batch], text_name):
                texts = block.column(at)
                offsets, cols, vals = _present(texts)
                p = _softmax((np.add.reduceat(m.weights[cols] * vals[:, None], offsets[:-1]) + m.bias).astype(np.float64))
                words = np.diff(word_bounds(*text_buffer(texts))[2])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*block.columns[:n], pa.array(words, pa.int64()), lists], names=[*block.schema.names[:n], "n_tokens", "posterior"])

    schema = T.StructType([*kept.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])
    return fed.mapInArrow(run, schema)


def _rates(p: np.ndarray, start: float, steps: np.ndarray) -> np.ndarray:
    """Every document's rate: the start less all gradient steps so far, projected on what is not negative. It follows from
    the posteriors and one vector, so the rates of a lost or rerun task come out the same and no state is kept."""
    return np.maximum(0.0, start - p @ steps)


def fit_rates(soft: DataFrame, targets: list[float], budget: float | None = None, ridge: float = RIDGE, rounds: int = MOST_ROUNDS) -> tuple[float, np.ndarray, dict]:
    """The steps whose rates make the expected token totals of the domains match ``targets`` (weights; scaled to sum to
    1) of ``budget`` tokens (default: the corpus's own).

    Minimises the squared error of the totals, and ``ridge`` times the squared distance of the rates from even use
    weighted by tokens, over rates >= 0. It is projected gradients with lazy projection: a document's gradient is its
    posterior times the error, steps add up to one vector, and the start less that vector is projected. Each round is one
    aggregate over all documents that returns the totals, the value and the curvature among documents with a positive
    rate (D * D + D + 1 numbers); that curvature scales the step, halved until the value falls. The ridge comes down by
    hundreds, so that targets out of reach end at the nearest totals too. Returns the starting rate, the steps and a
    report: totals reached, largest error, squared error, rounds. Raises if ``rounds`` are not enough.
    """
    d = len(targets)
    goal = np.array(targets, float) / (sum(targets) or 1.0)
    total = soft.agg(F.sum("n_tokens").alias("n")).first().n or 0
    if not total:
        return 1.0, np.zeros(d), {"totals": np.zeros(d), "error": 1.0, "squared": float(goal @ goal), "rounds": 0}
    start = (budget or total) / total
    done = 0

    def look(steps: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """At rates in units of the start: totals, half the weighted sum of squared rates, curvature."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s, q, g = np.zeros(d), 0.0, np.zeros((d, d))
            for batch in batches:
                n, p = batch.column(0).to_numpy() / total, batch.column(1).flatten().to_numpy().reshape(-1, d)
                r = _rates(p, 1.0, steps)
                s += (n * r) @ p
                q += float(n @ (r * r)) / 2
                live = r > 0
                g += (p[live] * n[live, None]).T @ p[live]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*s, q, *g.reshape(-1))], names=cols)

        cols = [f"v{i}" for i in range(d + 1 + d * d)]
        row = soft.select("n_tokens", "posterior").mapInArrow(run, ", ".join(f"{c} double" for c in cols)).agg(*[F.sum(c).alias(c) for c in cols]).first()
        v = np.array([row[c] for c in cols])
        return v[:d], float(v[d]), v[d + 1 :].reshape(d, d)

    steps = np.zeros(d)
    sums, half, curve = look(steps)
    weight = max(ridge, 1e-2)
    while True:
        value = lambda s, h, w: w / 2 * s @ s + h + goal @ s  # noqa: E731  convex; its gradient is the one below
        slope = weight * steps - sums + goal
        while np.abs(slope).max() > TOLERANCE:
            move, share, now = -np.linalg.solve(curve + weight * np.eye(d), slope), 1.0, value(steps, half, weight)
            while True:
                if done >= rounds:
                    raise RuntimeError(f"rates did not settle in {rounds} rounds")
                done += 1
                got = look(steps + share * move)
                if value(steps + share * move, got[1], weight) <= now + 1e-4 * share * (slope @ move) + 1e-15:
                    break
                share /= 2
            steps = steps + share * move
            sums, half, curve = got
            slope = weight * steps - sums + goal
        if weight <= ridge:
            break
        less = max(ridge, weight / 100)
        if np.abs(sums - goal).max() > TOLERANCE:  # out of reach so far: the error stays, and steps are the error over the weight
            trial = steps * (weight / less)
            got = look(trial)
            if np.abs(less * trial - got[0] + goal).max() < np.abs(less * steps - sums + goal).max():
                steps, (sums, half, curve) = trial, got
        weight = less
    miss = sums - goal
    return start, steps * start, {"totals": sums * start * total, "error": float(np.abs(miss).max()), "squared": float(miss @ miss), "rounds": done}


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``n_tokens``, ``posterior`` (in the order of ``targets``) and ``rate``: how often each
    document should be used so that the expected tokens of the domains stand as ``targets``.

    The posteriors are written once to the shared folder; rounds read only tokens and posteriors. A document
    without words has rate as any other and adds nothing. Null texts are empty. If the targets cannot be reached the
    totals are the nearest in least squares (see fit_rates for the ridge). An empty table gives no rows. Columns of the new names are replaced.
    """
    names = list(targets)
    model = fit_domains(docs, labelled, names, id_col, text_col)
    soft = Scratch(docs.sparkSession, "mixing").put("posteriors", posteriors(docs, model, id_col, text_col))
    start, steps, _ = fit_rates(soft, [targets[n] for n in names], budget)
    d = len(names)

    @F.pandas_udf("double")
    def rate(p):  # noqa: ANN001, ANN202
        import pandas as pd

        flat = np.concatenate(p.to_numpy()) if len(p) else np.zeros(0)
        return pd.Series(_rates(flat.reshape(-1, d), start, steps))

    return soft.withColumn("rate", rate("posterior"))


def realise(mixed: DataFrame, id_col: str = "doc_id", seed: int = 11) -> DataFrame:
    """Each row as often as its rate says: the whole part, and one more with the probability of the rest, by a hash of
    the id. A null id draws as one id. ``copy`` (int) numbers the copies of a row from 1; a column of that name is
    replaced."""
    draw = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 30)) / float(1 << 30)
    times = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("int")
    return mixed.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
