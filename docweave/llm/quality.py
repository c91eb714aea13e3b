"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import IS_SPACE, blocks, make_room, text_buffer, with_text, word_bounds, word_hashes

#: Buckets for words; above them come the statistics' buckets.
WORD_BUCKETS = 1 << 14
STATS = ("symbols", "digits", "capitals", "wide", "line_ends", "mean_word", "n_words", "n_bytes", "symbol_words", "distinct", "echoes")
STEPS = 16
FEATURES = WORD_BUCKETS + len(STATS) * STEPS
RANK = 8
#: The model is fitted on so many labelled rows at most, those with the smallest hashes of their ids.
MAX_TRAIN_ROWS = 12_000
THRESHOLD = 0.3
#: Bytes of text whose features stand in a worker at a time, the arrays made of them being many times larger.
BLOCK = 1 << 20

_KIND = np.zeros(256, np.uint8)  # 1 symbol, 2 digit, 3 capital, 4 part of a wide character
for _b in range(33, 127):
    _c = chr(_b)
    _KIND[_b] = 2 if _c.isdigit() else 3 if _c.isupper() else 0 if _c.islower() or _c in ".,'-" else 1
_KIND[128:] = 4


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def features(texts: pa.Array, buckets: int = WORD_BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows as (row offsets, feature numbers, values). A row's word values are square roots of counts, scaled to
    length 1; each statistic is one feature, the step it falls in. The words' case and their text alone count:
    no label, language, source or id is read."""
    buf, offsets = text_buffer(texts)
    n = len(offsets) - 1
    starts, ends, upto = word_bounds(buf, offsets)
    hashes = word_hashes(buf, starts, ends, seed=9)
    doc = np.repeat(np.arange(n), np.diff(upto))
    key, count = np.unique(doc * buckets + (hashes % np.uint64(buckets)).astype(np.int64), return_counts=True)
    row, bucket = key // buckets, key % buckets
    value = np.sqrt(count)
    norm = np.sqrt(np.bincount(row, value * value, n))
    value /= np.maximum(norm, 1)[row]
    size = np.diff(offsets)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    kind = _KIND[buf]
    solid = np.maximum(per_doc(~IS_SPACE[buf]), 1)
    words = np.diff(upto)
    odd = np.zeros(len(starts), bool)
    if len(starts):
        odd = kind[ends - 1] == 1
    shares = [per_doc(kind == k) / solid for k in (1, 2, 3, 4)] + [per_doc(buf == 10) / np.maximum(words, 1)]
    odd_words = np.bincount(doc[odd], minlength=n) / np.maximum(words, 1)
    distinct = np.bincount(row, minlength=n) / np.maximum(words, 1)
    echo = np.zeros(len(starts), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    echoes = np.bincount(doc[echo], minlength=n) / np.maximum(words, 1)
    steps = [np.minimum((np.sqrt(s) * STEPS).astype(np.int64), STEPS - 1) for s in shares]
    steps.append(np.minimum((solid / np.maximum(words, 1)).astype(np.int64), STEPS - 1))
    steps += [np.minimum(np.log2(x + 1).astype(np.int64), STEPS - 1) for x in (words, size)]
    steps += [np.minimum((np.sqrt(odd_words) * STEPS).astype(np.int64), STEPS - 1), np.minimum((distinct * STEPS).astype(np.int64), STEPS - 1), np.minimum((np.sqrt(echoes) * STEPS).astype(np.int64), STEPS - 1)]
    stat = np.stack([buckets + i * STEPS + s for i, s in enumerate(steps)], axis=1)
    rows = np.concatenate([row, np.repeat(np.arange(n), len(STATS))])
    cols = np.concatenate([bucket, stat.reshape(-1)])
    vals = np.concatenate([value, np.full(n * len(STATS), 0.5)])
    order = np.argsort(rows, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), cols[order].astype(np.int32), vals[order].astype(np.float32)


def scores(model: Model, offsets: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> np.ndarray:
    """Log odds of every row. All pairs of a row's features interact, in linear time: half of the squared sum less the sum
    of squares, in each factor. A row always has its statistics, so no row is empty."""
    if len(offsets) == 1:
        return np.zeros(0)
    at = offsets[:-1]
    part = model.factors[cols] * vals[:, None]
    pairs = 0.5 * (np.add.reduceat(part, at) ** 2 - np.add.reduceat(part * part, at)).sum(1)
    return model.bias + np.add.reduceat(model.linear[cols] * vals, at) + pairs


def fit(offsets: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, visits: int = 120_000, batch: int = 64, rate: float = 0.05, decay: float = 1e-5, seed: int = 1) -> Model:
    """Logistic loss, AdaGrad on small batches in a seeded order: about ``visits`` rows in all, each row 8 to 200 times. Without both classes the model is a constant."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    m = Model(float(np.log(share / (1 - share))), np.zeros(FEATURES, np.float32), rng.normal(0, 0.02, (FEATURES, RANK)).astype(np.float32))
    if len(np.unique(y)) < 2:
        m.factors[:] = 0
        return m
    g_lin, g_fac = np.full(FEATURES, 1e-2, np.float32), np.full((FEATURES, RANK), 1e-2, np.float32)
    for _ in range(min(200, max(8, visits // len(y)))):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            size = (offsets[rows + 1] - offsets[rows]).astype(np.int64)
            local = np.concatenate([[0], np.cumsum(size)])
            take = np.arange(local[-1]) - np.repeat(local[:-1] - offsets[rows], size)
            c, v = cols[take], vals[take]
            part = m.factors[c] * v[:, None]
            total = np.add.reduceat(part, local[:-1])
            z = m.bias + np.add.reduceat(m.linear[c] * v, local[:-1]) + 0.5 * (total**2 - np.add.reduceat(part * part, local[:-1])).sum(1)
            err = np.repeat((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]), size).astype(np.float32) / len(rows)
            seen, back = np.unique(c, return_inverse=True)
            d_lin = np.bincount(back, err * v, len(seen)).astype(np.float32) + decay * m.linear[seen]
            inner = err[:, None] * v[:, None] * (np.repeat(total, size, axis=0) - part)
            d_fac = np.stack([np.bincount(back, inner[:, k], len(seen)) for k in range(RANK)], axis=1).astype(np.float32) + decay * m.factors[seen]
            g_lin[seen] += d_lin**2
            g_fac[seen] += d_fac**2
            m.linear[seen] -= rate * 4 * d_lin / np.sqrt(g_lin[seen])
            m.factors[seen] -= rate * d_fac / np.sqrt(g_fac[seen])
            m.bias -= rate * float(err.sum() / max(1, len(rows)))
    return m


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the crc32 of the id as text leaves 0 modulo 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make_room("quality")
    for batch in batches:
        for block in blocks([batch], limit=BLOCK):
            offsets, cols, vals = features(block.column(1))
            offs = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(offs, pa.array(cols)), pa.ListArray.from_arrays(offs, pa.array(vals)), block.column(2)], names=["y", "cols", "vals", "id"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fits on labelled rows that are not held out, ``max_rows`` at most (the documented bound): their features, not
    their texts, come to the driver. Rows without a label, an id or a text do not teach; an id labelled twice teaches
    the smaller label."""
    picked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col)).cast("double").alias("y"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    # An id that several rows bear teaches once; sorted by id, the rows are the same however the input is cut.
    one = texts.join(F.broadcast(picked), texts.doc == picked.id).groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = one.select("y", "text", F.col("id").cast("string").alias("id")).mapInArrow(_featurise, "y double, cols array<int>, vals array<float>, id string").toArrow().sort_by("id")
    if rows.num_rows == 0:
        return fit(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0))
    cols, vals = rows["cols"].combine_chunks(), rows["vals"].combine_chunks()
    sizes = np.array(cols.value_lengths())
    return fit(np.concatenate([[0], np.cumsum(sizes)]), cols.flatten().to_numpy(), vals.flatten().to_numpy(), rows["y"].to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability of label 1, without a shuffle. Null texts count as empty; an existing
    column of the new name is replaced. The model (under 1 MB, whatever the input) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != score_col])
    n, (fed, text_name) = len(kept.columns), with_text(kept, text_col)
    at = fed.columns.index(text_name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("quality")
        for batch in batches:
            for block in blocks([batch], text_name, limit=BLOCK):
                p = 1 / (1 + np.exp(-np.clip(scores(shared.value, *features(block.column(at))), -30, 30)))
                yield pa.RecordBatch.from_arrays([*block.columns[:n], pa.array(p, pa.float64())], names=[*block.schema.names[:n], score_col])

    from pyspark.sql import types as T

    return fed.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(score_col, T.DoubleType())]))
