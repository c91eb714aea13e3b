"""Whitening of embeddings: blockwise TSQR of the centred rows, then a one-sided Jacobi SVD of the triangle that is left."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import Scratch, batch_of

SCALE, OFFSET, COMPONENTS = 64.0, 1_000_000, 32
#: Rows that go into one triangle at a time, and partial results that one task, or the driver, takes together.
BLOCK, FAN_IN = 4096, 64


def usable(vector: str) -> Column:
    """Vectors that are there and whose entries are all finite."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col(vector).isNotNull() & F.forall(vector, fits)


def _matrix(batch: pa.RecordBatch, at: int) -> np.ndarray:
    """The vectors as floor(scale * entry), exact whole numbers; the offset is left out, as it cancels in all that follows."""
    column = batch.column(at)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(SCALE * flat)
    if len(whole) and np.abs(whole).max() >= 2.0**62:
        raise OverflowError("an entry times the scale does not fit into a long")
    return whole.astype(np.int64).reshape(len(column), -1)


_SUMS = "pos int, rows long, total decimal(38,0)"
_SUMS_ARROW = pa.schema([("pos", pa.int32()), ("rows", pa.int64()), ("total", pa.decimal128(38, 0))])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each task and dimension: exact sums."""
    rows, total = 0, 0
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            x = _matrix(batch.slice(lo, BLOCK), 0)
            small = float(np.abs(x.astype(np.float64)).max()) * len(x) < 2.0**62
            total = total + (x if small else x.astype(object)).sum(axis=0).astype(object)
            rows += len(x)
    if rows:
        yield batch_of(_SUMS_ARROW, np.arange(len(total), dtype=np.int32), np.full(len(total), rows), [Decimal(int(t)) for t in total])


_PART = "rows long, numbers binary"
_PART_ARROW = pa.schema([("rows", pa.int64()), ("numbers", pa.binary())])


def _fold(of: Callable[[np.ndarray], np.ndarray], merge: Callable[[int, np.ndarray, int, np.ndarray], np.ndarray], at: int = 0):  # noqa: ANN202
    """Each task's rows in blocks, merged as they come: one row for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, None
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.slice(lo, BLOCK), at)
                part = of(x)
                total = part if total is None else merge(rows, total, len(x), part)
                rows += len(x)
        if rows:
            yield batch_of(_PART_ARROW, [rows], [total.tobytes()])

    return run


def _merge_parts(merge: Callable[[int, np.ndarray, int, np.ndarray], np.ndarray], shape: tuple[int, ...]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, None
        for batch in batches:
            for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, np.float64).reshape(shape)
                total = part if total is None else merge(rows, total, n, part)
                rows += n
        if rows:
            yield batch_of(_PART_ARROW, [rows], [np.ascontiguousarray(total).tobytes()])

    return run


def tree(parts: DataFrame, merge: Callable[[int, np.ndarray, int, np.ndarray], np.ndarray], shape: tuple[int, ...], scratch: Scratch, name: str) -> tuple[int, np.ndarray | None]:
    """Merges the tasks' results, FAN_IN at a time, until so few are left that the driver merges them: neither a task nor the
    driver ever takes more than FAN_IN, however many tasks there were."""
    level = 0
    parts = scratch.put(f"{name}-0", parts)
    while (n := parts.count()) > FAN_IN:
        level += 1
        parts = scratch.put(f"{name}-{level}", parts.repartition(-(-n // FAN_IN)).mapInArrow(_merge_parts(merge, shape), _PART))
        scratch.drop(f"{name}-{level - 1}")
    rows, total = 0, None
    for r in parts.collect():
        part = np.frombuffer(bytes(r["numbers"]), np.float64).reshape(shape)
        total = part if total is None else merge(rows, total, r["rows"], part)
        rows += r["rows"]
    scratch.drop(f"{name}-{level}")
    return rows, total


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a QR decomposition, always square: missing rows are zero."""
    r, d = np.linalg.qr(rows, mode="r"), rows.shape[1]
    return r if len(r) == d else np.concatenate([r, np.zeros((d - len(r), d))])


def jacobi_svd(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """One-sided Jacobi: plane rotations from the right make the columns of ``r`` orthogonal to machine precision. The
    columns' lengths are the singular values, each accurate in itself, and the rotations together are the right singular
    vectors (as columns); both by falling value. Every round takes disjoint pairs of columns, so that its rotations are one
    product."""
    a, d = r.astype(np.float64).copy(), r.shape[1]
    v = np.eye(d)
    noise = (4 * np.finfo(np.float64).eps) ** 2 * (a * a).sum()  # a column no longer than rounding of the whole counts as zero
    seats = np.arange(d + d % 2)  # a seat beyond the columns rests
    for _ in range(sweeps):
        turned = False
        for _ in range(max(len(seats) - 1, 1)):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            ok = (p < d) & (q < d)
            p, q = p[ok], q[ok]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            todo = np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)
            todo &= np.minimum(alpha, beta) > noise
            if todo.any():
                turned = True
                p, q, alpha, beta, gamma = p[todo], q[todo], alpha[todo], beta[todo], gamma[todo]
                with np.errstate(over="ignore"):
                    zeta = (beta - alpha) / (2 * gamma)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))  # 0 beyond what a double holds
                c = 1 / np.hypot(1.0, t)
                s = c * t
                for m in (a, v):
                    x, y = m[:, p], m[:, q]
                    m[:, p], m[:, q] = c * x - s * y, s * x + c * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])  # all pairs meet in a round robin
        if not turned:
            break
    else:
        raise RuntimeError(f"rotations did not settle in {sweeps} sweeps")
    sigma = np.sqrt((a * a).sum(0))
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], v[:, order]


@dataclass
class Whitening:
    """What was fitted: the number of vectors, sums per dimension (exact, without the offset), unit components as columns,
    their standard deviations and shares of the variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    sd: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - mean, rounded once: n * x - S is whole and exact."""
        return _centred(x, self.n, self.sums) / self.n

    def white(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / self.sd

    def deviation(self, x: np.ndarray) -> list[int]:
        """Exact sums over the dimensions of (n * x - S) squared."""
        far = _centred(x, self.n, self.sums)
        if far.dtype != object and len(far) and float(np.abs(far.astype(np.float64)).max()) ** 2 * far.shape[1] >= 2.0**62:
            far = far.astype(object)
        return [int(i) for i in (far * far).sum(axis=1)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, in longs where they surely hold it, else in whole numbers of any size."""
    most = max([float(np.abs(x.astype(np.float64)).max()) if x.size else 0.0, *(abs(s) / max(n, 1) for s in sums)])
    if n * most >= 2.0**61:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def _add(_n: int, a: np.ndarray, _m: int, b: np.ndarray) -> np.ndarray:
    return a + b


def _stack(_n: int, a: np.ndarray, _m: int, b: np.ndarray) -> np.ndarray:
    return triangle(np.concatenate([a, b]))


def _moments(x: np.ndarray) -> np.ndarray:
    """The mean in the first row, centred products in the others."""
    mean = x.mean(axis=0)
    return np.concatenate([mean[None, :], (x - mean).T @ (x - mean)])


def _merge_moments(n: int, a: np.ndarray, m: int, b: np.ndarray) -> np.ndarray:
    step = b[0] - a[0]
    return np.concatenate([(a[0] + step * (m / (n + m)))[None, :], a[1:] + b[1:] + np.outer(step, step) * (n * m / (n + m))])


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fits on all usable vectors, in two scans: exact sums, then TSQR of the centred rows. None if there are none.

    Each task folds its rows, ``BLOCK`` at a time, into a triangle; triangles are merged in a tree. The last one, d x d,
    is all that the driver decomposes. Components whose standard deviation is no more than rounding (constant or
    dependent dimensions, or fewer rows than dimensions) are left out.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "whitening")
    rows = df.filter(usable(vector)).select(F.col(vector).cast("array<double>").alias("v"))
    sizes = [r["d"] for r in rows.select(F.size("v").alias("d")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError("vectors have different lengths")
    if not sizes or not sizes[0]:
        return None
    each = {r["pos"]: r for r in rows.mapInArrow(_sums, _SUMS).groupBy("pos").agg(F.sum("rows").alias("n"), F.sum("total").alias("total")).collect()}
    n, sums = each[0]["n"], [int(each[i]["total"]) for i in range(sizes[0])]
    d = len(sums)
    _, r = tree(rows.mapInArrow(_fold(lambda x: triangle(_centred(x, n, sums).astype(np.float64) / n), _stack), _PART), _stack, (d, d), scratch, "r")
    sigma, v = jacobi_svd(r)
    total = float((sigma**2).sum())
    kept = sigma[:components] > max(n, d) * np.finfo(np.float64).eps * (sigma[0] if d else 0)
    if not total or not kept.any():
        kept = np.zeros(len(kept), bool)
    at = np.flatnonzero(kept)
    return Whitening(n, sums, v[:, at], sigma[at] / np.sqrt(n), sigma[at] ** 2 / total if total else np.zeros(0))


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance (centred first, divisor n) minus the identity."""
    k = len(model.sd)
    if not k:
        return 0.0
    rows = df.filter(usable(vector)).select(F.col(vector).cast("array<double>").alias("v"))
    parts = rows.mapInArrow(_fold(lambda x: _moments(model.white(x)), _merge_moments), _PART)
    n, total = tree(parts, _merge_moments, (k + 1, k), Scratch(df.sparkSession, "whitening"), "moments")
    return float(np.abs(total[1:] / n - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: ``vec_id``, ``component`` (from 1, by falling variance), ``n`` (vectors in the
    fit), ``deviation`` (sum over the dimensions of (n x - S) squared, exact), ``whitened`` (x less the mean, projected on
    the component, over its standard deviation), ``explained`` (the component's share of the variance) and
    ``identity_error`` (one value).

    x is floor(64 c) + 1,000,000 for each entry c as a double. The table is scanned four times (sums, triangles, check,
    result) and nothing of its size is shuffled. The driver decomposes one d x d triangle, so every row of a run sees
    the same components and signs.

    Vectors that are null or hold a null, NaN or infinite entry are dropped; so are empty ones, if all are empty. Vectors
    of different lengths raise ValueError, entries beyond 2^62 / 64 and deviations beyond a long OverflowError. Ids are cast to
    long (null where they are no numbers) and need not be unique: every row has its rows. Components without
    variance are left out, so equal vectors, or one, give no rows; as does an empty table. Other columns are left out, so their
    names cannot clash.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(df, vector, components)
    if model is None or not len(model.sd):
        return df.sparkSession.createDataFrame([], schema)
    error, k = identity_error(df, model, vector), len(model.sd)
    kinds = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), *[(c, pa.float64()) for c in ("whitened", "explained", "identity_error")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x, m = _matrix(part, 1), part.num_rows
                ids, deviation = part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(model.deviation(x), pa.int64())
                yield batch_of(
                    kinds, ids, np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, model.n), deviation.take(pa.array(np.repeat(np.arange(m), k))),
                    model.white(x).ravel(), np.tile(model.explained, m), np.full(m * k, error),
                )

    return df.filter(usable(vector)).select(F.col(id_col).try_cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, schema)
