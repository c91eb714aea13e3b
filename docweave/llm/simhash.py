"""SimHash near-dedup: 64-bit fingerprints of word shingles, links found by multi-index hashing, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import Scratch, batch_of, blocks, partitions, text_buffer, text_or_empty
from docweave.llm.components import connected_components

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Fingerprints of one table entry that a task compares with each other and with those that probe it; entries with more
#: go to the meeting of Hamming balls.
MOST = 4096
_NO_ID = -(1 << 63)
_SHINGLES = 1 << 18
_PAIRS = 1 << 21


def fingerprint(text: bytes, k: int = SHINGLE, seed: int = SEED) -> int:
    """A-Z are lower-cased; a bit is set if it is in over half of the hashes of all k-word shingles, repeats included."""
    words = text.lower().split()  # of bytes: ASCII letters and the six white-space bytes only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - k + 1, 1)
    starts, ends = starts[:n], ends[min(k, len(words)) - 1 :]
    of_bit = np.zeros(64, np.int64)
    for lo in range(0, n, _SHINGLES):
        each = map(joined.__getitem__, map(slice, starts[lo : lo + _SHINGLES].tolist(), ends[lo : lo + _SHINGLES].tolist()))
        digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, each, repeat(seed))), np.uint8)
        of_bit += _bit_counts(digests.reshape(-1, 8))
    return int.from_bytes(np.packbits(2 * of_bit > n).tobytes(), "big")


def _bit_counts(digests: np.ndarray) -> np.ndarray:
    """How many rows of 8 bytes have each of the 64 bits, highest first."""
    full = len(digests) // 255 * 255  # that many ones fit into a byte
    bits = np.unpackbits(digests, axis=1)
    out = bits[full:].sum(axis=0, dtype=np.int64)
    if full:
        out += np.add.reduce(bits[:full].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out


def segments(distance: int, count: int) -> list[tuple[int, int, int]]:
    """``count`` segments of the 64 bits as (lowest bit, width, radius): radii plus one add up to ``distance + 1``, so two
    fingerprints within ``distance`` are within the radius in one segment at least. The widest segments have the largest radius."""
    parts = min(count, distance + 1)
    widths = [64 // parts + (i < 64 % parts) for i in range(parts)]
    radii = [(distance + 1) // parts + (i < (distance + 1) % parts) - 1 for i in range(parts)]
    return [(sum(widths[:i]), w, r) for i, (w, r) in enumerate(zip(widths, radii, strict=True))]


def ball(width: int, radius: int) -> np.ndarray:
    """What to flip in ``width`` bits to reach everything within ``radius``, the centre not included."""
    return np.array([sum(1 << b for b in some) for r in range(1, radius + 1) for some in combinations(range(width), r)], np.uint64)


def segments_for(fingerprints: int, distance: int) -> list[tuple[int, int, int]]:
    """The number of segments that costs least with so many different fingerprints: each sends its probes, and meets what
    chance puts under them. The answer is the same with any."""

    def cost(count: int) -> float:
        plan = segments(distance, count)
        probes = [1 + len(ball(w, r)) / 2 for _, w, r in plan]
        return fingerprints * sum(p * (8 + fingerprints / 2.0**w) for p, (_, w, _) in zip(probes, plan, strict=True))

    return segments(distance, min(range(2 if distance else 1, distance + 2), key=cost))


def _probes(plan: list[tuple[int, int, int]]):  # noqa: ANN202
    """Each fingerprint as an entry of every segment's table, and as a probe of the entries around it. Of two values that lie
    within a radius the larger one probes, so a pair meets once a segment."""
    schema = pa.schema([("seg", pa.int8()), ("value", pa.int64()), ("probe", pa.bool_()), ("f", pa.int64())])
    balls = [ball(w, r) for _, w, r in plan]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy().view(np.uint64)
            step = max(1, (1 << 19) // max(1, *(len(b) for b in balls)))
            for lo in range(0, len(f), step):
                some = f[lo : lo + step]
                for seg, ((low, width, _), flips) in enumerate(zip(plan, balls, strict=True)):
                    own = some >> np.uint64(low) & np.uint64((1 << width) - 1)
                    near = own[:, None] ^ flips[None, :]
                    i, j = np.nonzero(near < own[:, None])
                    value = np.concatenate([own, near[i, j]]).astype(np.int64)
                    yield batch_of(schema, np.full(len(value), seg, np.int8), value, np.arange(len(value)) >= len(own), np.concatenate([some, some[i]]).view(np.int64))

    return run


def _linked(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= distance


def _clusters(f: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint the number of the first one that it hangs together with through links among ``f``."""
    label, left = np.arange(len(f)), np.arange(1, len(f))
    first, front = 0, np.zeros(1, np.int64)
    while len(left):
        if not len(front):
            first, left = left[0], left[1:]
            front = np.array([first])
            continue
        some, front = front[:256], front[256:]
        hit = _linked(f[some], f[left], distance).any(axis=0)
        label[left[hit]] = first
        front = np.concatenate([front, left[hit]])
        left = left[~hit]
    return label


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _verify(distance: int):  # noqa: ANN202
    """Rows come sorted by segment and value, entries before probes. The entries of one value (MOST at most) are held; probes
    pass in batches. Every pair's whole distance is looked at; an edge comes out for what is newly joined only."""

    def met(entries: np.ndarray, label: np.ndarray, probes: np.ndarray) -> pa.RecordBatch | None:
        step, out = max(1, _PAIRS // len(entries)), []
        for lo in range(0, len(probes), step):
            some = probes[lo : lo + step]
            i, j = np.nonzero(_linked(some, entries, distance))
            if len(i):
                each = np.unique(i * len(entries) + label[j])  # one edge to each cluster
                out.append((some[each // len(entries)], entries[each % len(entries)]))
        if not out:
            return None
        u, v = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
        return batch_of(_EDGES, u, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, entries, label, gathered = None, None, None, []
        for batch in batches:
            seg, value = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            probe, f = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy().view(np.uint64)
            if not len(f):
                continue
            group = np.concatenate([[0], np.cumsum((seg[1:] != seg[:-1]) | (value[1:] != value[:-1]))])
            first = np.flatnonzero(np.diff(group, prepend=-1))
            some = (np.diff(first, append=len(f)) > 1) & ~probe[first]  # the others have nobody to meet
            some[[0, -1]] = True  # these may go on in another batch
            seg, value, probe, f, group = (x[some[group]] for x in (seg, value, probe, f, group))
            cuts = np.flatnonzero((group[1:] != group[:-1]) | (probe[1:] != probe[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(f)], strict=True):
                key = (seg[lo], value[lo])
                if key != at:
                    if gathered and (alone := _spanning(gathered, distance)) is not None:
                        yield alone
                    at, entries, gathered = key, None, []
                if not probe[lo]:
                    gathered.append(f[lo:hi])
                elif gathered or entries is not None:
                    if entries is None:
                        entries = np.concatenate(gathered)
                        label = _clusters(entries, distance)
                        if (alone := _spanning(gathered, distance, label)) is not None:
                            yield alone
                        gathered = []
                    if (found := met(entries, label, f[lo:hi])) is not None:
                        yield found
        if gathered and (alone := _spanning(gathered, distance)) is not None:
            yield alone

    return run


def _spanning(gathered: list[np.ndarray], distance: int, label: np.ndarray | None = None) -> pa.RecordBatch | None:
    """An edge from each entry to the first of its cluster."""
    entries = gathered[0] if len(gathered) == 1 else np.concatenate(gathered)
    if len(entries) < 2:
        return None
    label = _clusters(entries, distance) if label is None else label
    other = np.flatnonzero(label != np.arange(len(entries)))
    return batch_of(_EDGES, entries[other].view(np.int64), entries[label[other]].view(np.int64)) if len(other) else None


def _points(distance: int):  # noqa: ANN202
    """All points within half the distance of each fingerprint; where the distance is odd, the larger half for probes."""
    schema = pa.schema([("point", pa.int64()), ("probe", pa.bool_()), ("f", pa.int64())])
    near = np.concatenate([np.zeros(1, np.uint64), ball(64, distance // 2)])
    wide = np.concatenate([np.zeros(1, np.uint64), ball(64, distance - distance // 2)]) if distance % 2 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy().view(np.uint64)
            for flips, probe in ((near, False), (wide, True)):
                step = 1 if flips is None else max(1, (1 << 17) // len(flips))
                for lo in range(0, len(f) if flips is not None else 0, step):
                    some = f[lo : lo + step]
                    points = (some[:, None] ^ flips[None, :]).ravel().view(np.int64)
                    yield batch_of(schema, points, np.full(len(points), probe), np.repeat(some, len(flips)).view(np.int64))

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by point, those without ``probe`` first: whatever is near one point hangs together with the first."""
    at, last, fits = None, 0, False
    for batch in batches:
        point, f = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        probe = batch.column(1).to_numpy(zero_copy_only=False)
        if not len(point):
            continue
        new = np.concatenate([[point[0] != at], point[1:] != point[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(point)), -1))
        head = np.where(start >= 0, f[start], last)
        ok = np.where(start >= 0, ~probe[start], fits)  # a point that only probes reach joins nothing
        at, last, fits = point[-1], head[-1], ok[-1]
        ok &= head != f
        pairs = np.unique(np.stack([f[ok], head[ok]]), axis=1)
        yield batch_of(_EDGES, pairs[0], pairs[1])


def hamming_edges(fingerprints: DataFrame, distance: int = DISTANCE, most: int = MOST, count: int | None = None, plan: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """Edges ``u``, ``v`` that hang together whatever of the distinct longs of the one column ``f`` is linked: within
    ``distance`` bits, directly or through others. Every edge is a link or leads to one through the same fingerprints; pairs are
    never written out.

    Fingerprints are cut into segments; each is an entry in every segment's table and probes the entries within the
    segment's radius. An entry value that more than ``most`` fingerprints share is hot: they and all that probe it meet
    in points instead, as two fingerprints are within the distance if and only if balls of half of it around them
    share a point. That costs a fixed number of rows for each, however many lie close together.
    """
    spark = fingerprints.sparkSession
    plan = plan or segments_for(fingerprints.count() if count is None else count, distance)
    scratch = Scratch(spark, "hamming")
    probes = fingerprints.select("f").mapInArrow(_probes(plan), "seg byte, value long, probe boolean, f long")
    whole = [F.shiftrightunsigned("f", low).bitwiseAND((1 << w) - 1 if w < 64 else -1) for low, w, _ in plan]
    sizes = fingerprints.select("f", F.posexplode(F.array(*whole)).alias("seg", "value")).groupBy("seg", "value").count()
    hot = scratch.put("hot", sizes.filter(F.col("count") > most).select(F.col("seg").cast("byte").alias("seg"), "value"))
    any_hot = not hot.isEmpty()
    seats = (probes.join(hot, ["seg", "value"], "left_anti") if any_hot else probes).select("seg", "value", "probe", "f")
    seats = seats.repartition(2 * partitions(spark), "seg", "value").sortWithinPartitions("seg", "value", "probe")
    edges = seats.mapInArrow(_verify(distance), "u long, v long")
    if any_hot:
        crowd = probes.join(hot, ["seg", "value"], "left_semi").select("f").distinct()
        points = crowd.mapInArrow(_points(distance), "point long, probe boolean, f long")
        points = points.repartition(4 * partitions(spark), "point").sortWithinPartitions("point", "probe", "f")
        edges = edges.union(points.mapInArrow(_meet, "u long, v long"))
    return edges


def _fingerprints(k: int):  # noqa: ANN202
    schema = pa.schema([("doc_id", pa.int64()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks([batch]):
                buf, at = text_buffer(part.column(1))
                found = np.array([fingerprint(buf[lo:hi].tobytes(), k) for lo, hi in zip(at, at[1:], strict=False)], np.uint64)
                yield batch_of(schema, part.column(0), found.view(np.int64))

    return run


def simhash(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` for every row: fingerprints link at ``distance``
    or fewer differing bits; a component is named by its smallest id.

    Whole texts are fingerprinted in one scan and only ids and fingerprints are kept. Equal fingerprints become one row,
    so copies cost nothing further; ``hamming_edges`` joins the rest and connected components name them.

    Null texts, empty ones and those without words have fingerprint zero and are linked like any other. Texts of fewer
    than ``k`` words have their whole sequence as the only shingle. Rows repeated with the same id are one document's. Ids
    are cast to long (null where they are no numbers); a null id is the smallest and comes back as null. An empty table
    gives no rows. Other columns are left out, so their names cannot clash.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    rows = df.select(F.coalesce(F.col(id_col).try_cast("long"), F.lit(_NO_ID)).alias("doc_id"), text_or_empty(text_col).alias("text"))
    signed = scratch.put("signed", rows.mapInArrow(_fingerprints(k), "doc_id long, f long"))
    classes = scratch.put("classes", signed.groupBy("f").agg(F.min("doc_id").alias("head")))
    edges = scratch.put("edges", hamming_edges(classes.select("f"), distance, most).distinct())
    parts = connected_components(edges)
    joined = parts.join(classes, F.col("node") == F.col("f")).select("component", "f", "head")
    least = joined.groupBy("component").agg(F.min("head").alias("least"))
    named = joined.join(least, "component").select(F.col("f").alias("of"), "least")
    named = classes.join(named, F.col("f") == F.col("of"), "left").select(F.col("f").alias("of"), F.coalesce("least", "head").alias("least"))
    out = signed.join(named, F.col("f") == F.col("of"))
    own = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return out.select(own("doc_id").alias("doc_id"), F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), own("least").alias("component_id"))
