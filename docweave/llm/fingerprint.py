"""Document fingerprints by content-defined chunking."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import BLOCK_BYTES, blocks, input_bytes, partitions, text_buffer, text_or_empty, word_hashes

#: Bytes of UTF-8. The gear hash sees WINDOW bytes; LEAST may not be smaller, so that no hash reaches before its text.
WINDOW, LEAST, NORMAL, MOST = 32, 32, 64, 256
#: Bits that must be zero at a boundary: more of them before NORMAL bytes, fewer after (normalised chunking).
HARD_BITS, EASY_BITS = 7, 5
_GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4, person=b"gear").digest(), "little") for b in range(256)], np.uint32)


def gear(buf: np.ndarray) -> np.ndarray:
    """The gear hash (h << 1) + G[byte] after each byte, over a window of 32 bytes, by doubling the window."""
    h = _GEAR[buf]
    step = 1
    while step < WINDOW:
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
        step *= 2
    return h


def chunk_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all chunks of all texts, and for each text the number of chunks before it (n + 1 values)."""
    top = gear(buf)
    easy_at = np.flatnonzero(top >> np.uint32(32 - EASY_BITS) == 0) + 1
    hard_at = easy_at[top[easy_at - 1] >> np.uint32(32 - HARD_BITS) == 0]
    easy, hard = [*easy_at.tolist(), 1 << 62], [*hard_at.tolist(), 1 << 62]
    starts, counts, ends = [], [0], []
    bounds = offsets.tolist()
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        while lo < hi:
            cut = hard[bisect_left(hard, lo + LEAST)]
            if cut >= lo + NORMAL:
                cut = min(easy[bisect_left(easy, lo + NORMAL)], lo + MOST)
            cut = min(cut, hi)
            starts.append(lo)
            ends.append(cut)
            lo = cut
        counts.append(len(starts))
    return np.array(starts, np.int64), np.array(ends, np.int64), np.array(counts, np.int64)


def chunk_sets(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text the sorted distinct chunks, each a 40-bit digest and in the low byte its length less one."""
    starts, ends, counts = chunk_bounds(buf, offsets)
    entry = (word_hashes(buf, starts, ends, seed=2) & np.uint64((1 << 48) - 256)) | (ends - starts - 1).astype(np.uint64)
    return [np.unique(entry[a:b]) for a, b in zip(counts, counts[1:], strict=False)]


def to_string(chunks: np.ndarray) -> str:
    """Twelve hex digits for each chunk: ten of its digest, two of its length less one."""
    return chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def from_string(text: str) -> np.ndarray:
    raw = np.zeros((len(text) // 12, 8), np.uint8)
    raw[:, 2:] = np.frombuffer(bytes.fromhex(text), np.uint8).reshape(-1, 6)
    return raw.reshape(-1).view(">u8").astype(np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The part of ``a``, weighted by chunk length, that ``b`` has too. Two empty sets are alike (1), an empty one and
    any other are not (0)."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    weight = (a & np.uint64(255)).astype(np.int64) + 1
    return float(weight[np.isin(a, b, assume_unique=True)].sum() / weight.sum())


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks([batch]):
            prints = [to_string(c) for c in chunk_sets(*text_buffer(block.column(block.schema.get_field_index("text"))))]
            yield pa.RecordBatch.from_arrays([block.column(block.schema.get_field_index("doc_id")), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every whole text, one row per input row and no shuffle.

    Boundaries depend on the 32 bytes before them only, so an insertion changes the chunks around it and no others.
    Equal texts have equal fingerprints; an empty or null text has the empty string. Other columns are not read.
    """
    return df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(_print, f"doc_id {dict(df.dtypes)[id_col]}, fingerprint string")


_NO_ID = -(1 << 63)
#: Ranges of ids, whatever the input: their bounds go to the driver and with every task.
MOST_RANGES = 1 << 15


def _with_next(pending: list[tuple], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """From rows by bucket and descending id: each own row with the text after it."""
    last = None
    for batch in batches:
        for bucket, own, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if last and last[0] == bucket:
                yield last[1], last[2], text
                last = None
            if own:
                last = (bucket, doc_id, text)
    if last:  # a bucket always ends with a row that isn't its own
        raise ValueError(f"no document after {last[1]}")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def flush(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        texts = [t.encode() for _, t, _ in rows]
        cut = [len(t) - len(t) // 2 for _, t, _ in rows]
        new = [(t[:c] + n[: len(t) - c]).encode() for (_, t, n), c in zip(rows, cut, strict=True)]
        after = [n.encode() for _, _, n in rows]
        every = [*texts, *new, after[-1]]  # rows follow each other: the next text is mostly the next row's own
        buf = np.frombuffer(b"".join(every), np.uint8)
        sets = chunk_sets(buf, np.concatenate([[0], np.cumsum([len(x) for x in every])]))
        n = len(rows)
        nxt = [sets[i + 1] if i + 1 < n and rows[i][2] == rows[i + 1][1] else sets[-1] if i + 1 == n else chunk_sets(np.frombuffer(after[i], np.uint8), np.array([0, len(after[i])]))[0] for i in range(n)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None if r[0] == _NO_ID else r[0] for r in rows], pa.int64()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in new]),
                pa.array([to_string(x) for x in sets[:n]]),
                pa.array([to_string(x) for x in sets[n : 2 * n]]),
                pa.array([containment(a, b) for a, b in zip(sets[:n], sets[n : 2 * n], strict=True)], pa.float64()),
                pa.array([containment(a, b) for a, b in zip(sets[:n], nxt, strict=True)], pa.float64()),
            ],
            schema=schema,
        )

    rows, size = [], 0
    for row in _with_next([], batches):
        rows.append(row)
        size += len(row[1]) * 2
        if size >= BLOCK_BYTES:
            yield flush(rows)
            rows, size = [], 0
    if rows:
        yield flush(rows)


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 8 << 20) -> DataFrame:
    """How the fingerprint bears an edit: every document against itself with its last floor(n_chars / 2) code points
    replaced by the first as many of the next document (by descending id; the first follows the last), and against
    that next document.

    Ids are cut into ranges of about ``bucket_bytes`` of text, MOST_RANGES at most (rows of a range pass by one after the other,
    so a longer range takes no more memory); the text is shuffled once, to its range, and the
    largest id of each range also goes to the range above it, so that every row finds its successor without a
    global sort in one task. Ids should be distinct; rows that share one follow each other by text. A null id
    counts as the smallest. Null texts are empty; one document is its own successor; an empty table gives no rows.
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), text_or_empty(text_col).alias("text"))
    n = int(min(max(4 * partitions(spark), input_bytes(df, text_col) // bucket_bytes, 1), MOST_RANGES))
    cuts = sorted({int(x) for x in rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)}) if n > 1 else []
    cuts_arr = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def bucket_of(ids):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(np.searchsorted(cuts_arr, ids.to_numpy(), side="left").astype(np.int32))

    tops = {r.bucket: r.top for r in rows.select("doc_id").withColumn("bucket", bucket_of("doc_id")).groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}  # as many rows as cuts
    order = sorted(tops)
    above = {tops[b]: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    last = np.array(sorted(above), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for own, at, to in ((True, np.arange(len(ids)), np.searchsorted(cuts_arr, ids, side="left")), (False, at := np.flatnonzero(np.isin(ids, last)), [above[int(i)] for i in ids[at]])):
                if len(at):
                    taken = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([own] * len(at)), taken.column(0), taken.column(1)], names=["bucket", "own", "doc_id", "text"])

    dealt = rows.mapInArrow(deal, "bucket int, own boolean, doc_id long, text string").repartition(max(partitions(spark), n // 4), "bucket")
    dealt = dealt.sortWithinPartitions("bucket", F.desc("own"), F.desc("doc_id"), "text")
    return dealt.mapInArrow(_edited, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
