"""Substring dedup: words covered by passages that occur earlier are removed, behind a count-min prefilter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import blocks, input_bytes, partitions, row_key, text_buffer, text_or_empty, word_bounds, word_hashes
from docweave.llm.sketch import count_min

WINDOW = 20
#: Bytes of text that are searched at a time.
BLOCK = 8 << 20
#: About so many windows meet in one bucket of the exact pass.
BUCKET_WINDOWS = 400_000
#: Bytes of a word and the space after it, for sizing only.
WORD_BYTES = 6
_NO_ID = -(1 << 63)
_Q1, _Q2 = 0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03 | 1


def _powers(hashes: np.ndarray, window: int, q: int) -> np.ndarray:
    """The polynomial of every run of ``window`` hashes (mod 2 ** 64), from those of runs of powers of two."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run, size, out, done = hashes, 1, None, 0
    while True:
        if window & size:
            piece = run[done : done + n]
            out = piece if out is None else out * np.uint64(pow(q, size, 1 << 64)) + piece
            done += size
        size *= 2
        if size > window:
            return out if out is not hashes else out.copy()
        half = size // 2
        run = run[:-half] * np.uint64(pow(q, half, 1 << 64)) + run[half:]


def windows(texts: pa.Array, window: int, second: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Of all windows within one text: first hash (64 bits), second hash (32 bits), row and first word's number."""
    buf, offsets = text_buffer(texts)
    starts, ends, upto = word_bounds(buf, offsets)
    hashes = word_hashes(buf, starts, ends, seed=3)
    counts = np.maximum(np.diff(upto) - window + 1, 0)
    row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    pos = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
    at = upto[:-1][row] + pos
    one = _powers(hashes, window, _Q1)[at] if len(at) else np.zeros(0, np.uint64)
    two = (_powers(hashes, window, _Q2)[at] >> np.uint64(32)).astype(np.uint32) if second and len(at) else np.zeros(0, np.uint32)
    return one, two, row, pos


_COLS = "bucket int, payload binary, doc_id long, key long, starts binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("key", pa.int64()), ("starts", pa.binary())])


def _later(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, key: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first occurrence or not, the order by hash): entries must come in order of (doc, key, pos)."""
    order = np.lexsort((h2, h1))
    a, b, d, k, p = h1[order], h2[order], doc[order], key[order], pos[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    first = (d == d[head]) & (k == k[head]) & (p == p[head])  # a row repeated with its id and text is no earlier than itself
    return first, order


def _by_doc(doc: np.ndarray, key: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.lexsort((pos, key, doc))
    doc, key, pos = doc[order], key[order], pos[order]
    cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]), [True]]))
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(doc[a]), int(key[a]), pos[a:b].astype(np.int32).tobytes()


def _candidates(sketch: Broadcast, window: int, bucket_bits: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks([batch], limit=BLOCK):
                block = block.take(pc.sort_indices(block, sort_keys=[("doc_id", "ascending"), ("key", "ascending")]))
                ids, keys = block.column(0).to_numpy(), block.column(2).to_numpy()
                h1, h2, row, pos = windows(block.column(1), window, True)
                maybe = np.flatnonzero(sketch.value.levels(h1))
                if not len(maybe):
                    continue
                h1, h2, doc, key, pos = h1[maybe], h2[maybe], ids[row[maybe]], keys[row[maybe]], pos[maybe]
                first, order = _later(h1, h2, doc, key, pos)
                rows = [((d ^ k) & (1 << bucket_bits) - 1, None, d, k, s) for d, k, s in _by_doc(*(x[order[~first]] for x in (doc, key, pos)))] if not first.all() else []
                heads = order[first]
                bucket = (h1[heads] >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(heads), np.int64)
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                for a, b in zip(cuts, cuts[1:], strict=False):
                    w = heads[a:b]
                    where = pa.compress(doc[w].tobytes() + key[w].tobytes() + pos[w].tobytes(), "zstd", asbytes=True)
                    rows.append((int(bucket[a]), len(w).to_bytes(4, "little") + h1[w].tobytes() + h2[w].tobytes() + where, None, None, None))
                for lo in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[lo : lo + 4096], strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket. A window is in a bucket once for each block at most, so no window's popularity makes
    a bucket large."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("starts", pa.binary())])
    at, held = None, []

    def done() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        parts = []
        for raw in held:
            n = int.from_bytes(raw[:4], "little")
            where = pa.decompress(raw[4 + 12 * n :], 20 * n, "zstd", asbytes=True)
            parts.append((np.frombuffer(raw, np.uint64, n, 4), np.frombuffer(raw, np.uint32, n, 4 + 8 * n), np.frombuffer(where, np.int64, n), np.frombuffer(where, np.int64, n, 8 * n), np.frombuffer(where, np.int32, n, 16 * n)))
        h1, h2, doc, key, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        start = np.lexsort((pos, key, doc))
        h1, h2, doc, key, pos = h1[start], h2[start], doc[start], key[start], pos[start]
        first, order = _later(h1, h2, doc, key, pos)
        rows = list(_by_doc(*(x[order[~first]] for x in (doc, key, pos)))) if not first.all() else []
        for lo in range(0, len(rows), 8192):
            d, k, s = zip(*rows[lo : lo + 8192], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int64()), pa.array(s, pa.binary())], schema=schema)

    for batch in batches:
        decided = batch.filter(pc.is_valid(batch.column(2)))
        if decided.num_rows:
            yield pa.RecordBatch.from_arrays([decided.column(2), decided.column(3), decided.column(4)], schema=schema)
        for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if raw is None:
                continue
            if bucket != at:
                yield from done()
                at, held = bucket, []
            held.append(raw)
    yield from done()


def _keep(window: int):  # noqa: ANN202
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks([batch]):
                out = []
                for doc_id, text, found in zip(*(block.column(i).to_pylist() for i in range(3)), strict=True):
                    words = text.encode().split()  # splits at the contract's six bytes
                    edge = np.zeros(len(words) + window + 1, np.int32)
                    for raw in found or ():
                        starts = np.frombuffer(raw, np.int32)
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + window, -1)
                    gone = np.cumsum(edge)[: len(words)] > 0
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
                    out.append((None if doc_id == _NO_ID else doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_text`` of every row: each word that a window of ``window`` words
    covers is removed if the window's words also start earlier (smaller id, or same document and earlier word). Windows are
    judged on the input.

    A first pass counts all windows in a count-min sketch whose estimates are never too low; the second sends only
    windows estimated to occur twice or more to an exact grouping by 96-bit hashes. Each block of text sends a window
    once, as its first occurrence there (later ones in the block are decided on the spot), so a passage that a third
    of all documents share is no larger in its bucket than any other. The sketch's size is bounded; beyond its
    capacity more windows go to the exact pass, none are lost.

    Null texts have no words. A null id comes before all others. Rows repeated with the same id and text are one document:
    none is earlier than the other. Different texts of one id (null too) are documents of their own, in the order of a
    hash of the text. Texts shorter than a window lose nothing. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), text_or_empty(text_col).alias("text"))
    key = row_key(rows)
    rows = rows.withColumn("key", F.lit(0).cast("long") if key is None else key)
    expected = input_bytes(df, text_col) // WORD_BYTES

    def items_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for block in blocks([batch], limit=BLOCK):
            yield windows(block.column(1), window, False)[0]

    sketch = count_min(rows, items_of, expected)
    bucket_bits = min(30, max(4, int(expected // BUCKET_WINDOWS).bit_length()))
    found = rows.mapInArrow(_candidates(sketch, window, bucket_bits), _COLS)
    found = found.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_exact, "doc_id long, key long, starts binary")
    found = found.groupBy(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).agg(F.collect_list("starts").alias("found"))
    met = rows.join(found, (F.col("doc_id") == F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left").select("doc_id", "text", "found")
    return met.mapInArrow(_keep(window), "doc_id long, n_words long, n_removed long, kept_text string")
