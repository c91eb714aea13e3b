"""What several operators share: the shared folder, Arrow batches in bounded blocks, and vectorised word hashes."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than these.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that a Python worker takes at a time; one longer text is a block of its own.
BLOCK_BYTES = 4 << 20
_LONG_WORD = 256


#: By application: the folder that stands in for the shared one on a local master.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that driver and executors share: spark.checkpoint.dir. Where that is unset a
    temporary folder of this machine serves a local master (tests); any other master is refused, as its executors would
    write to disks that nobody else reads."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='docweave-')}")
    return f"{base.rstrip('/')}/docweave/{name}-{uuid.uuid4().hex}"


#: Spark's own setting: the shuffle files of a write go when it has ended, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """The tables that one call of an operator keeps between its steps: each a cut in the lineage, in a folder of its own
    in the shared one, that outlives any executor. Those that no later step reads are to be dropped."""

    made: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, shared_dir(spark, name)
        self.made.append(self.path)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Writes ``df`` and reads it again."""
        path, before = f"{self.path}/{name}", self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.path}/{name}")


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """For results that are written before its end: the folders of scratch tables that were made inside are deleted."""
    before = len(Scratch.made)
    try:
        yield
    finally:
        for path in Scratch.made[before:]:
            delete(spark, path)
        del Scratch.made[before:]


def delete(spark: SparkSession, path: str) -> None:
    """Removes a path of any file system that Spark knows; one that is not there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by as many signs as it takes to be no column of ``df`` (Spark tells names apart regardless of case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def with_text(df: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """``df`` with its text as strings for a task, and that column's name: the column itself where it is of strings (nulls are
    the task's to take as empty), so that no text goes to a worker twice; else one more, the last."""
    if dict(df.dtypes).get(text_col) == "string":
        return df, text_col
    name = free_name(df, "__text")
    return df.withColumn(name, text_or_empty(text_col)), name


#: Ids are told to be shared by different texts in so many cells.
_ID_CELLS = 1 << 16


def row_key(rows: DataFrame) -> Column | None:
    """What tells rows (doc_id, text; neither null) of one id apart: the hash of the text where the id may be shared by
    different texts, else 0, which costs next to nothing where it is written many times. Equal rows have equal keys. The
    ids are looked up in a table of bounded size; an id that falls in another's cell is only keyed without need. None
    if the id alone tells all texts apart."""
    if rows.groupBy("doc_id").count().filter("count > 1").isEmpty():  # reads no texts
        return None
    cell, told = F.pmod(F.xxhash64("doc_id"), F.lit(_ID_CELLS)).cast("int"), F.xxhash64("text")
    each = rows.groupBy("doc_id").agg(F.min(told).alias("lo"), F.max(told).alias("hi"))
    found = each.filter("lo <> hi").select(cell.alias("cell")).distinct().toArrow()["cell"].to_pylist()
    if not found:
        return None
    table = bytearray(_ID_CELLS)
    for i in found:
        table[i] = 1
    return F.when(F.substring(F.lit(table), cell + 1, F.lit(1)) == F.lit(bytearray(b"\x01")), told).otherwise(0).cast("long")


def input_bytes(df: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts, counted over every row. Sizes sketches and partition counts."""
    return int(df.agg(F.sum(F.octet_length(F.col(text_col))).alias("b")).first().b or 0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(batches: Iterator[pa.RecordBatch], text_col: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of text, so that work arrays stay small."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text_col)))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the n + 1 offsets of the texts in them. Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if offs is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the number of words before it (n + 1 values)."""
    if len(buf) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[buf]
    first = np.empty(len(buf), bool)
    first[0] = True
    first[1:] = ~solid[:-1]
    inner = offsets[:-1]
    first[inner[inner < len(buf)]] = True
    starts = np.flatnonzero(solid & first)
    last = np.empty(len(buf), bool)
    last[-1] = True
    last[:-1] = first[1:] | ~solid[1:]
    ends = np.flatnonzero(solid & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (xor-shift and odd multipliers)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words, eight bytes a step; words of over 256 bytes go through BLAKE2b."""
    n = ends - starts
    key = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1))
    out = mix(n.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + key)
    if len(starts) == 0:
        return out
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    view = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    masks = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
    todo, at = np.flatnonzero(n <= _LONG_WORD), 0
    while len(todo):
        lane = view[starts[todo] + at] & masks[np.minimum(n[todo] - at, 8)]
        out[todo] = mix(out[todo] ^ (lane * np.uint64(0xE7037ED1A0B428DB) + np.uint64(at)))
        at += 8
        todo = todo[n[todo] > at]
    for i in np.flatnonzero(n > _LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return out


#: What operators keep in a Python worker between tasks, by operator.
_KEPT: dict[str, dict] = {}


def kept_in_worker(operator: str) -> dict:
    """A worker's own store of an operator, until a task of another one makes room."""
    return _KEPT.setdefault(operator, {})


def make_room(operator: str) -> None:
    """Called at a task's begin: Spark uses one worker for the tasks of all operators, so what the others have left there would
    stand beside what this one needs. It is freed and given back to the system."""
    left = [k for k, v in _KEPT.items() if k != operator and v]
    for k in left:
        _KEPT[k].clear()
    if left:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c for c, f in zip(columns, schema, strict=True)], schema=schema)
