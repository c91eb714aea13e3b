"""Exact dedup by progressive refinement: length, then a hash of the prefix, then the hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import text_or_empty

PREFIX_CHARS = 256
#: Lengths, and prefixes, that occur twice are told in so many cells, whatever the input.
CELLS = 1 << 20


def _repeated(rows: DataFrame, *keys: str) -> Column:
    """Whether a row's keys may occur in another row too: a look into a table of bounded size. Keys that are alone may fall
    in another's cell, which costs a hash and changes nothing."""
    cell = lambda: F.pmod(F.xxhash64(*keys), F.lit(CELLS)).cast("int")
    table = bytearray(CELLS)
    twice = rows.groupBy(*keys).count().filter("count > 1").select(cell().alias("cell")).distinct()
    for i in twice.toArrow()["cell"].to_pylist():
        table[i] = 1
    return F.substring(F.lit(table), cell() + 1, F.lit(1)) == F.lit(bytearray(b"\x01"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest_all: bool = False) -> DataFrame:
    """One row per input row: the id, ``keep_id`` (the largest id among rows of equal text), ``group_size``, ``kept``
    and ``full_hash``.

    1. Rows are counted by byte length; one whose length no other row has is alone.
    2. Of the others the hash of their first characters is counted along with the length; one that is alone there is alone.
    3. Only what is left has its whole text hashed (``digest_all`` hashes the others too, for callers that want the
       digest of every row). Copies meet in an aggregate that combines before the shuffle; a group of any size is a
       single row there, and the join back can be split by adaptive execution.

    Each step reads the table again and shuffles numbers only: no text ever leaves its scan.

    Null texts equal empty ones. A null id is smaller than any other; a group of null ids only has a null
    ``keep_id`` and each of its rows is kept. Rows repeated with the same id are all kept if that id is the
    largest. Very long texts are hashed whole. An empty table gives no rows; other columns are left out, so their names
    cannot clash.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("n_bytes", F.octet_length("text"))
    by_length = _repeated(rows, "n_bytes")
    prefixed = rows.withColumn("prefix", F.xxhash64(F.substring("text", 1, prefix_chars)))
    by_prefix = by_length & _repeated(prefixed.filter(by_length), "n_bytes", "prefix")
    digest = F.sha2(F.col("text"), 256)
    hashed = prefixed.select("doc_id", by_prefix.alias("shared"), (digest if digest_all else F.when(by_prefix, digest)).alias("full_hash"))
    groups = hashed.filter("shared").groupBy("full_hash").agg(F.max("doc_id").alias("top_id"), F.count("*").alias("copies")).filter("copies > 1")
    out = hashed.join(groups, "full_hash", "left")
    alone = F.col("copies").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("top_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "full_hash"
    )
