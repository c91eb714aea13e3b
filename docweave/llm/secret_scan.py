"""Secret scans over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import blocks, shared_dir, text_or_empty

#: Changes with any rule; the ledger keeps a blob's findings by this version.
RULE_VERSION = 3
# The contract's base kinds first, in its order, then the kinds that this operator adds.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "jwt", "url")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = re.compile("passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
# The added kinds have no bounds. Each can begin at the start of a run of its signs only and gives no sign of it back, so that
# runs of any length take linear time.
PEM = re.compile(r"-----BEGIN (?=([A-Z ]*+))\1(?<=PRIVATE KEY)-----")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")
URL = re.compile(r"(?<![a-z0-9+.-])[0-9+.-]*+([a-z][a-z0-9+.-]++)://[^\s/:@]++:[^\s/:@]{3,}+@")
ASSIGN_LEAST = 12

FINDING = "array<struct<start:int,kind_no:int,kind:string,end:int>>"
_OUT = pa.schema([("blob", pa.string()), ("found", pa.list_(pa.struct([("start", pa.int32()), ("kind_no", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])))])


def find_secrets(text: str) -> list[tuple[int, int, str, int]]:
    """All spans of one text as (start, kind number, kind, end) in code points, by start and kind. Within a kind
    matches are leftmost and do not overlap; an assignment whose value is too short is dropped but still consumes
    its text. The bounded repeats of the other kinds match just the long runs, as dropping short runs would."""
    out: list[tuple[int, int, str, int]] = []
    if ASSIGN_WORDS.search(text):
        out += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    if "-----BEGIN " in text:
        out += [(m.start(), 3, "pem", m.end()) for m in PEM.finditer(text)]
    if "eyJ" in text:
        out += [(m.start(), 4, "jwt", m.end()) for m in JWT.finditer(text)]
    if "://" in text:
        out += [(m.start(1), 5, "url", m.end()) for m in URL.finditer(text)]
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = _OUT.field("found").type
    for batch in blocks(batches):
        texts = batch.column(batch.schema.get_field_index("text"))
        found = [[{"start": s, "kind_no": k, "kind": name, "end": e} for s, k, name, e in find_secrets(t.as_py() or "")] for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("blob")), pa.array(found, kind)], schema=_OUT)


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows (blob, rule_version, found); none if nothing has been written yet."""
    from pyspark.errors import AnalysisException

    schema = f"blob string, rule_version int, found {FINDING}"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan_secrets(versions: DataFrame, ledger_path: str | None = None, path_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """Findings for every row of ``versions`` (each historical version of each path): ``path_cols``, ``blob`` (SHA-256
    of the text) and ``found``.

    Rows are content-addressed; one row per blob is picked by its smallest path, and only blobs that the ledger does
    not hold for this rule version are scanned and appended to it. Findings are then joined back to all paths. A
    text that occurs at many paths is scanned once, and a second run over the same history scans nothing. An
    append that was lost halfway leaves no committed files, so running again is safe; a blob that two runs append
    counts once.

    Null texts are empty; paths may hold nulls and repeat. An empty table gives no rows. Columns other than those
    named are not read.
    """
    spark = versions.sparkSession
    ledger_path = ledger_path or shared_dir(spark, "secret-ledger")
    keys = [f"path_{i}" for i in range(len(path_cols))]
    rows = versions.select(*[F.col(c).alias(k) for c, k in zip(path_cols, keys, strict=True)], text_or_empty(text_col).alias("text")).withColumn("blob", F.sha2("text", 256))
    paths = rows.select(*keys, "blob")
    one = paths.groupBy("blob").agg(F.min(F.struct(*keys)).alias("rep"))
    known = open_ledger(spark, ledger_path).filter(F.col("rule_version") == rule_version).select("blob").distinct()
    unseen = one.join(known, "blob", "left_anti").select(F.col("blob").alias("rep_blob"), *[F.col(f"rep.{k}").alias(f"rep_{k}") for k in keys])
    on = F.col("blob") == F.col("rep_blob")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"rep_{k}"))
    todo = rows.join(unseen, on, "inner").select("blob", "text")
    scanned = todo.mapInArrow(_scan, f"blob string, found {FINDING}")
    scanned.select("blob", F.lit(rule_version).cast("int").alias("rule_version"), "found").write.mode("append").parquet(ledger_path)
    known = open_ledger(spark, ledger_path).filter((F.col("rule_version") == rule_version) & (F.size("found") > 0)).dropDuplicates(["blob"]).select("blob", "found")
    out = paths.join(known, "blob", "left")
    return out.select(*[F.col(k).alias(c) for c, k in zip(path_cols, keys, strict=True)], "blob", F.coalesce("found", F.from_json(F.lit("[]"), FINDING)).alias("found"))
