"""Streams: documents to chunks, sliding limits, windows over events, and the state of processing jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docweave.functions import text as fx
from docweave.operators import splitting


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    """A table as a stream of its files (a glob, for the source takes folders and globs only)."""
    path = f"{sf_dir}/{name}.parque[t]"
    shape = spark.read.parquet(path).schema if schema is None else schema
    return spark.readStream.schema(shape).parquet(path)


def chunk_stream(docs: DataFrame) -> DataFrame:
    """Documents of a stream as chunks with stable ids; refused ones (without text) leave an empty list of chunks."""
    pieces = splitting.pack(fx.sentences(F.coalesce("text", F.lit("")), fx.PACKER_ENDS), glue=" ")
    c = docs.select("doc_id", "source", F.posexplode_outer(pieces).alias("chunk_index", "content"))
    return c.withColumn("chunk_id", fx.vector_id(F.lit(0), F.col("doc_id"), F.lit(None), F.col("chunk_index"), F.coalesce("content", F.lit(""))))


def ingest(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's chunks under its batch id: a batch that runs again replaces itself, so no chunk is there
    twice. Ends when what there is has been read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return chunk_stream(docs).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failures_per_minute(events: DataFrame, key: str = "user_id", at: str = "ts") -> DataFrame:
    """Failures of each key in sliding minutes, late ones up to ten minutes."""
    e = events.withColumn("at", F.col(at).cast("timestamp")).filter("event_type = 'error'").withWatermark("at", "10 minutes")
    w = e.groupBy(key, F.window("at", "60 seconds", "30 seconds").alias("w")).agg(F.count("*").alias("failures"))
    return w.select(key, F.col("w.start").alias("start"), "failures", (F.col("failures") >= 5).alias("blocked"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    s = e.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")


JOB_STATE = "failures int, status string, next_run_at double"
JOB_OUT = "job_id long, failures int, status string, next_run_at double"


def job_states(events: DataFrame, most: int = 5, base: float = 5.0, cap: float = 300.0) -> DataFrame:
    """The state of each job after each micro-batch of its events (job_id, at seconds, failed): failures in a row, retry
    with exponential delay, dead after ``most``. A dead job stays dead."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, status, due = state.get if state.exists else (0, "pending", 0.0)
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        for at, failed in zip(rows["at"], rows["failed"], strict=True):
            if status == "dead":
                break
            if failed:
                failures += 1
                status, due = ("dead", 0.0) if failures >= most else ("retry", at + min(base * 2 ** (failures - 1), cap))
            else:
                failures, status, due = 0, "done", 0.0
        state.update((failures, status, due))
        yield pd.DataFrame({"job_id": [key[0]], "failures": [failures], "status": [status], "next_run_at": [due]})

    return events.groupBy("job_id").applyInPandasWithState(step, JOB_OUT, JOB_STATE, "update", GroupStateTimeout.NoTimeout)


def to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what there is into a table in memory; for small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
