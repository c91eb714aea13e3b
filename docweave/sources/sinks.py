"""Writers: versioned index, reports, event frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_version(chunks: DataFrame, base: str, version: int, partition: str = "knowledge_base_id") -> str:
    """A new version of the index beside the others, by knowledge base. Readers do not see it yet."""
    path = f"{base.rstrip('/')}/v={version}"
    chunks.write.mode("errorifexists").partitionBy(partition).parquet(path)
    return path


def publish(spark: SparkSession, at: str, value: str) -> int:
    """Adds the next change of a pointer. Each change is a folder of its own that may not be there yet: of two writers that
    saw the same last change one fails, and no reader ever finds half a pointer."""
    n = max([0, *(c for c, _ in changes(spark, at))]) + 1
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("errorifexists").parquet(f"{at.rstrip('/')}/change={n}")
    return n


def changes(spark: SparkSession, at: str) -> list[tuple[int, str]]:
    """All changes of a pointer so far, in order."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.schema("value string, change int").parquet(at)
        return sorted((r["change"], r["value"]) for r in found.collect())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def activate(spark: SparkSession, base: str, version: int) -> None:
    """Readers that come from now on see this version: a pointer beside the versions names it, and its last change counts."""
    publish(spark, f"{base.rstrip('/')}/_current", str(version))


def read_current(spark: SparkSession, base: str) -> DataFrame:
    """The version of the index that is in force, in any session."""
    last = changes(spark, f"{base.rstrip('/')}/_current")
    if not last:
        raise FileNotFoundError(f"no version of {base} is in force")
    return spark.read.parquet(f"{base.rstrip('/')}/v={last[-1][1]}")


def reindex(chunks: DataFrame, base: str, version: int, partition: str = "knowledge_base_id") -> None:
    """Writes all knowledge bases and activates only if every row that went in can be read again."""
    spark = chunks.sparkSession
    seen = Observation()
    path = write_version(chunks.observe(seen, F.count(F.lit(1)).alias("n")), base, version, partition)
    if spark.read.parquet(path).count() != seen.get["n"]:
        raise RuntimeError("the new version is not whole; the one in force stays")
    activate(spark, base, version)


def overwrite_documents(chunks: DataFrame, path: str) -> None:
    """Replaces just the knowledge bases that ``chunks`` has."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("knowledge_base_id").parquet(path)


def report(rows: DataFrame, path: str) -> None:
    """One JSON file: reports are a handful of rows."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def event_frames(events: DataFrame) -> DataFrame:
    """Server-sent event frames (thread, n, frame) of (thread, n, event, data): each line of the data is a data line."""
    data = F.array_join(F.transform(F.split("data", "\n"), lambda x: F.concat(F.lit("data: "), x)), "\n")
    return events.select("thread", "n", F.concat(F.lit("event: "), "event", F.lit("\n"), data, F.lit("\n\n")).alias("frame"))


def parse_frames(frames: DataFrame) -> DataFrame:
    """Frames as a client reads them: all columns, ``event`` (message, if the frame names none) and ``data``, its data lines joined,
    each less one leading blank. An answer's data is text; all other data must be JSON. Frames without data, or with data
    that is none, have a null there."""
    lines = F.split(F.regexp_replace("frame", "\r\n", "\n"), "\n")
    names = F.transform(F.filter(lines, lambda x: x.startswith("event:")), lambda x: F.trim(F.substring(x, 7, F.length(x))))
    data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.regexp_replace(F.substring(x, 6, F.length(x)), "^ ", ""))
    out = frames.withColumns({"event": F.coalesce(F.get(F.reverse(names), F.lit(0)), F.lit("message")), "data": F.when(F.size(data) > 0, F.array_join(data, "\n"))})
    return out.withColumn("data", F.when((F.col("event") == "answer") | F.try_parse_json("data").isNotNull(), F.col("data")))
