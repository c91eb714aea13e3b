"""Operations of the service: listings, permissions, quotas, jobs, limits, uploads, metrics, the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import text as fx

#: What each role may do.
_EVERYTHING = ("knowledge_base:read", "knowledge_base:write", "knowledge_base:delete", "content:read", "content:write", "content:delete", "search:use", "chat:use", "upload:create", "user:manage")
PERMISSIONS = {
    "owner": _EVERYTHING,
    "admin": _EVERYTHING,
    "editor": ("knowledge_base:read", "knowledge_base:write", "content:read", "content:write", "search:use", "chat:use", "upload:create"),
    "viewer": ("knowledge_base:read", "content:read", "search:use", "chat:use"),
}
#: How an upload may go on.
TRANSITIONS = {("initiated", "uploading"), ("uploading", "completed"), ("uploading", "aborted"), ("initiated", "aborted"), ("initiated", "expired"), ("uploading", "expired")}


def permissions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, p) for r, ps in PERMISSIONS.items() for p in ps], "role string, permission string")


def authorise(requests: DataFrame) -> DataFrame:
    """Requests (role, permission) with ``allowed``; an unknown role may do nothing. The matrix has a dozen rows."""
    matrix = permissions(requests.sparkSession).withColumn("__ok", F.lit(True))
    return requests.join(F.broadcast(matrix), ["role", "permission"], "left").withColumn("allowed", F.coalesce("__ok", F.lit(False))).drop("__ok")


def visible(rows: DataFrame, org: Column, reviewer: Column, me: Column) -> DataFrame:
    """Reviewers see all of their organisation, others their own."""
    return rows.filter((F.col("org") == org) & (reviewer | (F.col("owner") == me)))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page (from 1) of a listing, with the total on each row. The total is a second, narrow pass; the page itself is a
    top-k."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", total.scalar())


def due(jobs: DataFrame, now: Column, most: int) -> DataFrame:
    """Jobs to claim: waiting ones whose time has come, running ones whose lease is over; by time, then id."""
    waiting = F.col("status").isin("pending", "retry") & (F.col("next_run_at") <= now)
    lost = F.col("status").isin("queued", "running") & F.col("lease_until").isNotNull() & (F.col("lease_until") <= now)
    return jobs.filter(waiting | lost).orderBy("next_run_at", "job_id").limit(most)


def rate_limit(events: DataFrame, key: str, at: str, failed: Column, seconds: int, most: int) -> DataFrame:
    """Each failed event with the failures of its key in the last ``seconds`` (itself included) and whether the key is
    blocked. The window is a range over time within the key."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("__t").rangeBetween(-seconds * 1_000_000, 0)
    return events.filter(failed).withColumn("__t", t).withColumn("failures", F.count("*").over(w)).withColumn("blocked", F.col("failures") >= most).drop("__t")


def retry_state(events: DataFrame, job: str, order: str, failed: Column, most: int) -> DataFrame:
    """The state of each job after its events: failures since its last success, status, and when it runs again."""
    w = Window.partitionBy(job)
    last_ok = F.max(F.when(~failed, F.col(order))).over(w)
    e = events.withColumn("__since", failed & (last_ok.isNull() | (F.col(order) > last_ok)))
    s = e.groupBy(job).agg(F.count_if("__since").alias("failures"))
    status = F.when(F.col("failures") == 0, "done").when(F.col("failures") >= most, "failed").otherwise("retry")
    return s.select(job, "failures", status.alias("status"), F.when(status == "retry", fx.backoff_seconds(F.col("failures"))).alias("delay"))


def quota(uploads: DataFrame, actor: str, at: str, size: str, most_tasks: int, most_bytes: float) -> DataFrame:
    day = F.date_trunc("day", F.col(at))
    q = uploads.groupBy(actor, day.cast("date").alias("day")).agg(F.count("*").alias("tasks"), F.round(F.sum(size), 4).alias("bytes"))
    return q.withColumn("over", (F.col("tasks") > most_tasks) | (F.col("bytes") > most_bytes))


def metrics(events: DataFrame, name: Column, labels: Column, seconds: Column) -> DataFrame:
    """Counters and durations by name and label set; negative durations count as none."""
    return events.select(name.alias("name"), labels.alias("labels"), seconds.alias("s")).groupBy("name", "labels").agg(F.count("*").alias("count"), F.round(F.sum(F.greatest("s", F.lit(0.0))), 4).alias("seconds"))


def exposition(m: DataFrame) -> DataFrame:
    """Text lines of the metrics, to be read in order of (name, labels)."""
    base = F.concat(F.col("name"), F.lit("{"), F.col("labels"), F.lit("} "))
    return m.select("name", "labels", F.concat(base, F.col("count").cast("string")).alias("line"))


def missing_parts(expected: DataFrame, done: DataFrame, task: str, total: str, part: str) -> DataFrame:
    """Part numbers 1 to ``total`` of each task that have not arrived."""
    wanted = expected.select(task, F.explode(F.sequence(F.lit(1), F.col(total))).alias(part))
    return wanted.join(done.select(task, part).distinct(), [task, part], "left_anti")


def compare_parts(local: DataFrame, remote: DataFrame, task: str, part: str, tag: str) -> DataFrame:
    """Per task whether the parts on both sides are the same, entity tags without their quotes."""
    plain = lambda df, as_: df.select(task, part, F.trim(F.replace(F.col(tag), F.lit('"'), F.lit(""))).alias(as_))
    both = plain(local, "l").join(plain(remote, "r"), [task, part], "full_outer")
    return both.groupBy(task).agg(F.count_if(~F.col("l").eqNullSafe(F.col("r"))).alias("mismatches")).withColumn("complete", F.col("mismatches") == 0)


def transitions(states: DataFrame, task: str, order: str, status: str) -> DataFrame:
    """Each change of an upload's status and whether it is one that may happen."""
    w = Window.partitionBy(task).orderBy(order)
    s = states.withColumn("before", F.lag(status).over(w)).filter(F.col("before").isNotNull() & (F.col("before") != F.col(status)))
    return s.withColumn("valid", F.concat_ws(">", "before", status).isin(*[f"{a}>{b}" for a, b in sorted(TRANSITIONS)]))


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows by key over those of the table. Of equal keys in ``rows`` the last by ``order`` counts; without one, any of
    them."""
    if order:
        last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
        rows = rows.withColumn("__n", last).filter("__n = 1").drop("__n")
    else:
        rows = rows.dropDuplicates([key])
    return table.join(rows.select(key), key, "left_anti").unionByName(rows.select(*table.columns))


def delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The table less those keys; keys that are not there are no matter."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def sample_negatives(pairs: DataFrame, pool: DataFrame, k: int, query: str, doc: str, salt: str = "") -> DataFrame:
    """k documents of the pool for each query that are none of its pairs, all documents being as likely: ``n`` from 1 to k, fewer
    only if the pool has no more.

    The pool is numbered in the order of a hash (MD5 of ``salt`` and the id), number by number within ranges of the hash, so
    no task sorts it whole. A query takes the numbers from a place of its own on, as many as k and its pairs, so that k are
    left when its pairs are gone. Queries meet just those rows: the join is on the number.
    """
    cells = 4096
    told = lambda c: F.md5(F.concat(F.lit(salt), F.col(c).cast("string")))
    cell = lambda h: F.conv(F.left(h, F.lit(3)), 16, 10).cast("int")
    p = pool.select(doc).distinct().withColumn("h", told(doc)).withColumn("cell", cell(F.col("h")))
    sizes = p.groupBy("cell").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most 4096 rows
    within = F.row_number().over(Window.partitionBy("cell").orderBy("h", doc))
    numbered = p.join(sizes.select("cell", before.alias("first")), "cell").select(doc, (F.col("first") + within - 1).alias("number"))
    total = numbered.count()
    own = pairs.groupBy(query).agg(F.count_distinct(doc).alias("taken"))
    at = F.pmod(F.conv(F.left(told(query), F.lit(15)), 16, 10).cast("long"), F.lit(max(total, 1)))
    steps = F.sequence(F.lit(0), F.least(F.col("taken") + k, F.lit(total)).cast("int") - 1)
    asked = own.filter(F.lit(total > 0)).select(query, F.posexplode(steps).alias("step", "_"), at.alias("at")).withColumn("number", (F.col("at") + F.col("step")) % max(total, 1))
    drawn = asked.join(numbered, "number").join(pairs.select(query, doc).distinct(), [query, doc], "left_anti")
    return drawn.withColumn("n", F.row_number().over(Window.partitionBy(query).orderBy("step"))).filter(F.col("n") <= k).select(query, doc, "n")


def total_parts(size: Column, part: Column) -> Column:
    return F.floor((size + part - 1) / part).cast("long")


def part_bytes(size: Column, part: Column, number: Column) -> Column:
    """Bytes of one part, counted from 1; the last may be shorter. Numbers that there are not give null."""
    n = total_parts(size, part)
    return F.when((number >= 1) & (number < n), part).when(number == n, size - part * (n - 1))


def within(asked: Column, there: Column) -> Column:
    """Whether all elements of the one array are in the other."""
    return F.size(F.array_except(asked, there)) == 0


def touch(conversations: DataFrame, messages: DataFrame, key: str = "thread", order: str = "at") -> DataFrame:
    """Conversations (key, title, at) after messages (key, at, text): a new thread is added under its first message's first
    80 signs, one that is there keeps its title, and each has the date of its last message."""
    seen = messages.groupBy(key).agg(F.max(order).alias("__at"), F.left(F.min_by("text", order), F.lit(80)).alias("__title"))
    both = conversations.join(seen, key, "full_outer")
    return both.select(key, F.coalesce("title", "__title").alias("title"), F.greatest(order, "__at").alias(order))


def cascade(ids: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    """Each table less the rows of those conversations."""
    return [delete(t, ids, key) for t in tables]
