"""Streams run to their end over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.plans.conversation import MEMORIES_SQL, asked_to_remember
from docweave.plans.documents import PACKED
from docweave.session import shared_folder, table
from docweave.streaming import jobs, processors


def _folder(spark: SparkSession) -> str:
    return shared_folder(spark, "streams")


def st_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Documents streamed to chunks; the chunks as they stand afterwards."""
    at = _folder(spark)
    jobs.ingest(jobs.table_stream(spark, d, "documents"), f"{at}/chunks", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/chunks").groupBy("doc_id").agg(F.count("content").alias("chunks"), F.sum(F.length("content")).alias("chars"))


def st_sessions(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    q = jobs.sessions(jobs.table_stream(spark, d, "events")).writeStream.option("checkpointLocation", f"{at}/checkpoint").outputMode("append").format("parquet").option("path", f"{at}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("user_id long, start timestamp, end timestamp, events long, value double").parquet(f"{at}/out").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


def st_job_states(spark: SparkSession, d: str) -> DataFrame:
    """Users' events as jobs: an error is a failure, a purchase a success."""
    at = _folder(spark)
    e = jobs.table_stream(spark, d, "events").filter("event_type in ('error', 'purchase')")
    e = e.select(F.col("user_id").alias("job_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") == "error").alias("failed"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={batch_id}")

    jobs.job_states(e).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    return out.groupBy("job_id").agg(F.max_by(F.struct("failures", "status"), "batch").alias("s")).select("job_id", "s.failures", "s.status")


ST_PIPELINE = f"""with {PACKED}
select doc_id, count(content) as chunks, sum(length(content))::bigint as chars from documents left join chunks using (doc_id) group by 1
"""

#: A session ends 30 minutes after its last event, and is given out once the watermark (an hour behind the last event) has passed its end.
ST_SESSIONS = """
with e as (select user_id, ts, value, coalesce((ts - lag(ts) over (partition by user_id order by ts)) > interval 30 minute, true)::int as fresh from events),
n as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as no from e),
s as (select user_id, no, max(ts) + interval 30 minute as ends, count(*) as events from n group by 1, 2)
select user_id, count(*) as sessions, sum(events)::bigint as events from s where ends <= (select max(ts) - interval 1 hour from events) group by 1
"""

ST_JOB_STATES = """
with l as (select user_id as job_id, list({'f': (event_type = 'error')::int, 'dead': false} order by ts) as xs from events where event_type in ('error', 'purchase') group by 1),
r as (select job_id, list_reduce(list_prepend({'f': 0, 'dead': false}, xs), lambda a, x : case when a.dead then a when x.f = 1 then {'f': a.f + 1, 'dead': a.f + 1 >= 5} else {'f': 0, 'dead': false} end) as z from l)
select job_id, z.f::int as failures, case when z.dead then 'dead' when z.f > 0 then 'retry' else 'done' end as status from r
"""

#: Changes of state, ends of sessions and time-outs come out when the watermark, an hour behind the last event, has passed them.


def _ran(stream: DataFrame, at: str) -> DataFrame:
    """What a stream over all files gives, as a table."""
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def _events(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    e = jobs.table_stream(spark, d, "events").filter(F.col("event_type").isin(*kinds)).withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumn("at", F.unix_millis("ts"))


def st_retry_live(spark: SparkSession, d: str) -> DataFrame:
    """Users as jobs: an error is a failure, a purchase a success. All changes of status, those of timers too."""
    e = _events(spark, d, "error", "purchase").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("n"), "ts", "at", (F.col("event_type") == "error").alias("failed"))
    return _ran(processors.retries(e, base=1800.0, cap=14400.0), _folder(spark))


ST_RETRY_LIVE = """
with e as (select user_id as job_id, event_id, (epoch_us(ts) // 1000) as "at", event_type = 'error' as failed from events where event_type in ('error', 'purchase')),
g as (select *, count(*) filter (not failed) over (partition by job_id order by "at", event_id) as run from e),
f as (select *, count(*) filter (failed) over (partition by job_id, run order by "at", event_id) as failures, row_number() over (partition by job_id order by "at", event_id) as pos from g),
s as (select *, min(case when failures >= 5 then pos end) over (partition by job_id) as dead from f),
c as (select job_id, "at", failures::int as failures, case when not failed then 'done' when failures >= 5 then 'failed' else 'retry' end as status, lead("at") over (partition by job_id order by pos) as next_at,
  "at" + least(1800 * pow(2, failures - 1), 14400)::bigint * 1000 as due from s where dead is null or pos <= dead),
w as (select (epoch_us(max(ts)) // 1000) - 3600000 as mark from events where event_type in ('error', 'purchase'))
select job_id, "at", status, failures from c
union all select job_id, due, 'pending', failures from c, w where status = 'retry' and ((next_at is not null and due <= next_at) or (next_at is null and due <= mark))
"""


def st_lease_live(spark: SparkSession, d: str) -> DataFrame:
    """Clicks as claims of their user's lease of twelve hours."""
    e = _events(spark, d, "click").select(F.col("user_id").alias("job_id"), "ts", "at", F.col("event_id").alias("claim"))
    return _ran(processors.leases(e, 43200), _folder(spark))


ST_LEASE_LIVE = """
with l as (select user_id as job_id, list({'at': (epoch_us(ts) // 1000), 'claim': event_id, 'until': 0::bigint, 'owner': 0::bigint, 'ok': false} order by ts, event_id) as xs from events where event_type = 'click' group by 1),
n as (select job_id, unnest(range(1, len(xs) + 1)) as i, xs from l),
z as (select job_id, i, list_reduce(list_prepend({'at': 0::bigint, 'claim': 0::bigint, 'until': 0::bigint, 'owner': 0::bigint, 'ok': false}, xs[1:i]),
  lambda a, x : case when a.until <= x."at" then {'at': x."at", 'claim': x.claim, 'until': x."at" + 43200000, 'owner': x.claim, 'ok': true} else {'at': x."at", 'claim': x.claim, 'until': a.until, 'owner': a.owner, 'ok': false} end) as s from n),
g as (select job_id, s."at" as "at", s.claim as claim, s.ok as ok, s.until as until, lead(s."at") over (partition by job_id order by i) as next_at from z),
o as (select *, max("at") over (partition by job_id) as last_at from g), w as (select (epoch_us(max(ts)) // 1000) - 3600000 as mark from events where event_type = 'click')
select job_id, "at", claim, case when ok then 'granted' else 'refused' end as status from g
union all select job_id, until, claim, 'expired' from o, w where ok and (until <= last_at or until <= mark)
"""


def st_revoke_live(spark: SparkSession, d: str) -> DataFrame:
    """Tokens (users by device) live for a day: errors revoke them, clicks are checked."""
    token = F.col("user_id") * 10 + F.col("event_id") % 3
    e = _events(spark, d, "error", "click").select("user_id", token.alias("token"), "ts", "at", (F.col("event_type") == "error").alias("revoke"), F.when(F.col("event_id") % 2 == 0, F.col("at") + 7200000).alias("until"))
    return _ran(processors.revocations(e, 86400), _folder(spark))


ST_REVOKE_LIVE = """
with e as (select user_id, user_id * 10 + event_id % 3 as token, (epoch_us(ts) // 1000) as "at", event_type = 'error' as revoke, case when event_id % 2 = 0 then (epoch_us(ts) // 1000) + 7200000 else (epoch_us(ts) // 1000) + 86400000 end as until from events where event_type in ('error', 'click')),
l as (select *, last_value(case when revoke then until end ignore nulls) over (partition by token order by "at", (not revoke)::int rows unbounded preceding) as known from e)
select user_id, token, "at", coalesce("at" < known, false) as revoked from l where not revoke
"""


def st_review_live(spark: SparkSession, d: str) -> DataFrame:
    """Errors ask for a review of their user's thread, purchases decide: two streams joined within a day."""
    asked = _events(spark, d, "error").select(F.col("event_id").alias("review"), F.col("user_id").alias("thread"), F.col("ts").alias("asked_at"))
    decided = _events(spark, d, "purchase").select(F.col("event_id").alias("decision"), F.col("user_id").alias("decided_for"), F.col("ts").alias("decided_at"))
    out = _ran(processors.reviews(asked, decided), _folder(spark))
    all_asked = table(spark, d, "events").filter("event_type = 'error'").select(F.col("event_id").alias("review"), F.col("user_id").alias("thread"))
    return processors.review_status(all_asked, out)


ST_REVIEW_LIVE = """
with m as (select epoch_us(least((select max(ts) from events where event_type = 'error'), (select max(ts) from events where event_type = 'purchase'))) - 3600000000 as mark)
select a.event_id as review, a.user_id as thread, arg_min(p.event_id, {'t': p.ts, 'e': p.event_id}) as decision,
  case when count(p.event_id) > 0 then 'resumed' when epoch_us(a.ts) + 86400000000 < any_value(mark) then 'timed_out' else 'pending' end as status
from events a cross join m left join events p on p.event_type = 'purchase' and p.user_id = a.user_id and p.ts >= a.ts and p.ts <= a.ts + interval 1 day
where a.event_type = 'error' group by a.event_id, a.user_id, a.ts
"""


def st_memory_live(spark: SparkSession, d: str) -> DataFrame:
    """Memories of a stream of messages; of equal ones of a conversation one is taken."""
    m = jobs.table_stream(spark, d, "conversations").filter("role = 'user'").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn")))
    out = _ran(processors.memories(m, asked_to_remember()), _folder(spark))
    return out.groupBy("conv_id", "key").agg(F.count("*").alias("n"), F.min(F.md5("content")).alias("content_md5")).drop("key").select("conv_id", "n", "content_md5")


ST_MEMORY_LIVE = f"""
with {MEMORIES_SQL} select conv_id, count(distinct key)::bigint as n, min(md5(content)) as content_md5 from k group by conv_id, key
"""

QUERIES = {
    "st_pipeline": (st_pipeline, ST_PIPELINE),
    "st_sessions": (st_sessions, ST_SESSIONS),
    "st_job_states": (st_job_states, ST_JOB_STATES),
    "st_retry_live": (st_retry_live, ST_RETRY_LIVE),
    "st_lease_live": (st_lease_live, ST_LEASE_LIVE),
    "st_revoke_live": (st_revoke_live, ST_REVOKE_LIVE),
    "st_review_live": (st_review_live, ST_REVIEW_LIVE),
    "st_memory_live": (st_memory_live, ST_MEMORY_LIVE),
}
