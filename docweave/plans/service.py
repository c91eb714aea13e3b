"""Listings, permissions, jobs, limits, uploads, metrics and index maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as fx
from docweave.operators import service
from docweave.session import table


def flt_listing(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return o.select("o_orderkey", "o_custkey", "o_orderpriority")


FLT_LISTING = "select o_orderkey, o_custkey, o_orderpriority from orders where o_orderstatus = 'O' and o_orderpriority in ('1-URGENT', '2-HIGH')"


def srt_page(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    return service.page(c, [F.desc("c_acctbal"), F.col("c_custkey")], 2, 20).select("c_custkey", "c_name", "c_acctbal", "total")


SRT_PAGE = "select c_custkey, c_name, c_acctbal, (select count(*) from customer where c_mktsegment = 'BUILDING') as total from customer where c_mktsegment = 'BUILDING' order by c_acctbal desc, c_custkey limit 20 offset 20"


def srt_listing(spark: SparkSession, d: str) -> DataFrame:
    """The top of a listing: urgent first, then the newest, then the greatest key."""
    o = table(spark, d, "orders")
    return o.orderBy(F.desc(F.col("o_orderpriority") == "1-URGENT"), F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_orderpriority")


SRT_LISTING = "select o_orderkey, o_orderpriority from orders order by (o_orderpriority = '1-URGENT') desc, o_orderdate desc, o_orderkey desc limit 50"


def join_members(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "c_name", "n_name")


JOIN_MEMBERS = "select c_custkey, c_name, n_name from customer join nation on c_nationkey = n_nationkey"


def join_actor(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer").filter("c_acctbal > 0")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", F.coalesce("c_name", F.lit("")).alias("actor"))


JOIN_ACTOR = "select o_orderkey, coalesce(c_name, '') as actor from orders left join (select * from customer where c_acctbal > 0) c on o_custkey = c_custkey"


def join_job_task(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_orderpriority").agg(F.count("*").alias("jobs"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


JOIN_JOB_TASK = "select o_orderpriority, count(*) as jobs, sum(l_quantity::bigint)::bigint as quantity from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F' group by 1"


def join_scope_404(spark: SparkSession, d: str) -> DataFrame:
    """Customers of nations in a region: the resource exists in my organisation or is not found."""
    n = table(spark, d, "nation").filter("n_regionkey = 1")
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")


JOIN_SCOPE_404 = "select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)"


def join_deps(spark: SparkSession, d: str) -> DataFrame:
    """Nations that may not be deleted, and what holds them."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("kind"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("kind"))
    return c.union(s).groupBy("k", "kind").agg(F.count("*").alias("n")).withColumnRenamed("k", "n_nationkey")


JOIN_DEPS = "select c_nationkey as n_nationkey, 'customer' as kind, count(*) as n from customer group by 1 union all select s_nationkey, 'supplier', count(*) from supplier group by 1"


def agg_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(F.col("n_chars") > 1000).alias("long"))


AGG_COUNT = "select lang, count(*) as documents, count(*) filter (n_chars > 1000) as long from documents group by 1"


def agg_owner_guard(spark: SparkSession, d: str) -> DataFrame:
    """Nations whose last solvent customer may not go (customers stand in for owners)."""
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("active")).withColumn("last_owner", F.col("active") <= 1)


AGG_OWNER_GUARD = "select c_nationkey, count(*) filter (c_acctbal > 0) as active, count(*) filter (c_acctbal > 0) <= 1 as last_owner from customer group by 1"


def flt_rbac(spark: SparkSession, d: str) -> DataFrame:
    role = F.element_at(F.array(*map(F.lit, ("owner", "admin", "editor", "viewer", "guest"))), (F.col("user_id") % 5 + 1).cast("int"))
    need = F.element_at(F.array(*map(F.lit, ("content:read", "content:write", "content:delete", "upload:create", "user:manage", "chat:use", "nothing:known"))), (F.col("event_id") % 7 + 1).cast("int"))
    return service.authorise(table(spark, d, "events").select("event_id", role.alias("role"), need.alias("permission"))).select("event_id", "role", "permission", "allowed")


FLT_RBAC = """
with e as (select event_id, ['owner', 'admin', 'editor', 'viewer', 'guest'][user_id % 5 + 1] as role, ['content:read', 'content:write', 'content:delete', 'upload:create', 'user:manage', 'chat:use', 'nothing:known'][event_id % 7 + 1] as permission from events)
select event_id, role, permission, case when role in ('owner', 'admin') then permission <> 'nothing:known' when role = 'editor' then permission in ('content:read', 'content:write', 'upload:create', 'chat:use')
  when role = 'viewer' then permission in ('content:read', 'chat:use') else false end as allowed from e
"""


def flt_visibility(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 3).alias("org"), F.col("user_id").alias("owner"), (F.col("event_id") % 10 == 0).alias("reviewer"))
    return service.visible(e, F.lit(1), F.col("reviewer"), F.lit(7)).select("event_id")


FLT_VISIBILITY = "select event_id from events where user_id % 3 = 1 and (event_id % 10 = 0 or user_id = 7)"


def flt_principal(spark: SparkSession, d: str) -> DataFrame:
    """Users with activity and membership whose sessions (events) were not revoked (by an error within the hour before)."""
    e = table(spark, d, "events")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    s = e.filter("event_type = 'signup'").select("event_id", "user_id", hour.alias("hour"))
    revoked = e.filter("event_type = 'error'").select("user_id", hour.alias("hour")).distinct()
    return s.join(revoked, ["user_id", "hour"], "left_anti").select("event_id", "user_id")


FLT_PRINCIPAL = "select event_id, user_id from events s where event_type = 'signup' and not exists (select 1 from events r where r.event_type = 'error' and r.user_id = s.user_id and date_trunc('hour', r.ts) = date_trunc('hour', s.ts))"


def flt_due(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    status = F.element_at(F.array(*map(F.lit, ("pending", "retry", "queued", "running", "done"))), (F.col("event_id") % 5 + 1).cast("int"))
    jobs = e.select(F.col("event_id").alias("job_id"), status.alias("status"), F.col("user_id").alias("next_run_at"), F.when(F.col("event_id") % 2 == 0, F.col("user_id") + 10).alias("lease_until"))
    return service.due(jobs, F.lit(60), 100).select("job_id", "status", "next_run_at")


FLT_DUE = """
with j as (select event_id as job_id, ['pending', 'retry', 'queued', 'running', 'done'][event_id % 5 + 1] as status, user_id as next_run_at, case when event_id % 2 = 0 then user_id + 10 end as lease_until from events)
select job_id, status, next_run_at from j where (status in ('pending', 'retry') and next_run_at <= 60) or (status in ('queued', 'running') and lease_until <= 60) order by next_run_at, job_id limit 100
"""


def st_ratelimit(spark: SparkSession, d: str) -> DataFrame:
    out = service.rate_limit(table(spark, d, "events"), "user_id", "ts", F.col("event_type") == "error", 86400, 3)
    return out.select("event_id", "user_id", "failures", "blocked")


ST_RATELIMIT = """
select event_id, user_id, count(*) over w as failures, count(*) over w >= 3 as blocked from events where event_type = 'error'
window w as (partition by user_id order by ts range between interval 1 day preceding and current row)
"""


def st_retry_fold(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type in ('error', 'purchase')")
    return service.retry_state(e, "user_id", "event_id", F.col("event_type") == "error", 5)


ST_RETRY_FOLD = """
with l as (select *, max(case when event_type = 'purchase' then event_id end) over (partition by user_id) as ok from events where event_type in ('error', 'purchase')),
f as (select user_id, count(*) filter (event_type = 'error' and (ok is null or event_id > ok)) as failures from l group by 1)
select user_id, failures, case when failures = 0 then 'done' when failures >= 5 then 'failed' else 'retry' end as status, case when failures between 1 and 4 then least(5 * pow(2, failures - 1), 300)::bigint end as delay from f
"""


def st_lease(spark: SparkSession, d: str) -> DataFrame:
    """Each click holds its user's lease for an hour: claims that come while an earlier one still holds it."""
    from pyspark.sql.window import Window

    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = table(spark, d, "events").filter("event_type = 'click'").select("event_id", "user_id", t.alias("t")).withColumn("previous", F.lag("t").over(w))
    return e.select("event_id", "user_id", F.coalesce(F.col("t") - F.col("previous") < 3_600_000_000, F.lit(False)).alias("held"))


ST_LEASE = """
select event_id, user_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) < 3600000000, false) as held from events where event_type = 'click'
"""


def st_dlq(spark: SparkSession, d: str) -> DataFrame:
    """Jobs out of retries go to the dead-letter table, all others stay."""
    s = st_retry_fold(spark, d)
    return s.select("user_id", F.when(F.col("status") == "failed", "dead_letter").otherwise("queue").alias("queue"))


ST_DLQ = f"select user_id, case when status = 'failed' then 'dead_letter' else 'queue' end as queue from ({ST_RETRY_FOLD})"


def st_expire(spark: SparkSession, d: str) -> DataFrame:
    """Uploads (orders) past their expiry (thirty days before the last order) that are still open."""
    o = table(spark, d, "orders")
    last = o.agg(F.max("o_orderdate").alias("m"))
    return o.filter("o_orderstatus = 'O'").filter(F.col("o_orderdate") < last.scalar() - F.expr("interval 30 days")).groupBy("o_orderpriority").agg(F.count("*").alias("expired"))


ST_EXPIRE = "select o_orderpriority, count(*) as expired from orders where o_orderstatus = 'O' and o_orderdate < (select max(o_orderdate) from orders) - interval 30 days group by 1"


def st_multipart(spark: SparkSession, d: str) -> DataFrame:
    """Changes of status (by line status and return flag of an order's lines) and whether they may happen."""
    status = F.when(F.col("l_returnflag") == "N", "initiated").when(F.col("l_returnflag") == "A", "uploading").otherwise("completed")
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag")).select("l_orderkey", "l_linenumber", status.alias("status"))
    return service.transitions(li, "l_orderkey", "l_linenumber", "status").groupBy("before", "status", "valid").agg(F.count("*").alias("n"))


ST_MULTIPART = """
with s as (select l_orderkey, l_linenumber, case l_returnflag when 'N' then 'initiated' when 'A' then 'uploading' else 'completed' end as status from (select l_orderkey, l_linenumber, min(l_returnflag) as l_returnflag from lineitem group by 1, 2)),
c as (select *, lag(status) over (partition by l_orderkey order by l_linenumber) as before from s)
select before, status, (before || '>' || status) in ('initiated>uploading', 'uploading>completed', 'uploading>aborted', 'initiated>aborted', 'initiated>expired', 'uploading>expired') as valid, count(*) as n from c where before is not null and before <> status group by all
"""


def st_revoke(spark: SparkSession, d: str) -> DataFrame:
    """Tokens live for a day; those revoked (an error after their signup within the day) with what was left of their life."""
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events")
    s = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("token"), t.alias("born"), F.explode(F.sequence(F.floor(t / 86400), F.floor(t / 86400) + 1)).alias("day"))
    r = e.filter("event_type = 'error'").select("user_id", t.alias("at"), F.floor(t / 86400).alias("day"))
    met = s.join(r, ["user_id", "day"]).filter((F.col("at") >= F.col("born")) & (F.col("at") < F.col("born") + 86400))
    return met.groupBy("user_id", "token").agg((F.min("born") + 86400 - F.min("at")).alias("ttl"))


ST_REVOKE = """
select s.user_id, s.event_id as token, min(floor(epoch(s.ts))::bigint) + 86400 - min(floor(epoch(r.ts))::bigint) as ttl from events s join events r on s.user_id = r.user_id and s.event_type = 'signup' and r.event_type = 'error'
  and floor(epoch(r.ts))::bigint >= floor(epoch(s.ts))::bigint and floor(epoch(r.ts))::bigint < floor(epoch(s.ts))::bigint + 86400 group by 1, 2
"""


def st_review(spark: SparkSession, d: str) -> DataFrame:
    """Reviews (errors) with the first decision (purchase) of the same user after them; only the newest one may be open."""
    e = table(spark, d, "events")
    r = e.filter("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("review"))
    done = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("decision"))
    return r.join(done, "user_id", "left").groupBy("user_id", "review").agg(F.min(F.when(F.col("decision") > F.col("review"), F.col("decision"))).alias("decision")).withColumn("status", F.when(F.col("decision").isNull(), "pending").otherwise("decided"))


ST_REVIEW = """
with r as (select user_id, max(event_id) as review from events where event_type = 'error' group by 1)
select r.user_id, review, min(event_id) filter (event_id > review) as decision, case when min(event_id) filter (event_id > review) is null then 'pending' else 'decided' end as status
from r left join (select * from events where event_type = 'purchase') p on r.user_id = p.user_id group by 1, 2
"""


def agg_quota(spark: SparkSession, d: str) -> DataFrame:
    return service.quota(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "value", 3, 200.0)


AGG_QUOTA = "select user_id, date_trunc('day', ts)::date as day, count(*) as tasks, round(sum(value), 4) as bytes, count(*) > 3 or round(sum(value), 4) > 200 as over from events group by 1, 2"


def agg_metrics(spark: SparkSession, d: str) -> DataFrame:
    labels = F.concat(F.lit('kind="'), fx.label_escape(F.col("event_type")), F.lit('"'))
    return service.metrics(table(spark, d, "events"), F.lit("events_total"), labels, F.col("value") - 10)


AGG_METRICS = "select 'events_total' as name, 'kind=\"' || event_type || '\"' as labels, count(*) as count, round(sum(greatest(value - 10, 0.0)), 4) as seconds from events group by 2"


def snk_prom(spark: SparkSession, d: str) -> DataFrame:
    return service.exposition(agg_metrics(spark, d))


SNK_PROM = "select name, labels, name || '{' || labels || '} ' || count as line from (select 'events_total' as name, 'kind=\"' || event_type || '\"' as labels, count(*) as count from events group by 2)"


def prj_redact(spark: SparkSession, d: str) -> DataFrame:
    detail = F.concat(F.lit("Authorization: Bearer abc."), F.col("user_id").cast("string"), F.lit(' {"token": "'), F.col("event_id").cast("string"), F.lit('", "k": 1} https://files.example.org/x?Expires='), F.col("event_id").cast("string"), F.lit("&Signature=zz"))
    return table(spark, d, "events").select("event_id", fx.redact(F.concat_ws(" ", "props", detail)).alias("detail"))


PRJ_REDACT = """
select event_id, props || ' Authorization: Bearer <redacted> {"token": "<redacted>", "k": 1} https://files.example.org/x?<redacted>' as detail from events
"""


def st_audit(spark: SparkSession, d: str) -> DataFrame:
    """Audit rows with merged context, secrets masked."""
    ctx = F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("api_key"), F.lit("k-1"), F.lit("note"), F.col("event_type"))
    safe = fx.redact_map(ctx)
    return table(spark, d, "events").select("event_id", safe["user_id"].alias("user"), safe["api_key"].alias("api_key"), safe["note"].alias("note"), F.when(F.col("event_type") == "error", "warning").otherwise("info").alias("level"))


ST_AUDIT = "select event_id, user_id::varchar as user, '<redacted>' as api_key, event_type as note, case when event_type = 'error' then 'warning' else 'info' end as level from events"


def fn_lenient_json(spark: SparkSession, d: str) -> DataFrame:
    """The number in the props, none where the JSON is broken (every tenth row is cut short)."""
    raw = F.when(F.col("event_id") % 10 == 0, F.left("props", F.lit(3))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.get_json_object(raw, "$.k").cast("long").alias("k"))


FN_LENIENT_JSON = "select event_id, case when event_id % 10 = 0 then null else (props::json ->> '$.k')::bigint end as k from events"


def join_parts(spark: SparkSession, d: str) -> DataFrame:
    """Expected against stored parts of each order; every ninth tag differs."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")])
    local = li.select("l_orderkey", "l_linenumber", F.concat(F.lit('"'), F.col("l_partkey").cast("string"), F.lit('"')).alias("etag"))
    remote = li.filter("l_quantity > 1").select("l_orderkey", "l_linenumber", F.when(F.col("l_suppkey") % 9 == 0, F.lit("other")).otherwise(F.col("l_partkey").cast("string")).alias("etag"))
    return service.compare_parts(local, remote, "l_orderkey", "l_linenumber", "etag")


JOIN_PARTS = "select l_orderkey, count(*) filter (l_quantity <= 1 or l_suppkey % 9 = 0) as mismatches, count(*) filter (l_quantity <= 1 or l_suppkey % 9 = 0) = 0 as complete from (select l_orderkey, l_linenumber, min(l_suppkey) as l_suppkey, min(l_quantity) as l_quantity from lineitem group by 1, 2) group by 1"


def set_missing_parts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    expected = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("parts"))
    return service.missing_parts(expected, li.filter("l_quantity > 5"), "l_orderkey", "parts", "l_linenumber")


SET_MISSING_PARTS = """
with e as (select l_orderkey, unnest(range(1, max(l_linenumber) + 1))::int as l_linenumber from lineitem group by l_orderkey)
select * from e except select l_orderkey, l_linenumber from lineitem where l_quantity > 5
"""


def agg_progress(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > 5).alias("done"), F.count("*").alias("parts"))
    return li.withColumn("status", F.when(F.col("done") == F.col("parts"), "completed").otherwise("uploading"))


AGG_PROGRESS = "select l_orderkey, count(*) filter (l_quantity > 5) as done, count(*) as parts, case when count(*) filter (l_quantity > 5) = count(*) then 'completed' else 'uploading' end as status from lineitem group by 1"


def win_latest_job(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("j")).select("o_custkey", "j.o_orderkey", "j.o_orderstatus")


WIN_LATEST_JOB = "select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1"


def snk_bulk_index(spark: SparkSession, d: str) -> DataFrame:
    """English documents written over an index of all of them, texts shortened to tell."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return service.upsert(docs, docs.filter("lang = 'en'").withColumn("n_chars", F.lit(-1).cast("long")), "doc_id")


SNK_BULK_INDEX = "select doc_id, lang, case when lang = 'en' then -1 else n_chars end as n_chars from documents"


def snk_delete(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return service.delete(docs, docs.filter("lang = 'de'"), "doc_id")


SNK_DELETE = "select doc_id, lang from documents where lang <> 'de'"


def snk_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Owner of each nation's rows: the first customer by segment rank, then key; suppliers take it over."""
    rank = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2)
    owner = table(spark, d, "customer").groupBy("c_nationkey").agg(F.min_by("c_custkey", F.struct(rank, "c_custkey")).alias("owner"))
    s = table(spark, d, "supplier")
    return s.join(owner, s.s_nationkey == owner.c_nationkey, "left").select("s_suppkey", "owner")


SNK_BACKFILL = """
select s_suppkey, owner from supplier left join (select c_nationkey, c_custkey as owner from customer qualify row_number() over (partition by c_nationkey order by case c_mktsegment when 'BUILDING' then 0 when 'MACHINERY' then 1 else 2 end, c_custkey) = 1) on s_nationkey = c_nationkey
"""


def snk_benchmark_import(spark: SparkSession, d: str) -> DataFrame:
    """Passages become items unless an item with their tag is there (every fourth is)."""
    b = table(spark, d, "benchmark").select(F.concat(F.lit("benchmark:"), F.col("item_id")).alias("tag"), F.sha2("text", 256).alias("content_sha256"))
    have = b.filter(F.expr("cast(substring(tag, 11) as long) % 4 = 0")).select("tag")
    return b.join(have, "tag", "left_anti")


SNK_BENCHMARK_IMPORT = "select 'benchmark:' || item_id as tag, sha256(text) as content_sha256 from benchmark where item_id % 4 <> 0"


def fn_parts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as uploads of as many bytes as their price, in parts of 5000; the size of every part."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("long").alias("size"))
    o = o.withColumn("parts", service.total_parts(F.col("size"), F.lit(5000)))
    o = o.filter("parts > 0").select("o_orderkey", "size", "parts", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts"))).alias("part"))
    return o.select("o_orderkey", "parts", "part", service.part_bytes(F.col("size"), F.lit(5000), F.col("part")).alias("bytes"))


FN_PARTS = """
with o as (select o_orderkey, trunc(o_totalprice)::bigint as size, (trunc(o_totalprice)::bigint + 4999) // 5000 as parts from orders)
select o_orderkey, parts, part, case when part < parts then 5000 else size - 5000 * (parts - 1) end as bytes from (select *, unnest(range(1, parts + 1)) as part from o)
"""


def set_subset(spark: SparkSession, d: str) -> DataFrame:
    """Whether the line numbers of an order are all among 1 to 4."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("have"))
    return lines.select("l_orderkey", service.within(F.col("have"), F.array(*map(F.lit, (1, 2, 3, 4)))).alias("inside"))


SET_SUBSET = "select l_orderkey, max(l_linenumber) <= 4 and min(l_linenumber) >= 1 as inside from lineitem group by 1"


def st_conversation(spark: SparkSession, d: str) -> DataFrame:
    """Conversations of even id exist with a title of their own; all messages touch them or add them; every tenth is deleted
    with its messages, which are counted."""
    m = table(spark, d, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("at"), "text")
    have = m.select("thread").distinct().filter("thread % 2 = 0").select("thread", F.concat(F.lit("kept "), "thread").alias("title"), F.lit(-1).cast("long").alias("at"))
    gone = m.select("thread").distinct().filter("thread % 10 = 0")
    left, messages = service.cascade(gone, "thread", service.touch(have, m), m)
    return left.join(messages.groupBy("thread").agg(F.count("*").alias("messages")), "thread").select("thread", F.md5("title").alias("title_md5"), "at", "messages")


ST_CONVERSATION = """
select conv_id as thread, md5(case when conv_id % 2 = 0 then 'kept ' || conv_id else left(arg_min(text, turn), 80) end) as title_md5, max(turn) as at, count(*) as messages from conversations where conv_id % 10 <> 0 group by 1
"""


def fn_budget(spark: SparkSession, d: str) -> DataFrame:
    """Budgets of requests: the price is what is configured, the window is 0 for every third order."""
    from docweave.operators import conversation

    configured, window = F.col("o_totalprice").cast("int"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_orderkey") * 100).cast("int")
    return table(spark, d, "orders").select("o_orderkey", conversation.input_budget(configured, window, F.lit(2000), F.lit(-5), F.lit(300)).alias("budget"))


FN_BUDGET = """
select o_orderkey, greatest(1, case when o_orderkey % 3 = 0 then trunc(o_totalprice)::int else least(trunc(o_totalprice)::int, (o_orderkey * 100)::int - 2300) end) as budget from orders
"""


def fn_range_label(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("int")
    return table(spark, d, "part").select("p_partkey", fx.range_label(key, key + F.col("p_size"), key % 26 + 1, key % 26 + 27).alias("label"))


FN_RANGE_LABEL = "select p_partkey, chr((65 + p_partkey % 26)::int) || p_partkey || ':A' || chr((65 + p_partkey % 26)::int) || (p_partkey + p_size) as label from part"

QUERIES = {k: (globals()[k], globals()[k.upper()]) for k in [x for x in list(globals()) if x.upper() in globals() and x.islower() and callable(globals()[x])]}
