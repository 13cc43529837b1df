"""Registered queries: jobs, limits, retries, reconciliation, over the events and documents tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs as J
from ..sources.tables import table

_STATUS = "case event_id % 7 when 0 then 'FAILED' when 1 then 'SKIPPED' when 2 then 'PENDING' else 'COMPLETED' end"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select(F.col("user_id").alias("key"), "ts", "event_id")
    return J.rate_limit(e, 1, 3600).select("event_id", "window_start", "n", "allowed", "retry_after")


RATE_SQL = """with e as (select *, floor(epoch(ts))::bigint as t, floor(epoch(ts))::bigint - floor(epoch(ts))::bigint % 3600 as window_start from events), n as (select *, row_number() over (partition by user_id, window_start order by ts, event_id) as n from e)
select event_id, window_start, n, n <= 1 as allowed, case when n > 1 then greatest(1, window_start + 3600 - t) end as retry_after from n"""


def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", F.col("event_type").alias("action"), "ts", "event_id")
    return J.daily_quota(e, 2).select("event_id", "n", "consumed", "allowed", "retry_after")


QUOTA_SQL = """with n as (select *, row_number() over (partition by user_id, event_type, date_trunc('day', ts) order by ts, event_id) as n from events)
select event_id, n, least(n, 2) as consumed, n <= 2 as allowed, case when n > 2 then greatest(1, epoch(date_trunc('day', ts) + interval 1 day)::bigint - floor(epoch(ts))::bigint) end as retry_after from n"""


def job_rollup(spark: SparkSession, d: str) -> DataFrame:
    steps = _events(spark, d).select(F.expr("event_id div 4").alias("job_id"), F.expr(_STATUS).alias("status"), F.col("ts").alias("completed_at"))
    return J.job_rollup(steps)


ROLLUP_SQL = f"""with s as (select event_id // 4 as job_id, {_STATUS} as status, ts from events), l as (select job_id, count(*) filter (where status <> 'SKIPPED') as n, count(*) filter (where status = 'COMPLETED') as c, count(*) filter (where status = 'FAILED') as f,
  count(*) filter (where status = 'PENDING') as p, max(ts) filter (where status <> 'SKIPPED') as last from s group by job_id), r as (select *, case when n = 0 or c = n then 'COMPLETED' when f = n then 'FAILED' when f > 0 and p = 0 then 'PARTIALLY_FAILED' else 'RUNNING' end as status from l)
select job_id, status, n as n_steps, case when status <> 'RUNNING' then last end as completed_at from r"""


def job_latest(spark: SparkSession, d: str) -> DataFrame:
    jobs = _events(spark, d).select(F.col("event_id").alias("job_id"), F.col("user_id").alias("workspace_id"), F.col("ts").alias("created_at"))
    return J.recent_jobs(jobs, 5).select("workspace_id", "job_id", F.col("rank").cast("long").alias("rank"))


LATEST_SQL = "select * from (select user_id as workspace_id, event_id as job_id, row_number() over (partition by user_id order by ts desc, event_id) as rank from events) where rank <= 5"


def job_fanout(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    given = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "documents", "view", "audio", "purchase", "images")]), F.col("event_type"))
    return J.fan_out(e.select(F.col("event_id").alias("job_id")), e.select(F.col("event_id").alias("job_id"), given.alias("content_type")).where("content_type is not null"))


FANOUT_SQL = """select event_id as job_id, c.content_type, case when c.content_type = case event_type when 'click' then 'documents' when 'view' then 'audio' when 'purchase' then 'images' end then 'PENDING' else 'SKIPPED' end as status
from events, (select unnest(['documents', 'audio', 'images', 'videos']) as content_type) c"""


def state_machine(spark: SparkSession, d: str) -> DataFrame:
    event = F.expr("case event_id % 3 when 0 then 'start' when 1 then 'complete' else 'fail' end")
    out = J.fold_states(_events(spark, d).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), event.alias("event")))
    return out.select(F.col("key").alias("user_id"), "status", F.col("moves").cast("long").alias("moves"), F.col("refused").cast("long").alias("refused"))


STATE_SQL = """with recursive e as (select user_id, case event_id % 3 when 0 then 'start' when 1 then 'complete' else 'fail' end as ev, row_number() over (partition by user_id order by ts, event_id) as i from events),
s as (select user_id, 0::bigint as i, 'UPLOADED' as status, 0::bigint as moves, 0::bigint as refused from (select distinct user_id from events)
 union all select s.user_id, e.i, case when ok then case ev when 'start' then 'PROCESSING' when 'complete' then 'PROCESSED' else 'FAILED' end else s.status end, moves + ok::int, refused + (not ok)::int
 from s join (select *, true as x from e) e on e.user_id = s.user_id and e.i = s.i + 1, lateral (select case when ev = 'start' then s.status <> 'PROCESSING' else s.status = 'PROCESSING' end as ok) o)
select user_id, arg_max(status, i) as status, max(moves) as moves, max(refused) as refused from s group by user_id"""


def lease_fencing(spark: SparkSession, d: str) -> DataFrame:
    event = F.expr("case event_type when 'click' then 'start' when 'view' then 'renew' when 'purchase' then 'complete' when 'signup' then 'fail' else 'start' end")
    e = _events(spark, d).select(F.col("user_id").alias("key"), F.unix_timestamp("ts").alias("ts"), F.col("event_id").alias("seq"), event.alias("event"), F.concat(F.lit("t"), (F.col("event_id") % 2).cast("string")).alias("token"))
    return J.fold_leases(e)


def due_tasks(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-10").cast("timestamp")
    e = _events(spark, d)
    status = F.expr("case event_id % 4 when 0 then 'SCHEDULED' when 1 then 'RUNNING' when 2 then 'COMPLETED' else 'DEAD' end")
    tasks = e.select(F.col("event_id").alias("source_id"), status.alias("status"), F.when(F.col("event_id") % 4 != 1, F.col("ts")).alias("next_attempt_at"), F.when(F.col("event_id") % 4 == 1, F.col("ts")).alias("lease_expires_at"), F.col("ts").alias("updated_at"))
    return J.due_tasks(tasks, now).select("source_id", "status")


DUE_SQL = """select event_id as source_id, case event_id % 4 when 0 then 'SCHEDULED' when 1 then 'RUNNING' else 'COMPLETED' end as status from events
where event_id % 4 < 3 and ts <= timestamp '2024-01-10' order by case when event_id % 4 <> 1 then ts end nulls last, ts, event_id limit 50"""


def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_id", (F.col("event_id") % 9).alias("attempt_count"), F.when(F.col("event_type") == "click", F.array(F.lit("RuntimeException"), F.lit("IOException"))).when(F.col("event_type") == "view", F.array(F.lit("UpstreamServiceException"))).otherwise(F.array(F.lit("IllegalArgumentException"), F.lit("IOException"))).alias("causes"))
    return J.retry_decision(e).select("event_id", "retryable", "delay_s", "outcome")


RETRY_SQL = """select event_id, event_type in ('click', 'view') as retryable, case when event_type in ('click', 'view') and event_id % 9 < 5 then least(900, 30 * (1 << greatest(0, event_id % 9 - 1)::int))::bigint end as delay_s,
case when event_type in ('click', 'view') and event_id % 9 < 5 then 'RETRY' else 'DEAD' end as outcome from events"""


def reconcile(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    sources = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, "PROCESSED").otherwise("FAILED").alias("status"), F.when(F.col("doc_id") % 7 > 0, F.col("doc_id")).alias("storage_key"), F.when(F.col("doc_id") % 11 == 0, F.lit("x")).alias("deleted_at"))
    files = docs.where("doc_id % 5 > 0").select(F.col("doc_id").alias("storage_key"))
    return J.reconcile(docs.select(F.col("doc_id").alias("source_id")), sources, files, labels.select(F.col("doc_id").alias("source_id"), F.lit(True).alias("complete")))


RECONCILE_SQL = """select d.doc_id as source_id, case when d.doc_id % 11 = 0 then 'DELETE_KNOWLEDGE' when d.doc_id % 7 > 0 and d.doc_id % 5 = 0 then 'DEAD_LETTER:SOURCE_CONTENT_MISSING'
when d.doc_id % 2 = 0 and l.doc_id is null then 'REPAIR:KNOWLEDGE_MISSING' else 'PRUNE_AND_DEFER' end as action from documents d left join labels l on l.doc_id = d.doc_id"""


def idempotency(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_id", F.concat_ws("/", F.col("user_id").cast("string"), F.col("event_type")).alias("key"), (F.col("event_id") % 2).alias("fingerprint"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 > 0, F.col("ts") + F.expr("interval 2 days")).alias("done_at"))
    return J.classify_submissions(e).select("event_id", "decision")


IDEMPOTENCY_SQL = """with f as (select *, first_value(event_id) over w as f_id, first_value(ts) over w as f_ts, row_number() over w as n from events window w as (partition by user_id, event_type order by ts, event_id))
select event_id, case when n = 1 then 'ACCEPTED' when event_id % 2 <> f_id % 2 then 'CONFLICT' when f_id % 3 > 0 and f_ts + interval 2 days <= ts then 'REPLAY' else 'PENDING' end as decision from f"""


def ttl_prune(spark: SparkSession, d: str) -> DataFrame:
    return J.expired(_events(spark, d), "ts", F.lit("2024-01-20").cast("timestamp"), 5).groupBy("event_type").agg(F.count("*").alias("kept"), F.max("event_id").alias("last_id"))


TTL_SQL = "select event_type, count(*) as kept, max(event_id) as last_id from events where ts >= timestamp '2024-01-20' - interval 5 days group by event_type"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    status = F.expr("case doc_id % 4 when 0 then 'UPLOADED' when 1 then 'PROCESSING' when 2 then 'PROCESSED' else 'FAILED' end")
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("name"), F.col("lang").alias("source_type"), status.alias("status"), F.lit("w").alias("workspace_id"), F.when(F.col("doc_id") % 10 == 0, F.lit("x")).alias("deleted_at"))


def ui_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return J.status_counts(_sources(spark, d), {"ready": ["PROCESSED"], "working": ["UPLOADED", "PROCESSING"], "failed": ["FAILED"]})


UI_COUNTS_SQL = "select count(*) filter (where doc_id % 4 = 2) as ready, count(*) filter (where doc_id % 4 < 2) as working, count(*) filter (where doc_id % 4 = 3) as failed from documents"


def ui_source_filter(spark: SparkSession, d: str) -> DataFrame:
    return J.filter_sources(_sources(spark, d), "en", "C1").select("id", "name")


UI_FILTER_SQL = "select doc_id::varchar as id, source as name from documents where lang = 'en' and contains(lower(source), 'c1')"


def backfill_tasks(spark: SparkSession, d: str) -> DataFrame:
    return J.backfill_tasks(_sources(spark, d)).select("source_id", "operation_type", "status", F.col("attempt_count").cast("long").alias("attempt_count"))


BACKFILL_SQL = "select doc_id::varchar as source_id, 'PROCESS' as operation_type, case doc_id % 4 when 2 then 'COMPLETED' when 3 then 'DEAD' else 'SCHEDULED' end as status, 0::bigint as attempt_count from documents where doc_id % 10 > 0"


QUERIES = {
    "rate_limit": rate_limit, "daily_quota": daily_quota, "job_rollup": job_rollup, "job_latest": job_latest, "job_fanout": job_fanout, "state_machine": state_machine, "lease_fencing": lease_fencing, "due_tasks": due_tasks, "retry_backoff": retry_backoff,
    "reconcile": reconcile, "idempotency": idempotency, "ttl_prune": ttl_prune, "ui_status_counts": ui_status_counts, "ui_source_filter": ui_source_filter, "backfill_tasks": backfill_tasks,
}
SQL = {
    "rate_limit": RATE_SQL, "daily_quota": QUOTA_SQL, "job_rollup": ROLLUP_SQL, "job_latest": LATEST_SQL, "job_fanout": FANOUT_SQL, "state_machine": STATE_SQL, "due_tasks": DUE_SQL, "retry_backoff": RETRY_SQL,
    "reconcile": RECONCILE_SQL, "idempotency": IDEMPOTENCY_SQL, "ttl_prune": TTL_SQL, "ui_status_counts": UI_COUNTS_SQL, "ui_source_filter": UI_FILTER_SQL, "backfill_tasks": BACKFILL_SQL,
}
