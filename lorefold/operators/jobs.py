"""Operations: jobs and steps, retries, leases, reconciliation, idempotency, limits and quotas, as DataFrame transforms."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTENT_TYPES = ("documents", "audio", "images", "videos")
CONTENT_OF_SOURCE = {"DOCUMENT": "documents", "AUDIO": "audio", "IMAGE": "images", "VIDEO": "videos", "WEB_PAGE": "documents", "YOUTUBE": "videos"}
#: Kinds of errors that end a task for good, and kinds that are worth another attempt.
FINAL_CAUSES = ("DocumentProcessingException", "IllegalArgumentException", "NoSuchElementException", "FileNotFoundException", "NoSuchFileException")
RETRYABLE_CAUSES = ("UpstreamServiceException", "IOException", "InterruptedException")


@dataclass(frozen=True)
class RetryPolicy:
    attempts: int = 5
    first_s: int = 30
    most_s: int = 900
    lease_s: int = 1800
    reconcile_s: int = 21_600

    def __post_init__(self) -> None:
        if min(self.attempts, self.first_s, self.most_s, self.lease_s, self.reconcile_s) < 1 or self.first_s > self.most_s:
            raise ValueError("durations must be positive and in order")


def backoff(attempt: Column, policy: RetryPolicy = RetryPolicy()) -> Column:
    """Seconds before the next attempt: doubled each time, up to the most."""
    power = F.least(F.lit(20), F.greatest(F.lit(0), attempt - 1)).cast("int")
    return F.least(F.lit(policy.most_s).cast("long"), F.lit(policy.first_s).cast("long") * F.pow(F.lit(2.0), power).cast("long"))


def retry_decision(tasks: DataFrame, policy: RetryPolicy = RetryPolicy()) -> DataFrame:
    """tasks (causes, attempt_count) with retryable, delay_s and outcome RETRY or DEAD. causes holds the kinds of an error and of what caused it, outermost first: the first known one decides."""
    known = F.filter("causes", lambda c: c.isin(*FINAL_CAUSES, *RETRYABLE_CAUSES))
    again = F.coalesce(F.get(known, F.lit(0)).isin(*RETRYABLE_CAUSES), F.lit(False))
    retry = again & (F.col("attempt_count") < policy.attempts)
    return tasks.withColumns({"retryable": again, "delay_s": F.when(retry, backoff(F.col("attempt_count"), policy)), "outcome": F.when(retry, "RETRY").otherwise("DEAD")})


def job_rollup(steps: DataFrame) -> DataFrame:
    """Status of each job from its steps (job_id, status, completed_at): skipped ones don't count, an end only for a final status."""
    live = F.col("status") != "SKIPPED"
    has = lambda *s: F.count_if(live & F.col("status").isin(*s))
    n = F.count_if(live)
    status = (
        F.when(n == 0, "COMPLETED").when(has("COMPLETED") == n, "COMPLETED").when(has("FAILED") == n, "FAILED")
        .when((has("FAILED") > 0) & (has("PENDING", "RUNNING") == 0), "PARTIALLY_FAILED").otherwise("RUNNING")
    )
    out = steps.groupBy("job_id").agg(status.alias("status"), n.alias("n_steps"), F.max(F.when(live, F.col("completed_at"))).alias("last"))
    return out.select("job_id", "status", "n_steps", F.when(F.col("status") != "RUNNING", F.col("last")).alias("completed_at"))


def fan_out(jobs: DataFrame, submissions: DataFrame) -> DataFrame:
    """The four steps of each job (job_id): pending for submitted content types (job_id, content_type), else skipped. The four types are explode()d, not joined."""
    given = submissions.select("job_id", "content_type").distinct().withColumn("given", F.lit(True))
    steps = jobs.select("job_id", F.explode(F.array(*[F.lit(c) for c in CONTENT_TYPES])).alias("content_type"))
    return steps.join(given, ["job_id", "content_type"], "left").select("job_id", "content_type", F.when(F.col("given"), "PENDING").otherwise("SKIPPED").alias("status"))


def content_type(source_type: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CONTENT_OF_SOURCE.items() for x in kv]), source_type)


def ordered_steps(steps: DataFrame) -> DataFrame:
    """Steps in the order of content types within a job."""
    return steps.withColumn("at", F.array_position(F.array(*[F.lit(c) for c in CONTENT_TYPES]), F.col("content_type"))).orderBy("job_id", "at").drop("at")


def recent_jobs(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest jobs of each workspace; the limit is held to 1 to 100."""
    w = Window.partitionBy("workspace_id").orderBy(F.desc("created_at"), F.asc("job_id"))
    return jobs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= min(max(limit, 1), 100))


def sources_of(sources: DataFrame, workspace: str | None = None) -> DataFrame:
    """Sources that aren't deleted, newest first."""
    kept = sources.where("deleted_at is null")
    return (kept if workspace is None else kept.where(F.col("workspace_id") == workspace)).orderBy(F.desc("created_at"))


def compare_and_set(sources: DataFrame, ids: list[str], allowed: list[str], status: str) -> DataFrame:
    """sources after a conditional change of status, with changed marking the rows it touched."""
    hit = F.col("id").isin(*ids) & F.col("status").isin(*allowed) & F.col("deleted_at").isNull()
    return sources.withColumn("changed", F.coalesce(hit, F.lit(False))).withColumn("status", F.when(F.col("changed"), status).otherwise(F.col("status")))


def soft_delete(sources: DataFrame, ids: list[str], now: Column) -> DataFrame:
    hit = F.col("id").isin(*ids) & F.col("deleted_at").isNull()
    return sources.withColumns({"deleted_at": F.when(hit, now).otherwise(F.col("deleted_at")), "status": F.when(hit, "DELETED").otherwise(F.col("status"))})


def due_tasks(tasks: DataFrame, now: Column, limit: int = 50) -> DataFrame:
    """Tasks to work on: scheduled ones whose time has come, running ones whose lease is over, completed ones to look at again; oldest first."""
    due = ((F.col("status") == "SCHEDULED") & (F.col("next_attempt_at") <= now)) | ((F.col("status") == "RUNNING") & (F.col("lease_expires_at") <= now)) | ((F.col("status") == "COMPLETED") & (F.col("next_attempt_at") <= now))
    return tasks.where(due).orderBy(F.asc_nulls_last("next_attempt_at"), F.asc("updated_at"), F.asc("source_id")).limit(limit)


def expired(rows: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    """What is left after rows older than some days are deleted."""
    return rows.where(F.col(column) >= now - F.expr(f"interval {int(days)} days"))


def backfill_tasks(sources: DataFrame) -> DataFrame:
    """Recovery tasks of sources that have none yet, by their status."""
    status = F.when(F.col("status") == "PROCESSED", "COMPLETED").when(F.col("status") == "FAILED", "DEAD").otherwise("SCHEDULED")
    return sources.where("deleted_at is null").select(F.col("id").alias("source_id"), "workspace_id", F.lit("PROCESS").alias("operation_type"), status.alias("status"), F.lit(0).alias("attempt_count"))


def source_of(sources: DataFrame, workspace: str, source: str) -> DataFrame:
    """One source of a workspace, unless it is deleted."""
    return sources.where((F.col("workspace_id") == workspace) & (F.col("id") == source) & F.col("deleted_at").isNull())


def reset_leases(tasks: DataFrame) -> DataFrame:
    """Running tasks lose their lease and token, so that they are claimed anew."""
    running = F.col("status") == "RUNNING"
    return tasks.withColumns({"lease_expires_at": F.when(running, F.lit(None).cast(tasks.schema["lease_expires_at"].dataType)).otherwise(F.col("lease_expires_at")), "claim_token": F.when(running, F.lit(None).cast("string")).otherwise(F.col("claim_token"))})


def split_request(sources: DataFrame, requested: DataFrame) -> DataFrame:
    """Each requested source (job_id, source_id), submitted if it is there and not being processed, else skipped, with its content type."""
    s = sources.where("deleted_at is null").select(F.col("id").alias("source_id"), "source_type", "status")
    good = F.col("status").isNotNull() & (F.col("status") != "PROCESSING")
    return requested.join(s, "source_id", "left").select("job_id", "source_id", content_type(F.col("source_type")).alias("content_type"), F.when(good, "SUBMITTED").otherwise("SKIPPED").alias("decision"))


def source_ids(split: DataFrame) -> DataFrame:
    """Submitted sources of each job by content type, the smallest of several."""
    one = split.where("decision = 'SUBMITTED' and content_type is not null").groupBy("job_id", "content_type").agg(F.min("source_id").alias("source_id"))
    return one.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("content_type", "source_id")))).alias("source_ids"))


def pending_jobs(tasks: DataFrame, steps: DataFrame, now: Column) -> DataFrame:
    """What a task (source_id, job_id, status, lease_expires_at) does with its job's step (job_id, content_type, status): REUSE a pending one, FAIL_STALE one that runs without a live lease, KEEP one that runs, NEW without either."""
    joined = tasks.join(steps.select("job_id", F.col("status").alias("step_status")), "job_id", "left")
    live = F.coalesce(F.col("lease_expires_at") > now, F.lit(False))
    action = F.when(F.col("step_status") == "PENDING", "REUSE").when((F.col("step_status") == "RUNNING") & live, "KEEP").when(F.col("step_status") == "RUNNING", "FAIL_STALE").otherwise("NEW")
    return joined.select("source_id", "job_id", action.alias("action"))


def delete_plan(sources: DataFrame) -> DataFrame:
    """Steps of deleting each source, in order: refused while it is processed, else its knowledge, its lease's check, its bytes and its row."""
    steps = F.when(F.col("status") == "PROCESSING", F.array(F.lit("REFUSE"))).otherwise(F.array(*[F.lit(x) for x in ("KNOWLEDGE", "ASSERT_LEASE", "BYTES", "METADATA")]))
    return sources.where("deleted_at is null").select(F.col("id").alias("source_id"), F.posexplode(steps).alias("position", "step"))


def surviving(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def rate_limit(events: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """events (key, ts, event_id) with their place in the key's fixed window and whether they pass; refused ones count too. A window of one key is one sort group."""
    t = F.unix_timestamp("ts")
    start = t - t % seconds
    place = F.row_number().over(Window.partitionBy("key", "window_start").orderBy("ts", "event_id"))
    out = events.withColumn("window_start", start).withColumn("n", place.cast("long")).withColumn("allowed", F.col("n") <= limit)
    return out.withColumn("retry_after", F.when(~F.col("allowed"), F.greatest(F.lit(1).cast("long"), F.col("window_start") + seconds - t)))


def daily_quota(events: DataFrame, limit: int) -> DataFrame:
    """events (user_id, action, ts, event_id) against a daily limit in UTC; only those that pass consume."""
    day = F.date_trunc("DAY", F.col("ts"))
    place = F.row_number().over(Window.partitionBy("user_id", "action", "day").orderBy("ts", "event_id"))
    out = events.withColumn("day", day).withColumn("n", place.cast("long")).withColumn("allowed", F.col("n") <= limit)
    left = F.unix_timestamp(F.col("day") + F.expr("interval 1 day")) - F.unix_timestamp("ts")
    return out.withColumn("consumed", F.least(F.col("n"), F.lit(limit).cast("long"))).withColumn("retry_after", F.when(~F.col("allowed"), F.greatest(F.lit(1).cast("long"), left)))


#: Source statuses and what each event makes of them.
MOVES = {("UPLOADED", "start"): "PROCESSING", ("PROCESSED", "start"): "PROCESSING", ("FAILED", "start"): "PROCESSING", ("PROCESSING", "complete"): "PROCESSED", ("PROCESSING", "fail"): "FAILED"}


STATES = ("UPLOADED", "PROCESSING", "PROCESSED", "FAILED")


def fold_states(events: DataFrame, first: str = "UPLOADED", span_events: int = 10_000) -> DataFrame:
    """Final status of each key after its events (key, ts, seq, event) in order, with the number of moves and of refused events.

    A key's events are cut in spans of time that hold span_events of all events on average, and each span is folded from every state at once, so a key
    with a large part of the events is many rows; a row for each key and span then makes the result.
    """
    second = F.unix_timestamp("ts")
    low, high, n = events.agg(F.min(second), F.max(second), F.count("*")).first()
    width = max(1, ((high or 0) - (low or 0) + 1) * span_events // max(1, n))
    step = lambda s, e: reduce(lambda other, m: F.when((s["status"] == m[0][0]) & (e["event"] == m[0][1]), F.lit(m[1])).otherwise(other), MOVES.items(), F.lit(None).cast("string"))

    def merge(s: Column, e: Column) -> Column:
        to = step(s, e)
        return F.struct(F.coalesce(to, s["status"]).alias("status"), (s["moves"] + F.when(to.isNotNull(), 1).otherwise(0)).alias("moves"), (s["refused"] + F.when(to.isNull(), 1).otherwise(0)).alias("refused"))

    def follow(s: Column, part: Column) -> Column:
        r = reduce(lambda other, state: F.when(s["status"] == state, part[state]).otherwise(other), STATES[1:], part[STATES[0]])
        return F.struct(r["status"].alias("status"), (s["moves"] + r["moves"]).alias("moves"), (s["refused"] + r["refused"]).alias("refused"))

    start = lambda state: F.struct(F.lit(state).alias("status"), F.lit(0).alias("moves"), F.lit(0).alias("refused"))
    spans = events.groupBy("key", F.floor(second / width).alias("span")).agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "event"))).alias("e"))
    parts = spans.select("key", F.struct("span", *[F.aggregate("e", start(state), merge).alias(state) for state in STATES]).alias("part"))
    rows = parts.groupBy("key").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return rows.select("key", F.aggregate("parts", start(first), follow).alias("s")).select("key", "s.*")


def fold_leases(events: DataFrame, policy: RetryPolicy = RetryPolicy()) -> DataFrame:
    """Leases of keys after events (key, ts in seconds, seq, event start|renew|complete|fail, token) in order: status, attempts, token, lease_until, conflicts.

    A start is refused while another lease is live; what shows a stale token or comes after the lease is a conflict.
    """
    start = F.struct(F.lit("SCHEDULED").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("token"), F.lit(0).cast("long").alias("lease_until"), F.lit(0).alias("conflicts"))

    def merge(s: Column, e: Column) -> Column:
        live = (s["status"] == "RUNNING") & (s["lease_until"] > e["ts"])
        mine = live & s["token"].eqNullSafe(e["token"])
        opens, renews, ends, fails = (e["event"] == "start") & ~live, (e["event"] == "renew") & mine, (e["event"] == "complete") & mine, (e["event"] == "fail") & mine
        good = opens | renews | ends | fails
        return F.struct(
            F.when(opens, "RUNNING").when(ends, "COMPLETED").when(fails, "SCHEDULED").otherwise(s["status"]).alias("status"),
            F.when(opens, F.when(s["status"] == "COMPLETED", 1).otherwise(s["attempts"] + 1)).otherwise(s["attempts"]).alias("attempts"),
            F.when(opens, e["token"]).when(ends | fails, F.lit(None).cast("string")).otherwise(s["token"]).alias("token"),
            F.when(opens | renews, e["ts"] + policy.lease_s).when(ends | fails, F.lit(0).cast("long")).otherwise(s["lease_until"]).alias("lease_until"),
            (s["conflicts"] + F.when(good, 0).otherwise(1)).alias("conflicts"),
        )

    rows = events.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "event", "token"))).alias("e"))
    return rows.select("key", F.aggregate("e", start, merge).alias("s")).select("key", "s.*")


def reconcile(tasks: DataFrame, sources: DataFrame, files: DataFrame, complete: DataFrame) -> DataFrame:
    """What to do about each completed task's source: gone, bytes missing, index incomplete, or all well. One row for each task."""
    s = sources.where("deleted_at is null").select(F.col("id").alias("source_id"), F.col("status").alias("source_status"), "storage_key")
    f = files.select("storage_key").distinct().withColumn("has_bytes", F.lit(True))
    joined = tasks.select("source_id").join(s, "source_id", "left").join(f, "storage_key", "left").join(complete.select("source_id", "complete"), "source_id", "left")
    action = (
        F.when(F.col("source_status").isNull(), "DELETE_KNOWLEDGE").when(F.col("storage_key").isNotNull() & F.col("has_bytes").isNull(), "DEAD_LETTER:SOURCE_CONTENT_MISSING")
        .when((F.col("source_status") == "PROCESSED") & ~F.coalesce("complete", F.lit(False)), "REPAIR:KNOWLEDGE_MISSING").otherwise("PRUNE_AND_DEFER")
    )
    return joined.select("source_id", action.alias("action"))


def submission_guard(tasks: DataFrame, now: Column) -> DataFrame:
    """Whether a source may be submitted again: not while scheduled, nor while a lease runs."""
    busy = (F.col("status") == "SCHEDULED") | ((F.col("status") == "RUNNING") & (F.col("lease_expires_at") > now))
    return tasks.select("source_id", (~F.coalesce(busy, F.lit(False))).alias("may_submit"))


def classify_submissions(requests: DataFrame) -> DataFrame:
    """Requests (key, fingerprint, ts, seq, done_at or null) as first, replay, pending or conflict: by the first request of the key and whether it is done by then."""
    w = Window.partitionBy("key").orderBy("ts", "seq")
    first, done = F.first("fingerprint").over(w), F.first("done_at").over(w)
    kind = F.when(F.row_number().over(w) == 1, "ACCEPTED").when(~F.col("fingerprint").eqNullSafe(first), "CONFLICT").when(done.isNotNull() & (done <= F.col("ts")), "REPLAY").otherwise("PENDING")
    return requests.withColumn("decision", kind)


def status_counts(rows: DataFrame, statuses: dict[str, list[str]]) -> DataFrame:
    """One row of counts, a column for each named set of statuses."""
    return rows.agg(*[F.count_if(F.col("status").isin(*s)).alias(n) for n, s in statuses.items()])


def filter_sources(rows: DataFrame, kind: str | None, text: str) -> DataFrame:
    out = rows if kind is None else rows.where(F.col("source_type") == kind)
    return out.where(F.contains(F.lower("name"), F.lit(text.lower())))


def hits(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 8)) -> DataFrame:
    """Share of questions (run, rank of the right passage or null) found in the first k, for each run."""
    return ranked.groupBy("run").agg(*[F.avg(F.coalesce(F.col("rank").between(1, k), F.lit(False)).cast("double")).alias(f"hit_at_{k}") for k in ks], F.count("*").alias("questions"))


def best_run(scores: DataFrame) -> DataFrame:
    """The run with the best Hit@1, then 3, then 5; the earlier of equals. Columns: run, ordinal, hit_at_1, hit_at_3, hit_at_5."""
    return scores.orderBy(F.desc("hit_at_1"), F.desc("hit_at_3"), F.desc("hit_at_5"), F.asc("ordinal")).limit(1)
