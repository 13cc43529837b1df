"""Structured Streaming twins of the operations: limits, quotas, states, leases and submissions of each key.

All share one shape. Events get an event-time watermark, are keyed, and a stateful operator decides on each in (ts, seq) order within a micro-batch; what is later than
the watermark is dropped. Over a source that is read once (trigger availableNow) whose files are in order of time, the decisions are those of the batch transforms.
State is a few numbers for each key, whatever the number of its events, and is checkpointed, so a lost executor costs a retry of its tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import error_text
from ..operators.jobs import MOVES, RetryPolicy

LATE = "10 minutes"


def _timed(events: DataFrame, late: str) -> DataFrame:
    """events with a watermark on ts, which may lack a time zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def window_counts(events: DataFrame, seconds: int = 60, late: str = LATE) -> DataFrame:
    """Events (key, ts) of each key in each fixed window: (key, window_start in seconds, n). Counts are final when the watermark passes the window."""
    w = F.window("ts", f"{seconds} seconds")
    out = _timed(events, late).groupBy("key", w.alias("w")).agg(F.count("*").alias("n"))
    return out.select("key", F.unix_timestamp("w.start").alias("window_start"), "n")


def _keyed(events: DataFrame, late: str, keys: list[str], decide: Callable, out: str, state: str) -> DataFrame:
    return _timed(events, late).groupBy(*keys).applyInPandasWithState(decide, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def _sorted(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's events of one micro-batch in order."""
    return pd.concat(batches).sort_values(["ts", "seq"], kind="stable")


def rate_limit(events: DataFrame, limit: int, seconds: int = 60, late: str = LATE) -> DataFrame:
    """Events (key string, ts, seq long) decided one by one: (seq, window_start, n, allowed, retry_after). Refused events count too; a window's state goes when the watermark passes its end."""
    rows = events.withColumn("window_start", F.unix_timestamp("ts") - F.unix_timestamp("ts") % seconds)

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        b = _sorted(batches)
        before = state.get[0] if state.exists else 0
        start = int(key[1])
        n = before + pd.Series(range(1, len(b) + 1))
        wait = (start + seconds - b["at"].reset_index(drop=True)).clip(lower=1)
        state.update((before + len(b),))
        if (start + seconds) * 1000 > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp((start + seconds) * 1000)
        yield pd.DataFrame({"seq": b["seq"].to_numpy(), "window_start": start, "n": n, "allowed": n <= limit, "retry_after": wait.where(n > limit).astype("Int64")})

    keyed = rows.select("key", "window_start", "ts", "seq", F.unix_timestamp("ts").alias("at"))
    return _keyed(keyed, late, ["key", "window_start"], decide, "seq long, window_start long, n long, allowed boolean, retry_after long", "n long")


def daily_quota(events: DataFrame, limit: int, late: str = LATE) -> DataFrame:
    """Events (key, ts, seq) against a daily limit in UTC; the session's time zone must be UTC. The window of rate_limit() is a day; consumption stops at the limit."""
    return rate_limit(events, limit, 86_400, late).withColumn("consumed", F.least(F.col("n"), F.lit(limit).cast("long")))


def fold_states(events: DataFrame, first: str = "UPLOADED", late: str = LATE) -> DataFrame:
    """Events (key, ts, seq, event) of a state machine to (key, seq, status, moved): the status after each event, and whether it was allowed."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = _sorted(batches)
        status = state.get[0] if state.exists else first
        after, moved = [], []
        for event in b["event"]:
            to = MOVES.get((status, event))
            moved.append(to is not None)
            status = to or status
            after.append(status)
        state.update((status,))
        yield pd.DataFrame({"key": key[0], "seq": b["seq"].to_numpy(), "status": after, "moved": moved})

    return _keyed(events.select("key", "ts", "seq", "event"), late, ["key"], decide, "key string, seq long, status string, moved boolean", "status string")


def fold_leases(events: DataFrame, policy: RetryPolicy = RetryPolicy(), late: str = LATE, keep_s: int = 7 * 86_400) -> DataFrame:
    """Lease events (key, ts, seq, event, token) to (key, seq, status, attempts, token, lease_until, conflict): a stale token or a start under a live lease is a conflict.

    When the watermark passes the end of a lease that nobody has renewed, a row without seq says that the task is SCHEDULED again, its attempts kept, though no event came. A completed task is forgotten
    keep_s after its last event; a start counts from 1 in either case, so decisions are those of the batch transform.
    """
    columns = ["key", "seq", "status", "attempts", "token", "lease_until", "conflict"]

    def wake(state: GroupState, seconds: int) -> None:
        state.setTimeoutTimestamp(max(seconds * 1000, state.getCurrentWatermarkMs() + 1))

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, attempts, _, _ = state.get
            if status == "RUNNING":
                state.update(("SCHEDULED", attempts, None, 0))
                yield pd.DataFrame([(key[0], None, "SCHEDULED", attempts, None, 0, False)], columns=columns).astype({"seq": "Int64"})
            else:
                state.remove()
            return
        b = _sorted(batches)
        status, attempts, token, until = state.get if state.exists else ("SCHEDULED", 0, None, 0)
        out = []
        if status == "RUNNING" and until * 1000 <= state.getCurrentWatermarkMs():  # new events keep a due timer from firing
            status, token, until = "SCHEDULED", None, 0
            out.append((key[0], None, status, attempts, token, until, False))
        for seq, at, event, shown in zip(b["seq"], b["at"], b["event"], b["token"], strict=True):
            live = status == "RUNNING" and until > at
            mine = live and token == shown
            good = (event == "start" and not live) or (event in ("renew", "complete", "fail") and mine)
            if good and event == "start":
                status, attempts, token, until = "RUNNING", 1 if status == "COMPLETED" else attempts + 1, shown, int(at) + policy.lease_s
            elif good and event == "renew":
                until = int(at) + policy.lease_s
            elif good:
                status, token, until = "COMPLETED" if event == "complete" else "SCHEDULED", None, 0
            out.append((key[0], seq, status, attempts, token, until, not good))
        state.update((status, attempts, token, until))
        if status == "RUNNING":
            wake(state, until)
        elif status == "COMPLETED":
            wake(state, int(b["at"].max()) + keep_s)
        yield pd.DataFrame(out, columns=columns).astype({"seq": "Int64"})

    rows = events.select("key", "ts", "seq", F.unix_timestamp("ts").alias("at"), "event", "token")
    return _keyed(rows, late, ["key"], decide, "key string, seq long, status string, attempts int, token string, lease_until long, conflict boolean", "status string, attempts int, token string, until long")


def classify_submissions(requests: DataFrame, keep_days: int = 30, late: str = LATE) -> DataFrame:
    """Requests (key, fingerprint string, ts, seq, done_at or null) to (seq, decision) as the batch transform has it; a key is forgotten keep_days after its first request."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        b = _sorted(batches)
        held = state.get if state.exists else None
        decisions = []
        for fingerprint, at, done in zip(b["fingerprint"], b["at"], b["done"], strict=True):
            if held is None:
                held = (fingerprint, -1 if pd.isna(done) else int(done), int(at))
                decisions.append("ACCEPTED")
            elif fingerprint != held[0]:
                decisions.append("CONFLICT")
            else:
                decisions.append("REPLAY" if 0 <= held[1] <= at else "PENDING")
        state.update(held)
        end = held[2] // 1000 + keep_days * 86_400_000
        if end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end)
        yield pd.DataFrame({"seq": b["seq"].to_numpy(), "decision": decisions})

    micros: Callable[[str], Column] = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = requests.select("key", "ts", "seq", F.col("fingerprint").cast("string").alias("fingerprint"), micros("ts").alias("at"), micros("done_at").alias("done"))
    return _keyed(rows, late, ["key"], decide, "seq long, decision string", "fingerprint string, done long, at long")


def poll(tasks: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = 30):
    """Hand each micro-batch of due tasks to work(batch, number), every `seconds`, or once over all there is with None."""
    writer = tasks.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def poll_isolated(tasks: DataFrame, work: Callable[[dict], object], result: str, path: str, checkpoint: str, seconds: int | None = 30):
    """Do the work of each due task in Spark's tasks, `seconds` apart or once with None; one that fails becomes a dead letter and doesn't stop the others.

    work(row as a dict) returns a value of the type `result`. Each micro-batch is worked on once and written as one folder of path, which a repeated batch writes anew: read it with outcomes(). How many tasks
    a batch takes in is the reader's maxFilesPerTrigger. Work that was under way when an executor was lost is done again, so it must bear that.
    """
    names = tasks.columns

    def attempt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values, errors, kinds = [], [], []
            for row in b.astype(object).where(b.notna(), None).to_dict("records"):
                try:
                    values.append(work(row))
                    errors.append(None)
                    kinds.append(None)
                except Exception as e:  # noqa: BLE001  a task's failure is its own, whatever it is
                    values.append(None)
                    errors.append(str(e))
                    kinds.append(type(e).__name__)
            yield b.assign(**{c: pd.Series(v, index=b.index, dtype=object) for c, v in (("result", values), ("error", errors), ("error_kind", kinds))})

    def once(batch: DataFrame, number: int) -> None:
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema), f"result {result}, error string, error_kind string"])
        done = batch.mapInPandas(attempt, schema).select(*names, "result", error_text(F.col("error"), F.col("error_kind")).alias("error"), "error_kind", F.col("error_kind").isNotNull().alias("failed"))
        done.write.mode("overwrite").partitionBy("failed").parquet(f"{path}/batch={number}")

    return poll(tasks, once, checkpoint, seconds)


def outcomes(spark: SparkSession, path: str, failed: bool = False) -> DataFrame:
    """Results of poll_isolated(), or its dead letters with their errors."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").where(F.col("failed") == failed).drop("failed", "batch", *(["result"] if failed else ["error", "error_kind"]))
