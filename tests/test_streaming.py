"""Streams that are read to their end decide as the batch transforms do."""

import time
import uuid

import pytest
from pyspark.sql import functions as F

from lorefold.operators import jobs as J
from lorefold.streaming import limits as L

SMALL = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def events(spark):
    e = spark.read.parquet(SMALL)
    return e.select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("seq"), "event_type")


@pytest.fixture(scope="module")
def stream(spark, events, tmp_path_factory):
    """The same events as a stream of one file."""
    path = str(tmp_path_factory.mktemp("events") / "in")
    events.coalesce(1).write.parquet(path)
    return spark.readStream.schema(events.schema).parquet(path)


def drain(spark, df, mode="append"):
    name = f"sink_{uuid.uuid4().hex}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_rate_limit(spark, events, stream):
    batch = J.rate_limit(events.withColumnRenamed("seq", "event_id"), 1, 3600).withColumnRenamed("event_id", "seq")
    got = drain(spark, L.rate_limit(stream, 1, 3600))
    columns = ["seq", "window_start", "n", "allowed"]
    assert rows(got, *columns) == rows(batch, *columns)
    assert rows(got.where("not allowed"), "seq", "retry_after") == rows(batch.where("not allowed"), "seq", "retry_after")


def test_daily_quota(spark, events, stream):
    e = events.select(F.concat_ws("/", "key", "event_type").alias("user_id"), F.lit("x").alias("action"), "ts", F.col("seq").alias("event_id"))
    batch = J.daily_quota(e, 2).withColumnRenamed("event_id", "seq")
    got = drain(spark, L.daily_quota(stream.withColumn("key", F.concat_ws("/", "key", "event_type")), 2))
    assert rows(got, "seq", "n", "consumed", "allowed") == rows(batch, "seq", "n", "consumed", "allowed")


def test_window_counts(spark, events, stream):
    got = drain(spark, L.window_counts(stream, 3600), "complete")
    start = F.unix_timestamp("ts") - F.unix_timestamp("ts") % 3600
    assert rows(got, "key", "window_start", "n") == rows(events.groupBy("key", start.alias("window_start")).agg(F.count("*").alias("n")), "key", "window_start", "n")


def test_states(spark, events, stream):
    event = F.expr("case seq % 3 when 0 then 'start' when 1 then 'complete' else 'fail' end")
    batch = J.fold_states(events.withColumn("event", event))
    got = drain(spark, L.fold_states(stream.withColumn("event", event)))
    assert rows(got.groupBy("key").agg(F.count_if("moved").alias("moves"), F.count_if(~F.col("moved")).alias("refused")), "key", "moves", "refused") == rows(batch, "key", "moves", "refused")


def test_leases(spark, events, stream):
    event = F.expr("case event_type when 'click' then 'start' when 'view' then 'renew' when 'purchase' then 'complete' when 'signup' then 'fail' else 'start' end")
    token = F.concat(F.lit("t"), (F.col("seq") % 2).cast("string"))
    batch = J.fold_leases(events.select("key", F.unix_timestamp("ts").alias("ts"), "seq", event.alias("event"), token.alias("token")))
    got = drain(spark, L.fold_leases(stream.withColumns({"event": event, "token": token})))
    assert rows(got.groupBy("key").agg(F.count_if("conflict").alias("conflicts"), F.count("*").alias("n")), "key", "conflicts") == rows(batch, "key", "conflicts")


def test_submissions(spark, events, stream):
    add = {"key": F.concat_ws("/", "key", "event_type"), "fingerprint": (F.col("seq") % 2).cast("string"), "done_at": F.when(F.col("seq") % 3 > 0, F.col("ts") + F.expr("interval 2 days"))}
    batch = J.classify_submissions(events.withColumns(add))
    got = drain(spark, L.classify_submissions(stream.withColumns(add)))
    assert rows(got, "seq", "decision") == rows(batch, "seq", "decision")


def test_poll_hands_over_each_row_once(stream, tmp_path):
    seen = []
    L.poll(stream, lambda batch, _: seen.append(batch.count()), str(tmp_path / "state"), None).awaitTermination()
    assert sum(seen) > 0


def lease_stream(spark, path, files):
    """A file for each list of events (key, time, seq, event, token), read one at a time."""
    schema = "key string, ts timestamp, seq long, event string, token string"
    for rows_of in files:
        x = spark.createDataFrame(rows_of, "key string, at string, seq long, event string, token string").withColumn("ts", F.to_timestamp("at")).drop("at")
        x.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read in order of their seconds
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_leases_expire_without_an_event_and_completed_ones_are_forgotten(spark, tmp_path):
    day = "2024-01-01 "
    files = [
        [("a", day + "00:00:00", 1, "start", "t1"), ("b", day + "00:00:00", 2, "start", "t2"), ("b", day + "00:00:10", 3, "complete", "t2")],
        [("c", "2024-01-03 00:00:00", 4, "start", "t3")],
        [("d", "2024-01-03 00:00:00", 7, "start", "t6")],
        [("a", "2024-01-03 00:00:01", 5, "start", "t4"), ("b", "2024-01-03 00:00:02", 6, "start", "t5")],
    ]
    found = L.fold_leases(lease_stream(spark, str(tmp_path / "in"), files), keep_s=3600)
    q = found.writeStream.format("memory").queryName("leases").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("leases").collect()  # the batch of d, which the watermark of c precedes, fires the timers of a and b
    expired = [(r.key, r.status, r.attempts, r.token, r.conflict) for r in got if r.seq is None]
    assert expired == [("a", "SCHEDULED", 1, None, False)]
    assert {r.seq: (r.status, r.attempts, r.conflict) for r in got if r.seq is not None} == {1: ("RUNNING", 1, False), 2: ("RUNNING", 1, False), 3: ("COMPLETED", 1, False), 4: ("RUNNING", 1, False), 5: ("RUNNING", 2, False), 6: ("RUNNING", 1, False), 7: ("RUNNING", 1, False)}
    assert sum(s["numRowsRemoved"] for p in q.recentProgress for s in p["stateOperators"]) >= 1


def test_one_bad_task_is_a_dead_letter(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(50).select(F.col("id").alias("task"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("size")).coalesce(1).write.parquet(path)

    def work(row):
        if row["task"] == 13:
            raise KeyError("no such source")
        return int(row["task"]) * 2 if row["size"] is not None else None

    tasks = spark.readStream.schema("task long, size long").parquet(path)
    L.poll_isolated(tasks, work, "long", out, str(tmp_path / "state"), None).awaitTermination()
    done, dead = L.outcomes(spark, out), L.outcomes(spark, out, failed=True)
    assert done.count() == 49 and done.where("result = task * 2").count() == 41 and done.where("result is null and size is null").count() == 8
    assert [(r.task, r.error, r.error_kind) for r in dead.collect()] == [(13, "'no such source'", "KeyError")]
