"""Staging, flushing, consolidating and triggers on a stream that starts again."""

import json

from pyspark.sql import functions as F

from tests.logs import message, write
from tracefold.plans.session import Sessions
from tracefold.sources import pending, session_log
from tracefold.streaming import due

BATCH = "session_id string, kind string, batch_no long, covers_up_to_id string, data string"


def test_a_flush_writes_each_batch_once(spark, tmp_path):
    waiting, ledger = str(tmp_path / "waiting"), str(tmp_path / "ledger")
    rows = [("s", "dropped", 1, "e", "{}"), ("s", "observed", 2, "e", "{}"), ("s", "observed", 1, "e", "{}"), ("t", "reflected", 1, "e", "{}"), ("s", "odd", 1, "e", "{}")]
    pending.stage(spark.createDataFrame(rows, BATCH), waiting)
    assert pending.flush(spark, waiting, ledger) == 4 and pending.read(spark, waiting).count() == 0
    got = spark.read.parquet(ledger).filter("session_id = 's'").orderBy("place").collect()
    assert [(r.kind, r.batch_no) for r in got] == [("observed", 1), ("observed", 2), ("dropped", 1)]
    # a flush that broke off before it cleared: the batches wait again, with a new one
    pending.stage(spark.createDataFrame([*rows, ("t", "observed", 7, "e", "{}")], BATCH), waiting)
    assert pending.flush(spark, waiting, ledger) == 1 and pending.flush(spark, waiting, ledger) == 0
    assert spark.read.parquet(ledger).count() == 5


def test_replacing_keeps_the_old_table_beside(spark, tmp_path):
    path = str(tmp_path / "state")
    for n in (1, 2, 3):
        pending.replace(spark.createDataFrame([("s", "observed", n, "e", "{}")], BATCH), path)
    assert pending.read(spark, path).first().batch_no == 3 and pending.read(spark, path + ".stale").first().batch_no == 2


def test_appending_makes_few_folders(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(500).select(F.concat(F.lit("s"), "id").alias("session_id"), "id")
    session_log.append(rows, path, 8)
    session_log.append(rows.limit(1), path, 8)
    assert len([p for p in (tmp_path / "table").iterdir() if p.is_dir()]) <= 8 and spark.read.parquet(path).count() == 501
    assert spark.read.parquet(path).filter(F.col("bucket") == session_log.bucket_of(F.lit("s3"), 8)).filter("session_id = 's3'").count() == 1


def test_sessions_that_may_run(spark):
    attempts = [("runs", 100, "running"), ("soon", 95, "failed"), ("late", 10, "failed"), ("often", 1, "done"), ("good", 99, "done")]
    attempts += [("often", 2 + k, "failed") for k in range(10)] + [("again", k, "failed") for k in range(10)] + [("again", 20, "done")]
    df = spark.createDataFrame(attempts, "session_id string, at long, outcome string").withColumn("at", F.timestamp_seconds("at"))
    sessions = df.select("session_id").distinct().union(spark.createDataFrame([("new",)], "session_id string"))
    got = {r.session_id for r in pending.ready(sessions, df, F.timestamp_seconds(F.lit(100))).collect()}
    assert got == {"late", "good", "again", "new"}


def test_consolidation_from_observing_to_the_ledger(spark, tmp_path):
    quiet = [message("q1", "user", "fine")]
    busy = [message("a", "user", "always use tabs " + "x" * 400), message("b", "assistant", "The build is broken on main")]
    logs = Sessions(spark, write(tmp_path, busy=busy, quiet=quiet), {"observeAfterTokens": 50, "reflectAfterTokens": 50})

    def learn(known):
        return known.groupBy("session_id").agg(F.lit("care is needed").alias("content"), F.collect_list("id").alias("support_ids"))

    got = {(r.session_id, r.kind): r for r in logs.consolidate(3, learn=learn).collect()}
    assert {*got} == {("busy", "observed"), ("busy", "reflected")} and {r.covers_up_to_id for r in got.values()} == {"b"} and {r.batch_no for r in got.values()} == {3}
    seen = json.loads(got["busy", "observed"].data)["observed"]
    assert {o["relevance"] for o in seen} == {"high", "medium"}
    [learnt] = json.loads(got["busy", "reflected"].data)["reflected"]
    assert sorted(learnt["support_ids"]) == sorted(o["id"] for o in seen)


def test_a_stream_that_starts_again_writes_nothing_twice(spark, tmp_path):
    log, out, state = (str(tmp_path / k) for k in ("log", "out", "state"))
    shape = "session_id string, pos long, kind string, tok long"
    done = []

    def work(sessions):
        done.extend(r.session_id for r in sessions.collect())
        return sessions.withColumn("summary", F.lit("made"))

    def run(rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(log)
        found = due.triggers(spark.readStream.schema(shape).parquet(log), 10)
        due.on_triggers(found, work, out, state).trigger(availableNow=True).start().awaitTermination()

    run([("s", 0, "source", 6), ("s", 1, "source", 6), ("t", 0, "source", 6)])
    run([("t", 1, "source", 6), ("s", 2, "marker", 0), ("s", 3, "source", 9)])
    # a late row and one that is delivered twice are not counted
    run([("s", 1, "source", 6), ("s", 0, "source", 6)])
    assert done == ["s", "t"] and sorted(r.session_id for r in spark.read.parquet(out).collect()) == ["s", "t"]


def test_late_rows_are_given(spark, tmp_path):
    log, out, state = (str(tmp_path / k) for k in ("log", "out", "state"))
    shape = "session_id string, pos long, kind string, tok long"
    for rows in ([("s", 5, "source", 4)], [("s", 2, "source", 3), ("s", 3, "marker", 0), ("s", 6, "source", 7)]):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(log)
        found = due.triggers(spark.readStream.schema(shape).parquet(log), 10)
        found.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("s", 2, 3, True), ("s", 6, 11, False)]
