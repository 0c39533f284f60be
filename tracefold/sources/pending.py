"""Memory batches that wait to be written to the ledger, and models that cool down, as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.sources.session_log import append

#: The order in which kinds are flushed.
KINDS = ("observed", "reflected", "dropped")
SCHEMA = "session_id string, kind string, batch_no long, covers_up_to_id string, data string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Waiting batches; those of an unknown kind, or without data or the entry that they cover, are left out."""
    rows = spark.read.schema(SCHEMA).json(path)
    return rows.filter(F.col("kind").isin(*KINDS) & F.col("session_id").isNotNull() & F.col("data").isNotNull() & (F.trim("covers_up_to_id") != ""))


def stage(batches: DataFrame, path: str) -> None:
    batches.select("session_id", "kind", "batch_no", "covers_up_to_id", "data").write.mode("append").json(path)


def sessions(batches: DataFrame) -> DataFrame:
    return batches.select("session_id").distinct()


def latest(batches: DataFrame) -> DataFrame:
    """The last batch of each session and kind."""
    return batches.groupBy("session_id", "kind").agg(F.max(F.struct("batch_no", "covers_up_to_id", "data")).alias("b")).select("session_id", "kind", "b.*")


def flush_order(batches: DataFrame) -> DataFrame:
    """All batches, each once, with ``place``: observations, then reflections, then drops, in the order of their numbers."""
    once = batches.dropDuplicates(["session_id", "kind", "batch_no"])
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(kind, "batch_no")))


def batch(records: DataFrame, kind: str, covers: DataFrame) -> DataFrame:
    """Records (session_id, ...) of a kind as one waiting batch a session, which covers up to an entry.

    covers: (session_id, batch_no, covers_up_to_id); sessions without records get no batch.
    """
    fields = [c for c in records.columns if c != "session_id"]
    held = records.groupBy("session_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(*fields))).alias(kind))).alias("data"))
    return held.join(covers, "session_id").select("session_id", F.lit(kind).alias("kind"), "batch_no", "covers_up_to_id", "data")


def replace(df: DataFrame, path: str) -> None:
    """Puts a table in the place of another: written beside it, then moved, so that readers find the old one or the new.

    The table that was there is kept beside it, as ``path``.stale, until the next time.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").json(f"{path}.new")
    jvm = spark.sparkContext._jvm
    place = lambda suffix: jvm.org.apache.hadoop.fs.Path(path + suffix)
    files = place("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(place(".stale"), True)
    if files.exists(place("")):
        files.rename(place(""), place(".stale"))
    files.rename(place(".new"), place(""))


def flush(spark: SparkSession, path: str, ledger: str) -> int:
    """Writes waiting batches to a ledger, observations first, and clears them; how many were written.

    A batch that is in the ledger is not written again, so a flush that broke off after writing is finished by the next.
    What was staged meanwhile stays, as only the files that were read are removed.
    """
    waiting = read(spark, path)
    files = waiting.inputFiles()
    fresh = flush_order(waiting)
    jvm = spark.sparkContext._jvm
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if place(ledger).getFileSystem(conf).exists(place(ledger)):
        done = spark.read.schema(SCHEMA + ", place int").parquet(ledger)
        fresh = fresh.join(done.select("session_id", "kind", "batch_no"), ["session_id", "kind", "batch_no"], "left_anti")
    fresh = fresh.select("session_id", "kind", "batch_no", "covers_up_to_id", "data", "place").persist()
    n = fresh.count()
    if n:
        append(fresh, ledger)
    fresh.unpersist()
    for f in files:
        place(f).getFileSystem(conf).delete(place(f), False)
    return n


def ready(sessions: DataFrame, attempts: DataFrame, now: Column, seconds: int = 30, most: int = 10) -> DataFrame:
    """Sessions that may run now: none that is running, failed within ``seconds``, or failed ``most`` times in a row.

    attempts: (session_id, at, outcome), outcome ``running``, ``failed`` or ``done``.
    """
    last = attempts.groupBy("session_id").agg(F.max(F.struct("at", "outcome")).alias("l"), F.max(F.when(F.col("outcome") == "done", F.col("at"))).alias("_done"))
    failed = attempts.filter("outcome = 'failed'").join(last.select("session_id", "_done"), "session_id").filter("_done is null or at > _done")
    failed = failed.groupBy("session_id").agg(F.count("*").alias("_failed"))
    rows = last.join(failed, "session_id", "left")
    soon = (F.col("l.outcome") == "failed") & (F.col("l.at") + F.make_dt_interval(secs=F.lit(seconds)) > now)
    held = rows.filter((F.col("l.outcome") == "running") | soon | (F.coalesce("_failed", F.lit(0)) >= most))
    return sessions.join(held.select("session_id"), "session_id", "left_anti")


def cooldowns(failures: DataFrame, hours: float = 1.0) -> DataFrame:
    """(model, until): failures (model, at) start a cooldown; with 0 hours there is none."""
    until = F.max("at") + F.make_dt_interval(secs=F.lit(hours * 3600))
    return failures.filter(F.lit(hours) > 0).groupBy("model").agg(until.alias("until"))


def active(cooling: DataFrame, now: Column) -> DataFrame:
    return cooling.filter(F.col("until") > now)
