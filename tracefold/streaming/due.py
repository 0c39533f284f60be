"""Which sessions are due for observation, reflection, dropping or compaction: in batch and on a stream."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracefold.operators import dropping, ledger


def due(sources: DataFrame, markers: dict[str, DataFrame], active: DataFrame, config: dict, cursors: DataFrame | None = None, pending: DataFrame | None = None) -> DataFrame:
    """(session_id, observe, reflect, drop): stages whose thresholds the session has passed.

    markers: observed, reflected and dropped (session_id, pos, covers); active: observations (session_id, rel, tok).
    cursors: (session_id, stage, at), stage as in markers: how far a stage has got. Its tokens count from there, and
    reflecting and dropping need a marker after it that covers something after it. A stage without a cursor counts from
    its markers' coverage, and without these from the beginning of the log.
    pending: batches that are not in the log yet (session_id, kind, covers, tok); they count as markers, and their
    observations fill the pool. Dropping also starts under pressure of the pool.
    """
    spark = sources.sparkSession
    none = lambda shape: spark.createDataFrame([], shape)
    kind = sources.schema["session_id"].dataType.simpleString()
    cursors = none(f"session_id {kind}, stage string, at long") if cursors is None else cursors
    pending = none(f"session_id {kind}, kind string, covers long, tok long") if pending is None else pending
    rows = sources.select("session_id").distinct()
    for stage, own in markers.items():
        cursor = cursors.filter(F.col("stage") == stage).select("session_id", F.col("at").alias("_at"))
        covered = ledger.latest_coverage(own).select("session_id", "covered")
        at = covered.join(cursor, "session_id", "full_outer").select("session_id", F.coalesce("_at", "covered").alias("at"))
        tokens = ledger.tokens_after(sources, at).withColumnRenamed("tokens", stage)
        rows = rows.join(tokens, "session_id").join(cursor.withColumnRenamed("_at", f"{stage}_at"), "session_id", "left")
        feeds = {"observed": [], "reflected": ["observed"], "dropped": ["observed", "reflected"]}[stage]
        if feeds:
            seen = reduce(DataFrame.unionByName, [markers[k].select("session_id", "pos", "covers") for k in feeds]).join(cursor, "session_id")
            seen = seen.filter("pos > _at and not (covers >= 0 and covers <= _at)").select("session_id")
            waiting = pending.filter(F.col("kind").isin(*feeds)).join(cursor, "session_id").filter("covers > _at").select("session_id")
            rows = rows.join(seen.union(waiting).distinct().withColumn(f"{stage}_fresh", F.lit(True)), "session_id", "left")
    held = dropping.pool(active, config["observationsPoolMaxTokens"]).select("session_id", F.col("tokens").alias("held"))
    more = pending.groupBy("session_id").agg(F.sum(F.when(F.col("kind") == "observed", F.col("tok")).otherwise(0)).alias("more"), F.count_if(F.col("kind") != "dropped").alias("waiting"))
    rows = rows.join(held, "session_id", "left").join(more, "session_id", "left").fillna({"held": 0, "more": 0, "waiting": 0, "reflected_fresh": False, "dropped_fresh": False})
    full = F.col("held") + F.col("more")
    pressure = full >= config["dropperPressureThreshold"] * config["reflectorInputMaxTokens"]
    enough = lambda stage: F.col(stage) >= config["reflectAfterTokens"]
    ready = lambda stage: enough(stage) & (F.col(f"{stage}_at").isNull() | F.col(f"{stage}_fresh"))
    most = config["observationsPoolMaxTokens"]
    fullness = full / most if most > 0 else F.lit(0.0)
    drop = (fullness >= dropping.SKIP) & (pressure | (F.col("dropped_at").isNull() & (F.col("waiting") > 0)) | ready("dropped"))
    return rows.select("session_id", (F.col("observed") >= config["observeAfterTokens"]).alias("observe"), ready("reflected").alias("reflect"), drop.alias("drop"))


def triggers(stream: DataFrame, threshold: int) -> DataFrame:
    """(session_id, pos, tokens, late): where a session's source tokens since its last trigger or marker reach the threshold.

    The stream has (session_id, pos, kind, tok), kind ``source`` or ``marker``. The state of a session is the tokens
    since its cursor and the last position, so it stays small however long the session is. Rows of a micro-batch are
    taken in order of position. A source row at or before the last position is late, or delivered twice; it is not
    counted, as no state could tell, but given as it is: late is true, and tokens are the row's own.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (0, -1)
        out = []
        rows = pd.concat(list(batches)).sort_values("pos")
        for pos, kind, tok in zip(rows["pos"], rows["kind"], rows["tok"], strict=True):
            if pos <= last:
                if kind == "source":
                    out.append((key[0], int(pos), int(tok), True))
                continue
            last = int(pos)
            tokens = 0 if kind == "marker" else tokens + int(tok)
            if tokens >= threshold:
                out.append((key[0], last, tokens, False))
                tokens = 0
        state.update((tokens, last))
        yield pd.DataFrame(out, columns=["session_id", "pos", "tokens", "late"])

    kind = stream.schema["session_id"].dataType.simpleString()
    return stream.select("session_id", "pos", "kind", "tok").groupBy("session_id").applyInPandasWithState(step, f"session_id {kind}, pos long, tokens long, late boolean", "tokens long, last long", "append", GroupStateTimeout.NoTimeout)


def triggers_batch(rows: DataFrame, threshold: int) -> DataFrame:
    """The same over a finished table, read in order of position: a session streams through, and is never held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tokens = None, 0
        for rows in batches:
            out = []
            for session, pos, kind, tok in zip(rows["session_id"], rows["pos"], rows["kind"], rows["tok"], strict=True):
                if session != now:
                    now, tokens = session, 0
                tokens = 0 if kind == "marker" else tokens + int(tok)
                if tokens >= threshold:
                    out.append((session, pos, tokens))
                    tokens = 0
            yield pd.DataFrame(out, columns=["session_id", "pos", "tokens"])

    kind = rows.schema["session_id"].dataType.simpleString()
    ordered = rows.select("session_id", "pos", "kind", "tok").repartition("session_id").sortWithinPartitions("session_id", "pos")
    return ordered.mapInPandas(run, f"session_id {kind}, pos long, tokens long")


def on_triggers(found: DataFrame, work, path: str, checkpoint: str):
    """A stream's triggers as work for their sessions: a writer to start, of one table of results.

    ``work`` takes the sessions of a micro-batch (session_id) and returns what to write; it reads the logs as they are
    then, so it checks again whether a session is due. A micro-batch that is run again after a failure replaces what it
    wrote, in a folder with its number, so nothing is written twice.
    """

    def run(rows: DataFrame, number: int) -> None:
        work(rows.filter("not late").select("session_id").distinct()).write.mode("overwrite").parquet(f"{path}/run={number}")

    return found.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def compact_due(sources: DataFrame, compactions: DataFrame, entries: DataFrame, config: dict) -> DataFrame:
    """(session_id, tokens) of sessions whose tokens since the last compaction pass the threshold."""
    since = ledger.tokens_since_compaction(sources, compactions, entries)
    return since.filter(F.col("tokens") >= config["compactAfterTokens"]) if config["compaction"] == "auto" else since.limit(0)
