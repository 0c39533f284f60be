"""The memory ledger: folds, coverage clocks, projections and budgets over many sessions at once.

Every relation carries (session_id, pos); order is always that of ``pos``. A session is the key of all windows and
joins, so sessions spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(own)).filter("_rn = 1").drop("_rn")


def until(rows: DataFrame, bound: DataFrame | None, column: str) -> DataFrame:
    """Rows whose ``column`` is at or before the session's bound (session_id, upto)."""
    if bound is None:
        return rows
    b = bound.select("session_id", F.col("upto").alias("_upto"))
    return rows.join(b, "session_id").filter(F.col(column) <= F.col("_upto")).drop("_upto")


def fold(observations: DataFrame, drops: DataFrame, upto: DataFrame | None = None) -> DataFrame:
    """Active observations: the first record of each id, without those that a drop names, whenever it was written.

    ``upto`` bounds the positions of the entries that count (session_id, upto).
    """
    first = keep_first(until(observations, upto, "pos"), ["session_id", "id"], ["pos"])
    return first.join(until(drops, upto, "pos").select("session_id", "id").distinct(), ["session_id", "id"], "left_anti")


def latest_coverage(markers: DataFrame) -> DataFrame:
    """(session_id, covered, marker_pos): the furthest position that a marker covers, and the first marker that does.

    Markers that cover no entry (covers < 0) do not count.
    """
    return (
        markers.filter("covers >= 0")
        .groupBy("session_id")
        .agg(F.max(F.struct("covers", (-F.col("pos")).alias("back"))).alias("m"))
        .select("session_id", F.col("m.covers").alias("covered"), (-F.col("m.back")).alias("marker_pos"))
    )


def tokens_after(sources: DataFrame, cursor: DataFrame) -> DataFrame:
    """(session_id, tokens): what the source entries after the session's cursor (session_id, at) hold; from the start without one."""
    c = cursor.select("session_id", F.col("at").alias("_at"))
    late = F.when(F.col("pos") > F.coalesce("_at", F.lit(-1)), F.col("tok")).otherwise(0)
    return sources.join(c, "session_id", "left").groupBy("session_id").agg(F.sum(late).alias("tokens"))


def tokens_since_coverage(sources: DataFrame, markers: DataFrame) -> DataFrame:
    return tokens_after(sources, latest_coverage(markers).select("session_id", F.col("covered").alias("at")))


def tokens_since_compaction(sources: DataFrame, compactions: DataFrame, entries: DataFrame) -> DataFrame:
    """Tokens from the last compaction's first kept entry on, or after the compaction if that entry is unknown.

    compactions: (session_id, pos, first_kept_entry_id). entries: (session_id, pos, entry_id).
    """
    last = compactions.groupBy("session_id").agg(F.max(F.struct("pos", "first_kept_entry_id")).alias("c"))
    kept = entries.select(F.col("session_id"), F.col("pos").alias("_kept"), F.col("entry_id").alias("_id"))
    at = last.join(kept, (last["session_id"] == kept["session_id"]) & (F.col("c.first_kept_entry_id") == F.col("_id")), "left").select(last["session_id"], F.coalesce(F.col("_kept") - 1, F.col("c.pos")).alias("at"))
    return tokens_after(sources, at)


def earlier(first: Column, second: Column) -> Column:
    """The lesser of two positions, either of which may be missing."""
    return F.least(F.coalesce(first, second), F.coalesce(second, first))


def created_after(records: DataFrame, cursor: DataFrame) -> DataFrame:
    """First records of each id among the entries after the cursor (session_id, at)."""
    c = cursor.select("session_id", F.col("at").alias("_at"))
    late = records.join(c, "session_id", "left").filter(F.col("pos") > F.coalesce("_at", F.lit(-1))).drop("_at")
    return keep_first(late, ["session_id", "id"], ["pos"])


def _covered(rows: DataFrame, bound: DataFrame) -> DataFrame:
    return until(rows.filter("covers >= 0"), bound, "covers")


def project(observations: DataFrame, reflections: DataFrame, drops: DataFrame, bounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations and reflections as they stand where each kind's coverage ends.

    bounds: (session_id, obs_upto, refl_upto, drop_upto); a missing one lets nothing through. What counts is what a
    marker covers, not where it stands.
    """
    of = lambda c: bounds.select("session_id", F.col(c).alias("upto"))
    gone = _covered(drops, of("drop_upto")).select("session_id", "id").distinct()
    first = keep_first(_covered(observations, of("obs_upto")), ["session_id", "id"], ["pos"])
    return first.join(gone, ["session_id", "id"], "left_anti"), keep_first(_covered(reflections, of("refl_upto")), ["session_id", "id"], ["pos"])


def compaction_projection(observations: DataFrame, reflections: DataFrame, drops: DataFrame, cuts: DataFrame, pool: int) -> tuple[DataFrame, DataFrame]:
    """The projection for a compaction at each session's cut, with column full_fold.

    cuts: (session_id, cut, full_cut). Reflections and drops count up to the last full fold only, until the
    observations fill the pool; then everything is folded anew up to the cut.
    """
    normal = project(observations, reflections, drops, cuts.select("session_id", F.col("cut").alias("obs_upto"), F.col("full_cut").alias("refl_upto"), F.col("full_cut").alias("drop_upto")))
    full = project(observations, reflections, drops, cuts.select("session_id", *(F.col("cut").alias(c) for c in ("obs_upto", "refl_upto", "drop_upto"))))
    held = normal[0].groupBy("session_id").agg(F.sum("tok").alias("_held"))
    switch = cuts.select("session_id").join(held, "session_id", "left").select("session_id", (F.coalesce("_held", F.lit(0)) >= pool).alias("full_fold"))
    pick = lambda k: normal[k].join(switch.filter("not full_fold"), "session_id").unionByName(full[k].join(switch.filter("full_fold"), "session_id"))
    return pick(0), pick(1)


def diff(visible: DataFrame, full: DataFrame, key: list[str]) -> DataFrame:
    """Rows of either side that the other lacks, with column side: only_full or only_visible."""
    late = full.join(visible.select(*key).distinct(), key, "left_anti").select(*key, F.lit("only_full").alias("side"))
    gone = visible.join(full.select(*key).distinct(), key, "left_anti").select(*key, F.lit("only_visible").alias("side"))
    return late.unionByName(gone)


def select_prior(observations: DataFrame, budget: int, cost: Column) -> DataFrame:
    """What fits a budget of tokens: high and critical always (rel >= 2), then medium and low by score up to the first that does not fit.

    A score is the relevance's base and a recency from 0 to 1 among the medium and low ones.
    """
    rows = observations.withColumn("cost", cost).withColumn("_top", F.col("rel") >= 2)
    rest = Window.partitionBy("session_id", "_top")
    place, size = F.row_number().over(rest.orderBy("pos", "id")) - 1, F.count("*").over(rest)
    recency = F.when(size > 1, place / (size - 1)).otherwise(F.lit(1.0))
    rows = rows.withColumn("score", F.when(F.col("_top"), F.lit(10.0)).otherwise(F.when(F.col("rel") == 1, 5.0).otherwise(1.0) + recency))
    spent = F.coalesce(F.sum(F.when(F.col("_top"), F.col("cost"))).over(Window.partitionBy("session_id")), F.lit(0))
    running = F.sum("cost").over(rest.orderBy(F.desc("score"), "pos", "id").rowsBetween(Window.unboundedPreceding, 0))
    # costs are positive, so a running sum within the budget is a prefix
    rows = rows.withColumn("_spent", spent).withColumn("_run", running)
    return rows.filter(F.col("_top") | (F.col("_spent") + F.col("_run") <= budget)).drop("_top", "_spent", "_run")


def cap_newest(entries: DataFrame, budget: int) -> DataFrame:
    """The newest entries of each session within a budget of tokens; the newest one always."""
    back = Window.partitionBy("session_id").orderBy(F.desc("pos"))
    rows = entries.withColumn("_run", F.sum("tok").over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rn", F.row_number().over(back))
    return rows.filter((F.col("_run") <= budget) | (F.col("_rn") == 1)).drop("_run", "_rn")


def cap_oldest(lines: DataFrame, budget: int) -> DataFrame:
    """The first lines of each session within a budget of tokens; the first one always."""
    on = Window.partitionBy("session_id").orderBy("pos", "id")
    rows = lines.withColumn("_run", F.sum("tok").over(on.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rn", F.row_number().over(on))
    return rows.filter((F.col("_run") <= budget) | (F.col("_rn") == 1)).drop("_run", "_rn")


def merge_records(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Both sets of records (session_id, id, ...); of one id the existing record stays."""
    both = existing.withColumn("_turn", F.lit(0)).unionByName(fresh.withColumn("_turn", F.lit(1)))
    return keep_first(both, ["session_id", "id"], ["_turn", "pos"]).drop("_turn")
