"""Cuts, runs and caps over ordered logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions import fixed
from tracefold.sources.scratch import Scratch


def lineage(entries: DataFrame, leaves: DataFrame) -> DataFrame:
    """(session_id, entry_id) of all entries on the paths from the leaves to their roots.

    By doubling: a path of n entries takes log2 n rounds of joins, each of which writes what it has found, so that a
    round's plan does not hold those before it. Rounds end when nothing new is found, also in a log with a cycle.
    """
    scratch = Scratch(entries.sparkSession, "lineage")
    step = entries.filter("parent_id is not null").select("session_id", "entry_id", F.col("parent_id").alias("up"))
    found = scratch.table(leaves.join(entries.select("session_id", "entry_id"), ["session_id", "entry_id"], "left_semi").select("session_id", "entry_id").distinct(), "0")
    known, turn = -1, 0
    while (n := found.count()) > known:
        known, turn = n, turn + 1
        above = found.join(step, ["session_id", "entry_id"]).select("session_id", F.col("up").alias("entry_id"))
        found = scratch.table(found.union(above).distinct(), f"{turn}")
        far = step.select("session_id", F.col("entry_id").alias("up"), F.col("up").alias("_far"))
        step = scratch.table(step.join(far, ["session_id", "up"]).select("session_id", "entry_id", F.col("_far").alias("up")).distinct(), f"{turn}-step")
    return found


def own_cut(messages: DataFrame) -> DataFrame:
    """(session_id, live, cut, reason): where a compaction of each session's live messages (session_id, pos, role) cuts.

    The cut is the last user message; without one after the first message everything is compacted, and two messages
    or fewer are left alone. Positions count the live messages.
    """
    own = Window.partitionBy("session_id").orderBy("pos")
    rows = messages.withColumn("_i", (F.row_number().over(own) - 1).cast("long"))
    sums = rows.groupBy("session_id").agg(F.count("*").alias("live"), F.max(F.when(F.col("role") == "user", F.col("_i"))).alias("_user"))
    reason = F.when(F.col("live") <= 2, "too_few_live_messages").when(F.coalesce("_user", F.lit(0)) <= 0, "compact_all").otherwise("cut")
    return sums.select("session_id", "live", F.when(reason == "cut", F.col("_user")).alias("cut"), reason.alias("reason"))


def host_cut(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """own_cut where a host asks to keep everything from an entry on: (session_id, live, cut, reason).

    messages: live ones (session_id, pos, role); asked: (session_id, asked), the asked entry's position in the log,
    null if it isn't there. The cut is the first live message from that position on. If that is the very first one,
    nothing is compacted as long as a later user message could be kept; in all other cases own_cut decides.
    """
    own = Window.partitionBy("session_id").orderBy("pos")
    rows = messages.withColumn("_i", (F.row_number().over(own) - 1).cast("long")).join(asked, "session_id", "left")
    last = F.max(F.when(F.col("role") == "user", F.col("_i")))
    sums = rows.groupBy("session_id").agg(F.min(F.when(F.col("pos") >= F.col("asked"), F.col("_i"))).alias("_at"), F.coalesce(last, F.lit(0)).alias("_user"))
    joined = own_cut(messages).join(sums, "session_id")
    stay = (F.col("_at") == 0) & (F.col("_user") > 0)
    reason = F.when(F.col("_at") > 0, "cut").when(stay, "too_few_live_messages").otherwise(F.col("reason"))
    cut = F.when(F.col("_at") > 0, F.col("_at")).when(stay, F.lit(None)).otherwise(F.col("cut"))
    return joined.select("session_id", "live", cut.alias("cut"), reason.alias("reason"))


def kept_stats(messages: DataFrame, cuts: DataFrame) -> DataFrame:
    """(session_id, summarized, kept, kept_tokens): messages (session_id, pos, text) before and from each session's cut on."""
    own = Window.partitionBy("session_id").orderBy("pos")
    rows = messages.withColumn("_i", F.row_number().over(own) - 1).join(cuts.select("session_id", F.col("cut").alias("_cut")), "session_id")
    kept = F.coalesce(F.col("_i") >= F.col("_cut"), F.lit(False))
    chars = F.sum(F.when(kept, F.char_length("text")).otherwise(0))
    return rows.groupBy("session_id").agg(F.count_if(~kept).alias("summarized"), F.count_if(kept).alias("kept"), F.round(chars / 4).cast("long").alias("kept_tokens"))


def advance(cursors: DataFrame, done: DataFrame) -> DataFrame:
    """Cursors (session_id, stage, entry_id, at, state) after runs ``done`` of the same shape: none ever goes back."""
    both = cursors.withColumn("_new", F.lit(0)).unionByName(done.withColumn("_new", F.lit(1)))
    return both.groupBy("session_id", "stage").agg(F.max(F.struct("at", "_new", "entry_id", "state")).alias("c")).select("session_id", "stage", "c.entry_id", "c.at", "c.state")


def valid_cursors(cursors: DataFrame, entries: DataFrame, coverage: DataFrame) -> DataFrame:
    """(session_id, stage, at, state): cursors (session_id, stage, entry_id, state) whose entry is in the log.

    One whose entry is gone falls back to the stage's furthest coverage (session_id, stage, covered), or goes.
    """
    at = entries.groupBy("session_id", "entry_id").agg(F.max("pos").alias("_pos"))
    rows = cursors.join(at, ["session_id", "entry_id"], "left").join(coverage, ["session_id", "stage"], "left")
    found = rows.select("session_id", "stage", F.coalesce("_pos", "covered").alias("at"), F.when(F.col("_pos").isNotNull(), F.col("state")).otherwise("initial").alias("state"))
    return found.filter("at is not null")


def runs(rows: DataFrame, header: str, order: list[str]) -> DataFrame:
    """``rows`` with ``run``: 0 for the session's first run of equal headers, 1 for the next, and so on."""
    own = Window.partitionBy("session_id").orderBy(*order)
    fresh = F.when(F.lag(header).over(own).eqNullSafe(F.col(header)) & F.lag(F.lit(1)).over(own).isNotNull(), 0).otherwise(1)
    return rows.withColumn("_fresh", fresh).withColumn("run", (F.sum("_fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long")).drop("_fresh")


def collapse(rows: DataFrame, header: str, order: list[str]) -> DataFrame:
    """One row for each run of equal headers: (session_id, run, header, n, refs)."""
    refs = F.transform(F.array_sort(F.collect_list("pos")), lambda p: F.concat(F.lit("#"), p.cast("string")))
    return runs(rows, header, order).groupBy("session_id", "run", header).agg(F.count("*").alias("n"), F.array_join(refs, ", ").alias("refs"))


def keep_last(rows: DataFrame, keys: list[str], most: int = fixed.TOOL_LINES) -> DataFrame:
    """The last rows of each key, and on each how many were left out before them."""
    back = Window.partitionBy(*keys).orderBy(F.desc("pos"))
    counted = rows.withColumn("_rn", F.row_number().over(back)).withColumn("omitted", F.greatest(F.count("*").over(Window.partitionBy(*keys)) - most, F.lit(0)))
    return counted.filter(F.col("_rn") <= most).drop("_rn")


def tail_first(rows: DataFrame, wanted, tail: int = fixed.TAIL_BLOCKS, most: int = fixed.BLOCKERS) -> DataFrame:
    """Of each session's last rows the first that are wanted."""
    back = Window.partitionBy("session_id").orderBy(F.desc("pos"))
    on = Window.partitionBy("session_id").orderBy("pos")
    last = rows.withColumn("_rn", F.row_number().over(back)).filter(F.col("_rn") <= tail).filter(wanted)
    return last.withColumn("item", F.row_number().over(on).cast("long")).filter(F.col("item") <= most).drop("_rn")


def merge_capped(previous, fresh, most: int):
    """Both lists without repetitions, of which the last stay."""
    both = F.array_distinct(F.concat(previous, fresh))
    return F.when(F.size(both) > most, F.slice(both, -most, most)).otherwise(both)


def merge_files(previous: dict, fresh: dict) -> dict:
    """Modified, Created and Read paths of two summaries (array columns): a modified file is neither created nor read."""
    both = {k: F.array_union(previous[k], fresh[k]) for k in ("Modified", "Created", "Read")}
    return {"Modified": both["Modified"], "Created": F.array_except(both["Created"], both["Modified"]), "Read": F.array_except(both["Read"], both["Modified"])}


def next_match(blocks: DataFrame, values, ahead: int = 2):
    """The first of ``values`` (a column, null where nothing matches) within the next ``ahead`` rows of the session."""
    own = Window.partitionBy("session_id").orderBy("pos")
    return blocks.withColumn("matched", F.coalesce(*(F.lead(values, k).over(own) for k in range(1, ahead + 1))))


def cooling(events: DataFrame, opens, seconds: int) -> DataFrame:
    """Events with cooling: whether one that ``opens`` a window came at most ``seconds`` before, in the same session."""
    own = Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(opens, F.col("ts"))).over(own)
    return events.withColumn("opened_at", last).withColumn("cooling", F.coalesce(F.col("ts") < last + F.expr(f"interval {seconds} seconds"), F.lit(False)))
