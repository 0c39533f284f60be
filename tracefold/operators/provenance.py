"""From memories to their sources and back, and what reflections cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions import fixed


def classify(citations: DataFrame, entries: DataFrame) -> DataFrame:
    """Each citation (..., entry) with status resolved, non_source or missing. entries: (entry, is_source), ids unique."""
    known = entries.select("entry", F.col("is_source").alias("_source"))
    return citations.join(known, "entry", "left").withColumn("status", F.when(F.col("_source").isNull(), "missing").when(F.col("_source"), "resolved").otherwise("non_source")).drop("_source")


def status_counts(classified: DataFrame, key: str) -> DataFrame:
    return classified.groupBy(key).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("resolved", "non_source", "missing")))


def citing(observations: DataFrame, entries: DataFrame, *by: str) -> DataFrame:
    """Observations (by, observation, entry) that cite any of the entries (by, entry): (by, observation, matched, entries).

    Ids are unique within ``by`` only: with many sessions, ``session_id``.
    """
    found = observations.join(entries.select(*by, "entry").distinct(), [*by, "entry"], "left_semi").select(*by, "observation", "entry").distinct()
    return found.groupBy(*by, "observation").agg(F.count("*").alias("matched"), F.array_sort(F.collect_list("entry")).alias("entries"))


def supported_by(supports: DataFrame, observations: DataFrame, *by: str) -> DataFrame:
    """Reflections (by, reflection, observation) that any of the observations (by, observation) supports: (by, reflection, matched)."""
    found = supports.join(observations.select(*by, "observation").distinct(), [*by, "observation"], "left_semi").distinct()
    return found.groupBy(*by, "reflection").agg(F.count("*").alias("matched"))


def tier(count: Column) -> Column:
    return F.when(count >= 2, "strong").when(count == 1, "partial").otherwise("none")


def coverage(observations: DataFrame, supports: DataFrame) -> DataFrame:
    """``observations`` with supports (how many reflections cite it) and tier."""
    counts = supports.select("reflection", "observation").distinct().groupBy("observation").agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0)).cast("long")
    return observations.join(counts, "observation", "left").withColumn("supports", n).withColumn("tier", tier(n)).drop("_n")


def transitions(before: DataFrame, after: DataFrame, *by: str) -> DataFrame:
    """How many observations changed tier: (by, before, after, count)."""
    old = before.select("observation", *by, F.col("tier").alias("before"))
    new = after.select("observation", F.col("tier").alias("after"))
    return old.join(new, "observation").filter("before <> after").groupBy(*by, "before", "after").agg(F.count("*").alias("count"))


def coverage_grid(tiers: DataFrame, by: str, values: list | None = None) -> DataFrame:
    """Counts and tokens of observations (by, tier, tok) by both, zeros included: (by, tier, n, tokens).

    ``values``: what stands in ``by``; else what does stand there.
    """
    kinds = F.array(*map(F.lit, fixed.TIERS))
    own = tiers.select(by).distinct() if values is None else tiers.sparkSession.createDataFrame([(v,) for v in values], tiers.select(by).schema)
    sums = tiers.groupBy(by, "tier").agg(F.count("*").alias("n"), F.sum("tok").alias("tokens"))
    grid = own.withColumn("tier", F.explode(kinds)).join(sums, [by, "tier"], "left")
    return grid.select(by, "tier", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def support_stats(supports: DataFrame, *by: str) -> DataFrame:
    """(by, n, total, least, most, mean): reflections (by, reflection, observation), and how many supports they have."""
    each = supports.select(*by, "reflection", "observation").distinct().groupBy(*by, "reflection").agg(F.count("*").alias("_n"))
    stats = F.count("*").alias("n"), F.sum("_n").alias("total"), F.min("_n").alias("least"), F.max("_n").alias("most"), F.avg("_n").alias("mean")
    return each.groupBy(*by).agg(*stats)


def support_histogram(supports: DataFrame) -> DataFrame:
    """How many reflections have how many supports: (supports, reflections)."""
    each = supports.distinct().groupBy("reflection").agg(F.count("*").alias("supports"))
    return each.groupBy("supports").agg(F.count("*").alias("reflections"))


def allowed_ids(proposed: Column, allowed: Column) -> Column:
    """Proposed ids that are allowed, once each, in the order of the allowed ones."""
    return F.array_intersect(allowed, proposed)


def all_known(proposed: Column, known: Column) -> Column:
    """The proposed ids once each, in the order of the known ones, or null if one of them is unknown or there are none."""
    return F.when((F.size(proposed) > 0) & F.forall(proposed, lambda x: F.coalesce(F.array_contains(known, x), F.lit(False))), F.array_intersect(known, proposed))


def proposal_order(proposed: Column, known: Column) -> Column:
    """Known ids among the proposed, once each, in the order of the proposal."""
    return F.array_intersect(proposed, known)
