"""Which observations to drop when the pool is full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fullness below which nothing is dropped, and where the ratio of drops ends to grow; the ratios there (fixed values).
SKIP, FULL, LOW, MEDIUM = 0.10, 1.00, 0.30, 0.60
LEAST_RATIO, MOST_RATIO = 0.10, 0.50


def fullness(tokens: Column, budget: int) -> Column:
    return F.when((tokens > 0) & (F.lit(budget) > 0), tokens / F.lit(float(budget) or 1.0)).otherwise(F.lit(0.0))


def urgency(full: Column) -> Column:
    return F.when(full < LOW, "low").when(full < MEDIUM, "medium").otherwise("high")


def max_drops(droppable: Column, full: Column) -> Column:
    """How many of the droppable observations may go: a share that grows with the fullness, one at least."""
    capped = F.least(F.greatest(full, F.lit(SKIP)), F.lit(FULL))
    ratio = F.lit(LEAST_RATIO) + (capped - SKIP) / (FULL - SKIP) * (MOST_RATIO - LEAST_RATIO)
    return F.when((droppable == 0) | (full < SKIP), 0).otherwise(F.greatest(F.lit(1), F.floor(droppable * ratio))).cast("long")


def pool(observations: DataFrame, budget: int) -> DataFrame:
    """(session_id, tokens, droppable, fullness, urgency, max_drops); rel 3 is critical and never droppable."""
    sums = observations.groupBy("session_id").agg(F.sum("tok").alias("tokens"), F.count_if(F.col("rel") < 3).alias("droppable"))
    full = fullness(F.col("tokens"), budget)
    return sums.select("session_id", "tokens", "droppable", full.alias("fullness"), urgency(full).alias("urgency"), max_drops(F.col("droppable"), full).alias("max_drops"))


def relevance_counts(observations: DataFrame) -> DataFrame:
    return observations.groupBy("session_id").agg(*(F.count_if(F.col("rel") == k).alias(name) for k, name in enumerate(("low", "medium", "high", "critical"))))


def candidates(observations: DataFrame, budget: int) -> DataFrame:
    """The observations (session_id, id, rel, tok, pos, supports) to drop: best covered first, then least relevant, then oldest.

    Unknown ages come last. Only as many as the session's pool allows.
    """
    rank = F.when(F.col("supports") >= 2, 0).when(F.col("supports") == 1, 1).otherwise(2)
    own = Window.partitionBy("session_id").orderBy(rank, "rel", F.col("pos").asc_nulls_last(), "id")
    rows = observations.withColumn("drop_rank", F.row_number().over(own)).join(pool(observations, budget).select("session_id", "max_drops"), "session_id")
    return rows.filter("drop_rank <= max_drops")
