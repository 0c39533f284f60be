"""Star-schema tables seen as message logs, ledgers and support graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions import text


def message_log(conversations: DataFrame) -> DataFrame:
    """(session_id, pos, entry_id, parent_id, role, text, tok): one entry a turn, each one's parent the turn before."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select(
        F.col("conv_id").alias("session_id"),
        (F.row_number().over(own) - 1).cast("long").alias("pos"),
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("entry_id"),
        F.lag("turn").over(own).alias("_before"),
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.select("session_id", "pos", "entry_id", F.concat(F.lit("c"), "session_id", F.lit("-"), "_before").alias("parent_id"), "role", "text", text.tokens(F.col("text")).alias("tok"))


def user_events(events: DataFrame) -> DataFrame:
    """(session_id, pos, event_id, event_type, k, tok, n, ts): a user's events in order; n is how many there are."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("session_id"),
        (F.row_number().over(own) - 1).cast("long").alias("pos"),
        "event_id",
        "event_type",
        (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 10).alias("k"),
        F.ceil("value").cast("long").alias("tok"),
        F.count("*").over(Window.partitionBy("user_id")).alias("n"),
        "ts",
    )


def _id(prefix: str) -> Column:
    return F.concat(F.lit(prefix), "k", F.lit("_"), F.col("event_id") % 2)


def observations(ev: DataFrame) -> DataFrame:
    """Purchases record observations that cover the log up to k + 1 entries before them; rel is 0 (low) to 3."""
    return ev.filter("event_type = 'purchase'").select("session_id", "pos", _id("o").alias("id"), (F.col("k") % 4).alias("rel"), "tok", (F.col("pos") - 1 - F.col("k")).alias("covers"))


def drops(ev: DataFrame) -> DataFrame:
    return ev.filter("event_type = 'error'").select("session_id", "pos", _id("o").alias("id"), (F.col("pos") - 1).alias("covers"))


def reflections(ev: DataFrame) -> DataFrame:
    return ev.filter("event_type = 'signup'").select("session_id", "pos", F.concat(F.lit("r"), "k").alias("id"), F.concat(F.lit("o"), "k", F.lit("_0")).alias("sup"), "tok", (F.col("pos") - 1).alias("covers"))


def sources(ev: DataFrame) -> DataFrame:
    """Views and clicks are source entries."""
    return ev.filter("event_type in ('view', 'click')").select("session_id", "pos", "tok")


def supports(lineitem: DataFrame) -> DataFrame:
    """(reflection, observation): each order is supported by its parts."""
    return lineitem.select(F.col("l_orderkey").alias("reflection"), F.col("l_partkey").alias("observation")).distinct()


#: The adapters in SQL, as other engines read them.
EVENTS_SQL = """
ev as (select user_id as session_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, event_id, event_type,
              cast(regexp_extract(props, '([0-9]+)', 1) as int) % 10 as k, cast(ceil(value) as bigint) as tok,
              count(*) over (partition by user_id) as n, ts from events),
obs as (select session_id, pos, concat('o', k, '_', event_id % 2) as id, k % 4 as rel, tok, pos - 1 - k as covers from ev where event_type = 'purchase'),
drp as (select session_id, pos, concat('o', k, '_', event_id % 2) as id, pos - 1 as covers from ev where event_type = 'error'),
refl as (select session_id, pos, concat('r', k) as id, concat('o', k, '_0') as sup, tok, pos - 1 as covers from ev where event_type = 'signup'),
src as (select session_id, pos, tok from ev where event_type in ('view', 'click')),
sess as (select distinct session_id, n from ev)
"""
LOG_SQL = """
msg as (select conv_id as session_id, row_number() over (partition by conv_id order by turn) - 1 as pos, concat('c', conv_id, '-', turn) as entry_id,
               case when lag(turn) over (partition by conv_id order by turn) is not null
                    then concat('c', conv_id, '-', lag(turn) over (partition by conv_id order by turn)) end as parent_id,
               role, coalesce(text, '') as text, cast(ceil(length(coalesce(text, '')) / 4.0) as bigint) as tok from conversations)
"""
