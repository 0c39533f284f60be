"""Source entries as text, for extractors and for recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.sources import session_log

OMITTED = "[non-text content omitted]"
NO_TIME, UNKNOWN_TIME = "????-??-?? ??:??", "Unknown time"


def minute(*values: Column, missing: str = NO_TIME) -> Column:
    """The first value that is a time, to the minute; values are ISO strings or milliseconds as text."""
    parsed = [F.when(v.rlike(r"^\d+(\.\d+)?$"), F.timestamp_millis(v.cast("double").cast("long"))).otherwise(F.try_to_timestamp(v)) for v in values]
    return F.coalesce(F.date_format(F.coalesce(*parsed), "yyyy-MM-dd HH:mm"), F.lit(missing))


def _body(content: str, thinking: bool) -> Column:
    """All parts of a content; what is no text has a placeholder, and redacted thinking goes where ``thinking`` shows the rest."""

    def shown(p: Column) -> Column:
        call = F.concat(F.lit("["), p["name"], F.lit("("), F.coalesce(p["arguments"], F.lit("{}")), F.lit(")]"))
        found = F.when((p["type"] == "text") & p["text"].isNotNull(), p["text"]).when((p["type"] == "toolCall") & p["name"].isNotNull(), call)
        if thinking:
            found = found.when((p["type"] == "thinking") & F.coalesce(p["redacted"], F.lit(False)), F.lit(None)).when((p["type"] == "thinking") & p["thinking"].isNotNull(), F.concat(F.lit("[thinking: "), p["thinking"], F.lit("]")))
        return found.otherwise(F.lit(OMITTED))

    return F.coalesce(F.array_join(F.transform(session_log._parts(content), shown), "\n"), F.lit(OMITTED))


def _texts(content: str) -> Column:
    return F.coalesce(F.array_join(F.transform(F.filter(session_log._parts(content), lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "\n"), F.lit(""))


def _no_blank_lines(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: x != ""), "\n")


def rendered(log: DataFrame, recall: bool = False) -> DataFrame:
    """(session_id, pos, entry_id, line) for each source entry that has something to show.

    ``recall`` takes the message's own time first and shows placeholders for what is no text.
    """
    own = F.try_variant_get("v", "$.message.timestamp", "string")
    missing = UNKNOWN_TIME if recall else NO_TIME
    spoken = minute(own, F.col("ts"), missing=missing) if recall else minute(own, missing=missing)
    noted = minute(F.col("ts"), missing=missing)
    role, tool = session_log._string("v", "$.message.role"), F.coalesce(session_log._string("v", "$.message.toolName"), F.lit("undefined"))
    said = _body("$.message.content", False) if recall else _texts("$.message.content")
    full = _no_blank_lines(_body("$.message.content", True))
    at = lambda who, when, text: F.concat(F.lit("["), who, F.lit(" @ "), when, F.lit("]: "), text)
    message = F.when(role == "user", at(F.lit("User"), spoken, said)).when(role == "assistant", F.when(full != "", at(F.lit("Assistant"), spoken, full)))
    message = message.when(role.isNotNull(), at(F.concat(F.lit("Tool result: " if recall else "Tool result for "), tool), spoken, said))
    label = "Custom message" if recall else "Custom"
    origin = F.when(F.coalesce("custom_type", F.lit("")) != "", F.concat(F.lit(f"{label} ("), "custom_type", F.lit(")"))).otherwise(label)
    line = (
        F.when(F.col("type") == "message", message)
        .when(F.col("type") == "custom_message", at(origin, noted, _body("$.content", False) if recall else _texts("$.content")))
        .when(F.col("type") == "branch_summary", F.when(F.col("summary").isNotNull(), at(F.lit("Branch summary"), noted, F.col("summary"))))
    )
    return log.select("session_id", "pos", "entry_id", line.alias("line")).filter(F.trim("line") != "")


def addressed(log: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(session_id, text, source_ids): each session's entries with their ids before them, in order.

    ``entries`` (session_id, pos) chooses those to show, as a budget has left them.
    """
    rows = rendered(log).filter(F.col("entry_id").isNotNull())
    if entries is not None:
        rows = rows.join(entries.select("session_id", "pos"), ["session_id", "pos"], "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("pos", "entry_id", "line")))
    text = F.array_join(F.transform(F.col("rows"), lambda r: F.concat(F.lit("[Source entry id: "), r["entry_id"], F.lit("]\n"), r["line"])), "\n\n")
    return rows.groupBy("session_id").agg(listed.alias("rows")).select("session_id", text.alias("text"), F.col("rows.entry_id").alias("source_ids"))


def observation_line(rows: DataFrame) -> Column:
    """An observation (id, timestamp, relevance, content) as a line, with its coverage where ``rows`` has a tier."""
    head = [F.lit("["), F.col("id"), F.lit("] "), F.col("timestamp"), F.lit(" ["), F.col("relevance"), F.lit("] ")]
    tier = [F.lit("[coverage: "), F.col("tier"), F.lit("] ")] if "tier" in rows.columns else []
    return F.concat(*head, *tier, F.col("content"))
