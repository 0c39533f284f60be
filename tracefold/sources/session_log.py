"""Session logs: JSON lines to entries, and entries to memory events.

A log is a folder or a set of files, one a session; an entry's position is its line among the session's valid lines.
Lines that are blank or no JSON are counted and skipped, records that fail their checks are skipped whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.functions import fixed

_OBSERVATION = "struct<id:string,content:string,timestamp:string,relevance:string,sourceEntryIds:array<string>,tokenCount:double>"
_REFLECTION = "struct<id:string,content:string,supportingObservationIds:array<string>,tokenCount:double>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, line, raw): all lines of each file, numbered; a session is named like its file."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.jsonl)?$", 1)
    # Files are read in splits. Numbers that rise within a task keep the order there, the split's place that of the splits.
    read = spark.read.option("lineSep", "\n").text(path)
    rows = read.select(F.url_decode(name).alias("session_id"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("raw"))
    at = F.row_number().over(Window.partitionBy("session_id").orderBy("_block", "_at")) - 1
    return rows.select("session_id", at.alias("line"), "raw")


def bad_lines(rows: DataFrame) -> DataFrame:
    """(session_id, bad): lines that hold something, but no JSON object."""
    parsed = F.try_parse_json("raw")
    return rows.filter("trim(raw) <> ''").groupBy("session_id").agg(F.count_if(parsed.isNull()).alias("bad"))


def _string(v: Column | str, path: str) -> Column:
    """The string at a path; null for what is no string."""
    v = F.col(v) if isinstance(v, str) else v
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, path, "string"))


def entries(rows: DataFrame) -> DataFrame:
    """(session_id, pos, entry_id, parent_id, type, ts, v, ...): one row for each valid line."""
    valid = rows.withColumn("v", F.try_parse_json("raw")).filter("v is not null")
    at = F.expr("row_number() over (partition by session_id order by line) - 1").cast("long")
    names = {"entry_id": "id", "parent_id": "parentId", "type": "type", "ts": "timestamp", "custom_type": "customType", "summary": "summary", "first_kept_entry_id": "firstKeptEntryId"}
    return valid.select("session_id", at.alias("pos"), *(_string("v", f"$.{path}").alias(c) for c, path in names.items()), "v").withColumn("is_source", F.coalesce(F.col("type").isin(*fixed.SOURCE_TYPES), F.lit(False)))


def _parts(content: str) -> Column:
    """The parts of a content array; a string is one text part, anything else none."""
    as_array = F.try_variant_get("v", content, "array<variant>")
    text = _string("v", content)
    fields = {"type": "type", "text": "text", "thinking": "thinking", "mime_type": "mimeType", "name": "name"}
    made = lambda p: F.struct(*(_string(p, f"$.{path}").alias(c) for c, path in fields.items()), F.try_variant_get(p, "$.redacted", "boolean").alias("redacted"), F.try_variant_get(p, "$.arguments", "string").alias("arguments"))
    none = F.lit(None).cast("string")
    one = F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.alias("thinking"), none.alias("mime_type"), none.alias("name"), F.lit(None).cast("boolean").alias("redacted"), none.alias("arguments")))
    return F.when(as_array.isNotNull(), F.transform(as_array, made)).when(text.isNotNull(), one)


def messages(log: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(session_id, pos, message_index, entry_id, role, parts, ...): numbered among all messages of the session.

    ``allowed`` (session_id, entry_id) keeps a lineage's messages; their numbers stay those of the whole log.
    """
    rows = log.filter("type = 'message'").filter(F.try_variant_get("v", "$.message", "variant").isNotNull())
    at = F.expr("row_number() over (partition by session_id order by pos) - 1").cast("long")
    names = {"role": "role", "tool_name": "toolName", "command": "command", "output": "output"}
    found = rows.select(
        "session_id", "pos", at.alias("message_index"), "entry_id", "ts", *(_string("v", f"$.message.{path}").alias(c) for c, path in names.items()),
        F.coalesce(F.try_variant_get("v", "$.message.isError", "boolean"), F.lit(False)).alias("is_error"), F.try_variant_get("v", "$.message.exitCode", "int").alias("exit_code"), _parts("$.message.content").alias("parts"),
    )
    text = F.array_join(F.transform(F.filter("parts", lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    found = found.withColumn("text", F.coalesce(text, F.lit("")))
    return found if allowed is None else found.join(allowed.select("session_id", "entry_id").distinct(), ["session_id", "entry_id"], "left_semi")


def entry_tokens(log: DataFrame) -> DataFrame:
    """(session_id, pos, entry_id, is_source, tok): four characters a token, rounded up for each part of the content."""
    content = F.when(F.col("type") == "message", F.transform(_parts("$.message.content"), lambda p: F.coalesce(p["text"], p["thinking"], p["arguments"], F.lit(""))))
    other = F.when(F.col("type") == "custom_message", F.transform(_parts("$.content"), lambda p: F.coalesce(p["text"], F.lit("")))).when(F.col("type") == "branch_summary", F.array(F.coalesce("summary", F.lit(""))))
    strings = F.coalesce(content, other, F.array().cast("array<string>"))
    total = F.aggregate(F.transform(strings, lambda s: F.ceil(F.char_length(s) / F.lit(4.0)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return log.select("session_id", "pos", "entry_id", "is_source", total.alias("tok"))


def _filled(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


def _records(log: DataFrame, kind: str, key: str, shape: str, check) -> DataFrame:
    rows = log.filter((F.col("type") == "custom") & (F.col("custom_type") == kind))
    data = rows.select("session_id", "pos", F.try_variant_get("v", f"$.data.{key}", f"array<{shape}>").alias("records"), _string("v", "$.data.coversUpToId").alias("covers_id"))
    # one bad record makes the whole entry invalid
    valid = data.filter(F.col("covers_id").isNotNull() & (F.size("records") > 0)).filter(F.forall("records", check))
    return valid.select("session_id", "pos", "covers_id", F.posexplode("records").alias("idx", "r"))


def _covers(events: DataFrame, log: DataFrame) -> DataFrame:
    """The position of the entry that an event covers up to; -1 if it isn't there."""
    at = log.groupBy("session_id", F.col("entry_id").alias("covers_id")).agg(F.max("pos").alias("covers"))
    return events.join(at, ["session_id", "covers_id"], "left").withColumn("covers", F.coalesce("covers", F.lit(-1)).cast("long"))


def observation_events(log: DataFrame) -> DataFrame:
    ok = lambda r: r["id"].rlike("^[0-9a-f]{12}$") & _filled(r["content"]) & _filled(r["timestamp"]) & r["relevance"].isin(*fixed.RELEVANCE) & (F.size(r["sourceEntryIds"]) > 0) & F.forall(r["sourceEntryIds"], _filled) & (r["tokenCount"] >= 0)
    rel = F.array_position(F.array(*map(F.lit, fixed.RELEVANCE)), F.col("r.relevance")) - 1
    rows = _records(log, fixed.OBSERVED, "observations", _OBSERVATION, lambda r: F.coalesce(ok(r), F.lit(False)))
    return _covers(rows.select("session_id", "pos", "covers_id", "idx", "r.id", "r.content", "r.timestamp", "r.relevance", rel.alias("rel"), F.col("r.sourceEntryIds").alias("source_ids"), F.col("r.tokenCount").cast("long").alias("tok")), log)


def reflection_events(log: DataFrame) -> DataFrame:
    ok = lambda r: r["id"].rlike("^[0-9a-f]{12}$") & _filled(r["content"]) & ~r["content"].contains("\n") & (F.size(r["supportingObservationIds"]) > 0) & (r["tokenCount"] >= 0)
    rows = _records(log, fixed.REFLECTED, "reflections", _REFLECTION, lambda r: F.coalesce(ok(r), F.lit(False)))
    return _covers(rows.select("session_id", "pos", "covers_id", "idx", "r.id", "r.content", F.col("r.supportingObservationIds").alias("support_ids"), F.col("r.tokenCount").cast("long").alias("tok")), log)


def drop_events(log: DataFrame) -> DataFrame:
    rows = _records(log, fixed.DROPPED, "observationIds", "string", lambda r: F.coalesce(_filled(r), F.lit(False)))
    return _covers(rows.select("session_id", "pos", "covers_id", "idx", F.col("r").alias("id")), log)


def markers(log: DataFrame, kind: str) -> DataFrame:
    """(session_id, pos, covers): entries of a kind that count for clocks.

    They name an entry that they cover and hold some records, of whatever shape: a record that fails its checks keeps an
    entry out of the memory, but what it covers has been read.
    """
    key = {fixed.OBSERVED: "observations", fixed.REFLECTED: "reflections", fixed.DROPPED: "observationIds"}[kind]
    rows = log.filter((F.col("type") == "custom") & (F.col("custom_type") == kind))
    held = F.size(F.try_variant_get("v", f"$.data.{key}", "array<variant>"))
    found = rows.select("session_id", "pos", _string("v", "$.data.coversUpToId").alias("covers_id"), held.alias("_n"))
    return _covers(found.filter("covers_id is not null and _n > 0").drop("_n"), log)


def compactions(log: DataFrame) -> DataFrame:
    """(session_id, pos, first_kept_entry_id, summary, full_fold): details may be nested under their type."""
    fold = F.coalesce(F.try_variant_get("v", "$.details.fullFold", "boolean"), F.try_variant_get("v", "$.details['om.folded'].fullFold", "boolean"), F.lit(False))
    return log.filter("type = 'compaction'").select("session_id", "pos", "first_kept_entry_id", "summary", fold.alias("full_fold"))


def append(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Adds records to a table in a fixed number of folders, each with the sessions whose hash falls there.

    So an addition writes at most ``buckets`` files, however many sessions it has; a filter on ``bucket_of`` reads one.
    """
    rows = df.withColumn("bucket", bucket_of(F.col("session_id"), buckets))
    rows.repartition(buckets, "bucket").write.mode("append").partitionBy("bucket").parquet(path)


def bucket_of(session: Column, buckets: int = 64) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int")
