"""Ranked and regex search over documents, their lines, and pages of hits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions import fixed, text


def looks_like_regex(query: str) -> bool:
    return any(c in fixed.REGEX_SIGNS for c in query)


def query_terms(query: str) -> list[str]:
    """The words that carry meaning, or all if none does. Repetitions stay: they weigh more."""
    terms = query.split()
    return [t for t in terms if t.lower() not in fixed.QUERY_STOPWORDS and len(t) > 1] or terms


def safe_pattern(spark, pattern: str) -> str:
    """The pattern without regard to case if it compiles, else as a literal."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:
        pattern = r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E"
    return "(?i)" + pattern


def bm25(docs: DataFrame, terms: list[str], corpus: list[str] = (), hay: str = "text") -> DataFrame:
    """``docs`` that hold a term, with score and matches (how many terms).

    ``corpus``: keys that divide the documents into corpora of their own. Statistics are one row a corpus, from sums
    taken before the shuffle; each document's term frequencies are computed in one pass with the scan. A term that is
    repeated m times counts m times in document frequency and score.
    """
    once = list(dict.fromkeys(t.lower() for t in terms))
    lower = docs.withColumn("_lower", F.lower(hay))
    tf = lower.select("*", text.words(F.col(hay)).alias("_len"), *(text.term_frequency(F.col("_lower"), t).alias(f"_tf{i}") for i, t in enumerate(once))).drop("_lower")
    keys = list(corpus)
    stats = tf.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg("_len").alias("_mean"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(once))))
    joined = tf.join(stats, keys) if keys else tf.crossJoin(F.broadcast(stats))  # one row
    times = [sum(t.lower() == u for t in terms) for u in once]
    score, matches = F.lit(0.0), F.lit(0)
    for i, m in enumerate(times):
        has = F.col(f"_tf{i}") > 0
        score = score + F.when(has, m * text.bm25(F.col(f"_tf{i}"), m * F.col(f"_df{i}"), F.col("_n"), F.col("_len"), F.col("_mean"))).otherwise(0.0)
        matches = matches + F.when(has, m).otherwise(0)
    found = joined.withColumn("score", score).withColumn("matches", matches.cast("long")).filter("matches > 0")
    return found.select(*docs.columns, "score", "matches")


def regex(docs: DataFrame, pattern: str, hay: str = "text") -> DataFrame:
    return docs.filter(F.col(hay).rlike(pattern))


def page(hits: DataFrame, order: list, number: int, size: int = fixed.PAGE) -> DataFrame:
    """The page's hits with their rank. Only the pages up to it are sorted, and that many rows meet in one task."""
    top = hits.orderBy(*order).limit(number * size)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).filter(F.col("rank") > (number - 1) * size)


def recent(entries: DataFrame, most: int = fixed.RECENT) -> DataFrame:
    """The last entries of each session."""
    back = Window.partitionBy("session_id").orderBy(F.desc("pos"))
    return entries.withColumn("_rn", F.row_number().over(back)).filter(F.col("_rn") <= most).drop("_rn")


def touched(calls: DataFrame) -> DataFrame:
    """Per session and path, in order of first touch: (session_id, path, first_pos, touches, calls as pos:tool)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "tool"))), lambda s: F.concat_ws(":", s["pos"].cast("string"), s["tool"]))
    return calls.groupBy("session_id", "path").agg(F.min("pos").alias("first_pos"), F.count("*").alias("touches"), F.array_join(listed, ",").alias("calls"))


def matching_lines(docs: DataFrame, pattern: str, hay: str = "text") -> DataFrame:
    """How many lines match and the first of them, for texts that have one."""
    lines = F.split(hay, "\n")
    hit = F.filter(lines, lambda x: x.rlike(pattern))
    return docs.withColumn("n_lines", F.size(hit).cast("long")).withColumn("first_line", F.get(hit, F.lit(0))).filter("n_lines > 0")


def file_matches(calls: DataFrame, pattern: str | None = None) -> DataFrame:
    """(session_id, pos, part_idx, tool, path, n_lines, snippet) by call (..., text): matching lines and the first of them.

    Without a pattern, the lines that are not blank, and no snippet.
    """
    lines = F.split("text", "\n")
    hit = F.filter(lines, (lambda x: F.trim(x) != "") if pattern is None else (lambda x: x.rlike(pattern)))
    found = calls.withColumn("_hit", hit).withColumn("n_lines", F.size("_hit").cast("long"))
    snippet = F.lit(None).cast("string") if pattern is None else F.get("_hit", F.lit(0))
    found = found.select("session_id", "pos", "part_idx", "tool", "path", "n_lines", snippet.alias("snippet"))
    return found if pattern is None else found.filter("n_lines > 0")


def recall_text(hits: DataFrame, files: DataFrame, query: str = "", most: int = 3) -> DataFrame:
    """(session_id, text): hits (session_id, place, pos, role, body) of each session as recall shows them.

    files: file_matches; of a hit's files the first ``most`` are shown.
    """
    one, many = ("match", "matches") if query else ("line", "lines")
    label = F.when(F.col("n_lines") == 1, one).otherwise(many)
    line = F.concat(F.lit("  ["), "tool", F.lit("] "), text.short_path(F.col("path")), F.lit(" — "), F.col("n_lines").cast("string"), F.lit(" "), label, F.lit("    use #"), F.col("pos").cast("string"), F.lit(":"), "path")
    line = F.concat(line, F.coalesce(F.concat(F.lit("\n    | "), "snippet"), F.lit("")))
    listed = files.groupBy("session_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("part_idx", line.alias("line")))), lambda x: x["line"]).alias("_files"))
    rows = hits.join(listed, ["session_id", "pos"], "left")
    head = F.concat(F.lit("#"), F.col("pos").cast("string"), F.lit(" ["), "role", F.lit("]"))
    n = F.size("_files")
    more = F.when(n > most, F.concat(F.lit("\n  ...("), (n - most).cast("string"), F.lit(" more file matches)"))).otherwise("")
    shown = F.concat(F.lit("\n  "), "body", F.lit("\n"), F.array_join(F.slice("_files", 1, most), "\n"), more)
    entry = F.concat(head, F.when(F.col("_files").isNull(), F.concat(F.lit(" "), "body")).otherwise(shown))
    found = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("place", entry.alias("entry")))).alias("e"))
    count = F.size("e").cast("string")
    title = F.concat(F.lit("Found "), count, F.lit(f' matches for "{query}":')) if query else F.concat(F.lit("Session history ("), count, F.lit(" entries):"))
    return found.select("session_id", F.concat(title, F.lit("\n\n"), F.array_join(F.transform("e", lambda x: x["entry"]), "\n\n")).alias("text"))


def merge_expanded(hits: DataFrame, expanded: DataFrame) -> DataFrame:
    """Hits (session_id, pos, summary) with the full text of entries that were asked for, which are added where they were no hits."""
    full = expanded.select("session_id", "pos", F.col("summary").alias("_full"))
    joined = hits.join(full, ["session_id", "pos"], "full_outer")
    return joined.select("session_id", "pos", F.coalesce("_full", "summary").alias("summary"), F.col("_full").isNotNull().alias("expanded"))


def window_of_lines(docs: DataFrame, offset: int, limit: int = fixed.PREVIEW_LINES, hay: str = "text") -> DataFrame:
    """Lines offset + 1 to offset + limit, the number of lines, and which these are."""
    lines = F.split(hay, "\n")
    total = F.size(lines)
    end = F.least(F.lit(offset + limit), total)
    body = F.array_join(F.slice(lines, offset + 1, limit), "\n")
    return docs.withColumn("total_lines", total.cast("long")).filter(F.col("total_lines") > offset).withColumn("end_line", end.cast("long")).withColumn("body", body)


def scope_and_mode(query: str) -> tuple[str, str, str]:
    """(query, scope, mode) from words such as scope:all and mode:file in the query; others count as default."""
    scope, mode, rest = "lineage", "hybrid", []
    for word in query.split():
        key, _, value = word.partition(":")
        if key == "scope" and value:
            scope = value if value in ("lineage", "all") else "lineage"
        elif key == "mode" and value:
            mode = value if value in ("hybrid", "file", "touched") else "hybrid"
        else:
            rest.append(word)
    return " ".join(rest), scope, mode


def parse_drill_down(query: str) -> dict | None:
    """#N:path, #N:path:full, #N:path:offset or #N:path:offset:limit."""
    m = re.fullmatch(r"#(\d+):(.+?)(?::(full|\d+(?::\d+)?))?", query)
    if not m:
        return None
    offset, _, limit = (m[3] or "").partition(":")
    numbers = m[3] and m[3] != "full"
    return {"index": int(m[1]), "path": m[2], "full": m[3] == "full", "offset": int(offset) if numbers else None, "limit": int(limit) if numbers and limit else None}


def invalid_indices(requested: Column, available: Column) -> Column:
    return F.array_except(requested, available)
