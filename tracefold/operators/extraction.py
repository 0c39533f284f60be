"""Extractors of memories: what an observer, a reflector and a dropper propose, and the checks on it.

Proposals come from a function from text to records, so that a language model can stand behind it; the rules here are
deterministic ones. Checks are the engine's: sources must be known, ids are hashes of contents, nothing is taken twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions import fixed, text
from tracefold.operators import dropping, provenance

#: From (text, its source ids) to proposals: dicts with content, relevance and source_ids.
Extractor = Callable[[str, list[str]], list[dict]]
_ENTRY = re.compile(r"^\[Source entry id: (.+?)\]\n", re.M)


def by_rules(addressed: str, source_ids: list[str]) -> list[dict]:
    """An observation for each entry that states a blocker (high), a preference or a change of scope (medium)."""
    parts = _ENTRY.split(addressed)[1:]
    blocker, scope = re.compile(fixed.BLOCKER), re.compile(fixed.SCOPE_CHANGE)
    wanted = [re.compile(p) for p in fixed.PREFERENCES]
    out = []
    for source, body in zip(parts[::2], parts[1::2], strict=True):
        for line in body.strip().split("\n"):
            said = re.sub(r"^\[[^\]]*\]: ", "", line).strip()
            relevance = "high" if blocker.search(said) else "medium" if scope.search(said) or any(p.search(said) for p in wanted) else None
            if relevance:
                out.append({"content": said[: fixed.RECORD_CHARS], "relevance": relevance, "source_ids": [source]})
                break
    return out


def observe(addressed: DataFrame, extract: Extractor = by_rules, known: DataFrame | None = None) -> DataFrame:
    """(session_id, id, content, relevance, source_ids, tok, status) for what is proposed on (session_id, text, source_ids).

    status: ``recorded``, ``rejected`` (no known source, odd relevance or no content), ``duplicate`` (proposed twice or
    already known). Source ids are those known, in the order of the text. known: (session_id, id).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for session, body, ids in rows.itertuples(index=False):
                for place, p in enumerate(extract(body, list(ids))):
                    named = set(p.get("source_ids") or ())
                    out.append((session, place, p.get("content") or "", p.get("relevance") or "", [i for i in ids if i in named]))
            yield pd.DataFrame(out, columns=["session_id", "place", "content", "relevance", "source_ids"])

    kind = addressed.schema["session_id"].dataType.simpleString()
    rows = addressed.select("session_id", "text", "source_ids").mapInPandas(run, f"session_id {kind}, place int, content string, relevance string, source_ids array<string>")
    rows = rows.withColumn("content", text.truncate_record(F.trim("content"))).withColumn("id", text.hash_id(F.col("content")))
    bad = (F.col("content") == "") | (F.size("source_ids") == 0) | ~F.col("relevance").isin(*fixed.RELEVANCE)
    first = F.row_number().over(Window.partitionBy("session_id", "id", bad).orderBy("place")) == 1
    old = F.lit(False)
    if known is not None:
        rows = rows.join(known.select("session_id", "id", F.lit(True).alias("_old")).distinct(), ["session_id", "id"], "left")
        old = F.coalesce("_old", F.lit(False))
    status = F.when(bad, "rejected").when(~first | old, "duplicate").otherwise("recorded")
    return rows.select("session_id", "id", "content", "relevance", "source_ids", text.tokens(F.col("content")).alias("tok"), status.alias("status"))


def reflect(proposals: DataFrame, observations: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(session_id, id, content, support_ids, tok, status) for proposed reflections (session_id, content, support_ids).

    ``rejected``: no content, more than one line, or a named observation (session_id, id, pos) that isn't active.
    ``duplicate``: already known, or proposed before; ``place``, if there is one, has the order of the proposals.
    Supports are named once each, in the order of the observations.
    """
    order = F.struct("pos", "id") if "pos" in observations.columns else F.struct("id")
    active = observations.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["id"]).alias("_active"))
    if "place" not in proposals.columns:
        proposals = proposals.withColumn("place", F.monotonically_increasing_id())
    rows = proposals.withColumn("content", text.truncate_record(F.regexp_replace("content", r"^\s+|\s+$", ""))).withColumn("id", text.hash_id(F.col("content")))
    rows = rows.join(active, "session_id", "left")
    supports = provenance.all_known(F.col("support_ids"), F.coalesce("_active", F.array().cast("array<string>")))
    rows = rows.withColumn("support_ids", supports)
    old = F.lit(False)
    if known is not None:
        rows = rows.join(known.select("session_id", "id", F.lit(True).alias("_old")).distinct(), ["session_id", "id"], "left")
        old = F.coalesce("_old", F.lit(False))
    rows = rows.withColumn("_bad", F.coalesce(F.col("support_ids").isNull() | (F.col("content") == "") | F.col("content").rlike("[\r\n]"), F.lit(True)))
    first = F.row_number().over(Window.partitionBy("session_id", "id", "_bad").orderBy("place")) == 1
    status = F.when(F.col("_bad"), "rejected").when(~first | old, "duplicate").otherwise("recorded")
    return rows.select("session_id", "id", "content", "support_ids", text.tokens(F.col("content")).alias("tok"), status.alias("status"))


def drop(observations: DataFrame, supports: DataFrame, budget: int) -> DataFrame:
    """(session_id, id) to drop: every active observation is proposed, and the pool's rules choose.

    observations: (session_id, id, rel, tok, pos); supports: (session_id, reflection, id).
    """
    counts = supports.distinct().groupBy("session_id", "id").agg(F.count("*").alias("supports"))
    rows = observations.join(counts, ["session_id", "id"], "left").withColumn("supports", F.coalesce("supports", F.lit(0)))
    return dropping.candidates(rows, budget).select("session_id", "id", "drop_rank")
