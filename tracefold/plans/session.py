"""Sessions as one object: search, drill-down, provenance, summaries and memory over a folder of logs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.functions import fixed, text
from tracefold.operators import blocks, dropping, extraction, ledger, provenance, search, serialize, summary, windows
from tracefold.sources import config as settings
from tracefold.sources import pending, session_log
from tracefold.streaming import due


class Sessions:
    """Logs under a path. All methods return DataFrames over all sessions; filter by session_id for one."""

    def __init__(self, spark: SparkSession, path: str, config: dict | None = None):
        self.spark = spark
        self.config = settings.DEFAULTS | (config or {})
        self.lines = session_log.lines(spark, path)
        self.entries = session_log.entries(self.lines)
        self.messages = session_log.messages(self.entries)

    # -------------------------------------------------------------------------------------------- recall

    def lineage(self, leaves: DataFrame | None = None) -> DataFrame:
        """(session_id, entry_id) on the paths from the leaves, by default each session's last entry, to the roots."""
        if leaves is None:
            leaves = self.entries.groupBy("session_id").agg(F.max_by("entry_id", "pos").alias("entry_id"))
        return windows.lineage(self.entries.select("session_id", "entry_id", "parent_id"), leaves)

    def _scoped(self, scope: str) -> DataFrame:
        return self.messages if scope == "all" else self.messages.join(self.lineage(), ["session_id", "entry_id"], "left_semi")

    def search(self, query: str = "", scope: str = "lineage", mode: str = "hybrid") -> DataFrame:
        """Ranked hits for words, hits in log order for a pattern, and the last entries for no query.

        (session_id, pos, entry_id, role, snippet, score, matches, ...); each session is a corpus of its own.
        """
        query, scope, mode = search.scope_and_mode(f"scope:{scope} mode:{mode} {query}")
        rows = self._scoped(scope)
        if mode == "touched":
            return self.touched(scope)
        if not query:
            return search.recent(blocks.rendered(rows))
        docs = blocks.search_documents(rows, mode)
        if search.looks_like_regex(query):
            pattern = search.safe_pattern(self.spark, query)
            found = search.regex(docs, pattern, "hay")
            return found.withColumn("snippet", text.line_snippet(F.col("text"), pattern)).drop("hay").orderBy("session_id", "pos")
        terms = search.query_terms(query)
        found = search.bm25(docs, terms, ["session_id"], "hay")
        pattern = "(?i)" + "|".join(re.escape(t) for t in terms)
        return found.withColumn("snippet", text.line_snippet(F.col("text"), pattern)).drop("hay").orderBy("session_id", F.desc("score"), "pos")

    def page(self, query: str, number: int = 1, **where) -> DataFrame:
        hits = self.search(query, **where)
        by = [c for c in ("pos", "first_pos", "path") if c in hits.columns]
        order = [F.desc("score")] * ("score" in hits.columns) + [F.col("session_id"), *map(F.col, by)]
        return search.page(hits, order, number)

    def recall_text(self, query: str = "", scope: str = "lineage", mode: str = "hybrid") -> DataFrame:
        """(session_id, text): a search as text, with the files that the messages write."""
        query, scope, mode = search.scope_and_mode(f"scope:{scope} mode:{mode} {query}")
        hits = self.search(query, scope, mode)
        pattern = None
        if query:
            pattern = search.safe_pattern(self.spark, query) if search.looks_like_regex(query) else "(?i)" + "|".join(re.escape(t) for t in search.query_terms(query))
        order = [F.desc("score"), "pos"] if "score" in hits.columns else ["pos"]
        body = F.coalesce("snippet", "summary") if {"snippet", "summary"} <= {*hits.columns} else F.col("snippet" if "snippet" in hits.columns else "summary")
        rows = hits.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(*order))).withColumn("body", body)
        return search.recall_text(rows.select("session_id", "place", "pos", "role", "body"), self.files(pattern, scope), query)

    def files(self, pattern: str | None = None, scope: str = "all") -> DataFrame:
        """Calls that write files, with their lines: all that aren't blank, or those that match and the first of them."""
        calls = blocks.written_files(self._scoped(scope))
        return search.file_matches(calls.withColumn("text", blocks.written_text(F.col("args"))), pattern)

    def expanded_search(self, query: str, indices: list[int], **where) -> DataFrame:
        """(session_id, pos, summary, expanded): hits, and messages by number in full."""
        hits = self.search(query, **where)
        hits = hits.select("session_id", "pos", F.col("snippet" if "snippet" in hits.columns else "summary").alias("summary"))
        return search.merge_expanded(hits, self.expand(indices))

    def expand(self, indices: list[int]) -> DataFrame:
        """The full text of messages by their numbers."""
        return blocks.rendered(self.messages.filter(F.col("message_index").isin(indices)), full=True)

    def touched(self, scope: str = "all") -> DataFrame:
        return search.touched(blocks.written_files(self._scoped(scope)))

    def drill_down(self, query: str) -> DataFrame:
        """Lines of what a message wrote to paths that contain the query's, as #N:path[:full|:offset[:limit]] says.

        (session_id, pos, tool, path, total_lines, end_line, body); several paths that fit are several rows.
        """
        asked = search.parse_drill_down(query)
        if not asked:
            raise ValueError(f"not a drill-down query: {query}")
        args = F.col("args")
        edits = F.try_variant_get(F.try_parse_json(args), "$.edits", "array<struct<oldText:string,newText:string>>")
        no, old, new = lambda i: (i + 1).cast("string"), lambda e: F.coalesce(e["oldText"], F.lit("")), lambda e: F.coalesce(e["newText"], F.lit(""))
        listed = F.array_join(F.transform(edits, lambda e, i: F.concat(F.lit("--- edit "), no(i), F.lit(" ---\n"), old(e), F.lit("\n--- becomes ---\n"), new(e))), "\n\n")
        both = F.concat(F.lit("--- old ---\n"), blocks.argument(args, "oldText"), F.lit("\n--- new ---\n"), blocks.argument(args, "newText"))
        body = F.coalesce(F.nullif(blocks.argument(args, "content"), F.lit("")), listed, both, F.lit("(no file content found in tool call arguments)"))
        calls = blocks.written_files(self.messages.filter(F.col("message_index") == asked["index"])).withColumn("text", body)
        if asked["path"] != "file":
            calls = calls.filter(F.col("path").contains(asked["path"]))
        columns = ["session_id", "pos", "part_idx", "tool", "path", "total_lines", "end_line", "body"]
        if asked["full"]:
            n = F.size(F.split("text", "\n")).cast("long")
            return calls.select("*", n.alias("total_lines"), n.alias("end_line"), F.substring("text", 1, fixed.FULL_CHARS).alias("body")).select(*columns)
        return search.window_of_lines(calls, asked["offset"] or 0, asked["limit"] or fixed.PREVIEW_LINES).select(*columns)

    def recall(self, query: str, **where) -> DataFrame:
        """A drill-down, one message by number, a memory by its id, or a search: the first that the query looks like."""
        q = query.strip()
        if search.parse_drill_down(q):
            return self.drill_down(q)
        if m := re.fullmatch(r"#(\d+)", q):
            return self.expand([int(m[1])])
        if re.fullmatch(r"[0-9a-f]{12}", q):
            return self.memory_sources(q)
        return self.search(query, **where)

    # -------------------------------------------------------------------------------------------- memory

    @property
    def observations(self) -> DataFrame:
        return session_log.observation_events(self.entries)

    @property
    def reflections(self) -> DataFrame:
        return session_log.reflection_events(self.entries)

    @property
    def drops(self) -> DataFrame:
        return session_log.drop_events(self.entries)

    @property
    def markers(self) -> dict[str, DataFrame]:
        """What counts for clocks, by stage: more than the events that count for the memory."""
        kinds = {"observed": fixed.OBSERVED, "reflected": fixed.REFLECTED, "dropped": fixed.DROPPED}
        return {stage: session_log.markers(self.entries, kind) for stage, kind in kinds.items()}

    def active(self) -> DataFrame:
        return ledger.fold(self.observations, self.drops)

    def memory_sources(self, memory_id: str) -> DataFrame:
        """(session_id, id, entry, status, message_index): the sources of an observation, or of a reflection's observations."""
        first = ledger.keep_first(self.observations, ["session_id", "id"], ["pos", "idx"])
        own = first.filter(F.col("id") == memory_id).select("session_id", "id", F.explode("source_ids").alias("entry"))
        asked = ledger.keep_first(self.reflections, ["session_id", "id"], ["pos", "idx"]).filter(F.col("id") == memory_id)
        support = asked.select("session_id", F.explode(F.array_distinct("support_ids")).alias("id"))
        through = support.join(first.select("session_id", "id", "source_ids"), ["session_id", "id"], "left").select("session_id", "id", F.explode_outer("source_ids").alias("entry"))
        cited = own.unionByName(through).withColumn("entry", F.struct("session_id", "entry"))
        branch = self.entries.select(F.struct("session_id", F.col("entry_id").alias("entry")).alias("entry"), "is_source").dropDuplicates(["entry"])
        at = self.messages.groupBy("session_id", F.col("entry_id").alias("_entry")).agg(F.min("message_index").alias("message_index"))
        found = provenance.classify(cited, branch).select("session_id", "id", F.col("entry.entry").alias("entry"), "status")
        return found.join(at.withColumnRenamed("_entry", "entry"), ["session_id", "entry"], "left")

    def related(self, entry_ids: list[str]) -> tuple[DataFrame, DataFrame]:
        """Observations that cite any of the entries, and reflections that rest on those, each of its own session.

        (session_id, id, content, timestamp, relevance, status, matched): status is active or dropped, and matched has
        the cited ids in their order; (session_id, id, content, matched), matched being how many of the observations.
        """
        first = ledger.keep_first(self.observations, ["session_id", "id"], ["pos", "idx"])
        found = first.withColumn("matched", F.filter("source_ids", lambda e: e.isin(*entry_ids))).filter(F.size("matched") > 0)
        gone = self.drops.select("session_id", "id", F.lit("dropped").alias("_gone")).distinct()
        found = found.join(gone, ["session_id", "id"], "left").select("session_id", "id", "content", "timestamp", "relevance", F.coalesce("_gone", F.lit("active")).alias("status"), "matched")
        learnt = ledger.keep_first(self.reflections, ["session_id", "id"], ["pos", "idx"])
        supports = learnt.select("session_id", F.col("id").alias("reflection"), F.explode("support_ids").alias("observation"))
        counts = provenance.supported_by(supports, found.withColumnRenamed("id", "observation"), "session_id").withColumnRenamed("reflection", "id")
        return found, counts.join(learnt, ["session_id", "id"]).select("session_id", "id", "content", "matched")

    def memory(self) -> DataFrame:
        """(session_id, memory): active observations and reflections as text."""
        return summary.memory_text(self.active(), ledger.keep_first(self.reflections, ["session_id", "id"], ["pos", "idx"]))

    def status(self) -> DataFrame:
        """(session_id, observed, reflected, dropped, held, fullness, urgency, max_drops): tokens since each marker, and the pool."""
        sources = session_log.entry_tokens(self.entries).filter("is_source")
        rows = None
        for name, markers in self.markers.items():
            since = ledger.tokens_since_coverage(sources, markers).withColumnRenamed("tokens", name)
            rows = since if rows is None else rows.join(since, "session_id", "full_outer")
        return rows.join(dropping.pool(self.active(), self.config["observationsPoolMaxTokens"]).withColumnRenamed("tokens", "held"), "session_id", "left")

    def cursors(self, kept: DataFrame) -> DataFrame:
        """Cursors (session_id, stage, entry_id, state) as positions, where their entries are still in the log."""
        covered = [ledger.latest_coverage(m).select("session_id", F.lit(k).alias("stage"), "covered") for k, m in self.markers.items()]
        return windows.valid_cursors(kept, self.entries, reduce(DataFrame.unionByName, covered))

    def due(self, cursors: DataFrame | None = None, pending: DataFrame | None = None) -> DataFrame:
        """Stages that are due. cursors: as kept; pending: waiting batches (session_id, kind, covers_up_to_id, tok)."""
        sources = session_log.entry_tokens(self.entries).filter("is_source")
        if cursors is not None:
            cursors = self.cursors(cursors).filter("state <> 'initial'")
        if pending is not None:
            at = self.entries.select("session_id", F.col("entry_id").alias("covers_up_to_id"), F.col("pos").alias("covers"))
            pending = pending.join(at, ["session_id", "covers_up_to_id"], "left").select("session_id", "kind", "covers", "tok")
        return due.due(sources, self.markers, self.active(), self.config, cursors, pending)

    def coverage(self) -> DataFrame:
        """(relevance, tier, n, tokens): active observations by how many reflections rest on them."""
        own = self.active().select(F.struct("session_id", "id").alias("observation"), "relevance", "tok")
        supports = self.reflections.select(F.struct("session_id", "id").alias("reflection"), F.explode("support_ids").alias("o"), "session_id")
        tiers = provenance.coverage(own, supports.select("reflection", F.struct("session_id", F.col("o").alias("id")).alias("observation")))
        return provenance.coverage_grid(tiers, "relevance", [*fixed.RELEVANCE])

    def drop(self) -> DataFrame:
        """(session_id, id, drop_rank): active observations that the pool's rules give up."""
        supports = self.reflections.select("session_id", F.col("id").alias("reflection"), F.explode("support_ids").alias("id"))
        return extraction.drop(self.active(), supports, self.config["observationsPoolMaxTokens"])

    def reflect(self, proposals: DataFrame, also: DataFrame | None = None) -> DataFrame:
        """Proposed reflections (session_id, content, support_ids) with what becomes of them. also: observations not in the log yet."""
        active = self.active().select("session_id", "id", "pos")
        active = active if also is None else active.unionByName(also.select("session_id", "id", F.lit(1 << 60).alias("pos")))
        return extraction.reflect(proposals, active, self.reflections)

    def consolidate(self, batch_no: int, extract: extraction.Extractor = extraction.by_rules, learn=None) -> DataFrame:
        """What observing, reflecting and dropping, one after the other, leave for the ledger, as batches to be staged.

        Only sessions run whose stage is due. ``learn`` takes (session_id, id, content, relevance), the active
        observations and the new ones, and returns proposals (session_id, content, support_ids).
        """
        ready = self.due().persist()
        at = lambda stage: ready.filter(stage).select("session_id")
        last = session_log.entry_tokens(self.entries).filter("is_source").groupBy("session_id").agg(F.max_by("entry_id", "pos").alias("covers_up_to_id"))
        covers = last.select("session_id", F.lit(batch_no).cast("long").alias("batch_no"), "covers_up_to_id")
        fresh = self.observe(extract).filter("status = 'recorded'").drop("status").join(at("observe"), "session_id", "left_semi").persist()
        out = [pending.batch(fresh, "observed", covers)]
        if learn is not None:
            known = self.active().select("session_id", "id", "content", "relevance").unionByName(fresh.select("session_id", "id", "content", "relevance"))
            learnt = self.reflect(learn(known.join(at("reflect"), "session_id", "left_semi")), fresh)
            out.append(pending.batch(learnt.filter("status = 'recorded'").drop("status"), "reflected", covers))
        out.append(pending.batch(self.drop().join(at("drop"), "session_id", "left_semi").select("session_id", "id"), "dropped", covers))
        return reduce(DataFrame.unionByName, out)

    def source_text(self, recall: bool = True) -> DataFrame:
        """(session_id, pos, entry_id, line): source entries as recall shows them."""
        return serialize.rendered(self.entries, recall)

    def observe(self, extract: extraction.Extractor = extraction.by_rules) -> DataFrame:
        """What an extractor finds in the source entries since the last covered one, as far as a chunk holds."""
        after = ledger.latest_coverage(self.markers["observed"]).select("session_id", F.col("covered").alias("at"))
        fresh = session_log.entry_tokens(self.entries).filter("is_source").join(after, "session_id", "left").filter(F.col("pos") > F.coalesce("at", F.lit(-1)))
        chunk = ledger.cap_newest(fresh, self.config["observerChunkMaxTokens"])
        return extraction.observe(serialize.addressed(self.entries, chunk), extract, self.observations)

    # -------------------------------------------------------------------------------------------- compaction

    def live(self) -> DataFrame:
        """Messages since each session's last compaction: from the entry that it kept, or after it if that one is unknown."""
        last = session_log.compactions(self.entries).groupBy("session_id").agg(F.max(F.struct("pos", "first_kept_entry_id")).alias("c"))
        kept = self.entries.select("session_id", F.col("pos").alias("_kept"), F.col("entry_id").alias("_id"))
        start = last.join(kept, (last["session_id"] == kept["session_id"]) & (F.col("c.first_kept_entry_id") == F.col("_id")), "left").select(last["session_id"], F.coalesce("_kept", F.col("c.pos") + 1).alias("_from"))
        return self.messages.join(start, "session_id", "left").filter(F.col("pos") >= F.coalesce("_from", F.lit(0))).drop("_from")

    def cut(self) -> DataFrame:
        """own_cut of the live messages, with first_kept_entry_id: empty where everything is compacted."""
        live = self.live()
        own = F.expr("row_number() over (partition by session_id order by pos) - 1").cast("long")
        at = live.select("session_id", own.alias("cut"), F.col("entry_id").alias("first_kept_entry_id"))
        found = windows.own_cut(live).join(at, ["session_id", "cut"], "left")
        return found.withColumn("first_kept_entry_id", F.when(F.col("reason") == "compact_all", "").otherwise(F.col("first_kept_entry_id")))

    def compact(self) -> DataFrame:
        """(session_id, first_kept_entry_id, summary, n_blocks, tokens_before, summarized, kept, kept_tokens).

        The live messages before the cut, merged with the last summary; what the live ones held, and what stays.
        """
        live = self.live().withColumn("_i", F.expr("row_number() over (partition by session_id order by pos) - 1"))
        cuts = self.cut().filter("reason in ('cut', 'compact_all')")
        before = live.join(cuts, "session_id").filter((F.col("reason") == "compact_all") | (F.col("_i") < F.col("cut")))
        previous = session_log.compactions(self.entries).filter("summary is not null").groupBy("session_id").agg(F.max_by("summary", "pos").alias("summary"))
        made = summary.compile_sessions(summary.prepared(blocks.normalize(before)), previous)
        held = live.groupBy("session_id").agg(F.round(F.sum(F.char_length("text")) / 4).cast("long").alias("tokens_before"))
        kept = windows.kept_stats(live.select("session_id", "pos", "text"), cuts.select("session_id", "cut"))
        found = cuts.select("session_id", "first_kept_entry_id").join(made, "session_id").join(held, "session_id").join(kept, "session_id")
        return summary.with_memory(found, self.memory()) if self.config["memory"] else found

    def outcome(self, trigger: str) -> str:
        return settings.may_compact(self.config, trigger)
