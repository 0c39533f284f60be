"""Logs read, searched, folded and compacted."""

import pytest
from pyspark.sql import functions as F

from tests.logs import call, custom, entry, message, observation, part, reflection, write
from tracefold.functions import fixed
from tracefold.operators import blocks, search, summary, windows
from tracefold.plans.session import Sessions
from tracefold.sources import session_log

O1, O2, O3, R1 = "aaaaaaaaaaa1", "aaaaaaaaaaa2", "aaaaaaaaaaa3", "bbbbbbbbbbb1"


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    searched = [
        message("m0", "user", "Fix login bug"),
        "",
        "{broken",
        message("m1", "assistant", [part("Reading auth.ts"), call("read", {"path": "/src/auth.ts"})], "m0"),
        message("m2", "toolResult", [part("export function auth() {}")], "m1", toolName="read", isError=False),
        message("m3", "assistant", [part("Found the root cause in auth module"), {"type": "thinking", "thinking": "hm", "redacted": True}], "m2"),
        message("side", "user", "[not a list", "m0"),
        message("m4", "assistant", [call("write", {"path": "/src/a.py", "content": "\n".join(f"line {i}" for i in range(40))}), call("edit", {"path": "/src/b.py", "edits": [{"oldText": "foo old", "newText": "bar new"}]})], "m3"),
        message("m5", "assistant", None, "m4"),
        message("m6", "user", "now commit it", "m5"),
    ]
    memory = [
        message("raw-1", "user", "abcd"),
        custom(fixed.OBSERVED, "e1", "raw-1", observations=[observation(O1), observation(O2, relevance="high", sources=("raw-1", "gone", "e1"))]),
        message("raw-2", "user", "abcdefgh"),
        custom(fixed.REFLECTED, "e2", "raw-2", reflections=[reflection(R1, [O1, O2, "aaaaaaaaaaa9"])]),
        message("raw-3", "user", "abcdefghijkl"),
        custom(fixed.DROPPED, "e3", "raw-2", observationIds=[O1, "aaaaaaaaaaa9", O3]),
        custom(fixed.OBSERVED, "e4", "raw-3", observations=[observation(O1, "again"), observation(O3)]),
        custom(fixed.OBSERVED, "bad", "raw-3", observations=[observation(O2), observation("short")]),
        message("raw-4", "user", "abcdefghijklmnop"),
    ]
    return Sessions(spark, write(tmp_path_factory.mktemp("logs"), searched=searched, memory=memory))


def positions(df):
    return [r.pos for r in df.filter("session_id = 'searched'").collect()]


def test_bad_lines_are_counted_and_skipped(logs):
    assert {r.session_id: r.bad for r in session_log.bad_lines(logs.lines).collect()} == {"searched": 1, "memory": 0}
    assert logs.entries.filter("session_id = 'searched'").count() == 8


def test_content_is_a_string_or_a_list(logs):
    text = {r.entry_id: r.text for r in logs.messages.filter("session_id = 'searched'").collect()}
    assert text["side"] == "[not a list" and text["m5"] == "" and text["m3"] == "Found the root cause in auth module"


def test_numbers_survive_the_lineage(logs):
    kept = session_log.messages(logs.entries, logs.lineage()).filter("session_id = 'searched'")
    assert [r.message_index for r in kept.orderBy("message_index").collect()] == [0, 1, 2, 3, 5, 6, 7]


@pytest.mark.parametrize(
    "query, want", [("login", [0]), ("login|auth", [0, 1, 2, 3]), ("the root cause of it", [3]), ("xyz123", []), ("(foo", []), ("bar new", [5])]
)
def test_search(logs, query, want):
    assert sorted(positions(logs.search(query, scope="all"))) == want


def test_search_ranks_and_snips(logs):
    hits = logs.search("root cause auth", scope="all").filter("session_id = 'searched'").collect()
    assert hits[0].pos == 3 and hits[0].matches == 3 and "root cause" in hits[0].snippet


def test_modes_and_scopes(logs):
    assert sorted(positions(logs.search("line", scope="all", mode="file"))) == [5]
    assert positions(logs.search("not", scope="all")) == [4] and positions(logs.search("not")) == []
    touched = {r.path: r.calls for r in logs.search(mode="touched", scope="all").collect()}
    assert touched == {"/src/a.py": "5:write", "/src/b.py": "5:edit"}
    assert search.scope_and_mode("find scope:all mode:odd it") == ("find it", "all", "hybrid")


def test_drill_down(logs):
    preview = logs.recall("#5:a.py").filter("session_id = 'searched'").first()
    assert preview.total_lines == 40 and preview.end_line == 30 and preview.body.endswith("line 29")
    assert logs.recall("#5:a.py:30:5").first().body.split("\n") == [f"line {i}" for i in range(30, 35)]
    assert "--- becomes ---\nbar new" in logs.recall("#5:b.py:full").first().body
    assert logs.recall("#5:file").count() == 2 and logs.recall("#5:a.py:90").count() == 0
    assert search.parse_drill_down("#x:a") is None


def test_expand(logs):
    full = logs.recall("#1").filter("session_id = 'searched'").first()
    assert full.summary == "read(path=/src/auth.ts)\nReading auth.ts" and full.files == ["/src/auth.ts"]


def test_fold_is_free_of_order(logs):
    assert {(r.id, r.content) for r in logs.active().collect()} == {(O2, "seen")}


def test_one_bad_record_spoils_its_entry(logs):
    assert logs.observations.count() == 4


def test_clocks(logs):
    row = logs.status().filter("session_id = 'memory'").first()
    assert (row.observed, row.reflected, row.dropped) == (4, 7, 7)


def test_provenance(logs):
    got = {(r.entry, r.status) for r in logs.recall(O2).collect()}
    assert got == {("raw-1", "resolved"), ("gone", "missing"), ("e1", "non_source")}
    through = {(r.id, r.entry, r.status) for r in logs.recall(R1).collect()}
    assert (O1, "raw-1", "resolved") in through and ("aaaaaaaaaaa9", None, "missing") in through
    seen, rest = logs.related(["raw-1"])
    got = {r.id: (r.session_id, r.status, r.matched, r.relevance) for r in seen.collect()}
    assert got == {O1: ("memory", "dropped", ["raw-1"], "medium"), O2: ("memory", "active", ["raw-1"], "high"), O3: ("memory", "dropped", ["raw-1"], "medium")}
    assert [tuple(r) for r in rest.collect()] == [("memory", R1, "learnt", 2)]


def test_equal_ids_of_two_sessions_stay_apart(spark, tmp_path):
    def rows(said, relevance):
        return [message("m1", "user", said), message("m2", "user", "x"), custom(fixed.OBSERVED, "e1", "m2", observations=[observation(O1, said, relevance, ("m2", "m1", "m1"))])]

    a = rows("one", "low") + [custom(fixed.REFLECTED, "e2", "m2", reflections=[reflection(R1, [O1], "from a")])]
    b = rows("two", "high") + [custom(fixed.DROPPED, "e2", "m2", observationIds=[O1]), custom(fixed.REFLECTED, "e3", "m2", reflections=[reflection(R1, [O2], "from b")])]
    logs = Sessions(spark, write(tmp_path, a=a, b=b))
    seen, rest = logs.related(["m1"])
    assert sorted((r.session_id, r.content, r.status, r.matched) for r in seen.collect()) == [("a", "one", "active", ["m1", "m1"]), ("b", "two", "dropped", ["m1", "m1"])]
    assert [(r.session_id, r.content) for r in rest.collect()] == [("a", "from a")]
    assert logs.related(["zz"])[0].count() == 0
    merged = {(r.session_id, r.pos): (r.summary, r.expanded) for r in logs.expanded_search("one", [1], scope="all").collect()}
    assert merged[("a", 0)] == ("one", False) and merged[("a", 1)] == ("x", True) and merged[("b", 1)] == ("x", True) and len(merged) == 3
    grid = {(r.relevance, r.tier): (r.n, r.tokens) for r in logs.coverage().collect()}
    assert grid[("low", "partial")] == (1, 10) and sum(n for n, _ in grid.values()) == 1 and len(grid) == 12


def test_clocks_move_on_markers_with_bad_records(spark, tmp_path):
    rows = [message("m1", "user", "abcd"), custom(fixed.OBSERVED, "e1", "m1", observations=[{"id": "short"}]), message("m2", "user", "abcdefgh"), custom(fixed.OBSERVED, "e2", "m2", observations=[]), custom(fixed.OBSERVED, "e3", "gone", observations=[{}])]
    logs = Sessions(spark, write(tmp_path, s=rows))
    assert logs.status().first().observed == 2 and logs.observations.count() == 0


def test_files_of_messages(logs):
    got = {r.path: (r.tool, r.n_lines, r.snippet) for r in logs.files().filter("session_id = 'searched'").collect()}
    assert got == {"/src/a.py": ("write", 40, None), "/src/b.py": ("edit", 2, None)}
    found = [tuple(r)[3:] for r in logs.files("(?i)line 1").filter("session_id = 'searched'").collect()]
    assert found == [("write", "/src/a.py", 11, "line 1")]
    shown = logs.recall_text("line 39").filter("session_id = 'searched'").first().text
    assert shown.startswith('Found 1 matches for "line 39":\n\n#') and "\n  [write] /src/a.py — 40 matches    use #" in shown and "\n    | line 0" in shown
    whole = logs.recall_text().filter("session_id = 'searched'").first().text
    assert whole.startswith("Session history (") and "[edit] /src/b.py — 2 lines" in whole


def test_pages_of_touched_files(logs):
    got = [(r.rank, r.path) for r in logs.page("", mode="touched", scope="all").collect()]
    assert got == [(1, "/src/a.py"), (2, "/src/b.py")] and logs.page("", 2, mode="touched").count() == 0


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    rows = [message(f"m{i}", "user", "x" * (i % 50)) for i in range(3000)]
    folder = write(tmp_path, **{"long one": rows, "b": rows[:5]})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        logs = Sessions(spark, folder)
        assert logs.lines.rdd.getNumPartitions() >= 1 and logs.entries.count() == 3005
        assert [r.entry_id for r in logs.entries.filter("session_id = 'long one'").orderBy("pos").collect()] == [f"m{i}" for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_cursors_need_something_new(spark, tmp_path):
    big = "x" * 4000
    rows = [message("m1", "user", big), custom(fixed.OBSERVED, "e1", "m1", observations=[observation(O1, tokens=900)]), message("m2", "user", big), message("m3", "user", big)]
    later = [*rows, custom(fixed.OBSERVED, "e2", "m3", observations=[observation(O2, tokens=900)])]
    config = {"observeAfterTokens": 1500, "reflectAfterTokens": 1500, "observationsPoolMaxTokens": 2000, "dropperPressureThreshold": 9.0}
    logs = Sessions(spark, write(tmp_path, old=rows, new=later), config)
    shape = "session_id string, stage string, entry_id string, state string"
    at = lambda entry_: spark.createDataFrame([(s, k, entry_, "done") for s in ("old", "new") for k in ("reflected", "dropped")], shape)
    state = lambda df: {r.session_id: (r.observe, r.reflect, r.drop) for r in df.collect()}
    assert state(logs.due()) == {"old": (True, True, True), "new": (False, True, True)}
    # enough tokens after the cursor, but only the later log has a marker that covers something after it
    assert state(logs.due(at("e1"))) == {"old": (True, False, False), "new": (False, True, True)}
    assert state(logs.due(at("gone"))) == state(logs.due())
    waiting = spark.createDataFrame([("old", "observed", "m2", 100)], "session_id string, kind string, covers_up_to_id string, tok long")
    assert state(logs.due(at("e1"), waiting))["old"] == (True, True, True)
    done = spark.createDataFrame([("s", "observed", "b", 5, "done"), ("s", "reflected", "a", 1, "done")], "session_id string, stage string, entry_id string, at long, state string")
    kept = spark.createDataFrame([("s", "observed", "a", 1, "done"), ("s", "reflected", "c", 7, "done")], "session_id string, stage string, entry_id string, at long, state string")
    assert {(r.stage, r.entry_id) for r in windows.advance(kept, done).collect()} == {("observed", "b"), ("reflected", "c")}


def test_memory_text(logs):
    memory = logs.memory().filter("session_id = 'memory'").first().memory
    assert memory == f"## Reflections\n[{R1}] learnt\n\n## Observations\n[{O2}] 2026-05-02 10:00 [high] seen\n\n{fixed.MEMORY_NOTE}"


def test_cut(spark, tmp_path):
    u, a = (lambda i: message(i, "user", "do")), (lambda i: message(i, "assistant", "did"))
    rows = dict(
        cut=[u("1"), a("2"), u("3"), a("4")],
        few=[u("1"), a("2")],
        every=[u("1"), a("2"), a("3")],
        kept=[u("1"), a("2"), u("3"), entry("compaction", "c", firstKeptEntryId="3", summary="s"), a("4"), u("5"), a("6")],
        orphan=[u("1"), a("2"), u("3"), entry("compaction", "c", firstKeptEntryId="", summary="s"), u("4"), a("5"), u("6")],
    )
    got = {r.session_id: (r.live, r.reason, r.first_kept_entry_id) for r in Sessions(spark, write(tmp_path, **rows)).cut().collect()}
    assert got == {"cut": (4, "cut", "3"), "few": (2, "too_few_live_messages", None), "every": (3, "compact_all", ""), "kept": (4, "cut", "5"), "orphan": (3, "cut", "6")}


def test_compaction_merges_the_last_summary(spark, tmp_path):
    first = [message("1", "user", "Implement the login page\nalways use tabs here"), message("2", "assistant", [part("Okay, so I start. The build still failing on CI."), call("write", {"path": "/r/s/a.py", "content": "x"}), call("bash", {"command": 'git commit -m "add page"'})])]
    first += [message("3", "toolResult", [part("[main 1234abc] add page")], toolName="bash", isError=False), message("4", "toolResult", [part("boom")], toolName="bash", isError=True), message("5", "user", "next")]
    one = Sessions(spark, write(tmp_path, s=first)).compact().first()
    assert one.first_kept_entry_id == "5"
    for piece in ("[Session Goal]\n- Implement the login page", "Modified: /r/s/a.py", "- 1234abc: add page", "[bash] boom", "- always use tabs here", "[tool_error] bash (#3)", '* bash "git commit'):
        assert piece in one.summary, piece
    assert fixed.RECALL_NOTE in one.summary.replace("\n", " ") and one.summary.endswith(fixed.RECALL_HINT)
    again = [*first, entry("compaction", "c", firstKeptEntryId="5", summary=one.summary), message("6", "assistant", "done"), message("7", "user", "Now I want a logout page please")]
    two = Sessions(spark, write(tmp_path, s=again)).compact().first()
    assert "Implement the login page" in two.summary and "- 1234abc: add page" in two.summary and "boom" in two.summary.split("---")[1] and "Outstanding" not in two.summary
    assert two.summary.replace("\n", " ").count(fixed.RECALL_NOTE) == 1


def test_noise(spark, tmp_path):
    rows = [message("1", "user", "<system-reminder>x</system-reminder> hi there"), message("2", "user", "No response requested."), message("3", "assistant", [call("TodoWrite", {"a": 1}), part("ok"), {"type": "thinking", "thinking": "t"}])]
    got = blocks.without_noise(blocks.normalize(Sessions(spark, write(tmp_path, s=rows)).messages))
    assert [(r.kind, r.text) for r in got.orderBy("message_index", "part_idx").collect()] == [("user", "hi there"), ("assistant", "ok")]


def test_normalize_keeps_images_and_empty_users(spark, tmp_path):
    rows = [message("1", "user", [{"type": "image", "mimeType": "image/png"}]), message("2", "user", ""), message("3", "system", "x"), entry("message", "4", message={"role": "bashExecution", "command": "ls", "output": "a"})]
    got = blocks.normalize(Sessions(spark, write(tmp_path, s=rows)).messages)
    assert [(r.kind, r.text or r.command or "") for r in got.orderBy("message_index").collect()] == [("user", "[image: image/png]"), ("user", ""), ("bash", "ls")]


def row(i, kind, text="", **more):
    return {"message_index": i, "kind": kind, "text": text, "name": None, "path": None, "command": None, "shown": None, "is_error": False} | more


def test_transcript_takes_equal_lines_together():
    calls = [row(i, "tool_call", name="Read", shown="a.py") for i in (1, 2, 3)]
    errors = [row(i, "tool_result", "Command aborted", name="bash", is_error=True) for i in (4, 5)]
    found = summary.transcript([row(0, "user", "go"), *calls, *errors])
    assert summary.transcript_text(found) == '[user]\ngo (#0)\n\n[assistant]\n* Read "a.py" (#1, #2, #3) x3\n[tool_error] bash (#4, #5) x2\nCommand aborted'
    assert summary.transcript_entries(found)[1] == {"role": "assistant", "ref": "#1, #2, #3", "count": 3, "tool": "Read", "cmd": "a.py"}


def test_transcript_keeps_the_last_calls():
    found = summary.transcript_text(summary.transcript([row(i, "tool_call", name="bash", shown=f"c{i}") for i in range(12)]))
    assert "* (4 earlier tool-call entries omitted)" in found and '"c4"' in found and '"c3"' not in found


def test_goals_and_scope_changes():
    rows = [row(0, "user", "ok"), row(1, "user", "- Fix the parser\n/tmp/x\nFor each issue: do"), row(2, "user", "actually write the docs first"), row(3, "user", "thanks")]
    assert summary.goals(rows) == ["Fix the parser", "[Scope change]", "actually write the docs first"]


def test_preferences_one_a_block():
    rows = [row(0, "user", "always use tabs\nnever push to main"), row(1, "user", "always use tabs\nplease avoid mocks"), row(2, "user", "do you prefer x?")]
    assert summary.preferences(rows, []) == ["always use tabs", "please avoid mocks"]
    assert summary.preferences(rows, ["Always use tabs "]) == ["please avoid mocks"]


def test_blockers():
    rows = [row(0, "assistant", "- It failed again here"), row(1, "user", "The build is broken on main. More"), row(2, "tool_result", "x\ny", name="bash", is_error=True)]
    assert summary.outstanding(rows) == ["[user] The build is broken on main. More", "[bash] x"]


def test_files_share_a_directory():
    calls = [row(0, "tool_call", name="Read", path="/a/b/c.py"), row(1, "tool_call", name="edit", path="/a/b/d.py"), row(2, "tool_call", name="read", path="/a/b/e.py")]
    assert summary.file_lines(summary.files(calls)) == ["Modified: d.py", "Read: c.py"]


def test_long_transcripts_begin_at_a_header():
    text = "\n".join(f"[user]\nline {i}" for i in range(100))
    capped = summary.cap_transcript(text)
    assert capped.startswith("...(80 earlier lines omitted)\n\n[user]") and capped.endswith("line 99")


def test_lineage_ends_in_a_cycle(spark):
    rows = spark.createDataFrame([("s", "a", "b"), ("s", "b", "a"), ("s", "c", None)], "session_id string, entry_id string, parent_id string")
    got = windows.lineage(rows, rows.filter("entry_id = 'a'"))
    assert {r.entry_id for r in got.collect()} == {"a", "b"}


def test_deep_lineage(spark):
    rows = spark.createDataFrame([("s", i, i - 1 if i else None) for i in range(300)], "session_id string, entry_id long, parent_id long")
    assert windows.lineage(rows, rows.filter("entry_id = 250")).count() == 251


def test_merge_expanded(spark):
    hits = spark.createDataFrame([("s", 1, "a"), ("s", 3, "c")], "session_id string, pos long, summary string")
    full = spark.createDataFrame([("s", 2, "BB"), ("s", 3, "CC"), ("t", 1, "D")], "session_id string, pos long, summary string")
    got = [tuple(r) for r in search.merge_expanded(hits, full).orderBy("session_id", "pos").collect()]
    assert got == [("s", 1, "a", False), ("s", 2, "BB", True), ("s", 3, "CC", True), ("t", 1, "D", True)]


def test_empty_folder_of_entries(spark, tmp_path):
    logs = Sessions(spark, write(tmp_path, s=[""]))
    assert logs.search("x").count() == 0 and logs.active().count() == 0 and logs.cut().count() == 0 and logs.compact().count() == 0
    assert logs.entries.filter(F.col("is_source")).count() == 0


# ------------------------------------------------------------------------------------------------ texts of entries, extractors, cursors


def test_source_entries_as_text(spark, tmp_path):
    from tracefold.operators import serialize

    rows = [
        message("a", "user", "hi\n\nthere", timestamp=1777716000000),
        message("b", "assistant", [part("one"), {"type": "thinking", "thinking": "t"}, {"type": "thinking", "thinking": "x", "redacted": True}, call("ls", {"path": "p"})]),
        message("c", "toolResult", [part("out"), {"type": "image", "mimeType": "image/png"}], toolName="ls", isError=False),
        entry("custom_message", "d", customType="note", content="n"),
        entry("branch_summary", "e", summary="s", timestamp="odd"),
        message("f", "assistant", []),
        entry("custom", "g", customType="x", data={}),
    ]
    log = Sessions(spark, write(tmp_path, s=rows)).entries
    plain = {r.entry_id: r.line for r in serialize.rendered(log).collect()}
    assert plain == {
        "a": "[User @ 2026-05-02 10:00]: hi\n\nthere",
        "b": '[Assistant @ ????-??-?? ??:??]: one\n[thinking: t]\n[ls({"path":"p"})]',
        "c": "[Tool result for ls @ ????-??-?? ??:??]: out",
        "d": "[Custom (note) @ 2026-05-02 10:00]: n",
        "e": "[Branch summary @ ????-??-?? ??:??]: s",
    }
    recall = {r.entry_id: r.line for r in serialize.rendered(log, recall=True).collect()}
    assert recall["c"] == "[Tool result: ls @ 2026-05-02 10:00]: out\n[non-text content omitted]" and recall["e"].startswith("[Branch summary @ Unknown time]")
    one = serialize.addressed(log).first()
    assert one.source_ids == ["a", "b", "c", "d", "e"] and one.text.startswith("[Source entry id: a]\n[User @")


def test_observer_rules_and_checks(spark, tmp_path):
    rows = [message("a", "user", "always use tabs"), message("b", "assistant", "The build is broken on main"), message("c", "user", "fine")]
    logs = Sessions(spark, write(tmp_path, s=rows))
    got = {r.content: (r.relevance, r.source_ids, r.status) for r in logs.observe().collect()}
    assert got == {"always use tabs": ("medium", ["a"], "recorded"), "The build is broken on main": ("high", ["b"], "recorded")}

    def odd(text, ids):
        return [{"content": "x", "relevance": "low", "source_ids": ["c", "a", "zz"]}, {"content": "x", "relevance": "low", "source_ids": ["a"]}, {"content": "y", "relevance": "low", "source_ids": ["zz"]}, {"content": "z", "relevance": "odd", "source_ids": ["a"]}]

    assert sorted((r.content, r.status, tuple(r.source_ids)) for r in logs.observe(odd).collect()) == [("x", "duplicate", ("a",)), ("x", "recorded", ("a", "c")), ("y", "rejected", ()), ("z", "rejected", ("a",))]


def test_reflections_need_known_supports(spark):
    from tracefold.operators import extraction

    obs = spark.createDataFrame([("s", "a"), ("s", "b")], "session_id string, id string")
    said = [("one\n two", ["a", "b"]), (" two ", ["b", "a", "b"]), ("two", ["a"]), ("bad", ["a", "zz"]), ("", ["a"]), ("none", []), ("known", ["a"]), ("l" * 10_050, ["a"])]
    rows = spark.createDataFrame([("s", *p, k) for k, p in enumerate(said)], "session_id string, content string, support_ids array<string>, place int")
    found = extraction.reflect(rows, obs).collect()
    known = spark.createDataFrame([("s", r.id) for r in found if r.content == "known"], "session_id string, id string")
    found = extraction.reflect(rows, obs, known).collect()
    got = sorted(((r.content, r.status, r.support_ids) for r in found if not r.content.startswith("l")), key=repr)
    want = [("one\n two", "rejected", ["a", "b"]), ("two", "recorded", ["a", "b"]), ("two", "duplicate", ["a"]), ("bad", "rejected", None), ("", "rejected", ["a"]), ("none", "rejected", None), ("known", "duplicate", ["a"])]
    assert got == sorted(want, key=repr)
    assert max(len(r.content) for r in found) < 10_050
    pool = spark.createDataFrame([("s", "a", 0, 60, 1), ("s", "b", 0, 60, 2), ("s", "c", 3, 60, 3)], "session_id string, id string, rel int, tok long, pos long")
    supports = spark.createDataFrame([("s", "r1", "b"), ("s", "r2", "b")], "session_id string, reflection string, id string")
    assert [r.id for r in extraction.drop(pool, supports, 100).collect()] == ["b"]


def test_host_cut(spark):
    rows = spark.createDataFrame([(s, p, r) for s in "abcde" for p, r in enumerate(["user", "assistant", "user", "assistant"])], "session_id string, pos long, role string")
    asked = spark.createDataFrame([("a", 1), ("b", 0), ("c", 9), ("d", None)], "session_id string, asked long")
    got = {r.session_id: (r.cut, r.reason) for r in windows.host_cut(rows, asked).collect()}
    assert got == {"a": (1, "cut"), "b": (None, "too_few_live_messages"), "c": (2, "cut"), "d": (2, "cut"), "e": (2, "cut")}


def test_kept_stats_and_cursors(spark):
    rows = spark.createDataFrame([("s", p, "x" * 10) for p in range(5)], "session_id string, pos long, text string")
    cuts = spark.createDataFrame([("s", 3)], "session_id string, cut long")
    assert tuple(windows.kept_stats(rows, cuts).first()) == ("s", 3, 2, 5)
    entries = spark.createDataFrame([("s", "a", 4)], "session_id string, entry_id string, pos long")
    cursors = spark.createDataFrame([("s", "observer", "a", "done"), ("s", "reflector", "gone", "done"), ("s", "dropper", "gone", "done")], "session_id string, stage string, entry_id string, state string")
    coverage = spark.createDataFrame([("s", "reflector", 2)], "session_id string, stage string, covered long")
    got = {r.stage: (r.at, r.state) for r in windows.valid_cursors(cursors, entries, coverage).collect()}
    assert got == {"observer": (4, "done"), "reflector": (2, "initial")}
