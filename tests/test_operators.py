"""Operators without a query of their own, configuration, staging and triggers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracefold.functions import fixed
from tracefold.operators import blocks, dropping, ledger, provenance, search, windows
from tracefold.sources import config, pending
from tracefold.streaming import due


def column(spark, c, **values):
    return spark.range(1).select(*(v.alias(k) for k, v in values.items())).select(c).first()[0] if values else spark.range(1).select(c).first()[0]


def arr(*items):
    return F.array(*map(F.lit, items)).cast("array<string>")


# ------------------------------------------------------------------------------------------------ ids and budgets


def test_id_checks(spark):
    assert column(spark, provenance.allowed_ids(arr("b", "x", "a", "a"), arr("a", "b", "c"))) == ["a", "b"]
    assert column(spark, provenance.all_known(arr("b", "a", "b"), arr("a", "b"))) == ["a", "b"]
    assert column(spark, provenance.all_known(arr("b", "x"), arr("a", "b"))) is None
    assert column(spark, provenance.all_known(arr(), arr("a"))) is None
    assert column(spark, provenance.proposal_order(arr("b", "x", "a", "b"), arr("a", "b"))) == ["b", "a"]
    assert column(spark, search.invalid_indices(F.array(F.lit(1), F.lit(9)), F.array(F.lit(1), F.lit(2)))) == [9]


def test_merging_lists(spark):
    assert column(spark, windows.merge_capped(arr("a", "b"), arr("b", "c", "d"), 3)) == ["b", "c", "d"]
    assert column(spark, windows.merge_capped(arr("a"), arr("b"), 3)) == ["a", "b"]
    merged = windows.merge_files({"Modified": arr("m"), "Created": arr("c", "x"), "Read": arr("r")}, {"Modified": arr("x", "r"), "Created": arr(), "Read": arr("q")})
    assert [column(spark, merged[k]) for k in ("Modified", "Created", "Read")] == [["m", "x", "r"], ["c"], ["q"]]


@pytest.mark.parametrize("tokens, droppable, want", [(0, 10, 0), (99, 10, 0), (100, 10, 1), (550, 10, 3), (1000, 10, 5), (5000, 10, 5), (1000, 0, 0), (150, 3, 1)])
def test_max_drops(spark, tokens, droppable, want):
    full = dropping.fullness(F.lit(tokens), 1000)
    assert column(spark, dropping.max_drops(F.lit(droppable), full)) == want


@pytest.mark.parametrize("full, want", [(0.0, "low"), (0.29, "low"), (0.3, "medium"), (0.59, "medium"), (0.6, "high"), (2.0, "high")])
def test_urgency(spark, full, want):
    assert column(spark, dropping.urgency(F.lit(full))) == want


def test_drop_order(spark):
    rows = [("s", "none-low", 0, 100, 1, 0), ("s", "strong-high", 2, 100, 2, 2), ("s", "strong-low", 0, 100, 3, 3), ("s", "partial", 1, 100, 0, 1), ("s", "strong-low-old", 0, 100, 1, 2), ("s", "ageless", 0, 100, None, 2)]
    df = spark.createDataFrame(rows, "session_id string, id string, rel int, tok long, pos long, supports long")
    got = dropping.candidates(df, 100).orderBy("drop_rank").collect()
    assert [r.id for r in got] == ["strong-low-old", "strong-low", "ageless"]


def test_prior_selection_stops_at_the_first_that_does_not_fit(spark):
    rows = [("s", f"i{k}", rel, k, cost) for k, (rel, cost) in enumerate([(2, 5), (1, 3), (0, 1), (1, 9), (1, 2), (3, 1)])]
    df = spark.createDataFrame(rows, "session_id string, id string, rel int, pos long, tok long")
    kept = lambda budget: sorted(r.id for r in ledger.select_prior(df, budget, F.col("tok")).collect())
    assert kept(0) == ["i0", "i5"] and kept(8) == ["i0", "i4", "i5"] and kept(10) == ["i0", "i4", "i5"] and len(kept(100)) == 6


def test_caps(spark):
    df = spark.createDataFrame([("s", "i%d" % k, k, t) for k, t in enumerate((50, 3, 4, 100))], "session_id string, id string, pos long, tok long")
    assert sorted(r.pos for r in ledger.cap_newest(df, 10).collect()) == [3] and sorted(r.pos for r in ledger.cap_newest(df, 104).collect()) == [2, 3]
    assert sorted(r.pos for r in ledger.cap_oldest(df, 10).collect()) == [0] and sorted(r.pos for r in ledger.cap_oldest(df, 57).collect()) == [0, 1, 2]


def test_furthest_coverage_not_the_latest(spark):
    markers = spark.createDataFrame([("s", 3, 2), ("s", 5, 1), ("s", 6, 2), ("s", 9, -1), ("t", 1, -1)], "session_id string, pos long, covers long")
    assert [tuple(r) for r in ledger.latest_coverage(markers).collect()] == [("s", 2, 3)]
    sources = spark.createDataFrame([("s", 1, 5), ("s", 4, 7), ("t", 0, 3)], "session_id string, pos long, tok long")
    assert {r.session_id: r.tokens for r in ledger.tokens_since_coverage(sources, markers).collect()} == {"s": 7, "t": 3}


def test_tokens_since_the_kept_entry(spark):
    entries = spark.createDataFrame([("s", k, f"e{k}") for k in range(6)], "session_id string, pos long, entry_id string")
    sources = spark.createDataFrame([("s", 0, 1), ("s", 2, 10), ("s", 5, 100)], "session_id string, pos long, tok long")
    for kept, want in (("e2", 110), ("gone", 100), ("", 100), ("e0", 111)):
        c = spark.createDataFrame([("s", 3, kept)], "session_id string, pos long, first_kept_entry_id string")
        assert ledger.tokens_since_compaction(sources, c, entries).first().tokens == want


def test_two_boundaries(spark):
    obs = spark.createDataFrame([("s", 9, "late", 1), ("s", 2, "early", 8)], "session_id string, pos long, id string, covers long").withColumn("tok", F.lit(1))
    none = spark.createDataFrame([], "session_id string, pos long, id string, covers long")
    bound = spark.createDataFrame([("s", 5)], "session_id string, upto long")
    assert [r.id for r in ledger.fold(obs, none, bound).collect()] == ["early"]
    bounds = spark.createDataFrame([("s", 5, 5, 5)], "session_id string, obs_upto long, refl_upto long, drop_upto long")
    seen, _ = ledger.project(obs, obs, none, bounds)
    assert [r.id for r in seen.collect()] == ["late"]
    nothing = bounds.withColumn("obs_upto", F.lit(-1))
    assert ledger.project(obs, obs, none, nothing)[0].count() == 0


def test_full_fold_switches_at_the_pool(spark):
    obs = spark.createDataFrame([("s", 1, "a", 0, 60), ("s", 2, "b", 1, 40)], "session_id string, pos long, id string, covers long, tok long")
    drop = spark.createDataFrame([("s", 3, "a", 2)], "session_id string, pos long, id string, covers long")
    cuts = spark.createDataFrame([("s", 5, None)], "session_id string, cut long, full_cut long")
    ids = lambda pool: sorted((r.id, r.full_fold) for r in ledger.compaction_projection(obs, obs.limit(0), drop, cuts, pool)[0].collect())
    assert ids(101) == [("a", False), ("b", False)] and ids(100) == [("b", True)]


def test_partitions_and_order_do_not_matter(spark):
    from tracefold.plans import catalogue

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    from tracefold.sources import adapters

    def active(df):
        ev = adapters.user_events(df)
        return {tuple(r) for r in ledger.fold(adapters.observations(ev), adapters.drops(ev)).select("session_id", "id", "pos").collect()}

    assert active(events) == active(events.orderBy(F.rand(3)).repartition(13)) and catalogue.QUERIES


# ------------------------------------------------------------------------------------------------ calls


@pytest.mark.parametrize(
    "args, bearing, written",
    [
        ('{"path":"a","content":"x"}', True, "x\n"),
        ('{"path":"a","content":""}', False, ""),
        ('{"content":"x"}', False, ""),
        ('{"path":1,"content":"x"}', False, ""),
        ('{"file":"a","oldText":"o","newText":"n"}', True, "o\nn\n"),
        ('{"path":"a","edits":[],"oldText":"o"}', False, ""),
        ('{"path":"a","edits":[{"oldText":"o","newText":"n"},{"newText":"m"}]}', True, "o\nn\nm\n"),
        ('{"path":"a","edits":["x"]}', False, ""),
        ('{"path":"a","command":"ls"}', False, ""),
    ],
)
def test_what_calls_write(spark, args, bearing, written):
    assert column(spark, blocks.content_bearing(F.lit(args))) is bearing
    assert column(spark, blocks.written_text(F.lit(args))) == written


@pytest.mark.parametrize("args, want", [('{"file_path":"a","command":"b"}', "path=a"), ('{"command":"b"}', "command=b"), ('{"query":"q"}', "query=q"), ('{"x":1,"y":2}', "x, y"), ("{}", "")])
def test_argument_summaries(spark, args, want):
    assert column(spark, blocks.summary_of(F.lit(args))) == want


def test_indexed_text_is_capped(spark):
    edits = '{"path":"a","edits":[{"oldText":"%s","newText":"%s"},{"oldText":"z"}]}' % ("a" * 9000, "b" * 9000)
    got = column(spark, blocks.written_text(F.lit(edits)))
    assert len(got) == fixed.INDEXED_CHARS and "z" not in got


@pytest.mark.parametrize("query, want", [("the root cause of it", ["root", "cause"]), ("the of", ["the", "of"]), ("a b auth", ["auth"]), ("auth auth", ["auth", "auth"])])
def test_query_terms(query, want):
    assert search.query_terms(query) == want


def test_patterns(spark):
    assert search.looks_like_regex("auth.ts") and not search.looks_like_regex("auth ts")
    assert search.safe_pattern(spark, "(foo") == r"(?i)\Q(foo\E" and search.safe_pattern(spark, "a|b") == "(?i)a|b"


def test_repeated_terms_weigh_more(spark):
    docs = spark.createDataFrame([(1, "auth x"), (2, "y"), (3, "z auth auth")], "id long, text string")
    one, two = ({r.id: r.score for r in search.bm25(docs, terms).collect()} for terms in (["auth"], ["auth", "auth"]))
    assert set(one) == {1, 3} and one[3] > one[1] > 0 and two[1] != one[1]


def test_retryable_errors(spark):
    assert column(spark, F.lit("HTTP 429 Too Many Requests").rlike(fixed.RETRYABLE)) and not column(spark, F.lit("bad key").rlike(fixed.RETRYABLE))


# ------------------------------------------------------------------------------------------------ configuration


def test_configuration(tmp_path):
    path = tmp_path / "c.json"
    assert config.load(path) == config.DEFAULTS
    path.write_text('{"observeAfterTokens": -1, "reflectAfterTokens": 7, "compaction": "odd", "dropperPressureThreshold": 1.5, "memory": "no", "x": 1}')
    found = config.load(path, {"TRACEFOLD_compactAfterTokens": "9", "TRACEFOLD_tailBehavior": "host"})
    assert found == config.DEFAULTS | {"reflectAfterTokens": 7, "compactAfterTokens": 9, "tailBehavior": "host"}
    config.save(path, {"debug": True})
    assert '"x": 1' in path.read_text() and config.load(path)["debug"] is True
    path.write_text("{broken")
    assert config.load(path) == config.DEFAULTS
    assert config.scaffold(tmp_path / "new.json") and not config.scaffold(tmp_path / "new.json")


@pytest.mark.parametrize(
    "old, want",
    [
        ({"passive": True}, {"compaction": "off", "memory": False}),
        ({"noAutoCompact": True}, {"compaction": "manual"}),
        ({"overrideDefaultCompaction": True}, {"compactionEngine": "native", "tailBehavior": "minimal"}),
        ({"overrideDefaultCompaction": False}, {"compactionEngine": "host"}),
        ({"passive": True, "compaction": "auto"}, {"passive": True, "compaction": "auto"}),
    ],
)
def test_names_of_earlier_versions(old, want):
    assert config.migrated(old) == want


@pytest.mark.parametrize("compaction", ["auto", "manual", "off"])
@pytest.mark.parametrize("engine", ["native", "host"])
@pytest.mark.parametrize("memory", [True, False])
def test_who_may_compact(compaction, engine, memory):
    c = config.DEFAULTS | {"compaction": compaction, "compactionEngine": engine, "memory": memory}
    own = compaction == "auto" and engine == "native"
    assert [config.may_compact(c, t) for t in ("threshold", "event", "command")] == ["handled" if own else "skipped", "handled" if own else "passed", "handled"]


def test_models_to_try():
    m = lambda k: {"provider": "p", "id": k}
    c = config.DEFAULTS | {"observerModel": m("a"), "observerFallbackModels": [m("b"), m("a")], "model": m("c")}
    assert [x["id"] for x in config.candidates(c, "observer", m("s"))] == ["a", "b", "c", "s"]
    assert [x["id"] for x in config.candidates(c | {"sessionFallback": False}, "observer", m("s"), {"p/a"})] == ["b", "c"]
    assert config.context_window() == 128_000 and config.context_window(5, 9) == 5 and config.output_tokens(50_000) == 32_000


# ------------------------------------------------------------------------------------------------ staging, cooldowns, triggers


def test_staged_batches(spark, tmp_path):
    rows = [("s", "dropped", 1, "e", "d"), ("s", "observed", 2, "e", "o2"), ("s", "observed", 1, "e", "o1"), ("s", "reflected", 1, "e", "r"), ("s", "observed", 1, "e", "o1"), ("s", "odd", 1, "e", "x"), ("t", "observed", 1, " ", "x"), ("u", "observed", 1, "e", None)]
    pending.stage(spark.createDataFrame(rows, pending.SCHEMA), str(tmp_path / "p"))
    found = pending.read(spark, str(tmp_path / "p"))
    assert [r.session_id for r in pending.sessions(found).collect()] == ["s"]
    assert [r.data for r in pending.flush_order(found).orderBy("place").collect()] == ["o1", "o2", "r", "d"]
    assert {r.kind: r.data for r in pending.latest(found).collect()} == {"observed": "o2", "reflected": "r", "dropped": "d"}


def test_cooldowns(spark):
    at = dt.datetime(2026, 1, 1, 12)
    failures = spark.createDataFrame([("m", at), ("m", at - dt.timedelta(hours=2)), ("n", at - dt.timedelta(hours=2))], "model string, at timestamp_ntz")
    now = F.lit(at + dt.timedelta(minutes=30)).cast("timestamp_ntz")
    assert [r.model for r in pending.active(pending.cooldowns(failures), now).collect()] == ["m"]
    assert pending.cooldowns(failures, 0).count() == 0


def test_due(spark):
    sources = spark.createDataFrame([("s", k, 100) for k in range(10)], "session_id string, pos long, tok long")
    none = spark.createDataFrame([], "session_id string, pos long, covers long")
    seen = spark.createDataFrame([("s", 9, 7)], "session_id string, pos long, covers long")
    active = spark.createDataFrame([("s", 0, 90)], "session_id string, rel int, tok long")
    c = config.DEFAULTS | {"observeAfterTokens": 300, "reflectAfterTokens": 1000, "observationsPoolMaxTokens": 100, "reflectorInputMaxTokens": 1000}
    row = due.due(sources, {"observed": seen, "reflected": none, "dropped": seen}, active, c).first()
    assert (row.observe, row.reflect, row.drop) == (False, True, False)
    assert due.due(sources, {"observed": none, "reflected": seen, "dropped": seen}, active, c | {"reflectorInputMaxTokens": 100}).first()[1:] == (True, False, True)


def test_compaction_is_due(spark):
    sources = spark.createDataFrame([("s", 0, 81_000), ("t", 0, 5)], "session_id string, pos long, tok long")
    none = spark.createDataFrame([], "session_id string, pos long, first_kept_entry_id string")
    entries = spark.createDataFrame([("s", 0, "a")], "session_id string, pos long, entry_id string")
    assert [r.session_id for r in due.compact_due(sources, none, entries, config.DEFAULTS).collect()] == ["s"]
    assert due.compact_due(sources, none, entries, config.DEFAULTS | {"compaction": "manual"}).count() == 0


def test_next_match_looks_two_ahead(spark):
    rows = spark.createDataFrame([("s", 0, None), ("s", 1, None), ("s", 2, "x"), ("s", 3, "y"), ("s", 4, None)], "session_id string, pos long, v string")
    assert [r.matched for r in windows.next_match(rows, F.col("v")).orderBy("pos").collect()] == ["x", "x", "y", None, None]


def test_runs_of_null_headers(spark):
    rows = spark.createDataFrame([("s", 0, None), ("s", 1, None), ("s", 2, "a"), ("s", 3, None)], "session_id string, pos long, h string")
    assert [r.run for r in windows.runs(rows, "h", ["pos"]).orderBy("pos").collect()] == [0, 0, 1, 2]


def test_entry_without_optional_parts():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
