"""Registered queries over the star-schema tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.functions import fixed, text
from tracefold.operators import blocks, dropping, extraction, ledger, provenance, search, summary, windows
from tracefold.sources import adapters
from tracefold.sources.adapters import EVENTS_SQL, LOG_SQL
from tracefold.sources.scratch import Scratch
from tracefold.sources.tables import table
from tracefold.streaming import due

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Words that occur in the invented texts.
SEARCH = "ertion heing schen ertion"
POOL = 300
LINE_BUDGET = 1_500
BOUNDARY = "1995-03-01"
PATTERN = r"(?i)(tra+sh|scum|ment[a-z]*que)"
_SPACE = "[ \\t\\n\\x0b\\f\\r]"


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def _log(spark: SparkSession, d: str) -> DataFrame:
    return adapters.message_log(table(spark, d, "conversations"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return adapters.user_events(table(spark, d, "events"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


# ------------------------------------------------------------------------------------------------ scans and scalars


@query("scan_messages", f"with {LOG_SQL} select session_id, pos, entry_id, parent_id, role, tok from msg")
def scan_messages(spark, d):
    """The message log: numbered entries with ids, parents and token estimates."""
    return _log(spark, d).select("session_id", "pos", "entry_id", "parent_id", "role", "tok")


@query(
    "sanitize_text",
    r"""select doc_id, sha256(t) as text_sha256, cast(length(t) as bigint) as n_chars from (
    select doc_id, regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\x1b\[[0-9;]*[A-Za-z]', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') as t from documents)""",
)
def sanitize_text(spark, d):
    clean = text.sanitize(F.col("text"))
    return _documents(spark, d).select("doc_id", F.sha2(clean, 256).alias("text_sha256"), F.char_length(clean).cast("long").alias("n_chars"))


@query(
    "filter_noise_html",
    """select page_id, sha256(t) as text_sha256, cast(length(t) as bigint) as n_chars from (
    select page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g') as t from pages)""",
)
def filter_noise_html(spark, d):
    """Wrapper elements go, as host-added tags go from a user's message."""
    clean = text.strip_wrappers(F.coalesce("html", F.lit("")), ("script", "style"))
    return table(spark, d, "pages").select("page_id", F.sha2(clean, 256).alias("text_sha256"), F.char_length(clean).cast("long").alias("n_chars"))


@query(
    "clip_words",
    """select doc_id, case when length(text) <= 200 then text when instr(left(text, 201), ' ') > 0 and 201 - instr(reverse(left(text, 201)), ' ') > 120
    then left(text, 201 - instr(reverse(left(text, 201)), ' ')) else left(text, 200) end as clipped from (select doc_id, coalesce(text, '') as text from documents)""",
)
def clip_words(spark, d):
    return _documents(spark, d).select("doc_id", text.clip(F.col("text"), 200).alias("clipped"))


@query(
    "clip_sentences",
    r"""with t as (select doc_id, coalesce(text, '') as text, regexp_extract(left(coalesce(text, ''), 150), '(?s)^(.*[.!?])(?:\s|$)', 1) as s from documents)
    select doc_id, case when length(text) <= 150 then text when length(s) >= 75 then s
      when instr(left(text, 151), ' ') > 0 and 151 - instr(reverse(left(text, 151)), ' ') > 90 then left(text, 151 - instr(reverse(left(text, 151)), ' ')) else left(text, 150) end as clipped from t""",
)
def clip_sentences(spark, d):
    return _documents(spark, d).select("doc_id", text.clip_sentence(F.col("text"), 150).alias("clipped"))


@query(
    "hash_dedup",
    """select sha256(coalesce(text, ''))[1:12] as id, min(doc_id) as doc_id, cast(count(*) as bigint) as copies,
    cast(ceil(length(coalesce(any_value(text), '')) / 4.0) as bigint) as tok from documents group by 1""",
)
def hash_dedup(spark, d):
    """Content ids, and the first document of each. Partial minima go through the shuffle, not the texts."""
    rows = _documents(spark, d).select("doc_id", text.hash_id(F.col("text")).alias("id"), text.tokens(F.col("text")).alias("tok"))
    return rows.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("tok").alias("tok"))


_STOP = ", ".join(f"'{w}'" for w in sorted(w.replace("'", "''") for w in fixed.BRIEF_STOPWORDS))


@query(
    "truncate_words",
    rf"""with f as (select doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as flat from documents),
  c as (select doc_id, flat, regexp_extract_all(flat, '[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}]+') as ch from f),
  k as (select doc_id, flat, ch, list_filter(range(1, len(ch) + 1), lambda i: lower(regexp_extract(ch[i], '[\p{{L}}\p{{N}}]+$')) not in ({_STOP}))[{fixed.BRIEF_ASSISTANT_WORDS + 1}] as cut from c)
  select doc_id, case when cut is null then flat else concat(array_to_string(ch[1:cut - 1], ''), '...(truncated)') end as brief from k""".replace("\\\\", "\\"),
)
def truncate_words(spark, d):
    return _documents(spark, d).select("doc_id", text.truncate_words(fixed.BRIEF_ASSISTANT_WORDS)("text").alias("brief"))


# ------------------------------------------------------------------------------------------------ search

_TF = ", ".join(f"cast((length(lower(hay)) - length(replace(lower(hay), '{t}', ''))) / {len(t)} as bigint) as tf{i}" for i, t in enumerate(("ertion", "heing", "schen")))
_SCORE = " + ".join(f"case when tf{i} > 0 then {m} * ln((n - {m} * df{i} + 0.5) / ({m} * df{i} + 0.5) + 1) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean)) else 0 end" for i, m in enumerate((2, 1, 1)))
_MATCHES = "2 * cast(tf0 > 0 as bigint) + cast(tf1 > 0 as bigint) + cast(tf2 > 0 as bigint)"
_DOC_HITS = rf"""with docs as (select doc_id, coalesce(text, '') as hay from documents),
  tf as (select doc_id, len(string_split_regex(hay, '\s+')) as len, {_TF} from docs),
  st as (select count(*) as n, avg(len) as mean, count(*) filter (tf0 > 0) as df0, count(*) filter (tf1 > 0) as df1, count(*) filter (tf2 > 0) as df2 from tf),
  hits as (select doc_id, round({_SCORE}, 6) as score, {_MATCHES} as matches from tf, st where tf0 + tf1 + tf2 > 0)"""


def _hits(spark, d):
    return search.bm25(_documents(spark, d), search.query_terms(SEARCH)).select("doc_id", F.round("score", 6).alias("score"), "matches")


@query("search_bm25", f"{_DOC_HITS} select * from hits")
def search_bm25(spark, d):
    """All documents that hold a term, ranked."""
    return _hits(spark, d).orderBy(F.desc("score"), "doc_id")


@query("search_page2", f"{_DOC_HITS} select doc_id, score, matches, rank from (select *, row_number() over (order by score desc, doc_id) as rank from hits) where rank between 6 and 10")
def search_page2(spark, d):
    return search.page(_hits(spark, d), [F.desc("score"), F.col("doc_id")], 2)


@query(
    "search_bm25_conv",
    rf"""with {LOG_SQL}, docs as (select session_id, pos, concat(role, ' ', text, ' ') as hay from msg),
  tf as (select session_id, pos, len(string_split_regex(hay, '\s+')) as len, {_TF} from docs),
  st as (select session_id, count(*) as n, avg(len) as mean, count(*) filter (tf0 > 0) as df0, count(*) filter (tf1 > 0) as df1, count(*) filter (tf2 > 0) as df2 from tf group by session_id)
  select session_id, pos, round({_SCORE}, 6) as score, {_MATCHES} as matches from tf join st using (session_id) where tf0 + tf1 + tf2 > 0""",
)
def search_bm25_conv(spark, d):
    """Each conversation is a corpus; a message's text follows its role."""
    docs = _log(spark, d).select("session_id", "pos", F.concat_ws(" ", "role", "text", F.lit("")).alias("hay"))
    return search.bm25(docs, search.query_terms(SEARCH), ["session_id"], "hay").select("session_id", "pos", F.round("score", 6).alias("score"), "matches")


@query(
    "search_regex",
    f"""select doc_id, cast(len(hit) as bigint) as n_lines, hit[1] as first_line from (
    select doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{PATTERN}')) as hit from documents) where len(hit) > 0""",
)
def search_regex(spark, d):
    """Documents with a line that matches, how many lines do, and the first of them."""
    return search.matching_lines(search.regex(_documents(spark, d), PATTERN), PATTERN).select("doc_id", "n_lines", "first_line")


@query(
    "line_snippet",
    f"""with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
  m as (select doc_id, ls, list_position(list_transform(ls, lambda x: regexp_matches(x, '{PATTERN}')), true) as p from l)
  select doc_id, concat(case when p > 3 then concat('...(', p - 3, ' lines above)', chr(10)) else '' end, array_to_string(ls[greatest(p - 2, 1):least(p + 2, len(ls))], chr(10)),
    case when p + 2 < len(ls) then concat(chr(10), '...(', len(ls) - p - 2, ' lines below)') else '' end) as snippet from m where p > 0""",
)
def line_snippet(spark, d):
    return search.regex(_documents(spark, d), PATTERN).select("doc_id", text.line_snippet(F.col("text"), PATTERN).alias("snippet"))


@query("recent_entries", f"with {LOG_SQL} select session_id, pos, role, tok from (select *, row_number() over (partition by session_id order by pos desc) as rn from msg) where rn <= 3")
def recent_entries(spark, d):
    return search.recent(_log(spark, d), 3).select("session_id", "pos", "role", "tok")


@query(
    "touched_files",
    f"with {EVENTS_SQL} select session_id, concat('k', k) as path, min(pos) as first_pos, cast(count(*) as bigint) as touches, string_agg(concat(pos, ':', event_type), ',' order by pos) as calls from ev group by 1, 2",
)
def touched_files(spark, d):
    calls = _events(spark, d).select("session_id", "pos", F.concat(F.lit("k"), "k").alias("path"), F.col("event_type").alias("tool"))
    return search.touched(calls)


@query(
    "drilldown_window",
    """with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)
  select doc_id, cast(len(ls) as bigint) as total_lines, cast(least(60, len(ls)) as bigint) as end_line, array_to_string(ls[31:60], chr(10)) as body from l where len(ls) > 30""",
)
def drilldown_window(spark, d):
    return search.window_of_lines(_documents(spark, d), 30).select("doc_id", "total_lines", "end_line", "body")


@query(
    "preference_lines",
    r"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as no from documents),
  t as (select doc_id, no, regexp_replace(line, '^\s+|\s+$', '', 'g') as line from l)
  select doc_id, no as line_no, line from (select *, row_number() over (partition by doc_id order by no) as rn from t
    where length(line) between 5 and 200 and not ends_with(line, '?') and regexp_matches(line, '(?i)\b(with|avec|para)\s+\w')) where rn = 1""",
)
def preference_lines(spark, d):
    """The first line of each text that says how something is wanted, by words that these texts have."""
    lines = _documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("line", text.trim(F.col("line")))
    wanted = F.char_length("line").between(5, 200) & ~F.col("line").endswith("?") & F.col("line").rlike(r"(?i)\b(with|avec|para)\s+\w")
    return lines.filter(wanted).groupBy("doc_id").agg(F.min(F.struct("no", "line")).alias("l")).select("doc_id", (F.col("l.no") + 1).cast("long").alias("line_no"), "l.line")


# ------------------------------------------------------------------------------------------------ windows


@query(
    "own_cut_minimal",
    f"""with {LOG_SQL}, s as (select session_id, count(*) as live, max(pos) filter (role = 'user') as u from msg group by session_id)
  select session_id, cast(live as bigint) as live, case when live > 2 and coalesce(u, 0) > 0 then u end as cut,
    case when live <= 2 then 'too_few_live_messages' when coalesce(u, 0) <= 0 then 'compact_all' else 'cut' end as reason from s""",
)
def own_cut_minimal(spark, d):
    return windows.own_cut(_log(spark, d))


@query(
    "brief_islands",
    f"""with {EVENTS_SQL}, f as (select *, case when lag(event_type) over w = event_type then 0 else 1 end as fresh from ev window w as (partition by session_id order by pos)),
  r as (select *, sum(fresh) over (partition by session_id order by pos rows unbounded preceding) - 1 as run from f)
  select session_id, cast(run as bigint) as run, event_type, cast(count(*) as bigint) as n, string_agg(concat('#', pos), ', ' order by pos) as refs from r group by session_id, run, event_type""",
)
def brief_islands(spark, d):
    """Runs of entries under one header, collapsed with their references."""
    return windows.collapse(_events(spark, d), "event_type", ["pos"])


@query(
    "tool_cap",
    f"""with {EVENTS_SQL} select session_id, event_type, pos, cast(greatest(c - 8, 0) as bigint) as omitted from (
  select *, row_number() over (partition by session_id, event_type order by pos desc) as rn, count(*) over (partition by session_id, event_type) as c from ev) where rn <= 8""",
)
def tool_cap(spark, d):
    return windows.keep_last(_events(spark, d), ["session_id", "event_type"]).select("session_id", "event_type", "pos", F.col("omitted").cast("long").alias("omitted"))


@query(
    "tail_blockers",
    f"""with {EVENTS_SQL}, t as (select *, row_number() over (partition by session_id order by pos desc) as rn from ev)
  select session_id, pos, event_id, item from (select *, row_number() over (partition by session_id order by pos) as item from t where rn <= 20 and event_type = 'error') where item <= 5""",
)
def tail_blockers(spark, d):
    return windows.tail_first(_events(spark, d), F.col("event_type") == "error").select("session_id", "pos", "event_id", "item")


@query(
    "lineage",
    f"""with recursive {LOG_SQL}, up as (select m.session_id, m.entry_id, m.parent_id from msg m join (select session_id, max(pos) // 2 as pos from msg group by session_id) l using (session_id, pos)
    union all select m.session_id, m.entry_id, m.parent_id from msg m join up on m.session_id = up.session_id and m.entry_id = up.parent_id) select session_id, entry_id from up""",
)
def lineage(spark, d):
    """The entries on the path from each session's middle entry to its root."""
    log = _log(spark, d)
    middle = log.groupBy("session_id").agg(F.floor(F.max("pos") / 2).alias("pos"))
    return windows.lineage(log.select("session_id", "entry_id", "parent_id"), log.join(middle, ["session_id", "pos"]).select("session_id", "entry_id"))


@query(
    "next_commit",
    f"""with {EVENTS_SQL}, h as (select *, case when event_type = 'purchase' then event_id end as v from ev)
  select session_id, pos, matched from (select session_id, pos, event_type, coalesce(lead(v, 1) over w, lead(v, 2) over w) as matched from h window w as (partition by session_id order by pos)) where event_type = 'click'""",
)
def next_commit(spark, d):
    """For each click the purchase within the next two entries, as a commit's hash is found in a result that follows."""
    hit = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return windows.next_match(_events(spark, d), hit).filter("event_type = 'click'").select("session_id", "pos", "matched")


@query(
    "cooldown_asof",
    f"""with {EVENTS_SQL}, o as (select *, max(case when event_type = 'error' then ts end) over (partition by session_id order by ts, event_id rows between unbounded preceding and 1 preceding) as opened from ev)
  select session_id, event_id, coalesce(ts < opened + interval 1 hour, false) as cooling from o""",
)
def cooldown_asof(spark, d):
    return windows.cooling(_events(spark, d), F.col("event_type") == "error", 3600).select("session_id", "event_id", "cooling")


# ------------------------------------------------------------------------------------------------ ledger


@query(
    "latest_coverage",
    f"""with {EVENTS_SQL}, m as (select session_id, max(covers) as covered from obs where covers >= 0 group by session_id)
  select m.session_id, m.covered, min(o.pos) as marker_pos from m join obs o on o.session_id = m.session_id and o.covers = m.covered group by 1, 2""",
)
def latest_coverage(spark, d):
    return ledger.latest_coverage(adapters.observations(_events(spark, d)))


@query(
    "tokens_since_coverage",
    " union all ".join(
        f"""(with {EVENTS_SQL}, m as (select session_id, max(covers) as at from {t} where covers >= 0 group by session_id)
  select '{kind}' as kind, s.session_id, cast(sum(case when s.pos > coalesce(m.at, -1) then s.tok else 0 end) as bigint) as tokens from src s left join m using (session_id) group by 2)"""
        for kind, t in (("observed", "obs"), ("reflected", "refl"), ("dropped", "drp"))
    ),
)
def tokens_since_coverage(spark, d):
    """What the source entries hold since each kind of marker's furthest coverage."""
    ev = _events(spark, d)
    parts = [ledger.tokens_since_coverage(adapters.sources(ev), m(ev)).select(F.lit(kind).alias("kind"), "session_id", "tokens") for kind, m in (("observed", adapters.observations), ("reflected", adapters.reflections), ("dropped", adapters.drops))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "tokens_since_compaction",
    f"""with {EVENTS_SQL}, c as (select session_id, max(pos) as at from ev where event_type = 'signup' group by session_id),
  k as (select c.session_id, coalesce(c2.pos - 1, c.at) as at from c left join ev c2 on c2.session_id = c.session_id and c2.pos = c.at - 5)
  select s.session_id, cast(sum(case when s.pos > coalesce(k.at, -1) then s.tok else 0 end) as bigint) as tokens from src s left join k using (session_id) group by 1""",
)
def tokens_since_compaction(spark, d):
    """Signups compact the log and keep the five entries before them; the first ones name an entry that isn't there."""
    ev = _events(spark, d)
    name = lambda p: F.concat(F.lit("e"), p.cast("string"))
    compactions = ev.filter("event_type = 'signup'").select("session_id", "pos", name(F.col("pos") - 5).alias("first_kept_entry_id"))
    return ledger.tokens_since_compaction(adapters.sources(ev), compactions, ev.select("session_id", "pos", name(F.col("pos")).alias("entry_id")))


_FOLD = """first_ as (select * from (select *, row_number() over (partition by session_id, id order by pos) as rn from {obs}) where rn = 1),
  act as (select * from first_ f where not exists (select 1 from {drp} x where x.session_id = f.session_id and x.id = f.id))"""


@query("fold_active", f"with {EVENTS_SQL}, {_FOLD.format(obs='obs', drp='drp')} select session_id, id, pos, rel, tok from act")
def fold_active(spark, d):
    ev = _events(spark, d)
    return ledger.fold(adapters.observations(ev), adapters.drops(ev)).select("session_id", "id", "pos", "rel", "tok")


@query(
    "fold_upto",
    f"""with {EVENTS_SQL}, ob as (select obs.* from obs join sess using (session_id) where pos <= n // 2), dr as (select drp.* from drp join sess using (session_id) where pos <= n // 2),
  {_FOLD.format(obs="ob", drp="dr")} select session_id, id, pos, rel, tok from act""",
)
def fold_upto(spark, d):
    """Folded up to the middle of each log, by the position of the events themselves."""
    ev = _events(spark, d)
    bound = ev.groupBy("session_id").agg(F.floor(F.first("n") / 2).alias("upto"))
    return ledger.fold(adapters.observations(ev), adapters.drops(ev), bound).select("session_id", "id", "pos", "rel", "tok")


def _projected(name: str, obs: str, refl: str, drop: str) -> str:
    """SQL for the projection with these bounds, as CTEs <name>_o and <name>_r."""
    return f"""{name}_d as (select distinct session_id, id from drp join sess using (session_id) where covers >= 0 and covers <= {drop}),
  {name}_f as (select *, row_number() over (partition by session_id, id order by pos) as rn from obs join sess using (session_id) where covers >= 0 and covers <= {obs}),
  {name}_o as (select session_id, id, pos, rel, tok from {name}_f f where rn = 1 and not exists (select 1 from {name}_d x where x.session_id = f.session_id and x.id = f.id)),
  {name}_r as (select session_id, id, pos, tok from (select *, row_number() over (partition by session_id, id order by pos) as rn from refl join sess using (session_id) where covers >= 0 and covers <= {refl}) where rn = 1)"""


_CUT, _FULL_CUT = "n * 6 // 10", "n * 3 // 10"


def _cuts(ev: DataFrame) -> DataFrame:
    return ev.groupBy("session_id").agg(F.first("n").alias("n")).select("session_id", F.floor(F.col("n") * 6 / 10).alias("cut"), F.floor(F.col("n") * 3 / 10).alias("full_cut"))


def _ledger(ev: DataFrame):
    return adapters.observations(ev), adapters.reflections(ev), adapters.drops(ev)


@query("projection_full", f"with {EVENTS_SQL}, {_projected('p', _CUT, _CUT, _CUT)} select 'observation' as kind, session_id, id, pos, tok from p_o union all select 'reflection', session_id, id, pos, tok from p_r")
def projection_full(spark, d):
    """Folded up to a cut, by what the markers cover."""
    ev = _events(spark, d)
    bounds = _cuts(ev).select("session_id", *(F.col("cut").alias(c) for c in ("obs_upto", "refl_upto", "drop_upto")))
    o, r = ledger.project(*_ledger(ev), bounds)
    columns = ["session_id", "id", "pos", "tok"]
    return o.select(F.lit("observation").alias("kind"), *columns).unionByName(r.select(F.lit("reflection").alias("kind"), *columns))


_SWITCH = f"""{_projected("a", _CUT, _FULL_CUT, _FULL_CUT)}, {_projected("b", _CUT, _CUT, _CUT)},
  sw as (select s.session_id, coalesce(sum(tok), 0) >= {POOL} as full_fold from sess s left join a_o using (session_id) group by 1)"""


@query(
    "projection_compaction",
    f"""with {EVENTS_SQL}, {_SWITCH}
  select 'observation' as kind, sw.full_fold, o.session_id, id, pos, tok from a_o o join sw using (session_id) where not full_fold union all select 'observation', sw.full_fold, o.session_id, id, pos, tok from b_o o join sw using (session_id) where full_fold
  union all select 'reflection', sw.full_fold, o.session_id, id, pos, tok from a_r o join sw using (session_id) where not full_fold union all select 'reflection', sw.full_fold, o.session_id, id, pos, tok from b_r o join sw using (session_id) where full_fold""",
)
def projection_compaction(spark, d):
    ev = _events(spark, d)
    o, r = ledger.compaction_projection(*_ledger(ev), _cuts(ev), POOL)
    columns = ["full_fold", "session_id", "id", "pos", "tok"]
    return o.select(F.lit("observation").alias("kind"), *columns).unionByName(r.select(F.lit("reflection").alias("kind"), *columns))


@query(
    "projection_diff",
    f"""with {EVENTS_SQL}, {_projected("v", _FULL_CUT, _FULL_CUT, _FULL_CUT)}, {_projected("f", "n", "n", "n")}
  select session_id, id, 'only_full' as side from f_o x where not exists (select 1 from v_o y where y.session_id = x.session_id and y.id = x.id)
  union all select session_id, id, 'only_visible' from v_o x where not exists (select 1 from f_o y where y.session_id = x.session_id and y.id = x.id)
  union all select session_id, id, 'only_full' from f_r x where not exists (select 1 from v_r y where y.session_id = x.session_id and y.id = x.id)""",
)
def projection_diff(spark, d):
    """What is visible since the last full fold against everything."""
    ev = _events(spark, d)
    ends = ev.groupBy("session_id").agg(F.first("n").alias("n")).select("session_id", *(F.col("n").alias(c) for c in ("obs_upto", "refl_upto", "drop_upto")))
    seen = _cuts(ev).select("session_id", *(F.col("full_cut").alias(c) for c in ("obs_upto", "refl_upto", "drop_upto")))
    (vo, vr), (fo, fr) = ledger.project(*_ledger(ev), seen), ledger.project(*_ledger(ev), ends)
    return ledger.diff(vo, fo, ["session_id", "id"]).unionByName(ledger.diff(vr, fr, ["session_id", "id"]))


@query(
    "select_prior",
    f"""with {EVENTS_SQL}, {_FOLD.format(obs="obs", drp="drp")}, c as (select session_id, id, pos, rel, tok, cast(ceil(tok / 4.0) as bigint) as cost, rel >= 2 as top from act),
  s as (select *, case when top then 10.0 else case when rel = 1 then 5.0 else 1.0 end + case when count(*) over (partition by session_id, top) > 1
      then (row_number() over (partition by session_id, top order by pos, id) - 1) / (count(*) over (partition by session_id, top) - 1.0) else 1.0 end end as score,
      coalesce(sum(case when top then cost end) over (partition by session_id), 0) as spent from c),
  r as (select *, sum(cost) over (partition by session_id, top order by score desc, pos, id rows unbounded preceding) as run from s)
  select session_id, id, pos, rel, cost from r where top or spent + run <= {LINE_BUDGET // 10}""",
)
def select_prior(spark, d):
    ev = _events(spark, d)
    active = ledger.fold(adapters.observations(ev), adapters.drops(ev))
    return ledger.select_prior(active, LINE_BUDGET // 10, F.ceil(F.col("tok") / 4).cast("long")).select("session_id", "id", "pos", "rel", "cost")


@query(
    "cap_source",
    f"""with {EVENTS_SQL} select session_id, pos, tok from (select *, sum(tok) over (partition by session_id order by pos desc rows unbounded preceding) as run, row_number() over (partition by session_id order by pos desc) as rn from src)
  where run <= {LINE_BUDGET} or rn = 1""",
)
def cap_source(spark, d):
    return ledger.cap_newest(adapters.sources(_events(spark, d)), LINE_BUDGET).select("session_id", "pos", "tok")


@query(
    "existing_summary",
    f"""with {EVENTS_SQL}, {_FOLD.format(obs="obs", drp="drp")} select session_id, id, pos, tok from (
  select *, sum(tok) over (partition by session_id order by pos, id rows unbounded preceding) as run, row_number() over (partition by session_id order by pos, id) as r from act) where run <= {POOL} or r = 1""",
)
def existing_summary(spark, d):
    ev = _events(spark, d)
    return ledger.cap_oldest(ledger.fold(adapters.observations(ev), adapters.drops(ev)), POOL).select("session_id", "id", "pos", "tok")


@query(
    "created_after",
    f"""with {EVENTS_SQL}, c as (select session_id, max(covers) as cursor from refl where covers >= 0 group by session_id)
  select session_id, id, pos, tok from (select o.*, row_number() over (partition by o.session_id, id order by pos) as rn from obs o left join c using (session_id) where pos > coalesce(cursor, -1)) where rn = 1""",
)
def created_after(spark, d):
    """Observations recorded since the reflections' furthest coverage."""
    ev = _events(spark, d)
    cursor = ledger.latest_coverage(adapters.reflections(ev)).select("session_id", F.col("covered").alias("at"))
    return ledger.created_after(adapters.observations(ev), cursor).select("session_id", "id", "pos", "tok")


@query(
    "merge_records",
    f"""with {EVENTS_SQL}, e as (select 0 as turn, session_id, id, pos, tok from refl join sess using (session_id) where pos < n // 2 union all select 1, session_id, id, pos, tok from refl join sess using (session_id) where pos >= n // 2)
  select session_id, id, pos, tok from (select *, row_number() over (partition by session_id, id order by turn, pos) as rn from e) where rn = 1""",
)
def merge_records(spark, d):
    """Reflections of the first half of each log, joined by those of the second that are new."""
    ev = _events(spark, d)
    half = ev.select("session_id", "n").distinct().select("session_id", F.floor(F.col("n") / 2).alias("half"))
    rows = adapters.reflections(ev).join(half, "session_id").select("session_id", "id", "pos", "tok", (F.col("pos") < F.col("half")).alias("old"))
    return ledger.merge_records(rows.filter("old").drop("old"), rows.filter("not old").drop("old"))


# ------------------------------------------------------------------------------------------------ provenance


@query(
    "recall_sources",
    """with c as (select distinct l_orderkey as reflection, l_partkey as entry from lineitem), s as (select c.reflection, case when p_size is null or p_size > 40 then 'missing' when p_size <= 5 then 'non_source' else 'resolved' end as status from c left join part on p_partkey = entry)
  select reflection, cast(count(*) filter (status = 'resolved') as bigint) as resolved, cast(count(*) filter (status = 'non_source') as bigint) as non_source, cast(count(*) filter (status = 'missing') as bigint) as missing from s group by 1""",
)
def recall_sources(spark, d):
    """Each order's parts by what became of them: large parts are not on the branch, small ones are no sources."""
    edges = adapters.supports(table(spark, d, "lineitem")).withColumnRenamed("observation", "entry")
    branch = table(spark, d, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("entry"), (F.col("p_size") > 5).alias("is_source"))
    return provenance.status_counts(provenance.classify(edges, branch), "reflection")


@query(
    "recall_reflection",
    """with s as (select distinct l_orderkey as reflection, l_partkey as observation from lineitem)
  select o_orderkey as reflection, cast(count(p_partkey) as bigint) as supports, cast(count(distinct p_brand) as bigint) as sources, cast(count(s.observation) - count(p_partkey) as bigint) as unsupported
  from orders join s on s.reflection = o_orderkey left join part on p_partkey = s.observation and p_size <= 40 group by 1""",
)
def recall_reflection(spark, d):
    """From a reflection to its observations to their sources: how many of each, and observations that are gone."""
    edges = adapters.supports(table(spark, d, "lineitem")).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("reflection")), "reflection")
    obs = table(spark, d, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("observation"), F.col("p_brand").alias("source"))
    found = edges.join(obs, "observation", "left")
    return found.groupBy("reflection").agg(F.count("source").alias("supports"), F.countDistinct("source").alias("sources"), F.count_if(F.col("source").isNull()).alias("unsupported"))


@query(
    "reverse_recall",
    """with s as (select distinct l_orderkey as reflection, l_partkey as observation from lineitem), o as (select p_partkey as observation from part where p_brand = 'Brand#11' or p_size = 7)
  select reflection, cast(count(*) as bigint) as matched from s where observation in (select observation from o) group by 1""",
)
def reverse_recall(spark, d):
    """Reflections that rest on observations which cite the entries asked for."""
    cited = table(spark, d, "part").select(F.col("p_partkey").alias("observation"), F.col("p_brand").alias("entry"), "p_size").filter("entry = 'Brand#11' or p_size = 7")
    return provenance.supported_by(adapters.supports(table(spark, d, "lineitem")), cited)


def _tiers(spark, d, until: str) -> DataFrame:
    early = table(spark, d, "orders").filter(F.col("o_orderdate") < F.lit(until).cast("timestamp_ntz")).select(F.col("o_orderkey").alias("reflection"))
    edges = adapters.supports(table(spark, d, "lineitem")).join(early, "reflection")
    obs = table(spark, d, "part").select(F.col("p_partkey").alias("observation"), F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("tok"))
    return provenance.coverage(obs, edges)


def _tier_sql(until: str) -> str:
    return f"""select p_partkey as observation, p_brand as brand, cast(p_size as bigint) as tok, coalesce(n, 0) as supports, case when coalesce(n, 0) >= 2 then 'strong' when n = 1 then 'partial' else 'none' end as tier
  from part left join (select l_partkey, count(distinct l_orderkey) as n from lineitem join orders on o_orderkey = l_orderkey where o_orderdate < timestamp '{until}' group by 1) on l_partkey = p_partkey"""


@query(
    "coverage_tiers",
    f"""with t as ({_tier_sql(BOUNDARY)}), g as (select distinct p_brand as brand, tier from part, (values ('none'), ('partial'), ('strong')) x(tier))
  select g.brand, g.tier, cast(count(t.observation) as bigint) as n, cast(coalesce(sum(t.tok), 0) as bigint) as tokens from g left join t on t.brand = g.brand and t.tier = g.tier group by 1, 2""",
)
def coverage_tiers(spark, d):
    """Counts and tokens by brand and tier, zeros included."""
    return provenance.coverage_grid(_tiers(spark, d, BOUNDARY), "brand")


@query(
    "coverage_transitions",
    f"""with a as ({_tier_sql(BOUNDARY)}), b as ({_tier_sql("1995-04-15")}) select a.brand, a.tier as before, b.tier as after, cast(count(*) as bigint) as count from a join b using (observation) where a.tier <> b.tier group by 1, 2, 3""",
)
def coverage_transitions(spark, d):
    return provenance.transitions(_tiers(spark, d, BOUNDARY), _tiers(spark, d, "1995-04-15"), "brand")


@query("support_histogram", "with e as (select l_orderkey, count(distinct l_partkey) as supports from lineitem group by 1) select supports, cast(count(*) as bigint) as reflections from e group by 1")
def support_histogram(spark, d):
    return provenance.support_histogram(adapters.supports(table(spark, d, "lineitem")))


@query("support_stats", "with e as (select l_orderkey, count(distinct l_partkey) as s from lineitem group by 1) select count(*) as n, cast(sum(s) as bigint) as total, min(s) as least, max(s) as most, avg(s) as mean from e")
def support_stats(spark, d):
    return provenance.support_stats(adapters.supports(table(spark, d, "lineitem")))


@query(
    "related_by_session",
    f"with {EVENTS_SQL} select session_id, id as reflection, count(distinct sup) as matched from refl where (session_id, sup) in (select session_id, id from obs where rel = 2) group by 1, 2",
)
def related_by_session(spark, d):
    """Reflections that rest on observations of high relevance; ids are those of the session."""
    ev = _events(spark, d)
    found = adapters.observations(ev).filter("rel = 2").select("session_id", F.col("id").alias("observation"))
    supports = adapters.reflections(ev).select("session_id", F.col("id").alias("reflection"), F.col("sup").alias("observation"))
    return provenance.supported_by(supports, found, "session_id")


@query(
    "citing_by_session",
    f"with {EVENTS_SQL} select session_id, id as observation, count(distinct covers) as matched from obs where (session_id, covers) in (select session_id, pos from src) group by 1, 2",
)
def citing_by_session(spark, d):
    """Observations that cite source entries, and how many each does."""
    ev = _events(spark, d)
    cites = adapters.observations(ev).select("session_id", F.col("id").alias("observation"), F.col("covers").alias("entry"))
    return provenance.citing(cites, adapters.sources(ev).select("session_id", F.col("pos").alias("entry")), "session_id").drop("entries")


@query(
    "reflect_status",
    f"""with {EVENTS_SQL}, {_FOLD.format(obs="obs", drp="drp")}, p as (select session_id, pos, id, (session_id, sup) in (select session_id, id from act) as good from refl),
  r as (select *, row_number() over (partition by session_id, id, good order by pos) as rn from p)
  select session_id, id as content, case when not good then 'rejected' when rn > 1 then 'duplicate' else 'recorded' end as status, count(*) as n from r group by 1, 2, 3""",
)
def reflect_status(spark, d):
    """What becomes of proposed reflections: their supports must be active, and none is recorded twice."""
    ev = _events(spark, d)
    active = ledger.fold(adapters.observations(ev), adapters.drops(ev))
    proposals = adapters.reflections(ev).select("session_id", F.col("pos").alias("place"), F.col("id").alias("content"), F.array("sup").alias("support_ids"))
    return extraction.reflect(proposals, active).groupBy("session_id", "content", "status").agg(F.count("*").alias("n"))


_RATIO = "least(greatest(tokens / 2000.0, 0.10), 1.0)"


@query(
    "drop_candidates",
    f"""with {EVENTS_SQL}, {_FOLD.format(obs="obs", drp="drp")}, sp as (select session_id, sup as id, count(distinct id) as supports from refl group by 1, 2),
  c as (select a.session_id, a.id, a.rel, a.tok, a.pos, coalesce(sp.supports, 0) as supports from act a left join sp using (session_id, id)),
  p as (select session_id, cast(sum(tok) as double) as tokens, count(*) filter (rel < 3) as droppable from c group by 1),
  m as (select session_id, case when droppable = 0 or tokens / 2000.0 < 0.10 then 0 else greatest(1, floor(droppable * (0.10 + ({_RATIO} - 0.10) / 0.90 * 0.40))) end as max_drops from p),
  r as (select c.*, row_number() over (partition by session_id order by case when supports >= 2 then 0 when supports = 1 then 1 else 2 end, rel, pos, id) as drop_rank from c)
  select session_id, id, rel, supports, drop_rank from r join m using (session_id) where drop_rank <= max_drops""",
)
def drop_candidates(spark, d):
    ev = _events(spark, d)
    active = ledger.fold(adapters.observations(ev), adapters.drops(ev))
    sup = adapters.reflections(ev).select("session_id", F.col("sup").alias("id"), F.col("id").alias("r")).distinct().groupBy("session_id", "id").agg(F.count("*").alias("supports"))
    rows = active.join(sup, ["session_id", "id"], "left").withColumn("supports", F.coalesce("supports", F.lit(0)))
    return dropping.candidates(rows, 2000).select("session_id", "id", "rel", "supports", F.col("drop_rank").cast("long").alias("drop_rank"))


@query(
    "relevance_counts",
    f"with {EVENTS_SQL}, {_FOLD.format(obs='obs', drp='drp')} select session_id, " + ", ".join(f"cast(count(*) filter (rel = {k}) as bigint) as {n}" for k, n in enumerate(fixed.RELEVANCE)) + " from act group by 1",
)
def relevance_counts(spark, d):
    ev = _events(spark, d)
    return dropping.relevance_counts(ledger.fold(adapters.observations(ev), adapters.drops(ev)))


@query(
    "merge_sections",
    f"""with {LOG_SQL}, l as (select session_id, pos, role, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from msg),
  h as (select session_id, pos, no, line, row_number() over (partition by session_id, line order by role <> 'user', pos, no) as first_, role <> 'user' as late from l where line <> ''),
  k as (select *, row_number() over (partition by session_id order by late desc, pos desc, no desc) as back from h where first_ = 1)
  select session_id, string_agg(line, chr(10) order by late, pos, no) as lines from k where back <= 8 group by 1""",
)
def merge_sections(spark, d):
    """Lines of the user's messages, then new ones of the others, of which the last eight stay."""
    own = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", F.filter(F.split("text", "\n"), lambda x: x != "").alias("lines"))))), lambda s: s["lines"]))
    sides = _log(spark, d).groupBy("session_id").agg(own(F.col("role") == "user").alias("a"), own(F.col("role") != "user").alias("b"))
    kept = windows.merge_capped(F.col("a"), F.col("b"), 8)
    return sides.select("session_id", F.array_join(kept, "\n").alias("lines")).filter("lines <> ''")


# ------------------------------------------------------------------------------------------------ summaries and triggers


def _conversation_blocks(spark, d) -> DataFrame:
    kind = F.when(F.col("role") == "user", "user").when(F.col("role") == "assistant", "assistant")
    none = F.lit(None).cast("string")
    rows = _log(spark, d).withColumn("kind", kind).filter("kind is not null")
    return rows.select("session_id", F.col("pos").alias("message_index"), F.lit(0).alias("part_idx"), "kind", text.sanitize(F.col("text")).alias("text"), none.alias("name"), none.alias("args"), F.lit(False).alias("is_error"), none.alias("command"), none.alias("output"))


@query("compile_conversations")
def compile_conversations(spark, d):
    """Each conversation's summary: goals, blockers, preferences and a brief transcript."""
    return summary.compile_sessions(summary.prepared(_conversation_blocks(spark, d))).select("session_id", "summary", "n_blocks")


_DUE = {"observeAfterTokens": 1_000, "reflectAfterTokens": 2_000, "observationsPoolMaxTokens": 2_000, "dropperPressureThreshold": 0.7, "reflectorInputMaxTokens": 2_500}


@query(
    "stages_due",
    f"""with {EVENTS_SQL}, {_FOLD.format(obs="obs", drp="drp")},
  """ + ", ".join(
        f"""m_{t} as (select session_id, max(covers) as cursor from {t} where covers >= 0 group by session_id),
  s_{t} as (select s.session_id, sum(case when s.pos > coalesce(m.cursor, -1) then s.tok else 0 end) as n from src s left join m_{t} m using (session_id) group by 1)"""
        for t in ("obs", "refl", "drp")
    ) + """, h as (select session_id, sum(tok) as held from act group by 1)
  select s_obs.session_id, s_obs.n >= 1000 as observe, s_refl.n >= 2000 as reflect, coalesce(held, 0) / 2000.0 >= 0.10 and (coalesce(held, 0) >= 1750 or s_drp.n >= 2000) as drop
  from s_obs join s_refl using (session_id) join s_drp using (session_id) left join h using (session_id)""",
)
def stages_due(spark, d):
    """Which sessions are due for observation, reflection and dropping."""
    ev = _events(spark, d)
    markers = {"observed": adapters.observations(ev), "reflected": adapters.reflections(ev), "dropped": adapters.drops(ev)}
    return due.due(adapters.sources(ev), markers, ledger.fold(markers["observed"], markers["dropped"]), _DUE)


def _trigger_rows(spark, d) -> DataFrame:
    ev = _events(spark, d)
    kind = F.when(F.col("event_type").isin("view", "click"), "source").when(F.col("event_type") == "purchase", "marker")
    return ev.select("session_id", "pos", kind.alias("kind"), "tok").filter("kind is not null")


_TRIGGERS = f"""with recursive {EVENTS_SQL}, t as (select session_id, pos, event_type = 'purchase' as marker, tok, row_number() over (partition by session_id order by pos) as i from ev where event_type in ('view', 'click', 'purchase')),
  run(session_id, i, pos, tokens, carry) as (
    select session_id, i, pos, case when marker then 0 else tok end, case when marker or tok >= 400 then 0 else tok end from t where i = 1
    union all
    select t.session_id, t.i, t.pos, case when marker then 0 else carry + tok end, case when marker or carry + tok >= 400 then 0 else carry + tok end from run join t on t.session_id = run.session_id and t.i = run.i + 1)
  select session_id, pos, tokens from run where tokens >= 400"""


@query("stage_due_batch", _TRIGGERS)
def stage_due_batch(spark, d):
    """Where each session's tokens since its last marker or trigger reach the threshold."""
    return due.triggers_batch(_trigger_rows(spark, d), 400)


@query("stage_due_stream", _TRIGGERS)
def stage_due_stream(spark, d):
    """The same found by a stateful stream over files of the log, until all of them are read."""
    scratch = Scratch(spark, "stream")
    rows = scratch.table(_trigger_rows(spark, d), "log")
    # a session's positions arrive in order: its rows are in one file each, so no file overtakes another
    stream = spark.readStream.schema(rows.schema).parquet(f"{scratch.root}/log")
    out = f"{scratch.root}/out"
    run = due.triggers(stream, 400).writeStream.format("parquet").option("checkpointLocation", f"{scratch.root}/state").outputMode("append").trigger(availableNow=True).start(out)
    run.awaitTermination()
    found = spark.read.schema(f"session_id {rows.schema['session_id'].dataType.simpleString()}, pos long, tokens long, late boolean").parquet(out)
    return found.filter("not late").drop("late")


# ------------------------------------------------------------------------------------------------ cuts, cursors and pools


_OWN = f"""with {LOG_SQL}, s as (select session_id, count(*) as live, coalesce(max(pos) filter (role = 'user'), 0) as u from msg group by 1),
  own as (select session_id, live, u, case when live > 2 and u > 0 then u end as cut,
    case when live <= 2 then 'too_few_live_messages' when u <= 0 then 'compact_all' else 'cut' end as reason from s)"""


@query(
    "host_cut",
    f"""{_OWN}, a as (select *, case when session_id % 3 < 2 and session_id % 3 * 2 < live then session_id % 3 * 2 end as spot from own)
  select session_id, cast(live as bigint) as live, case when spot > 0 then spot when spot = 0 and u > 0 then null else cut end as cut,
    case when spot > 0 then 'cut' when spot = 0 and u > 0 then 'too_few_live_messages' else reason end as reason from a""",
)
def host_cut(spark, d):
    """A host asks to keep everything, everything from the third entry on, or an entry that isn't there."""
    log = _log(spark, d)
    at = F.when(F.col("session_id") % 3 < 2, F.col("session_id") % 3 * 2)
    return windows.host_cut(log, log.select("session_id", at.alias("asked")).distinct())


@query(
    "kept_stats",
    f"""{_OWN} select session_id, count(*) filter (not coalesce(pos >= cut, false)) as summarized, count(*) filter (pos >= cut) as kept,
    cast(round(sum(case when pos >= cut then length(text) else 0 end) / 4.0) as bigint) as kept_tokens from msg join own using (session_id) group by 1""",
)
def kept_stats(spark, d):
    log = _log(spark, d)
    return windows.kept_stats(log, windows.own_cut(log))


def _named(p: Column) -> Column:
    return F.concat(F.lit("e"), p.cast("string"))


def _last(rows: DataFrame, stage: str, shift: int) -> DataFrame:
    """A cursor of the stage in each session, ``shift`` entries from its last row."""
    return rows.groupBy("session_id").agg(F.max("pos").alias("p")).select("session_id", F.lit(stage).alias("stage"), _named(F.col("p") + shift).alias("entry_id"), F.lit("done").alias("state"))


@query(
    "valid_cursors",
    f"""with {EVENTS_SQL}, c as (select session_id, 'reflect' as stage, max(pos) - 5 as p from refl group by 1 union all select session_id, 'drop', max(pos) + 1000000 from drp group by 1),
  m as (select session_id, 'reflect' as stage, max(covers) as covered from refl where covers >= 0 group by 1 union all select session_id, 'drop', max(covers) from drp where covers >= 0 group by 1)
  select c.session_id, c.stage, coalesce(e.pos, covered) as at, case when e.pos is null then 'initial' else 'done' end as state
  from c left join ev e on e.session_id = c.session_id and e.pos = p left join m on m.session_id = c.session_id and m.stage = c.stage where coalesce(e.pos, covered) is not null""",
)
def valid_cursors(spark, d):
    """Cursors of reflections that may point before the log, and of drops that point beyond it."""
    ev = _events(spark, d)
    refl, drp = adapters.reflections(ev), adapters.drops(ev)
    cursors = _last(refl, "reflect", -5).unionByName(_last(drp, "drop", 1_000_000))
    covered = [ledger.latest_coverage(rows).select("session_id", F.lit(stage).alias("stage"), "covered") for rows, stage in ((refl, "reflect"), (drp, "drop"))]
    return windows.valid_cursors(cursors, ev.select("session_id", "pos", _named(F.col("pos")).alias("entry_id")), covered[0].unionByName(covered[1]))


@query(
    "advanced_cursors",
    f"""with {EVENTS_SQL}, c as (select session_id, arg_min(covers, pos) as a, arg_max(covers, pos) as b from obs group by 1)
  select session_id, 'observe' as stage, concat('e', greatest(a, b)) as entry_id, greatest(a, b) as at, case when b >= a then 'new' else 'old' end as state from c""",
)
def advanced_cursors(spark, d):
    """Cursors at what each session's first observation covers, after a run that covered what its last one does."""
    obs = adapters.observations(_events(spark, d)).groupBy("session_id").agg(F.min_by("covers", "pos").alias("a"), F.max_by("covers", "pos").alias("b"))
    side = lambda c, state: obs.select("session_id", F.lit("observe").alias("stage"), _named(F.col(c)).alias("entry_id"), F.col(c).alias("at"), F.lit(state).alias("state"))
    return windows.advance(side("a", "old"), side("b", "new"))


@query(
    "earlier_marker",
    f"with {EVENTS_SQL}, f as (select session_id, min(pos) filter (event_type = 'purchase') as a, min(pos) filter (event_type = 'error') as b from ev group by 1) select session_id, least(coalesce(a, b), coalesce(b, a)) as at from f",
)
def earlier_marker(spark, d):
    """The first entry that observes or drops."""
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("pos")))
    return _events(spark, d).groupBy("session_id").agg(first("purchase").alias("a"), first("error").alias("b")).select("session_id", ledger.earlier(F.col("a"), F.col("b")).alias("at"))


@query(
    "pool_pressure",
    f"""with {EVENTS_SQL}, {_FOLD.format(obs="obs", drp="drp")}, p as (select session_id, cast(sum(tok) as bigint) as tokens, count(*) filter (rel < 3) as droppable from act group by 1),
  f as (select *, case when tokens > 0 then tokens / 2000.0 else 0.0 end as fullness from p)
  select *, case when fullness < 0.30 then 'low' when fullness < 0.60 then 'medium' else 'high' end as urgency,
    case when droppable = 0 or fullness < 0.10 then 0 else cast(greatest(1, floor(droppable * (0.10 + (least(fullness, 1.0) - 0.10) / 0.90 * 0.40))) as bigint) end as max_drops
  from (select session_id, tokens, droppable, cast(fullness as double) as fullness from f)""",
)
def pool_pressure(spark, d):
    """How full each session's pool is, how urgent dropping is, and how many may go."""
    ev = _events(spark, d)
    return dropping.pool(ledger.fold(adapters.observations(ev), adapters.drops(ev)), 2000)


@query("drop_proposals", f"select session_id, id, drop_rank from ({ORACLES['drop_candidates']})")
def drop_proposals(spark, d):
    """What the dropper proposes, with supports counted from the reflections."""
    ev = _events(spark, d)
    supports = adapters.reflections(ev).select("session_id", F.col("id").alias("reflection"), F.col("sup").alias("id"))
    found = extraction.drop(ledger.fold(adapters.observations(ev), adapters.drops(ev)), supports, 2000)
    return found.withColumn("drop_rank", F.col("drop_rank").cast("long"))


def _first_line(body: str, ids: list[str]) -> list[dict]:
    """An extractor for the query below: the beginning of the text, of a relevance that is known only for some texts."""
    return [{"content": body.split("\n")[0][:80], "relevance": "high" if "er" in body else "odd", "source_ids": ids}]


@query(
    "observe_status",
    f"""with {LOG_SQL}, c as (select session_id, trim(left(string_split(text, chr(10))[1], 80)) as content, contains(text, 'er') as known from msg),
  g as (select session_id, content, content = '' or not known as bad, count(*) as n from c group by 1, 2, 3)
  select session_id, sha256(content)[1:12] as id, case when bad then 'rejected' else 'recorded' end as status, case when bad then n else 1 end as n, cast(ceil(length(content) / 4.0) as bigint) as tok from g
  union all select session_id, sha256(content)[1:12], 'duplicate', n - 1, cast(ceil(length(content) / 4.0) as bigint) from g where not bad and n > 1""",
)
def observe_status(spark, d):
    """What becomes of proposed observations: one from each message."""
    rows = _log(spark, d).select("session_id", "text", F.array("entry_id").alias("source_ids"))
    return extraction.observe(rows, _first_line).groupBy("session_id", "id", "status").agg(F.count("*").alias("n"), F.min("tok").alias("tok"))


# ------------------------------------------------------------------------------------------------ texts, paths and calls


@query(
    "merge_expanded",
    f"""with {LOG_SQL}, h as (select session_id, pos, left(text, 40) as summary from msg where role = 'user'), x as (select session_id, pos, text from msg where pos <= 1)
  select session_id, pos, coalesce(x.text, h.summary) as summary, x.text is not null as expanded from h full join x using (session_id, pos)""",
)
def merge_expanded(spark, d):
    """The user's messages in short, with the first two entries in full."""
    log = _log(spark, d)
    hits = log.filter("role = 'user'").select("session_id", "pos", F.substring("text", 1, 40).alias("summary"))
    return search.merge_expanded(hits, log.filter("pos <= 1").select("session_id", "pos", F.col("text").alias("summary")))


@query(
    "truncate_records",
    """select doc_id, case when length(t) > 500 then concat(left(t, 500), '… [truncated ', length(t) - 500, ' chars]') else t end as record
  from (select doc_id, coalesce(text, '') as t from documents)""",
)
def truncate_records(spark, d):
    return _documents(spark, d).select("doc_id", text.truncate_record(F.col("text"), 500).alias("record"))


@query(
    "term_snippet",
    """with t as (select doc_id, coalesce(text, '') as t, instr(lower(coalesce(text, '')), 'heing') as spot from documents),
  w as (select *, greatest(spot - 60, 1) as a, least(spot + 65, length(t) + 1) as b from t where spot > 0)
  select doc_id, concat(case when a > 1 then '...' else '' end, substring(t, a, b - a), case when b <= length(t) then '...' else '' end) as snippet from w""",
)
def term_snippet(spark, d):
    return _documents(spark, d).select("doc_id", text.snippet(F.col("text"), "heing").alias("snippet")).filter("snippet is not null")


_TALK = {0: "Hmm, wait - ", 1: "okay so ", 2: "So, so, so, ", 3: ""}


@query(
    "strip_self_talk",
    "select doc_id, regexp_replace(concat(case doc_id % 4 "
    + " ".join(f"when {k} then '{v}'" for k, v in _TALK.items())
    + f" end, left(coalesce(text, ''), 100)), '{fixed.SELF_TALK}', '') as said from documents",
)
def strip_self_talk(spark, d):
    """The beginning of each text after words that say nothing; at most two of them go."""
    before = F.element_at(F.create_map(*(F.lit(x) for kv in _TALK.items() for x in kv)), (F.col("doc_id") % 4).cast("int"))
    return _documents(spark, d).select("doc_id", text.strip_self_talk(F.concat(before, F.substring("text", 1, 100))).alias("said"))


@query(
    "compress_bash",
    rf"""with l as (select doc_id, string_split(concat('cd /work && ', left(coalesce(text, ''), doc_id % 300), ' | sort -u | head -3'), chr(10)) as ls from documents),
  j as (select doc_id, array_to_string(list_filter(list_transform(ls, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), '; ') as line from l),
  c as (select doc_id, regexp_replace(regexp_replace(line, '^cd\s+\S+\s*&&\s*', ''), '{fixed.PIPE_TAIL}', '') as line from j),
  h as (select doc_id, line, left(line, 119) as head, 119 - instr(reverse(left(line, 119)), ' ') as spot from c)
  select doc_id, case when length(line) <= 120 then line else concat(rtrim(left(line, case when instr(head, ' ') > 0 and spot > 72 then spot else 117 end)), '...') end as command from h""",
)
def compress_bash(spark, d):
    """Texts as commands, with a change of directory before and formatting pipes after them."""
    body = F.substring(F.col("text"), F.lit(1), (F.col("doc_id") % 300).cast("int"))
    return _documents(spark, d).select("doc_id", text.compress_bash(F.concat(F.lit("cd /work && "), body, F.lit(" | sort -u | head -3"))).alias("command"))


_CWD = "http://therha.example.com/en"


@query(
    "short_paths",
    f"""select page_id, case when starts_with(url, '{_CWD}/') then concat('.', substring(url, {len(_CWD) + 1}))
  when len(string_split(url, '/')) > 3 then concat('.../', array_to_string(string_split(url, '/')[-3:], '/')) else url end as path from pages""",
)
def short_paths(spark, d):
    return table(spark, d, "pages").select("page_id", text.short_path(F.col("url"), _CWD).alias("path"))


@query(
    "common_directories",
    """with p as (select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, string_split(regexp_replace(url, '^https?:/', ''), '/') as a from pages),
  w as (select page_id, a, lag(a) over (partition by host order by page_id) as b from p),
  n as (select page_id, a, list_max(list_filter(range(1, least(len(a), len(b))), lambda i: a[1:i] = b[1:i])) as n from w)
  select page_id, case when n >= 2 then concat(array_to_string(a[1:n], '/'), '/') else '' end as directory from n""",
)
def common_directories(spark, d):
    """The directory that a page shares with the page before it of the same host."""
    path = F.regexp_replace("url", "^https?:/", "")
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), path.alias("path"))
    before = F.lag("path").over(Window.partitionBy("host").orderBy("page_id"))
    return rows.withColumn("_before", before).select("page_id", text.common_directory(F.array_compact(F.array("path", "_before"))).alias("directory"))


_ARGS = {
    0: '{{"path": "{0}", "content": "x"}}',
    1: '{{"command": "{0}", "path": 7}}',
    2: '{{"query": "{0}"}}',
    3: '{{"j": "{0}", "k": 1}}',
    4: '{{"path": "{0}", "content": ""}}',
    5: '{{"path": "{0}", "oldText": "", "newText": "y"}}',
}


@query(
    "call_summaries",
    "with c as (select p_partkey, case p_partkey % 6 "
    + " ".join(f"when {k} then concat('{v.format(chr(0)).split(chr(0))[0]}', p_name, '{v.format(chr(0)).split(chr(0))[1]}')" for k, v in _ARGS.items())
    + """ end as args from part),
  s as (select p_partkey, args, case when json_type(args, '$.path') = 'VARCHAR' then json_extract_string(args, '$.path') end as path from c)
  select p_partkey, path, case when path is not null then concat('path=', path) when json_exists(args, '$.command') then concat('command=', json_extract_string(args, '$.command'))
    when json_exists(args, '$.query') then concat('query=', json_extract_string(args, '$.query')) else array_to_string(json_keys(args), ', ') end as summary,
    path is not null and (coalesce(json_extract_string(args, '$.content'), '') <> '' or coalesce(json_extract_string(args, '$.newText'), '') <> '') as writes from s""",
)
def call_summaries(spark, d):
    """Calls by their arguments: the path, what is shown of them, and whether they write something."""
    parts = {k: v.format("\0").split("\0") for k, v in _ARGS.items()}
    args = F.coalesce(*(F.when(F.col("p_partkey") % 6 == k, F.concat(F.lit(a), "p_name", F.lit(b))) for k, (a, b) in parts.items()))
    rows = table(spark, d, "part").select("p_partkey", args.alias("args"))
    return rows.select("p_partkey", blocks.path_of(F.col("args")).alias("path"), blocks.summary_of(F.col("args")).alias("summary"), blocks.content_bearing(F.col("args")).alias("writes"))
