"""A session's summary: sections from its blocks, a brief transcript, and the merge with an earlier summary.

What does not depend on order is done in columns before (noise, text clean-up, compressed commands, clipped bodies).
Here, one session's blocks are walked in order, as several rules depend on what came before. A session that is
compacted is no longer than the threshold that triggers its compaction.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.functions import fixed, text
from tracefold.operators import blocks as blocks_of

_SCOPE, _TASK, _SHORT, _NOT_GOAL, _TEMPLATE, _BLOCKER = (re.compile(p) for p in (fixed.SCOPE_CHANGE, fixed.TASK, fixed.SHORT_NOISE, fixed.NOT_A_GOAL, fixed.TEMPLATE_START, fixed.BLOCKER))
_PREFERENCES = [re.compile(p) for p in fixed.PREFERENCES]
_COMMIT, _HASHES = re.compile(fixed.COMMIT_MESSAGE), [re.compile(p) for p in fixed.COMMIT_HASHES]


def clip(s: str, most: int) -> str:
    if len(s) <= most:
        return s
    at = s.rfind(" ", 0, most + 1)
    return s[: at if at > most * 0.6 else most]


def clip_sentence(s: str, most: int) -> str:
    ends = [m.start() + 1 for m in re.finditer(r"[.!?](?:\s|$)", s[:most])]
    return s if len(s) <= most else s[: ends[-1]] if ends and ends[-1] >= most / 2 else clip(s, most)


def _lines(s: str) -> list[str]:
    return [x for x in map(str.strip, s.split("\n")) if x]


def goals(rows: list[dict]) -> list[str]:
    """The first user block that states goals, and the last change of scope after it."""
    first, change = [], []
    for row in rows:
        if row["kind"] != "user":
            continue
        lines = _lines(row["text"])
        stop = next((i for i, x in enumerate(lines) if _TEMPLATE.search(x)), len(lines))
        stated = [x for x in lines[:stop] if 5 < len(x) <= 200 and not _SHORT.search(x) and not _NOT_GOAL.search(x)]
        stated = [re.sub(r"^\s*(?:[-*+]|\d+\.)\s+", "", x).strip() for x in text.collapse_skill_lines(stated)]
        stated = [x for x in stated if len(x) > 5]
        if not stated:
            continue
        if not first:
            first = stated[:6]
            continue
        opening = row["text"][:200]
        take = 3 if _SCOPE.search(opening) else 2 if _TASK.search(opening) and len(stated[0]) > 15 else 0
        if take:
            change = [clip(x, 200) for x in stated[:take]]
    return (first + (["[Scope change]", *change] if change else []))[: fixed.GOALS]


def preferences(rows: list[dict], besides: list[str]) -> list[str]:
    """The first new line of each user block that says how something is wanted, unless it is a goal."""
    found: dict[str, str] = {}
    for row in rows:
        if row["kind"] == "user":
            for line in _lines(row["text"]):
                wanted = 5 <= len(line) <= 200 and not line.endswith("?") and "?..." not in line and any(p.search(line) for p in _PREFERENCES)
                if wanted and line.lower() not in found:
                    found[line.lower()] = line
                    break
    known = {g.strip().lower() for g in besides}
    return [v for k, v in list(found.items())[: fixed.PREFERENCE_LINES] if k not in known]


def commits(rows: list[dict]) -> list[str]:
    """Messages of git commits, each with the hash in one of the two blocks that follow."""
    found: dict[tuple[str, str], None] = {}
    for i, row in enumerate(rows):
        m = row["kind"] == "tool_call" and row["name"] == "bash" and row["command"] and _COMMIT.search(row["command"])
        if not m:
            continue
        said = next((g for g in m.groups() if g is not None), "").replace('\\"', '"').replace("\\'", "'").strip()
        message = re.split(r"\\n|\n", said)[0].strip()
        if message:
            results = [r["text"] or "" for r in rows[i + 1 : i + 3] if r["kind"] == "tool_result"]
            hashes = (h[1] for r in results for p in _HASHES if (h := p.search(r)))
            found[next(hashes, ""), message] = None
    return [f"{h}: {m}" if h else m for h, m in list(found)[-fixed.COMMITS :]]


def files(rows: list[dict]) -> dict[str, list[str]]:
    """Paths that calls read and modify, without the directories that all absolute ones share."""
    calls = [r for r in rows if r["kind"] == "tool_call" and r["path"]]
    sides = {k: list(dict.fromkeys(r["path"] for r in calls if r["name"] in tools)) for k, tools in (("Modified", fixed.WRITE_TOOLS), ("Created", ()), ("Read", fixed.READ_TOOLS))}
    absolute = [p.replace("\\", "/") for side in sides.values() for p in side]
    absolute = [p.split("/") for p in absolute if re.match(r"/|[A-Za-z]:/", p)]
    shared = 0
    if len(absolute) > 1:
        for level in list(zip(*absolute, strict=False))[: min(map(len, absolute)) - 1]:
            if len(set(level)) > 1:
                break
            shared += 1
    prefix = "/".join(absolute[0][:shared]) + "/" if shared >= 2 else ""
    return {k: list(dict.fromkeys(p.removeprefix(prefix) for p in side)) for k, side in sides.items()}


def file_lines(sides: dict[str, list[str]]) -> list[str]:
    more = lambda n: f" (+{n - fixed.FILES} more)" if n > fixed.FILES else ""
    return [f"{k}: {', '.join(v[: fixed.FILES])}{more(len(v))}" for k, v in sides.items() if v]


def outstanding(rows: list[dict]) -> list[str]:
    """Errors and sentences about blockers in the last blocks."""
    found: list[str] = []
    for row in rows[-fixed.TAIL_BLOCKS :]:
        if row["kind"] == "tool_result" and row["is_error"]:
            found.append(f"[{row['name']}] {clip((row['text'] or '').split(chr(10))[0], 150)}")
        elif row["kind"] in ("assistant", "user"):
            for line in _lines(row["text"]):
                if len(line) >= 15 and _BLOCKER.search(line) and not re.match(r"[-*+>]\s|\(", line) and re.match(r"""["'`*_]?[A-Z`]""", line):
                    said = ("[user] " if row["kind"] == "user" else "") + clip_sentence(line, 150)
                    if said not in found:
                        found.append(said)
                    break
    return found[: fixed.BLOCKERS]


def _one_liner(row: dict) -> str:
    shown = row["shown"]
    return f'* {row["name"]} "{shown}"' if shown is not None else f"* {row['name']}"


def transcript(rows: list[dict]) -> list[dict]:
    """Sections (header, lines, refs): lines of one speaker, equal calls and equal errors in a row taken together.

    A line is (text, list of references); a header's references are those of its errors.
    """
    sections: list[dict] = []

    def put(header: str, line: str, ref: int, tool: str | None = None) -> None:
        last = sections[-1] if sections else None
        if tool is not None:
            if last and last["tool"] == tool and last["lines"][0][0] == line:
                last["refs"].append(ref)
                return
            sections.append({"header": header, "tool": tool, "refs": [ref], "lines": [(line, [])]})
            return
        if not last or last["header"] != header or last["tool"] is not None:
            sections.append({"header": header, "tool": None, "refs": [], "lines": []})
        lines = sections[-1]["lines"]
        if line.startswith("* ") and lines and lines[-1][0] == line:
            lines[-1][1].append(ref)
        else:
            lines.append((line, [ref]))

    for row in rows:
        ref = row["message_index"]
        if row["kind"] == "user":
            if line := text.truncate_plain(re.sub(fixed.SKILL_BLOCK.replace("(?s:.*?)", "[\\s\\S]*?"), r"[skill: \1]", row["text"]), fixed.BRIEF_USER_WORDS):
                put("[user]", line, ref)
        elif row["kind"] == "bash":
            if row["shown"]:
                put("[user]", f"$ {row['shown']}", ref)
        elif row["kind"] == "assistant":
            if line := text.truncate_plain(re.sub(fixed.SELF_TALK, "", row["text"]), fixed.BRIEF_ASSISTANT_WORDS):
                put("[assistant]", line, ref)
        elif row["kind"] == "tool_call" and (row["name"] or "").strip():
            put("[assistant]", _one_liner(row), ref)
        elif row["kind"] == "tool_result" and row["is_error"]:
            body = clip((row["text"] or "").split("\n")[0], 150)
            if body and body != "(no output)":
                put("[tool_error]", body, ref, row["name"] or "")
    for s in sections:
        calls = [i for i, (line, _) in enumerate(s["lines"]) if line.startswith("* ")] if s["header"] == "[assistant]" else []
        if (drop := len(calls) - fixed.TOOL_LINES) > 0:
            gone, first = set(calls[:drop]), calls[drop]
            marker = (f"* ({drop} earlier tool-call entries omitted)", [])
            s["lines"] = [x for i, line in enumerate(s["lines"]) if i not in gone for x in ([marker, line] if i == first else [line])]
    return sections


def _refs(refs: list[int]) -> str:
    return f" ({', '.join(f'#{r}' for r in refs)})" + (f" x{len(refs)}" if len(refs) > 1 else "") if refs else ""


def transcript_text(sections: list[dict]) -> str:
    out: list[str] = []
    quiet = False
    for s in sections:
        tools = s["tool"] is not None or s["header"] == "[assistant]" and all(x.startswith("* ") for x, _ in s["lines"])
        out += [""] if out and not (quiet and tools) else []
        quiet = tools
        out.append(f"[tool_error] {s['tool']}{_refs(s['refs'])}" if s["tool"] is not None else s["header"])
        out += [line + _refs(refs) for line, refs in s["lines"]]
    return "\n".join(out)


def transcript_entries(sections: list[dict]) -> list[dict]:
    """The transcript as records {role, text, tool, cmd, ref, count}."""
    out = []
    for s in sections:
        for line, refs in s["lines"]:
            own = s["refs"] or refs
            call = re.fullmatch(r'\* (\S+)(?: "(.*)")?', line, re.S) if s["header"] == "[assistant]" else None
            entry = {"role": s["header"].strip("[]"), "ref": ", ".join(f"#{r}" for r in own) or None, "count": len(own) if len(own) > 1 else None}
            entry |= {"tool": call[1], "cmd": call[2]} if call else {"text": line} | ({"tool": s["tool"]} if s["tool"] is not None else {})
            out.append(entry)
    return out


def cap_transcript(s: str) -> str:
    lines = s.split("\n")
    if len(lines) <= fixed.BRIEF_LINES:
        return s
    kept = lines[-fixed.BRIEF_LINES :]
    at = next((i for i, x in enumerate(kept) if re.match(r"\[.+\]", x)), 0)
    return f"...({len(lines) - fixed.BRIEF_LINES} earlier lines omitted)\n\n" + "\n".join(kept[at:])


def sections(rows: list[dict]) -> dict:
    stated = goals(rows)
    return {
        "Session Goal": stated,
        "Files And Changes": file_lines(files(rows)),
        "Commits": commits(rows),
        "Outstanding Context": outstanding(rows),
        "User Preferences": preferences(rows, stated),
        "transcript": transcript_text(transcript(rows)),
    }


def render(found: dict) -> str:
    heads = [f"[{k}]\n" + "\n".join(f"- {x}" for x in found[k]) for k in fixed.SECTIONS if found[k]]
    parts = ["\n\n".join(heads)] * bool(heads) + [cap_transcript(found["transcript"])] * bool(found["transcript"])
    return fixed.SEPARATOR.join(parts)


def parse(summary: str) -> dict:
    """The sections of a rendered summary; lists of lines, and the transcript."""
    head, found, transcript_ = summary, re.search(r"(?:^|\n)\n---\n\n", summary), ""
    at = summary.find(fixed.SEPARATOR)
    if found and at >= 0:
        head, transcript_ = summary[:at], summary[at + len(fixed.SEPARATOR) :].strip()
    out: dict = {k: [] for k in fixed.SECTIONS} | {"transcript": transcript_}
    current = None
    for line in head.split("\n"):
        if line.startswith("[") and line.endswith("]") and line[1:-1] in out:
            current = line[1:-1]
        elif current and line.startswith("- "):
            out[current].append(line[2:])
    if at < 0 and not any(out[k] for k in fixed.SECTIONS):
        out["transcript"] = summary.strip()
    return out


def _paths(lines: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {"Modified": [], "Created": [], "Read": []}
    for line in lines:
        kind, _, rest = line.partition(": ")
        if kind in out:
            out[kind] += [p for p in map(str.strip, re.sub(r"\s*\(\+\d+ more\)\s*$", "", rest).split(",")) if p]
    return out


def merge(before: dict, fresh: dict) -> dict:
    """Earlier and new sections: lines without repetitions, of which the last stay; blockers are the new ones only."""
    out = {"Outstanding Context": fresh["Outstanding Context"], "transcript": "\n\n".join(x for x in (before["transcript"], fresh["transcript"]) if x)}
    for k, most in (("Session Goal", fixed.GOALS), ("Commits", fixed.COMMITS), ("User Preferences", fixed.MERGED_PREFERENCES)):
        if before[k] and fresh[k]:
            out[k] = list(dict.fromkeys(x for x in before[k] + fresh[k] if "<skill" not in x and "</skill" not in x))[-most:]
        else:
            out[k] = before[k] or fresh[k]
    old, new = _paths(before["Files And Changes"]), _paths(fresh["Files And Changes"])
    both = {k: list(dict.fromkeys(old[k] + new[k])) for k in old}
    changed = set(both["Modified"])
    out["Files And Changes"] = file_lines({k: v if k == "Modified" else [p for p in v if p not in changed] for k, v in both.items()}) if before["Files And Changes"] and fresh["Files And Changes"] else before["Files And Changes"] or fresh["Files And Changes"]
    return out


def strip_notes(summary: str) -> str:
    """An earlier summary without its closing note and without memories, which are rendered anew."""
    s = summary.replace(text.wrap_lines(fixed.RECALL_NOTE), "").replace(fixed.RECALL_NOTE, "")
    s = s.replace(fixed.RECALL_HINT, "")
    cut = [m.start() for m in (re.search(r"(?m)^## Reflections", s), re.search(r"(?m)^## Observations", s)) if m]
    s = s[: min(cut)] if cut else s
    return re.sub(r"(\s*\n---\s*)+$", "", s.rstrip()).rstrip()


def compile_rows(rows: list[dict], previous: str | None = None) -> str:
    found = sections(rows)
    if previous and (old := strip_notes(previous)):
        found = merge(parse(old), found)
    body = render(found)
    return text.wrap_lines(body + fixed.SEPARATOR + fixed.RECALL_NOTE) if body else ""


def prepared(blocks: DataFrame) -> DataFrame:
    """Blocks without noise, with what is shown of calls and commands: (session_id, message_index, part_idx, kind, text, name, path, command, shown, is_error)."""
    args = F.col("args")
    by_field = F.lit(None).cast("string")
    for name, key in fixed.SUMMARY_FIELDS.items():
        by_field = F.when(F.col("name") == name, blocks_of.argument(args, key)).otherwise(by_field)
    bash = F.col("name").isin("bash", "Bash")
    command = F.coalesce(blocks_of.argument(args, "command"), blocks_of.argument(args, "description"), F.lit(""))
    path = blocks_of.path_of(args)
    call = F.coalesce(by_field, path, F.when(bash, text.compress_bash(command)), text.clip(blocks_of.argument(args, "query"), 60))
    clean = blocks_of.without_noise(blocks)
    return clean.select(
        "session_id", "message_index", "part_idx", "kind", F.coalesce("text", F.lit("")).alias("text"), "name", path.alias("path"),
        blocks_of.argument(args, "command").alias("command"), F.when(F.col("kind") == "bash", text.compress_bash(F.col("command"))).otherwise(call).alias("shown"), F.coalesce("is_error", F.lit(False)).alias("is_error"),
    )


def compile_sessions(blocks: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(session_id, summary, n_blocks) for each session of prepared blocks; previous: (session_id, summary)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["message_index", "part_idx"])
        before = rows["_previous"].iloc[0] if rows["_previous"].notna().any() else None
        records = rows.astype(object).where(rows.notna(), None).to_dict("records")
        return pd.DataFrame({"session_id": [rows["session_id"].iloc[0]], "summary": [compile_rows(records, before)], "n_blocks": [len(rows)]})

    if previous is None:
        joined = blocks.withColumn("_previous", F.lit(None).cast("string"))
    else:
        joined = blocks.join(previous.select("session_id", F.col("summary").alias("_previous")), "session_id", "left")
    return joined.groupBy("session_id").applyInPandas(run, f"session_id {blocks.schema['session_id'].dataType.simpleString()}, summary string, n_blocks long")


def memory_text(observations: DataFrame, reflections: DataFrame) -> DataFrame:
    """(session_id, memory): reflections and observations as lines. observations: with id, timestamp, relevance, content."""
    line = F.concat(F.lit("["), "id", F.lit("] "), "timestamp", F.lit(" ["), "relevance", F.lit("] "), "content")
    listed = lambda df, c, title: df.groupBy("session_id").agg(F.concat(F.lit(f"## {title}\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx", c.alias("line")))), lambda s: s["line"]), "\n")).alias(title))
    r = listed(reflections, F.concat(F.lit("["), "id", F.lit("] "), "content"), "Reflections")
    o = listed(observations, line, "Observations")
    return r.join(o, "session_id", "full_outer").select("session_id", F.concat_ws("\n\n", "Reflections", "Observations", F.lit(fixed.MEMORY_NOTE)).alias("memory"))


def with_memory(summaries: DataFrame, memory: DataFrame) -> DataFrame:
    """Summaries with their session's memories below, or with the hint alone where there are none."""
    joined = summaries.join(memory, "session_id", "left")
    return joined.withColumn("summary", F.concat_ws("\n\n", F.nullif("summary", F.lit("")), F.coalesce("memory", F.lit(fixed.RECALL_HINT)))).drop("memory")
