"""Chat formatting by event-sourced reconstruction.

A log of events (conv_id, turn, seq, kind, role, text) says how each message came about: ``message`` starts one,
``delta`` adds streamed text to it, ``edit`` replaces its text, ``regenerate`` empties it for new deltas. The events of
one turn are sorted by sequence and folded into final messages; these are rendered with a template that marks turns and
escapes control strings inside texts, so that the output can be read back. A turn's events lie together in one
partition, but those of a long conversation are spread over many; only the digest of a whole conversation, which is a
chain by its nature, streams over it in one task, holding a message at a time.

Edge cases: a null text or role is empty; a null turn comes first, null conv_ids are one conversation; rows of the
same turn are messages of their own, in order of seq, role and text; a delta, edit or regenerate before any message of
its turn starts one with the role it names; an unknown kind counts as ``message``; an empty log gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The template's control strings (fixed values).
OPEN, NAMED, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
BLOCK = 8 << 20
_ESCAPED = re.compile(r"\\|(?=" + "|".join(map(re.escape, CONTROL)) + ")")
#: An escaped character, passed over, or a control string.
_UNESCAPED = re.compile(r"(?s)\\.|(" + "|".join(map(re.escape, CONTROL)) + ")")


def escape(text: str) -> str:
    """A backslash before each control string and each backslash."""
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] else "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A message in the template; where the text begins and ends there, if it is the assistant's (else 0, 0)."""
    head = f"{OPEN}{escape(role)}{NAMED}"
    body = escape(text)
    return head + body + CLOSE, *((len(head), len(head) + len(body)) if role == "assistant" else (0, 0))


def read_back(formatted: str) -> tuple[str, str]:
    """The role and the text of a rendered message, found by its unescaped control strings."""
    at, found = 0, []
    while at < len(formatted):
        m = _UNESCAPED.search(formatted, at)
        if not m:
            break
        if m[1]:
            found.append((m.start(), m.end()))
        at = m.end()
    (_, _), (_, head), (named, body), (close, _) = found
    return unescape(formatted[head:named]), unescape(formatted[body:close])


def fold(events: Iterator[tuple[str, str, str]]) -> Iterator[tuple[str, str]]:
    """The final (role, text) of each message, from the sorted events (kind, role, text) of one turn."""
    role, held = None, []
    for kind, who, text in events:
        if kind not in ("delta", "edit", "regenerate") or role is None:
            if role is not None:
                yield role, "".join(held)
            role, held = who, [] if kind == "regenerate" else [text]
        elif kind == "delta":
            held.append(text)
        else:
            held = [text] if kind == "edit" else []
    if role is not None:
        yield role, "".join(held)


def messages(log: DataFrame) -> DataFrame:
    """The rendered final messages: (conv_id, turn, no, formatted, loss_start, loss_end), numbered in each turn."""
    names = ["conv_id", "turn", "no", "formatted", "loss_start", "loss_end"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for (conv, turn), own in groupby(rows(batches), key=lambda r: r[:2]):
            for no, (role, text) in enumerate(fold((kind, role, text) for *_, kind, role, text in own)):
                formatted, *loss = render(role, text)
                out.append((conv, turn, no, formatted, *loss))
                size += len(formatted)
                if size > BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    events = log.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # the seq and the text only order the rows of a turn
    return events.repartition("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "seq", "role", "text").drop("seq").mapInArrow(run, "conv_id long, turn long, no long, formatted string, loss_start long, loss_end long")


def digests(rendered: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its rendered messages."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def close() -> None:
            if state:
                n, turns, chars, loss, total = state
                out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        for batch in batches:
            for conv, formatted, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_back(formatted)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if b > a or role == "assistant":
                    masked = unescape(formatted[a:b])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(formatted)
            if len(out) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "no").select("conv_id", "formatted", "loss_start", "loss_end")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log: each row starts a message."""
    return conversations.select("conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return digests(messages(as_events(rows.unionByName(extra))))


ORACLE = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized as (
  select *, 20 + length(role || text)
    + length(role || chr(0) || text) - length(replace(role || chr(0) || text, '\', ''))
    + (length(role || chr(0) || text) - length(replace(role || chr(0) || text, '<s>', ''))) // 3
    + (length(role || chr(0) || text) - length(replace(role || chr(0) || text, '</s>', ''))) // 4
    + (length(role || chr(0) || text) - length(replace(role || chr(0) || text, '[INST]', ''))) // 6
    + (length(role || chr(0) || text) - length(replace(role || chr(0) || text, '[/INST]', ''))) // 7 as n
  from rows
)
select conv_id, cast(count(*) as bigint) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(n) as bigint) as formatted_chars
from sized group by conv_id
"""
