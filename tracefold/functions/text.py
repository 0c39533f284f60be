"""Text functions as Column expressions.

Lengths are in code points and white space is ASCII, so that the same expression says the same in other SQL engines.
"""

from __future__ import annotations

import re
import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefold.functions import fixed


def sanitize(c: Column) -> Column:
    """Line feeds only, no ANSI sequences, no control characters but tab and line feed."""
    for pattern, to in (("\r\n", "\n"), ("\r", "\n"), (fixed.ANSI, ""), (fixed.CONTROL, "")):
        c = F.regexp_replace(c, F.lit(pattern), F.lit(to))
    return c


def strip_wrappers(c: Column, tags: tuple[str, ...] = fixed.WRAPPER_TAGS) -> Column:
    """The text without elements of these tags."""
    return F.regexp_replace(c, F.lit(rf"(?s)<({'|'.join(map(re.escape, tags))})[^>]*>.*?</\1>"), F.lit(""))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(r"^\s+|\s+$"), F.lit(""))


def clip(c: Column, most: int) -> Column:
    """The first ``most`` characters, or up to the last space there if that is beyond 60 % of them."""
    head = F.substring(c, 1, most + 1)
    at = F.char_length(head) - F.instr(F.reverse(head), " ")  # of the last space, from 0
    has = F.instr(head, " ") > 0
    end = F.when(has & (at > most * 0.6), at).otherwise(F.lit(most))
    return F.when(F.char_length(c) <= most, c).otherwise(F.substring(c, F.lit(1), end.cast("int")))


def clip_sentence(c: Column, most: int) -> Column:
    """Up to the last sentence end in the first ``most`` characters if it is in their second half, else clipped."""
    found = F.regexp_extract(F.substring(c, 1, most), r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.char_length(c) <= most, c).when(F.char_length(found) >= most * 0.5, found).otherwise(clip(c, most))


def non_empty_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), trim), lambda x: x != "")


def first_line(c: Column, most: int = 200) -> Column:
    return clip(F.element_at(F.split(c, "\n"), 1), most)


def tokens(c: Column) -> Column:
    """Four characters a token, rounded up."""
    return F.ceil(F.char_length(c) / F.lit(4.0)).cast("long")


def hash_id(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def words(c: Column) -> Column:
    """How many parts white space divides the text into, empty ones included."""
    return F.size(F.split(c, r"\s+", -1)).cast("long")


def term_frequency(lower: Column, term: str) -> Column:
    """Occurrences of a literal term in a text in lower case."""
    t = term.lower()
    return ((F.char_length(lower) - F.char_length(F.replace(lower, F.lit(t), F.lit("")))) / F.lit(len(t))).cast("long")


def bm25(tf: Column, df: Column, docs: Column, length: Column, mean: Column) -> Column:
    idf = F.log((docs - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (fixed.BM25_K + 1) / (tf + fixed.BM25_K * (1 - fixed.BM25_B + fixed.BM25_B * length / mean))


def first_match(lines: Column, pattern: str) -> Column:
    """The place, from 0, of the first line that matches; null if none does."""
    return F.nullif(F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True), F.lit(0)) - 1


def line_window(lines: Column, at: Column, around: int) -> tuple[Column, Column, Column]:
    """(lines around a place, how many are above, how many below)."""
    start = F.when(at.isNotNull(), F.greatest(at - around, F.lit(0)))
    end = F.when(at.isNotNull(), F.least(at + around + 1, F.size(lines)))
    return F.array_join(F.slice(lines, (start + 1).cast("int"), (end - start).cast("int")), "\n"), start.cast("long"), (F.size(lines) - end).cast("long")


def line_snippet(c: Column, pattern: str, around: int = 2) -> Column:
    """Lines around the first that matches; null if none does. The text is split and searched once."""
    found = F.transform(F.array(F.split(c, "\n")), lambda lines: F.struct(lines.alias("lines"), first_match(lines, pattern).alias("at")))

    def shown(s: Column) -> Column:
        body, above, below = line_window(s["lines"], s["at"], around)
        note = lambda n, where: F.when(n > 0, F.concat(F.lit("...("), n, F.lit(f" lines {where})")))
        return F.when(s["at"].isNotNull(), F.array_join(F.array(note(above, "above"), body, note(below, "below")), "\n"))

    return F.get(F.transform(found, shown), F.lit(0))


def snippet(c: Column, term: str, radius: int = 60) -> Column:
    """Characters around the first occurrence of a literal term."""
    at = F.instr(F.lower(c), term.lower())
    start, end = F.greatest(at - radius, F.lit(1)), F.least(at + len(term) + radius, F.char_length(c) + 1)
    text = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(c, start, end - start), F.when(end <= F.char_length(c), "...").otherwise(""))
    return F.when(at > 0, text)


def strip_self_talk(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(fixed.SELF_TALK), F.lit(""))


def collapse_skills(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(fixed.SKILL_BLOCK), F.lit(r"[skill: $1]"))


def compress_bash(c: Column, most: int = fixed.BASH_CHARS) -> Column:
    """One line without a leading cd and trailing formatting pipes, cut at a word."""
    line = F.array_join(non_empty_lines(c), "; ")
    line = F.regexp_replace(F.regexp_replace(line, F.lit(r"^cd\s+\S+\s*&&\s*"), F.lit("")), F.lit(fixed.PIPE_TAIL), F.lit(""))
    head = F.substring(line, 1, most - 1)
    at = F.char_length(head) - F.instr(F.reverse(head), " ")
    end = F.when((F.instr(head, " ") > 0) & (at > most * 0.6), at).otherwise(F.lit(most - 3))
    cut = F.concat(F.rtrim(F.substring(line, F.lit(1), end.cast("int"))), F.lit("..."))
    return F.when(F.char_length(line) <= most, line).otherwise(cut)


def truncate_record(c: Column, most: int = fixed.RECORD_CHARS) -> Column:
    more = (F.char_length(c) - most).cast("string")
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit("… [truncated "), more, F.lit(" chars]"))).otherwise(c)


def short_path(c: Column, cwd: str = "") -> Column:
    """./ below the working directory, else the last three parts."""
    parts = F.split(c, "/")
    tail = F.when(F.size(parts) > 3, F.concat(F.lit(".../"), F.array_join(F.slice(parts, -3, 3), "/"))).otherwise(c)
    return F.when(c.startswith(cwd + "/"), F.concat(F.lit("."), F.substring(c, len(cwd) + 1, 1 << 30))).otherwise(tail) if cwd else tail


def common_directory(paths: Column) -> Column:
    """The directories that all absolute paths of an array begin with, if two paths share two parts; else empty."""
    absolute = F.filter(F.transform(paths, lambda p: F.replace(p, F.lit("\\"), F.lit("/"))), lambda p: p.rlike("^(/|[A-Za-z]:/)"))
    first, last = F.split(F.array_min(absolute), "/"), F.split(F.array_max(absolute), "/")
    # what the least and the greatest path share, all share
    most = F.array_min(F.transform(absolute, lambda p: F.size(F.split(p, "/")))) - 1
    same = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: F.slice(first, F.lit(1), i) == F.slice(last, F.lit(1), i))
    n = F.coalesce(F.array_max(same), F.lit(0))
    return F.when((F.size(absolute) >= 2) & (n >= 2) & (most >= 2), F.concat(F.array_join(F.slice(first, F.lit(1), n), "/"), F.lit("/"))).otherwise("")


def thousands(c: Column) -> Column:
    return F.when(c >= 1000, F.format_string("%.1fk", c / 1000)).otherwise(c.cast("string"))


_WORD = re.compile(r"[^\W_]+")


def truncate_plain(text: str, limit: int) -> str:
    """The text in one line, cut before the word that would exceed the budget of words that count."""
    flat = re.sub(r"\s+", " ", text).strip()
    count, end = 0, 0
    for m in _WORD.finditer(flat):
        if m[0].lower() not in fixed.BRIEF_STOPWORDS:
            count += 1
            if count > limit:
                return flat[:end].rstrip() + "...(truncated)"
        end = m.end()
    return flat


def truncate_words(limit: int):
    """truncate_plain as a vectorized function; the order-dependent budget has no Column form."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else truncate_plain(t, limit))

    return run


def wrap_line(line: str, width: int = fixed.LINE_WIDTH) -> list[str]:
    """Lines of at most ``width`` characters; those of a list item are indented like its text."""
    if len(line) <= width:
        return [line]
    indent = " " * min(8, len(re.match(r"\s*(?:[-*]\s+|\d+\.\s+)?", line)[0]))
    return textwrap.wrap(line, width, subsequent_indent=indent, break_long_words=True, break_on_hyphens=False, drop_whitespace=True, replace_whitespace=False) or [""]


def wrap_lines(text: str, width: int = fixed.LINE_WIDTH) -> str:
    return "\n".join(w for line in text.split("\n") for w in wrap_line(line, width))


def collapse_skill_lines(lines: list[str]) -> list[str]:
    """One line for each skill that is named, none for what its block holds."""
    out, seen, inside = [], set(), False
    for line in lines:
        if opened := re.match(r"""-?\s*<skill\s+name="([^"]+)\"""", line):
            inside = True
            if opened[1] not in seen:
                seen.add(opened[1])
                out.append(f"[skill: {opened[1]}]")
        elif inside:
            inside = not re.match(r"-?\s*</skill>", line)
        else:
            out.append(line)
    return out
