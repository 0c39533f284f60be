"""Text functions on small inputs."""

import pytest
from pyspark.sql import functions as F

from tracefold.functions import text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "column, value, want",
    [
        (text.sanitize, "a\r\nb\rc\x1b[31mred\x1b[0m\x07\t.", "a\nb\ncred\t."),
        (lambda c: text.clip(c, 10), "short", "short"),
        (lambda c: text.clip(c, 10), "abcdefgh ijkl", "abcdefgh"),
        (lambda c: text.clip(c, 10), "ab cdefghijklmn", "ab cdefghi"),
        (lambda c: text.clip(c, 10), "abcdefghij klm", "abcdefghij"),
        (lambda c: text.clip_sentence(c, 20), "One is here. Two goes on and on", "One is here."),
        (lambda c: text.clip_sentence(c, 20), "One. Twogoesonandonandon", "One. Twogoesonandona"),
        (text.tokens, "12345", 2),
        (text.tokens, "", 0),
        (text.hash_id, "x", "2d711642b726"),
        (text.words, " a b ", 4),
        (lambda c: text.term_frequency(F.lower(c), "Aa"), "AaaAaa", 3),
        (lambda c: text.line_snippet(c, "TARGET"), "l0\nl1\nl2 TARGET\nl3\nl4\nl5", "l0\nl1\nl2 TARGET\nl3\nl4\n...(1 lines below)"),
        (lambda c: text.line_snippet(c, "none"), "l0", None),
        (lambda c: text.snippet(c, "mid", 3), "abcdefmidghijkl", "...defmidghi..."),
        (text.strip_wrappers, "a<system-reminder x>b\nc</system-reminder>d", "ad"),
        (text.strip_self_talk, "Hmm, actually, do it", "do it"),
        (text.collapse_skills, 'x <skill name="s" a="b">body</skill> y', "x [skill: s] y"),
        (text.compress_bash, "cd /a/b && ls -la | grep x | head -5 | wc -l", "ls -la | grep x"),
        (text.compress_bash, "a\n\n b", "a; b"),
        (lambda c: text.truncate_record(c, 3), "abcdef", "abc… [truncated 3 chars]"),
        (lambda c: text.short_path(c, "/home/x"), "/home/x/a/b.py", "./a/b.py"),
        (lambda c: text.short_path(c, "/home/x"), "/v/a/b/c.py", ".../a/b/c.py"),
        (lambda c: text.thousands(F.length(c) * 500), "abc", "1.5k"),
    ],
)
def test_column(spark, column, value, want):
    assert one(spark, column, value) == want


@pytest.mark.parametrize(
    "paths, want",
    [(["/a/b/c/d.py", "/a/b/e.py"], "/a/b/"), (["/a/b/c.py", "/a/x/c.py"], "/a/"), (["/a/b.py", "/x/b.py"], ""), (["/a/b/c.py"], ""), (["/a/b/c.py", "rel", "/a/b/c/d.py"], "/a/b/")],
)
def test_common_directory(spark, paths, want):
    assert spark.createDataFrame([(paths,)], "p array<string>").select(text.common_directory(F.col("p"))).first()[0] == want


def test_budget_counts_only_words_that_matter():
    assert text.truncate_plain("the quick brown fox", 2) == "the quick brown...(truncated)"
    assert text.truncate_plain("the  quick\nfox", 2) == "the quick fox"


def test_wrapping_keeps_list_indent():
    assert text.wrap_lines("- aaa bbb ccc", 8).split("\n") == ["- aaa", "  bbb", "  ccc"]


def test_skill_lines():
    assert text.collapse_skill_lines(['<skill name="a">', "x", "</skill>", "y", '<skill name="a">', "</skill>"]) == ["[skill: a]", "y"]
