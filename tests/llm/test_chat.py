"""Chat formatting: folding, escaping and reading back."""

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tracefold.llm import chat

LOG = "conv_id long, turn long, seq long, kind string, role string, text string"


@given(st.text(alphabet=st.sampled_from(list("\\</s>[INST] abé\n"))), st.text(alphabet=st.sampled_from(list("\\[/INST]<s>u"))))
def test_escaping_is_reversible(text, role):
    formatted, *_ = chat.render(role, text)
    assert chat.read_back(formatted) == (role, text)
    body = chat.escape(text)
    assert chat.unescape(body) == text
    assert all(m[1] is None for m in chat._UNESCAPED.finditer(body))


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "\\", "<", "<<s>", "[INST", "\\</s>", ""])
def test_control_strings(text):
    formatted, a, b = chat.render("assistant", text)
    assert chat.read_back(formatted) == ("assistant", text) and chat.unescape(formatted[a:b]) == text


def test_events_are_folded(spark):
    rows = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "He"), (1, 1, 3, "delta", None, "lo"), (1, 1, 2, "delta", None, "l"),
        (1, 2, 0, "message", "assistant", "wrong"), (1, 2, 1, "regenerate", None, None), (1, 2, 2, "delta", None, "ri"), (1, 2, 3, "delta", None, "ght"),
        (1, 3, 0, "message", "user", "teh"), (1, 3, 1, "edit", None, "the"), (1, 4, 0, "delta", "assistant", "late"), (2, 0, 0, None, None, None),
    ]
    got = chat.messages(spark.createDataFrame(rows, LOG).repartition(3)).orderBy("conv_id", "turn", "no").collect()
    assert [chat.read_back(r.formatted) for r in got] == [("user", "hi"), ("assistant", "Hello"), ("assistant", "right"), ("user", "the"), ("assistant", "late"), ("", "")]
    one, two = chat.digests(chat.messages(spark.createDataFrame(rows, LOG))).orderBy("conv_id").collect()
    spoken = "Hellorightlate"
    assert one.n_turns == 5 and one.loss_chars == len(spoken) and one.loss_sha256 == hashlib.sha256(spoken.encode()).hexdigest()
    assert one.turns_sha256 == hashlib.sha256("user\nhi\nassistant\nHello\nassistant\nright\nuser\nthe\nassistant\nlate\n".encode()).hexdigest()
    assert two.n_turns == 1 and two.turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()


def test_edge_cases(spark):
    rows = [(None, 0, "user", "a"), (3, None, "user", "first"), (3, 0, "user", "b"), (3, 0, "user", "b"), (3, 0, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.messages(chat.as_events(df))).collect()}
    assert got[None].n_turns == 1 and got[3].n_turns == 4
    assert got[3].turns_sha256 == hashlib.sha256(b"user\nfirst\nassistant\n\nuser\nb\nuser\nb\n").hexdigest()
    assert chat.digests(chat.messages(chat.as_events(df.limit(0)))).count() == 0


def test_a_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(3000)]
    got = chat.digests(chat.messages(chat.as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)))).first()
    assert got.n_turns == 3000 and got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
