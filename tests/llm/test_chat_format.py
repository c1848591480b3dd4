from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from vacantia.llm import chat_format as c

TRICKY = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<<TEXT>>", "<</TEXT>>", "<", "[", "\\", "/s>", "a", "é\n", "<\\", "[\\/INST]"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.lists(st.sampled_from(TRICKY), max_size=8).map("".join)), max_size=5))
def test_round_trip_of_any_turns(turns):
    rendered = "".join(c.render_turn(r, t) for r, t in turns)
    assert c.parse(rendered) == turns
    parser, found = c.Parser(), []
    for piece in (c.render_turn(r, t) for r, t in turns):
        found += list(parser.feed(piece))
    assert [(r, t) for r, t, _, _ in found] == turns
    assert [c.unescape(rendered[a:b]) for _, _, a, b in found] == [t for _, t in turns]


def test_marks_are_escaped_only_where_needed():
    assert c.render_turn("user", "plain [x] < y") == "[INST]plain [x] < y[/INST]"
    assert c.render_turn("user", "</s>[INST] ok [/INST]") == "[INST]<\\/s>[\\INST] ok [\\/INST][/INST]"
    assert c.render_turn("x", None) == "<<ROLE>>x<<TEXT>><</TEXT>>"


@pytest.mark.parametrize("broken", ["a", "[INST]", "[INST]a</s>", "<s>[INST]</s>", "[/INST]", "<<ROLE>>a<</TEXT>>"])
def test_wrong_grammar_fails(broken):
    with pytest.raises(c.GrammarError):
        c.parse(broken)


def test_conversations_with_nulls_ties_and_extra_columns(spark):
    schema = "conv_id long, turn long, role string, text string, place string, piece string"
    long_text = "word " * 50_000
    given_rows = [
        (1, 1, "assistant", "b", "x", "y"), (1, 0, "user", None, "x", "y"), (1, 1, "assistant", "a", "x", "y"), (1, 1, "assistant", "a", "x", "y"),
        (None, None, None, "t", "x", "y"), (2, 0, "assistant", long_text, "x", "y"),
    ]
    df = spark.createDataFrame(given_rows, schema)
    formatted = c.format_conversations(df)
    out = {r["conv_id"]: r for r in c.read_back(formatted).collect()}
    turns = [("user", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]
    assert out[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert (out[1]["n_turns"], out[1]["loss_chars"]) == (4, 3)
    assert out[1]["loss_sha256"] == hashlib.sha256(b"aab").hexdigest()
    assert out[2]["loss_chars"] == len(long_text) and out[2]["formatted_chars"] == len(long_text) + 7
    assert out[None]["n_turns"] == 1
    spans = sorted(tuple(r) for r in c.loss_spans(formatted).where("conv_id = 1").collect())
    assert [b - a for _, a, b in spans] == [1, 1, 1]
    assert c.read_back(c.format_conversations(df.limit(0))).count() == 0


def test_equal_turns_are_ordered_by_text_and_not_by_its_rendering(spark):
    texts = ["a b", "a", "<", "</s>", "<s", "b", "", "[INST]", "[z", None]
    df = spark.createDataFrame([(1, 0, "user", t) for t in texts], "conv_id long, turn long, role string, text string")
    out = c.read_back(c.format_conversations(df)).first()
    ordered = sorted(t or "" for t in texts)
    assert out["turns_sha256"] == hashlib.sha256("".join(f"user\n{t}\n" for t in ordered).encode()).hexdigest()
