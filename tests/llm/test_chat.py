import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat
from tessera.llm.queries import QUERIES

PARTS = [*chat.CONTROL, "\\", "\n", "n", "<", "|", "s", ">", "[", "]", "é", "im_start", " "]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=12).map("".join)


def brute(turns):
    own = [(role or "", text or "") for _, role, text in turns]
    loss = "".join(text for role, text in own if role == "assistant")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(own), digest("".join(f"{role}\n{text}\n" for role, text in own)), len(loss), digest(loss)


@given(TEXTS)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(x in chat.escape(text) for x in chat.CONTROL)


@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=6), st.integers(2, 5))
def test_spans_of_prefixes_make_up_the_whole_and_read_back(turns, window):
    spans = list(chat.spans(iter(turns), chat.marked, window))
    assert "".join(spans) == chat.marked(turns)
    assert [chat.read_marked(x) for x in spans] == turns


def test_templates_that_rewrite_history_are_refused():
    def counting(turns):
        return f"{len(turns)} turns: " + "".join(text for _, text in turns)

    def closing(turns):
        return "".join(f"{role}: {text}\n" for role, text in turns) + "end"

    for template in (counting, closing):
        with pytest.raises(chat.Rewritten):
            list(chat.spans(iter([("user", "a"), ("assistant", "b")]), template))
    assert list(chat.spans(iter([("user", "a"), ("assistant", "b")]), lambda turns: "<s>" + "".join(t for _, t in turns))) == ["a", "b"]


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    turns = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    rows = QUERIES["op7_chat"](spark, folder).collect()
    assert sorted(r.conv_id for r in rows) == sorted(turns)
    for r in rows:
        assert tuple(r)[1:5] == brute(sorted(turns[r.conv_id])) and r.formatted_chars > 0


def test_edge_cases(spark):
    rows = [(1, None, "user", "b"), (1, 0, None, None), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (None, 5, "a\nb\\n", "x"), (2, 1, "assistant", "y" * 100_000)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, span string, place int")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.rendered(frame)).collect()}
    assert got[1] == brute([(None, "user", "b"), (0, "", ""), (0, "assistant", "a"), (0, "assistant", "a")])
    assert got[None] == brute([(5, "a\nb\\n", "x")]) and got[2] == brute([(1, "assistant", "y" * 100_000)])
    assert chat.digests(chat.rendered(frame.limit(0))).count() == 0


def test_long_conversation_streams(spark):
    turns = spark.range(500).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    row = chat.digests(chat.rendered(turns)).first()
    assert tuple(row)[1:5] == brute([(i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(500)])


def test_long_conversations_are_rendered_whole():
    turns = [("user" if i % 2 == 0 else "assistant", str(i)) for i in range(60)]

    def numbered(turns):
        return "".join(f"{i} {role}: {text}\n" for i, (role, text) in enumerate(turns))

    def rewriting(turns):
        return "".join(text + "\n" for _, text in turns).replace("0\n", "gone\n" if len(turns) > 50 else "0\n", 1)

    assert "".join(chat.spans(iter(turns), numbered)) == numbered(turns)
    with pytest.raises(chat.Rewritten):
        list(chat.spans(iter(turns), rewriting))
