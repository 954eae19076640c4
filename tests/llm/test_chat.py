"""Chat formatting: exact round trips, layouts, the loss mask and edge rows."""

import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopcast.llm import chat

PARTS = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "\\c", "\\z", "\\n", "\n", " ", "a", "é", "<", "[", "/", "𐍈", "s>", "INST]", "$1"])
TEXT = st.lists(PARTS, max_size=8).map("".join)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "to\nol", "[INST]", ""]), TEXT), max_size=5), min_size=8, max_size=8))
def test_round_trip_and_mask(spark, convs):
    df = spark.createDataFrame([(i, [{"role": r, "text": t} for r, t in c]) for i, c in enumerate(convs)],
                               f"conv_id int, turns {chat.TURNS}")
    f = df.withColumn("formatted", chat.render(F.col("turns"))).withColumn("mask", chat.loss_mask(F.col("turns")))
    for r in f.withColumn("back", chat.read_back(F.col("formatted"))).collect():
        assert [(t["role"], t["text"]) for t in r["back"]] == convs[r["conv_id"]]
        assert sum(r["mask"]) == len(r["formatted"])
        at, learnt = 0, []
        for i, n in enumerate(r["mask"]):
            if i % 2:
                learnt.append(r["formatted"][at:at + n])
            at += n
        said = "".join(t for role, t in convs[r["conv_id"]] if role == "assistant")
        assert "".join(learnt).replace("\\c", "").replace("\\z", "\\") == said


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, "messages_content", [("user", "q"), ("assistant", "")]),
    ({"messages": [{"text": "q", "role": "user"}]}, "messages_text", [("user", "q")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations_from", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "response": "a"}, "prompt_response", [("user", "q"), ("assistant", "a")]),
    ({"completion": 7, "prompt": "q"}, "prompt_completion", [("user", "q"), ("assistant", "7")]),
    ({"instruction": "do", "output": "a"}, "instruction_output", [("user", "do"), ("assistant", "a")]),
    ({"instruction": "do", "input": "this", "output": "a"}, "instruction_input_output", [("user", "do\n\nthis"), ("assistant", "a")]),
    ({"instruction": "do", "input": "", "output": None}, "instruction_input_output", [("user", "do"), ("assistant", "")]),
    ({"system": "s", "prompt": "q", "response": "a"}, "system_prompt_response", [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "response": "a", "more": 1}, "unknown", None),
]


@pytest.mark.parametrize("record,layout,turns", LAYOUTS)
def test_layouts(spark, record, layout, turns):
    df = spark.createDataFrame([(json.dumps(record),)], "j string").select(F.parse_json("j").alias("record"))
    r = chat.canonical_turns(df, "record").first()
    assert r["layout"] == layout and (None if r["turns"] is None else [(t["role"], t["text"]) for t in r["turns"]]) == turns


BESIDE = [
    ({"id": "x1", "conversations": [{"from": "human", "value": "q"}]}, "conversations_from", [("user", "q")]),
    ({"source": {"name": "s"}, "messages": [{"role": "user", "content": "q", "weight": 1}, {"role": "assistant", "content": None}]},
     "messages_content", [("user", "q"), ("assistant", "")]),
    ({"messages": [{"role": "user", "text": "q", "meta": {"role": "z"}}], "tags": []}, "messages_text", [("user", "q")]),
    ({"messages": []}, "messages_text", []),
    ({"messages": None, "id": 7}, "messages_text", []),
    ({"conversations": [], "id": 7}, "conversations_from", []),
    ({"messages": [{"role": "user", "text": "q", "content": "p"}]}, "unknown", None),
    ({"messages": [{"role": "user", "content": [{"type": "text"}]}]}, "unknown", None),
    ({"system": "s", "conversations": [{"from": "human", "value": "q"}]}, "unknown", None),
    ({"messages": [{"role": "user"}]}, "unknown", None),
    ({"messages": ["q", "a"]}, "unknown", None),
    ({"messages": "q"}, "unknown", None),
    ({"id": 1}, "unknown", None),
    ([], "unknown", None),
    (7, "unknown", None),
]


def test_fields_beside_and_empty_lists(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(BESIDE)], "i int, j string").select("i", F.parse_json("j").alias("record"))
    rows = chat.format_chats(df).collect()
    for r in rows:
        _, layout, turns = BESIDE[r["i"]]
        assert r["layout"] == layout and (None if r["turns"] is None else [(t["role"], t["text"]) for t in r["turns"]]) == turns, BESIDE[r["i"]]
        assert turns != [] or r["formatted"] == "<s>"
    assert len(rows) == len(BESIDE)


def test_rows_by_turn(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (2, 0, None, "x"), (None, 0, "assistant", "n"), (1, 1, "assistant", "b</s>"),
            (3, 0, "assistant", "long " * 100000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("messages", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(chat.records_of(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == sha("user\n\n" + "assistant\nb</s>\n" * 2)
    assert got[1]["loss_sha256"] == sha("b</s>b</s>") and got[1]["loss_chars"] == 10
    assert got[2]["turns_sha256"] == sha("\nx\n") and got[2]["loss_sha256"] == sha("") and got[None]["loss_chars"] == 1
    assert got[3]["loss_chars"] == 500000
    assert chat.digests(chat.format_chats(chat.records_of(df.limit(0)))).count() == 0


def test_loss_digests_come_from_the_mask(spark):
    import hashlib
    rows = [(1, 0, "user", "q </s>"), (1, 1, "assistant", "one\\ [INST] é"), (1, 2, "assistant", ""), (1, 3, "assistant", "two"), (2, 0, "user", "x"), (3, 0, "assistant", "𐍈 y")]
    records = chat.records_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole = chat.format_chats(records)
    got = {r["conv_id"]: (r["loss_chars"], r["loss_sha256"]) for r in chat.digests(whole).collect()}
    for c in (1, 2, 3):
        said = "".join(t for i, _, role, t in rows if i == c and role == "assistant")
        assert got[c] == (len(said), hashlib.sha256(said.encode()).hexdigest())
    wrong = whole.withColumn("loss_mask", F.transform("loss_mask", lambda n, i: F.when((i % 2 == 1) & (n > 1), n - 1).otherwise(n)))
    off = {r["conv_id"]: r["loss_chars"] for r in chat.digests(wrong).collect()}
    assert off[1] < got[1][0] and off[2] == 0                  # a wrong mask shows
