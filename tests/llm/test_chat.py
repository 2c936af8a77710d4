import hashlib
import json

import pytest

from reviewloom.llm.chat import LAYOUTS, MAPPINGS, canonical, escaped, format_chats, formatted, paths, read_chats, read_turns, records_of, unescaped, unmapped
from reviewloom.llm.queries import ORACLES, QUERIES
from tests.compare import differences, duck

ODD = ["", "\\", "\\n", "<|", "<\\|", "<<|im_end|>\n", "<|im_start|>assistant\nx<|im_end|>\n", "|im_end|>", "é\U0001f600 \x00", "a\n\n", "\\\\<|\\"]


@pytest.mark.parametrize("text", ODD)
def test_escapes_come_back(text):
    assert unescaped(escaped(text)) == text and "<|" not in escaped(text)
    turns = [("user", text), ("assistant", text), (text, "x"), ("assistant", text + "<")]
    out, spans = formatted(turns)
    assert read_turns(out) == turns
    assert [unescaped(out[a:b]) for a, b in spans] == [text, text + "<"]


def test_every_layout_is_found_by_its_fingerprint():
    assert len(MAPPINGS) == len(LAYOUTS)
    examples = {
        "prompt_response": {"response": "b", "prompt": "a"}, "prompt_completion": {"prompt": "a", "completion": "b"}, "question_answer": {"question": "a", "answer": "b"},
        "instruction": {"instruction": "a", "output": "b"}, "instruction_input": {"instruction": "a", "input": None, "output": "b"},
        "instruction_system": {"system": "s", "instruction": "a", "output": "b"}, "messages": {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        "nested_messages": {"data": {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}},
        "shared_dialogue": {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
    }
    assert examples.keys() == LAYOUTS.keys()
    for layout, record in examples.items():
        _, found, turns = canonical(json.dumps(record))
        assert found == layout and [t for t in turns if t[0] != "system"] == [("user", "a"), ("assistant", "b")]
    for bad in (None, "", "[]", "3", "{", '{"prompt": "a"}', '{"messages": []}', "null"):
        assert canonical(bad)[1:] == ("unknown", [])
    assert paths({"a": [{"b": 1}, {"c": {"d": None}}], "e": []}) == {"a[].b", "a[].c.d", "e[]"}


@pytest.mark.parametrize("record, layout", [
    ({"id": 1, "prompt": "a", "response": "b", "meta": {"x": [1]}}, "prompt_response"), ({"instruction": "a", "input": "", "output": "b", "id": 2}, "instruction_input"),
    ({"messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "assistant", "content": "b"}]}, "messages"),
    ({"data": {"id": 3, "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "source": "s"}, "nested_messages"),
])
def test_further_fields_are_optional(record, layout):
    assert canonical(json.dumps(record))[1:] == (layout, [("user", "a"), ("assistant", "b")])


def test_unknown_records_stay(spark):
    odd = [{"prompt": "a", "response": "b", "system": "s"}, {"system": "s", "instruction": "a", "input": "i", "output": "b"}, {"data.messages[].role": 1, "data.messages[].content": 2},
           {"messages": [{"role": "user", "content": "a"}, "b"]}, {"text": "x"}]  # a text would be lost
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate([*odd, {"prompt": "a", "response": "b"}])], "conv_id long, record string")
    got = {r.conv_id: json.loads(r.record) for r in unmapped(format_chats(df)).collect()}
    assert got == dict(enumerate(odd))


def test_records_take_all_layouts(spark):
    turns = [(i, k, r, f"{r}\n\n{i}\n\n") for i in range(300) for k, r in enumerate([("user", "assistant"), ("system", "user", "assistant"), ("tool", "user")][i % 3])]
    chats = format_chats(records_of(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))
    assert {r.layout for r in chats.select("layout").distinct().collect()} == LAYOUTS.keys()
    assert chats.select("fingerprint").distinct().count() > len(LAYOUTS)
    back = [(r.conv_id, k, t.role, t.text) for r in read_chats(chats).collect() for k, t in enumerate(r.turns)]
    assert sorted(back) == sorted(turns)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    problem, n = differences(spark, duck(sf), QUERIES["op9_schema_fingerprints"], ORACLES["op9_schema_fingerprints"], sf)
    assert not problem and n > 1


def test_odd_rows(spark):
    rows = [(None, 1, None, None, 1), (None, None, "user", "u", 2), (1, 0, "assistant", "a", 3), (1, 0, "assistant", "a", 4), (2, 1, "tool", "x" * 300_000, 5), (2, 0, "system", "", 6)]
    rows += [(3, i, "assistant" if i % 2 else "user", t, 7) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in read_chats(format_chats(records_of(df))).collect()}
    assert [(t.role, t.text) for t in got[None].turns] == [("user", "u"), ("", "")]
    assert got[1].loss_text == "aa" and len(got[1].turns) == 2
    assert [(t.role, len(t.text)) for t in got[2].turns] == [("system", 0), ("tool", 300_000)] and got[2].loss_text == ""
    assert got[3].loss_text == "".join(ODD[1::2]) and [t.text for t in got[3].turns] == ODD
    assert read_chats(format_chats(records_of(df.limit(0)))).collect() == []


def test_own_conversation(spark):
    row = QUERIES["op9_schema_fingerprints"](spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    said = "<|im_end|><|im_start|>assistant ok"
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and row.n_turns == 2 and row.loss_chars == len(said)
