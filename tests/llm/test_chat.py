"""Layouts, escapes and round trips of chat formatting."""

import hashlib
import json
import random

import pytest

from pathloom.llm import chat
from tests.llm.conftest import EDGE_TEXTS

U, A, S = "user", "assistant", "system"
#: (record, layout, turns)
RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "bot", "content": None}]}, "messages", [(U, "a"), (A, "")]),
    ({"messages": [{"content": "a", "role": "Human"}], "system": ""}, "messages with system", [(U, "a")]),
    ({"messages": [{"content": "a", "role": "tool"}], "system": "be brief"}, "messages with system", [(S, "be brief"), ("tool", "a")]),
    ({"messages": []}, "messages", []),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, "shared conversation", [(U, "q"), (A, "r")]),
    ({"response": {"content": "r"}, "request": {"messages": [{"role": "user", "content": "q"}]}}, "request and reply", [(U, "q"), (A, "r")]),
    ({"prompt": "p", "completion": "c"}, "prompt and completion", [(U, "p"), (A, "c")]),
    ({"prompt": "p", "response": 12}, "prompt and response", [(U, "p"), (A, "12")]),
    ({"question": "p", "answer": None}, "question and answer", [(U, "p"), (A, "")]),
    ({"system_prompt": "s", "question": "q", "response": "r"}, "question with system", [(S, "s"), (U, "q"), (A, "r")]),
    ({"instruction": "i", "output": "o"}, "instruction", [(U, "i"), (A, "o")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction with input", [(U, "i\n\nx"), (A, "o")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction with input", [(U, "i"), (A, "o")]),
    ({"instruction": "i", "context": "x", "response": "o", "category": "z"}, "instruction with context", [(U, "i\n\nx"), (A, "o")]),
    ({"prompt": "p", "chosen": "c", "rejected": "r"}, "chosen and rejected", [(U, "p"), (A, "c")]),
    ({"dialog": ["a", "b", "c"]}, "dialog", [(U, "a"), (A, "b"), (U, "c")]),
    ({"dialog": []}, "dialog", []),
    ({"role": "user", "text": "t", "turn": 3}, "turn row", [(U, "t")]),
    ({"prompt": "p", "completion": "c", "more": 1}, None, []),
    ({"prompt": {"text": "p"}, "completion": "c"}, None, []),
    ({"a: STRING, b": "p", "STRING": "c"}, None, []),
    ({}, None, []), ([], None, []), (5, None, []),
]


def test_layouts(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(900, None), (901, "{not json"), (902, "")]
    records = spark.createDataFrame([(*r, "clash") for r in rows], "key long, record string, turns string")
    got = {r["key"]: r for r in chat.canonical(records).collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert (got[i]["layout"], [tuple(t) for t in got[i]["turns"]]) == (layout, turns), RECORDS[i]
    assert all(got[k]["layout"] is None and got[k]["turns"] == [] and got[k]["fingerprint"] for k in (900, 901, 902))
    assert len({got[i]["fingerprint"] for i in (0, 4, 5, 6, 7, 17, 18, 19)}) == 8
    found = {(r["shape"], r["layout"]): r["n"] for r in chat.layouts_of(records).collect()}
    assert found["OBJECT<input: *, instruction: *, output: *>", "instruction with input"] == 2 and sum(found.values()) == len(rows)
    assert found["OBJECT<completion: *, more: *, prompt: *>", None] == 1


def test_structs_and_variants_are_records(spark):
    rows = spark.createDataFrame([(1, ("p", "c")), (2, None)], "key long, record struct<prompt:string,completion:string>")
    assert [(r["layout"], len(r["turns"])) for r in chat.canonical(rows).orderBy("key").collect()] == [("prompt and completion", 2), (None, 0)]
    rows = rows.selectExpr("key", "parse_json(to_json(record)) as record")
    assert [(r["layout"], len(r["turns"])) for r in chat.canonical(rows).orderBy("key").collect()] == [("prompt and completion", 2), (None, 0)]


def tricky_texts(rng):
    marks = [*chat.Template().marks(), "\\", "\\~", "\\n", "~", "\n", "<", "</turn", ">", "#", "x", "é", "🎉", "\x00", "\r"]
    return ["".join(rng.choice(marks) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [t or "" for t in EDGE_TEXTS]


def expected(turns):
    """Digest columns of (role, text) pairs but the formatted length."""
    loss = "".join(t for r, t in turns if r == A)
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_round_trip(spark, size):
    rng = random.Random(size)
    texts = tricky_texts(rng)
    rows = [(i % 37 if i % 37 else None, i, rng.choice([U, A, "a\nb", "", "<turn>"]), t) for i, t in enumerate(texts)]
    records = spark.createDataFrame([(k, (r, t, n)) for k, n, r, t in rows], "key long, record struct<role:string,text:string,turn:long>").repartition(5)
    template = chat.Template()
    fragments = chat.saved(chat.formatted(chat.canonical(records), "key", template, size), "test-chat")
    want = {}
    for k, _, r, t in rows:
        want.setdefault(k, []).append((r, t))
    back = {}
    for r in chat.turns_of(fragments).orderBy("task", "part", "place").collect():
        back.setdefault(r["key"], []).append((r["role"], r["text"]))
    assert back == want
    whole = {}
    for r in fragments.orderBy("task", "part").collect():
        whole[r["key"]] = whole.get(r["key"], "") + r["formatted"]
        assert len(r["formatted"]) < size + 6000 and r["n_turns"] == len(chat.parsed(r["formatted"], template))
        inner = r["formatted"].replace(template.stop, "").replace(template.start, "")
        assert not any(m in inner for m in template.marks())
    got = {r["key"]: r for r in chat.digests(fragments).collect()}
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in got.items()} == {k: expected(v) for k, v in want.items()}
    assert {k: r["formatted_chars"] for k, r in got.items()} == {k: len(v) for k, v in whole.items()}


def test_ties_repeats_and_empty_tables(spark):
    rows = [(1, 0, U, "b"), (1, 0, U, "a"), (1, 0, U, "a"), (1, None, A, None), (1, 0, None, "z"), (None, 2, A, "n"), (None, 1, A, "m")]
    schema = "conv_id long, turn long, role string, text string"
    got = {r["conv_id"]: r for r in chat.digested(spark.createDataFrame(rows, schema)).collect()}
    want = {1: [(A, ""), ("", "z"), (U, "a"), (U, "a"), (U, "b")], None: [(A, "m"), (A, "n")]}
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in got.items()} == {k: expected(v) for k, v in want.items()}
    assert chat.digested(spark.createDataFrame([], schema)).collect() == []


def test_templates_that_cannot_be_undone_are_refused():
    for bad in ({"start": "<"}, {"stop": "--x--"}, {"controls": ("a\\b",)}):
        with pytest.raises(ValueError):
            chat.Template(**bad)
    with pytest.raises(ValueError):
        chat.parsed("x<turn>user\na</turn>\n", chat.Template())
