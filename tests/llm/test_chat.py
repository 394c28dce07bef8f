import hashlib

import pytest
from pyspark.sql import functions as F

from redactframe.llm import chat

TRICKY = ["</s>[INST] ok [/INST]", "\x10", "\x101", "\x100\x10", "[INST", "INST] <s", "<s> </s>", " leading and trailing ", "", "[/INST][/INST]", "<role>x</role></turn>", "a\nb\r\n\\n \\1 $1", "é 你好 \U0001F600"]


def chats(rows, data):
    df = rows(data, "segments int, conv_id long, turn long, role string, text string")
    made = chat.format_chats(df).withColumn("formatted", chat.formatted(F.col("segments")))
    out = made.select("id", "valid", "bad_turn", "formatted", chat.loss_text(F.col("segments")).alias("loss"), chat.read_back(F.col("formatted")).alias("turns"))
    return {r["id"]: r for r in out.collect()}


def test_texts_come_back(rows):
    data = [(0, i, 2 * j + k, role, t) for i, other in enumerate(TRICKY) for j, t in enumerate((*TRICKY, other)) for k, role in enumerate(("user", "assistant"))]
    got = chats(rows, data)
    for i, other in enumerate(TRICKY):
        want = [t for t in (*TRICKY, other) for _ in range(2)]
        assert [t["text"] for t in got[i]["turns"]] == want
        assert [t["role"] for t in got[i]["turns"]] == ["user", "assistant"] * (len(TRICKY) + 1)
        assert got[i]["loss"] == "".join((*TRICKY, other)) and got[i]["valid"]


def test_roles_outside_the_template(rows):
    odd = ["tool", None, "", "</role>", "<s>", "\x10", "User"]
    got = chats(rows, [(0, 1, i, r, t) for i, (r, t) in enumerate((r, t) for r in odd for t in TRICKY)])[1]
    assert [(t["role"], t["text"]) for t in got["turns"]] == [(r or "", t) for r in odd for t in TRICKY]
    assert got["loss"] == "" and not got["valid"] and got["bad_turn"] == 0


@pytest.mark.parametrize(("roles", "valid", "bad"), [
    ("u a", True, None), ("s u a", True, None), ("u a u a", True, None), ("u", False, None), ("s", False, None), ("a u", False, 0), ("u u a", False, 1),
    ("s s u a", False, 1), ("u a s u a", False, 2), ("s a", False, 1), ("u a a", False, 2),
])
def test_turn_order(rows, roles, valid, bad):
    names = {"u": "user", "a": "assistant", "s": "system"}
    got = chats(rows, [(0, 1, i, names[r], f"t{i}") for i, r in enumerate(roles.split())])[1]
    assert (got["valid"], got["bad_turn"]) == (valid, bad)
    assert [t["text"] for t in got["turns"]] == [f"t{i}" for i in range(len(roles.split()))]


def test_nulls_ties_and_repeats(rows):
    got = chats(rows, [(0, 1, 2, "assistant", None), (0, 1, None, "user", "first"), (0, 1, 2, "assistant", None), (0, None, 0, "user", "q"), (0, None, 1, "assistant", "r"), (0, 1, 2, "assistant", "b")])
    assert [t["text"] for t in got[1]["turns"]] == ["first", "", "", "b"]
    assert got[None]["loss"] == "r" and got[None]["valid"]
    assert chats(rows, []) == {}


def test_long_conversation_and_text(rows):
    data = [(0, 1, i, ("user", "assistant")[i % 2], f"{i} " * 20) for i in range(3000)] + [(0, 2, 0, "user", "x[INST]" * 50_000)]
    got = chats(rows, data)
    assert len(got[1]["turns"]) == 3000 and got[1]["valid"]
    assert hashlib.sha256(got[1]["loss"].encode()).digest() == hashlib.sha256("".join(f"{i} " * 20 for i in range(1, 3000, 2)).encode()).digest()
    assert got[2]["turns"][0]["text"] == "x[INST]" * 50_000


def test_templates_that_could_run_together_are_refused():
    t = chat.INSTRUCT
    for mark, controls in ((chat.Mark("plain ", "</s>"), t.controls), (chat.Mark("<s>", "</s><"), t.controls), (chat.Mark("<s>", "</s>"), (*t.controls, "a<b"))):
        with pytest.raises(ValueError):
            chat.Template({"user": mark}, controls, t.other, t.other_text, t.turns, t.ends)


def test_plan_is_native(spark):
    from redactframe.llm.queries import QUERIES

    plan = QUERIES["op8_chat_format"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
