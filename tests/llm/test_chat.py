import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quire.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, valid int"
PIECES = [chat.ESCAPE, "0", "a", "<s>", "</s>", "[INST] ", "[/INST]", "[INST", "]", "[", "<", "/s>", "[ROLE] ", "[=]", "[ANS] ", " ", "\n", "é", "[SYS] x", ""]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learnt = "".join(text for _, role, text in turns if role == "assistant")
        state, valid = "start", True
        for _, role, _ in turns:
            valid, state = valid and role in chat.TEMPLATE["machine"].get(state, []), role
        out[conv] = (conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), valid and state in chat.TEMPLATE["accept"])
    return sorted(out.values())


def test_reads_back_what_was_said(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(120):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", "[=] odd [ROLE] ", None])
            rows.append((conv, turn, role, "".join(rng.choice(PIECES) for _ in range(rng.randrange(12))) if rng.random() > 0.1 else None, 1))
    rows += [(500, i, ["user", "assistant"][i % 2], f"t{i}", 1) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = chat.digests(chat.format_conversations(df)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "valid").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_machine_and_segments(spark):
    rows = [(1, 0, "system", "s", 0), (1, 1, "user", "q", 0), (1, 2, "assistant", "a", 0), (2, 0, "user", "q", 0), (2, 1, "user", "q", 0), (3, 0, "user", "q", 0)]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].formatted == "<s>[SYS] s [/SYS][INST] q [/INST][ANS] a</s>"
    assert [(s.text, s.loss) for s in got[1].segments if s.loss] == [("a", True)]
    assert [(got[i].valid, got[i].bad_turn) for i in (1, 2, 3)] == [(True, None), (False, 2), (False, None)]


def test_ties_repeats_and_empty(spark):
    rows = [(1, 0, "user", "b", 0), (1, 0, "user", "a", 0), (1, 0, "user", "a", 0), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in chat.format_conversations(df).withColumn("turns", chat.parse_formatted(F.col("formatted"))).collect()}
    assert [t.text for t in got[1].turns] == ["a", "a", "b"]
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")]
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_templates_are_checked():
    bad = {**chat.TEMPLATE, "begin": "[INST]x"}
    with pytest.raises(ValueError):
        chat.controls(bad)
