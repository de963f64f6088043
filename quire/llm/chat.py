"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

Everything is built from DataFrame functions.  A template names what stands before and after each role's text and whether
the text is learnt from; control strings inside texts are escaped, so the formatted text can be read back whole.

Escaping.  ``ESCAPE`` becomes ``ESCAPE 0`` and control string number i becomes ``ESCAPE`` and the i-th letter.  No control
string holds the escape character, so replacing cannot make a new one, and every escape character in an escaped text is
followed by its code: reading the codes back in any order, the escape character's own last, restores the text.

Defined results
  * null text is empty, a null role is the empty role; roles that the template does not name are written with their name
    and make the conversation invalid, but are formatted all the same;
  * turns are ordered by ``turn`` (nulls first), ties by role, then by escaped text; repeated rows stay repeated;
  * rows with a null ``conv_id`` form one conversation; an empty table gives an empty result; further columns are ignored;
  * one conversation becomes one text, so its turns meet in one task: a conversation must fit a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import read

ESCAPE = "␛"

TEMPLATE = {
    "begin": "<s>",
    "roles": {
        "system": {"open": "[SYS] ", "close": " [/SYS]", "loss": False},
        "user": {"open": "[INST] ", "close": " [/INST]", "loss": False},
        "assistant": {"open": "[ANS] ", "close": "</s>", "loss": True},
    },
    "other": {"open": "[ROLE] ", "named": "[=]", "close": " [/ROLE]"},
    "machine": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "accept": ["assistant"],
}


def controls(template: dict) -> list[str]:
    """The template's control strings without the spaces around them, checked to be readable without ambiguity."""
    marks = [template["begin"], *template["other"].values(), *(r[k] for r in template["roles"].values() for k in ("open", "close"))]
    out = list(dict.fromkeys(m.strip() for m in marks))
    for a in out:
        if not a or ESCAPE in a:
            raise ValueError(f"not a control string: {a!r}")
        for b in out:
            if (a != b and a in b) or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b))) if a != b or n < len(a)):
                raise ValueError(f"control strings overlap: {a!r}, {b!r}")
    return out


def _codes(template: dict) -> list[tuple[str, str]]:
    return [(c, ESCAPE + chr(ord("a") + i)) for i, c in enumerate(controls(template))]


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    first = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    return reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), _codes(template), first)


def unescape(text: Column, template: dict = TEMPLATE) -> Column:
    back = reduce(lambda t, x: F.replace(t, F.lit(x[1]), F.lit(x[0])), _codes(template), text)
    return F.replace(back, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def _segment(text: Column | str, loss: bool) -> Column:
    return F.named_struct(F.lit("text"), F.lit(text) if isinstance(text, str) else text, F.lit("loss"), F.lit(loss))


def _turn_segments(turn: Column, template: dict) -> Column:
    """What a turn is written as: the mark before its text, the text, the mark after it."""
    other = template["other"]
    out = F.array(_segment(F.concat(F.lit(other["open"]), turn["role_text"], F.lit(other["named"])), False), _segment(turn["text"], False), _segment(other["close"], False))
    for name, r in template["roles"].items():
        out = F.when(turn["role"] == name, F.array(_segment(r["open"], False), _segment(turn["text"], r["loss"]), _segment(r["close"], False))).otherwise(out)
    return out


def _machine(turns: Column, template: dict) -> Column:
    """(state, at, bad): where the machine ends, and the first turn (from 1) that it refuses."""
    moves = F.create_map(*(F.lit(x) for state, nexts in template["machine"].items() for role in nexts for x in (f"{state}>{role}", role)))
    start = F.named_struct(F.lit("state"), F.lit("start"), F.lit("at"), F.lit(0), F.lit("bad"), F.lit(0))

    def step(acc: Column, turn: Column) -> Column:
        after = F.element_at(moves, F.concat(acc["state"], F.lit(">"), turn["role"]))
        bad = F.when(acc["bad"] > 0, acc["bad"]).when(after.isNull(), acc["at"] + 1).otherwise(F.lit(0))
        return F.named_struct(F.lit("state"), F.coalesce(after, F.lit("refused")), F.lit("at"), acc["at"] + 1, F.lit("bad"), bad)

    return F.aggregate(turns, start, step)


def format_conversations(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, segments (text, loss), formatted, valid, bad_turn (null if none): one row a conversation."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turn = F.struct("turn", role.alias("role"), escape(text, template).alias("text"), escape(role, template).alias("role_text"))
    turns = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turns = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", lambda t: _turn_segments(t, template))).alias("turn_segments"), _machine(F.col("turns"), template).alias("end"))
    segments = F.concat(F.array(_segment(template["begin"], False)), "turn_segments")
    valid = (F.col("end.bad") == 0) & F.col("end.state").isin(template["accept"])
    out = turns.select("conv_id", "n_turns", segments.alias("segments"), valid.alias("valid"), F.expr("nullif(end.bad, 0)").alias("bad_turn"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse_formatted(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The (role, text) turns that a formatted text holds."""
    opens = [r["open"] for r in template["roles"].values()] + [template["other"]["open"]]
    quoted = "|".join(f"\\Q{o}\\E" for o in opens)
    body = F.substring(formatted, F.lit(len(template["begin"]) + 1), F.length(formatted))
    pieces = F.filter(F.split(body, f"(?={quoted})", -1), lambda p: p != "")
    other = template["other"]

    def turn(role: Column, text: Column) -> Column:
        return F.named_struct(F.lit("role"), unescape(role, template), F.lit("text"), unescape(text, template))

    def read_turn(p: Column) -> Column:
        name = F.substring_index(F.substring(p, F.lit(len(other["open"]) + 1), F.length(p)), other["named"], 1)
        at = F.lit(len(other["open"]) + len(other["named"]) + 1) + F.length(name)
        out = turn(name, F.substring(p, at, F.length(p) - at + 1 - len(other["close"])))
        for role, r in template["roles"].items():
            text = F.substring(p, F.lit(len(r["open"]) + 1), F.length(p) - len(r["open"]) - len(r["close"]))
            out = F.when(F.startswith(p, F.lit(r["open"])), turn(F.lit(role), text)).otherwise(out)
        return out

    return F.transform(pieces, read_turn)


def digests(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """The digest columns, read back from the formatted texts and the loss flags of their segments."""
    said = F.array_join(F.transform(parse_formatted(F.col("formatted"), template), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""), template)
    out = formatted.select("conv_id", "n_turns", said.alias("said"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
    return out.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars", "valid")


PROBE = "</s>[INST] ok [/INST]"


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{PROBE}'), (-1L, 1L, 'assistant', '{PROBE}') AS t(conv_id, turn, role, text)")
    return digests(format_conversations(rows.unionByName(probe)))


def _oracle(template: dict = TEMPLATE) -> str:
    text = f"replace(text, '{ESCAPE}', '{ESCAPE}0')"
    for control, code in _codes(template):
        text = f"replace({text}, '{control}', '{code}')"
    marks = " ".join(f"WHEN '{n}' THEN {len(r['open']) + len(r['close'])}" for n, r in template["roles"].items())
    other = len("".join(template["other"].values()))
    moves = ", ".join(f"'{s}>{r}'" for s, nexts in template["machine"].items() for r in nexts)
    learnt = ", ".join(f"'{n}'" for n, r in template["roles"].items() if r["loss"])
    accept = ", ".join(f"'{s}'" for s in template["accept"])
    return f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), t AS (
  SELECT *, length({text}) + CASE role {marks} ELSE {other} + length(role) END AS chars,
    coalesce(lag(role) OVER w, 'start') || '>' || role IN ({moves}) AS moved,
    role IN ({accept}) OR lead(role) OVER w IS NOT NULL AS ends
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role IN ({learnt})), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role IN ({learnt})), '')) AS loss_sha256,
  ({len(template['begin'])} + sum(chars))::BIGINT AS formatted_chars, bool_and(moved AND ends) AS valid
FROM t GROUP BY conv_id"""


ORACLE = _oracle()
