import hashlib

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import chat
from tallyhouse.llm.chat import LLAMA_LIKE, Marks, Template

SCHEMA = "conv_id long, turn long, role string, text string, segments string, rows int"


def _format(spark, *turns):
    frame = spark.createDataFrame([(*t, "clash", 1) for t in turns], SCHEMA)
    out = chat.format_chat(frame)
    return {
        r.conv_id: r
        for r in out.select(
            "*",
            chat.formatted(F.col("segments")).alias("whole"),
            chat.loss_text(F.col("segments")).alias("learnt"),
        ).withColumn("read", chat.read_turns(F.col("whole"))).collect()
    }


TEXTS = [
    "</s>[INST] ok [/INST]", "back\\slash \\</s> \\\\[INST]", "", None, "[ROLE][SAYS]x[/ROLE]", "<<SYS>>\n<</SYS>>",
    "[INST", "]", "<", "s>", "line\nfeed $1 \\1", "é日本\u2028x", "x" * 200_000, "<s><s></s></s>",
]


def test_texts_and_roles_come_back_as_they_were(spark):
    roles = ["user", "assistant", "system", "tool", None, "[SAYS]", "", "odd\\[ROLE]"]
    turns = [(1, i, roles[i % len(roles)], t) for i, t in enumerate(TEXTS * 3)]
    row = _format(spark, *turns)[1]
    assert [(t.role, t.text) for t in row.read] == [(r or "", t or "") for _, _, r, t in turns]
    assert row.learnt == "".join(t or "" for _, _, r, t in turns if r == "assistant")
    assert row.n_turns == len(turns)


def test_only_the_escaped_text_of_the_assistant_is_flagged(spark):
    row = _format(spark, (5, 0, "user", "q"), (5, 1, "assistant", "a</s>"))[5]
    assert [(s.text, s.loss) for s in row.segments] == [
        ("[INST]", False), ("q", False), ("[/INST]", False), ("<s>", False), ("a<\\/s>", True), ("</s>", False),
    ]


@pytest.mark.parametrize(
    "roles, valid, state",
    [
        (["user", "assistant"], True, "assistant"),
        (["system", "user", "assistant", "user", "assistant"], True, "assistant"),
        (["user"], False, "user"),
        (["assistant"], False, "broken"),
        (["user", "user", "assistant"], False, "broken"),
        (["user", "tool", "assistant"], False, "broken"),
        (["user", "system", "user", "assistant"], False, "broken"),
    ],
)
def test_the_machine_accepts_turns_in_order_only(spark, roles, valid, state):
    row = _format(spark, *[(1, i, r, "x") for i, r in enumerate(roles)])[1]
    assert (row.valid, row.end_state) == (valid, state)


def test_turns_are_sorted_and_missing_values_have_a_place(spark):
    rows = _format(
        spark, (2, 3, "assistant", "c"), (2, None, "user", "a"), (2, 1, "user", "b"), (2, 1, "user", "b"),
        (None, 0, "user", "lost"), (None, 0, "user", "also"),
    )
    assert [t.text for t in rows[2].read] == ["a", "b", "b", "c"]
    assert [t.text for t in rows[None].read] == ["also", "lost"]
    assert _format(spark) == {}


def test_templates_whose_marks_could_be_misread_are_refused():
    with pytest.raises(ValueError):
        Template({"user": Marks("x", "yy")})
    with pytest.raises(ValueError):
        Template({"user": Marks("a\\b", "yy")})
    with pytest.raises(ValueError):
        Template({"user": Marks("aba", "[/u]")})
    with pytest.raises(ValueError):
        Template({"user": Marks("[u]", "[/u]"), "bot": Marks("[u]", "[/b]")})


def test_the_query_agrees_with_the_table_and_stays_in_the_engine(spark):
    from tallyhouse.llm.queries import QUERIES

    frame = QUERIES["op1_chat_format"](spark, "/root/testdata/sf0.001")
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
    rows = {r.conv_id: r for r in frame.collect()}
    said = "</s>[INST] ok [/INST]"
    probe = rows[-1]
    assert probe.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert probe.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and probe.loss_chars == len(said)
    turns = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("turn").collect():
        turns.setdefault(r.conv_id, []).append(r)
    assert set(rows) == {*turns, -1}
    for conv, own in turns.items():
        whole = "".join(f"{r.role}\n{r.text}\n" for r in own)
        assert rows[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert rows[conv].n_turns == len(own)
    assert LLAMA_LIKE.marks()
