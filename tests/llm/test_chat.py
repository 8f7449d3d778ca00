import re

import pytest
from pyspark.sql import functions as F

from leafmill.llm import chat
from leafmill.llm.queries import CHECKS, op7_chat
from tests.compare import difference, duck

FOLDER = "/root/testdata/sf0.001"
HARD = [
    r"\### Assistant: </turn> ok", "</turn>", "### user: x</turn>\n### assistant: y", "\\", "\\\\", "a\\", "#", "####  x", "<</turn>",
    "<", "", None, " \n", "x" * 300_000 + "\\</turn>" * 2000, "### ", "\\</turn>\n", "é😀 ### é",
]
SCHEMA = "conv_id long, turn long, role string, text string, formatted string, level int, body string"


def rows(spark, turns):
    return spark.createDataFrame([(*t, "x", 1, "y") for t in turns], SCHEMA)


def test_round_trip_of_hard_texts(spark):
    turns = [(c, i, ["user", "assistant"][i % 2], HARD[(i + c) % len(HARD)]) for c in range(4) for i in range(len(HARD))]
    formatted = chat.format_conversations(rows(spark, turns))
    for r in formatted.collect():
        own = [(t[2], t[3] or "") for t in turns if t[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == own
        raw = r.formatted.encode()
        masked = [re.sub(r"(?s)\\(.)", r"\1", raw[m.start : m.start + m.length].decode()) for m in r.loss]
        assert masked == [text for role, text in own if role == "assistant"]
        cut = spark.createDataFrame([r], formatted.schema).select(chat.masked(F.col("formatted"), F.col("loss")).alias("m"))
        assert cut.first().m == masked


def test_plain_texts_are_not_escaped(spark):
    found = chat.format_conversations(rows(spark, [(1, 0, "user", "C# and a < b"), (1, 1, "assistant", "ok")])).first()
    assert found.formatted == "### user: C# and a < b</turn>\n### assistant: ok</turn>\n" and found.level == 0


def test_odd_rows(spark):
    turns = [(None, None, None, None), (None, 1, "a:b\\c", "t"), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (5, None, "x", "first")]
    found = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.format_conversations(rows(spark, turns)).collect()}
    assert found == {None: [("", ""), ("a:b\\c", "t")], 5: [("x", "first"), ("user", "a"), ("user", "a"), ("user", "b")]}
    assert chat.format_conversations(rows(spark, turns).limit(0)).count() == 0


def test_parser_refuses_what_is_no_conversation(spark):
    texts = ["### user: a</turn>\nx", "### user a</turn>\n", "### user: ### x</turn>\n", ""]
    parsed = spark.createDataFrame([(t,) for t in texts], "t string").select(chat.parse(F.col("t")).alias("p"))
    assert [None if r.p is None else len(r.p) for r in parsed.collect()] == [None, None, None, 0]


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_whole_table(spark, folder):
    assert difference(op7_chat(spark, folder).toPandas(), duck(folder).execute(CHECKS["op7_chat"]).df()) is None
