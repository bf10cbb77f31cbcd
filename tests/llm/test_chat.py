from pyspark.sql import functions as F

from tallyspark.llm.chat import CONTROLS, format_chats, masked_text, parse

SCHEMA = "conv_id long, turn long, role string, text string, source string, raw string"


def _read(df):
    rows = format_chats(df).withColumn("m", masked_text(F.col("formatted"), F.col("loss_spans"))).collect()
    return {r.conv_id: r for r in rows}


def test_any_content_reads_back(spark):
    bits = [*CONTROLS, "&", "<", "[", "&lt;", "&amp;lt;", "x", "\n", "é🙂", "[/INS", "</", ""]
    rows = []
    for i, a in enumerate(bits):
        for j, b in enumerate(bits):
            rows += [(i * 100 + j, 0, "user", a + b, "", ""), (i * 100 + j, 1, "assistant", b + a + b, "", ""), (i * 100 + j, 2, a, b, "", "")]
    got = _read(spark.createDataFrame(rows, SCHEMA))
    for c, r in got.items():
        mine = [x for x in rows if x[0] == c]
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in mine]
        assert r.m == "".join(x[3] for x in mine if x[2] == "assistant")
    assert 0 < sum(r.escaped > 0 for r in got.values()) < len(got)


def test_odd_rows(spark):
    rows = [(1, None, "user", "first", "", ""), (1, 0, None, None, "", ""), (1, 0, "assistant", "b", "", ""), (1, 0, "assistant", "b", "", ""), (None, 0, "user", "x", "", ""), (None, 1, "assistant", "", "", ""), (2, 0, "assistant", "long " * 100_000, "", "")]
    got = _read(spark.createDataFrame(rows, SCHEMA))
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "first"), ("", ""), ("assistant", "b"), ("assistant", "b")]
    assert got[1].m == "bb" and got[None].m == "" and len(got[2].m) == 500_000
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_control_strings_inside_texts_are_always_escaped(spark):
    got = _read(spark.createDataFrame([(1, 0, "user", "what does [INST] or <s> mean?", "", ""), (1, 1, "assistant", "plain & simple < text", "", "")], SCHEMA))[1]
    assert got.formatted == "[INST]user[=]what does &lb;INST] or &lt;s> mean?[/INST]<s>assistant[:]plain & simple < text</s>" and got.escaped == 1
    assert [t.text for t in got.turns] == ["what does [INST] or <s> mean?", "plain & simple < text"]


def test_a_turn_is_closed_by_the_end_of_its_kind(spark):
    read = spark.createDataFrame([("[INST]user[:]a</s>b[/INST]<s>assistant[:]c[/INST]</s>",)], "f string").select(parse(F.col("f")).alias("t")).first().t
    assert [(t.loss, t.role, t.text) for t in read] == [(False, "user", "a</s>b"), (True, "assistant", "c[/INST]")]
