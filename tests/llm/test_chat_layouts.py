"""Layouts with and without a system text, unknown ones, empty tables, long texts and clashing names."""

from noticelake.llm import chat


def turns(df):
    return {r.conv_id: ([tuple(t) for t in r.turns], r.status) for r in chat.canonical_turns(df).collect()}


def test_every_layout_comes_with_and_without_a_system_text(spark):
    message = "array<struct<role:string,content:string>>"
    spoken = [("user", "q"), ("assistant", "a")]
    rows = [
        (0, "s", spoken, None, None, None, None, None, None),
        (1, None, spoken, None, None, None, None, None, None),
        (2, "s", None, "q", "a", None, None, None, None),
        (3, "", None, None, None, "q", None, "a", None),
        (4, "s", None, None, None, "q", "more", "a", None),
        (5, None, None, "q", None, None, None, None, None),
        (6, None, None, None, None, None, None, None, "?"),
        (7, None, [], None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, system string, messages {message}, prompt string, response string, instruction string, input string, output string, riddle string")
    got = turns(df)
    lead = [("system", "s")]
    assert got[0] == (lead + spoken, "mapped") and got[1] == (spoken, "mapped") and got[2] == (lead + spoken, "mapped")
    assert got[3] == ([("system", "")] + spoken, "mapped") and got[4] == (lead + [("user", "q\n\nmore"), ("assistant", "a")], "mapped")
    assert got[5] == ([], "unknown") and got[6] == ([], "empty") and got[7] == ([], "mapped")
    aside = chat.unmapped(df.selectExpr("*", "1 AS turns", "2 AS status", "3 AS fingerprint"))
    assert [(r.conv_id, r.turns, r.status, r.fingerprint) for r in aside.collect()] == [(5, 1, 2, 3)] and aside.columns[-1] == "fingerprint_"
    report = {r.conv_id: r for r in chat.chat_report(df).collect()}
    assert len(report) == len(rows) and report[5].n_turns == 0 and report[5].status == "unknown" and report[5].fingerprint == chat.fingerprint(["prompt"])


def test_fingerprints_of_layouts_differ():
    assert len({chat.fingerprint(x.paths) for x in chat.LAYOUTS}) == len(chat.LAYOUTS)


def test_long_texts_clashing_columns_and_empty_tables(spark):
    long = "</s>[INST] \\ word " * 40_000
    rows = spark.createDataFrame([(1, 0, "user", long, "x", "y"), (1, 1, "assistant", long, "x", "y")], "conv_id long, turn long, role string, text string, turns string, formatted string")
    (r,) = chat.chat_report(chat.gather_turns(rows)).collect()
    assert r.n_turns == 2 and r.loss_chars == len(long)
    records = spark.createDataFrame([(1, "q", "a", "x", "y", "z")], "conv_id long, prompt string, completion string, turns string, status string, loss_mask string")
    assert chat.chat_report(records).first().n_turns == 2
    assert chat.chat_report(chat.gather_turns(rows.limit(0))).count() == 0 and chat.chat_report(records.limit(0)).count() == 0
