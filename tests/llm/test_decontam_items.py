"""Items that share an id, and items without one."""

from noticelake.llm import decontam

A = "one two three four five six seven eight nine ten"
B = "red orange yellow green blue indigo violet black white grey"
C = "north south east west up down left right front back"


def test_every_text_of_an_id_and_items_without_one(spark):
    docs = spark.createDataFrame(list(enumerate([f"x {A} y", f"x {B} y", f"x {C} y", f"{A} and {B}", "a clean text of no interest at all"])), "doc_id long, text string")
    bench = spark.createDataFrame([(1, A), (1, B), (1, A), (None, C), (None, A), (2, None)], "item_id long, text string")
    got = sorted((tuple(r)[:2] for r in decontam.contamination_report(docs, bench).collect()), key=str)
    assert got == sorted([(0, 1), (0, None), (1, 1), (2, None), (3, 1), (3, None)], key=str)
    assert [r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()] == [4]
