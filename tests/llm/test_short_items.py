"""Benchmark items of one or two words are found inside longer documents."""

from graphloom.llm import op4_decontam


def test_short_items(spark):
    items = [(1, "zebra"), (2, "blue whale"), (3, "one two three four five six")]
    docs = [(1, "a zebra ran over the hill"), (2, "we saw the Blue Whale, twice"), (3, "blue sky, whale song, red sand"), (4, "zebra"), (5, "big zebra"), (6, "x one two three four five six y"), (7, "blue whale"), (8, "")]
    got = {(r["doc_id"], r["item_id"], r["first_word"], r["end_word"]) for r in op4_decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1, 1, 2), (2, 2, 3, 5), (4, 1, 0, 1), (5, 1, 1, 2), (6, 3, 1, 7), (7, 2, 0, 2)}
