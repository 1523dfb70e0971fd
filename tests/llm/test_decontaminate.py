"""Benchmark items under 8 words are found word for word."""

from pairscape.llm import decontaminate


def test_short_items_are_found_word_for_word(spark):
    docs = [(1, "They asked: Who wrote the book? and went."), (2, "who wrote a book"), (3, "who wrote"), (4, "the book"), (5, "Who wrote the book"), (6, None)]
    items = [(10, "Who wrote the book?"), (11, "who wrote the book"), (12, "went"), (13, ""), (14, None)]
    got = decontaminate.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_words, r.distance) for r in got} == {(1, 10, 4, 0), (1, 11, 4, 0), (1, 12, 1, 0), (5, 10, 4, 0), (5, 11, 4, 0)} and len(got) == 5
    assert {docs[0][1][r.start : r.stop] for r in got if r.doc_id == 1} == {"Who wrote the book?", "went."}
