from mediatrends.llm.decontaminate import decontaminate
from tests.llm.test_decontaminate import ITEM, ITEMS, SCHEMA, pairs


def test_short_items_are_found_as_sentences_lines_or_texts(spark):
    items = ["Why is grass green", "What is 12 + 15 * 3 - 7?", "x", "the cat"]
    docs = [
        "He asked: why is GRASS green? Nobody knew, or would say so.", "so why is GRASS green today, and for how long will it be", "what is grass",
        "They asked: what is 12 + 15 * 3 - 7? Nobody knew that.", "one line\nWhy is grass green\nanother line", "x\ny", " X ", "The cat. It sat.", "the cat",
    ]
    assert set(pairs(spark, docs, items)) == {(0, 0), (3, 1), (4, 0), (6, 2), (8, 3)}


def test_dense_items_are_found_verbatim(spark):
    item = "Add 3 5 8 13 21 34 55 89 144 and 233"
    got = pairs(spark, [f"one more line here. {item} is the task", item.replace("13", "14").replace("55", "56")], [item])
    assert set(got) == {(0, 0)} and got[(0, 0)].n_matched == got[(0, 0)].n_windows


def test_copies_in_any_case(spark):
    got = pairs(spark, [f"x y {t} z" for t in (ITEM.lower(), ITEM.upper(), ITEM.title(), ITEM)])
    assert set(got) == {(i, 0) for i in range(4)}
    assert {r.n_changed for r in got.values()} == {0}


def test_a_clash_spoils_only_its_windows(spark):
    assert set(pairs(spark, [ITEM.replace("12", "7", 1)])) == {(0, 0)}


def test_rows_are_judged_by_id_and_text(spark):
    docs = spark.createDataFrame([(None, ITEM), (None, "clean text"), (None, None), (5, ITEM), (5, "another clean text"), (6, ITEM + " x")], SCHEMA)
    left = decontaminate(docs, spark.createDataFrame([(0, ITEM)], ITEMS)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == [(0, ""), (0, "clean text"), (5, "another clean text")]
