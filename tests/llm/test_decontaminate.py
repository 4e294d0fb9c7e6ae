import random

from mediatrends.llm.decontaminate import UNITS, contaminated, decontaminate
from tests.conftest import SF
from tests.llm import plain

SCHEMA, ITEMS = "doc_id long, text string", "item_id long, text string"
ITEM = "A farmer named Anna sells 12 kg of apples to Boris and later gives 12 more kg to her friend Clara who pays 40 dollars for them."


def pairs(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {(r.doc_id, r.item_id): r for r in contaminated(docs, spark.createDataFrame(list(enumerate(items)), ITEMS)).collect()}


def test_given_documents(spark):
    sf = SF.replace("0.001", "0.01")
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    known = {r.item_id: plain.normal(r.text) for r in items.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in known.items() if t in plain.normal(r.text)}
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()} == want
    clean = decontaminate(docs, items)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_other_numbers_and_names_are_caught(spark):
    other = ITEM.replace("Anna", "Dora").replace("Boris", "Emil").replace("Clara", "Fritz").replace("12", "7").replace("40", "15")
    got = pairs(spark, [f"Before it comes this. {other} After it comes that.", ITEM.upper().lower(), f"noise {ITEM} noise"])
    assert got[(0, 0)].n_changed > 0
    assert (2, 0) in got and got[(2, 0)].n_changed == 0


def test_slots_must_agree(spark):
    # the item says the same number twice; here the two differ, so the windows of the second are spoilt
    got = pairs(spark, [ITEM, ITEM.replace("12", "7", 1)])
    assert set(got) == {(0, 0), (1, 0)} and got[(1, 0)].n_matched < got[(0, 0)].n_matched == got[(0, 0)].n_windows
    # the item's names differ; here all are one, and so are most numbers
    other = ITEM.replace("Anna", "Zoe").replace("Boris", "Zoe").replace("Clara", "Zoe")
    assert pairs(spark, [other]) == {} == {k: 1 for k in [(0, 0)] if plain.leaks(other, ITEM, set(UNITS))}


def test_parts_marks_and_layout(spark):
    words = ITEM.split()
    half = " ".join(words[5:])
    got = pairs(spark, [half, ITEM.replace(" ", "\n"), ITEM.replace(" ", " | "), " ".join(words[:9]), "all other words " * 30])
    assert (0, 0) in got and (3, 0) not in got and (4, 0) not in got
    assert (2, 0) in got


def test_placeholders_alone_do_not_meet(spark):
    assert pairs(spark, ["1 2 3 4 5 6 7 8 9 10 11 12 " * 5], ["7 8 9 10 11 12 13 14 15 16 17 18"]) == {}


def test_short_and_odd_items(spark):
    got = pairs(spark, ["so why is grass green today", None, "", "why is the grass green"], ["Why is grass green", None, "", "..."])
    assert set(got) == set()  # a short item is one window as long as itself; longer documents have longer windows
    assert set(pairs(spark, ["why is grass green"], ["Why is grass green"])) == {(0, 0)}


def test_odd_tables(spark):
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, ITEM)], ITEMS)
    docs = spark.createDataFrame([(None, ITEM, 1), (5, ITEM, 2), (5, ITEM, 2), (6, None, 3)], SCHEMA + ", item_id int")
    assert sorted((r.doc_id or 0, r.item_id) for r in contaminated(docs.drop("item_id"), items).collect()) == [(0, 1), (0, 2), (5, 1), (5, 2)]
    assert [r.doc_id for r in decontaminate(docs, items).collect()] == [6]
    assert decontaminate(docs.limit(0), items).collect() == []
    assert decontaminate(docs, items.limit(0)).count() == 4


def test_windows_of_a_large_benchmark_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr("mediatrends.llm.decontaminate.SHIP_WINDOWS", 0)
    assert set(pairs(spark, [ITEM, "other words only"])) == {(0, 0)}


def test_equals_plain_templates(spark):
    draw = random.Random(11)
    common = ["the", "of", "farm", "sells", "apples", "road", "green", "why", "is", "to", "5", "kg", "Anna", "Boris", "12", "days,", "pays.", "ends;", "|"]

    def text(n):
        return " ".join(draw.choice(common) for _ in range(n)).replace("| ", "\n" if draw.random() < 0.5 else "| ")

    def changed(words):
        swap = {"5": draw.choice(["5", "7"]), "12": draw.choice(["12", "5"]), "Anna": draw.choice(["Anna", "Emil"]), "Boris": draw.choice(["Boris", "Anna"])}
        return " ".join(swap.get(w, w) if draw.random() < 0.9 else w for w in words)

    items = [text(draw.choice([1, 2, 3, 4, 5, 7, 8, 9, 12, 20, 30])) for _ in range(24)]
    docs = [text(draw.randrange(1, 40)) for _ in range(30)]
    for _ in range(90):
        words = changed(draw.choice(items).split(" ")).split(" ")
        cut = draw.randrange(0, max(1, len(words) // 2)) if draw.random() < 0.5 else 0
        docs.append(draw.choice(["", text(3) + " ", text(4) + ". ", text(2) + "\n"]) + " ".join(words[cut:]) + draw.choice(["", " " + text(3), ". " + text(3), "\n" + text(3)]))
    docs += [i.upper() for i in items]
    units = set(UNITS)
    want = {(d, i) for d, a in enumerate(docs) for i, b in enumerate(items) if plain.leaks(a, b, units)}
    assert set(pairs(spark, docs, items)) == want and len(want) > 60


def test_common_words_do_not_empty_a_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for item in ("yes", "the", "the cat", "4", "of the"):
        assert decontaminate(docs, spark.createDataFrame([(0, item)], ITEMS)).count() == docs.count()


def test_clashing_columns_come_back_unchanged(spark):
    names = ["row_key", "text_key", "FOUND_KEY", "found_id", "found_text", "item_id"]
    rows = [(0, ITEM, *range(6)), (1, "clean words", *range(6))]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {n} int" for n in names))
    assert list(map(tuple, decontaminate(docs, spark.createDataFrame([(0, ITEM)], ITEMS)).collect())) == [rows[1]]
