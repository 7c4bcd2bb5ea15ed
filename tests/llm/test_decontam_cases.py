"""Decontamination: copies that windows over typed tokens alone don't find."""

import pytest

from casebook.llm import op06_decontam as decon

BOX = "A box holds 12 red pens and a bag holds 7 red pens. A box holds 30 red pens and a bag holds 9 red pens. How many pens are there?"
EGGS = "A farmer sold 48 eggs on the first market day and then half as many eggs on the second day in the old town."


def held(spark, texts, items):
    def table(rows, key):
        return spark.createDataFrame(list(enumerate(rows)), f"{key} bigint, text string")

    return {(r.doc_id, r.item_id): r.kind for r in decon.contaminated(table(texts, "doc_id"), table(items, "item_id")).collect()}


def test_case_plays_no_part_in_verbatim_copies(spark):
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").collect()]
    for change in (str.upper, str.title):
        got = held(spark, [change(t) for t in items], items)
        assert all(got.get((i, i)) == "exact" for i in range(len(items)))


def test_slots_are_judged_by_occurrence(spark):
    texts = [BOX, f"{EGGS} {EGGS.replace('48', '52')}", EGGS.replace("48", "52")]
    got = held(spark, texts, [BOX, EGGS])
    assert got == {(0, 0): "exact", (1, 1): "exact", (2, 1): "template"}


def test_items_without_a_wide_window(spark):
    items = ["What is 15 plus 27?", "Who wrote the novel Moby Dick?", "Moby Dick", "In 1998 Bill Clinton and Tony Blair met with Boris Yeltsin in Cologne, Germany.", "...", None]
    texts = [f"some words before {t} and after" for t in items[:4]] + ["What is 3 plus 4?", "Who wrote the novel Emma?", "Moby the Dick"]
    got = held(spark, texts, items)
    assert got == {(0, 0): "exact", (1, 1): "exact", (1, 2): "exact", (2, 2): "exact", (3, 3): "exact"}


@pytest.mark.parametrize("old, new", [(("Tom", "5", "3", "2"), ("Sam", "8", "6", "4")), (("Tom", "5", "3", "2"), ("Tom", "7", "3", "2"))])
def test_names_that_open_sentences_are_slots(spark, old, new):
    item = "Tom has 5 apples. Tom buys 3 apples. Tom eats 2 apples. How many apples does Tom have now?"
    text = item
    for a, b in zip(old, new):
        text = text.replace(a, b)
    crossed = text.replace(f"{new[0]} eats", "Ann eats")
    assert held(spark, [text, crossed], [item]) == {(0, 0): "template"}


def test_one_changed_or_added_word_in_a_short_item(spark):
    item = "the quick brown fox of my uncle jumps over every lazy dog that sleeps outside"
    words = item.split()
    texts = [" ".join([*words[:7], "hops", *words[8:]]), " ".join([*words[:7], "often", *words[7:]]), " ".join(words[:6])]
    assert set(held(spark, texts, [item])) == {(0, 0), (1, 0)}
