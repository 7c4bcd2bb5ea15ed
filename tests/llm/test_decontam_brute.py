"""The decontamination stage against a plain-Python detector of entire items."""

import re

import corpus_pipeline as p
from casebook.llm.shared import shared_folder

BOX = "A box holds 12 red pens and a bag holds 7 red pens. A box holds 30 red pens and a bag holds 9 red pens. How many pens are there?"
EGGS = "A farmer sold 48 eggs on the first market day and then half as many eggs on the second day in the old town."
WALK = "We see that Anna walks 12 miles to the old town and then Anna rests before the long way home."
SHORT = "What is 15 plus 27?"
ITEMS = [BOX, EGGS, WALK, SHORT, "Moby Dick"]
PLAIN = "nothing of any question stands in these plain words about rain and wind"


def holds(text, item):
    """Some place of the text has the item's words; in items of eight words or more, numbers and capitalised words may
    stand for others, one to one."""
    a, b = re.findall(r"\w+", text), re.findall(r"\w+", item)
    for k in range(len(a) - len(b) + 1):
        pairs = set()
        for x, y in zip(a[k:], b):
            free = len(b) >= 8 and (x.isdigit() and y.isdigit() or x.istitle() and y.istitle() and y == "Anna")
            if x.lower() != y.lower() and not free:
                break
            pairs.add((x.lower(), y.lower()))
        else:
            if len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}):
                return True
    return False


def test_stage_keeps_what_brute_force_keeps(spark):
    texts = [f"{PLAIN} {t} {PLAIN}" for i in ITEMS for t in (i, i.upper())]
    texts += [f"{EGGS} {EGGS.replace('48', '52')}", f"{BOX.replace('12', '5')} {BOX}", EGGS.replace("48", "52"), WALK.replace("Anna", "Bertha").replace("12", "7")]
    texts += [PLAIN, "What is 3 plus 4?", WALK.replace("that Anna", "that Carla"), "Moby the Dick", EGGS[:30], ""]
    folder = shared_folder(spark, "brute")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = p.decontamination(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), folder).collect()
    assert {r.doc_id for r in kept} == {i for i, t in enumerate(texts) if not any(holds(t, item) for item in ITEMS)}
