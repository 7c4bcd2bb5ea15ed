"""Each stage against plain Python over odd rows: nulls, empty and repeated rows, shared ids, columns with clashing names."""

import hashlib

import corpus_pipeline as p
from casebook.llm.shared import shared_folder

NAMES = "doc_id bigint, text string, _doc string, _row string, _drop string, _lines string, _gone string, _held string, _key string, score string, n_chars bigint"
WORDS = " ".join(f"w{i}" for i in range(40))
ITEM = "A farmer sold 48 eggs on the first market day and then half as many eggs on the second day in the old town."


def table(spark, texts, ids):
    return spark.createDataFrame([(i, t, *"abcdefgh", 0) for i, t in zip(ids, texts)], NAMES)


def side_tables(spark):
    folder = shared_folder(spark, "odd")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 0, int(i == 1)) for i in range(4)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def kept(df):
    return sorted((str(r.doc_id), str(r.text)) for r in df.collect())


TEXTS = [None, "", "  ", f"{WORDS} end", f"{WORDS} end", f"{WORDS} other", "a shared line of text\nmine", "A shared line of text \nyours", f"so {ITEM}", f"so {ITEM}", "x " * 30_000]
IDS = [1, 2, 3, 4, 5, 6, 7, 8, None, 9, 10]


def test_columns_of_any_name_and_empty_tables(spark):
    docs, folder = table(spark, TEXTS, IDS), side_tables(spark)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.where("_doc <> 'a' OR _row <> 'b' OR _drop <> 'c' OR _lines <> 'd' OR _gone <> 'e' OR _held <> 'f' OR _key <> 'g' OR score <> 'h'").count() == 0, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert p.bpe(spark, docs.limit(0), folder).count() == 0


def test_line_dedup_stage(spark):
    docs, seen = table(spark, TEXTS, IDS), {}
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for i, t in zip(IDS, TEXTS):
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                seen.setdefault(key(line), set()).add(i)
    want = []
    for i, t in zip(IDS, TEXTS):
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(seen.get(key(x), ())) < 2 or min(seen[key(x)]) == i]
        want.append((str(i), "\n".join(stay)))
    out = p.line_dedup(spark, docs, "")
    assert kept(out) == sorted(want) and out.where("n_chars <> char_length(text)").count() == 0


def test_near_dedup_and_decontamination_stages(spark):
    docs, folder = table(spark, TEXTS, IDS), side_tables(spark)
    assert kept(p.near_dedup(spark, docs, folder)) == sorted((str(i), str(t)) for i, t in zip(IDS, TEXTS) if i not in (5, 6))
    assert kept(p.decontamination(spark, docs, folder)) == sorted((str(i), str(t)) for i, t in zip(IDS, TEXTS) if ITEM not in (t or ""))


def test_bpe_stage_decodes_to_the_texts(spark):
    got = sorted((str(r.doc_id), r.decoded_sha256) for r in p.bpe(spark, table(spark, TEXTS, IDS), "").collect())
    assert got == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in zip(IDS, TEXTS))


def test_rows_without_labels_all_stay(spark):
    docs, folder = table(spark, TEXTS, IDS), shared_folder(spark, "odd")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert kept(p.toxicity(spark, docs, folder)) == sorted((str(i), str(t)) for i, t in zip(IDS, TEXTS))
