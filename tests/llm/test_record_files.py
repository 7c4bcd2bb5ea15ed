"""op10's small files: one manifest file whatever the number of record files, and few tasks to read them."""

from casebook.llm import op10_records as rec


def test_small_files_are_gathered(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k} " * (k % 5)) for k in range(60)], "doc_id bigint, text string")
    manifest = rec.write_records(docs, parts=7)
    assert 1 < manifest.count() <= 7 and len(manifest.inputFiles()) == 1
    together = rec.read_records(manifest)
    assert together.rdd.getNumPartitions() == 1
    monkeypatch.setattr(rec, "READ_BYTES", 1)
    apart = rec.read_records(manifest)
    assert apart.rdd.getNumPartitions() == manifest.count()
    rows = sorted(map(tuple, together.collect()))
    assert rows == sorted(map(tuple, apart.collect())) and [r[2] for r in rows] == list(range(60))
