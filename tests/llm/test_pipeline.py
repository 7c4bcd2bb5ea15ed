import corpus_pipeline as p
from casebook.llm import op01_toxicity as tox, op06_decontam as decon, op09_minhash as near

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_in_order(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    a = p.toxicity(spark, documents, SF)
    model = tox.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in tox.score_documents(documents, model).where("predicted = 1").collect()}
    assert a.columns == documents.columns and {r.doc_id for r in a.collect()} == {r.doc_id for r in documents.collect()} - bad
    b = p.line_dedup(spark, documents, SF)
    assert b.columns == documents.columns and b.count() == documents.count() and b.where("n_chars <> char_length(text)").count() == 0
    c = p.near_dedup(spark, documents, SF)
    keep = {r.class_id for r in near.near_duplicates(documents).collect()}
    assert {r.doc_id for r in c.collect()} == keep
    d = p.decontamination(spark, documents, SF)
    held = {r.doc_id for r in decon.contaminated(documents, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in d.collect()} == {r.doc_id for r in documents.collect()} - held


def test_run_is_the_stages(spark):
    out = p.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() < 200
