import corpus_pipeline as p

SF = "/root/testdata/sf0.001"


def test_contaminated_rows_without_an_id_go(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, f"before {item} after"), (None, "plain words"), (None, None), (1, item), (2, "plain words")]
    kept = p.decontamination(spark, spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), SF).collect()
    assert sorted(map(str, kept)) == sorted(["Row(doc_id=None, text='plain words')", "Row(doc_id=None, text=None)", "Row(doc_id=2, text='plain words')"])
