"""A corpus through five operators: toxic documents go, shared lines are dropped, near-duplicates and contaminated
documents go, and what is left is encoded. Each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casebook.llm.op01_toxicity import fit, score_documents
from casebook.llm.op04_line_dedup import dedup_lines
from casebook.llm.op05_bpe import encode_decode
from casebook.llm.op06_decontam import contaminated
from casebook.llm.op09_minhash import keep_one
from casebook.llm.shared import unused, written


def toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject; the model learns from the training labels.

    Defined cases: null and empty texts get the least score and stay; rows without a doc_id are scored like others, and
    repeated rows alike; without labels of both classes nothing is rejected; an empty table gives none; columns of any
    name are kept as they are."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (rows,) = unused([*docs.columns, "doc_id", "text"], "_row")
    slim = docs.select("doc_id", "text", F.struct(*docs.columns).alias(rows))
    return score_documents(slim, model, passages=False).where("predicted = 0").select(f"{rows}.*")


def line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; n_chars follows the text.

    Defined cases: a null text becomes an empty one; a document all of whose lines are held elsewhere stays with an
    empty text; rows without a doc_id keep all lines; rows that share a doc_id are one document; an empty table gives
    none; columns of any name but n_lines and n_dropped, which the operator replaces, are kept."""
    kept = dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
    return kept.select(*docs.columns)


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each class of near-duplicates.

    Defined cases: null and wordless texts are classes of their own and stay; rows without a doc_id stay; of rows that
    share a doc_id all stay or all go; an empty table gives none; columns of any name are kept as they are."""
    return keep_one(docs).select(*docs.columns)


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Defined cases: null and empty texts hold nothing and stay; rows without a doc_id are judged one by one, by a hash of
    their text; of rows that share a doc_id all stay or all go; an empty benchmark removes nothing; an empty table gives
    none; columns of any name are kept as they are."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    held, key = unused(docs.columns, "_held", "_key")

    def clean(rows: DataFrame, own: str) -> DataFrame:
        found = contaminated(rows.select(F.col(own).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(held)).distinct()
        return rows.join(found, F.col(own) == F.col(held), "left_anti").select(*docs.columns)

    kept = clean(docs.where("doc_id IS NOT NULL"), "doc_id")
    nameless = docs.where("doc_id IS NULL")
    if nameless.limit(1).count():
        kept = kept.unionByName(clean(nameless.withColumn(key, F.xxhash64("text")), key))
    return kept


def bpe(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left.

    Defined cases: null and empty texts have no tokens; null doc_ids and repeated rows give a row each; an empty table
    gives none; other columns are ignored."""
    return encode_decode(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", bpe)]

#: The stages score and sample; SQL has no twin for them. Tests hold line dedup, near-dedup, decontamination and the
#: encoding against brute force, and toxicity by its operator's tests.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is a committed table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
