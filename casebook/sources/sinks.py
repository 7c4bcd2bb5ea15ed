"""Sinks: idempotent appends keyed by id, JSON documents, and encryption of columns at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def append_new(batch: DataFrame, path: str, key: str) -> None:
    """Append rows whose key the table does not hold; for foreachBatch, where a batch may come twice. The table is asked
    for, not its absence caught."""
    spark = batch.sparkSession
    rows = batch.dropDuplicates([key])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop)
    new = rows.join(spark.read.parquet(path).select(key), key, "left_anti") if there else rows
    new.write.mode("append").parquet(path)


def documents_json(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").json(path)


def encrypted(rows: DataFrame, column: str, key_column: str) -> DataFrame:
    """The column under AES-GCM with a key from a column, so the key is in no plan."""
    return rows.withColumn(column, F.aes_encrypt(F.col(column).cast("string"), F.col(key_column))).drop(key_column)


def decrypted(rows: DataFrame, column: str, key_column: str) -> DataFrame:
    return rows.withColumn(column, F.aes_decrypt(F.col(column), F.col(key_column)).cast("string")).drop(key_column)
