"""Readers of the engine's inputs; every one leaves listing, splitting and pruning to Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PHOTO_BYTES = 20 << 20
FIELD = "struct<key:string,label_fr:string,label_en:string,section:string,kind:string,dtype:string,value:variant,display:string,raw:string,status:string,confidence:double,issues:array<string>,question_fr:string,question_en:string>"
PAGE = f"schema_version string, page_type string, page_type_confidence double, layout string, record_number string, fields map<string,{FIELD}>, needs_review array<string>, summary map<string,int>, backend string, model_version string, processing_ms bigint, warnings array<string>"


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, reason) of a folder's empty files, which Spark's readers leave out. Names are listed where Spark lists
    them, on the driver; only empty ones are kept."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(root, True)
    found = []
    while files.hasNext():
        status = files.next()
        if not status.getLen():
            found.append((status.getPath().toString(), 0, "empty"))
    return spark.createDataFrame(found, "path string, length bigint, reason string")


def photos(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Accepted and refused photos of a folder (path, content, length; path, length, reason): empty and oversized files are
    refused."""
    raw = spark.read.format("binaryFile").load(path).withColumn("reason", F.when(F.col("length") > PHOTO_BYTES, "too large"))
    refused = raw.where("reason IS NOT NULL").select("path", "length", "reason").unionByName(empty_files(spark, path))
    return raw.where("reason IS NULL").drop("reason"), refused


def captured_at(text, now):
    """A capture time: ISO 8601, without a zone UTC, never later than ``now``; null where it is no such time."""
    whole = F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(text, F.lit("T00:00:00"))).otherwise(text)
    zoned = F.when(whole.rlike(r"(Z|[+\-]\d\d:?\d\d)$"), whole).otherwise(F.concat(whole, F.lit("Z")))
    at = F.try_to_timestamp(zoned)
    return F.when(at.isNotNull(), F.least(at, now))  # least alone would take ``now`` for a text that is no time


def extractions(spark: SparkSession, path: str) -> DataFrame:
    """Page extraction documents (JSON, one per file) with a ``file`` column; manual and screen files are left out."""
    pages = spark.read.schema(PAGE).option("multiLine", True).json(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return pages.where(~F.col("file").startswith("manual_") & ~F.col("file").endswith(".ui.json"))


def fields_of(pages: DataFrame) -> DataFrame:
    """The long table of fields: one row per page and key."""
    return pages.select("file", "page_type", F.explode("fields").alias("key", "f")).select("file", "page_type", "key", *(F.col(f"f.{c}").alias(c) for c in ("kind", "dtype", "display", "raw", "status", "confidence", "issues")))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def by_id(records: DataFrame, key: str, value) -> DataFrame:
    """The rows of one id; KeyError where there is none."""
    found = records.where(F.col(key) == value)
    if not found.limit(1).count():
        raise KeyError(value)
    return found


def page_images(spark: SparkSession, path: str, pattern: str = r"(\d+)[^/]*$") -> DataFrame:
    """(page, files): image files of a folder by the page number in their name."""
    files = spark.read.format("binaryFile").load(path).select("path", F.regexp_extract("path", pattern, 1).try_cast("int").alias("page"))
    return files.where("page IS NOT NULL").groupBy("page").agg(F.array_sort(F.collect_list("path")).alias("files"))


def config_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document of definitions (templates, priors, truth) as a table of its schema; a missing part is null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


#: Fixed value: characters that a reading keeps: Latin letters, marks and signs of the form.
KEPT = r"[^\u0000-\u024F\u2010-\u2027\u00B0\u2103]"


def read_lines(text, score):
    """struct(text, score) of a crop's reading without letters of other scripts; what was left out halves the score."""
    latin = F.btrim(F.regexp_replace(text, KEPT, ""))
    return F.struct(latin.alias("text"), F.when(latin == F.btrim(text), score).otherwise(score * 0.5).alias("score"))
