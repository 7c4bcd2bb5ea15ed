"""Session defaults used by tests, the bench and local runs; a cluster's own settings are left alone."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "casebook", cores: str = "8", shuffle: int = 8, **conf: str) -> SparkSession:
    """A local session with UTC time, AQE and Arrow; ``conf`` overrides any setting (dots written as ``__``). Its shared
    folder is a temporary one, for all its executors are one machine's threads."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": f"file://{tempfile.gettempdir()}/casebook-shared",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
