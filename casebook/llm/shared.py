"""Where intermediate tables and archives go: the folder the cluster shares, named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode, which is one
    machine; RuntimeError on a cluster, where a machine's own folder would split the data."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir() + "/casebook-shared"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as it takes to clash with no column (case plays no part)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """``df`` as a committed Parquet table in the shared folder: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, most_bytes: int):
    """Within it, plans that run hand Python batches of at most about ``most_bytes``; the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most_bytes))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whatever its scheme."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def open_out(uri: str):
    """A binary output stream in the shared folder; parents are made."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_in(uri: str):
    """A seekable binary input of the shared folder."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
