"""Written intermediate tables in the shared folder, and input helpers."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset a folder of our own, on one machine only: executors of a cluster wouldn't share it."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[.*\])?$", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or f"file:///tmp/checkpoints/{os.getpid()}").rstrip("/")


def fresh(label: str) -> str:
    """A column name that no input has."""
    return f"__{label}_{uuid.uuid4().hex[:12]}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and reread it: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file: written beside it, then renamed."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, part = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(target, False)
    if not files.rename(part, target):
        raise OSError(f"{path} can't be written")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        return None
    size, source = files.getFileStatus(target).getLen(), files.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source, int(size))).decode()
    finally:
        source.close()


def discard(*tables: DataFrame) -> None:
    """Delete tables made by save() that no later plan reads."""
    for table in tables:
        path = getattr(table, "_saved_at", None)
        if path:
            delete_path(table.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch of whole texts; the default of Spark would put some ten thousand of them into a worker at once.
TEXT_BATCH = 2000


def bounded_batches(df: DataFrame) -> None:
    """Lower the session's Arrow batch size to TEXT_BATCH if it is larger. A setting of the session, as plans run later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= TEXT_BATCH:
        df.sparkSession.conf.set(key, str(TEXT_BATCH))
