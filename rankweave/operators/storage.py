"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; one of our own where it is unset and Spark runs on one machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: tasks on several machines need a folder that all of them share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_back(df: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """``df`` written to ``path`` and read back, which cuts its lineage."""
    (df.coalesce(files) if files else df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def publish_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file as a whole or not at all: under another name beside it first, then renamed, over an older one."""
    folder, name = path.rsplit("/", 1)
    fs, draft = _file(spark, f"{folder}/.draft-{name}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    _, final = _file(spark, path)
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    over = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = over
    files.rename(files.makeQualified(draft), files.makeQualified(final), options)


def read_file(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None where there is none."""
    fs, target = _file(spark, path)
    if not fs.exists(target):
        return None
    reader = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(reader, "UTF-8")
    finally:
        reader.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none where it does not exist."""
    fs, target = _file(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(target)) if fs.exists(target) else []


def delete(spark: SparkSession, path: str) -> bool:
    fs, target = _file(spark, path)
    return fs.delete(target, True)
