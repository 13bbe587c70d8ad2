"""Shared folder, lineage cuts and store-agnostic file access for the operators.

Everything that must outlive an executor goes below the folder that the session names in ``spark.checkpoint.dir``. Executors
reach it through ``pyarrow.fs`` (file:, hdfs:, s3:, gs:), the driver through Spark's own Hadoop file system.
"""

from __future__ import annotations

import contextlib
import posixpath
import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``.

    Where the setting is absent, a local session (one JVM, as in tests) gets a local folder; on a cluster that is an error, since
    executors would each write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_dir()
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + root
    return posixpath.join(root, f"finmodel-{label}-{uuid.uuid4().hex[:12]}")


@lru_cache(1)
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="finmodel-ckpt-")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and rereads it: lineage ends there and survives lost executors."""
    return cut_path(df, label)[0]


def cut_path(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``cut``, with the folder's name, to give to ``remove`` later."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders made by ``shared_dir`` once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession):
    """Meanwhile shuffle files go as soon as the job that made them has ended, so that passes do not add up on disk."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def row_key(*values: Column) -> Column:
    """A 64-bit hash of some columns as text, in which a null differs from the empty text; tells rows of one id apart."""
    return F.xxhash64(*[x for v in values for x in (F.coalesce(v.cast("string"), F.lit("")), v.isNull())])


def without(docs: DataFrame, rejected: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The rows of ``docs`` that ``rejected`` (id, key) does not name, key being ``row_key`` of ``columns``; all columns are kept.

    A row is told by its doc_id (null is an id too) and those columns, so equal rows go or stay together.
    """
    gone = cut(rejected.select(F.col("id").cast("long").alias("gone_id_"), F.col("key").alias("gone_key_")).distinct(), "rejected")
    same = docs["doc_id"].cast("long").eqNullSafe(gone["gone_id_"]) & (row_key(*[docs[c] for c in columns]) == gone["gone_key_"])
    return docs.join(gone, same, "left_anti")


def filesystem(url: str):
    """(pyarrow file system, path) for a URL; runs on executors."""
    from pyarrow import fs

    if url.startswith("file:"):
        return fs.LocalFileSystem(), "/" + url[5:].lstrip("/")
    return fs.FileSystem.from_uri(url)


def publish(url: str, write) -> None:
    """Writes a file under an attempt-only name through ``write(stream)`` and moves it into place, so readers never see half a file."""
    fs, path = filesystem(url)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        write(out)
    fs.move(part, path)
