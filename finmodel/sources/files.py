"""Models, requests and instructions from files."""

from __future__ import annotations

import json
import pathlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ExecutionError
from ..graph import Graph, parse


def _hadoop(path: str):
    """(file system, path) of the driver's JVM for a URL."""
    spark = SparkSession.builder.getOrCreate()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _is_url(path: str) -> bool:
    return "://" in path or path.startswith("file:")


def read_text(path: str) -> str:
    """A small file: URLs by the file systems that Spark knows, other paths on the driver's disk."""
    if not _is_url(path):
        with open(path, encoding="utf-8") as f:
            return f.read()
    fs, p = _hadoop(path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """The counterpart of ``read_text``; an old file is replaced."""
    if not _is_url(path):
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return
    fs, p = _hadoop(path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def beside(path: str, name: str) -> str:
    """The URL of ``name`` in the folder of a file, for data that executors write: a path on the driver's disk will not do on a cluster."""
    if _is_url(path):
        return f"{path.rpartition('/')[0]}/{name}"
    if not SparkSession.builder.getOrCreate().sparkContext.master.startswith("local"):
        raise ExecutionError(f"{path!r} is a path of the driver; rows need a URL that executors reach")
    return (pathlib.Path(path).absolute().parent / name).as_uri()


def read_model(path: str) -> Graph:
    """A model in textual form, or as JSON if the name ends in .json."""
    text = read_text(path)
    return Graph.from_json(text) if path.endswith(".json") else parse(text)


def write_model(g: Graph, path: str) -> None:
    write_text(path, json.dumps(g.to_json(), indent=2) if path.endswith(".json") else g.to_text())


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of many model files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests from JSON lines, in the envelope's columns."""
    from ..intents import ENVELOPE_DDL

    return spark.read.schema(ENVELOPE_DDL).json(path)


def read_instructions(spark: SparkSession, path: str, fixtures: str | None = None) -> DataFrame:
    """Labelled instructions from JSON lines: text, and the expected envelope as JSON text.

    A row may name a ``fixture`` instead: the file of that name in the folder ``fixtures`` is its expected envelope. Files are read
    and joined by name on the executors. A fixture that is missing leaves the envelope null; difficulty defaults to core.
    """
    rows = spark.read.schema("id string, category string, difficulty string, text string, execution_expectation string, expected_intent string, fixture string").json(path)
    rows = rows.withColumn("difficulty", F.coalesce("difficulty", F.lit("core")))
    if fixtures is not None:
        files = spark.read.text(fixtures, wholetext=True).select(F.col("_metadata.file_name").alias("fixture"), F.col("value").alias("fixture_text"))
        rows = rows.join(files, "fixture", "left").withColumn("expected_intent", F.coalesce("fixture_text", "expected_intent"))
    return rows.select("id", "category", "difficulty", "text", "execution_expectation", "expected_intent")
