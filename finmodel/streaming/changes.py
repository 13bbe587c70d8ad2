"""What-ifs from a stream of change events.

``windowed_pressure`` is an event-time aggregate with a watermark; ``apply_changes`` evaluates a model once per micro-batch, for
the last change of every input, and appends the results: a replayed batch overwrites its own folder, so results are exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import change_column


def windowed_pressure(events: DataFrame, length: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """(start, event_type, n, total) per tumbling window; events (ts, event_type, value) later than ``lateness`` are left out."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    late = events.withWatermark("ts", lateness) if events.isStreaming else events
    grouped = late.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def last_changes(changes: DataFrame) -> DataFrame:
    """(input, spec): the latest spec of each input of (ts, input, spec), combined map-side."""
    return changes.groupBy("input").agg(F.max_by("spec", "ts").alias("spec"))


def apply_changes(model, changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs ``model.what_if`` with the last changes of each micro-batch and writes the targets below ``path``."""
    inputs = {n.name for n in model.module.of_kind("input")}

    def batch(df: DataFrame, epoch: int) -> None:
        # at most one row per input of the model
        specs = {r["input"]: r["spec"] for r in last_changes(df.where(F.col("input").isin(*inputs))).collect()}
        model.what_if(specs).frame.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["apply_changes", "change_column", "last_changes", "windowed_pressure"]
