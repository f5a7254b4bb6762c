"""Structured Streaming jobs for live submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import escalation, questionnaire
from ..session import shared_dir
from ..sources.stored import ROWS_PER_BUCKET, KeyedTable
from ..sources.tables import first_per_key
from .stateful import stream_codes, stream_doctor_alerts, stream_sessions, stream_streaks  # noqa: F401


def stream_enrich(submissions: DataFrame, catalogue=None) -> DataFrame:
    """Enrichment on arrival; the batch expression is stateless and row-local."""
    return questionnaire.enrich(submissions, catalogue)


def alert_feed(assessments: DataFrame, assignments: DataFrame) -> DataFrame:
    """T4: flagged assessments with the doctors to notify."""
    return escalation.flagged(assessments).join(
        assignments.select("doctor_id", "user_id").distinct(), "user_id")


def alert_batch(assignments: DataFrame, target: str):
    """T4: ``foreachBatch`` function writing a micro-batch's alerts.

    Each micro-batch owns one directory that a repetition replaces. Inside the
    batch the join is planned adaptively, so a patient with very many alerts is
    split like in any batch job.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        alert_feed(batch, assignments).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
    return write


def stream_alerts(stream: DataFrame, assignments: DataFrame, target: str, checkpoint: str, **trigger):
    """T4: start the alert feed; returns the running query."""
    return (stream.writeStream.foreachBatch(alert_batch(assignments, target))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def insert_batch(target: str, keys: list[str], order: str, rows_per_bucket: int = ROWS_PER_BUCKET, compact_every: int = 50, on_files=None):
    """T5: ``foreachBatch`` function appending rows whose key is not stored yet.

    The stored table itself is the memory, so nothing is forgotten and a
    repeated micro-batch adds nothing. It is a keyed table, whose buckets follow
    its size: a micro-batch reads the key columns of its own buckets, a share
    that falls as the table grows. Every ``compact_every`` batches crowded
    buckets are split and their small files merged. ``on_files`` is told the
    batch, and the number of files it read and found.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        table = KeyedTable(batch.sparkSession, target, keys, rows_per_bucket)
        if batch_id and batch_id % compact_every == 0:
            table.compact(batch.withColumn("_bucket", F.lit(0)).schema)
        share = table.insert_if_absent(batch, lambda rows: first_per_key(rows, keys, order))
        if on_files:
            on_files(batch_id, *share)
    return write


def stream_insert_if_absent(stream: DataFrame, target: str, checkpoint: str, keys: list[str],
                            order: str, **trigger):
    """T5: start the insert-if-absent sink; returns the running query."""
    return (stream.writeStream.foreachBatch(insert_batch(target, keys, order))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def run_once(stream: DataFrame, out: str, progress: str) -> None:
    """Drive a stream over all data present in one micro-batch; for state on processing time, which has no end of input."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", progress).trigger(once=True).start())
    query.awaitTermination()


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Drive a stream over all data present and return what it wrote.

    Output and progress live in the shared folder, so a lost executor or a
    restarted driver continues from the last finished micro-batch.
    """
    root = shared_dir(stream.sparkSession, name)
    out = f"{root}/out"
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
