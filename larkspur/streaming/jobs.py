"""The three incremental jobs: review ingest, alert log, search index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts, inverted
from ..operators.dedup import keep_first
from ..sources.sinks import new_rows
from .common import earlier, run_available, stream_files, unseen, write_batch


def ingest_reviews(spark: SparkSession, source: str, schema, target: str, checkpoint: str,
                   order: list[Column], key: str = "review_id", fmt: str = "parquet") -> None:
    """New files to the target, first arrival of a key wins, never an update."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        fresh = unseen(batch, target, batch_id, key)
        write_batch(new_rows(fresh, None, key, order), target, batch_id, key)

    run_available(stream_files(spark, source, schema, fmt), handle, checkpoint)


def log_anomalies(spark: SparkSession, source: str, schema, log: str, checkpoint: str) -> None:
    """Anomaly rows appended to ``source`` become alerts once: rows already
    there count as new on the first run, and a repeated anomaly keeps its id."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = alerts.from_anomalies(batch).withColumn("alert_id", alerts.alert_id())
        # of rows with one id the first in the order of all columns, not just any
        found = keep_first(rows, ["alert_id"], [F.col(c) for c in rows.columns])
        write_batch(alerts.add_alerts(earlier(batch.sparkSession, log, batch_id), found), log, batch_id)

    run_available(stream_files(spark, source, schema), handle, checkpoint)


def refresh_index(spark: SparkSession, source: str, schema, index: str, checkpoint: str,
                  doc_id: str = "review_id", body: str = "review_text") -> None:
    """New documents to the search index, one segment per batch.  A batch that is
    repeated finds its documents there.  The lag is the interval at which this is
    called; ``inverted.compact`` joins segments now and then."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        inverted.add(batch, index, doc_id, body)

    run_available(stream_files(spark, source, schema), handle, checkpoint)


def search_index(spark: SparkSession, index: str, terms: DataFrame, k: int) -> DataFrame:
    return inverted.top_documents(spark, index, terms, k)
