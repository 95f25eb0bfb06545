"""Streaming forms of ingestion and audit: new files become micro-batches of the batch jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftstone.operators import bookkeeping
from siftstone.plans.ingest import Engine
from siftstone.sources.tables import ORIGINALS
from siftstone.streaming import retries


def ingest_stream(engine: Engine, source: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Adds the documents of Parquet files below source as they come. A batch that is run again replaces its own chunks, so the result is the same."""
    docs = engine.spark.readStream.schema(ORIGINALS).parquet(source)

    def batch(df: DataFrame, _: int) -> None:
        if df.limit(1).count():
            engine.add(df.dropDuplicates(["doc_id"]).select("doc_id", "raw_text", "business_type", "source_metadata"))

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def audit(chunks: DataFrame, model: Callable, now=None) -> DataFrame:
    """The review rows of all documents of chunks. model(prompts) gives replies; a failing model gives audit_failed."""
    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            try:
                yield pd.Series(model(list(prompts)))
            except Exception:  # noqa: BLE001  the report counts it
                yield pd.Series([None] * len(prompts), dtype="object")

    groups = bookkeeping.audit_groups(chunks)
    audited = bookkeeping.verdicts(groups.withColumn("reply", ask("prompt"))).drop("reply")
    return bookkeeping.review_report(audited, bookkeeping.ungroupable(chunks), now if now is not None else F.current_timestamp())


def audit_sweep(engine: Engine, model: Callable, limit: int = 20) -> int:
    """One tick of the audit loop: reviews up to `limit` documents that have none; returns their number."""
    chunks, due = engine.table("lexical"), engine.due_reviews(limit)
    n = due.count()
    if n:
        engine.add_reviews(audit(chunks.join(due, "doc_id", "left_semi"), model))
    return n


def audit_stream(engine: Engine, model: Callable, source: str, checkpoint: str, limit: int = 20) -> StreamingQuery:
    """An audit sweep for each micro-batch of new files below source."""
    docs = engine.spark.readStream.schema(ORIGINALS).parquet(source)
    return docs.writeStream.foreachBatch(lambda df, _: audit_sweep(engine, model, limit) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_stream(engine: Engine, source: str, checkpoint: str, base: int = 60, most: int = 5, available_now: bool = True) -> StreamingQuery:
    """The retry queue over Parquet files of retries.EVENTS below source; outcomes settle the engine's failure records. A batch that is run again settles nothing twice."""
    engine.spark.conf.set(retries.STATE_STORE, retries.ROCKS)
    events = engine.spark.readStream.schema(retries.EVENTS).parquet(source)

    def batch(df: DataFrame, _: int) -> None:
        if df.limit(1).count():
            engine.settle(df)

    writer = retries.retried(events, base, most).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def event_windows(spark: SparkSession, events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Extension: counts and sums of events by window and type, with a watermark; works on a stream and on a table alike."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
