"""The live retry queue against the batch retry, over a restart, with back-off and a cap."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftstone.operators import bookkeeping
from siftstone.plans import ingest
from siftstone.streaming import jobs, retries

from test_engine import PROVIDERS, docs, ids

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


@pytest.fixture
def queue(spark, tmp_path):
    """Runs the queue over what has come so far and gives the outcomes since the last run."""
    before = spark.conf.get(retries.STATE_STORE, None)
    spark.conf.set(retries.STATE_STORE, retries.ROCKS)
    seen = []

    def run(*rows, **options):
        spark.createDataFrame(list(rows), retries.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = []
        stream = retries.retried(spark.readStream.schema(retries.EVENTS).parquet(str(tmp_path / "in")), **options)
        q = stream.writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        seen.extend(out)
        return sorted(out)

    yield run
    spark.conf.unset(retries.STATE_STORE) if before is None else spark.conf.set(retries.STATE_STORE, before)


def test_back_off_and_cap_over_restarts(queue):
    options = {"base": 10, "most": 3}
    assert queue(("a", "failure", "es_write", at(0)), ("b", "failure", "es_write", at(0)), ("c", "failure", "both", at(0)), ("c", "vector", None, at(0)), (None, "failure", "es_write", at(0)), ("d", "failure", "es_write", None), **options) == []
    assert queue(("b", "vector", None, at(5)), **options) == []
    # Each call is a restart from the checkpoint. b is tried at 10 s and gets through; a and c fail and are due at 30 s.
    assert queue((".", "tick", None, at(12)), **options) == [("b", True, 1, None)]
    assert queue((".", "tick", None, at(25)), **options) == []
    assert queue((".", "tick", None, at(31)), **options) == []
    # The third attempt, at 70 s, is the last one.
    assert queue((".", "tick", None, at(75)), **options) == [("a", False, 3, "retry failed"), ("c", False, 3, "retry failed")]
    # Given up, until it fails anew; its vector has come meanwhile.
    assert queue(("a", "vector", None, at(80)), ("a", "failure", "es_write", at(80)), **options) == []
    assert queue((".", "tick", None, at(95)), **options) == [("a", True, 1, None)]


def test_stream_equals_the_batch_retry(spark, queue):
    modes = ("es_write", "qdrant_write", "both")
    failed = spark.createDataFrame([(f"c{n}", f"d{n % 7}", modes[n % 3], "x") for n in range(60)], "chunk_id string, doc_id string, failure_mode string, error_msg string")
    vectors = spark.createDataFrame([(f"c{n}", f"d{n % 7}", "t") for n in range(60) if n % 2], "chunk_id string, doc_id string, text string")
    records = bookkeeping.record_failures(spark.createDataFrame([], ingest.FAILURES), failed, F.to_timestamp(F.lit("2024-01-01")))
    batch = {(r.chunk_id, r.resolved, r.error_msg) for r in bookkeeping.retry(records, vectors, limit=None)[1].collect()}
    events = [(r.chunk_id, "failure", r.failure_mode) for r in failed.collect()] + [(r.chunk_id, "vector", None) for r in vectors.collect()]
    # What isn't later than the watermark is late, so the second half comes a second after the first.
    queue(*[(*e, at(0)) for e in events[:50]], most=1)
    got = queue(*[(*e, at(1)) for e in events[50:]], (".", "tick", None, at(61)), most=1) + queue((".", "tick", None, at(130)), most=1)
    assert {(c, ok, e) for c, ok, _, e in got} == batch and len(got) == 60


def test_outcomes_settle_the_engines_records(spark, tmp_path):
    engine = ingest.Engine(spark, str(tmp_path / "e"), PROVIDERS, buckets=2)
    engine.add(docs(spark, ("a", "alpha"), ("b", "beta")))
    engine.store("lexical").replace(engine.store("lexical").read().where("doc_id <> 'a'"), "bucket")
    engine.reconcile()
    lost = engine.table("failures").first()
    rows = [(lost.chunk_id, "failure", lost.failure_mode, at(0)), (lost.chunk_id, "vector", None, at(0)), (".", "tick", None, at(100))]
    spark.createDataFrame(rows, retries.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        jobs.retry_stream(engine, str(tmp_path / "in"), str(tmp_path / "ck")).awaitTermination()
    assert ids(engine.table("lexical")) == ["a", "b"] and engine.table("failures").where("resolved").count() == 1 and {"alpha", "beta"} <= set(ids(engine.table("postings"), "term"))
