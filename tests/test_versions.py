"""Versions of the warehouse, isolation of failing documents, and the phases of a rebuild."""

import pytest
from pyspark.sql import functions as F

from siftstone.operators import bookkeeping, dense
from siftstone.plans import ingest
from siftstone.sources.tables import Conflict, Warehouse

from test_engine import PROVIDERS, docs, ids


def numbers(spark, *rows):
    return spark.createDataFrame(list(rows), "id int, bucket int, v string")


@pytest.fixture
def warehouse(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    change = w.change()
    change.put("a", numbers(spark, (1, 0, "x"), (2, 1, "y"), (3, 1, "z")), "bucket")
    change.put("b", numbers(spark, (1, 0, "x")))
    assert w.live() == 0 and change.commit() == 1
    return w


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_held_reader_keeps_its_version(spark, warehouse):
    held = warehouse.read("a")
    change = warehouse.change()
    change.put("a", change.read("a", buckets=[1]).where("id = 2").withColumn("v", F.lit("new")), "bucket", [1])
    change.put("b", numbers(spark))
    assert rows(warehouse.read("a")) == rows(held) and rows(change.read("a")) == [(1, 0, "x"), (2, 1, "new")]
    change.commit()
    assert rows(held) == [(1, 0, "x"), (2, 1, "y"), (3, 1, "z")] and rows(warehouse.read("a", version=1)) == rows(held)
    assert rows(warehouse.read("a")) == [(1, 0, "x"), (2, 1, "new")] and warehouse.read("b").count() == 0 and warehouse.read("a", buckets=[0]).count() == 1
    # What a change didn't touch is the same file.
    assert set(warehouse.read("a", buckets=[0]).inputFiles()) <= set(held.inputFiles())


def test_a_change_that_dies_leaves_nothing_visible(spark, warehouse):
    change = warehouse.change()
    change.put("b", numbers(spark, (9, 0, "lost")))
    with pytest.raises(Exception, match="boom"):
        change.put("a", warehouse.read("a").withColumn("v", F.when(F.col("id") == 3, F.raise_error(F.lit("boom"))).otherwise(F.col("v"))), "bucket")
    assert warehouse.versions() == [1] and rows(Warehouse(spark, warehouse.root).read("b")) == [(1, 0, "x")]
    assert warehouse.expire() >= 1 and warehouse.read("a").count() == 3


def test_of_two_changes_the_later_one_conflicts(spark, warehouse):
    one, two = warehouse.change(), warehouse.change()
    one.put("b", numbers(spark, (1, 0, "one")))
    two.put("b", numbers(spark, (1, 0, "two")))
    assert one.commit() == 2
    with pytest.raises(Conflict):
        two.commit()
    assert rows(warehouse.read("b")) == [(1, 0, "one")]


def test_switching_back_and_expiry(spark, warehouse):
    change = warehouse.change()
    change.put("b", numbers(spark, (2, 0, "later")))
    change.commit()
    assert warehouse.switch(1) == 2 and rows(warehouse.read("b")) == [(1, 0, "x")] and warehouse.live() == 3
    assert warehouse.expire(keep=1) == 1 and warehouse.versions() == [3] and rows(warehouse.read("b")) == [(1, 0, "x")]
    for wrong in (1, 7):
        with pytest.raises(ValueError, match="no version"):
            warehouse.switch(wrong)
    with pytest.raises(ValueError, match="no table"):
        warehouse.read("c")


def test_a_hot_bucket_gets_several_files(spark, warehouse):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        change = warehouse.change()
        change.put("a", spark.range(60_000).select(F.col("id").cast("int"), F.lit(5).alias("bucket"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("v")), "bucket")
        change.commit()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(warehouse.read("a").inputFiles()) > 3 and warehouse.read("a").count() == 60_000


def test_tables_of_an_engine_change_together(spark, tmp_path):
    engine = ingest.Engine(spark, str(tmp_path), PROVIDERS, buckets=4)
    engine.add(docs(spark, ("a", "alpha"), ("b", "beta")))
    before, version = engine.corpus(), engine.warehouse.live()
    engine.delete("a")
    engine.add(docs(spark, ("c", "gamma")))
    assert ids(before.chunks) == ["a", "b"] and ids(before.index, "term") == ["a", "alpha", "b", "beta"] and before.vectors["v"].count() == 2
    assert ids(engine.table("lexical")) == ["b", "c"] and ids(engine.table("originals", version)) == ["a", "b"]


def poisoning():
    """A provider that fails on a batch with a poisoned text. Made here so that it travels to the workers whole."""

    def provider(texts):
        if any("poison" in t for t in texts):
            raise RuntimeError("can't read this")
        return dense.hashing_provider(8)(texts)

    return provider


def test_one_bad_document_of_a_thousand(spark, tmp_path):
    engine = ingest.Engine(spark, str(tmp_path), {"v": (poisoning(), 8, "1")}, buckets=4)
    batch = spark.range(1000).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.when(F.col("id") == 500, "some poison here").otherwise(F.concat(F.lit("text "), "id")).alias("raw_text"))
    result = {r.doc_id: r for r in engine.add(batch).collect()}
    assert len(result) == 1000 and sum(r.indexed for r in result.values()) == 999 and [d for d, r in result.items() if r.error_msg] == ["d500"]
    (q,) = engine.table("quarantine").collect()
    assert (q.doc_id, q.stage, q.error_msg, q.attempts) == ("d500", "embed", "can't read this", 1) and result["d500"].error_msg == "embed: can't read this"
    assert engine.table("lexical").count() == engine.table("vectors").count() == 999 and engine.table("originals").count() == 1000
    assert engine.retry_quarantined().first().indexed == 0 and engine.table("quarantine").first().attempts == 2
    engine.providers = PROVIDERS
    assert engine.retry_quarantined().first().indexed == 1 and engine.table("quarantine").count() == 0 and engine.table("lexical").count() == 1000


def test_a_document_that_fails_keeps_what_was_indexed(spark, tmp_path):
    engine = ingest.Engine(spark, str(tmp_path), {"v": (poisoning(), 8, "1")}, buckets=2)
    engine.add(docs(spark, ("a", "fine"), ("b", "fine too")))
    out = {r.doc_id: r for r in engine.add(docs(spark, ("a", "poison"), (None, "no id"), ("c", None), ("d", "good"))).collect()}
    assert {d: r.error_msg for d, r in out.items()} == {"a": "embed: can't read this", None: "validate: no id or no text", "c": "validate: no id or no text", "d": None}
    assert [r.text for r in engine.chunks_of("a").collect()] == ["fine"] and ids(engine.table("lexical")) == ["a", "b", "d"]
    assert engine.table("quarantine").count() == 3


def test_each_text_fails_alone_until_patience_ends(spark):
    calls, inner = spark.sparkContext.accumulator(0), poisoning()

    def provider(texts):
        calls.add(1)
        return inner(texts)

    some = spark.createDataFrame([(n, "poison" if n in (3, 77) else "t") for n in range(200)], "n int, context_text string").coalesce(1)
    bad = [r.n for r in dense.embed_each(some, provider, 8).where("error IS NOT NULL").collect()]
    assert bad == [3, 77] and calls.value < 40
    calls.add(-calls.value)
    down = spark.createDataFrame([("poison",)] * 3000, "context_text string").coalesce(1)
    assert dense.embed_each(down, provider, 8).where("error = \"can't read this\" AND vector IS NULL").count() == 3000 and calls.value < 400
    wide = dense.embed_each(some, lambda t: [[1.0] * (7 if x == "poison" else 8) for x in t], 8)
    assert wide.where("error IS NOT NULL").count() == 2


def test_reconciliation_reads_only_buckets_that_differ(spark, tmp_path):
    engine = ingest.Engine(spark, str(tmp_path), PROVIDERS, buckets=8)
    engine.add(docs(spark, *[(f"d{n}", f"text {n}") for n in range(60)]))
    assert engine.reconcile()["in_sync"] == 60 and engine.scanned == 0
    engine.delete("d7")
    assert engine.reconcile()["in_sync"] == 59 and engine.scanned == 0
    # Lost behind the engine's back: the folders are new, so their digests are made anew.
    engine.store("vectors").replace(engine.store("vectors").read().where("doc_id <> 'd8'"), "bucket")
    out = engine.reconcile()
    assert out == {"lexical_only": 1, "vector_only": 0, "in_sync": 58, "newly_recorded": 1, "already_pending": 0} and engine.scanned == 1
    assert engine.reconcile()["already_pending"] == 1
    whole = bookkeeping.reconcile(engine.table("lexical"), engine.table("vectors"), engine.table("failures"))[0].first().asDict()
    assert engine.reconcile() == whole


def test_rebuild_tells_its_phases(spark, tmp_path):
    engine = ingest.Engine(spark, str(tmp_path), PROVIDERS, buckets=4)
    engine.add(docs(spark, *[(f"d{n}", f"text {n}") for n in range(12)]))
    told = []
    assert engine.rebuild(told.append, batches=4)["switched"]
    assert [t["phase"] for t in told] == ["provision", *["index"] * 4, "switch", "cleanup", "done"]
    counts = [t["chunks"] for t in told if t["phase"] == "index"]
    assert counts == sorted(counts) and counts[0] < counts[-1] == 12 and told[-1]["documents"] == 12
    before, told = engine.warehouse.live(), []
    engine.providers = {"v": (lambda t: [[0.0]] * len(t), 8, "2")}
    out = engine.rebuild(told.append)
    assert not out["switched"] and out["failed"] == 12 and told[-1]["phase"] == "error" and engine.warehouse.live() == before and engine.table("lexical").count() == 12
    engine.budget = None
    with pytest.raises(AttributeError):
        engine.rebuild(told.append)
    assert told[-1]["phase"] == "error" and engine.warehouse.live() == before
