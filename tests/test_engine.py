import json
import re

import pytest
from pyspark.sql import functions as F

from siftstone import __main__ as cli
from siftstone.operators import bookkeeping, dense
from siftstone.plans import config, ingest, models
from siftstone.sources import tables
from siftstone.streaming import jobs

PROVIDERS = {"v": (dense.hashing_provider(8), 8, "1")}


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "news", {"title": i}) for i, t in rows], "doc_id string, raw_text string, business_type string, source_metadata map<string,string>")


@pytest.fixture
def engine(spark, tmp_path):
    return ingest.Engine(spark, str(tmp_path), PROVIDERS, buckets=4)


def ids(table, column="doc_id"):
    return sorted({r[0] for r in table.select(column).collect()})


def test_life_of_documents(spark, engine):
    result = engine.add(docs(spark, ("a", "# T\nalpha one\n\nalpha two"), ("b", "beta")))
    assert {r.doc_id: (r.indexed, r.failed) for r in result.collect()} == {"a": (3, 0), "b": (1, 0)}
    before = sorted(map(tuple, engine.table("lexical").select("chunk_id", "text").collect()))
    engine.add(docs(spark, ("a", "# T\nalpha one\n\nalpha two")))
    assert sorted(map(tuple, engine.table("lexical").select("chunk_id", "text").collect())) == before
    engine.update(spark.createDataFrame([("a", "short")], "doc_id string, raw_text string"))
    assert engine.table("lexical").where("doc_id = 'a'").count() == 1 and engine.get("a").first().source_metadata == {"title": "a"}
    assert engine.rebuild() == {"switched": True, "documents": 2, "indexed_documents": 2, "chunks": 2, "split_chunks": 0, "failed": 0}
    assert engine.delete("a") == {"originals": 1, "lexical": 1, "vectors": 1} and ids(engine.table("vectors")) == ["b"]
    assert engine.delete("a") == {"originals": 0, "lexical": 0, "vectors": 0}
    assert {r.name: r.rows for r in engine.status().collect()} == {"originals": 1, "lexical": 1, "vectors": 1, "failures": 0}
    assert ids(engine.table("postings").where("field = 'text'"), "term") == ["beta"] and ids(engine.table("postings").where("field = 'title'"), "term") == ["b"]
    assert ids(engine.list_ids()) == ["b"]
    chunk = engine.chunks_of("b").select("chunk_id")
    assert engine.delete_chunks(chunk) == {"lexical": 1, "vectors": 1} and engine.table("postings").count() == 0


def test_plain_upsert_leaves_orphans(spark, engine):
    engine.add(docs(spark, ("a", "# T\none\n\ntwo")))
    engine.add(docs(spark, ("a", "one")), replace=False)
    assert engine.table("lexical").count() > 1


def test_reconcile_and_retry(spark, engine):
    engine.add(docs(spark, ("a", "alpha"), ("b", "beta")))
    engine.store("lexical").replace(engine.store("lexical").read().where("doc_id <> 'a'"), "bucket")
    assert engine.reconcile() == {"lexical_only": 0, "vector_only": 1, "in_sync": 1, "newly_recorded": 1, "already_pending": 0}
    assert engine.reconcile()["already_pending"] == 1
    assert engine.retry() == {"attempted": 1, "resolved": 1, "still_failing": 0}
    assert ids(engine.table("lexical")) == ["a", "b"] and engine.purge_resolved() == 1
    engine.store("vectors").replace(engine.store("vectors").read().where("doc_id <> 'a'"), "bucket")
    engine.reconcile()
    assert engine.retry(max_attempts=1) == {"attempted": 1, "resolved": 0, "still_failing": 1} and engine.retry(max_attempts=1)["attempted"] == 0


def test_failure_records_count_attempts(spark):
    none = spark.createDataFrame([], tables.FAILURES)
    new = spark.createDataFrame([("c", "d", "both", "x")], "chunk_id string, doc_id string, failure_mode string, error_msg string")
    now = F.to_timestamp(F.lit("2024-01-01"))
    one = bookkeeping.record_failures(none, new, now)
    two = bookkeeping.record_failures(one, new.withColumn("error_msg", F.lit("y")), now)
    assert [(r.attempt_count, r.error_msg) for r in one.collect() + two.collect()] == [(0, "x"), (1, "y")]


def test_enhancement_policies(spark):
    df = spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", "half")], "doc_id string, text string")
    replies = {"good": '```json\n{"summary": ["s1", "s2"], "keywords": ["k"]}\n```', "bad": "?", "half": '{"summary": "s"}'}
    out = {r.doc_id: r for r in ingest.enhance(df, lambda t: [replies[x] for x in t], ("summary", "keywords")).collect()}
    assert out["a"].enhanced and out["a"].summary == "s1 s2" and out["a"].keywords == ["k"]
    assert not out["b"].enhanced and out["b"].enhancement_error and out["c"].enhancement_error == "missing field keywords" and out["c"].summary is None

    def down(texts):
        raise RuntimeError("down")

    assert ingest.enhance(df, down).first().enhancement_error == "down"
    with pytest.raises(Exception, match="down"):
        ingest.enhance(df, down, policy="fail_fast").collect()


def test_serialised_rows(spark):
    c = spark.createDataFrame([("c1", "d", "body", "ctx body", ["H", "I"], ["k1", "k2"], {"m": "1", "a": "2"}, {"author": "x", "doc_id": "no"})], "chunk_id string, doc_id string, text string, context_text string, heading_path array<string>, keywords array<string>, embedding_model_versions map<string,string>, source_metadata map<string,string>")
    lex = bookkeeping.lexical_rows(c.withColumn("entities", F.lit(None).cast("array<string>")), ["author", "doc_id"]).first()
    assert (lex.text, lex.derived_keywords, lex.derived_entities, lex.heading_path, lex.embedding_model_versions, lex.author, lex.doc_id) == ("ctx body", "k1 k2", None, "H I", "a=2,m=1", "x", "d")
    vec = bookkeeping.vector_rows(c)
    assert vec.first().text == "body" and not [n for n in vec.columns if n.startswith("derived")]


def test_audit(spark):
    rows = [("d", "g", "p", 1, 1, "c2", "two"), ("d", "g", "p", 1, 0, "c1", "one"), ("d", None, "p", 1, 2, "c3", "x"), ("e", None, None, 1, 0, "c4", "y")]
    c = spark.createDataFrame(rows, "doc_id string, lc_group_id string, parent_id string, hierarchy_level int, position int, chunk_id string, text string")
    report, root = jobs.audit(c, lambda prompts: ['{"verdict": "should_merge", "confidence": "high", "reason": "r", "affected_chunk_ids": ["c1", "zz"]}'] * len(prompts)).orderBy("doc_id").collect()
    assert (root.doc_id, root.total_groups, root.groups[0].group_key, root.groups[0].grouping_type, root.skipped) == ("e", 1, "root:c4", "parent_id_fallback", 0)
    assert (report.doc_id, report.total_groups, report.should_merge, report.skipped, report.groups[0].affected) == ("d", 1, 1, 1, ["c1"])

    def down(prompts):
        raise RuntimeError("down")

    assert jobs.audit(c, down).first().audit_failed == 1


def test_streams_equal_batches(spark, engine, tmp_path):
    source = str(tmp_path / "in")
    docs(spark, ("a", "# T\nalpha"), ("b", "beta")).withColumn("stored_at", F.current_timestamp()).select(*tables.ORIGINALS.names).coalesce(1).write.parquet(source)
    jobs.ingest_stream(engine, source, str(tmp_path / "ck")).awaitTermination()
    assert ids(engine.table("lexical")) == ["a", "b"]
    good = lambda p: ['{"verdict": "ok", "affected_chunk_ids": []}'] * len(p)
    jobs.audit_stream(engine, good, source, str(tmp_path / "ck2")).awaitTermination()
    assert ids(engine.table("reviews")) == ["a", "b"] and engine.clear_reviews("a") == 1 and ids(engine.table("reviews")) == ["b"]
    jobs.ingest_stream(engine, source, str(tmp_path / "ck")).awaitTermination()
    assert engine.table("lexical").count() == 3


def test_only_touched_partitions_change(spark, engine):
    engine.add(docs(spark, *[(f"d{n}", f"text {n}") for n in range(40)]))
    files = lambda: set(engine.store("lexical").read().inputFiles())
    before = files()
    engine.add(docs(spark, ("d1", "other words")))
    assert len(before - files()) == len(files() - before) == 1 and engine.table("lexical").count() == 40
    assert ids(engine.table("postings").where("term = 'other'"), "chunk_id") == ids(engine.chunks_of("d1"), "chunk_id")


def test_late_chunks(spark, tmp_path):
    def tokens(texts):
        """A token a word, its vector by the word's length."""
        out = []
        for t in texts:
            spans = [m.span() for m in re.finditer(r"\S+", t)]
            out.append((spans, [[float(b - a), 1.0] for a, b in spans]))
        return out

    engine = ingest.Engine(spark, str(tmp_path), PROVIDERS, buckets=2, late={"late": (tokens, 2, "7", 512)})
    engine.add(docs(spark, ("a", "# T\nalpha one\n\nbeta gamma two")))
    rows = engine.table("vectors").collect()
    assert all(len(r.named_vectors["late"]) == 2 and abs(sum(x * x for x in r.named_vectors["late"]) - 1) < 1e-9 and r.embedding_model_versions == "late=7,v=1" for r in rows)
    assert set(engine.corpus().vectors) == {"v", "late"}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for name, text in (("a", "red apple pie"), ("b", "blue sky")):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps({"doc_id": name, "raw_text": text, "business_type": "n", "source_metadata": {"title": name}}))
    (tmp_path / "c.json").write_text(json.dumps(base()))
    items = [{"id": "1", "query": "apple", "relevant_doc_ids": ["a"], "relevant_chunk_ids": [], "notes": ""}, {"id": "2", "query": "", "relevant_doc_ids": [], "relevant_chunk_ids": [], "notes": "expected_empty=true"}]
    (tmp_path / "g.json").write_text(json.dumps({"version": "1", "business_type": "n", "items": items}))
    where = ["--root", str(tmp_path / "t"), "--config", str(tmp_path / "c.json")]
    assert cli.main(["ingest", *where, "--source", str(tmp_path / "in")]) == 0
    assert cli.main(["evaluate", *where, "--golden", str(tmp_path / "g.json"), "--report", str(tmp_path / "r")]) == 0
    said = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert said["avg_recall_5"] == 1.0 and said["negative_rejection_rate"] == 1.0 and said["total_queries"] == 2
    worse = tables.read_report(spark, str(tmp_path / "r")).withColumn("avg_recall_5", F.lit(0.5))
    tables.write_report(worse, str(tmp_path / "w"))
    same = ["compare", "--baseline", str(tmp_path / "r"), "--current"]
    assert cli.main([*same, str(tmp_path / "r")]) == 0 and cli.main([*same, str(tmp_path / "w")]) == 1
    assert "recall@5 dropped from 1.0000 to 0.5000" in capsys.readouterr().out


def test_golden_and_originals(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"version": "1", "business_type": "n", "items": [{"id": "1", "query": "q", "relevant_doc_ids": ["a"], "relevant_chunk_ids": [], "notes": ""}, {"id": "2", "query": "r", "relevant_doc_ids": [], "relevant_chunk_ids": [], "notes": "x=1; expected_empty=true"}]}))
    assert [r.expected_empty for r in tables.read_golden(spark, str(tmp_path / "g.json")).orderBy("id").collect()] == [False, True]
    (tmp_path / "o" / "aa").mkdir(parents=True)
    (tmp_path / "o" / "aa" / "aa1.json").write_text('{"raw_text": "x"}')
    (tmp_path / "o" / "bad.json").write_text("{")
    assert [(r.doc_id, r.raw_text) for r in tables.read_json_originals(spark, str(tmp_path / "o")).collect()] == [("aa1", "x")]


def base():
    return {
        "version": "0.1", "standard_fields": {"fields": [{"name": "title", "type": "text"}, {"name": "created_time", "type": "date"}]}, "models": {"embeddings": [{"id": "m", "vector_name": "v", "dimension": 8}]},
        "chunking": {"length": {"max_tokens": 400, "overlap_tokens": 40, "context_preservation_tokens": 80}},
        "retrieval": {"retrievers": [{"id": "l", "type": "lexical"}, {"id": "d", "type": "dense", "model_id": "m", "vector_name": "v", "weight": 0.5}], "fusion": {"method": "weighted_rrf"}, "rerank": {"enabled": True, "top_k": 50}},
    }


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(base()))
    c = config.load_config(str(tmp_path / "c.json"))
    assert c.weights() == {"l": 1.0, "d": 0.5} and c.budget.text_tokens == 320 and {"chunk_id", "title", "created_time"} <= set(c.chunk_schema().names) and c.dump()["fusion_k"] == 60


@pytest.mark.parametrize(
    "change,message",
    [
        (lambda d: d["retrieval"]["retrievers"][1].update(model_id="x"), "no model 'x'"),
        (lambda d: d["retrieval"]["retrievers"][1].update(vector_name="x"), "vector_name differs"),
        (lambda d: d["retrieval"]["retrievers"][1].pop("model_id"), "needs model_id"),
        (lambda d: d["retrieval"]["retrievers"][0].update(odd=1), "unknown keys"),
        (lambda d: d["standard_fields"]["fields"][0].update(type="blob"), "unknown type"),
        (lambda d: d["retrieval"]["rerank"].pop("top_k"), "top_k is needed"),
        (lambda d: d["chunking"]["length"].update(overlap_tokens=400), "stay below"),
        (lambda d: d["retrieval"].update(retrievers=[]), "empty"),
        (lambda d: d.pop("models"), "models.embeddings: missing"),
        (lambda d: d["retrieval"]["fusion"].update(method="sum"), "unknown 'sum'"),
    ],
)
def test_config_errors(change, message):
    data = base()
    change(data)
    with pytest.raises(config.ConfigError, match=message):
        config.parse_config(data)


def test_config_files(tmp_path):
    with pytest.raises(config.ConfigError, match="no such file"):
        config.load_config(str(tmp_path / "none.json"))
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(config.ConfigError, match="no JSON"):
        config.load_config(str(tmp_path / "bad.json"))


def test_small_reads_of_an_engine(spark, engine):
    engine.add(docs(spark, ("a", "alpha"), ("b", "beta")))
    chunk = engine.chunks_of("a").first().chunk_id
    assert engine.lexical_row(chunk).first().text == "alpha" and engine.lexical_row("none").count() == 0
    engine.store("vectors").replace(engine.store("vectors").read().where("doc_id <> 'a'"), "bucket")
    engine.reconcile()
    assert tuple(engine.pending().first()) == (1, 1)
    assert ids(engine.due_reviews()) == ids(engine.due_reviews(None)) == ["a", "b"]
    good = lambda p: ['{"verdict": "ok", "affected_chunk_ids": []}'] * len(p)
    assert jobs.audit_sweep(engine, good, 1) == 1 and engine.reviews("a").count() == 1 and ids(engine.due_reviews(None)) == ["b"]


def test_requests_have_limits(spark):
    assert ingest.checked_request(docs(spark, ("a", "x"))).count() == 1
    for bad in (docs(spark), docs(spark, ("a", "")), docs(spark, (None, "x")), docs(spark, *[(str(n), "x") for n in range(51)])):
        with pytest.raises(ValueError, match="request"):
            ingest.checked_request(bad)


def test_models_are_listed_and_tried(spark):
    settings = config.Config("1", (), ({"id": "m1", "name": "n", "version": 2, "vector_name": "v1", "dimension": 8, "max_seq_len": 512, "normalize": True}, {"id": "m2", "vector_name": "v2", "dimension": 4}), ())
    assert [(r.ord, r.id, r.version, r.dimension, r.normalize) for r in models.models(spark, settings).orderBy("ord").collect()] == [(0, "m1", "2", 8, True), (1, "m2", None, 4, None)]
    texts = spark.createDataFrame([(n, f"t{n}") for n in range(3)], "n int, text string")
    providers = {"m1": dense.hashing_provider(8), "m2": dense.hashing_provider(9)}
    rows = models.embed_texts(texts, settings, providers).collect()
    assert len(rows) == 6 and all((r.vector is None) == (r.model_id == "m2") and (r.error is None) == (r.model_id == "m1") for r in rows)
    assert models.embed_texts(texts, settings, providers, "m1").count() == 3
    with pytest.raises(KeyError, match="m1"):
        models.embed_texts(texts, settings, providers, "m3")
    with pytest.raises(ValueError, match="256"):
        models.embed_texts(spark.range(257).selectExpr("int(id) AS n", "'t' AS text"), settings, providers)


def test_models_of_late_chunks_are_called_by_batches(spark):
    from siftstone.operators import chunking

    calls = spark.sparkContext.accumulator(0)

    def provider(texts):
        calls.add(1)
        return [([(i, i + 1) for i in range(len(t))], [[float(ord(c)), 1.0] for c in t]) for t in texts]

    rows = [(f"c{n}", f"g{n // 5}" if n % 7 else None, n % 5, "ab", "ab", 3 * (n % 5), 3 * (n % 5) + 2) for n in range(400)]
    c = spark.createDataFrame(rows, "chunk_id string, lc_group_id string, position int, text string, context_text string, char_start int, char_end int")
    out = chunking.late_chunk_vectors(c, provider, 2, 100).collect()
    assert len(out) == 400 and calls.value <= 20 and all(len(r.vector) == 2 for r in out)
