"""The index of inverted lists against brute force, on vectors with and without structure, and on odd ones."""

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.operators import ann, dense
from siftstone.plans import query
from siftstone.plans.config import Retriever


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, v) for i, v in enumerate(x)], "chunk_id long, vector array<double>")


def asked(vectors, every=50):
    return vectors.where(F.col("chunk_id") % every == 0).select(F.col("chunk_id").alias("query_id"), "vector")


def share(found, exact):
    r = ann.recall(found, exact).agg(F.sum("found"), F.sum("wanted")).first()
    return r[0] / r[1]


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 1, (60, 32))
    x = centres[rng.integers(0, 60, 4000)] + rng.normal(0, 0.25, (4000, 32))
    x[:1300] = x[0]  # a third of all rows is one vector
    return table(spark, x.tolist()).cache()


def test_few_probes_where_vectors_have_structure(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "SLICE_ROWS", 300)  # the cell of the copies is searched in slices
    monkeypatch.setattr(ann, "QUERY_ROWS", 8)
    z = ann.fit(clustered)
    assert z.probes <= len(z.centres) / 4
    index = ann.build(clustered, str(tmp_path / "i"), z)
    assert index.rows().count() == 4000 == index.sizes().agg(F.sum("n")).first()[0]
    found = ann.search(index, asked(clustered), 10)
    # Copies tie; what counts is the scores that are reached.
    exact = dense.cosine_topk(clustered, asked(clustered), 10)
    both = found.select("query_id", "rank", F.col("score").alias("s")).join(exact, ["query_id", "rank"], "right")
    assert both.where("abs(coalesce(s, -2) - score) < 1e-5").count() >= 0.9 * exact.count() and found.where("query_id = chunk_id OR query_id < 1300").count() > 0
    assert found.groupBy("query_id").count().where("count <> 10").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    again = ann.load(spark, str(tmp_path / "i"))
    assert sorted(ann.search(again, asked(clustered), 10).collect()) == sorted(found.collect())


def test_all_probes_and_candidates_give_the_exact_result(spark, tmp_path):
    x = np.random.default_rng(1).normal(0, 1, (500, 24))
    v = table(spark, x.tolist())
    index = ann.build(v, str(tmp_path / "i"), ann.fit(v))
    exact = dense.cosine_topk(v, asked(v), 10)
    assert sorted(map(tuple, ann.search(index, asked(v), 10, probes=10**6, keep=500).collect())) == sorted(map(tuple, exact.collect()))
    assert share(ann.search(index, asked(v), 10), exact) >= 0.9


def test_recall_on_the_tables(spark, tmp_path):
    v = spark.read.parquet(compare.DATA.replace("0.001", "0.1") + "/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    index = ann.build(v, str(tmp_path / "i"), ann.fit(v))
    assert share(ann.search(index, asked(v, 10), 10), dense.cosine_topk(v, asked(v, 10), 10)) >= 0.9


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0])]
    v = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    index = ann.build(v, str(tmp_path / "i"), ann.fit(v))
    assert index.rows().count() == 4
    q = spark.createDataFrame([("a", [2.0, 0.0]), ("b", None), ("c", [1.0, 2.0, 3.0])], "query_id string, vector array<double>")
    assert [tuple(r) for r in ann.search(index, q, 2).orderBy("rank").collect()] == [("a", 1, 1, 1.0), ("a", 2, 1, 1.0)]
    none = ann.build(v.limit(0), str(tmp_path / "n"), ann.fit(v.limit(0)))
    assert ann.search(none, q, 3).count() == 0 and ann.load(spark, str(tmp_path / "n")).quantiser is None
    assert ann.fit(v.where("chunk_id > 2")) is None or ann.fit(v.where("chunk_id > 2")).width == 3


def test_a_retriever_may_ask_the_index(spark, tmp_path):
    texts = [f"word{n} other{n % 7}" for n in range(300)]
    chunks = spark.createDataFrame([(f"c{n}", t) for n, t in enumerate(texts)], "chunk_id string, text string")
    v = dense.embed(chunks, dense.hashing_provider(16), 16, "text").select("chunk_id", "vector")
    index = ann.build(v, str(tmp_path / "i"), ann.fit(v))
    corpus = query.Corpus(chunks, None, {"v": v}, {"v": index})
    models = query.Models(embed={"a": (dense.hashing_provider(16), 16), "e": (dense.hashing_provider(16), 16)})
    q = query.preprocess(spark.createDataFrame([(n, texts[n]) for n in range(0, 300, 30)], "query_id int, query string"))
    both = query.retrieve(q, corpus, [Retriever("a", "dense", 5, vector_name="v", engine="approximate"), Retriever("e", "dense", 5, vector_name="v")], models, query.Filters(), None)
    scores = {(r.retriever_id, r.query_id, r["rank"]): r.score for r in both.collect()}
    # Texts of one hash tie, so scores are compared and not ids.
    assert len(scores) == 100 and sum(abs(scores["a", n, k] - scores["e", n, k]) < 1e-5 for _, n, k in scores if _ == "a") >= 45
    filtered = query.retrieve(q, corpus, [Retriever("a", "dense", 5, vector_name="v", engine="approximate")], models, query.Filters(extra={"chunk_id": "c7"}), None)
    assert {r.chunk_id for r in filtered.collect()} == {"c7"}
