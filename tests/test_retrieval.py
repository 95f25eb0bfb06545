import json

import pytest
from pyspark.sql import functions as F

from siftstone.operators import dense, fusion, lexical
from siftstone.operators.lexical import Filters
from siftstone.plans import evaluate, query
from siftstone.plans.config import Ladder, Retriever


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("c1", "d1", None, "red apple pie", "Pie", "x"), ("c2", "d1", "c1", "green apple", "", "x"), ("c3", "d2", None, "blue sky", "Sky", "y"), ("c4", "d3", "zz", "apple apple apple", None, "y")]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, parent_id string, text string, title string, business_type string")
    embedded = dense.embed(chunks, dense.hashing_provider(64), 64, "text").select("chunk_id", "vector")
    return query.Corpus(chunks, lexical.postings(chunks, fields={"text": "text", "title": "title"}), {"v": embedded})


def asked(spark, *texts):
    return spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "query_id int, query string")


def test_filters_are_ands_of_what_is_set(spark):
    assert Filters().is_empty and Filters().predicates() == [] and Filters(business_type="").predicates() == []
    full = Filters("a", "b", "c", "2024-01-01", "2024-02-01", {"k": "v"})
    assert len(full.predicates()) == 6
    assert Filters().bound_to("x").business_type == "x" and Filters("y").bound_to("x").business_type == "y"


def test_filter_on_unknown_field_passes_nothing(spark, corpus):
    assert Filters(extra={"nope": "1"}).apply(corpus.chunks).count() == 0
    assert Filters(business_type="y").apply(corpus.chunks).count() == 2


def test_bm25_orders_and_boosts(spark, corpus):
    hits = lexical.bm25_topk(corpus.index, asked(spark, "apple", "pie", " "), 10).collect()
    got = {q: [r.chunk_id for r in sorted(hits, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 1, 2)}
    assert got[0][0] == "c4" and set(got[0]) == {"c1", "c2", "c4"} and got[1] == ["c1"] and got[2] == []


def test_highlight(spark):
    df = spark.createDataFrame([("An Apple a day", ["apple", "day"]), ("none", ["apple"])], "t string, q array<string>")
    assert [r.h for r in df.select(lexical.highlighted(F.col("t"), F.col("q")).alias("h")).collect()] == [["An <em>Apple</em> a <em>day</em>"], None]


def test_highlights_at_the_ends_of_fragments(spark):
    hit, parted, tail = "<em>apple</em>", "x " * 73 + "a apple pie", "b " * 100
    rows = [
        (parted + " rest", ["apple"], [f"{'x ' * 73}a {hit}"]),  # a hit over the end of the first 150 characters
        ("x" * 147 + "apple " + tail + "apple", ["apple"], None),
        ("apple " * 200, ["apple"], None),
        (None, ["apple"], []),
        ("apple", [], []),
    ]
    df = spark.createDataFrame([(n, t, q) for n, (t, q, _) in enumerate(rows)], "n int, t string, q array<string>")
    got = {r.n: r.h for r in df.select("n", lexical.highlighted(F.col("t"), F.col("q")).alias("h")).collect()}
    assert got[0] == rows[0][2] and got[3] is None and got[4] is None
    # The first letters of a fragment may be the end of a word, which is no hit.
    assert len(got[1]) == 1 and got[1][0].endswith("b " + hit) and got[1][0].count("<em>") == 1
    assert len(got[2]) == 3 and all(f.replace("<em>", "").replace("</em>", "") == "apple " * 25 for f in got[2])


def test_copies_and_equal_queries_are_scored_once(spark, monkeypatch):
    words = ["red apple", "red apple", "green apple pie", "blue sky", "apple red", ""]
    rows = [(n, words[n % 6] if n % 7 else "apple " * (1 + n % 3), "red" if n % 2 else "sky blue") for n in range(240)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, title string")
    queries = spark.createDataFrame([(n, ["red apple", "Apple red apple", "sky pie", "blue", "none", ""][n % 6]) for n in range(60)], "query_id long, query string")
    text = lexical.materialised(lexical.tokenised(chunks, fields={"text": "text", "title": "title"}), "tokens")
    allowed = chunks.where("chunk_id % 5 > 1").select("chunk_id")
    for only in (None, allowed):
        few = lexical._few_of_copies(text, 4, only)
        assert few.count() < text.count() / 3 and few.agg(F.sum("copies")).first()[0] == text.count()
        for most in (lexical.BROADCAST_TERMS, 0):  # postings counted row by row, and by joins
            monkeypatch.setattr(lexical, "BROADCAST_TERMS", most)
            found = {tuple(r) for r in lexical.search(text, queries, 4, digits=6, allowed=only).collect()}
            assert len({r[2:] for r in found}) < len(found) / 4
            index = lexical.postings(chunks, fields={"text": "text", "title": "title"})
            # Each query alone, over all postings.
            alone = lexical._distinct_topk(index, lexical.query_terms(queries), 4, None, only, 6, None)
            assert found == {tuple(r) for r in alone.collect()}
            monkeypatch.undo()


def test_dense_ties_and_bad_vectors(spark):
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("n", None), ("z", [0.0, 0.0]), ("w", [1.0, 0.0, 0.0]), ("h", [1.0, None])], "chunk_id string, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, vector array<double>")
    assert [tuple(r) for r in dense.cosine_topk(v, q, 5).orderBy("rank").collect()] == [(1, 1, "a", 1.0), (1, 2, "b", 1.0)]


def test_embedding_width_is_checked(spark):
    with pytest.raises(Exception, match="vectors for"):
        dense.embed(spark.createDataFrame([("x",)], "context_text string"), lambda t: [[1.0]] * len(t), 2).collect()


def hits(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id int, rank int, chunk_id string, score double")


def test_pool_keeps_order_and_isolates_failures(spark):
    def fails():
        raise RuntimeError("down")

    a, b = hits(spark, (1, 1, "x", 3.0)), hits(spark, (1, 1, "y", 0.9))
    pooled = fusion.pool([("one", "lexical", a), ("two", "dense", fusion.isolated(fails)), ("three", "dense", b)])
    assert [(r.retriever_id, r.n) for r in fusion.candidate_counts(pooled, ["one", "two", "three"]).orderBy("retriever_id").collect()] == [("one", 1), ("three", 1), ("two", 0)]
    empty = fusion.pool([("two", "dense", None)], a)
    assert empty.count() == 0 and fusion.candidate_counts(empty, ["two"]).first().n == 0 and fusion.fuse(fusion.pool([("two", "dense", None)])).count() == 0
    with pytest.raises(ValueError):
        fusion.pool([])


def test_answers_where_all_retrievers_fail(spark, corpus):
    lost = [Retriever("d", "dense", vector_name="none"), Retriever("e", "dense", vector_name="v")]
    rows = query.run(asked(spark, "apple"), corpus, lost).collect()
    assert [(r.answer, r.grounded, r.citations) for r in rows] == [(query.NO_ANSWER, False, None)]


def test_unsupported_retrievers_are_skipped(spark, corpus, caplog):
    some = [Retriever("odd", "graph"), Retriever("lex", "lexical")]
    found = query.search(query.preprocess(asked(spark, "apple")), corpus, some)
    assert found.count() > 0 and {i for r in found.collect() for i in r.source_retriever_ids} == {"lex"} and "odd" in caplog.text
    with pytest.raises(ValueError, match="supported"):
        query.search(query.preprocess(asked(spark, "apple")), corpus, some[:1])


def test_the_last_dense_score_decides_ties_of_rounds(spark):
    kind = "query_id int, pos int, chunk_id string, rerank_score double, rrf_score double, dense_scores map<string,double>"
    one = spark.createDataFrame([(1, 1, "a", None, 0.5, {"x": 0.9, "y": 0.1}), (1, 2, "b", None, 0.5, {"x": 0.2, "y": 0.8}), (1, 3, "c", None, 0.5, {})], kind)
    merged = fusion.merge_rounds(one, one.limit(0)).orderBy("pos").collect()
    assert [r.chunk_id for r in merged] == ["b", "a", "c"]


@pytest.mark.parametrize("most", [10**6, 0])
def test_pruned_search_equals_scoring_everything(spark, monkeypatch, most):
    """Queries of common and rare terms over documents of a few words, against sums over all postings; by blocks and by joins."""
    monkeypatch.setattr(lexical.maxscore, "MOST_TERMS", most)
    import math
    import random

    rng = random.Random(8)
    vocabulary = ["common"] + [f"w{n}" for n in range(40)]
    texts = [" ".join(["common"] + rng.choices(vocabulary, weights=[3] + [1 / (n + 1) for n in range(40)], k=rng.randint(1, 12))) for _ in range(600)]
    titles = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 3))) for _ in texts]
    chunks = spark.createDataFrame([(f"c{n:03d}", a, b) for n, (a, b) in enumerate(zip(texts, titles))], "chunk_id string, text string, title string")
    queries = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 6))) + " common" for _ in range(40)] + ["common", "nowhere", "", "w39"]
    want = {}
    stats = {}
    for f, values, boost in (("text", texts, 1.0), ("title", titles, 3.0)):
        split = [v.split() for v in values]
        there = [s for s in split if s]
        stats[f] = (split, len(there), sum(map(len, there)) / len(there), boost)
    for q, text in enumerate(queries):
        best = {}
        for split, n, avg, boost in stats.values():
            for term in set(text.split()):
                df = sum(term in s for s in split)
                for i, s in enumerate(split):
                    if (tf := s.count(term)):
                        best.setdefault((i, boost), 0.0)
                        best[i, boost] += boost * math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(s) / avg))
        score = {}
        for (i, _), s in best.items():
            score[i] = max(score.get(i, 0), s)
        want[q] = [(f"c{i:03d}", pytest.approx(s, abs=2e-6)) for i, s in sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:7]]
    for index in (lexical.postings(chunks, fields={"text": "text", "title": "title"}), None):
        if index is None:
            found = lexical.search(lexical.tokenised(chunks, fields={"text": "text", "title": "title"}), asked(spark, *queries), 7, digits=6)
        else:
            found = lexical.bm25_topk(index, asked(spark, *queries), 7, digits=6)
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
        assert {q: v for q, v in want.items() if v} == got


def test_pruning_opens_few_blocks(spark, monkeypatch):
    """A term that all documents and queries hold adds no candidates: rows grow with the queries, not with queries times documents."""
    from siftstone.operators import maxscore

    monkeypatch.setattr(maxscore, "MOST_TERMS", 0)
    chunks = spark.range(20_000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("all of them hold own"), "id").alias("text"))
    queries = spark.range(200).select(F.col("id").alias("query_id"), F.concat(F.lit("all hold own"), "id").alias("query"))
    seen = []
    kept = maxscore.materialised
    try:
        maxscore.materialised = lambda df, name: (seen.append((name, kept(df, name))), seen[-1][1])[1]
        found = lexical.search(lexical.tokenised(chunks), queries, 1)
    finally:
        maxscore.materialised = kept
    assert found.where("chunk_id = query_id").count() == 200
    assert dict(seen)["candidates"].count() < 5_000 < 200 * 20_000


def test_ties_and_frequent_terms_leave_a_cell_k_times(spark, monkeypatch):
    """Texts that differ, but tie for every query: what the tasks give back grows with the queries times k, not times the ties (2,000 here)."""
    from siftstone.operators import maxscore

    monkeypatch.setattr(maxscore, "MOST_TERMS", 0)
    monkeypatch.setattr(maxscore, "CELLS", 6, raising=False)
    chunks = spark.range(2_000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("large ring own"), "id").alias("text"))
    queries = spark.range(0, 2_000, 20).select(F.col("id").alias("query_id"), F.concat(F.lit("large ring own"), "id").alias("query"))
    seen = []
    kept = maxscore.materialised
    monkeypatch.setattr(maxscore, "materialised", lambda df, name: (seen.append((name, kept(df, name))), seen[-1][1])[1])
    found = {}
    for r in lexical.search(lexical.tokenised(chunks), queries, 3, digits=6).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.chunk_id)
    assert found == {q: [q, *[n for n in range(3) if n != q][:2]] for q in range(0, 2_000, 20)}
    assert dict(seen)["candidates"].count() <= 6 * 3 * 100 < 100 * 2_000


@pytest.mark.parametrize("names", ["int", "str"])
def test_a_cell_equals_scoring_everything(monkeypatch, names):
    """Random impacts with many ties and near ties in several zones, in small pieces, against plain sums; and cells without documents or queries."""
    import random

    import pyarrow as pa

    from siftstone.operators import maxscore

    for name, value in (("PIECE_ROWS", 7), ("AT_ONCE", 60), ("PENDING", 10)):
        monkeypatch.setattr(maxscore, name, value)
    rng = random.Random(3)
    name = (lambda n: n) if names == "int" else (lambda n: f"d{n}")
    kind = pa.int64() if names == "int" else pa.string()
    for trial in range(60):
        k, digits, terms = rng.choice([1, 2, 5]), 6, rng.choice([3, 12])
        # Zones 0 and 1 are of a field with terms below 100, zone 64 of another one. Parts of halves tie, those with 3e-8 only after rounding.
        docs = [(t + 100 * (z > 1), z, name(d), rng.choice([0.5, 1.0, 1.5, 1.5 + 3e-8])) for d in range(40) for z in {rng.choice([0, 1]), 64} for t in range(terms) if rng.random() < 0.4]
        asked = {q: [t + f for t in range(terms) if rng.random() < 0.5 for f in (0, 100)] for q in range(15)}
        want, rows = {}, []
        for q, ts in asked.items():
            sums = {}
            for t, z, d, part in sorted(docs):
                if t in ts:
                    sums[z, d] = sums.get((z, d), 0.0) + part
            best = {}
            for (_, d), s in sums.items():
                best[d] = max(best.get(d, 0.0), round(s, digits))
            want[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
            # A bar is the score of some k documents less the slack.
            some = sorted(rng.sample(sorted(best.values()), k))[0] - 2e-6 if rng.random() < 0.5 and len(best) >= k else 0.0
            rows += [(q, t, some) for t in ts]
        rng.shuffle(docs)
        rng.shuffle(rows)
        table = lambda rows, fields: pa.table([pa.array([r[n] for r in rows], of) for n, (_, of) in enumerate(fields)], [f for f, _ in fields])
        left = table(docs, [("t", pa.int64()), ("zone", pa.int64()), ("chunk_id", kind), ("part", pa.float64())])
        right = table(rows, [("query_id", pa.int64()), ("t", pa.int64()), ("bar", pa.float64())])
        got = {q: {} for q in asked}
        for r in maxscore._cell(left, right, k, 1e-6).to_pylist():
            of = got[r["query_id"]]
            of[r["chunk_id"]] = max(of.get(r["chunk_id"], 0.0), round(r["s"], digits))
        assert {q: sorted(of.items(), key=lambda x: (-x[1], x[0]))[:k] for q, of in got.items()} == want
        for a, b in ((left.slice(0, 0), right), (left, right.slice(0, 0)), (left.slice(0, 0), right.slice(0, 0))):
            none = maxscore._cell(a, b, k, 1e-6)
            assert len(none) == 0 and none.schema.field("chunk_id").type == kind


def test_fusion_sums_and_merges(spark):
    pooled = fusion.pool([("lex", "lexical", hits(spark, (1, 1, "x", 3.0), (1, 2, "y", 2.0))), ("den", "dense", hits(spark, (1, 1, "y", 0.9), (1, 2, "z", 0.8)))])
    rows = fusion.fuse(pooled, 60, {"lex": 1.0, "den": 0.5}).orderBy("pos").collect()
    assert [r.chunk_id for r in rows] == ["y", "x", "z"] and rows[0].rrf_score == round(1 / 62 + 0.5 / 61, 9)
    assert rows[0].bm25_score == 2.0 and rows[0].dense_scores == {"den": 0.9} and rows[0].rank_in_retriever == {"lex": 2, "den": 1} and rows[2].bm25_score is None
    plain = fusion.fuse(pooled).orderBy("pos").collect()
    assert {r.chunk_id: r.rrf_score for r in plain}["x"] == round(1 / 61, 9)


def test_rerank_degrades(spark):
    fused = fusion.fuse(fusion.pool([("lex", "lexical", hits(spark, (1, 1, "x", 3.0), (1, 2, "y", 2.0), (2, 1, "z", 1.0)))]))
    scores = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.4)], "query_id int, pos int, rerank_score double")
    rows = {(r.query_id, r.chunk_id): r for r in fusion.rerank(fused, scores).collect()}
    assert rows[1, "y"].pos == 1 and rows[1, "x"].rerank_score == 0.0 and rows[1, "x"].reranked
    assert not rows[2, "z"].reranked and rows[2, "z"].degradation_reason
    assert fusion.rerank(fused, None, 1).count() == 2 and fusion.rerank(fused, None, 1, enabled=False).count() == 3
    odd = spark.createDataFrame([(1, 2, 0.0), (1, 9, 0.4), (2, 5, 0.1)], "query_id int, pos int, rerank_score double")
    rows = {(r.query_id, r.chunk_id): (r.pos, r.rerank_score, r.reranked) for r in fusion.rerank(fused, odd).collect()}
    assert rows == {(1, "y"): (1, 0.0, True), (2, "z"): (1, None, False)}
    assert not any(r.reranked for r in fusion.rerank(fused, odd.unionAll(scores)).collect())
    kept = fusion.at_least(fusion.rerank(fused, scores), 0.1)
    assert {(r.query_id, r.chunk_id) for r in kept.collect()} == {(1, "y"), (2, "z")}


def test_backfill_and_context(spark, corpus):
    found = spark.createDataFrame([(1, 1, "c2", 0.5), (1, 2, "c4", 0.4), (2, 1, "c1", 0.3), (2, 2, "c2", 0.2)], "query_id int, pos int, chunk_id string, rerank_score double")
    chosen = fusion.backfilled(found, corpus.chunks)
    assert [(r.query_id, r.chunk_id) for r in chosen.orderBy("query_id", "pos").collect()] == [(1, "c1"), (1, "c4"), (2, "c1"), (2, "c2")]
    built = {r.query_id: r for r in fusion.build_context(chosen, spark.createDataFrame([(1,), (2,), (3,)], "query_id int")).collect()}
    assert built[1].context_text == "[1] Pie\nred apple pie" + fusion.BLOCK_DELIMITER + "[2] d3\napple apple apple" and built[1].citations[1]["index"] == 2
    assert built[3].is_empty and built[3].context_text == "" and built[3].candidate_count == 0


def test_min_score_empties_context_and_no_model_is_asked(spark, corpus):
    def never(queries, contexts):
        raise AssertionError("asked")

    out = query.run(asked(spark, "apple"), corpus, [Retriever("lex", "lexical")], query.Models(score=lambda q, t: [0.12] * len(q), answer=never), min_score=0.5).first()
    assert out.answer == query.NO_ANSWER and not out.grounded


def test_whole_pipeline(spark, corpus):
    models = query.Models(embed={"den": (dense.hashing_provider(64), 64)}, rewrite=lambda q: [x + " pie" if x == "red" else None for x in q])
    out = {r.query_id: r for r in query.run(asked(spark, "apple", "", "red"), corpus, [Retriever("lex", "lexical"), Retriever("den", "dense", vector_name="v")], models, ladder=Ladder(10, 10, 5, 2)).collect()}
    assert out[0].grounded and out[0].answer.startswith("[1]") and not out[1].grounded and "red apple pie" in out[2].answer


def evaluation(**changes):
    return json.dumps({"sufficient": False, "confidence": "low", "missing_aspects": "m", "sub_queries": ["a"]} | changes)


def test_self_evaluation_is_strict(spark):
    said = [evaluation(sub_queries=[" a ", 3, "", "b", "c"]), f"```json\n{evaluation(sufficient=True, missing_aspects=' TOPIC_ABSENT ')}\n```", "no json", evaluation(sufficient="no"), None, evaluation(confidence=0.9), evaluation(missing_aspects=["m"]), evaluation(sub_queries="a"), evaluation(sub_queries=[]), evaluation(missing_aspects="TOPIC_ABSENT")]
    rows = query.self_evaluation(spark.createDataFrame([(n, r) for n, r in enumerate(said)], "query_id int, reply string")).orderBy("query_id").collect()
    assert [r.sufficient for r in rows] == [False, *[True] * 8, False] and rows[0].sub_queries == ["a", "b"] and rows[1].sub_queries == []
    assert [r.query_id for r in rows if r.topic_absent] == [1] and rows[2].confidence == "low" and rows[0].missing == "m"


def test_second_round(spark, corpus):
    absent, more, fine = evaluation(sufficient=True, missing_aspects="TOPIC_ABSENT"), evaluation(sub_queries=["blue sky"]), evaluation(sufficient=True)

    def judge(queries, shown):
        return [absent if "sky" in q else more if "pie" in q else fine for q in queries]

    asked_ = asked(spark, "pie", "sky", "green")
    out = {r.query_id: r for r in query.iterate(asked_, corpus, [Retriever("lex", "lexical")], judge).collect()}
    assert out[0].iterations == 2 and {c.chunk_id for c in out[0].citations} == {"c1", "c3"} and out[0].confidence == "low"
    assert out[1].answer == query.NO_ANSWER and out[1].citations is None and out[1].topic_absent and not out[1].grounded and out[1].iterations == 1
    assert out[2].iterations == 1 and out[2].grounded and out[2].citations[0].highlight == ["<em>green</em> apple"]

    def down(queries, shown):
        raise RuntimeError("down")

    assert all(r.iterations == 1 and r.grounded for r in query.iterate(asked_, corpus, [Retriever("lex", "lexical")], down).collect())


def test_unknown_retrievers_are_errors(spark, corpus):
    with pytest.raises(ValueError, match="no retriever of a supported type"):
        query.run(asked(spark, "pie"), corpus, [Retriever("odd", "magic")])


def test_evaluation(spark):
    golden = spark.createDataFrame([(1, ["a", "b"], False), (2, [], True), (3, [], True)], "id int, relevant_doc_ids array<string>, expected_empty boolean")
    got = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (1, 3, "x"), (1, 4, "b"), (3, 1, "x")], "id int, rank int, doc_id string")
    r = evaluate.report(evaluate.item_results(golden, got)).first()
    assert (r.total_queries, r.avg_recall_3, r.avg_mrr, r.negative_total, r.negative_correct_rejections, r.negative_rejection_rate) == (3, 1.0, 0.5, 2, 1, 0.5)
    base = spark.createDataFrame([("recall", 3, 1.0), ("gone", 1, 0.5), ("same", 1, 0.5)], "metric string, k int, value double")
    now = spark.createDataFrame([("recall", 3, 0.9), ("same", 1, 0.49)], "metric string, k int, value double")
    assert {x.metric for x in evaluate.regressions(base, now).collect()} == {"recall", "gone"}


def test_filters_are_echoed_and_the_ladder_is_overridden(spark, corpus):
    asked_ = query.preprocess(asked(spark, "apple"))
    told = query.echoed(asked_, Filters(category="c", extra={"k": "v"}), "news").first()
    assert told.filters == {"business_type": "news", "category": "c", "k": "v"} and told.effective == "apple" and query.echoed(asked_, Filters()).first().filters == {}
    full, one = (query.run(asked(spark, "apple"), corpus, [Retriever("lex", "lexical")], top_k=k).first() for k in (None, {"context_top_k": 1}))
    assert len(full.citations) == 3 and len(one.citations) == 1
    assert query.with_ladder(Ladder(), recall_top_k=None, rerank_top_k=3) == Ladder(rerank_top_k=3)


def test_copies_are_told_by_the_digest_of_the_table_of_tokens(spark):
    chunks = spark.createDataFrame([(n, "ten equal words") for n in range(10)] + [(10, "another one"), (11, "Kelvin K İx"), (12, "café 中文字 a1")], "chunk_id long, text string")
    plain = lexical.tokenised(chunks)
    table = lexical.with_digest(plain)
    read = lexical._few_of_copies(table.withColumn("tokens", F.lit(None).cast("array<string>")), 3).select("chunk_id", "copies").orderBy("chunk_id").collect()
    assert [tuple(r) for r in read] == [(0, 8), (1, 1), (2, 1), (10, 1), (11, 1), (12, 1)]
    assert lexical._few_of_copies(table, 3).columns == lexical._few_of_copies(plain, 3).columns
    of = {r.chunk_id: r.tokens for r in plain.collect()}
    assert of[0] == ["ten", "equal", "words"] and of[11][:2] == ["kelvin", "k"] and of[12] == ["café", "中文", "文字", "a1"]
