"""Queries of the engine's own operators by name, and the SQL that each has to equal."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.functions import markup
from siftstone.functions import text as T
from siftstone.functions import values as V
from siftstone.operators import ann, bookkeeping, chunking, dense, fusion, lexical, replies, segment
from siftstone.operators.lexical import Filters
from siftstone.plans import evaluate, ingest
from siftstone.sources.tables import FAILURES, delete_where, discard, materialised, shared_folder, upsert
from siftstone.streaming.jobs import event_windows


#: Rarest terms by which passages meet documents.
KEY_TERMS = 3


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- retrieval -----------------------------------------------------------------------------------------------------


def _tokens(spark, sf_dir) -> DataFrame:
    return materialised(lexical.with_digest(lexical.tokenised(_t(spark, sf_dir, "documents"), "doc_id")), "tokens")


def _bm25(spark, sf_dir, k=10, allowed=None, tokens=None) -> DataFrame:
    asked = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    if tokens is not None:
        return lexical.search(tokens, asked, k, allowed=allowed, digits=6)
    tokens = _tokens(spark, sf_dir)
    found = lexical.search(tokens, asked, k, allowed=allowed, digits=6)
    discard(tokens)  # search() has read them
    return found


def hybrid_bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir).select(F.col("query_id").alias("item_id"), "rank", F.col("chunk_id").alias("doc_id"), "score")


def bm25_filtered(spark, sf_dir):
    docs = Filters(business_type="en").apply(_t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("business_type")))
    return _bm25(spark, sf_dir, 5, docs.select(F.col("doc_id").alias("chunk_id"))).select(F.col("query_id").alias("item_id"), "rank", F.col("chunk_id").alias("doc_id"), "score")


def term_statistics(spark, sf_dir):
    index = lexical.postings(_t(spark, sf_dir, "documents"), "doc_id")
    index = materialised(index, "postings")
    return lexical.term_stats(index).join(index.groupBy("field", "term").agg(F.sum("tf").alias("cf")), ["field", "term"]).select("term", "df", "cf")


def field_statistics(spark, sf_dir):
    return lexical.field_stats(lexical.postings(_t(spark, sf_dir, "documents"), "doc_id")).select("field", "n_docs", F.round("avgdl", 6).alias("avgdl"))


def _vectors(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _asked(vectors: DataFrame) -> DataFrame:
    """The stated query set: ids divisible by 100, against all rows."""
    return vectors.where(F.col("chunk_id") % 100 == 0).select(F.col("chunk_id").alias("query_id"), "vector")


def dense_cosine_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return dense.cosine_topk(v, _asked(v), 10).select("query_id", "rank", F.col("chunk_id").alias("vec_id"), "score")


def _ann(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(the approximate ten best, the exact ten best) of the stated queries."""
    v = _vectors(spark, sf_dir).select("chunk_id", "vector")
    index = ann.build(v, f"{shared_folder(spark)}/ann-{uuid.uuid4().hex}", ann.fit(v))
    return ann.search(index, _asked(v), 10), dense.cosine_topk(v, _asked(v), 10)


def ann_topk(spark, sf_dir):
    """The ten most similar vectors by the index of inverted lists."""
    return _ann(spark, sf_dir)[0].select("query_id", "rank", F.col("chunk_id").alias("vec_id"), "score")


def ann_recall(spark, sf_dir):
    """Of the exact ten best of all queries, how many there are, and whether the index finds nine tenths of them."""
    found, exact = _ann(spark, sf_dir)
    return ann.recall(found, exact).agg(F.count("*").alias("queries"), F.sum("wanted").alias("wanted"), (F.sum("found") >= 0.9 * F.sum("wanted")).alias("recall_reached"))


def _two_models(spark, sf_dir, k=50) -> DataFrame:
    """Two 32-component halves of the vectors stand for two models."""
    lists = []
    for name, start in (("first", 1), ("second", 33)):
        v = _vectors(spark, sf_dir).withColumn("vector", F.slice("vector", start, 32))
        lists.append((name, "dense", dense.cosine_topk(v, _asked(v), k)))
    return materialised(fusion.pool(lists), "pool")


def weighted_rrf(spark, sf_dir):
    fused = fusion.fuse(_two_models(spark, sf_dir), 60, {"first": 1.0, "second": 0.8}, 20)
    return fused.select("query_id", "pos", F.col("chunk_id").alias("vec_id"), F.col("rrf_score").alias("rrf"))


def plain_rrf(spark, sf_dir):
    fused = fusion.fuse(_two_models(spark, sf_dir), 60, None, 20)
    return fused.select("query_id", "pos", F.col("chunk_id").alias("vec_id"), F.col("rrf_score").alias("rrf"))


def candidate_counts(spark, sf_dir):
    return fusion.candidate_counts(_two_models(spark, sf_dir), ["first", "second", "third"])


def rerank_min_score(spark, sf_dir):
    """The full vector's cosine reranks the fused halves; 0.3 and more stay."""
    fused = materialised(fusion.fuse(_two_models(spark, sf_dir), 60, None, 200), "fused")
    v = _vectors(spark, sf_dir).select("chunk_id", "vector")
    head = fused.where("pos <= 30").select("query_id", "pos", "chunk_id")
    pairs = head.join(v, "chunk_id").join(v.select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("q")), "query_id")
    scores = pairs.select("query_id", "pos", F.round(V.cosine(F.col("q"), F.col("vector")), 6).alias("rerank_score"))
    ranked = fusion.at_least(fusion.rerank(fused, scores, 30), 0.3)
    return ranked.select("query_id", "pos", F.col("chunk_id").alias("vec_id"), "rerank_score")


def context_blocks(spark, sf_dir):
    """The three best documents of each passage as a numbered context."""
    found = _bm25(spark, sf_dir, 3).withColumnRenamed("rank", "pos").withColumnRenamed("score", "rerank_score")
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id"), F.col("lang").alias("title"), "text", "source")
    asked = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    built = fusion.build_context(found.join(docs, "chunk_id"), asked)
    return built.select(F.col("query_id").alias("item_id"), F.md5("context_text").alias("digest"), F.length("context_text").alias("chars"), "candidate_count", "is_empty")


def parent_backfill(spark, sf_dir):
    """Line items as candidates, orders as their parents: one join finds the parents that aren't candidates."""
    orders = _t(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), "o_orderpriority")
    lines = _t(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber").alias("chunk_id"), F.concat(F.lit("o"), "l_orderkey").alias("parent_id"), F.lit("line").alias("o_orderpriority"), "l_suppkey", "l_extendedprice")
    found = lines.select(F.col("l_suppkey").alias("query_id"), "chunk_id", F.col("l_extendedprice").alias("score"))
    hits = lexical.ranked(found.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), 8).withColumnRenamed("rank", "pos")
    chunks = orders.unionByName(lines.select("chunk_id", "parent_id", "o_orderpriority").dropDuplicates(["chunk_id"]))
    return fusion.backfilled(hits, chunks).select("query_id", "pos", "chunk_id", "o_orderpriority")


# --- evaluation ----------------------------------------------------------------------------------------------------


def _holders(items: DataFrame, docs: DataFrame, doc_tokens: DataFrame) -> DataFrame:
    """(item_id, doc_id): all pairs whose document may hold the passage, by its KEY_TERMS rarest terms.

    The first and last term of a passage may be parts of longer ones in the document and don't count. Passages without others meet the documents whose terms
    hold their longest one: found among the distinct terms by its first three characters. Passages without terms meet the documents with their first character.
    """
    tokens = items.select("item_id", lexical.lexical_tokens(F.col("text")).alias("t"))
    terms = tokens.where("size(t) > 2").select("item_id", F.explode(F.array_distinct(F.expr("slice(t, 2, size(t) - 2)"))).alias("term"))
    index = materialised(lexical.postings_of(doc_tokens, only=terms.select("term").distinct()).select("term", F.col("chunk_id").alias("doc_id")), "postings")
    df = index.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rare = Window.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "term")
    keys = terms.join(df, "term", "left").withColumn("n", F.row_number().over(rare)).where(F.col("n") <= KEY_TERMS)
    keys = keys.select("item_id", "term", F.max("n").over(Window.partitionBy("item_id")).alias("n"))
    near = index.join(keys, "term").groupBy("item_id", "doc_id", "n").agg(F.count_distinct("term").alias("met")).where("met = n")
    near = near.select("item_id", "doc_id")
    return near.unionByName(_short_holders(items, tokens, docs, doc_tokens)) if tokens.where("size(t) <= 2").limit(1).count() else near


def _short_holders(items: DataFrame, tokens: DataFrame, docs: DataFrame, doc_tokens: DataFrame) -> DataFrame:
    """_holders() of passages of two terms or fewer."""
    index = materialised(doc_tokens.select(F.col("chunk_id").alias("doc_id"), F.explode(F.array_distinct("tokens")).alias("term")), "all-terms")
    longest = F.try_element_at(F.array_sort("t", lambda a, b: F.length(a) - F.length(b)), F.lit(-1))
    short = tokens.where("size(t) BETWEEN 1 AND 2").select("item_id", longest.alias("part")).withColumn("gram", F.substring("part", 1, 3))
    size = short.select(F.length("gram").alias("size"), "gram").distinct()
    # Of the vocabulary, not of the documents: each distinct term once with each of its parts of these sizes.
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("term")))
    parts = index.select("term").distinct().select("term", F.explode(F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.substr("term", i, n)))))).alias("gram"))
    longer = parts.join(F.broadcast(size.select("gram").distinct()) if size.count() <= lexical.BROADCAST_TERMS else size.select("gram").distinct(), "gram", "left_semi").join(short, "gram").where(F.contains("term", F.col("part")))
    by_part = longer.select("item_id", "term").join(index, "term").select("item_id", "doc_id").distinct()
    bare = items.join(tokens.where("size(t) = 0").select("item_id"), "item_id").select("item_id", F.substring("text", 1, 1).alias("sign"))
    signs = docs.select("doc_id", F.explode(F.array_append(F.array_distinct(F.split(F.regexp_replace("text", r"[\p{L}\p{N}]+", ""), "")), "")).alias("sign"))
    return by_part.unionByName(signs.join(bare, "sign").select("item_id", "doc_id").distinct())


def _golden(spark, sf_dir, tokens: DataFrame | None = None) -> DataFrame:
    """Relevant are the documents that hold a passage; passages that none holds are negatives."""
    items, docs = _t(spark, sf_dir, "benchmark"), _t(spark, sf_dir, "documents")
    pairs = _holders(items, docs, tokens if tokens is not None else _tokens(spark, sf_dir)).join(items, "item_id").join(docs.select("doc_id", F.col("text").alias("body")), "doc_id")
    held = pairs.where(F.contains("body", F.col("text"))).groupBy("item_id").agg(F.array_sort(F.collect_set("doc_id")).alias("relevant_doc_ids"))
    none = F.array().cast("array<bigint>")
    return items.select("item_id").join(held, "item_id", "left").select(F.col("item_id").alias("id"), F.coalesce("relevant_doc_ids", none).alias("relevant_doc_ids"), F.col("relevant_doc_ids").isNull().alias("expected_empty"))


def _items(spark, sf_dir) -> DataFrame:
    tokens = _tokens(spark, sf_dir)
    found = _bm25(spark, sf_dir, tokens=tokens).select(F.col("query_id").alias("id"), "rank", F.col("chunk_id").alias("doc_id"))
    return evaluate.item_results(_golden(spark, sf_dir, tokens), found)


def eval_items(spark, sf_dir):
    m = [f"{n}_{k}" for n in ("recall", "precision", "ndcg") for k in (1, 10)]
    return _items(spark, sf_dir).select("id", "expected_empty", *[F.round(c, 6).alias(c) for c in (*m, "mrr")])


def eval_report(spark, sf_dir):
    r = evaluate.report(_items(spark, sf_dir))
    return r.select("total_queries", "negative_total", "negative_correct_rejections", *[F.round(c, 6).alias(c) for c in ("avg_recall_10", "avg_ndcg_10", "avg_mrr", "negative_rejection_rate")])


def regression_gate(spark, sf_dir):
    """Mean event value by type in the first half of the month against the second."""
    e = _t(spark, sf_dir, "events")
    half = lambda c: e.where(c).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value")).select("metric", F.lit(1).alias("k"), "value")
    mid = F.to_timestamp(F.lit("2024-01-16"))
    return evaluate.regressions(half(F.col("ts") < mid), half(F.col("ts") >= mid), 0.0).select("metric", F.round("baseline", 6).alias("baseline"), F.round("current", 6).alias("current"))


# --- cleaning and text ---------------------------------------------------------------------------------------------


def clean_documents(spark, sf_dir):
    """Lengths before and after all rules but the composition of characters, which SQL lacks."""
    done = T.clean(_t(spark, sf_dir, "documents").select("doc_id", "text"), "text", T.CleaningProfile(compose=False), out="clean")
    return done.select("doc_id", F.md5("clean").alias("digest"), T.chars_removed(F.col("log")).alias("removed"), T.any_change(F.col("log")).alias("changed"))


def clean_log(spark, sf_dir):
    done = T.clean(_t(spark, sf_dir, "pages").select("page_id", "html"), "html", T.CleaningProfile(), out="clean")
    return done.select("page_id", F.posexplode("log").alias("n", "r")).select("page_id", "n", "r.op", "r.chars_before", "r.chars_after", "r.detail")


def html_tree_text(spark, sf_dir):
    """Pages by the tag state machine: no scripts and styles, all entities."""
    done = T.clean(_t(spark, sf_dir, "pages").select("page_id", "html"), "html", T.CleaningProfile(use_defaults=False, compose=False, tree_html=True), out="clean")
    parsed = F.element_at("log", 4)
    return done.select("page_id", F.md5("clean").alias("digest"), parsed["chars_after"].alias("chars"))


def encoding_repair(spark, sf_dir):
    """Documents of which two thirds are damaged here, once or twice: read as Latin-1 though they are UTF-8. All come back as they were."""
    wrong = lambda t: F.decode(F.encode(t, "UTF-8"), "ISO-8859-1")
    damage = F.when(F.col("doc_id") % 3 == 0, wrong(F.col("text"))).when(F.col("doc_id") % 3 == 1, wrong(wrong(F.col("text")))).otherwise(F.col("text"))
    seen = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("whole"), damage.alias("text"))
    done = seen.withColumn("r", markup.repaired_encoding(F.col("text")))
    return done.select("doc_id", F.md5("r.text").alias("digest"), (F.col("r.places") > 0).alias("repaired"))


def strip_html(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(T._html(F.col("html"))[0]).alias("digest"))


def query_normalisation(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.normalize_query(F.col("text"))).alias("digest"))


def token_budget(spark, sf_dir):
    t = F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", T.token_count(t).alias("tokens"), T.fits(t, 400, 80).alias("fits"), F.md5(T.truncate_tokens(t, 320)).alias("head"), F.md5(T.token_suffix(t, 40)).alias("tail"))


def identities(spark, sf_dir):
    o = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    key = V.chunk_id(F.col("l_orderkey"), F.lit(2), F.col("l_linenumber"))
    return o.select("l_orderkey", "l_linenumber", key.alias("chunk_id"), V.sub_chunk_id(key, F.lit(0)).alias("sub_id"), V.point_id(key).alias("point_id"), V.review_id(F.col("l_orderkey"), F.lit("2024-01-01")).alias("review_id"))


def versions_text(spark, sf_dir):
    p = _t(spark, sf_dir, "part").groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), F.col("p_size").cast("string")))).alias("m"))
    return p.select("p_brand", V.versions_text(F.col("m")).alias("versions"))


def unit_vectors(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: x * 3)
    return v.select("vec_id", F.round(V.norm(V.l2_normalized(scaled)), 6).alias("length"), F.round(F.get(V.l2_normalized(scaled), F.lit(0)), 6).alias("first"))


# --- chunks --------------------------------------------------------------------------------------------------------


def _chunks(spark, sf_dir, overlap=0) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("lang").alias("business_type"))
    budget = chunking.Budget(overlap_tokens=overlap, semantic=True, whole_nodes=True)
    nodes = chunking.parse(docs.where(F.length(F.trim("text")) > 0), budget.levels)
    return chunking.semantic_split(chunking.chunk(materialised(nodes, "nodes"), docs, budget, "1"), budget)


def structure_nodes(spark, sf_dir):
    nodes = chunking.parse(_t(spark, sf_dir, "documents").where(F.length(F.trim("text")) > 0))
    return nodes.groupBy("doc_id", "node_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def structural_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir, overlap=40).select("chunk_id", "doc_id", "parent_id", "hierarchy_level", "position", "token_count", "char_start", "char_end", F.md5("context_text").alias("digest"))


# --- tables and bookkeeping ----------------------------------------------------------------------------------------


def upsert_orders(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return upsert(o, new, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


def _sides(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("chunk_id"), F.col("o_custkey").alias("doc_id"), "o_orderpriority", "o_orderstatus")
    return o.where("o_orderpriority <> '1-URGENT'"), o.where("o_orderstatus <> 'P'")


def _waiting(spark, sf_dir):
    a, _ = _sides(spark, sf_dir)
    now = F.to_timestamp(F.lit("2024-01-01"))
    failed = a.where("o_orderstatus = 'P' AND o_orderpriority = '5-LOW'").select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), F.lit("qdrant_write").alias("failure_mode"), F.lit("x").alias("error_msg"))
    return bookkeeping.record_failures(spark.createDataFrame([], FAILURES), failed, now)


def reconcile_counts(spark, sf_dir):
    return bookkeeping.reconcile(*_sides(spark, sf_dir), _waiting(spark, sf_dir))[0]


def reconcile_drift(spark, sf_dir):
    return bookkeeping.reconcile(*_sides(spark, sf_dir), _waiting(spark, sf_dir))[1]


def digest_drift(spark, sf_dir):
    """reconcile_drift, but digests of both sides' buckets say which rows have to be compared at all."""
    bucketed = lambda df: materialised(df.withColumn("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(64)).cast("int")), "side")
    a, b = map(bucketed, _sides(spark, sf_dir))
    apart = materialised(bookkeeping.differing(bookkeeping.digests(a), bookkeeping.digests(b)).where("NOT same"), "apart")
    return bookkeeping.reconcile(bookkeeping.of_differing(a, apart), bookkeeping.of_differing(b, apart), _waiting(spark, sf_dir))[1]


def quarantine_outcomes(spark, sf_dir):
    """Documents by source as an ingestion leaves them, where the model refuses texts with an access identifier: what is indexed, and what is set aside and why."""
    docs = _t(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("raw_text"))
    made = dense.embed_each(docs.where(~ingest.invalid(docs)), _refusing(8), 8, text="raw_text")
    chunks = materialised(made.select("doc_id", F.col("doc_id").alias("chunk_id"), F.lit(1).alias("hierarchy_level"), F.lit(0).alias("position"), "error"), "embedded")
    bad = ingest.isolated_failures(docs, chunks)
    joined = docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]), "left")
    return joined.groupBy("source", "stage", "error_msg").agg(F.count("*").alias("n"))


def _refusing(dimension: int):
    """A model that fails on any batch with an access identifier."""
    plain = dense.hashing_provider(dimension)

    def provider(texts: list[str]) -> list[list[float]]:
        if any("AKIA" in t for t in texts):
            raise ValueError("refused")
        return plain(texts)

    return provider


def retry_outcomes(spark, sf_dir):
    _, b = _sides(spark, sf_dir)
    drift = materialised(reconcile_drift(spark, sf_dir), "drift")
    records = bookkeeping.record_failures(spark.createDataFrame([], FAILURES), drift, F.to_timestamp(F.lit("2024-01-01")))
    return bookkeeping.retry(records, b, limit=None)[1].groupBy("resolved").agg(F.count("*").alias("n"))


def indexed_by_document(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("chunk_id"), F.col("l_suppkey").alias("doc_id"), "l_discount", "l_tax")
    _, _, failed = bookkeeping.dual_write(li, F.when(F.col("l_discount") > 0.09, "lexical"), F.when(F.col("l_tax") > 0.07, "vector"))
    failed = materialised(failed, "failed")
    return bookkeeping.index_result(li.dropDuplicates(["chunk_id"]), failed).select("doc_id", "indexed", "failed")


def failure_modes(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_suppkey").alias("doc_id"), "l_discount", "l_tax")
    failed = bookkeeping.dual_write(li, F.when(F.col("l_discount") > 0.09, "lexical"), F.when(F.col("l_tax") > 0.07, "vector"))[2]
    return failed.groupBy("failure_mode", "error_msg").agg(F.count("*").alias("n"))


def pending_documents(spark, sf_dir):
    chunks = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"))
    reviews = _t(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("doc_id"))
    return bookkeeping.pending_reviews(chunks, reviews, 20)


def latest_reviews(spark, sf_dir):
    """Each customer's last order stands for a document's last review."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderdate").alias("audited_at"), F.col("o_orderkey").alias("review_id"))
    return bookkeeping.latest_reviews(o).select("doc_id", "review_id")


def audit_prompts(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    parent = F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("c"), "conv_id"))
    chunks = c.select(F.col("role").alias("doc_id"), parent.alias("parent_id"), F.lit(None).cast("string").alias("lc_group_id"), F.lit(1).alias("hierarchy_level"), F.col("turn").alias("position"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), "text")
    return bookkeeping.audit_groups(chunks).select("doc_id", "group_key", "grouping_type", "first.position", F.size("chunk_ids").alias("n"), F.md5("prompt").alias("digest"))


def ungroupable_chunks(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("chunk_id"), F.when(F.col("o_orderstatus") == "F", "g").alias("lc_group_id"), F.lit(None).cast("string").alias("parent_id"))
    return bookkeeping.ungroupable(o)


def date_filter(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("created_time", F.col("ts")).withColumn("business_type", F.col("event_type"))
    f = Filters(created_after="2024-01-05T00:00:00Z", created_before="2024-01-12T00:00:00Z").bound_to("click")
    return f.apply(e).select("event_id", "event_type", F.round("value", 6).alias("value"))


def daily_events(spark, sf_dir):
    return event_windows(spark, _t(spark, sf_dir, "events")).select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def deletion_counts(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    kept, gone = delete_where(o, F.col("o_orderstatus") == "F")
    stays = kept.groupBy("o_orderpriority").agg(F.count("*").alias("kept"))
    return o.groupBy("o_orderpriority").agg(gone.alias("deleted")).join(stays, "o_orderpriority", "left").select("o_orderpriority", "deleted", F.coalesce("kept", F.lit(0)).alias("kept"))


# --- model replies -------------------------------------------------------------------------------------------------

#: Replies of many shapes, in SQL that both engines read.
_FENCE = "'```json' || chr(10) || {0} || chr(10) || '```'"
_AUDIT_REPLY = f"""CASE c_custkey % 9 WHEN 0 THEN 'no json' WHEN 1 THEN '["ok"]' WHEN 2 THEN '{{"verdict": "unclear", "confidence": "high"}}'
  WHEN 3 THEN {_FENCE.format("""'{"verdict": "boundary_issue", "confidence": "low", "reason": " cut ", "affected_chunk_ids": ["a", "zz", "b"]}'""")}
  WHEN 4 THEN '{{"verdict": "ok", "confidence": "sure", "reason": "  "}}' WHEN 5 THEN '{{"verdict": "should_merge", "confidence": "medium", "reason": "r", "affected_chunk_ids": "a"}}'
  WHEN 6 THEN chr(10) || ' {{"verdict": "should_split", "affected_chunk_ids": ["b", "b"]}} ' WHEN 7 THEN '{{"confidence": "high"}}' END"""
_EVAL_REPLY = f"""CASE c_custkey % 13 WHEN 0 THEN 'no json' WHEN 1 THEN '[]' WHEN 2 THEN '{{"sufficient": false, "confidence": "high", "missing_aspects": "m", "sub_queries": [" a ", "", 7, "b", "c"]}}'
  WHEN 3 THEN {_FENCE.format("""'{"sufficient": true, "confidence": "high", "missing_aspects": " TOPIC_ABSENT ", "sub_queries": []}'""")}
  WHEN 4 THEN '{{"sufficient": true, "confidence": "low", "missing_aspects": "FACTUAL_NEGATION", "sub_queries": ["x"]}}' WHEN 5 THEN '{{"sufficient": false, "confidence": "high", "missing_aspects": "TOPIC_ABSENT", "sub_queries": ["x"]}}'
  WHEN 6 THEN '{{"sufficient": "no", "confidence": "high", "missing_aspects": "", "sub_queries": ["x"]}}' WHEN 7 THEN '{{"sufficient": false, "confidence": 0.5, "missing_aspects": "", "sub_queries": ["x"]}}'
  WHEN 8 THEN '{{"sufficient": false, "confidence": "sure", "missing_aspects": "", "sub_queries": ["x"]}}' WHEN 9 THEN '{{"sufficient": false, "confidence": "low", "missing_aspects": ["m"], "sub_queries": ["x"]}}'
  WHEN 10 THEN '{{"sufficient": false, "confidence": "low", "missing_aspects": "", "sub_queries": "x"}}' WHEN 11 THEN '{{"sufficient": false, "confidence": "low", "missing_aspects": "", "sub_queries": [" "]}}' END"""
_ENHANCED_REPLY = f"""CASE c_custkey % 9 WHEN 0 THEN 'no json' WHEN 1 THEN '7' WHEN 2 THEN '{{"summary": " s ", "keywords": ["k", 2]}}'
  WHEN 3 THEN {_FENCE.format("""'{"summary": ["s1", "s2"], "keywords": []}'""")} WHEN 4 THEN '{{"summary": "s"}}' WHEN 5 THEN '{{"summary": "s", "keywords": "no list"}}'
  WHEN 6 THEN '{{"summary": null, "keywords": ["k"]}}' WHEN 7 THEN '{{"summary": 5, "keywords": ["k"]}}' END"""


def audit_verdicts(spark, sf_dir):
    """Verdicts read from replies of many shapes, about the chunks a and b."""
    said = _t(spark, sf_dir, "customer").select("c_custkey", F.expr(_AUDIT_REPLY).alias("reply"), F.array(F.lit("a"), F.lit("b")).alias("chunk_ids"))
    return bookkeeping.verdicts(said).select("c_custkey", "verdict", "confidence", F.when(F.col("verdict") != "audit_failed", F.col("reason")).alias("reason"), F.array_join("affected", ",").alias("affected"))


def self_evaluations(spark, sf_dir):
    """Evaluations of a first round, read from replies of many shapes."""
    said = _t(spark, sf_dir, "customer").select("c_custkey", replies.self_evaluation(F.expr(_EVAL_REPLY)).alias("e"))
    says = lambda s: replies.says(F.col("e"), s)
    return said.select("c_custkey", "e.sufficient", "e.confidence", "e.missing", F.array_join("e.sub_queries", "|").alias("sub_queries"), says(replies.TOPIC_ABSENT).alias("topic_absent"), says(replies.FACTUAL_NEGATION).alias("factual_negation"))


def enhancement_replies(spark, sf_dir):
    """Derived fields read from replies of many shapes."""
    said = _t(spark, sf_dir, "customer").select("c_custkey", replies.enhancement(F.expr(_ENHANCED_REPLY), ("summary", "keywords")).alias("e"))
    return said.select("c_custkey", F.col("e.error").isNull().alias("fine"), "e.summary", F.array_join("e.keywords", "|").alias("keywords"))


def rerank_by_index(spark, sf_dir):
    """Queries whose scores are whole, too few, or partly out of range: the last lose the candidates that no score names."""
    fused = materialised(fusion.fuse(_two_models(spark, sf_dir), 60, None, 20), "fused")
    q = F.floor(F.col("query_id") / 100) % 3
    there = fused.where((q != 1) | (F.col("pos") <= 5)).where(F.col("pos") <= 10)
    index = F.when((q == 2) & (F.col("pos") > 7), F.col("pos") + 90).otherwise(F.col("pos"))
    scores = there.select("query_id", index.alias("pos"), F.round(F.col("rrf_score") * ((F.col("pos") * 7) % 11), 9).alias("rerank_score"))
    return fusion.rerank(fused, scores, 10).select("query_id", "pos", F.col("chunk_id").alias("vec_id"), "reranked", "rerank_score")


def round_merge(spark, sf_dir):
    """The halves of the vectors as two rounds: each candidate once as first met, and candidate counts over both."""
    pooled = _two_models(spark, sf_dir)
    one, two = (materialised(fusion.fuse(pooled.where(F.col("retriever_id") == r), 60, None, 30).withColumn("rerank_score", F.lit(None).cast("double")), r) for r in ("first", "second"))
    merged = fusion.merge_rounds(one, two)
    counts = fusion.counts_over_rounds(*[fusion.candidate_counts(pooled.where(F.col("retriever_id") == r), ["first", "second"]) for r in ("first", "second")])
    total = counts.agg(F.sum("n").alias("candidates"))
    return merged.select("query_id", "pos", F.col("chunk_id").alias("vec_id"), "rrf_score").join(F.broadcast(total))


# --- several fields ------------------------------------------------------------------------------------------------


def _part_search(spark, sf_dir) -> DataFrame:
    parts = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), "p_name", "p_type", "p_brand")
    tokens = materialised(lexical.tokenised(parts, fields={"text": "p_type", "title": "p_name", "derived_keywords": "p_brand"}), "tokens")
    asked = parts.where(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("query_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("query"))
    return lexical.search(tokens, asked, 5, digits=6)


def bm25_multi_field(spark, sf_dir):
    """Parts by type, name and brand with their boosts: a hit's best field counts."""
    return _part_search(spark, sf_dir).select("query_id", "rank", F.col("chunk_id").alias("p_partkey"), "score")


def highlights(spark, sf_dir):
    """The names of the parts found, with the query's terms marked."""
    parts = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("text"))
    asked = parts.where(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("query_id"), F.col("text").alias("query"))
    found = lexical.with_highlights(_part_search(spark, sf_dir), asked, parts)
    return found.select("query_id", F.col("chunk_id").alias("p_partkey"), F.array_join("highlight", "|").alias("highlight"))


# --- text without spaces -------------------------------------------------------------------------------------------

_LONGEST = 8


def _unspaced(spark, sf_dir) -> DataFrame:
    """Names and types of parts without the spaces."""
    return _t(spark, sf_dir, "part").select("p_partkey", F.lower(F.regexp_replace(F.concat("p_name", "p_type"), " ", "")).alias("text"))


def discovered_words(spark, sf_dir):
    """Words of the parts' names and types, found in them without their spaces."""
    counts = materialised(segment.grams(_unspaced(spark, sf_dir), _LONGEST + 1, run="[a-z]"), "grams")
    found = segment.discover(counts, _LONGEST, least=5, cohesion=1.0, entropy=0.5)
    return found.select("word", "n", F.round("cohesion", 6).alias("cohesion"), F.round("freedom", 6).alias("freedom"))


def segmented_parts(spark, sf_dir):
    """The same text cut by a dictionary of its words: the coarse path, and the number of fine terms."""
    spaced = _t(spark, sf_dir, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("word"))
    words = segment.Dictionary.of(spaced.groupBy("word").agg(F.count("*").alias("n")))
    coarse, fine = (segment.tokens(words, grain, "[a-z]") for grain in ("coarse", "fine"))
    cut = _unspaced(spark, sf_dir).select("p_partkey", coarse(F.col("text")).alias("coarse"), fine(F.col("text")).alias("fine"))
    return cut.select("p_partkey", F.array_join("coarse", " ").alias("coarse"), F.size("fine").alias("n_fine"))


QUERIES = {f.__name__: f for f in (
    hybrid_bm25_topk, bm25_filtered, term_statistics, field_statistics, dense_cosine_topk, ann_topk, ann_recall, weighted_rrf, plain_rrf, candidate_counts, rerank_min_score, context_blocks, parent_backfill,
    eval_items, eval_report, regression_gate, clean_documents, clean_log, html_tree_text, encoding_repair, strip_html, query_normalisation, token_budget, identities, versions_text, unit_vectors, structure_nodes, structural_chunks,
    upsert_orders, reconcile_counts, reconcile_drift, digest_drift, quarantine_outcomes, retry_outcomes, indexed_by_document, failure_modes, pending_documents, latest_reviews, audit_prompts, ungroupable_chunks, date_filter, daily_events, deletion_counts,
    audit_verdicts, self_evaluations, enhancement_replies, rerank_by_index, round_merge, bm25_multi_field, highlights, discovered_words, segmented_parts,
)}


# --- the same in SQL -----------------------------------------------------------------------------------------------

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


def _bm25_sql(k: int, where: str = "true") -> str:
    return f"""
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY doc_id),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
      FROM q JOIN p USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st WHERE doc_id IN (SELECT doc_id FROM documents WHERE {where}) GROUP BY ALL),
top AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s
        QUALIFY rank <= {k})"""


_COS = "round(list_inner_product({a}, {b}) / sqrt(list_inner_product({a}, {a}) * list_inner_product({b}, {b})), 6)"
_POOL = f"""
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
h AS (SELECT q.vec_id AS query_id, c.vec_id, m.r, {_COS.format(a='q.e[m.a:m.b]', b='c.e[m.a:m.b]')} AS s
      FROM v q, v c, (VALUES ('first', 1, 32), ('second', 33, 64)) m(r, a, b) WHERE q.vec_id % 100 = 0),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id, r ORDER BY s DESC, vec_id) AS rank FROM h QUALIFY rank <= 50)"""


def _rrf_sql(second: float, k: int) -> str:
    return f"""
f AS (SELECT query_id, vec_id, round(sum((CASE r WHEN 'first' THEN 1.0::DOUBLE ELSE {second}::DOUBLE END) / (60 + rank)), 9) AS rrf, min((r, rank)) AS met FROM l GROUP BY ALL),
t AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, met, vec_id)::INT AS pos, vec_id, rrf FROM f QUALIFY pos <= {k})"""


_GOLD = """
g AS (SELECT item_id, list(DISTINCT doc_id) AS rel FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id),
r AS (SELECT item_id, list(doc_id ORDER BY rank) AS got FROM top GROUP BY item_id),
m AS (SELECT item_id AS id, rel IS NULL AS expected_empty, coalesce(rel, []) AS rel, coalesce(got, []) AS got FROM benchmark LEFT JOIN g USING (item_id) LEFT JOIN r USING (item_id)),
hit AS (SELECT id, i AS rank, list_contains(rel, got[i]) AS hit FROM m, range(1, 11) x(i) WHERE i <= len(got)),
a AS (SELECT id,
        count(*) FILTER (hit AND rank <= 1) AS h1, count(*) FILTER (hit) AS h10, coalesce(1.0 / min(rank) FILTER (hit), 0.0) AS mrr,
        coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 1), 0) AS d1, coalesce(sum(1 / log2(rank + 1)) FILTER (hit), 0) AS d10 FROM hit GROUP BY id),
x AS (SELECT id, expected_empty,
        CASE WHEN len(rel) = 0 THEN 0 ELSE h1 / len(rel) END AS recall_1, CASE WHEN len(rel) = 0 THEN 0 ELSE h10 / len(rel) END AS recall_10, h1 / 1.0 AS precision_1, h10 / 10.0 AS precision_10,
        CASE WHEN len(rel) = 0 THEN 0 ELSE d1 END AS ndcg_1,
        CASE WHEN len(rel) = 0 THEN 0 ELSE d10 / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) y(i) WHERE i <= len(rel)) END AS ndcg_10, mrr, len(got) AS n FROM m JOIN a USING (id))"""

_HTML = r"""regexp_replace(regexp_replace({0}, '(?i)<(?:p|div|br|li|tr|h[1-6]|blockquote)[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g')"""
_HTML = "CASE WHEN regexp_matches({0}, '<[a-zA-Z/][^>]{{0,200}}>') THEN " + reduce(lambda s, e: f"replace({s}, '{e[0]}', '{e[1].replace(chr(39), chr(39) * 2)}')", T.ENTITIES, _HTML) + " ELSE {0} END"
#: Silent elements and comments go first, then tags; the entities of the pages, also without their semicolon.
_TREE = r"regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<![^>]*>', '', 'g'), '(?i)<(?:p|div|br|li|tr|h[1-6]|blockquote)(?:\s[^>]*)?>', chr(10), 'g'), '<[^>]+>', '', 'g')"
_TREE = reduce(lambda s, e: f"regexp_replace({s}, '&{e[0]};?', '{e[1]}', 'g')", [("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")], _TREE)
_STRIP = r"regexp_replace({0}, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"
_SPACES = _STRIP.format(r"regexp_replace(regexp_replace(regexp_replace({0}, '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
_PUNCT = reduce(lambda s, c: f"regexp_replace({s}, '[{c}]{{{{3,}}}}', '{c[-1]}', 'g')", ["!", "?", "~", "`", "@", "#", "$", "%", "&", "*", "\\^", "_", "+", "=", "|", "<", ">"], "{0}")
_PUNCT = f"regexp_replace(regexp_replace({_PUNCT}, '[.。]{{{{3,}}}}', '…', 'g'), '[-—]{{{{3,}}}}', '—', 'g')"
_LINES = reduce(lambda s, p: f"regexp_replace({s}, '{p}', '', 'g')", [p.replace("(?mdUi)", "(?mi)").replace("(?mdU)", "(?m)").replace("{", "{{").replace("}", "}}") for p in T.BOILERPLATE], "{0}")
_PRIORITY = "o_orderpriority <> '1-URGENT'"


def _reply_sql(reply: str, everywhere: bool) -> str:
    """b: the reply without fence; o: whether it is a JSON object."""
    lines = "list_filter(l, lambda x: NOT starts_with(x, '```'))" if everywhere else "CASE WHEN trim(l[-1], ' ' || chr(10)) = '```' THEN l[2:-2] ELSE l[2:] END"
    strip = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
    bare = strip.format("coalesce(reply, '')")
    return f"""s AS (SELECT c_custkey, {bare} AS t, string_split({bare}, chr(10)) AS l FROM (SELECT c_custkey, {reply} AS reply FROM customer)),
u AS (SELECT c_custkey, CASE WHEN starts_with(t, '```') THEN {strip.format(f"array_to_string({lines}, chr(10))")} ELSE t END AS b FROM s),
j AS (SELECT c_custkey, CASE WHEN json_valid(b) AND json_type(CASE WHEN json_valid(b) THEN b ELSE '0' END) = 'OBJECT' THEN b::JSON ELSE '{{{{}}}}'::JSON END AS j, json_valid(b) AND json_type(CASE WHEN json_valid(b) THEN b ELSE '0' END) = 'OBJECT' AS o FROM u)""".replace("{{}}", "{}")


def _field_sql(name: str, column: str, boost: float) -> str:
    """Scores of one field of part."""
    return f"""SELECT query_id, p_partkey, {boost} * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS s
FROM q JOIN (SELECT p_partkey, term, count(*) AS tf, any_value(dl) AS dl, count(*) OVER (PARTITION BY term) AS df FROM (SELECT p_partkey, unnest(w) AS term, len(w) AS dl FROM (SELECT p_partkey, regexp_extract_all(lower({column}), '[a-z0-9]+') AS w FROM part)) GROUP BY p_partkey, term) USING (term),
     (SELECT count(*) AS n, avg(len(regexp_extract_all(lower({column}), '[a-z0-9]+'))) AS avgdl FROM part) GROUP BY ALL"""


_PART_TOP = (
    "q AS (SELECT DISTINCT p_partkey AS query_id, unnest(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[a-z0-9]+')) AS term FROM part WHERE p_partkey % 20 = 0), "
    f"f AS ({_field_sql('text', 'p_type', 1.0)} UNION ALL {_field_sql('title', 'p_name', 3.0)} UNION ALL {_field_sql('derived_keywords', 'p_brand', 1.5)}), "
    "x AS (SELECT query_id, p_partkey, round(max(s), 6) AS score FROM f GROUP BY ALL), "
    "top AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_partkey)::INT AS rank, p_partkey, score FROM x QUALIFY rank <= 5)"
)

ORACLE_SQL = {
    "hybrid_bm25_topk": f"WITH {_bm25_sql(10)} SELECT * FROM top",
    "bm25_filtered": "WITH " + _bm25_sql(5, "lang = 'en'") + " SELECT * FROM top",
    "term_statistics": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY term",
    "field_statistics": f"SELECT 'text' AS field, count(*) AS n_docs, round(avg(n), 6) AS avgdl FROM (SELECT len({_WORDS}) AS n FROM documents) WHERE n > 0",
    "dense_cosine_topk": f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id, {_COS.format(a='q.e', b='c.e')} AS score FROM v q, v c WHERE q.vec_id % 100 = 0) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10",
    "ann_recall": "WITH q AS (SELECT count(*) FILTER (vec_id % 100 = 0) AS queries, count(*) AS n FROM embeddings) SELECT queries, (queries * least(n, 10))::BIGINT AS wanted, true AS recall_reached FROM q",
    "weighted_rrf": f"WITH {_POOL}, {_rrf_sql(0.8, 20)} SELECT * FROM t",
    "plain_rrf": f"WITH {_POOL}, {_rrf_sql(1.0, 20)} SELECT * FROM t",
    "candidate_counts": f"WITH {_POOL} SELECT r AS retriever_id, count(*) AS n FROM l GROUP BY r UNION ALL SELECT 'third', 0",
    "rerank_min_score": f"WITH {_POOL}, {_rrf_sql(1.0, 200)}, z AS (SELECT query_id, t.vec_id, pos AS old, {_COS.format(a='a.e', b='b.e')} AS rerank_score FROM t JOIN v a ON a.vec_id = query_id JOIN v b ON b.vec_id = t.vec_id WHERE pos <= 30), y AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, old)::INT AS pos, vec_id, rerank_score FROM z) SELECT * FROM y WHERE rerank_score >= 0.3",
    "context_blocks": f"WITH {_bm25_sql(3)}, c AS (SELECT item_id, coalesce(string_agg('[' || rank || '] ' || lang || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank), '') AS t, count(doc_id)::INT AS candidate_count, count(doc_id) = 0 AS is_empty FROM (SELECT item_id FROM benchmark) b LEFT JOIN top USING (item_id) LEFT JOIN documents USING (doc_id) GROUP BY item_id) SELECT item_id, md5(t) AS digest, length(t)::INT AS chars, candidate_count, is_empty FROM c",
    "parent_backfill": "WITH c AS (SELECT l_suppkey AS query_id, 'l-' || l_orderkey || '-' || l_linenumber AS chunk_id, 'o' || l_orderkey AS parent, max(l_extendedprice) AS s FROM lineitem GROUP BY ALL), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id)::INT AS pos FROM c QUALIFY pos <= 8), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent ORDER BY pos) AS nth FROM h) SELECT query_id, pos, CASE WHEN nth = 1 AND o_orderkey IS NOT NULL THEN parent ELSE chunk_id END AS chunk_id, CASE WHEN nth = 1 AND o_orderkey IS NOT NULL THEN o_orderpriority ELSE 'line' END AS o_orderpriority FROM n LEFT JOIN orders ON 'o' || o_orderkey = parent",
    "eval_items": f"WITH {_bm25_sql(10)}, {_GOLD} SELECT id, expected_empty, " + ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in ("recall_1", "recall_10", "precision_1", "precision_10", "ndcg_1", "ndcg_10", "mrr")) + " FROM x",
    "eval_report": f"WITH {_bm25_sql(10)}, {_GOLD} SELECT count(*) AS total_queries, count(*) FILTER (expected_empty) AS negative_total, count(*) FILTER (expected_empty AND n = 0) AS negative_correct_rejections, " + ", ".join(f"round(avg({c}) FILTER (NOT expected_empty), 6)::DOUBLE AS avg_{c}" for c in ("recall_10", "ndcg_10", "mrr")) + ", round(count(*) FILTER (expected_empty AND n = 0) / count(*) FILTER (expected_empty), 6)::DOUBLE AS negative_rejection_rate FROM x",
    "regression_gate": "WITH m AS (SELECT event_type AS metric, avg(value) FILTER (ts < '2024-01-16') AS b, coalesce(avg(value) FILTER (ts >= '2024-01-16'), 0) AS c FROM events GROUP BY 1) SELECT metric, round(b, 6) AS baseline, round(c, 6) AS current FROM m WHERE b - c > 0",
    "clean_documents": "WITH c AS (SELECT doc_id, coalesce(text, '') AS t, " + _PUNCT.format(_SPACES.format(_LINES.format(_HTML.format("coalesce(text, '')")))) + " AS u, " + _SPACES.format(_LINES.format(_HTML.format("coalesce(text, '')"))) + " AS s FROM documents) SELECT doc_id, md5(u) AS digest, (length(t) - length(u))::INT AS removed, length(t) <> length(s) OR length(s) <> length(u) AS changed FROM c",
    "strip_html": "SELECT page_id, md5(" + _HTML.format("html") + ") AS digest FROM pages",
    "query_normalisation": "SELECT conv_id, turn, md5(" + _STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), '\n+', ' ', 'g'), ' +', ' ', 'g')") + ") AS digest FROM conversations",
    "token_budget": "SELECT doc_id, ((length(text) + 2) // 3)::INT AS tokens, (length(text) + 2) // 3 <= 320 AS fits, md5(CASE WHEN (length(text) + 2) // 3 <= 320 THEN text ELSE left(text, 960) END) AS head, md5(CASE WHEN (length(text) + 2) // 3 <= 40 THEN text ELSE right(text, 120) END) AS tail FROM documents",
    "identities": "WITH k AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), c AS (SELECT *, substr(sha1(l_orderkey || ':2:' || l_linenumber), 1, 16) AS chunk_id FROM k), u AS (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || chunk_id::BLOB) AS h FROM c) SELECT l_orderkey, l_linenumber, chunk_id, substr(sha1(chunk_id || ':sub:0'), 1, 16) AS sub_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id, l_orderkey || '::2024-01-01' AS review_id FROM u",
    "versions_text": "SELECT p_brand, string_agg(p_partkey || '=' || p_size, ',' ORDER BY p_partkey::VARCHAR) AS versions FROM part GROUP BY p_brand",
    "unit_vectors": "WITH v AS (SELECT vec_id, [x * 3 for x in embedding::DOUBLE[]] AS e FROM embeddings) SELECT vec_id, 1.0::DOUBLE AS length, round(e[1] / sqrt(list_inner_product(e, e)), 6) AS first FROM v",
    "upsert_orders": "SELECT o_orderkey, o_orderstatus, round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS o_totalprice FROM orders",
    "reconcile_counts": f"WITH s AS (SELECT {_PRIORITY} AS a, o_orderstatus <> 'P' AS b, o_orderstatus = 'P' AND o_orderpriority = '5-LOW' AS w FROM orders) SELECT count(*) FILTER (a AND NOT b) AS lexical_only, count(*) FILTER (b AND NOT a) AS vector_only, count(*) FILTER (a AND b) AS in_sync, count(*) FILTER (a <> b AND NOT w) AS newly_recorded, count(*) FILTER (a <> b AND w) AS already_pending FROM s",
    "reconcile_drift": f"SELECT o_orderkey::VARCHAR AS chunk_id, o_custkey::VARCHAR AS doc_id, CASE WHEN {_PRIORITY} THEN 'qdrant_write' ELSE 'es_write' END AS failure_mode, 'detected by reconciliation: missing from the ' || CASE WHEN {_PRIORITY} THEN 'vector' ELSE 'lexical' END || ' table' AS error_msg FROM orders WHERE ({_PRIORITY}) <> (o_orderstatus <> 'P') AND NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')",
    "retry_outcomes": f"SELECT NOT ({_PRIORITY}) AS resolved, count(*) AS n FROM orders WHERE ({_PRIORITY}) <> (o_orderstatus <> 'P') AND NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW') GROUP BY 1",
    "indexed_by_document": "WITH c AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, min(l_suppkey) AS doc_id, bool_or(l_discount > 0.09 OR l_tax > 0.07) AS bad FROM lineitem GROUP BY 1) SELECT doc_id, count(*) FILTER (NOT bad) AS indexed, count(*) FILTER (bad) AS failed FROM c GROUP BY doc_id",
    "failure_modes": "SELECT CASE WHEN l_discount > 0.09 AND l_tax > 0.07 THEN 'both' WHEN l_discount > 0.09 THEN 'es_write' ELSE 'qdrant_write' END AS failure_mode, concat_ws('; ', CASE WHEN l_discount > 0.09 THEN 'lexical' END, CASE WHEN l_tax > 0.07 THEN 'vector' END) AS error_msg, count(*) AS n FROM lineitem WHERE l_discount > 0.09 OR l_tax > 0.07 GROUP BY ALL",
    "pending_documents": "WITH t AS (SELECT l_suppkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, doc_id LIMIT 80) SELECT doc_id FROM t WHERE doc_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) ORDER BY doc_id LIMIT 20",
    "latest_reviews": "SELECT o_custkey AS doc_id, o_orderkey AS review_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "audit_prompts": "SELECT role AS doc_id, CASE WHEN conv_id % 3 > 0 THEN 'c' || conv_id ELSE 'root:' || conv_id || '-' || turn END AS group_key, 'parent_id_fallback' AS grouping_type, min(turn) AS position, count(*)::INT AS n, md5(left(string_agg('[' || conv_id || '-' || turn || '] ' || left(text, 800), chr(10) ORDER BY turn), 4000)) AS digest FROM conversations GROUP BY ALL",
    "ungroupable_chunks": "SELECT o_custkey AS doc_id, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN count(*) FILTER (o_orderstatus <> 'F') ELSE 0 END AS skipped FROM orders GROUP BY 1",
    "date_filter": "SELECT event_id, event_type, round(value, 6) AS value FROM events WHERE event_type = 'click' AND ts BETWEEN '2024-01-05' AND '2024-01-12'",
    "daily_events": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "audit_verdicts": f"WITH {_reply_sql(_AUDIT_REPLY, True)}, v AS (SELECT c_custkey, j, o AND coalesce(j->>'verdict' IN ('ok', 'should_merge', 'should_split', 'boundary_issue'), false) AS k FROM j) SELECT c_custkey, CASE WHEN k THEN j->>'verdict' ELSE 'audit_failed' END AS verdict, CASE WHEN k AND j->>'confidence' IN ('high', 'medium', 'low') THEN j->>'confidence' END AS confidence, CASE WHEN k THEN coalesce(nullif(trim(j->>'reason'), ''), '（LLM 未提供 reason）') END AS reason, CASE WHEN k AND json_type(j->'affected_chunk_ids') = 'ARRAY' THEN array_to_string(list_filter((j->'affected_chunk_ids')::VARCHAR[], lambda x: x IN ('a', 'b')), ',') ELSE '' END AS affected FROM v",
    "self_evaluations": f"WITH {_reply_sql(_EVAL_REPLY, False)}, p AS (SELECT *, CASE WHEN json_type(j->'sub_queries') = 'ARRAY' THEN list_filter([trim(x->>'$') for x in (j->'sub_queries')::JSON[] if json_type(x) = 'VARCHAR'], lambda x: x <> '')[1:2] ELSE [] END AS subs, coalesce(json_type(j->'sufficient') = 'BOOLEAN', false) AS b FROM j), e AS (SELECT *, b AND coalesce(json_type(j->'confidence') = 'VARCHAR' AND j->>'confidence' IN ('high', 'medium', 'low') AND json_type(j->'missing_aspects') = 'VARCHAR' AND json_type(j->'sub_queries') = 'ARRAY', false) AND (j->>'sufficient' = 'true' OR len(subs) > 0) AS k FROM p) SELECT c_custkey, NOT k OR j->>'sufficient' = 'true' AS sufficient, CASE WHEN k THEN j->>'confidence' ELSE 'low' END AS confidence, CASE WHEN k THEN j->>'missing_aspects' ELSE '' END AS missing, CASE WHEN k AND j->>'sufficient' = 'false' THEN array_to_string(subs, '|') ELSE '' END AS sub_queries, k AND j->>'sufficient' = 'true' AND trim(j->>'missing_aspects') = 'TOPIC_ABSENT' AS topic_absent, k AND j->>'sufficient' = 'true' AND trim(j->>'missing_aspects') = 'FACTUAL_NEGATION' AS factual_negation FROM e",
    "enhancement_replies": f"WITH {_reply_sql(_ENHANCED_REPLY, True)}, k AS (SELECT *, o AND coalesce(json_type(j->'summary') IN ('VARCHAR', 'ARRAY') AND json_type(j->'keywords') = 'ARRAY', false) AS k FROM j) SELECT c_custkey, k AS fine, CASE WHEN k THEN trim(CASE WHEN json_type(j->'summary') = 'ARRAY' THEN array_to_string((j->'summary')::VARCHAR[], ' ') ELSE j->>'summary' END) END AS summary, CASE WHEN k THEN array_to_string((j->'keywords')::VARCHAR[], '|') END AS keywords FROM k",
    "rerank_by_index": f"WITH {_POOL}, {_rrf_sql(1.0, 20)}, hd AS (SELECT *, query_id // 100 % 3 AS m, round(rrf * ((pos * 7) % 11), 9) AS z FROM t WHERE pos <= 10) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN m <> 1 THEN z END DESC NULLS LAST, pos)::INT AS pos, vec_id, m <> 1 AS reranked, CASE WHEN m <> 1 THEN z END AS rerank_score FROM hd WHERE m <> 2 OR pos <= 7",
    "round_merge": f"WITH {_POOL}, one AS (SELECT query_id, vec_id, CASE r WHEN 'first' THEN 1 ELSE 2 END AS round, rank AS pos, round(1.0::DOUBLE / (60 + rank), 9) AS rrf, s FROM l WHERE rank <= 30), m AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY query_id, vec_id ORDER BY round) = 1) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, s DESC, round, pos)::INT AS pos, vec_id, rrf AS rrf_score, (SELECT count(*) FROM l)::BIGINT AS candidates FROM m",
    "discovered_words": f"WITH r AS (SELECT lower(replace(p_name || p_type, ' ', '')) AS s FROM part), g AS (SELECT gram, count(*) AS n FROM (SELECT s[i:i + k - 1] AS gram FROM r, range(1, {_LONGEST + 2}) a(k), range(1, 100) b(i) WHERE i + k - 1 <= length(s)) GROUP BY gram), t AS (SELECT sum(n) AS total FROM g WHERE length(gram) = 1), w AS (SELECT gram AS word, n FROM g WHERE length(gram) BETWEEN 2 AND {_LONGEST} AND n >= 5), c AS (SELECT word, w.n, min(ln(w.n * total / a.n / b.n)) AS cohesion FROM w, range(1, {_LONGEST}) k(k), g a, g b, t WHERE k < length(word) AND a.gram = left(word, k) AND b.gram = substr(word, k + 1) GROUP BY word, w.n), f AS (SELECT word, c.n, cohesion, ln(c.n) - coalesce((SELECT sum(g.n * ln(g.n)) FROM g WHERE length(gram) >= 3 AND left(gram, length(gram) - 1) = word), 0) / c.n AS x, ln(c.n) - coalesce((SELECT sum(g.n * ln(g.n)) FROM g WHERE length(gram) >= 3 AND substr(gram, 2) = word), 0) / c.n AS y FROM c WHERE cohesion >= 1.0) SELECT word, n, round(cohesion, 6) AS cohesion, round(least(x, y), 6) AS freedom FROM f WHERE least(x, y) >= 0.5",
    "segmented_parts": "WITH d AS (SELECT DISTINCT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part), p AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS coarse, lower(replace(p_name || p_type, ' ', '')) AS s FROM part) SELECT p_partkey, coarse, sum(len(list_filter(range(1, length(s) + 1), lambda i: s[i:i + length(w) - 1] = w)))::INT AS n_fine FROM p, d GROUP BY ALL",
    "bm25_multi_field": f"WITH {_PART_TOP} SELECT * FROM top",
    "highlights": f"WITH {_PART_TOP}, h AS (SELECT query_id, t.p_partkey, p.p_name, list_intersect(regexp_extract_all(lower(p.p_name), '[a-z0-9]+'), regexp_extract_all(lower(o.p_name), '[a-z0-9]+')) AS w FROM top t JOIN part p USING (p_partkey) JOIN part o ON o.p_partkey = query_id) SELECT query_id, p_partkey, CASE WHEN len(w) > 0 THEN regexp_replace(p_name, '(?i)\\b(' || array_to_string(w, '|') || ')\\b', '<em>\\1</em>', 'g') END AS highlight FROM h",
    "html_tree_text": "WITH t AS (SELECT page_id, " + _TREE.format("html") + " AS t FROM pages) SELECT page_id, md5(" + _PUNCT.format(_SPACES.format("t")) + ") AS digest, length(t)::INT AS chars FROM t",
    "encoding_repair": "SELECT doc_id, md5(text) AS digest, doc_id % 3 < 2 AND regexp_matches(text, '[^\\x00-\\x7F]') AS repaired FROM documents",
    "quarantine_outcomes": "SELECT source, CASE WHEN text IS NULL OR doc_id IS NULL THEN 'validate' WHEN contains(text, 'AKIA') THEN 'embed' END AS stage, CASE WHEN text IS NULL OR doc_id IS NULL THEN 'no id or no text' WHEN contains(text, 'AKIA') THEN 'refused' END AS error_msg, count(*) AS n FROM documents GROUP BY ALL",
    "deletion_counts": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS deleted, count(*) FILTER (o_orderstatus <> 'F') AS kept FROM orders GROUP BY 1",
}
ORACLE_SQL["digest_drift"] = ORACLE_SQL["reconcile_drift"]
