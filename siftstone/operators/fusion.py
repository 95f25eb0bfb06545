"""From ranked lists to the answer's context: pool, fusion, reranking, score filter, context and citations.

Every table carries query_id, so a batch of queries is one plan. A hit is (query_id, retriever_id, ord, rank, chunk_id, score).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_DELIMITER = "\n\n---\n\n"
CITATION_EXTRAS = ("text", "category", "created_time", "author", "config_version", "hierarchy_level", "position", "parent_id")


def pool(lists: list[tuple[str, str, DataFrame | None]], like: DataFrame | None = None) -> DataFrame:
    """The retrievers' lists [(retriever_id, kind, (query_id, rank, chunk_id, score))] in the order of configuration; a failed one is None and gives no rows.

    Where all failed the pool is empty, with the columns' types of `like`. Only a configuration without retrievers is an error.
    """
    if not lists:
        raise ValueError("there are no retrievers")
    there = [(n, r, kind, df) for n, (r, kind, df) in enumerate(lists) if df is not None]
    if not there:
        none = SparkSession.active().createDataFrame([], "query_id string, rank int, chunk_id string, score double") if like is None else like.limit(0)
        there = [(n, r, kind, none) for n, (r, kind, _) in enumerate(lists)]
    return reduce(DataFrame.unionByName, [df.select("query_id", F.lit(r).alias("retriever_id"), F.lit(kind).alias("kind"), F.lit(n).alias("ord"), "rank", "chunk_id", "score") for n, r, kind, df in there])


def isolated(build) -> DataFrame | None:
    """build()'s table, materialised, or None where building or running it fails: the failure of one retriever leaves the others."""
    try:
        from siftstone.sources.tables import materialised

        return materialised(build(), "retriever")
    except Exception:  # noqa: BLE001  a retriever may fail in any way
        return None


def candidate_counts(pooled: DataFrame, retrievers: list[str]) -> DataFrame:
    """(retriever_id, n) with zeros."""
    every = pooled.sparkSession.createDataFrame([(r,) for r in retrievers], "retriever_id string")
    return every.join(pooled.groupBy("retriever_id").agg(F.count("*").alias("n")), "retriever_id", "left").select("retriever_id", F.coalesce("n", F.lit(0)).alias("n"))


def counts_over_rounds(*rounds: DataFrame) -> DataFrame:
    """(retriever_id, n): sums of the rounds' candidate counts."""
    return reduce(DataFrame.unionByName, rounds).groupBy("retriever_id").agg(F.sum("n").alias("n"))


def fuse(pooled: DataFrame, k: int = 60, weights: dict[str, float] | None = None, pool_top_k: int = 200, digits: int | None = 9) -> DataFrame:
    """Weighted reciprocal-rank fusion: each chunk's sum of weight / (k + rank), 1 for retrievers without a weight.

    A chunk met by several retrievers is one row; bm25_score is that of the first lexical list that has it, dense_scores and
    rank_in_retriever are maps by retriever. Equal sums keep the order of first meeting. Pass weights=None for plain fusion.
    """
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("retriever_id") == name, F.lit(float(w))).otherwise(weight)
    of = lambda value, kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "retriever_id", value))))
    total = F.sum(weight / (k + F.col("rank")))
    merged = pooled.groupBy("query_id", "chunk_id").agg(
        (F.round(total, digits) if digits else total).alias("rrf_score"),
        F.min(F.struct("ord", "rank")).alias("met"),
        F.get(of("score", "lexical"), F.lit(0))["score"].alias("bm25_score"),
        F.map_from_entries(F.transform(of("score", "dense"), lambda s: F.struct(s["retriever_id"], s["score"]))).alias("dense_scores"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("retriever_id", "rank")))).alias("rank_in_retriever"),
        F.array_sort(F.collect_set("retriever_id")).alias("source_retriever_ids"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "met", "chunk_id")
    return merged.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= pool_top_k).drop("met")


def rerank(fused: DataFrame, scores: DataFrame | None, top_k: int = 50, enabled: bool = True) -> DataFrame:
    """fused with rerank_score, reranked, degradation_reason and pos in the new order.

    scores: (query_id, pos, rerank_score) for the first top_k. A query whose scores are missing, not as many as candidates, or all out of
    range keeps the fusion order of its first top_k, flagged; else scores out of range are dropped, and candidates that no score names with them. Switched off, the whole pool stays.
    """
    none = F.lit(None).cast("double")
    if not enabled:
        return fused.select("*", none.alias("rerank_score"), F.lit(False).alias("reranked"), F.lit("reranker disabled").alias("degradation_reason"))
    head = fused.where(F.col("pos") <= top_k)
    if scores is None:
        return head.select("*", none.alias("rerank_score"), F.lit(False).alias("reranked"), F.lit("reranker failed").alias("degradation_reason"))
    per_query = Window.partitionBy("query_id")
    given = scores.groupBy("query_id").agg(F.count("*").alias("_given"))
    joined = head.join(scores.select("query_id", "pos", "rerank_score", F.lit(True).alias("_named")), ["query_id", "pos"], "left").join(given, "query_id", "left")
    joined = joined.withColumn("_n", F.size(F.collect_set("pos").over(per_query))).withColumn("_some", F.max("_named").over(per_query))
    as_many = F.coalesce(F.col("_given") == F.col("_n"), F.lit(False))
    joined = joined.withColumn("reranked", as_many & F.coalesce("_some", F.lit(False))).withColumn("rerank_score", F.when(F.col("reranked"), F.col("rerank_score")))
    reason = F.when(F.col("reranked"), F.lit(None).cast("string")).when(as_many, F.lit("no score in range")).otherwise(F.lit("score count mismatch"))
    order = per_query.orderBy(F.desc_nulls_last("rerank_score"), "pos")
    kept = joined.withColumn("degradation_reason", reason).where(~F.col("reranked") | F.coalesce("_named", F.lit(False)))
    return kept.withColumn("pos", F.row_number().over(order)).drop("_given", "_n", "_some", "_named")


def at_least(candidates: DataFrame, min_score: float | None) -> DataFrame:
    """Candidates of min_score and more; those that weren't reranked pass. 0.0 is a score."""
    return candidates if min_score is None else candidates.where(~F.col("reranked") | (F.col("rerank_score") >= min_score))


def backfilled(candidates: DataFrame, chunks: DataFrame, top_k: int = 8) -> DataFrame:
    """The first top_k candidates, a child replaced by its parent where that isn't among them and exists.

    One left join looks up all parents. Of several children of one parent the first gives way. Scores stay the child's.
    """
    head = candidates.where(F.col("pos") <= top_k).join(chunks, "chunk_id", "left")
    in_query = Window.partitionBy("query_id")
    head = head.withColumn("_there", F.array_contains(F.collect_set("chunk_id").over(in_query), F.col("parent_id")))
    parent = chunks.select(*[F.col(c).alias(f"_p_{c}") for c in chunks.columns])
    found = head.join(parent, (F.col("parent_id") == F.col("_p_chunk_id")) & ~F.coalesce("_there", F.lit(False)), "left")
    nth = F.row_number().over(Window.partitionBy("query_id", "_p_chunk_id").orderBy("pos"))
    swap = F.col("_p_chunk_id").isNotNull() & (F.col("_nth") == 1)
    found = found.withColumn("_nth", nth)
    rest = [c for c in candidates.columns if c != "chunk_id"]
    return found.select(*rest, *[F.when(swap, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) for c in chunks.columns])


def keep_first(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """Of rows with equal keys the first in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def build_context(candidates: DataFrame, queries: DataFrame, with_scores: bool = False) -> DataFrame:
    """(query_id, context_text, citations, is_empty, candidate_count) for every query; columns that candidates lack count as absent."""
    rows = keep_first(candidates, ["query_id", "chunk_id"], "pos")
    rows = rows.withColumn("index", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))
    have = set(rows.columns)
    text_or = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    title = F.coalesce(F.nullif(text_or("title"), F.lit("")), F.col("doc_id").cast("string"))
    block = F.concat(F.format_string("[%d] ", F.col("index")), title, F.lit("\n"), text_or("text"))
    if with_scores:
        part = lambda name, c: F.when(F.col(c).isNotNull(), F.format_string(f"{name}=%.4f", F.col(c)))
        parts = F.concat_ws(", ", *[part(n, c) for n, c in (("rerank", "rerank_score"), ("rrf", "rrf_score")) if c in have])
        block = F.when(F.length(parts) > 0, F.concat(block, F.lit("\n("), parts, F.lit(")"))).otherwise(block)
    extras = F.map_filter(F.create_map(*[x for c in CITATION_EXTRAS if c in have for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull())
    scores = [F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in ("bm25_score", "rrf_score", "rerank_score")]
    highlight = (F.col("highlight") if "highlight" in have else F.lit(None).cast("array<string>")).alias("highlight")
    citation = F.struct("index", "chunk_id", F.col("doc_id"), text_or("title").alias("title"), text_or("source").alias("source"), *scores, highlight, extras.alias("extra"))
    # At most top_k rows a query are collected.
    built = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("index", block.alias("block")))).alias("b"), F.array_sort(F.collect_list(F.struct("index", citation.alias("c"))), lambda x, y: x["index"] - y["index"]).alias("c"))
    built = built.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), BLOCK_DELIMITER).alias("context_text"), F.transform("c", lambda x: x["c"]).alias("citations"))
    joined = queries.select("query_id").join(built, "query_id", "left")
    n = F.coalesce(F.size("citations"), F.lit(0))
    empty = F.col("citations").isNull()
    return joined.select("query_id", F.coalesce("context_text", F.lit("")).alias("context_text"), "citations", empty.alias("is_empty"), F.when(empty, 0).otherwise(n).alias("candidate_count"))


def citation_summary(citations: Column, most: int = 8) -> Column:
    """A line for each of the first citations; "(no citations)" where there are none."""
    line = lambda c: F.concat(F.format_string("[%d] ", c["index"]), F.coalesce(F.nullif(c["title"], F.lit("")), c["doc_id"].cast("string")), F.lit(" ("), c["doc_id"].cast("string"), F.lit(")"))
    return F.when(F.coalesce(F.size(citations), F.lit(0)) > 0, F.array_join(F.transform(F.slice(citations, 1, most), line), "\n")).otherwise("(no citations)")


def merge_rounds(first: DataFrame, second: DataFrame) -> DataFrame:
    """Candidates of two rounds, each chunk once as first met, ordered by (rerank, rrf, dense) with missing scores last. The dense score that decides ties is the last retriever's."""
    both = first.withColumn("_round", F.lit(1)).unionByName(second.withColumn("_round", F.lit(2)), allowMissingColumns=True)
    once = keep_first(both, ["query_id", "chunk_id"], F.struct("_round", "pos"))
    dense = F.try_element_at(F.map_values("dense_scores"), F.lit(-1)) if "dense_scores" in once.columns else F.lit(None).cast("double")
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), F.desc_nulls_last("rrf_score"), F.desc_nulls_last("_dense"), "_round", "pos")
    return once.withColumn("_dense", dense).withColumn("_new", F.row_number().over(w)).drop("pos", "_dense", "_round").withColumnRenamed("_new", "pos")
