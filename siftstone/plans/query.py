"""The query pipeline for a batch of queries: preprocess, retrieve, fuse, rerank, filter, build context, answer.

Models are callables on lists of texts, run in Arrow batches; each has a deterministic default, so a plan needs no network.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions import text as T
from siftstone.operators import ann, dense, fusion, lexical, replies
from siftstone.operators.lexical import Filters
from siftstone.plans.config import Ladder
from siftstone.sources.tables import materialised

#: Fixed value: the answer where nothing was found.
NO_ANSWER = "根据现有资料无法回答该问题"
MAX_REWRITE = 500


def overlap_scorer(queries: list[str], texts: list[str]) -> list[float]:
    """Share of the query's distinct words that stand in the text."""
    out = []
    for q, t in zip(queries, texts):
        words, there = set((q or "").lower().split()), set((t or "").lower().split())
        out.append(len(words & there) / len(words) if words else 0.0)
    return out


def first_block_answer(queries: list[str], contexts: list[str]) -> list[str]:
    return [c.split(fusion.BLOCK_DELIMITER)[0] for c in contexts]


@dataclass(frozen=True)
class Models:
    """rewrite(queries) -> queries or None each; embed[retriever_id](texts) -> vectors; score(queries, texts) -> numbers; answer(queries, contexts) -> texts."""

    rewrite: Callable | None = None
    embed: dict[str, tuple[Callable, int]] = field(default_factory=dict)
    score: Callable | None = overlap_scorer
    answer: Callable = first_block_answer


@dataclass(frozen=True)
class Corpus:
    """The tables that a query reads: chunks, the postings index, by vector name (chunk_id, vector), and by vector name the index that retrievers of the engine "approximate" ask."""

    chunks: DataFrame
    index: DataFrame
    vectors: dict[str, DataFrame] = field(default_factory=dict)
    approximate: dict[str, ann.AnnIndex] = field(default_factory=dict)
    #: What cuts queries into terms as the postings were cut, or more coarsely.
    query_tokens: Callable = T.lexical_tokens


def _model(function: Callable, kind: str):
    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(function(list(a), list(b)))

    return run


def _safe(function: Callable, kind: str):
    """_model() that gives nulls for a batch on which the model fails."""

    def run(a: list, b: list) -> list:
        try:
            return function(a, b)
        except Exception:  # noqa: BLE001  a model may fail in any way; the rules for replies decide
            return [None] * len(a)

    return _model(run, kind)


def preprocess(queries: DataFrame, rewrite: Callable | None = None, query: str = "query") -> DataFrame:
    """queries with normalized, rewritten, rewrite_used and effective. Blank queries and rewrites that fail, are blank, too long or equal are not used."""
    df = queries.withColumn("normalized", T.normalize_query(F.col(query)))
    if rewrite is None:
        df = df.withColumn("rewritten", F.lit(None).cast("string"))
    else:

        @F.pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                try:
                    yield pd.Series(rewrite(list(s)), dtype="object")
                except Exception:  # noqa: BLE001  the model may fail in any way; the query goes on as it is
                    yield pd.Series([None] * len(s), dtype="object")

        df = df.withColumn("rewritten", F.when(F.length("normalized") > 0, T.strip(run("normalized"))))
    used = F.col("rewritten").isNotNull() & (F.length("rewritten") > 0) & (F.length("rewritten") <= MAX_REWRITE) & (F.col("rewritten") != F.col("normalized"))
    return df.withColumn("rewrite_used", F.coalesce(used, F.lit(False))).withColumn("effective", T.effective_query(F.col("rewritten"), F.col("normalized"), F.col("rewrite_used")))


def echoed(queries: DataFrame, filters: Filters, business_type: str | None = None) -> DataFrame:
    """preprocess()'s rows with filters, a map of the filters that hold for them."""
    held = filters.bound_to(business_type).echo()
    return queries.withColumn("filters", F.create_map(*[F.lit(str(x)) for pair in held.items() for x in pair]) if held else F.create_map().cast("map<string,string>"))


def retrieve(queries: DataFrame, corpus: Corpus, retrievers: list, models: Models, filters: Filters, top_k: int | None) -> DataFrame:
    """The pool of all retrievers' lists; top_k overrides theirs. One that fails gives no rows, one of an unsupported type is skipped with a warning."""
    asked = queries.select("query_id", F.col("effective").alias("query")).where(F.length("query") > 0)
    allowed = None if filters.is_empty else filters.apply(corpus.chunks).select("chunk_id")
    supported = [r for r in retrievers if r.type in ("lexical", "elasticsearch", "dense", "qdrant")]
    for r in retrievers:
        if r not in supported:
            logging.getLogger(__name__).warning("retriever %s is skipped: its type %r isn't supported", r.id, r.type)
    if not supported:
        raise ValueError("no retriever of a supported type is configured")
    lists = []
    for r in supported:
        k = top_k or r.top_k
        if r.type in ("lexical", "elasticsearch"):
            found = fusion.isolated(lambda k=k: lexical.bm25_topk(corpus.index, asked, k, allowed=allowed, digits=6, tokens=corpus.query_tokens))
            lists.append((r.id, "lexical", found))
        else:

            def search(r=r, k=k):
                vectors = corpus.vectors[r.vector_name]
                if allowed is not None:
                    vectors = vectors.join(allowed, "chunk_id", "left_semi")
                if r.id not in models.embed:
                    raise ValueError(f"retriever {r.id} has no embedding model; there are models for {sorted(models.embed)}")
                provider, dimension = models.embed[r.id]
                # The index knows no filters: with filters the search is exact.
                if r.engine == "approximate" and allowed is None and r.vector_name in corpus.approximate:
                    return ann.search(corpus.approximate[r.vector_name], dense.embed(asked, provider, dimension, "query"), k)
                return dense.cosine_topk(vectors, dense.embed(asked, provider, dimension, "query"), k)

            lists.append((r.id, "dense", fusion.isolated(search)))
    none = corpus.chunks.select(F.lit(0).alias("rank"), "chunk_id", F.lit(0.0).alias("score")).limit(0)
    return fusion.pool(lists, asked.select("query_id").limit(0).join(none, F.lit(True), "left"))


def scored(head: DataFrame, queries: DataFrame, chunks: DataFrame, score: Callable | None) -> DataFrame | None:
    """(query_id, pos, rerank_score), or None where the model fails."""
    if score is None:
        return None
    pairs = head.select("query_id", "pos", "chunk_id").join(chunks.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", "effective"), "query_id")
    return fusion.isolated(lambda: pairs.select("query_id", "pos", F.round(_model(score, "double")("effective", "text"), 6).alias("rerank_score")))


def search(queries: DataFrame, corpus: Corpus, retrievers: list, models: Models = Models(), filters: Filters = Filters(), ladder: Ladder = Ladder(), weights: dict | None = None, fusion_k: int = 60, rerank_enabled: bool = True, min_score: float | None = None) -> DataFrame:
    """Candidates in final order with all their scores; queries come from preprocess()."""
    pooled = retrieve(queries, corpus, retrievers, models, filters, ladder.recall_top_k)
    fused = fusion.fuse(pooled, fusion_k, weights, ladder.rrf_pool_k)
    head = fused.where(F.col("pos") <= ladder.rerank_top_k)
    ranked = fusion.rerank(fused, scored(head, queries, corpus.chunks, models.score) if rerank_enabled else None, ladder.rerank_top_k, rerank_enabled)
    found = fusion.at_least(ranked, min_score)
    marked = lexical.with_highlights(found, queries.select("query_id", F.col("effective").alias("query")), corpus.chunks)
    # Only lexical hits have fragments.
    return marked.withColumn("highlight", F.when(F.col("bm25_score").isNotNull(), F.col("highlight")))


def answers(queries: DataFrame, context: DataFrame, answer: Callable, query: str = "effective") -> DataFrame:
    """(query_id, answer, grounded, citations, context_text): an empty context gives the fixed answer and asks no model."""
    joined = queries.select("query_id", query).join(context, "query_id")
    full = joined.where("NOT is_empty").select("query_id", _model(answer, "string")(query, "context_text").alias("answer"), F.lit(True).alias("grounded"), "citations", "context_text")
    empty = joined.where("is_empty").select("query_id", F.lit(NO_ANSWER).alias("answer"), F.lit(False).alias("grounded"), "citations", "context_text")
    return full.unionByName(empty)


def run(queries: DataFrame, corpus: Corpus, retrievers: list, models: Models = Models(), **options) -> DataFrame:
    """The whole pipeline for queries (query_id, query). top_k, a dict of the ladder's steps, overrides these for this run."""
    asked = preprocess(queries, models.rewrite)
    ladder = with_ladder(options.pop("ladder", Ladder()), **options.pop("top_k", None) or {})
    options["ladder"] = ladder
    found = search(asked, corpus, retrievers, models, **options)
    chosen = fusion.backfilled(found, lexical.projected(corpus.chunks), ladder.context_top_k)
    return answers(asked, fusion.build_context(chosen, asked), models.answer)


# --- a second round ------------------------------------------------------------------------------------------------


def self_evaluation(said: DataFrame, reply: str = "reply") -> DataFrame:
    """(query_id, sufficient, confidence, missing, sub_queries, topic_absent, factual_negation) of each reply."""
    read = said.select("query_id", replies.self_evaluation(F.col(reply)).alias("e"))
    absent, negated = (replies.says(F.col("e"), s) for s in (replies.TOPIC_ABSENT, replies.FACTUAL_NEGATION))
    return read.select("query_id", "e.sufficient", "e.confidence", "e.missing", "e.sub_queries", absent.alias("topic_absent"), negated.alias("factual_negation"))


def iterate(queries: DataFrame, corpus: Corpus, retrievers: list, evaluate: Callable, models: Models = Models(), **options) -> DataFrame:
    """run() with a second round for queries whose first answer evaluate(queries, answers with their citations) finds lacking:
    (query_id, answer, grounded, citations, context_text, iterations, and what self_evaluation() gives).

    The sub-queries of all such queries are one batch; their candidates join those of the first round, each chunk once.
    A sufficient reply that names the topic absent, or the fact denied, clears the citations and gives the fixed answer. A model that fails leaves the first round.
    """
    asked = materialised(preprocess(queries, models.rewrite), "asked")
    ladder = options.get("ladder", Ladder())
    first = materialised(search(asked, corpus, retrievers, models, **options), "first-round")
    answered = materialised(answers(asked, fusion.build_context(fusion.backfilled(first, lexical.projected(corpus.chunks), ladder.context_top_k), asked), models.answer), "first-answers")
    shown = F.concat_ws("\n", "answer", fusion.citation_summary(F.coalesce("citations", F.array())))
    said = answered.join(asked.select("query_id", "effective"), "query_id").select("query_id", _safe(evaluate, "string")("effective", shown).alias("reply"))
    verdict = materialised(self_evaluation(said), "verdict")
    more = verdict.where("NOT sufficient").select("query_id", F.posexplode("sub_queries").alias("n", "query"))
    subs = preprocess(more.select(F.concat_ws("#", F.col("query_id").cast("string"), F.col("n").cast("string")).alias("query_id"), "query", F.col("query_id").alias("of")))
    second = search(subs, corpus, retrievers, models, **options).join(subs.select("query_id", "of"), "query_id").drop("query_id").withColumnRenamed("of", "query_id")
    again = asked.join(verdict.where("NOT sufficient").select("query_id"), "query_id", "left_semi")
    both = fusion.merge_rounds(first, second).join(again.select("query_id"), "query_id", "left_semi")
    renewed = answers(again, fusion.build_context(fusion.backfilled(both, lexical.projected(corpus.chunks), ladder.context_top_k), again), models.answer)
    kept = answered.join(verdict.where("sufficient").select("query_id"), "query_id", "left_semi")
    out = kept.unionByName(renewed).join(verdict, "query_id")
    cleared = F.col("topic_absent") | F.col("factual_negation")
    return out.select(
        "query_id", F.when(cleared, F.lit(NO_ANSWER)).otherwise(F.col("answer")).alias("answer"), (F.col("grounded") & ~cleared).alias("grounded"), F.when(~cleared, F.col("citations")).alias("citations"),
        F.when(cleared, F.lit("")).otherwise(F.col("context_text")).alias("context_text"), F.when(F.col("sufficient"), 1).otherwise(2).alias("iterations"), *verdict.columns[1:],
    )


def with_ladder(ladder: Ladder, **top_k: int | None) -> Ladder:
    """The ladder with the given steps replaced."""
    return replace(ladder, **{k: v for k, v in top_k.items() if v is not None})
