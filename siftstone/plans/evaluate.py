"""Evaluation of ranked answers against a golden set, and the regression check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions import values as V
from siftstone.plans import query
from siftstone.sources.tables import materialised

K_VALUES = (1, 3, 5, 10)


def item_results(golden: DataFrame, retrieved: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    """A row for each golden item (id, relevant_doc_ids, expected_empty) with its metrics; retrieved: (id, rank, doc_id[, success, latency_ms]).

    A document counts once, where it comes first. Items without an answer have an empty list.
    """
    first = retrieved.groupBy("id", "doc_id").agg(F.min("rank").alias("rank"))
    lists = first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("retrieved"))
    rows = golden.join(lists, "id", "left")
    got = F.coalesce("retrieved", F.array().cast(golden.schema["relevant_doc_ids"].dataType))
    rows = rows.withColumn("retrieved", got)
    rel = F.col("relevant_doc_ids")
    for k in sorted(k_values):
        rows = rows.withColumn(f"recall_{k}", V.recall_at(F.col("retrieved"), rel, k)).withColumn(f"precision_{k}", V.precision_at(F.col("retrieved"), rel, k)).withColumn(f"ndcg_{k}", V.ndcg_at(F.col("retrieved"), rel, k))
    return rows.withColumn("mrr", V.reciprocal_rank(F.col("retrieved"), rel, max(k_values))).withColumn("negative_score", F.when(F.col("expected_empty"), V.rejection(F.col("retrieved"))))


def report(items: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    """One row: averages over answered positives, latency over all, and the share of negatives that were rejected."""
    success = F.col("success") if "success" in items.columns else F.lit(True)
    positive, negative = success & ~F.col("expected_empty"), success & F.col("expected_empty")
    mean = lambda c: F.coalesce(F.avg(F.when(positive, F.col(c))), F.lit(0.0)).alias(f"avg_{c}")
    named = [f"{m}_{k}" for m in ("recall", "precision", "ndcg") for k in sorted(k_values)]
    latency = [F.avg("latency_ms").alias("avg_latency_ms")] if "latency_ms" in items.columns else []
    rejected = F.count_if(negative & (F.col("negative_score") == 1))
    return items.agg(
        F.count("*").alias("total_queries"), F.count_if(success).alias("successful_queries"), *[mean(c) for c in (*named, "mrr")], *latency,
        F.count_if(negative).alias("negative_total"), rejected.alias("negative_correct_rejections"), F.try_divide(rejected, F.count_if(negative)).alias("negative_rejection_rate"),
    )


def regressions(baseline: DataFrame, current: DataFrame, threshold: float = 0.02) -> DataFrame:
    """Rows (metric, k, baseline, current, message) of the metrics (metric, k, value) that fell by more than threshold; a missing one counts as 0."""
    both = baseline.select("metric", "k", F.col("value").alias("baseline")).join(current.select("metric", "k", F.col("value").alias("current")), ["metric", "k"], "left")
    both = both.withColumn("current", F.coalesce("current", F.lit(0.0)))
    message = F.format_string("%s@%s dropped from %.4f to %.4f", "metric", F.col("k").cast("string"), "baseline", "current")
    return both.where(F.col("baseline") - F.col("current") > threshold).withColumn("message", message)


def long_metrics(report_: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    """A report as (metric, k, value)."""
    named = [(m, k) for m in ("recall", "precision", "ndcg") for k in sorted(k_values)]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.col(f"avg_{m}_{k}").alias("value")) for m, k in named], F.struct(F.lit("mrr").alias("metric"), F.lit(max(k_values)).alias("k"), F.col("avg_mrr").alias("value")))
    return report_.select(F.explode(rows).alias("r")).select("r.*")


def run_golden(golden: DataFrame, corpus: query.Corpus, retrievers: list, models: query.Models = query.Models(), k_values: tuple[int, ...] = K_VALUES, **options) -> tuple[DataFrame, DataFrame]:
    """(item results, report) of a golden set (id, query, relevant_doc_ids, expected_empty) put to the query plan: an item's documents are those that its answer cites."""
    asked = golden.select(F.col("id").alias("query_id"), "query")
    answers = materialised(query.run(asked, corpus, retrievers, models, **options), "answers")
    cited = answers.select(F.col("query_id").alias("id"), F.explode("citations").alias("c")).select("id", F.col("c.index").alias("rank"), F.col("c.doc_id").alias("doc_id"))
    items = materialised(item_results(golden, cited, k_values), "items")
    return items, report(items, k_values)
