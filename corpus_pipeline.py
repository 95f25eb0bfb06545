"""From raw documents to shards: each stage works on what its predecessor kept.

quality          documents that the compression classifier rejects go
near_duplicates  of each component of similar five-word shingle sets (0.8 or more) the smallest id stays
decontamination  documents that leak a benchmark item go
mixing           rows are repeated or left out so that the sources reach their target weights, and lie in the order of their mixing shards
sharding         a row for each remaining row: its shard by extendible hashing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm import extendible_shards, ngram_join, quality_zstd, source_mix, template_leaks
from siftstone.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold of the query. Null and empty texts score the labelled share of good ones; without labels of both classes all rows do."""
    model = quality_zstd.train(docs, table(spark, sf_dir, "labels"), held_out=F.lit(False))
    return quality_zstd.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, under its smallest id. Null and empty texts link with nothing, rows without an id stay."""
    return ngram_join.one_of_each(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leak, which null and empty texts never have."""
    return template_leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as they are drawn, three times at most, in the order of the mix. Rows of size 0 come along with their blocks, a null source is the last one."""
    rows = written(source_mix.sized_rows(docs), "mix-rows")
    return source_mix.shuffled_mix(docs, source_mix.plan_mix(rows))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each row, null ids and texts included."""
    return extendible_shards.assign_shards(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: No stage but the last is within SQL's reach; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each other stage's rows are a table of their own in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
