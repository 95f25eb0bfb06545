"""Which documents may hold a passage: none that does is missed, however short the passage."""

from pyspark.sql import functions as F

from siftstone.operators import lexical
from siftstone.plans import catalog


def test_short_and_odd_passages(spark):
    texts = ["the quick brown fox", "unquick browns", "a-b --- c", "", None, "foxes", "x1y", "brown. Fox", "ab", "the quick brown fox jumps over"]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id int, text string")
    passages = ["quick brown", "fox", "---", "", "o", "quick brown fox jumps over", "n. F", "zz", "ick bro", "1", "a-b", " "]
    items = spark.createDataFrame([(n, p) for n, p in enumerate(passages)], "item_id int, text string")
    held = catalog._holders(items, docs, lexical.tokenised(docs, "doc_id")).distinct()
    pairs = held.join(items, "item_id").join(docs.withColumnRenamed("text", "body"), "doc_id").where(F.contains("body", F.col("text")))
    got = sorted((r.item_id, r.doc_id) for r in pairs.collect())
    assert got == sorted((i, d) for i, p in enumerate(passages) for d, t in enumerate(texts) if t is not None and p in t)
