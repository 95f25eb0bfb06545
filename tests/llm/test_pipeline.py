"""The stages of the pipeline on one small table: what each keeps, and that a rerun agrees."""

import compare
import corpus_pipeline as P
from pyspark.sql import functions as F
from test_operators import brute_components

from siftstone.llm.common import written


def test_stages(spark):
    docs, kept = spark.read.parquet(f"{compare.DATA}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in P.STAGES:
        before, docs = docs, written(stage(spark, docs, compare.DATA), name)
        kept[name] = (before, docs)
        assert docs.columns == columns or name == "sharding"
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    before, after = kept["near_duplicates"]
    found = brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert sorted(ids(after)) == sorted(i for i, (_, c) in found.items() if c == i)
    con = compare.oracle()
    leaked = {i for i, in con.sql("SELECT doc_id FROM documents d WHERE EXISTS (FROM benchmark b WHERE contains(d.text, b.text))").fetchall()}
    before, after = kept["decontamination"]
    assert not leaked & set(ids(after)) and len(ids(before)) - len(ids(after)) < 0.15 * len(ids(before))
    before, after = kept["mixing"]
    assert max(ids(after).count(i) for i in set(ids(after))) <= 3 and set(ids(after)) <= set(ids(before))
    before, after = kept["sharding"]
    assert sorted(ids(before)) == sorted(ids(after))
    good = {i for i, in con.sql("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
    before, after = kept["quality"]
    assert len(good & set(ids(after))) >= 0.95 * len(good & set(ids(before)))
    again = P.run(spark, compare.DATA)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, kept["sharding"][1].collect()))


def test_stages_with_odd_rows(spark):
    """Null and empty texts, null and repeated ids, repeated rows, null sources and columns whose names the operators use themselves."""
    names = ("_id", "k1", "size", "draws", "copy", "row", "fp", "part", "label", "item_id", "_source_key", "mix_shard", "score", "_kept")
    clash = lambda df: df.withColumns({n: F.lit(n) for n in names})
    real = spark.read.parquet(f"{compare.DATA}/documents.parquet")
    odd = [(None, None, None, None, None), (None, "", "en", "s", 0), (7, None, "en", None, 0), (7, "", "en", "s", 0), (7, " \n ", "en", "s", 3), (7, "word", "en", "s", 4), (7, "word", "en", "s", 4), (None, "same same", "en", "s", 9), (None, "same same", "en", "s", 9)]
    docs = clash(real.limit(80).unionByName(spark.createDataFrame(odd, real.schema)))
    for empty in (False, True):
        rows = docs.limit(0) if empty else docs
        for name, stage in P.STAGES:
            # The classifier may take all odd rows away, so the others get them too.
            out = written(stage(spark, rows, compare.DATA), name)
            assert out.columns == docs.columns or name == "sharding"
            assert not empty or out.count() == 0
            if name == "sharding":
                assert out.count() == rows.count()
            if name == "near_duplicates" and not empty:
                kept = [r.text for r in out.where("doc_id IS NULL").collect()]
                assert sorted(kept, key=str) == ["", None, "same same", "same same"] or len(kept) == 4
                assert out.where("doc_id = 7").count() == 1
            if name == "decontamination" and not empty:
                assert out.where("doc_id IS NULL OR doc_id = 7").count() >= 9
            if name == "mixing" and not empty:
                assert out.groupBy("doc_id", "text").count().join(rows.groupBy("doc_id", "text").count().withColumnRenamed("count", "n"), ["doc_id", "text"]).where("count > 3 * n").count() == 0
