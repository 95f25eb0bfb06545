"""Each query of the catalogue against its SQL, on the smallest tables."""

import compare
import pytest

from siftstone.plans import catalog


@pytest.fixture(scope="module")
def con():
    return compare.oracle()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert compare.differences(catalog.QUERIES[name](spark, compare.DATA).toPandas(), con.sql(catalog.ORACLE_SQL[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, compare.DATA).count() > 0


def test_golden_set_has_all_holders(spark, tmp_path):
    """A passage in 80 documents, one within words, in one long document, and passages too short for terms of their own."""
    passage = "the quick brown fox jumps over it"
    texts = [f"{n} {passage} {n}" for n in range(80)] + [f"un{passage}s", "pad " * 5000 + "rare words stand here once", "The quick brown fox", None, ""]
    items = [(1, passage), (2, "rare words stand here"), (3, "nowhere at all seen"), (4, "fox"), (5, "ox"), (6, "?"), (7, "")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.id: (r.relevant_doc_ids, r.expected_empty) for r in catalog._golden(spark, str(tmp_path)).collect()}
    want = {i: [n for n, t in enumerate(texts) if t is not None and p in t] for i, p in items}
    assert got == {i: (found, not found) for i, found in want.items()}


def test_retry_takes_all_records(spark):
    df = catalog.QUERIES["retry_outcomes"](spark, compare.DATA)
    assert "Limit" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
