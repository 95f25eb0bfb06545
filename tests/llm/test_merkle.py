"""The Merkle manifest against trees that plain loops build, with odd rows and on small blocks."""

import hashlib
import zlib

import compare
import pytest
from pyspark.sql import functions as F

from siftstone.llm import merkle_manifest as M
from siftstone.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])


def tree(nodes):
    """The last node, and for each leaf what stands beside it by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a - a % 3 : a - a % 3 + 3]
            paths[i].append((run[: a % 3], run[a % 3 + 1 :]))
            at[i] = a // 3
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append(r)
    trees = {}
    for s, own in groups.items():
        own.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees[s] = tree([leaf(r, r.text) for r in own])
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    root, above = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, above):
        for r, path in zip(groups[s], trees[s][1]):
            proof, text = path + top, r.text
            if r.doc_id is not None and text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for a, b in proof:
                node = H(*a, node, *b)
            out.append((r.doc_id, leaf(r, r.text), trees[s][0], root, H(*[x for a, b in proof for x in a + b]), node, node == root))
    return sorted(out, key=repr)


def ran(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).withColumns({"g": F.lit("clash"), "hash": F.lit(1), "kept": F.lit(2.5), "pos": F.lit(None).cast("int")}).repartition(3).write.parquet(f"{folder}/documents.parquet")
    found = QUERIES["op11_merkle_manifest"](spark, str(folder))
    return sorted(map(tuple, found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def odd_rows():
    rows = [(n, ("hot", "ü", None, "a", "B")[0 if n % 3 else n % 5], ("en", None)[n % 7 == 0], n * 11, f"text {n}\nline\n") for n in range(260)]
    rows += [(None, "hot", None, None, None), (None, None, None, None, None), (5, "hot", "en", 1, None), (6, "", "en", 0, ""), (7, "one", "de", 3, "größe\n"), (-4, "hot", "en", 2, "\n\n")]
    rows += [(9, "same", "en", 4, "copy\nof")] * 50  # rows that are equal
    return rows + [(300, "long", "en", 1, "x\n" * 200_000)]


def test_odd_rows_equal_brute_force(spark, tmp_path):
    rows = odd_rows()
    from pyspark.sql import Row

    want = brute([Row(doc_id=a, source=b, lang=c, n_chars=d, text=e) for a, b, c, d, e in rows])
    got = ran(spark, tmp_path, rows)
    assert got == want and {v for *_, v in got} == {True, False}


@pytest.mark.parametrize("fold", [1, 2, 4])
def test_sizes_at_the_borders_of_blocks(spark, fold):
    rows = [(i + 1000 * n, f"s{n}", "en", i, str(i)) for n in (1, 2, 3, 4, 9, 10, 81, 82, 244) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {w[0]: w for w in brute(df.collect())}
    for r in M.manifest(df, COLUMNS, "source", "doc_id", fold=fold).collect():
        assert (r.leaf, r.subroot, r.root) == want[r.doc_id][1:4] and H(*[x for s in r.proof for x in (*s.before, *s.after)]) == want[r.doc_id][4]


def test_single_rows_and_no_rows(spark, tmp_path):
    ((i, leaf_, sub, root, proof, folded, ok),) = ran(spark, tmp_path / "one", [(1, None, None, None, None)])
    assert leaf_ == sub == root == folded and ok and proof == H("") and i == 1
    assert ran(spark, tmp_path / "none", []) == []


def test_a_hot_group_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    rows = M.manifest(df, COLUMNS, "source", "doc_id", {"doc_id": F.col("doc_id")}).withColumn("ok", M.folded(F.col("leaf"), F.col("proof")) == F.col("root"))
    assert rows.where("ok").count() == len(odd_rows())


def test_equals_sql(spark):
    got = QUERIES["op11_merkle_manifest"](spark, compare.DATA).toPandas()
    assert not compare.differences(got, compare.oracle().sql(ORACLE_SQL["op11_merkle_manifest"]).df())
    assert got.verified.nunique() == 2
