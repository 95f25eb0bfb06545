"""Whitening against a dense eigensolver, and on odd vectors."""

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.llm import whitening as W
from siftstone.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def dense(vectors):
    """n, whole entries times n less their sums, eigenvalues from the largest on, eigenvectors, trace."""
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n = len(x)
    shifted = n * x - x.sum(axis=0)
    v = (shifted / n).T @ (shifted / n) / n
    values, axes = np.linalg.eigh(v)
    return n, shifted, values[::-1], axes[:, ::-1], np.trace(v)


def check(rows, ids, vectors):
    n, shifted, values, axes, trace = dense(vectors)
    real = int((values[:32] > 1e-9 * values[0]).sum())
    assert len(rows) == real * n and sorted(rows.component.unique()) == list(range(1, real + 1))
    want = (shifted / n) @ axes[:, :real] / np.sqrt(values[:real])
    got = rows.sort_values(["vec_id", "component"]).whitened.to_numpy().reshape(n, real)[np.argsort(np.argsort(ids))]
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < 1e-8
    first = rows[rows.component == 1].set_index("vec_id")
    assert [first.deviation[i] for i in ids] == [int(d) for d in (shifted.astype(object) ** 2).sum(axis=1)]
    assert (rows.n == n).all() and rows.identity_error.max() < 1e-8
    assert np.allclose(rows.groupby("component").explained.first(), values[:real] / trace, rtol=1e-9)


def test_query_equals_a_dense_solver(spark):
    for sf in (compare.DATA, compare.DATA.replace("0.001", "0.1")):
        t = compare.oracle(sf).sql("SELECT vec_id, embedding FROM embeddings").df()
        check(QUERIES["op13_whitening"](spark, sf).toPandas(), t.vec_id.tolist(), t.embedding.tolist())


def ran(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).withColumns({"whitened": F.lit("clash"), "v": F.lit(1)}).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return QUERIES["op13_whitening"](spark, str(folder)).toPandas()


def test_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(2)
    fine = [(i, [float(x) for x in np.float32(rng.normal(0, 1 + np.arange(6)))]) for i in range(60)] + [(100 + i, [0.5] * 6) for i in range(30)]
    odd = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, [float("nan")] * 6), (204, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (205, [1.0, 2.0]), (206, [3e38] * 6)]
    rows = ran(spark, tmp_path, [(*r, 0) for r in fine + odd])
    check(rows, [i for i, _ in fine], [v for _, v in fine])


def test_few_rows(spark, tmp_path):
    """Fewer components where rows span fewer dimensions, none for one row, equal rows and no rows."""
    rng = np.random.default_rng(3)
    three = [(i, [float(x) for x in np.float32(rng.normal(0, 9, 40))]) for i in range(3)]
    rows = ran(spark, tmp_path / "three", [(*r, 0) for r in three])
    assert len(rows) == 3 * 2
    check(rows, [0, 1, 2], [v for _, v in three])
    assert len(ran(spark, tmp_path / "one", [(1, [1.0, 2.0], 0)])) == len(ran(spark, tmp_path / "equal", [(i, [1.0, 2.0], 0) for i in range(9)])) == len(ran(spark, tmp_path / "none", [])) == 0


def test_null_and_repeated_ids_and_large_entries(spark, tmp_path):
    rows = [(None, [1.0, 5.0], 0), (None, [2.0, 1.0], 0), (7, [2.0, 1.0], 0), (7, [-1.0, 3.0e9], 0)]
    out = ran(spark, tmp_path, rows)
    # The second eigenvalue is below what a double can tell beside the first, and (4 * 64 * 3e9) ** 2 is beyond a long.
    assert len(out) == 4 and out.vec_id.isna().sum() == 2 and out.deviation.isna().all() and (out.component == 1).all()


@pytest.mark.parametrize(("width", "k", "guard"), [(300, 12, 4), (120, 32, 8), (30, 32, 8)])
def test_iteration_converges_on_flat_spectra(width, k, guard):
    rng = np.random.default_rng(6)
    turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
    values = np.linspace(2, 1, width)
    matrix = (turn * values) @ turn.T
    seen = []
    found, axes, passes = W.eigenpairs(lambda q: seen.append(q.shape[1]) or matrix @ q, width, min(k, width), guard)
    k = min(k, width)
    assert np.abs(found - values[:k]).max() < 1e-10 and np.linalg.norm(matrix @ axes - axes * found) < 1e-9 and np.abs(axes.T @ axes - np.eye(k)).max() < 1e-12
    assert passes == len(seen) and max(seen) <= min(width, 3 * (k + guard))


def test_iteration_says_when_it_does_not_converge():
    matrix = np.diag(np.linspace(2, 1.99, 400))
    with pytest.raises(ArithmeticError, match="residuals"):
        W.eigenpairs(lambda q: matrix @ q, 400, 8, guard=2, most=2)
