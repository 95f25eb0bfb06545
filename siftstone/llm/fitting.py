"""Labelled samples and logistic calibration for the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import written


LEAST_SLOPE = 1e-3


def part_of(doc_id: str) -> Column:
    """A number in [0, 1) for an id, always the same."""
    return F.pmod(F.xxhash64(doc_id, F.lit(12)), F.lit(1 << 20)) / float(1 << 20)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, rows: int) -> DataFrame:
    """(doc_id, text, label int, part double): the texts of at most `rows` labelled documents that aren't held out.

    The sample is the rows of the smallest hash, so it is the same in each run; part is uniform in [0, 1) and
    independent of that choice. Null ids, null labels and labels other than 0 and 1 are left out; a document with
    both labels counts once with each. The sample's ids are broadcast: their number is bounded by `rows`. It is written once, as several passes read it.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out)
        .select("doc_id", F.col(label).cast("int").alias("label"))
        .distinct()
        .orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "label")
        .limit(rows)
    )
    return written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label", part_of("doc_id").alias("part")), "sample")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights, the intercept first, of a logistic regression whose slopes are positive: a feature that would count against label 1 gets LEAST_SLOPE,
    so that scores keep its order.

    Newton steps, each halved until the loss falls. The ridge keeps the weights finite where a feature separates the classes, and a smaller
    one the intercept. Of one class only: an intercept with a count of one half for the other.
    """
    w = np.zeros(x.shape[1] + 1)
    if len(y) == 0:
        return w
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w[0] = np.log(rate / (1 - rate))
    if y.min() == y.max():
        return w
    used = list(range(x.shape[1]))
    while True:
        found = _newton(np.column_stack([np.ones(len(x)), x[:, used]]), y, np.r_[w[0], np.zeros(len(used))], np.r_[ridge / 100, np.full(len(used), ridge)])
        if not used or found[1:].min() >= 0:
            break
        used.pop(int(np.argmin(found[1:])))
    out = np.full(x.shape[1] + 1, LEAST_SLOPE)
    out[0], out[[1 + i for i in used]] = found[0], found[1:]
    return out


def _newton(a: np.ndarray, y: np.ndarray, w: np.ndarray, keep: np.ndarray) -> np.ndarray:
    centre = np.r_[w[0], np.zeros(len(w) - 1)]
    loss = lambda v: np.logaddexp(0, a @ v).sum() - y @ (a @ v) + keep @ (v - centre) ** 2 / 2
    now = loss(w)
    for _ in range(100):
        p = np.exp(-np.logaddexp(0, -(a @ w)))
        slope = a.T @ (y - p) - keep * (w - centre)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(keep), slope)
        while (new := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        if new > now or np.abs(step).max() <= 1e-9:
            break
        w, now = w + step, new
    return w


def logistic(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
