"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into equal segments. With the mean m and the deviation norm s of each segment, Cauchy-Schwarz gives
    <q, x>  <=  sum over segments of (len * mq * mx + sq * sx)
so the bound is itself an inner product of short summaries [sqrt(len) * m, s]. The squared distance is
|q|^2 + |x|^2 - 2<q, x>, so an upper bound of the inner product is a lower bound of the distance. Bounds are
computed coarse to fine; only pairs that can still enter a query's k best reach the next resolution and, at the end,
the exact integer score.

For the bounds, and for them alone, vectors are turned by the main axes of a bounded sample (SAMPLE_ROWS rows), which leaves inner
products as they are and puts what varies most into the first segments. Each query starts with a bar: its k-th best score among the sample's rows.

Layout: candidates are dealt into groups of bounded size, queries into blocks of bounded size; each cell joins one
query block with one group (a stated query set against all rows, in blocks). A cell keeps the running k-th best of each query, so
that later blocks are pruned harder. The last step keeps k of (groups * k) rows a query. How much the bounds prune depends on the data: of
vectors without any structure, in 64 dimensions, only the finest resolution rules out most pairs.

Rows whose vector is null, or holds null or non-finite components, take no part; neither do rows without an id.
Vectors of other lengths are padded with zeros. Repeated rows are candidates of their own; a query never meets a row
of its own id. Ties go to the smaller id. Components beyond a long become the nearest long, and so do scores; both are exact within. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.llm.common import table

#: Segment counts, coarse to fine.
RESOLUTIONS = (8, 32)
QUERY_BLOCK = 1024
GROUP_ROWS = 8192
ROW_BLOCK = 1024
SURVIVORS = 1 << 15
#: Rows, and components in all, of the sample that the driver takes.
SAMPLE_ROWS, SAMPLE_SIZE = 2048, 1 << 20
LONG = np.iinfo(np.int64)


def quantised(df: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of the rows that take part."""
    x = F.col(embedding)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    return df.where(F.col(vec_id).isNotNull() & x.isNotNull() & whole).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"),
    )


def _summary(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows [sqrt(len) * mean, deviation norm] by segment: inner products of these bound those of x from above."""
    parts = np.array_split(x, min(segments, max(1, x.shape[1])), axis=1)
    mean = np.stack([p.mean(axis=1) for p in parts], axis=1)
    spread = np.stack([np.sqrt(np.maximum(((p - m[:, None]) ** 2).sum(axis=1), 0)) for p, m in zip(parts, mean.T)], axis=1)
    return np.concatenate([mean * np.sqrt([p.shape[1] for p in parts]), spread], axis=1)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """A list column as rows of longs, padded to width."""
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.values, dtype=np.int64)
    out = np.zeros((len(offsets) - 1, width), np.int64)
    size = np.diff(offsets)
    rows = np.repeat(np.arange(len(size)), size)
    out[rows, np.arange(len(rows)) - np.repeat(offsets[:-1] - offsets[0], size)] = flat[offsets[0] : offsets[-1]]
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, exact; those beyond a long become the nearest long."""
    top = lambda a: float(np.abs(a.astype(float)).max(initial=0))
    if top(q) * top(x) * max(1, q.shape[1]) < 2.0**62:
        return np.einsum("ij,ij->i", q, x)
    return np.array([min(LONG.max, max(LONG.min, sum(int(a) * int(b) for a, b in zip(r, s)))) for r, s in zip(q, x)], np.int64)


class Axes:
    """The main axes of a sample of rows, by falling energy."""

    def __init__(self, sample: np.ndarray, width: int):
        x = sample.astype(float)
        size = max(1.0, np.abs(x).max(initial=0))  # squares stay finite
        self.turn = np.linalg.eigh(x.T @ (x / size) / size)[1][:, ::-1] if width <= 1024 and len(x) else None

    def summaries(self, x: np.ndarray) -> list[np.ndarray]:
        turned = x.astype(float)
        turned = turned if self.turn is None else turned @ self.turn
        return [_summary(turned, r) for r in RESOLUTIONS]


class _Best:
    """The k best (score, vec_id) of each query of a cell so far."""

    def __init__(self, bar: np.ndarray, k: int):
        self.n, self.bar = np.zeros(len(bar), int), bar.astype(float)
        self.score = np.full((len(bar), k), LONG.min, np.int64)
        self.vec = np.full((len(bar), k), LONG.max, np.int64)

    def floor(self, rounding: np.ndarray) -> np.ndarray:
        """What a pair of each query has to reach, less a margin for the rounding of bounds."""
        k = self.score.shape[1]
        last = np.maximum(np.where(self.n >= k, self.score[:, -1].astype(float), -np.inf), self.bar)
        return np.where(np.isneginf(last), last, last - 1e-9 * np.abs(last) - rounding)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Takes up pairs (query row, vec id, score)."""
        k = self.score.shape[1]
        touched = np.unique(q)
        self.n += np.bincount(q, minlength=len(self.n))
        all_q = np.concatenate([np.repeat(touched, k), q])
        all_s = np.concatenate([self.score[touched].ravel(), score])
        all_v = np.concatenate([self.vec[touched].ravel(), ids])
        # Places that nothing has taken yet come after all pairs.
        free = np.concatenate([np.arange(k)[None, :] >= (self.n[touched] - np.bincount(q, minlength=len(self.n))[touched])[:, None]]).ravel()
        order = np.lexsort((all_v, ~all_s, np.concatenate([free, np.zeros(len(q), bool)]), all_q))
        all_q, all_s, all_v = all_q[order], all_s[order], all_v[order]
        pick = np.searchsorted(all_q, touched)[:, None] + np.arange(k)
        self.score[touched], self.vec[touched] = all_s[pick], all_v[pick]


class Cell:
    """A block of queries that meets rows."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, bar: np.ndarray, axes: Axes, k: int):
        self.ids, self.q, self.axes, self.best = ids, q, axes, _Best(bar, k)
        self.sums, self.norms = axes.summaries(q), np.linalg.norm(q.astype(float), axis=1)
        self.met = self.compared = 0

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        sums = self.axes.summaries(x)
        rounding = 1e-3 + 1e-11 * self.norms * np.linalg.norm(x.astype(float), axis=1).max(initial=0)
        self.met += len(self.ids) * len(ids)
        floor = self.best.floor(rounding)
        alive = self.sums[0] @ sums[0].T >= floor[:, None]
        for a, b in zip(self.sums[1:], sums[1:]):
            if 8 * alive.sum() > alive.size:  # cheaper for all at once
                alive &= a @ b.T >= floor[:, None]
            else:
                rows, cols = np.nonzero(alive)
                alive[rows, cols] = np.einsum("ij,ij->i", a[rows], b[cols]) >= floor[rows]
        alive &= self.ids[:, None] != ids[None, :]
        rows, cols = np.nonzero(alive)
        self.compared += len(rows)
        for i in range(0, len(rows), SURVIVORS):
            r, c = rows[i : i + SURVIVORS], cols[i : i + SURVIVORS]
            self.best.add(r, ids[c], _scores(self.q[r], x[c]))

    def result(self) -> pa.RecordBatch:
        there = np.arange(self.best.score.shape[1])[None, :] < self.best.n[:, None]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, there.sum(axis=1))), pa.array(self.best.vec[there]), pa.array(self.best.score[there])], ["query_id", "vec_id", "score"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray, pa.Array, np.ndarray]]:
    """Runs of rows of the same cell and side."""
    for batch in batches:
        cell, side = np.asarray(batch["cell"]), np.asarray(batch["is_query"])
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(cell)]):
            if b > a:
                yield cell[a], bool(side[a]), np.asarray(batch["vec_id"])[a:b], batch["v"].slice(a, b - a), np.asarray(batch["bar"])[a:b]


def _searcher(k: int, width: int, axes: Axes):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queries, open_cell = None, [], None
        for cell, is_query, ids, v, bar in _runs(batches):
            if cell != at:
                if open_cell:
                    yield open_cell.result()
                at, queries, open_cell = cell, [], None
            x = _matrix(v, width)
            if is_query:
                queries.append((ids, x, bar))
                continue
            if not queries:
                continue
            if open_cell is None:
                open_cell = Cell(*(np.concatenate(c) for c in zip(*queries)), axes, k)
            for i in range(0, len(ids), ROW_BLOCK):
                open_cell.meet(ids[i : i + ROW_BLOCK], x[i : i + ROW_BLOCK])
        if open_cell:
            yield open_cell.result()

    return search


def _barrer(k: int, width: int, ids: np.ndarray, sample: np.ndarray):
    """Rows with bar, their k-th best score among the sample; minus infinity where that has fewer."""

    def bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, q = np.asarray(batch["vec_id"]), _matrix(batch["v"], width)
            bar = np.full(len(own), -np.inf)
            for i in range(0, len(own), 256):
                score = q[i : i + 256].astype(float) @ sample.astype(float).T
                score[own[i : i + 256, None] == ids[None, :]] = -np.inf
                if score.shape[1] >= k:
                    kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                    bar[i : i + 256] = kth - 1e-9 * np.abs(np.where(np.isfinite(kth), kth, 0))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(bar)], ["vec_id", "v", "bar"])

    return bars


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors with the highest inner product for each row of queries.

    Both tables are (vec_id long, v array<long>), see quantised(). Of query rows that share an id the one of the
    smallest vector counts; rows that share the query's id are its own, whatever their vectors, and aren't met.
    """
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    n_queries, q_width = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(width or 1, q_width or 1)
    groups, blocks = max(1, -(-n // GROUP_ROWS)), max(1, -(-n_queries // QUERY_BLOCK))
    taken = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(max(1, min(SAMPLE_ROWS, SAMPLE_SIZE // width))).toArrow()
    sample = _matrix(taken["v"].combine_chunks(), width) if len(taken) else np.zeros((0, width), np.int64)
    axes = Axes(sample, width)

    dealt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(groups))
    rows = vectors.select(
        F.explode(F.sequence(dealt * blocks, dealt * blocks + (blocks - 1))).alias("cell"), F.lit(False).alias("is_query"), "vec_id", "v", F.lit(0.0).alias("bar")
    )
    barred = queries.groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(_barrer(k, width, np.asarray(taken["vec_id"]), sample), "vec_id long, v array<long>, bar double")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    asked = barred.select(
        F.explode(F.sequence(block, block + (groups - 1) * blocks, F.lit(blocks).cast("long"))).alias("cell"), F.lit(True).alias("is_query"), "vec_id", "v", "bar"
    )
    parts = max(1, min(groups * blocks, 4096))
    # Cells go to partitions by their number, so that each gets as many as any other.
    cells = rows.unionByName(asked).repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int")).sortWithinPartitions("cell", F.desc("is_query"))
    found = cells.mapInArrow(_searcher(k, width, axes), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return exact_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


#: Every pair, ranked.
OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scored QUALIFY rank <= 5
"""
