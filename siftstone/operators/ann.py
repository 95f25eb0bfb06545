"""Approximate cosine search over inverted lists of product-quantised codes, with exact scores for the best.

A coarse quantiser puts each vector into the cell of its nearest centre; what is left of it is cut into parts, each coded as the nearest of CODES
points. Since q.x = q.centre + q.rest, a query needs one table of inner products for all cells. Rows lie by cell, so a search reads only the
cells that its queries probe, by dynamic partition pruning, and of these first the codes: they rank a cell's rows for a query, the `keep` best of
each slice that reach the query's bar become candidates (the bar is the k-th best score of a sample, less the codes' error), and the candidates' exact cosines rank the result as dense.cosine_topk does.

The quantiser is fitted on a sample of about SAMPLE_ROWS rows by hash; every row is indexed. The sample also tells how many cells to probe and how many
candidates to keep for a recall of `target` against brute force. A cell of more than SLICE_ROWS rows is searched in slices, and one that more than QUERY_ROWS
queries probe in blocks of these, so that copies of one vector don't gather in a task. Bounds: MAX_CELLS centres and the parts' points are what the driver and the tasks hold of the quantiser, and BAR_ROWS rows of the sample.

Null, empty, zero and non-finite vectors, and those of another width than the sample's most frequent one, are in no cell and never found. Ids are
any type that orders; rows that share an id are rows of their own.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.functions import values as V
from siftstone.operators.lexical import ranked
from siftstone.sources.tables import materialised

SAMPLE_ROWS, MAX_CELLS, CODES, SLICE_ROWS, QUERY_ROWS, CALIBRATION, BAR_ROWS, BROADCAST_ROWS = 20_000, 4096, 256, 50_000, 20_000, 200, 16_384, 200_000


def _means(x: np.ndarray, k: int, unit: bool, rounds: int = 12) -> np.ndarray:
    """k centres of x by Lloyd's rounds from rows spread over x; an empty centre moves to the row that is worst served."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        distance = (centres**2).sum(axis=1) - 2 * x @ centres.T
        of = distance.argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        n = np.bincount(of, minlength=k)
        centres = sums / np.maximum(n, 1)[:, None]
        empty = np.flatnonzero(n == 0)
        if len(empty):
            centres[empty] = x[np.argsort(-distance.min(axis=1), kind="stable")[: len(empty)]]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1), 1e-12)[:, None]
    return centres


@dataclass(frozen=True)
class Quantiser:
    """Unit centres (cells, width), the parts' points (parts, codes, width / parts), the probes and candidates that the sample asks for, some rows of it, and by how much at most
    codes rank a neighbour too low, but for a hundredth of them."""

    centres: np.ndarray
    points: np.ndarray
    probes: int
    keep: int
    sample: np.ndarray
    error: float

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T).argmax(axis=1)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        parts = len(self.points)
        rest = (x - self.centres[cell]).reshape(len(x), parts, -1)
        return np.stack([((p**2).sum(axis=1) - 2 * rest[:, i] @ p.T).argmin(axis=1) for i, p in enumerate(self.points)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, parts, codes) inner products of queries with the parts' points."""
        return np.einsum("qpw,pcw->qpc", q.reshape(len(q), len(self.points), -1), self.points)

    def rough(self, tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(queries, rows) of what the codes add to q.centre."""
        out = np.zeros((len(tables), len(codes)))
        for i in range(codes.shape[1]):
            out += tables[:, i][:, codes[:, i]]
        return out

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centres=self.centres, points=self.points, rest=np.array([self.probes, self.keep]), sample=self.sample, error=np.array([self.error]))
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Quantiser:
        there = np.load(io.BytesIO(data))
        return Quantiser(there["centres"], there["points"], *map(int, there["rest"]), there["sample"], float(there["error"][0]))


def _unit_rows(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places of usable vectors of the width (of the most frequent one), and these as unit rows."""
    lists = [None if v is None or any(c is None for c in v) else v for v in column.to_pylist()] if column.null_count or column.flatten().null_count else None
    lengths = np.array([len(v) if v else 0 for v in lists]) if lists is not None else np.diff(np.asarray(column.offsets))
    if width is None:
        width = int(np.bincount(lengths[lengths > 0]).argmax()) if (lengths > 0).any() else 0
    at = np.flatnonzero(lengths == width) if width else np.zeros(0, int)
    if not len(at):
        return at, np.zeros((0, max(1, width)))
    picked = pa.array([lists[i] for i in at], pa.list_(pa.float64())) if lists is not None else column.take(pa.array(at))
    x = picked.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), width)
    length = np.linalg.norm(x, axis=1)
    fine = np.isfinite(length) & (length > 0)
    return at[fine], x[fine] / length[fine, None]


def fit(vectors: DataFrame, cells: int | None = None, part_width: int = 4, target: float = 0.93, k: int = 10) -> Quantiser | None:
    """The quantiser of vectors (chunk_id, vector); None where no vector is usable."""
    n = vectors.count()
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    picked = vectors.where(F.pmod(F.xxhash64("chunk_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.xxhash64("chunk_id", F.lit(6)).alias("h"), "vector")
    taken = picked.limit(2 * SAMPLE_ROWS).toArrow().combine_chunks()
    _, x = _unit_rows(taken["vector"].combine_chunks() if len(taken) else pa.array([], pa.list_(pa.float64())))
    if not len(x):
        return None
    x = x[np.lexsort(x.T)]
    x = x[np.random.default_rng(3).permutation(len(x))]
    cells = max(1, min(cells or int(np.sqrt(n)), MAX_CELLS, len(x) // 8 or 1))
    centres = _means(x, cells, unit=True)
    width = x.shape[1]
    parts = max(p for p in range(1, width + 1) if width % p == 0 and (p == 1 or width // p >= part_width))
    rest = (x - centres[(x @ centres.T).argmax(axis=1)]).reshape(len(x), parts, -1)
    points = np.stack([_means(rest[:, i], min(CODES, len(x)), unit=False, rounds=8) for i in range(parts)])
    return _calibrated(Quantiser(centres, points, cells, len(x), x[:BAR_ROWS].astype(np.float32), 0.0), x, target, k)


def _calibrated(found: Quantiser, x: np.ndarray, target: float, k: int) -> Quantiser:
    """With the fewest probes, and candidates as a power of two, that reach the target on the sample."""
    some = x[:CALIBRATION]
    score = some @ x.T
    score[np.arange(len(some)), np.arange(len(some))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return replace(found, probes=1, keep=1)
    want = np.argpartition(-score, k - 1, axis=1)[:, :k]
    cell = found.cells(x)
    near = np.argsort(-(some @ found.centres.T), axis=1, kind="stable")
    place = np.empty_like(near)
    np.put_along_axis(place, near, np.arange(near.shape[1])[None, :], axis=1)
    turn = np.take_along_axis(place, cell[want], axis=1)  # which probe meets each wanted row
    halfway = (1 + target) / 2
    probes = int(np.quantile(turn, halfway, method="higher")) + 1
    rough = found.rough(found.tables(some), found.codes(x, cell)) + (some @ found.centres.T)[:, cell]
    rough[np.arange(len(some)), np.arange(len(some))] = -np.inf
    mine = np.take_along_axis(rough, want, axis=1)
    rank = np.stack([np.searchsorted(np.sort(-rough[i]), -mine[i]) for i in range(len(some))])  # rows that the codes place before
    met = turn < probes
    keep = next((r for r in (1 << i for i in range(20)) if r >= k and ((rank < r) & met).mean() >= target or r >= len(x)), len(x))
    error = float(np.quantile(np.take_along_axis(score, want, axis=1) - mine, 0.99))
    return replace(found, probes=probes, keep=keep, error=max(0.0, error))


@dataclass(frozen=True)
class AnnIndex:
    """A quantiser and the folder of its rows (cell, chunk_id, code, vector) by cell."""

    spark: SparkSession
    path: str
    quantiser: Quantiser | None

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def sizes(self) -> DataFrame:
        """(cell, n): a row a cell."""
        return self.spark.read.parquet(f"{self.path}/sizes")


def build(vectors: DataFrame, path: str, quantiser: Quantiser | None) -> AnnIndex:
    """Writes every usable row of vectors (chunk_id, vector) to its cell below path."""
    spark = vectors.sparkSession
    spark.createDataFrame([(None if quantiser is None else bytearray(quantiser.to_bytes()),)], "quantiser binary").coalesce(1).write.parquet(f"{path}/quantiser")
    if quantiser is None:
        return AnnIndex(spark, path, None)
    kind = vectors.schema["chunk_id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _unit_rows(batch["vector"], quantiser.width)
            cell = quantiser.cells(x) if len(at) else np.zeros(0, int)
            codes = [c.tobytes() for c in quantiser.codes(x, cell)] if len(at) else []
            place = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch["chunk_id"].take(place), pa.array(codes, pa.binary()), batch["vector"].take(place)], ["cell", "chunk_id", "code", "vector"])

    rows = vectors.select("chunk_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(assign, f"cell int, chunk_id {kind}, code binary, vector array<double>")
    # Large cells get several files: rows are rebalanced, not gathered in a task a cell.
    rows.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    made = AnnIndex(spark, path, quantiser)
    made.rows().groupBy("cell").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/sizes")
    return made


def load(spark: SparkSession, path: str) -> AnnIndex:
    data = spark.read.parquet(f"{path}/quantiser").first()[0]
    return AnnIndex(spark, path, None if data is None else Quantiser.from_bytes(bytes(data)))


def search(index: AnnIndex, queries: DataFrame, k: int, probes: int | None = None, keep: int | None = None, digits: int = 6) -> DataFrame:
    """(query_id, rank, chunk_id, score) as dense.cosine_topk gives it for queries (query_id, vector), but for rows that no probe or code leads to."""
    id_kind = queries.schema["query_id"].dataType.simpleString()
    z = index.quantiser
    if z is None:
        return queries.select("query_id", F.lit(0).alias("rank"), F.lit(None).cast("string").alias("chunk_id"), F.lit(0.0).alias("score")).limit(0)
    # Who asks for candidates of their own gets them without a bar.
    whole, probes, keep = keep is not None, min(probes or z.probes, len(z.centres)), max(k, keep or z.keep)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, q = _unit_rows(batch["vector"], z.width)
            near = np.argsort(-(q @ z.centres.T), axis=1, kind="stable")[:, :probes]
            again = pa.array(np.repeat(at, near.shape[1]))
            # The k best of all rows score at least what the k best of the sample do.
            score = q @ z.sample.T
            bar = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] - z.error if len(q) and score.shape[1] >= k and not whole else np.full(len(q), -np.inf)
            bars = pa.array(np.repeat(bar, near.shape[1]))
            flat = pa.array(np.repeat(q, near.shape[1], axis=0).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["query_id"].take(again), flat, pa.array(near.ravel().astype(np.int32)), bars], ["query_id", "q", "cell", "bar"])

    asked = materialised(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(probed, f"query_id {id_kind}, q array<double>, cell int, bar double"), "probes")
    slices, blocks = F.ceil(F.col("n") / SLICE_ROWS).cast("int"), F.ceil(F.col("asked") / QUERY_ROWS).cast("int")
    # A row a cell; the filter lets the scan of the rows be pruned by what this side gives.
    opened = asked.groupBy("cell").agg(F.count("*").alias("asked")).where("asked > 0").join(F.broadcast(index.sizes()), "cell").select("cell", slices.alias("slices"), blocks.alias("blocks"))
    opened = materialised(opened.where("slices > 0"), "opened-cells")
    pruned = lambda: index.rows().join(F.broadcast(opened.where("slices > 0")), "cell")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = F.pmod(F.xxhash64("chunk_id", F.monotonically_increasing_id()), "slices").cast("int")
    codes = pruned().select("cell", own.alias("slice"), upto("blocks").alias("block"), "chunk_id", "code")
    pairs = asked.join(F.broadcast(opened), "cell").select("cell", upto("slices").alias("slice"), F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), "query_id", "q", "bar")
    kind = codes.schema["chunk_id"].dataType.simpleString()

    def best_of(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        names = ["query_id", "cell", "chunk_id", "rough"]
        code = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(rows), -1)
        q = np.array(wanted["q"].to_pylist(), float).reshape(len(wanted), -1)
        out, ids = [], rows["chunk_id"].combine_chunks()
        if not len(rows) or not len(wanted):
            return pa.table([pa.array([], wanted["query_id"].type), pa.array([], pa.int32()), pa.array([], ids.type), pa.array([], pa.float64())], names)
        bars = wanted["bar"].to_numpy()
        cell, whose = wanted["cell"][0].as_py(), wanted["query_id"].combine_chunks()
        for i in range(0, len(q), 256):
            rough = z.rough(z.tables(q[i : i + 256]), code) + (q[i : i + 256] @ z.centres[cell])[:, None]
            most = min(keep, len(rows))
            best = np.argpartition(-rough, most - 1, axis=1)[:, :most]
            value = np.take_along_axis(rough, best, axis=1)
            asker, place = np.nonzero(value >= bars[i : i + 256, None])
            out.append(pa.table([whose.take(pa.array(asker + i)), pa.array(np.full(len(asker), cell, np.int32)), ids.take(pa.array(best[asker, place])), pa.array(value[asker, place])], names))
        return pa.concat_tables(out)

    rough = codes.groupBy("cell", "slice", "block").cogroup(pairs.groupBy("cell", "slice", "block")).applyInArrow(best_of, f"query_id {id_kind}, cell int, chunk_id {kind}, rough double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("rough"), "chunk_id")
    chosen = materialised(rough.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= keep).select("query_id", "cell", "chunk_id").distinct(), "candidates")
    wanted = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    exact = pruned().select("cell", "chunk_id", "vector").join(wanted, ["cell", "chunk_id"])
    whole = asked.groupBy("query_id").agg(F.first("q").alias("q"))
    scored = exact.join(whole, "query_id").select("query_id", "chunk_id", F.round(V.cosine(F.col("q"), F.col("vector")), digits).alias("score"))
    return ranked(scored, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, wanted, found): how many of exact's rows a search found."""
    hit = found.select("query_id", "chunk_id").distinct().withColumn("hit", F.lit(1))
    return exact.select("query_id", "chunk_id").join(hit, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
