"""Exact cosine search over named vectors, many queries at once.

A crossJoin with a broadcast side would bind the query set to one executor's memory. Here queries are packed into
blocks and each block meets each group of corpus rows in a task of its own; per group only k rows a query leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.operators.lexical import ranked

#: Rows of a group, queries of a block, and scores that a task holds at a time.
GROUP_ROWS, QUERY_ROWS, SCORES = 16_384, 2048, 1 << 20


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, rank, chunk_id, score): the k rows of vectors (chunk_id, vector) most similar to each of queries (query_id, vector).

    Null, zero and non-finite vectors take no part. Vectors of another width than the query's don't meet it. Scores are rounded to `digits`, ties go
    to the smaller chunk id. A task holds a group, a block and SCORES scores, whatever the number of rows and queries.
    """
    n, n_queries = vectors.count(), queries.count()
    groups, blocks = max(1, -(-n // GROUP_ROWS)), max(1, -(-n_queries // QUERY_ROWS))
    left = vectors.select("chunk_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("chunk_id"), F.lit(groups)).cast("int").alias("grp"))
    right = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    c_type, q_type = (d.schema[c].dataType.simpleString() for d, c in ((vectors, "chunk_id"), (queries, "query_id")))
    found = left.groupBy("grp", "block").cogroup(right.groupBy("grp", "block")).applyInArrow(_block_topk(k, digits), f"query_id {q_type}, chunk_id {c_type}, score double")
    return ranked(found, k)


def _by_width(table: pa.Table, name: str) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """By width: the ids of the usable vectors, ascending, and these as unit vectors."""
    ids, vectors = (table[c].combine_chunks() if len(table) else pa.array([], table.schema.field(c).type) for c in (name, "vector"))
    order = pc.sort_indices(ids)
    ids, vectors = ids.take(order), vectors.take(order)
    widths, out = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False), {}
    for width in np.unique(widths[widths > 0]).tolist():
        at = np.flatnonzero(widths == width)
        # A null component becomes NaN, and so does the length.
        x = np.array(vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(at), width)
        length = np.linalg.norm(x, axis=1)
        fine = np.isfinite(length) & (length > 0)
        if fine.any():
            out[width] = ids.take(pa.array(at[fine])), x[fine] / length[fine, None]
    return out


def _block_topk(k: int, digits: int):
    def topk(rows: pa.Table, asked: pa.Table) -> pa.Table:
        of, out = _by_width(rows, "chunk_id"), []
        for width, (query_ids, q) in _by_width(asked, "query_id").items():
            if width not in of:
                continue
            ids, x = of[width]
            step, most = max(1, SCORES // len(ids)), min(k, len(ids))
            for start in range(0, len(q), step):
                scores = np.round(q[start : start + step] @ x.T, digits) + 0.0
                # All above the last place's score, and of those with it the first.
                last = np.partition(scores, len(ids) - most, axis=1)[:, len(ids) - most, None]
                tie = scores == last
                room = most - (scores > last).sum(axis=1, keepdims=True)
                query, row = np.nonzero((scores > last) | (tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= room)))
                out.append(pa.table([query_ids.take(pa.array(query + start)), ids.take(pa.array(row)), pa.array(scores[query, row])], ["query_id", "chunk_id", "score"]))
        kinds = asked.schema.field("query_id").type, rows.schema.field("chunk_id").type
        return pa.concat_tables(out) if out else pa.table([pa.array([], kind) for kind in (*kinds, pa.float64())], ["query_id", "chunk_id", "score"])

    return topk


def embed(df: DataFrame, provider, dimension: int, text: str = "context_text", out: str = "vector") -> DataFrame:
    """df with provider's vectors. provider maps a list of texts to as many vectors; another number or width fails the task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(_vectors(provider, [t or "" for t in s], dimension))

    # A model is called once a text: a filter on what it gives mustn't be moved before it with a call of its own.
    return df.withColumn(out, run.asNondeterministic()(F.col(text)))


def _vectors(provider, texts: list[str], dimension: int) -> list:
    vectors = provider(texts)
    if len(vectors) != len(texts) or any(len(v) != dimension for v in vectors):
        raise ValueError(f"the provider gave {len(vectors)} vectors for {len(texts)} texts, or not of {dimension} components")
    return list(vectors)


def embed_each(df: DataFrame, provider, dimension: int, text: str = "context_text", out: str = "vector", error: str = "error", patience: int = 64) -> DataFrame:
    """embed() that no text can fail: df with the vector, or null and what the provider said about that text.

    A batch that fails is halved until the texts that fail are alone, so one bad text costs two calls for each halving. After `patience` failures of single texts
    in a row with no success between, the rest of the task counts as failed by the same error: the provider is down.
    """

    def each(texts: list[str], streak: list[int]) -> list[tuple]:
        if streak[0] >= patience:
            return [(None, streak[1])] * len(texts)
        try:
            found = [(v, None) for v in _vectors(provider, texts, dimension)]
            streak[0] = 0
            return found
        except Exception as e:  # noqa: BLE001  a provider may fail in any way
            if len(texts) == 1:
                streak[:] = [streak[0] + 1, str(e) or type(e).__name__]
                return [(None, streak[1])]
        half = len(texts) // 2
        return each(texts[:half], streak) + each(texts[half:], streak)

    @F.pandas_udf("vector array<float>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        streak = [0, ""]
        for s in batches:
            found = each([t or "" for t in s], streak) if len(s) else []
            yield pd.DataFrame({"vector": pd.Series([v for v, _ in found], dtype="object"), "error": pd.Series([e for _, e in found], dtype="object")})

    return df.withColumn("_e", run.asNondeterministic()(F.col(text))).withColumn(out, F.col("_e.vector")).withColumn(error, F.col("_e.error")).drop("_e")


def hashing_provider(dimension: int):
    """A deterministic stand-in for a model: signed hashed word counts, normalised."""
    import xxhash

    def provide(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dimension)
            for w in t.lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                v[h % dimension] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return provide
