"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: source i of weight w gets the share w / sum of weights of the total size, at most MAX_REPEAT times its own
size; what a capped source can't take is shared again by weight until none is above its cap.

Draws: the documents of a source are dealt by hash into blocks of about BLOCK_DOCS. The slots of a source are its blocks in a
permuted order, copy after copy. A source whose target is m whole copies and a rest has as its quota all slots of m copies, and for the rest as
many more as fit; the last slot is drawn in part: its documents in hash order that still fit. So every source has an exact quota of
slots. Quotas are split among the output shards by a tree: each node gives its left half of the shards a
multivariate-hypergeometric part of its quotas, whose total is the half's exact capacity. At the leaves each shard has its number of slots of each source;
a source's slots, permuted, go to the shards in disjoint runs of these sizes. What no shard's run holds isn't drawn: the tree says what is taken.
Within a shard, rows are shuffled by a seeded hash.

All is a function of the seed and the rows, so reruns agree. To the driver come figures of each source, nothing of a document; there may be
SOURCES of them at most, else an error says so. A draw looks through the ends of its source's runs, so shards are for some thousands at most.
Rows of the same source, id and size are drawn together. A null source is a source and comes last; a null text has size
0. An empty table gives no rows; a source of size 0 has target 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.llm.common import table, word_count, written

MAX_REPEAT, BLOCK_DOCS, SHARDS, SEED, BROADCAST_ROWS = 3, 1000, 16, 20_240, 100_000
#: Sources at most; blocks whose sums are added up at once.
SOURCES, SPAN = 100_000, 1000
#: Partitions of a shard, a power of 2.
PARTS = 16
WEIGHTS = (1, 2, 3)


def fill_targets(sizes: list[int], weights: list[float], total: float, repeat: float = MAX_REPEAT) -> list[float]:
    """Shares of total by weight, none above repeat times its size, the excess shared again by weight."""
    caps = [repeat * s for s in sizes]
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), min(float(total), float(sum(caps)))
    while free:
        per = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * per > caps[i]]
        if not full:
            for i in free:
                target[i] = weights[i] * per
            break
        for i in full:
            target[i] = float(caps[i])
            left -= caps[i]
            free.remove(i)
    return target


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """quotas[source] -> [source, shard]: shard totals differ by one at most, rows sum to the quotas."""
    out = np.zeros((len(quotas), shards), np.int64)

    def split(part: np.ndarray, a: int, b: int) -> None:
        if b - a == 1:
            out[:, a] = part
            return
        mid = (a + b) // 2
        n = int(part.sum())
        wanted = n * (mid - a) // (b - a)
        left, n_left, rest = np.zeros_like(part), wanted, n
        for i, q in enumerate(part):  # one source after the other: a hypergeometric draw of each
            rest -= q
            left[i] = rng.hypergeometric(q, rest, n_left) if n_left and q else 0
            n_left -= left[i]
        split(left, a, mid)
        split(part - left, mid, b)

    if len(quotas):
        split(quotas.astype(np.int64), 0, shards)
    return out


def _stride(n: int, rng: np.random.Generator) -> tuple[int, int]:
    """(a, c) of a permutation u -> (a u + c) mod n."""
    if n < 2:
        return 1, 0
    while math.gcd(a := int(rng.integers(1, min(n, 1 << 31))), n) != 1:
        pass
    return a, int(rng.integers(n))


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


@dataclass
class Mix:
    """sources: a row for each source; picks: the documents that the partly drawn blocks give."""

    sources: DataFrame
    picks: DataFrame
    seed: int

    def copies(self, rows: DataFrame) -> DataFrame:
        """rows (with _source_key, doc_id, size) with the columns of sources and draws, array<struct<copy, shard>>."""
        joined = rows.join(self.sources, "_source_key").withColumn("_block", _block(self.seed))
        picked = self.picks.withColumn("_picked", F.lit(True))
        same = joined["_source_key"].eqNullSafe(picked["_k"]) & joined["doc_id"].eqNullSafe(picked["_id"]) & (joined["size"] == picked["_size"])
        joined = joined.join(picked, same, "left").drop("_k", "_id", "_size")
        rank = (F.col("_block") * F.col("stride") + F.col("shift")) % F.col("blocks")
        number = F.col("whole") + F.when((rank < F.col("cut")) | F.coalesce("_picked", F.lit(False)), 1).otherwise(0)

        def draw(copy: Column) -> Column:
            at = ((copy * F.col("blocks") + rank) * F.col("draw_stride") + F.col("draw_shift")) % F.col("quota")
            return F.struct(copy.cast("int").alias("copy"), F.size(F.filter("shard_ends", lambda e: e <= at)).alias("shard"))

        slots = F.when(number > 0, F.transform(F.sequence(F.lit(0).cast("long"), number - 1), draw)).otherwise(F.array().cast("array<struct<copy:int,shard:int>>"))
        return joined.withColumn("draws", F.filter(slots, lambda d: d["shard"] < F.size("shard_ends"))).drop("_block", "_picked")


def _block(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "_source_key", "doc_id", "size"), F.col("blocks"))


_PLAN = "_source_key string, source_size long, target double, whole long, blocks long, stride long, shift long, remainder double"


def _cuts(units: DataFrame, plan: DataFrame) -> DataFrame:
    """(_source_key, cut, left): the first slot of the last copy that doesn't fit the remainder, and what is left for it. Sources that take all have none."""
    by_block = units.groupBy("_source_key", "rank", "remainder").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    by_block = written(by_block.withColumn("span", F.floor(F.col("rank") / SPAN)), "mix-blocks")

    def first_over(rows: DataFrame, at: str, before: Column) -> DataFrame:
        """(_source_key, at, left before it) of the first row in whose running sum the remainder ends."""
        upto = before + F.sum("words").over(Window.partitionBy("_source_key").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
        left = F.col("remainder") - F.col("upto") + F.col("words")
        over = rows.withColumn("upto", upto).where(F.col("upto") > F.col("remainder"))
        return over.groupBy("_source_key").agg(F.min(F.struct(at, left.alias("left"))).alias("o")).select("_source_key", f"o.{at}", "o.left")

    # First the span in which the remainder ends, then the block of that span.
    spans = by_block.groupBy("_source_key", "span", "remainder").agg(F.sum("words").alias("words"))
    found = first_over(spans, "span", F.lit(0))
    inside = by_block.drop("remainder").join(found.withColumnRenamed("left", "remainder"), ["_source_key", "span"])
    return first_over(inside, "rank", F.lit(0)).withColumnRenamed("rank", "cut")


def plan_mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, shards: int = SHARDS, seed: int = SEED) -> Mix:
    """The plan for rows (_source_key, doc_id, size); weights are dealt to the sources in code point order, null last, repeating."""
    spark = rows.sparkSession
    units = written(rows.groupBy("_source_key", "doc_id", "size").agg(F.count("*").alias("n")), "mix-units")
    sums = units.groupBy("_source_key").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.count("*").alias("n"))
    stats = sums.limit(SOURCES + 1).collect()
    if len(stats) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    stats.sort(key=lambda r: (r["_source_key"] == "n", r["_source_key"]))
    targets = fill_targets([r.size for r in stats], [weights[i % len(weights)] for i in range(len(stats))], sum(r.size for r in stats))
    rng = np.random.default_rng(seed)
    plan = []
    for r, target in zip(stats, targets):
        whole = min(MAX_REPEAT, int(target // r.size)) if r.size else 0
        blocks = -(-r.n // BLOCK_DOCS)
        plan.append((r["_source_key"], r.size, float(target), whole, blocks, *_stride(blocks, rng), float(max(0.0, target - whole * r.size))))
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    first = small(spark.createDataFrame(plan, _PLAN), len(plan))
    placed = units.join(first, "_source_key").withColumn("block", _block(seed)).withColumn("rank", F.expr("(block * stride + shift) % blocks"))
    cuts = {r["_source_key"]: r for r in _cuts(placed, first).collect()}
    # A source without such a block is drawn whole again.
    cut = [(p[0], int(cuts[p[0]].cut) if p[0] in cuts else p[4], float(cuts[p[0]].left) if p[0] in cuts else 0.0) for p in plan]
    partly = placed.join(small(spark.createDataFrame(cut, "_source_key string, cut long, left double"), len(cut)), "_source_key").where(F.col("rank") == F.col("cut"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        """Documents of one block in hash order, each if it still fits."""
        left, taken = pdf["left"].iloc[0], []
        for i, words in enumerate((pdf["size"] * pdf["n"]).to_numpy()):
            if 0 < words <= left:
                left -= words
                taken.append(i)
        return pdf.iloc[taken][["_source_key", "doc_id", "size"]].set_axis(["_k", "_id", "_size"], axis=1)

    id_type = units.schema["doc_id"].dataType.simpleString()
    ordered = partly.select("_source_key", "doc_id", "size", "n", "left", F.xxhash64(F.lit(seed + 1), "doc_id", "size").alias("o"))
    picks = written(ordered.groupBy("_source_key").applyInPandas(lambda pdf: fit(pdf.sort_values(["o", "size"])), f"_k string, _id {id_type}, _size long"), "mix-picks")
    quotas = np.array([p[3] * p[4] + c[1] + (c[1] < p[4]) for p, c in zip(plan, cut)], np.int64)
    runs = split_quotas(quotas, shards, rng)
    # A source without a quota has one of 1 here, as it divides; its runs are empty.
    rows_ = [(*p[:7], c[1], max(1, int(q)), *_stride(int(q), rng), [int(x) for x in np.cumsum(s)]) for p, c, q, s in zip(plan, cut, quotas, runs)]
    schema = _PLAN.replace("remainder double", "cut long, quota long, draw_stride long, draw_shift long, shard_ends array<long>")
    return Mix(small(spark.createDataFrame(rows_, schema), len(rows_)), small(picks, picks.count()), seed)


def _drawn(df: DataFrame, mix: Mix, doc_id: str, text: str, source: str) -> DataFrame:
    """(row struct, mix_shard, mix_order) for each draw of each row of df."""
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_kept")
    rows = df.select(kept, F.col(doc_id).alias("doc_id"), _source_key(F.col(source)).alias("_source_key"), word_count(F.col(text)).alias("size"))
    drawn = mix.copies(rows).select("_kept", "doc_id", F.explode("draws").alias("d"))
    order = F.xxhash64(F.lit(mix.seed + 2), "d.shard", "doc_id", "d.copy")
    return drawn.select("_kept", F.col("d.shard").alias("mix_shard"), order.alias("mix_order"))


def mix_documents(df: DataFrame, mix: Mix, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of df as often as they are drawn, with mix_shard and mix_order: shards in order of mix_order are shuffled. Columns of df with these names give way."""
    drawn = _drawn(df, mix, doc_id, text, source)
    return drawn.select(*[F.col("_kept").getField(c).alias(c) for c in df.columns if c not in ("mix_shard", "mix_order")], "mix_shard", "mix_order")


def shuffled_mix(df: DataFrame, mix: Mix, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The drawn rows of df, with its columns, in order of shard and, within it, shuffled; each shard lies in PARTS partitions, which split its order evenly."""
    part = F.shiftrightunsigned(F.col("mix_order").bitwiseXOR(-(1 << 63)), 64 - PARTS.bit_length() + 1)
    ordered = _drawn(df, mix, doc_id, text, source).repartition("mix_shard", part).sortWithinPartitions("mix_shard", "mix_order")
    return ordered.select(*[F.col("_kept").getField(c).alias(c) for c in df.columns])


def sized_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return df.select(_source_key(F.col(source)).alias("_source_key"), F.col(doc_id).alias("doc_id"), word_count(F.col(text)).alias("size"))


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(sized_rows(table(spark, sf_dir, "documents")), "mix-rows")
    drawn = plan_mix(rows).copies(rows)
    shards = F.transform("draws", lambda d: d["shard"])
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), shards.alias("shards"))
