"""Sharding by extendible hashing, in Spark expressions only.

Each row has a 60-bit hash; a bucket is the set of rows that share a prefix of it. Starting from the empty prefix, only
buckets over the byte limit split on the next bit, so a shard is the shortest prefix whose rows fit the limit. A round
splits the open buckets, and them alone, by up to STEP bits: their rows are summed by cells of STEP more bits, the sums are added up
along the prefixes, and buckets that fit leave with their entry of the directory. The rows of the others go to the next round.

A row's bytes are those of its text, 0 for null. Whole repeated rows (same id and text) are numbered, and the hash is that of
id, digest of the text and number, so repeated ids and repeated rows split as well. Numbers are dealt by partition of the input, each
with an offset, so many copies of a row never meet in one task. A single row over the
limit is a shard of its own. A null id is an id of its own kind. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.llm.common import table, written

#: Bytes of a shard in production, and of the query, whose smallest tables hold half a megabyte.
SHARD_BYTES, QUERY_BYTES = 32 << 20, 32 << 10
BITS, STEP, DIRECTORY_ROWS = 60, 8, 100_000


def _cell(depth: int) -> Column:
    """The leading bits of the hash, as a number."""
    return F.shiftright("h", BITS - depth) if depth else F.lit(0).cast("long")


def _directory(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(cell, depth, prefix, shard_bytes, shard_rows) of each cell of depth `high`: its shortest prefix of at least `low` bits that fits; depth null where none does."""
    cells = rows.groupBy(_cell(high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    by_depth = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    sums = by_depth.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == BITS)
    leaf = F.min(F.when(fits, F.struct("depth", "prefix", "shard_bytes", "shard_rows")))
    return by_depth.select("cell", "depth", "prefix").join(sums, ["depth", "prefix"]).groupBy("cell").agg(leaf.alias("leaf")).select("cell", "leaf.*")


def _numbered(sized: DataFrame) -> DataFrame:
    """Rows (id, digest, ..) with copy, their number among those of the same id and digest."""
    rows = written(sized.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "shard-sized")
    key = ["id", "digest"]
    repeated = written(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "shard-repeated")
    few = repeated.limit(DIRECTORY_ROWS + 1).count()
    if not few:
        return rows.withColumn("copy", F.lit(1)).drop("part", "seq")
    # A key has a row for each partition of the input here, and one alone in the window.
    repeated = F.broadcast(repeated) if few <= DIRECTORY_ROWS else repeated
    some = rows.join(repeated, key, "left_semi")
    by_part = some.groupBy(*key, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_part.select(*key, "part", F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy(*key, "part").orderBy("seq"))
    numbered = some.withColumn("within", within).join(offsets, [*key, "part"]).withColumn("copy", (F.col("within") + F.col("offset")).cast("int")).drop("within", "offset")
    return rows.join(repeated, key, "left_anti").withColumn("copy", F.lit(1)).unionByName(numbered).drop("part", "seq")


def _keyed(df: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    """(id, digest, bytes, doc_id, .., copy) of each row."""
    key = F.when(F.col(doc_id).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(doc_id).cast("string")))
    size, digest = F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit(""))
    return _numbered(df.select(key.alias("id"), digest.alias("digest"), size.alias("bytes"), F.col(doc_id).alias("doc_id"), *more))


def _shards(df: DataFrame, limit: int, doc_id: str, text: str) -> DataFrame:
    key = F.concat_ws(":", "id", "digest", F.col("copy").cast("string"))
    h = F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    rows = rest = written(_keyed(df, doc_id, text).withColumn("h", h), "shard-rows")
    done, low, high = [], 0, STEP
    while True:
        directory = written(_directory(rest, low, high, limit), "shard-directory")
        n, open_cells = directory.agg(F.count("*"), F.count_if(F.col("depth").isNull())).first()
        small = F.broadcast(directory) if n <= DIRECTORY_ROWS else directory
        placed = rest.withColumn("cell", _cell(high)).join(small, "cell").drop("cell")
        done.append(placed.where(F.col("depth").isNotNull()))
        if not open_cells:
            return reduce(DataFrame.unionByName, done)
        rest = written(placed.where(F.col("depth").isNull()).select(*rows.columns), "shard-rest")
        low, high = high + 1, min(BITS, high + STEP)


def assign_shards(df: DataFrame, limit: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, copy, bytes, depth, prefix, shard_bytes, shard_rows) of each row of df; (depth, prefix) names the shard."""
    return _shards(df, limit, doc_id, text).select("doc_id", "copy", "bytes", "depth", "prefix", "shard_bytes", "shard_rows")


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), QUERY_BYTES)


def op2_sql(source: str = "documents", limit: int = QUERY_BYTES) -> str:
    return f"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || doc_id::VARCHAR, 'n') AS id, coalesce(strlen(text), 0) AS bytes, coalesce(md5(text), '') AS digest FROM {source}
), hashed AS (
  SELECT *, ('0x' || substr(md5(id || ':' || digest || ':' || copy), 1, 15))::BIGINT AS h
  FROM (SELECT *, row_number() OVER (PARTITION BY id, digest) AS copy FROM sized)
), buckets AS (
  SELECT d AS depth, h >> (60 - d) AS prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
  FROM hashed, range(0, 61) r(d) GROUP BY ALL
), fits AS (
  SELECT * FROM buckets WHERE shard_bytes <= {limit} OR shard_rows = 1 OR depth = 60
)
SELECT doc_id, copy::INT AS copy, bytes::BIGINT AS bytes, depth::INT AS depth, prefix, shard_bytes, shard_rows
FROM hashed JOIN fits ON fits.prefix = h >> (60 - depth)
QUALIFY row_number() OVER (PARTITION BY id, digest, copy ORDER BY depth) = 1
"""


def write_shards(df: DataFrame, path: str, limit: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes df below path as one folder a shard. Rows reach their shard's writers by (depth, prefix)."""
    names = df.columns
    at = _shards(df, limit, doc_id, text).select("id", "digest", "copy", "depth", "prefix")
    rows = _keyed(df, doc_id, text, F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    joined = rows.join(at, ["id", "digest", "copy"]).select("row.*", "depth", "prefix")
    joined.repartition("depth", "prefix").write.partitionBy("depth", "prefix").parquet(path)
