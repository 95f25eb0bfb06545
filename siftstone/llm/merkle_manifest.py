"""Merkle manifest of a dataset, with a proof of inclusion for each row.

A row's leaf is the hash of its columns. The leaves of a group, in order, are the lowest level of the group's tree; each run of
three nodes that follow one another becomes the hash of their hex digests, until one node is left, the group's subroot. The
subroots, in order of the groups, are the leaves of a tree of their own, whose last node is the root.

Bottom-up build: a pass joins FOLD levels, since 3 ** FOLD nodes that follow one another make a block that no run crosses. Blocks
and their levels are a table in the shared folder; their tops are the nodes of the next pass. Top-down proof push: from the top
tree down, each block that has inherited the proof of its top hands to each child that proof with the child's own siblings before
it. A block holds 3 ** FOLD nodes at most, so neither a hot group nor a large tree gathers rows in one task; what the driver sees
is the largest group's height and the root.

Places in a group come from a range partitioning by (group, order, leaf, place in the written table): a hot group, and rows that
are equal in all of these, spread over partitions. A place is the row's number in its partition, plus what the partitions before hold.

Defined results: a null column counts as `-`. Null order values come first, rows of equal order follow their leaves; equal
rows each have a leaf. Null groups form a group of their own, the first. A group of one row is its leaf; so is the root of one group.
An empty table gives no rows. Extra columns, whatever their names, are kept where they are asked for and otherwise ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.llm.common import crc32_of, discard, table, written

#: Nodes of a run, and levels that a pass joins.
RUN, FOLD = 3, 4
#: Rows of partition starts and of groups that are broadcast at most; beyond, the same joins are shuffled.
BROADCAST_ROWS = 100_000
NO_PROOF = "array<struct<before:array<string>,after:array<string>>>"


def H(parts: Column) -> Column:
    """Lowercase hex sha256 of an array's strings, one after the other."""
    return F.sha2(F.array_join(parts, "").cast("binary"), 256)


def leaf_of(columns: list[Column]) -> Column:
    """The hash of `-` for each null and of byte count, `:` and value for each other column."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]).cast("binary"), 256)


def _runs(level: Column) -> Column:
    """The hashes of a level's runs."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / RUN).cast("int")), lambda i: H(F.slice(level, i * RUN + 1, F.lit(RUN))))


def _steps(n: Column, most: int) -> Column:
    """Levels above n nodes, at most so many: the least k with RUN ** k >= n."""
    return reduce(lambda out, k: F.when(n > RUN**k, k + 1).otherwise(out), range(most), F.lit(0))


def _looked_up(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, keys)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (g, hash, kept and the order columns) as (g, hash, kept, pos, n): pos counts from 0 in each g, n is g's number of rows."""
    spread = rows.withColumn("_place", F.monotonically_increasing_id())
    by = ["g", *order, "hash", "_place"]
    # The id's upper bits are the partition, the lower ones the row in it.
    lying = written(spread.repartitionByRange(*by).sortWithinPartitions(*by).select("g", "hash", "kept", F.monotonically_increasing_id().alias("_id")), "merkle-order")
    part = F.shiftright("_id", 33).alias("_part")
    runs = lying.groupBy("g", part).agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("g")
    before = F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_rows")
    starts = written(runs.select("g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n")), "merkle-starts")
    return _looked_up(lying.withColumn("_part", part), starts, ["g", "_part"]).select("g", "hash", "kept", (F.col("_id") + F.col("_shift")).alias("pos"), "n")


def _blocks(nodes: DataFrame, fold: int) -> DataFrame:
    """nodes (g, pos, n, hash, kept) by blocks: (g, block, n, steps, nodes array<struct<hash, kept>>, l0 .. l<fold>), l0 being the nodes'
    hashes and each l the runs of the one before; levels above the group's top are null."""
    width = RUN**fold
    block = nodes.groupBy("g", F.floor(F.col("pos") / width).alias("block"), "n").agg(F.array_sort(F.collect_list(F.struct("pos", "hash", "kept")), lambda x, y: (x["pos"] - y["pos"]).cast("int")).alias("nodes"))
    block = block.withColumn("steps", _steps(F.col("n"), fold)).withColumn("l0", F.transform("nodes", lambda x: x["hash"]))
    for k in range(fold):
        block = block.withColumn(f"l{k + 1}", F.when(F.col("steps") > k, _runs(F.col(f"l{k}"))))
    return block


def _top(fold: int) -> Column:
    """The one node of a block's highest level."""
    return F.get(F.element_at(F.array(*[F.col(f"l{k}") for k in range(fold + 1)]), F.col("steps") + 1), F.lit(0))


def _siblings(at: Column, fold: int) -> Column:
    """What stands before and after the node's run member on each level of its block, from the lowest up."""

    def level(k: int) -> Column:
        place = F.floor(at / RUN**k).cast("int")
        inside = place % RUN
        here = F.col(f"l{k}")
        return F.when(F.col("steps") > k, F.struct(F.slice(here, place - inside + 1, inside).alias("before"), F.slice(here, place + 2, RUN - 1 - inside).alias("after")))

    return F.filter(F.array(*[level(k) for k in range(fold)]), lambda s: s.isNotNull())


def _tree(leaves: DataFrame, fold: int) -> tuple[list[DataFrame], DataFrame | None]:
    """The passes' block tables from the lowest up, and (g, subroot, turn): each group's last node and the pass that made it."""
    most = leaves.agg(F.max("n")).first()[0]
    passes, tops, nodes = [], [], leaves
    while most:
        passes.append(written(_blocks(nodes, fold), f"merkle-level{len(passes)}"))
        made = passes[-1].select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / RUN**fold).cast("long").alias("n"), _top(fold).alias("hash"), F.lit(None).cast("string").alias("kept"))
        tops.append(made.where("n = 1").select("g", F.col("hash").alias("subroot"), F.lit(len(passes) - 1).alias("turn")))
        nodes, most = made.where("n > 1"), -(-most // RUN**fold) if most > RUN**fold else 0
    return passes, reduce(DataFrame.unionAll, tops) if tops else None


def _pushed(passes: list[DataFrame], tops: DataFrame, fold: int) -> DataFrame:
    """(g, kept, hash, subroot, proof) of the lowest nodes. tops: (g, subroot, turn, proof), the proof being that of the subroot."""
    handed = None
    for turn in reversed(range(len(passes))):
        heads = tops.where(F.col("turn") == turn).select("g", F.lit(0).cast("long").alias("block"), "subroot", "proof")
        inherited = heads if handed is None else heads.unionByName(handed)
        opened = passes[turn].join(inherited, ["g", "block"]).select("*", F.posexplode("nodes").alias("at", "node"))
        proof = F.concat(_siblings(F.col("at"), fold), F.col("proof"))
        if turn == 0:
            return opened.select("g", "node.kept", "node.hash", "subroot", proof.alias("proof"))
        handed = written(opened.select("g", (F.col("block") * RUN**fold + F.col("at")).alias("block"), "subroot", proof.alias("proof")), f"merkle-proofs{turn}")
    raise ValueError("a tree has a pass at least")


def manifest(df: DataFrame, columns: list[str], group: str, order: str, keep: dict[str, Column] | None = None, fold: int = FOLD) -> DataFrame:
    """(the columns of keep, leaf, subroot, root, proof) of each row of df.

    columns enter the leaf in this order. proof has an entry for each level from the leaf up to the root, with the digests that stand before and after the
    row's node in its run; a run of one leaves both empty. keep: names and expressions over df to hand through, its columns named in `columns` by default.
    """
    keep = keep or {c: F.col(f"`{c}`") for c in columns}
    kept = F.struct(*[c.alias(f"k{n}") for n, c in enumerate(keep.values())])
    # Null groups first: "" is below "=" and whatever follows it.
    g = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = written(df.select(g.alias("g"), F.col(f"`{order}`").alias("o"), leaf_of([F.col(f"`{c}`") for c in columns]).alias("hash"), kept.alias("kept")), "merkle-leaves")
    passes, tops = _tree(written(numbered(leaves, ["o"]), "merkle-numbered"), fold)
    shape = lambda rows, root: rows.select(*[F.col("kept").getField(f"k{n}").alias(c) for n, c in enumerate(keep)], F.col("hash").alias("leaf"), "subroot", root.alias("root"), "proof")
    if tops is None:
        none = leaves.select("kept", "hash", F.lit(None).cast("string").alias("subroot"), F.array().cast(NO_PROOF).alias("proof"))
        return shape(none, F.lit(None).cast("string"))
    tops = written(tops, "merkle-subroots")
    above = numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("o"), F.col("subroot").alias("hash"), F.struct("g", "subroot", "turn").alias("kept")), ["o"])
    top_passes, top_roots = _tree(above, fold)
    top_roots = written(top_roots.withColumn("proof", F.array().cast(NO_PROOF)), "merkle-root")
    root = top_roots.first()["subroot"]
    subroots = written(_pushed(top_passes, top_roots, fold).select("kept.g", "kept.subroot", "kept.turn", "proof"), "merkle-subproofs")
    discard(leaves)
    return shape(_pushed(passes, subroots, fold), F.lit(root))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda node, s: H(F.concat(s["before"], F.array(node), s["after"])))


def proof_digest(proof: Column) -> Column:
    """H of all siblings of a proof, level by level, left to right."""
    return H(F.flatten(F.transform(proof, lambda s: F.concat(s["before"], s["after"]))))


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents by source. Where 2 divides the id's crc32, the text loses its line feeds before it is checked."""
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    cut = F.coalesce(crc32_of(F.col("doc_id")) % 2 == 0, F.lit(False)) & F.contains("text", F.lit("\n"))
    tampered = leaf_of([F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in columns])
    rows = manifest(docs.select(*columns), columns, "source", "doc_id", {"doc_id": F.col("doc_id"), "tampered": F.when(cut, tampered)})
    checked = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return checked.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _tree_sql(name: str, leaves: str) -> str:
    """<name>: the nodes (g, level, pos, h, n) of a tree for each g, from leaves (g, pos, h, n)."""
    return f"""{name}(g, level, pos, h, n) AS (
  SELECT g, 0, pos, h, n FROM {leaves}
  UNION ALL
  SELECT g, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, level, pos // 3, n
)"""


#: The trees level by level, the siblings by joins, the tampered leaves folded level by level.
OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS g, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS v,
    -- crc32 of the decimal id, bit by bit
    list_reduce([x::UBIGINT for x in [4294967295] || list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: unicode(c))],
      lambda a, b: list_reduce([xor(a, b)] || [0::UBIGINT for i in range(8)], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)) AS crc
  FROM documents
), l AS (
  SELECT doc_id, g, sha256(list_aggregate([CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END for x in v], 'string_agg', '')) AS leaf,
    CASE WHEN doc_id IS NULL OR xor(crc, 4294967295::UBIGINT) % 2 = 1 OR v[5] IS NULL THEN NULL
      ELSE sha256(list_aggregate([CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END for x in v[1:4] || [replace(v[5], chr(10), '')]], 'string_agg', '')) END AS tampered
  FROM d
), o AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l
), ol AS (SELECT g, pos, leaf AS h, n FROM o),
{_tree_sql("t", "ol")}, s AS (
  SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, h, count(*) OVER () AS n, g AS of, level AS height FROM t WHERE n = 1
), sl AS (SELECT g, pos, h, n FROM s),
{_tree_sql("top", "sl")}, root AS (SELECT h AS root, level AS height FROM top WHERE n = 1),
runs AS (
  SELECT o.g, o.pos AS leaf_pos, lv.level, lv.of_top, lv.place FROM o JOIN s ON s.of = o.g, root,
    LATERAL (SELECT i AS level, i >= s.height AS of_top, CASE WHEN i < s.height THEN o.pos // (3 ** i)::BIGINT ELSE s.pos // (3 ** (i - s.height))::BIGINT END AS place FROM range(s.height + root.height) r(i)) lv
), sides AS (
  SELECT runs.g, leaf_pos, runs.level, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < place), '') AS before, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > place), '') AS after
  FROM runs JOIN s ON s.of = runs.g
    JOIN (SELECT g, level, pos, h, false AS of_top FROM t UNION ALL SELECT NULL, level, pos, h, true FROM top) x
      ON x.of_top = runs.of_top AND (x.g = runs.g OR runs.of_top) AND x.level = CASE WHEN runs.of_top THEN runs.level - s.height ELSE runs.level END AND x.pos // 3 = place // 3
  GROUP BY ALL
), proofs AS (SELECT g, leaf_pos, sha256(string_agg(before || after, '' ORDER BY level)) AS proof_sha256 FROM sides GROUP BY ALL),
folding(g, leaf_pos, level, h) AS (
  SELECT g, pos, 0, coalesce(tampered, leaf) FROM o
  UNION ALL
  SELECT f.g, f.leaf_pos, f.level + 1, sha256(before || h || after) FROM folding f JOIN sides x ON x.g = f.g AND x.leaf_pos = f.leaf_pos AND x.level = f.level
)
SELECT doc_id, leaf, s.h AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM o JOIN s ON s.of = o.g CROSS JOIN root LEFT JOIN proofs p ON p.g = o.g AND p.leaf_pos = o.pos
  JOIN folding f ON f.g = o.g AND f.leaf_pos = o.pos AND f.level = s.height + root.height
"""
