"""N-gram Jaccard join by prefix trees: the exact components of documents whose word n-gram sets are similar.

1. Each text becomes its set of distinct n-gram hashes (64 bit). Documents of equal sets form a class (128-bit hash
   of the set); from here on there is one set a class, so copies cost nothing.
2. A global order of n-grams: those with low hashes first, and of these the rare ones (by number of classes) first; the
   others by hash. Similar sets must share one of their first n - ceil(t n) + 1 n-grams. N-grams of one class only
   meet nothing, so a class enters with the shared ones of its beginning; most classes have none and are done. The whole sets
   of the others are fetched, and the same is done with all their n-grams, ordered by rarity among them, which leaves
   beginnings that little but near copies share.
3. Classes that share such an n-gram are a group; groups of the same classes count once. The ordered beginnings of a group
   go into a prefix tree. Each class traverses it, shares the overlap of common paths, and leaves a subtree when the
   n-grams that remain can't bring the overlap up to t, or when a smaller common n-gram has the pair in its own group.
   A first pass finds the classes that have a partner; only they come with their whole sets to a second pass, which compares
   exactly and joins components as it goes; a subtree that lies in one component with the traversing class is left.
4. A group of more than BLOCK classes is dealt into blocks by size and hash, as similar sets are of similar size. Blocks are
   joined in themselves, under two ways of dealing, and the links make components; what is left are pairs of blocks
   of neighbouring sizes that still hold several components, and they meet in cells of two blocks. So no task holds an unbounded group,
   and a cluster of near copies costs what its tree costs.

All links between different components are found, as every similar pair shares an entry of step 2, and all come from the trees.

A null or blank text has an empty set, links with nothing and is its own component. A text of fewer than n words has
one n-gram, the whole sequence. Documents without an id have no component. Rows that share an id are documents of their
own with the same id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm.common import arrow_rows, discard, table, written
from siftstone.llm.components import connected_components

#: Share of the hashes that count as low.
LOW_SHARE = 0.25
#: An order key is the number of classes and the lowest bits of the hash. For a hash that isn't low it is the largest value and the highest
#: bits, as these n-grams are chosen by hash: keys have to sort as beginnings are chosen, or bounds on what lies beyond them don't hold.
KEY_BITS, NOT_LOW = 43, (1 << 20) - 1
#: Classes and n-grams of a block; words a worker remembers; rows of a broadcast.
BLOCK, BLOCK_GRAMS, MEMO_WORDS, BROADCAST_ROWS = 512, 1 << 19, 100_000, 100_000


class NgramHasher:
    """Texts to sorted arrays of distinct n-gram hashes."""

    def __init__(self, words: int):
        self.words = words
        self.multipliers = np.array([xxhash.xxh3_64_intdigest(f"word {i}") | 1 for i in range(words)], np.uint64)
        self.memo = _WordCodes()

    def __call__(self, text: bytes | None) -> np.ndarray:
        tokens = text.lower().split() if text else []
        if not tokens:
            return np.zeros(0, np.uint64)
        if len(tokens) < self.words:
            return np.array([xxhash.xxh3_64_intdigest(b"\x20".join(tokens))], np.uint64)
        codes = np.fromiter(map(self.memo.__getitem__, tokens), np.uint64, len(tokens))
        n = len(codes) - self.words + 1
        h = np.zeros(n, np.uint64)
        for i in range(self.words):
            h += codes[i : i + n] * self.multipliers[i]
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0x9E3779B97F4A7C15)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(factor)
        return np.unique(h ^ (h >> np.uint64(32)))


class _WordCodes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch["text"].cast(pa.binary()).to_pylist()


def _beginning(n, percent: int):
    """Number of n-grams of which similar sets share one."""
    return n - (n * percent + 99) // 100 + 1


def _signer(words: int, percent: int):
    """(doc_id, n, n_low, fp, tokens): the set's size, its low hashes' number, its 128-bit hash, and the low hashes with as many others as a beginning needs."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, limit = NgramHasher(words), np.uint64(int(LOW_SHARE * 2.0**64))
        for batch in batches:
            size, low, fp, tokens, lens = [], [], [], [], [0]
            for s in map(hasher, _texts(batch)):
                n = len(s)
                size.append(n)
                low.append(int(np.searchsorted(s, limit)))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if n else None)
                tokens.append((s[: max(low[-1], _beginning(n, percent) if n else 0)] >> np.uint64(1)).astype(np.int64))
                lens.append(len(tokens[-1]))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lens), pa.int32()), pa.array(np.concatenate(tokens) if tokens else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(size, pa.int32()), pa.array(low, pa.int32()), pa.array(fp, pa.binary()), lists], ["doc_id", "n", "n_low", "fp", "tokens"])

    return sign


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str], members: str, total: int) -> DataFrame:
    """rows joined with their groups (keys, members). Groups of more than 1 / BROADCAST_ROWS of all rows are fewer than that and are broadcast, so no group's rows meet in one task."""
    big = max(BLOCK, total // BROADCAST_ROWS)
    hot = groups.where(F.col(members) > big)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(F.col(members) <= big), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def _beginnings(classes: DataFrame, percent: int, share: float) -> DataFrame:
    """(cid, n, own, keys) of classes (cid, n, n_low, tokens) with shared n-grams in their beginning: these in order, and the number of n-grams that are surely theirs alone."""
    tokens = classes.select("cid", F.explode("tokens").alias("token"))
    shared = written(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    met = _joined(tokens, shared, ["token"], "df", classes.agg(F.sum(F.size("tokens"))).first()[0] or 0)
    low = F.col("token") < (int(share * 2.0**64) >> 1) if share < 1 else F.lit(True)
    rarity = F.when(low, F.least("df", F.lit(NOT_LOW - 1))).otherwise(F.lit(NOT_LOW)).cast("long")
    bits = F.when(low, F.col("token").bitwiseAND((1 << KEY_BITS) - 1)).otherwise(F.shiftright("token", 63 - KEY_BITS))
    key = F.shiftleft(rarity, KEY_BITS).bitwiseOR(bits)
    by_class = met.select("cid", key.alias("key")).groupBy("cid").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    shared_low = F.size(F.filter("keys", lambda k: k < (NOT_LOW << KEY_BITS)))
    first = F.col("n") - F.floor((F.col("n") * percent + 99) / 100).cast("int") + 1
    sized = by_class.join(classes.select("cid", "n", "n_low"), "cid").withColumn("own", F.col("n_low") - shared_low)
    taken = F.when(F.col("n_low") < first, F.col("keys")).otherwise(F.slice("keys", F.lit(1), F.greatest(F.lit(0), first - F.col("own"))))
    begun = written(sized.select("cid", "n", "own", taken.alias("keys")).where(F.size("keys") > 0), "beginnings")
    discard(shared)
    return begun


# --- whole sets ------------------------------------------------------------------------------------------------


def _setter(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = NgramHasher(words)
        for batch in batches:
            found = list(map(hasher, _texts(batch)))
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            grams = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), grams], ["fp", "grams"])

    return sets


def _whole_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(cid, grams) of each wanted class, from the texts of its first document's id."""
    ids = written(wanted.select("cid").join(classes.select("cid", "fp", "rep"), "cid").select(F.col("rep").alias("doc_id"), "fp", "cid"), "wanted")
    chosen = ids.select("doc_id").distinct()
    texts = docs.join(F.broadcast(chosen) if ids.count() <= BROADCAST_ROWS else chosen, "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(_setter(words), "fp binary, grams array<long>")
    # Rows that share an id give sets that weren't asked for, and copies the same set again.
    return written(sets.join(ids.select("fp", "cid"), "fp").groupBy("cid").agg(F.first("grams").alias("grams")), "grams")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * overlap >= percent * union, of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


# --- the prefix tree -------------------------------------------------------------------------------------------


class _Node:
    """A run of n-grams, and of the rows below: the least size and the most n-grams that aren't a row's own."""

    __slots__ = ("children", "edge", "leaves", "least", "most", "one")

    def __init__(self, edge: list[int], leaves: list[int], least: int, most: int):
        self.edge, self.leaves, self.least, self.most = edge, leaves, least, most
        self.children: list[_Node] = []
        self.one = -1  # a row of the component of all rows below, once they are known to be of one


class PrefixTree:
    """Ordered beginnings of sets."""

    def __init__(self, beginnings: list[list[int]], sizes: list[int], own: list[int], percent: int):
        self.beginnings, self.sizes, self.own, self.percent = beginnings, sizes, own, percent
        self.left = [n - o for n, o in zip(sizes, own)]
        order = sorted(range(len(beginnings)), key=beginnings.__getitem__)
        self.root, todo = None, [(0, len(order), 0, None)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            first, last = beginnings[order[lo]], beginnings[order[hi - 1]]
            end, most = depth, min(len(first), len(last))
            while end < most and first[end] == last[end]:
                end += 1
            start = lo
            while start < hi and len(beginnings[order[start]]) == end:
                start += 1
            below = order[lo:hi]
            node = _Node(first[depth:end], order[lo:start], min(map(sizes.__getitem__, below)), max(map(self.left.__getitem__, below)))
            if parent is None:
                self.root = node
            else:
                parent.children.append(node)
            for k in range(start + 1, hi + 1):
                if k == hi or beginnings[order[k]][end] != beginnings[order[start]][end]:
                    todo.append((start, k, end, node))
                    start = k

    def partners(self, row: int, token: int, done=None) -> Iterator[int]:
        """Rows of the tree, this one too, that may be similar to a row, and whose first common n-gram is token. Subtrees for which done(node) holds are left."""
        x, n, t = self.beginnings[row], self.sizes[row], self.percent
        there, last, free = set(x), x[-1], n - self.own[row]
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, path = stack.pop()
            if done and done(node):
                continue
            only_x = only_y = 0
            edge = node.edge
            if edge:
                common = [k for k in edge if k in there]
                if common and not overlap and common[0] != token:
                    continue
                overlap += len(common)
                path += len(edge) if edge[-1] <= last else bisect_right(edge, last)
                # N-grams up to the end of the other's beginning that only one side shows aren't in the other set.
                only_x, only_y = bisect_right(x, edge[-1]) - overlap, path - overlap
            at_most = min(free - only_x, node.most - only_y)
            if 100 * at_most < t * (n + node.least - at_most):
                continue
            for i in node.leaves:
                both = min(free - only_x, self.left[i] - only_y)
                if 100 * both >= t * (n + self.sizes[i] - both):
                    yield i
            stack += [(c, overlap, path) for c in node.children]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(token, low, high) and the rows (block, cid, n, own, label, keys[, grams]) of each run of rows with that key."""
    held, key = [], None
    for batch in batches:
        keys = zip(*(batch[c].to_pylist() for c in ("token", "low", "high")))
        cols = [batch[c].to_pylist() for c in ("block", "cid", "n", "own", "label")]
        lists, grams = batch["keys"], batch["grams"] if "grams" in batch.schema.names else None
        for r, k in enumerate(keys):
            if k != key and held:
                yield key, held
                held = []
            key = k
            whole = () if grams is None else (np.array(grams[r].values, np.int64).view(np.uint64),)
            held.append((*(c[r] for c in cols), lists[r].as_py(), *whole))
    if held:
        yield key, held


def _tree(rows: list[tuple], percent: int) -> PrefixTree:
    return PrefixTree([r[5] for r in rows], [r[2] for r in rows], [r[3] for r in rows], percent)


def _meet(x: tuple, y: tuple, low: int, high: int) -> bool:
    """Whether two rows of a cell are to be compared: rows of one block have met in that block's own cell."""
    return low == high or x[0] != y[0]


class _Union:
    """Components of a cell's rows, by their labels."""

    def __init__(self, rows: list[tuple]):
        first: dict[int, int] = {}
        self.root = [first.setdefault(r[4], i) for i, r in enumerate(rows)]
        self.parts = len(first)

    def of(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.root[j], self.parts = i, self.parts - 1

    def done(self, i: int):
        """Whether all rows below a node are known to be of row i's component: nodes learn it from their children, bottom up with each visit."""

        def known(node: _Node) -> bool:
            if node.one < 0:
                below = {self.of(k) for k in node.leaves} | {self.of(c.one) if c.one >= 0 else -1 for c in node.children}
                if len(below) == 1:
                    node.one = below.pop()
            return node.one >= 0 and self.of(node.one) == self.of(i)

        return known


_MEMBER = ("token", "low", "high", "block", "cid", "label")


def _tree_members(percent: int):
    """The rows that have a possible partner in another component: as many at most as came."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (token, low, high), rows in _cells(batches):
            parts = _Union(rows)
            if parts.parts == 1:
                continue
            tree, found = _tree(rows, percent), set()
            usual, times = Counter(r[4] for r in rows).most_common(1)[0]
            waits = 2 * times > len(rows)
            for i, row in enumerate(rows):
                # The rows of a component that holds most of them wait to be found; others are content with one partner, or look for their own.
                if row[4] == usual if waits else i in found:
                    continue
                for j in tree.partners(i, token, parts.done(i) if parts.parts < len(rows) else None):
                    if rows[j][4] != row[4] and _meet(row, rows[j], low, high):
                        found |= {i, j}
                        if not waits:
                            break
            if found:
                kept = [rows[i] for i in sorted(found)]
                n = len(kept)
                cols = [[token] * n, [low] * n, [high] * n, [r[0] for r in kept], [r[1] for r in kept], [r[4] for r in kept]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], list(_MEMBER))

    return members


def _tree_join(percent: int):
    """Exact links, as many as join what is similar in a cell. Components grow with the links; pairs within one aren't compared."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (token, low, high), rows in _cells(batches):
            parts, tree, found, tried = _Union(rows), _tree(rows, percent), [], set()
            for i, row in enumerate(rows):
                if parts.parts == 1:
                    break
                for j in tree.partners(i, token, parts.done(i)):
                    here, there = parts.of(i), parts.of(j)
                    if here == there or not _meet(row, rows[j], low, high) or (j, i) in tried:
                        continue
                    if similar(row[6], rows[j][6], percent):
                        parts.join(here, there)
                        found.append(sorted((row[1], rows[j][1])))
                    else:
                        tried.add((i, j))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return join


# --- groups, blocks and cells ----------------------------------------------------------------------------------


def _labelled(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return entries.withColumn("label", F.col("cid"))
    return entries.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def _kind(percent: int) -> Column:
    """Number of a size class: sizes of similar sets are of the same or of neighbouring ones."""
    ratio = max(100 / percent, 1.01) * (1 + 1e-9)
    return F.floor(F.log("n") / math.log(ratio)).cast("long")


def _blocks(rows: DataFrame, percent: int, total: int) -> DataFrame:
    """Rows (token, cid, n) of large groups with kind, and parts, the number of blocks of that kind."""
    kinds = rows.withColumn("kind", _kind(percent))
    sizes = kinds.groupBy("token", "kind").agg(F.count("*").alias("members"), F.sum("n").alias("grams"))
    parts = F.greatest(F.ceil(F.col("members") / BLOCK), F.least("members", F.ceil(F.col("grams") / BLOCK_GRAMS)))
    return _joined(kinds, sizes.select("token", "kind", "members", parts.alias("parts")), ["token", "kind"], "members", total).drop("members")


def _block(deal: int) -> Column:
    """Number of a row's block under the deal-th way of dealing; its upper bits are the kind."""
    return F.shiftleft("kind", 40).bitwiseOR(F.pmod(F.xxhash64("cid", F.lit(deal)), F.col("parts")))


def _open_cells(blocked: DataFrame) -> DataFrame:
    """Rows (.., label, block) once for each pair of blocks of a group, of the same or neighbouring kinds, that hold several components."""
    spans = blocked.groupBy("token", "block").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    left = spans.select("token", F.col("block").alias("low"), F.col("least").alias("l1"), F.col("most").alias("m1"))
    right = spans.select("token", F.col("block").alias("high"), F.col("least").alias("l2"), F.col("most").alias("m2"))
    near = F.shiftright("high", 40) - F.shiftright("low", 40) <= 1
    pairs = left.join(right, "token").where((F.col("low") < F.col("high")) & near & (F.least("l1", "l2") < F.greatest("m1", "m2")))
    sides = pairs.select("token", "low", "high", F.explode(F.array("low", "high")).alias("block"))
    return blocked.join(sides, ["token", "block"])


def _links(cells: DataFrame, begun: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The links that the trees of cells (token, low, high, block, cid, label) give."""
    keys = ["token", "low", "high"]
    together = lambda df: df.repartition(*keys).sortWithinPartitions(*keys)
    rows = together(cells.select(*_MEMBER).join(begun, "cid"))
    members = written(rows.mapInArrow(_tree_members(percent), ", ".join(f"{c} long" for c in _MEMBER)), "members")
    whole = together(members.join(begun, "cid").join(grams, "cid"))
    found = written(whole.mapInArrow(_tree_join(percent), "a long, b long"), "similar")
    discard(members)
    return found


def _tree_links(begun: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all classes with similar sets."""
    total = begun.agg(F.sum(F.size("keys"))).first()[0] or 0
    entries = begun.select("cid", "n", F.explode("keys").alias("token"))
    stats = entries.groupBy("token").agg(
        F.count("*").alias("members"), F.sum("n").alias("grams"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("of"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("of_too")
    )
    groups = written(stats.where("members > 1").groupBy("members", "grams", "of", "of_too").agg(F.min("token").alias("token")).select("token", "members", "grams"), "groups")
    rows = written(_joined(entries, groups, ["token"], "members", total), "entries")
    large = (F.col("members") > BLOCK) | (F.col("grams") > BLOCK_GRAMS)
    large_rows = rows.where(large).select("token", "cid", "n")
    none = F.lit(0).cast("long")
    cells = _labelled(rows.where(~large), None).select("token", none.alias("low"), none.alias("high"), none.alias("block"), "cid", "label")
    if not groups.where(large).limit(1).count():
        return _links(cells, begun, grams, percent)

    blocked = written(_blocks(large_rows, percent, total), "blocks")
    within = lambda deal, labels: _labelled(blocked, labels).withColumn("block", _block(deal)).select("token", F.col("block").alias("low"), F.col("block").alias("high"), "block", "cid", "label")
    links = [_links(cells.unionByName(within(0, None)), begun, grams, percent)]
    links.append(_links(within(1, connected_components(links[0])), begun, grams, percent))
    labels = connected_components(reduce(DataFrame.unionAll, links))
    across = _open_cells(written(_labelled(blocked, labels).withColumn("block", _block(0)).select("token", "cid", "label", "block"), "labelled"))
    links.append(_links(across, begun, grams, percent))
    return reduce(DataFrame.unionAll, links)


# --- all together ----------------------------------------------------------------------------------------------


def _components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, fp, component_id) of each row of (doc_id, text)."""
    arrow_rows(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = written(docs.mapInArrow(_signer(words, percent), f"doc_id {id_type}, n int, n_low int, fp binary, tokens array<long>"), "signed")
    # Rows of the same fp have the same n, n_low and tokens.
    same = [F.first(c).alias(c) for c in ("n", "n_low", "tokens")]
    classes = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *same)
    sets = written(classes.withColumn("cid", F.monotonically_increasing_id()), "sets")
    ids = written(signed.select("doc_id", "n", "fp"), "ids")
    discard(signed)
    some = _beginnings(sets, percent, LOW_SHARE)
    classes = written(sets.select("cid", "fp", "rep", "copies"), "classes")
    discard(sets)
    grams = _whole_sets(some, classes, docs, words)
    tokens = F.transform("grams", lambda g: F.shiftrightunsigned(g, 1))
    begun = _beginnings(grams.select("cid", F.size("grams").alias("n"), F.size("grams").alias("n_low"), tokens.alias("tokens")), percent, 1.0)
    labels = connected_components(_tree_links(begun, grams, percent))
    named = labels.join(classes.select(F.col("cid").alias("node"), "rep"), "node")
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    linked = named.join(smallest, "label").select(F.col("node").alias("cid"), "component_id")
    by_fp = classes.join(linked, "cid", "left").select("fp", "copies", F.coalesce("component_id", "rep").alias("component_id"))
    there = F.col("n") > 0
    known = there & F.col("doc_id").isNotNull()
    total = classes.agg(F.sum("copies")).first()[0] or 0
    of_sets = _joined(ids.where(known), by_fp, ["fp"], "copies", total).select("doc_id", "n", "fp", "component_id")
    alone = ids.where(~known).select("doc_id", "n", "fp", F.col("doc_id").alias("component_id"))
    return of_sets.unionByName(alone)


def ngram_components(df: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles long, component_id) of each row: component_id is the smallest id that similar sets connect it with."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _components(docs, words, percent).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(df: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df whose id is the smallest of their component, one row an id; rows without an id stay as they are.

    Rows that share an id are judged by their own sets: those whose component has a smaller id go. Of the rest of an id the row with the smallest text stays.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = written(_components(docs, words, percent), "components")
    known = found.where("doc_id IS NOT NULL")
    # Ids are few enough to broadcast, or both sides are dealt by id.
    small = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    shared = written(known.groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id"), "shared-ids")
    goes = written(known.where("component_id <> doc_id").select(F.col("doc_id").alias("_id")).distinct(), "gone")
    if not shared.limit(1).count():
        return df.join(small(goes), df[doc_id] == goes["_id"], "left_anti")
    names = df.columns
    several = df.join(small(shared), df[doc_id] == shared["_id"], "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = several.mapInArrow(_row_signer(words), several.withColumn("fp", F.lit(b"")).schema)
    stays = known.where("component_id = doc_id").select(F.col("doc_id").alias("_id"), F.coalesce("fp", F.lit(b"")).alias("_fp")).distinct()
    kept = signed.join(small(stays), (F.col("doc_id") == F.col("_id")) & (F.col("fp") == F.col("_fp")), "left_semi")
    one = kept.groupBy("doc_id").agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    judged = written(goes.unionAll(shared).distinct(), "judged")
    single = df.join(small(judged), df[doc_id] == judged["_id"], "left_anti")
    return single.unionByName(one)


def _row_signer(words: int):
    """Rows with the 128-bit hash of their set, empty for an empty one."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = NgramHasher(words)
        for batch in batches:
            sets = map(hasher, _texts(batch))
            yield batch.append_column("fp", pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"" for s in sets], pa.binary()))

    return sign


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), words=4, percent=85)


#: All pairs that share an n-gram, compared; components by the closure of the links.
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM g
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), c AS (
  SELECT doc_id, doc_id AS r FROM g UNION SELECT p.b, c.r FROM c JOIN p ON p.a = c.doc_id
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM g JOIN (SELECT doc_id, min(r) AS component_id FROM c GROUP BY doc_id) USING (doc_id)
"""
