"""Exact top k of summed impacts for many queries at once, without scoring every document that holds a term.

An impact is what a term of a field adds to a document's score in it; a score is the sum over a query's terms in a field, a document's score that of its
best field. Documents of like length in a field make a zone, as length decides how large impacts can be; zones are cut into blocks. A term has a bound in
each zone, its largest impact there, and a largest impact in each block.

Each query has a bar: the k best documents among the k largest impacts of its terms, scored in full, give a score that k documents reach.

Few queries (MOST_TERMS terms in all, which then travel to the tasks): a task takes the impacts of a block. A query whose terms' largest impacts there don't reach its bar
together leaves the block unscored; for the others the block's documents are summed up and those that reach the bar leave the task, its k best of the block at most, with ties.

Many queries: cells of a slice of the queries and a share of the blocks, each a group of bounded size that both sides are shuffled to (_in_cells()). In a cell the documents of a
zone are taken in the order of their ids, some at a time (a piece). Queries with the same terms in a piece are scored there together, and a query leaves a piece out whose
largest impacts can't reach its bar, or can only tie with k documents of smaller ids. Bars rise as documents are found. A cell gives a query k documents, and those within the slack of
the last: what leaves it grows with the queries times k, whatever ties or frequent terms there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.sources.tables import materialised

#: Documents of a block, about; zones a doubling of the length; bits of a block's number within its zone.
BLOCK_ROWS, ZONES, BLOCK_BITS = 256, 2, 32
#: Query terms that travel to the tasks at most.
MOST_TERMS = 200_000
#: Query terms and impacts of a cell, about, and cells at least; documents of a piece; scores and impacts that are summed up at once; rows that a cell collects before it cuts them.
SLICE_TERMS, SHARE_ROWS, CELLS, PIECE_ROWS, AT_ONCE, PENDING = 200_000, 1_000_000, 64, 1024, 2_000_000, 200_000


def block_of(field_no: Column, length: Column, chunk_id: Column, n_docs: Column) -> Column:
    """The number of a document's block: field, zone by length, and a hash for zones of many documents."""
    zone = F.least(F.lit(63), F.floor(ZONES * F.log2(F.greatest(F.lit(1), length))).cast("int"))
    within = F.pmod(F.xxhash64(chunk_id), F.ceil(n_docs / (4 * BLOCK_ROWS)).cast("long"))
    return F.shiftleft((field_no * 64 + zone).cast("long"), BLOCK_BITS) + within


def _zone(block: Column | str) -> Column:
    return F.shiftright(block, BLOCK_BITS)


def _field(zone: Column | str) -> Column:
    return F.shiftright(zone, 6)


def _full(pairs: DataFrame, impacts: DataFrame) -> DataFrame:
    """(query_id, field, chunk_id, s): the sums over pairs (query_id, t, chunk_id)."""
    found = pairs.join(impacts.select("t", "chunk_id", "blk", "part"), ["t", "chunk_id"])
    return found.groupBy("query_id", _field(_zone("blk")).alias("field"), "chunk_id").agg(F.sum("part").alias("s"))


def topk(impacts: DataFrame, terms: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score): each query's k best documents, with all that share the last place and some below it.

    impacts: (t, blk, chunk_id, part), a table that is read several times: t numbers a term of a field, blk is block_of(), parts are above 0. terms: (query_id, t), each once. With
    digits, scores are rounded.
    """
    slack = 10.0 ** -(digits if digits is not None else 9)
    zoned = impacts.withColumn("zone", _zone("blk"))
    best = Window.partitionBy("t").orderBy(F.desc("part"), "chunk_id")
    champions = zoned.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("t", _field("zone").alias("field"), "chunk_id", "part")
    met = terms.join(champions, "t").groupBy("query_id", "field", "chunk_id").agg(F.sum("part").alias("s")).groupBy("query_id", "chunk_id").agg(F.max("s").alias("s"))
    seeds = met.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "chunk_id"))).where(F.col("n") <= k)
    reached = _full(seeds.select("query_id", "chunk_id").join(terms, "query_id"), impacts).groupBy("query_id", "chunk_id").agg(F.max("s").alias("s"))
    bars = reached.groupBy("query_id").agg(F.min("s").alias("bar"), F.count("*").alias("n")).where(F.col("n") == k).select("query_id", (F.col("bar") - 2 * slack).alias("bar"))
    small = terms.count() <= MOST_TERMS
    sums = _in_blocks(impacts, terms, bars, k, slack) if small else _in_cells(impacts, terms, bars, k, slack)
    score = F.max("s") if digits is None else F.round(F.max("s"), digits)
    return sums.groupBy("query_id", "chunk_id").agg(score.alias("score"))


def _in_blocks(impacts: DataFrame, terms: DataFrame, bars: DataFrame, k: int, slack: float) -> DataFrame:
    """(query_id, chunk_id, s) of the documents that reach a query's bar, scored block by block."""
    asked = terms.join(bars, "query_id", "left").select("query_id", "t", F.coalesce("bar", F.lit(0.0)).alias("bar")).orderBy("query_id", "t").toArrow().combine_chunks()
    t = asked["t"].to_numpy()
    whose = asked["query_id"].combine_chunks() if len(asked) else pa.array([], asked["query_id"].type)
    number = whose.dictionary_encode()
    ids, number = number.dictionary, number.indices.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else np.zeros(0, int)
    last, bar = np.append(first[1:], len(number)), asked["bar"].to_numpy()[first]

    def score(block: pa.Table) -> pa.Table:
        of, at = np.unique(np.asarray(block["t"]), return_inverse=True)
        order = np.argsort(at, kind="stable")
        part, chunks = block["part"].to_numpy()[order], block["chunk_id"].combine_chunks().dictionary_encode()
        doc = chunks.indices.to_numpy(zero_copy_only=False)[order]
        start = np.searchsorted(at[order], np.arange(len(of) + 1))
        most = np.maximum.reduceat(part, start[:-1])
        place = np.searchsorted(of, t)
        there = of[np.minimum(place, len(of) - 1)] == t
        # What a query could reach in the block.
        reach = np.add.reduceat(np.where(there, most[np.minimum(place, len(of) - 1)], 0.0), first) if len(first) else np.zeros(0)
        out_q, out_doc, out_s = [], [], []
        for q in np.flatnonzero((reach >= bar) & (reach > 0)):
            mine = place[first[q] : last[q]][there[first[q] : last[q]]]
            n = start[mine + 1] - start[mine]
            rows = np.repeat(start[mine] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            s = np.bincount(doc[rows], part[rows], minlength=len(chunks.dictionary))
            hit = np.flatnonzero((s >= bar[q]) & (s > 0))
            if len(hit) > k:
                hit = hit[s[hit] >= np.partition(s[hit], len(hit) - k)[len(hit) - k] - 2 * slack]
            out_q.append(np.full(len(hit), q))
            out_doc.append(hit)
            out_s.append(s[hit])
        q, d, s = (np.concatenate(x) if x else np.zeros(0, int) for x in (out_q, out_doc, out_s))
        return pa.table([ids.take(pa.array(q)), chunks.dictionary.take(pa.array(d)), pa.array(s.astype(float))], ["query_id", "chunk_id", "s"])

    kinds = terms.schema["query_id"].dataType.simpleString(), impacts.schema["chunk_id"].dataType.simpleString()
    return impacts.groupBy("blk").applyInArrow(score, f"query_id {kinds[0]}, chunk_id {kinds[1]}, s double")


def _in_cells(impacts: DataFrame, terms: DataFrame, bars: DataFrame, k: int, slack: float) -> DataFrame:
    """_in_blocks() of any number of queries."""
    asked = materialised(terms.join(bars, "query_id", "left").select("query_id", "t", F.coalesce("bar", F.lit(0.0)).alias("bar")), "asked")
    n_terms, n_impacts = max(1, asked.count()), max(1, impacts.count())
    # Terms go to each share and impacts to each slice: of the ways to get the cells, about the one that copies the fewest rows.
    slices = max(-(-n_terms // SLICE_TERMS), min(CELLS, round((CELLS * n_terms / n_impacts) ** 0.5)), 1)
    shares = max(-(-n_impacts // SHARE_ROWS), -(-CELLS // slices))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = impacts.select(every(slices).alias("slice"), F.pmod(F.xxhash64("blk"), F.lit(shares)).cast("int").alias("share"), "t", _zone("blk").alias("zone"), "chunk_id", "part")
    right = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int").alias("slice"), every(shares).alias("share"), "query_id", "t", "bar")
    kinds = terms.schema["query_id"].dataType.simpleString(), impacts.schema["chunk_id"].dataType.simpleString()
    left, right = (df.repartition(2 * slices * shares, "slice", "share").groupBy("slice", "share") for df in (left, right))
    cells = left.cogroup(right).applyInArrow(lambda docs, queries: _cell(docs, queries, k, slack), f"query_id {kinds[0]}, chunk_id {kinds[1]}, s double")
    return materialised(cells, "candidates")


def _cell(docs: pa.Table, queries: pa.Table, k: int, slack: float) -> pa.Table:
    """(query_id, chunk_id, s): of docs (t, zone, chunk_id, part) what queries (query_id, t, bar) may have among their k best."""
    whose = queries["query_id"].combine_chunks().dictionary_encode()
    q, ask, by_term = whose.indices.to_numpy(zero_copy_only=False), queries["t"].to_numpy(), np.argsort(queries["t"].to_numpy(), kind="stable")
    kept = _Best(len(whose.dictionary), k, slack)
    kept.bar[q] = queries["bar"].to_numpy()
    q, ask = q[by_term], ask[by_term]
    # Documents by zone and id, terms in order.
    names = docs["chunk_id"].combine_chunks().dictionary_encode()
    in_order = pc.array_sort_indices(names.dictionary)
    doc = np.empty(len(in_order), np.int64)
    doc[in_order.to_numpy()] = np.arange(len(in_order))
    doc = doc[names.indices.to_numpy(zero_copy_only=False)]
    t, zone = docs["t"].to_numpy(), docs["zone"].to_numpy()
    wanted = np.flatnonzero(np.isin(t, ask))
    wanted = wanted[np.lexsort((t[wanted], doc[wanted], zone[wanted]))]
    t, zone, doc, part = t[wanted], zone[wanted], doc[wanted], docs["part"].to_numpy()[wanted]
    other_zone = _changes(zone)
    nth = np.cumsum(_changes(doc) | other_zone) - 1
    begin = np.flatnonzero(other_zone)
    piece = (nth - np.repeat(nth[begin], np.diff(np.append(begin, len(nth))))) // PIECE_ROWS
    edges = np.append(np.flatnonzero(_changes(piece) | other_zone), len(piece))
    # The first pieces of all zones come first, as their small ids are the ones that win ties.
    for e in np.argsort(piece[edges[:-1]], kind="stable"):
        rows = slice(edges[e], edges[e + 1])
        _piece(t[rows], nth[rows] - nth[rows.start], doc[rows], part[rows], q, ask, kept)
    q, d, s = kept.rows()
    return pa.table([whose.dictionary.take(pa.array(q)), names.dictionary.take(in_order).take(pa.array(d)), pa.array(s)], ["query_id", "chunk_id", "s"])


def _piece(t: np.ndarray, column: np.ndarray, doc: np.ndarray, part: np.ndarray, q: np.ndarray, ask: np.ndarray, kept: _Best) -> None:
    """Gives kept the documents of a piece (numbered by column, in the order of their ids doc) for the queries q with the terms ask, which are in order."""
    by_term = np.argsort(t, kind="stable")
    t, column_of, part = t[by_term], column[by_term], part[by_term]
    start = np.flatnonzero(_changes(t))
    held, most = np.diff(np.append(start, len(t))), np.maximum.reduceat(part, start)
    first = np.searchsorted(ask, t[start])
    asking = np.searchsorted(ask, t[start], "right") - first
    who, term = q[_ranges(first, asking)], np.repeat(np.arange(len(start)), asking)
    # Sums go by rising terms here and below, so no sum of a document is above the reach.
    reach = np.bincount(who, most[term], len(kept.bar))
    go = np.flatnonzero((reach > 0) & (reach >= kept.bar) & ((reach > kept.least) | (doc[0] <= kept.last)))
    if not len(go):
        return
    # Queries with the same terms here: the sums of two random numbers of 40 bits a term are whole, so exact, and told apart up to a chance of 2^-80.
    marks = [np.bincount(who, np.random.default_rng(seed).integers(1 << 40, size=len(start)).astype(float)[term], len(kept.bar))[go] for seed in (1, 2)]
    _, sample, alike = np.unique(marks[0] + 1j * marks[1], return_index=True, return_inverse=True)
    low = np.full(len(sample), np.inf)
    np.minimum.at(low, alike, kept.bar[go])
    row = np.full(len(kept.bar), -1)
    row[go[sample]] = np.arange(len(sample))
    mine = np.flatnonzero(row[who] >= 0)
    mine = mine[np.argsort(row[who[mine]], kind="stable")]
    row, term = row[who[mine]], term[mine]
    width, doc = column[-1] + 1, doc[np.flatnonzero(_changes(column))]
    load = np.cumsum(np.bincount(row, held[term], len(sample)) + width) // AT_ONCE
    ends = np.append(np.flatnonzero(np.diff(load)) + 1, len(sample))
    out = []
    for a, b in zip(np.append(0, ends[:-1]), ends):
        part_of = slice(*np.searchsorted(row, (a, b)))
        n = held[term[part_of]]
        at = _ranges(start[term[part_of]], n)
        s = np.bincount(np.repeat(row[part_of] - a, n) * width + column_of[at], part[at], (b - a) * width).reshape(b - a, width)
        floor = low[a:b] if width <= kept.k else np.maximum(low[a:b], np.partition(s, width - kept.k, axis=1)[:, width - kept.k] - 2 * kept.slack)
        r, c = np.nonzero((s >= floor[:, None]) & (s > 0))
        s = s[r, c]
        order = np.lexsort((c, -s, r))
        r, c, s = r[order], c[order], s[order]
        # Of equal scores the k of the smallest ids.
        few = _place(_changes(r) | _changes(s)) < kept.k
        out.append((r[few] + a, doc[c[few]], s[few]))
    r, d, s = (np.concatenate(x) for x in zip(*out))
    found = np.bincount(r, minlength=len(sample))
    at = _ranges((np.cumsum(found) - found)[alike], found[alike])
    kept.add(np.repeat(go, found[alike]), d[at], s[at])


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.append(np.full(min(1, len(x)), True), x[1:] != x[:-1])


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. of n[0] numbers, and so on for the others."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def _place(begins: np.ndarray) -> np.ndarray:
    """The place of each element in its run, from 0."""
    at = np.flatnonzero(begins)
    return np.arange(len(begins)) - np.repeat(at, np.diff(np.append(at, len(begins))))


class _Best:
    """What n queries have found so far: documents d, numbered in the order of their ids, with scores s.

    A row goes if k other documents reach its score with smaller ids, or pass it by more than the slack: after rounding they are still before it. A document may come with
    several scores, of its fields; the best one counts.
    """

    def __init__(self, n: int, k: int, slack: float):
        self.k, self.slack = k, slack
        #: The score to reach; the least score of the k best and their largest id.
        self.bar, self.least, self.last = np.zeros(n), np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)
        self.found, self.pending, self.size = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0

    def add(self, q: np.ndarray, d: np.ndarray, s: np.ndarray) -> None:
        on = (s >= self.bar[q]) & ((s > self.least[q]) | (d <= self.last[q]))
        self.pending.append((q[on], d[on], s[on]))
        self.size += int(on.sum())
        if self.size > max(PENDING, len(self.found[0]) // 2):
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(q, d, s), cut to what may be among the k best."""
        q, d, s = (np.concatenate(x) for x in zip(self.found, *self.pending))
        order = np.lexsort((-s, d, q))
        q, d, s = q[order], d[order], s[order]
        one = _changes(q) | _changes(d)
        q, d, s = q[one], d[one], s[one]
        order = np.lexsort((d, -s, q))
        q, d, s = q[order], d[order], s[order]
        place = _place(_changes(q))
        kth = np.flatnonzero(place == self.k - 1)
        self.least[q[kth]] = s[kth]
        self.bar[q[kth]] = np.maximum(self.bar[q[kth]], s[kth] - 2 * self.slack)
        self.last[q[kth]] = np.maximum.reduce([d[kth - n] for n in range(self.k)]) if len(kth) else 0
        on = (s >= self.bar[q]) & (_place(_changes(q) | _changes(s)) < self.k) & ((s > self.least[q]) | (d <= self.last[q]))
        self.found, self.pending, self.size = (q[on], d[on], s[on]), [], 0
        return self.found
