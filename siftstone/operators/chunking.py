"""Cleaned documents to chunks.

The line structure is found with Spark expressions on exploded lines: what a line is, which block it belongs to and
under which heading it stands are window functions over a document's lines. Only the overlap between neighbours,
where each chunk builds on its predecessor's new text, runs as a fold in Arrow batches.

A block is a maximal run of non-blank lines that no heading or step line interrupts. Headings stand alone. Its kind: step (opened by a step line),
table (two lines with a single pipe), list (its leading items, at least two) or paragraph.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions import text as T
from siftstone.functions import values as V
from siftstone.sources.tables import materialised

#: The patterns of headings with their levels, of list items, steps and table lines.
HEADINGS = (
    (r"^(#{1,6})\s+(.+)$", None),
    (r"^第[一二三四五六七八九十百千\d]+[章节条款篇部分]\s*.+", 1),
    (r"(?i)^(?:第[一二三四五六七八九十百千\d]+条|Article\s+\d+|Section\s+[\d.]+)\s*[：:。\s]", 2),
    (r"^[一二三四五六七八九十]{1,2}[、．.]\s*.+", 2),
    (r"^（[一二三四五六七八九十\d]+）\s*.+", 3),
    (r"^\d+(?:\.\d+){0,3}\s+[^\d].+", None),
)
ITEM = r"^\s*(?:[•\-\*\x{ff65}\x{30fb}◆◇○●▪▸►]\s+|\d+[.)）]\s+|[①②③④⑤⑥⑦⑧⑨⑩]\s*)"
#: How a line may begin that is a heading of any kind; other lines needn't meet the patterns.
HEADING_STARTS = r"(?U)^[#第一二三四五六七八九十（\daAsSſ]"
STEP = r"(?i)^(?:步骤|Step|操作|Action)\s*\d+[：:.]\s*"
PIPE = r"(?<!\|)\|(?!\|)"
SENTENCE_END = r"(?<=[。！？…\?!])|(?<=\.)\s+(?=[A-Z\x{4e00}-\x{9fff}])|(?<=\n\n)"
LEVELS = ("heading", "clause", "paragraph", "list_item", "table", "step")
MIN_PIECE = 20


@dataclass(frozen=True)
class Budget:
    max_tokens: int = 400
    overlap_tokens: int = 40
    context_tokens: int = 80
    semantic: bool = False
    min_trigger_tokens: int = 256
    levels: tuple[str, ...] = ("heading", "clause", "paragraph", "list_item", "table")
    #: Nodes over text_tokens go to semantic_split() as a whole; without it they are cut to their beginning, as in the reference.
    whole_nodes: bool = False
    #: Likeness of neighbouring sentences under which a chunk is cut, where there is a model for their vectors; None packs sentences.
    similarity: float | None = None

    @property
    def text_tokens(self) -> int:
        return self.max_tokens - self.context_tokens


def heading_level(line: Column) -> Column:
    """Level of a heading line, null for others; the first pattern that fits decides."""
    out = F.lit(None).cast("int")
    for pattern, level in reversed(HEADINGS):
        if level is None:
            found = F.length(F.regexp_extract(line, pattern, 1)) if "#" in pattern else F.regexp_count(F.regexp_extract(line, r"^(\S+)", 1), F.lit(r"\.")) + 1
        else:
            found = F.lit(level)
        out = F.when(F.rlike(line, F.lit("(?U)" + pattern)), found).otherwise(out)
    return F.when(F.rlike(F.substring(line, 1, 1), F.lit(HEADING_STARTS)), out)


def parse(docs: DataFrame, levels: tuple[str, ...] = LEVELS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, number, node_type, level, heading, text): the nodes of each document, numbered from 1. Blank documents give none."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]", -1)).alias("at", "line"))
    level = heading_level(F.col("line")) if {"heading", "clause"} & set(levels) else F.lit(None).cast("int")
    step = F.rlike("line", F.lit("(?U)" + STEP)) if "step" in levels else F.lit(False)
    by_doc = Window.partitionBy("doc_id").orderBy("at")
    seen = lines.withColumn("blank", T.is_blank(F.col("line"))).withColumn("level", F.when(~F.col("blank"), level)).withColumn("step", step & F.col("level").isNull())
    # A block opens after a blank line or heading, and at headings and steps.
    opens = F.col("level").isNotNull() | F.col("step") | F.coalesce(F.lag("blank").over(by_doc), F.lit(True)) | F.lag("level").over(by_doc).isNotNull()
    item = F.rlike("line", F.lit("(?U)" + ITEM)) if "list_item" in levels else F.lit(False)
    in_block = seen.withColumn("opens", opens).where("NOT blank").withColumn("block", F.sum(F.col("opens").cast("int")).over(by_doc)).withColumn("item", item)
    of_block = Window.partitionBy("doc_id", "block")
    pipes = F.sum((F.contains("line", F.lit("|")) & F.rlike("line", F.lit(PIPE))).cast("int")).over(of_block)
    # The leading items of a block, with their indented continuations, are a list; what follows is another block.
    leading = F.min((F.col("item") | F.startswith("line", F.lit("  "))).cast("int")).over(of_block.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) == 1
    first_item = F.first("item").over(of_block.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    typed = in_block.withColumn("table", (pipes >= 2) if "table" in levels else F.lit(False)).withColumn("listed", leading & first_item)
    items = F.sum((F.col("item") & F.col("listed")).cast("int")).over(of_block)
    kind = (
        F.when(F.col("level").isNotNull(), F.when(F.col("level") <= 2, "heading").otherwise("clause"))
        .when(F.max(F.col("step").cast("int")).over(of_block) == 1, "step").when(F.col("table"), "table").when(F.col("listed") & (items >= 2), "list_item").otherwise("paragraph")
    )
    kinds = typed.withColumn("kind", kind)
    rows = kinds.groupBy("doc_id", "block", "kind").agg(F.min("at").alias("at"), F.first("level").alias("level"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    node = F.when(F.array_contains(F.array(*[F.lit(v) for v in levels]), F.col("kind")), F.col("kind")).otherwise("paragraph")
    number = F.row_number().over(by_doc)
    title = T.strip(F.when(F.rlike(body, F.lit(HEADINGS[0][0])), F.regexp_extract(body, HEADINGS[0][0], 2)).otherwise(body))
    return rows.select("doc_id", number.alias("number"), node.alias("node_type"), F.coalesce("level", F.lit(2)).alias("level"), F.when(F.col("level").isNotNull(), title).otherwise("").alias("heading"), T.strip(body).alias("text"), F.col("level").isNotNull().alias("is_heading_line"))


def chunk(nodes: DataFrame, docs: DataFrame, budget: Budget = Budget(), config_version: str = "") -> DataFrame:
    """Nodes to chunks with ids, parents, heading trails, contexts and offsets; docs gives context_padding, business_type and source_metadata where it has them."""
    heads = F.col("node_type").isin("heading", "clause")
    by_doc = Window.partitionBy("doc_id").orderBy("number")
    ids = nodes.withColumn("chunk_id", V.chunk_id(F.col("doc_id"), F.col("level"), F.col("number"))).withColumn("head", heads)
    # For each level the last heading before, unless one of a lower or equal level came later: that closed it.
    before = by_doc.rowsBetween(Window.unboundedPreceding, -1)
    for k in range(1, 7):
        here = F.struct("number", "chunk_id", "heading", "text", "level")
        ids = ids.withColumn(f"_h{k}", F.last(F.when(F.col("head") & (F.col("level") == k), here), ignorenulls=True).over(before))
    opened = lambda k: F.coalesce(F.col(f"_h{k}.number"), F.lit(0))
    alive = []
    for k in range(1, 7):
        closed_by = F.greatest(*([opened(j) for j in range(1, k)] + [F.lit(0), F.lit(0)]))
        alive.append(F.when(opened(k) > closed_by, F.col(f"_h{k}")))
    trail = F.filter(F.array(*alive), lambda h: h.isNotNull())
    ids = ids.withColumn("_open", trail).drop(*[f"_h{k}" for k in range(1, 7)])
    # A heading's own parent is the innermost of a lower level; its breadcrumb is the trail as it stood before it.
    names = F.transform("_open", lambda h: F.coalesce(F.nullif(h["heading"], F.lit("")), h["text"]))
    parents = F.when(F.col("head"), F.transform(F.filter("_open", lambda h: h["level"] < F.col("level")), lambda h: h["chunk_id"])).otherwise(F.transform("_open", lambda h: h["chunk_id"]))
    out = ids.withColumn("heading_path", names).withColumn("parent_id", F.element_at(F.when(F.size(parents) > 0, parents), -1)).drop("_open")
    known = {c: docs[c] for c in ("context_padding", "business_type", "source_metadata", "keywords", "entities", "potential_questions") if c in docs.columns}
    out = out.join(docs.select("doc_id", *known), "doc_id")
    blurb = F.col("context_padding") if "context_padding" in known else F.lit(None).cast("string")
    out = out.withColumn("_tokens", T.token_count(F.col("text")))
    over = F.col("_tokens") > budget.text_tokens
    if budget.whole_nodes:
        out = out.withColumn("truncated", F.lit(False))
    else:
        out = out.withColumn("truncated", over).withColumn("text", T.truncate_tokens(F.col("text"), budget.text_tokens)).withColumn("_tokens", T.token_count(F.col("text")))
    siblings = Window.partitionBy("doc_id", "parent_id", "level").orderBy("number")
    group = F.when(~F.col("truncated"), F.coalesce("parent_id", F.col("doc_id").cast("string")))
    out = out.withColumn("lc_group_id", group).withColumn("position", F.row_number().over(siblings) - 1)
    upto = Window.partitionBy("doc_id", "lc_group_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.when(F.col("lc_group_id").isNotNull(), F.coalesce(F.sum(F.length("text") + 1).over(upto), F.lit(0)).cast("int"))
    out = out.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length("text"))
    out = out.withColumn("context_text", T.with_prefix(T.context_prefix(blurb, F.col("heading_path"), budget.context_tokens), F.col("text")))
    split = F.lit(budget.semantic) & (F.col("_tokens") > budget.min_trigger_tokens) | F.lit(budget.whole_nodes) & over
    out = out.withColumn("needs_semantic_split", split).withColumn("token_count", T.token_count(F.col("context_text")))
    rest = [c for c in ("business_type", "source_metadata", "keywords", "entities", "potential_questions") if c in known]
    out = out.select("chunk_id", "doc_id", "number", "parent_id", F.col("level").alias("hierarchy_level"), "position", "node_type", "text", "context_text", "heading_path", F.lit(config_version).alias("config_version"), "needs_semantic_split", "token_count", "lc_group_id", "char_start", "char_end", *rest)
    return overlapped(out, budget) if budget.overlap_tokens > 0 else out


def _are_cjk(text: str) -> np.ndarray:
    """Of each character of a text whether it is CJK."""
    if text.isascii():
        return np.zeros(len(text), bool)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return (c >= 0x4E00) & (c <= 0x9FFF) | (c >= 0x3400) & (c <= 0x4DBF) | (c >= 0xF900) & (c <= 0xFAFF) | (c >= 0x20000) & (c <= 0x2A6DF)


def _tokens(t: str) -> int:
    cjk = int(_are_cjk(t).sum())
    return cjk + (len(t) - cjk + 2) // 3


def _suffix(t: str, most: int) -> str:
    """The longest suffix of at most so many tokens."""
    low, high = 0, min(len(t), 3 * most)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if _tokens(t[len(t) - mid :]) <= most else (low, mid - 1)
    return t[len(t) - low :]


def overlapped(chunks: DataFrame, budget: Budget) -> DataFrame:
    """Each chunk below level 1 begins with the end of the chunk before it, where both have the same parent and level and the context still fits.

    The end is taken from the predecessor's new text, so ends cascade; offsets of a changed chunk are void. A task folds over
    its documents' chunks in order and holds one chunk, the predecessor.
    """
    names = ("doc_id", "parent_id", "hierarchy_level", "needs_semantic_split", "text", "context_text", "token_count")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            changed, texts, contexts, counts = [], [], [], []
            for doc, parent, level, split, text, context, n in zip(*(batch[c].to_pylist() for c in names)):
                place = (doc, parent or None, level)
                end = _suffix(before[1], budget.overlap_tokens) if before and before[0] == place and level > 1 and not split else ""
                new = f"{end}\n{text}".strip() if end else text
                whole = (context.replace(text, new, 1) if text in context else new) if end else context
                fits = bool(end) and (size := _tokens(whole)) <= budget.max_tokens
                if fits:
                    text, context, n = new, whole, size
                before = (place, text)
                changed.append(fits)
                texts.append(text)
                contexts.append(context)
                counts.append(n)
            new_of = {"text": texts, "context_text": contexts, "token_count": counts}
            columns = {f.name: pa.array(new_of[f.name], f.type) if f.name in new_of else batch[f.name] for f in batch.schema}
            for c in ("char_start", "char_end", "lc_group_id"):
                columns[c] = pc.if_else(pa.array(changed, pa.bool_()), pa.scalar(None, columns[c].type), columns[c])
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return chunks.repartition("doc_id").sortWithinPartitions("doc_id", "number").mapInArrow(fold, chunks.schema)


def _parts(text: Column) -> Column:
    """A text cut behind its sentence ends."""
    return F.split(F.regexp_replace(text, SENTENCE_END, "$0\x00"), "\x00", -1)


def sentences(text: Column) -> Column:
    """array<struct<text, start, end>>: trimmed sentences and their place; white space alone is left out."""
    parts = _parts(text)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        bare = T.strip(p)
        start = acc["at"] + F.length(p) - F.length(F.regexp_replace(p, r"(?U)^\s+", ""))
        found = V.let(bare, lambda b: F.array(F.struct(b.alias("text"), start.alias("start"), (start + F.length(b)).alias("end"))))
        return F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["out"], found).alias("out"))

    placed = F.aggregate(parts, zero, step, lambda acc: acc["out"])
    return F.filter(placed, lambda s: F.length(s["text"]) > 0)


def packed(text: Column, budget: int, least: int = MIN_PIECE) -> Column:
    """array<struct<start, end, n>>: sentences packed in order into pieces of at most budget tokens; a last piece under `least` joins the one before if both fit."""
    kind = "struct<start:int,end:int,n:int>"
    sized = F.transform(sentences(text), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.least(T.token_count(s["text"]), F.lit(budget)).alias("n")))

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), s["end"].alias("end"), (last["n"] + s["n"]).alias("n"))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))
        return F.when(F.coalesce(last["n"] + s["n"] <= budget, F.lit(False)), joined).otherwise(F.concat(acc, F.array(s))).cast(f"array<{kind}>")

    def finished(groups: Column) -> Column:
        last, prev = F.try_element_at(groups, F.lit(-1)), F.try_element_at(groups, F.lit(-2))
        merged = F.concat(F.slice(groups, F.lit(1), F.size(groups) - 2), F.array(F.struct(prev["start"].alias("start"), last["end"].alias("end"), (prev["n"] + last["n"]).alias("n"))))
        tiny = (F.size(groups) >= 2) & (last["n"] < least) & (prev["n"] + last["n"] <= budget)
        return F.when(tiny, merged).otherwise(groups)

    return V.let(F.aggregate(sized, F.array().cast(f"array<{kind}>"), step), finished)


def _pieces_of(text: str, ends: list[tuple[int, int]], budget: int, least: int) -> list[tuple[int, int]]:
    """Places of pieces of at most budget tokens that hold all sentences: these packed in order, longer ones cut into consecutive pieces."""
    cjk = np.concatenate([[0], np.cumsum(_are_cjk(text))])
    cost = lambda a, b: int(cjk[b] - cjk[a]) + (b - a - int(cjk[b] - cjk[a]) + 2) // 3
    out: list[tuple[int, int]] = []
    for a, b in ends:
        if out and cost(out[-1][0], b) <= budget:
            out[-1] = (out[-1][0], b)
            continue
        while cost(a, b) > budget:
            low, high = a + 1, min(b, a + 3 * budget)
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if cost(a, mid) <= budget else (low, mid - 1)
            out.append((a, low))
            a = low
        out.append((a, b))
    if len(out) > 1 and cost(*out[-1]) < least and cost(out[-2][0], out[-1][1]) <= budget:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


def _with_pieces(chunks: DataFrame, cut: Callable[[list[str], list[list[tuple[int, int]]]], list[list[tuple[int, int]]]]) -> DataFrame:
    """chunks with _pieces, an array<struct<start, end>> of the flagged ones and null for others: cut(texts, places of their sentences) gives them, a batch at a time.

    Spark cuts the sentences and measures them; their places are sums of these lengths, made in the task, so the work grows with the text.
    """
    sizes = F.transform(_parts(F.col("text")), lambda p: F.struct(F.length(p).alias("n"), (F.length(p) - F.length(F.ltrim(p, F.lit(T.SPACES)))).alias("lead"), F.length(T.strip(p)).alias("bare")))
    names = chunks.columns
    measured = chunks.withColumn("_sizes", F.when(F.col("needs_semantic_split"), sizes))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["_sizes"]
            flagged = np.flatnonzero(sizes.is_valid().to_numpy(zero_copy_only=False))
            n, lead, bare = (x.to_numpy(zero_copy_only=False) for x in sizes.flatten().flatten())
            last = np.cumsum(sizes.take(pa.array(flagged)).value_lengths().to_numpy(zero_copy_only=False))
            places = []
            for a, b in zip(np.append(0, last[:-1]), last):
                start = np.cumsum(n[a:b]) - n[a:b] + lead[a:b]
                some = bare[a:b] > 0
                places.append(list(zip(start[some].tolist(), (start + bare[a:b])[some].tolist())))
            pieces = [None] * len(batch)
            for row, found in zip(flagged, cut(batch["text"].take(pa.array(flagged)).to_pylist(), places)):
                pieces[row] = [{"start": a, "end": b} for a, b in found]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(pieces, kind)], [*names, "_pieces"])

    return measured.mapInArrow(pack, chunks.withColumn("_pieces", F.lit(None).cast("array<struct<start:int,end:int>>")).schema)


def packed_whole(chunks: DataFrame, budget: int, least: int = MIN_PIECE) -> DataFrame:
    """chunks with _pieces: as of packed(), but the pieces hold the whole text and fit. Chunks that aren't flagged have null."""
    return _with_pieces(chunks, lambda texts, places: [_pieces_of(t, found, budget, least) for t, found in zip(texts, places)])


def best_pieces(places: list[tuple[int, int]], alike: list[float], cost: Callable[[int, int], int], budget: int, least: int, threshold: float) -> list[tuple[int, int]]:
    """Sentences (start, end) joined to pieces of at most budget tokens so that the sum of (likeness less threshold) over the cuts is smallest.

    alike[i] is how alike sentences i and i + 1 are. So a cut lies where likeness drops under the threshold, or, where the budget asks for one, at the least alike
    neighbours. Pieces under `least` tokens are made only where nothing else fits; ties go to fewer cuts, then to the longer last piece. Sentences are within the budget.
    """
    n = len(places)
    best: list[tuple[int, float, int, int]] = [(0, 0.0, 0, 0)] + [(n + 1, math.inf, 0, 0)] * n  # too small pieces, sum, cuts, start of the last piece
    for j in range(1, n + 1):
        for i in range(j - 1, -1, -1):
            size = cost(places[i][0], places[j - 1][1])
            if size > budget and i < j - 1:
                break
            small = best[i][0] + (size < least and not (i == 0 and j == n))
            new = (small, round(best[i][1] + (alike[i - 1] - threshold if i else 0.0), 9), best[i][2] + (i > 0), i)
            if new < best[j]:
                best[j] = new
    out, j = [], n
    while j > 0:
        i = best[j][3]
        out.append((places[i][0], places[j - 1][1]))
        j = i
    return out[::-1]


def _cost_of(text: str) -> Callable[[int, int], int]:
    """Tokens of text[a:b]."""
    cjk = np.concatenate([[0], np.cumsum(_are_cjk(text))])
    return lambda a, b: int(cjk[b] - cjk[a]) + (b - a - int(cjk[b] - cjk[a]) + 2) // 3


def similar_pieces(chunks: DataFrame, budget: int, provider: Callable, threshold: float, least: int = MIN_PIECE) -> DataFrame:
    """chunks with _pieces, null for those that aren't flagged: cut where neighbouring sentences are least alike by the model's vectors (see best_pieces()).

    The model is called once a batch, with the sentences of all its flagged chunks. Where it fails, and where a sentence alone is over the budget, a chunk is packed as by packed_whole().
    """

    def cut(texts: list[str], ends: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
        said = [t[a:b] for t, row in zip(texts, ends) for a, b in row]
        try:
            v = np.array(provider(said), float).reshape(len(said), -1) if said else np.zeros((0, 1))
            v = v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
            alike = np.append((v[:-1] * v[1:]).sum(axis=1), 0.0).round(6).tolist()
        except Exception:  # noqa: BLE001  a model may fail in any way; the text is cut without it
            alike = None
        out, at = [], 0
        for text, row in zip(texts, ends):
            cost = _cost_of(text)
            if alike is None or any(cost(a, b) > budget for a, b in row):
                out.append(_pieces_of(text, row, budget, least))
            else:
                out.append(best_pieces(row, alike[at : at + len(row)], cost, budget, least, threshold))
            at += len(row)
        return out

    return _with_pieces(chunks, cut)


def semantic_split(chunks: DataFrame, budget: Budget = Budget(), provider: Callable | None = None) -> DataFrame:
    """Flagged chunks in pieces of whole sentences, a level deeper, with the chunk as parent; others, and those of one piece, stay with the flag cleared.

    With a provider and budget.similarity, flagged chunks are cut where likeness drops; else, as in the reference for that strategy, by packing. chunks are read once:
    a row passes as it is or as its pieces.
    """
    alike = provider is not None and budget.similarity is not None
    if alike:
        found = similar_pieces(chunks, budget.text_tokens, provider, budget.similarity)
    elif budget.whole_nodes:
        found = packed_whole(chunks, budget.text_tokens)
    else:
        found = chunks.withColumn("_pieces", F.when(F.col("needs_semantic_split"), F.transform(packed(F.col("text"), budget.text_tokens), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))))
    many = F.size("_pieces") > 1
    whole = F.array(F.lit(None).cast("struct<start:int,end:int>"))
    prefix = F.when(many, T.prefix_of(F.col("context_text"), F.col("text"), F.col("heading_path")))
    rows = found.select(*chunks.columns, prefix.alias("_prefix"), F.posexplode(F.when(many, F.col("_pieces")).otherwise(whole)).alias("_i", "_p"))
    piece = F.col("_p").isNotNull()
    body = F.substr("text", F.col("_p.start") + 1, F.col("_p.end") - F.col("_p.start"))
    body = body if budget.whole_nodes or alike else T.truncate_tokens(body, budget.text_tokens)
    rows = rows.withColumn("text", F.when(piece, body).otherwise(F.col("text"))).withColumn("context_text", F.when(piece, T.with_prefix(F.col("_prefix"), F.col("text"))).otherwise(F.col("context_text")))
    new = {
        "parent_id": F.col("chunk_id"), "chunk_id": V.sub_chunk_id(F.col("chunk_id"), F.col("_i")), "hierarchy_level": F.col("hierarchy_level") + 1, "position": F.col("_i"), "lc_group_id": F.concat(F.lit("sem:"), F.col("chunk_id")),
        "char_start": F.col("_p.start"), "char_end": F.col("_p.start") + F.length("text"), "token_count": T.token_count(F.col("context_text")),
    }
    out = {c: F.when(piece, new[c]).otherwise(F.col(c)) if c in new else F.col(c) for c in chunks.columns} | {"needs_semantic_split": F.lit(False)}
    return rows.select(*[value.alias(c) for c, value in out.items()])


def late_chunk_vectors(chunks: DataFrame, provider: Callable, dimension: int, max_seq_len: int) -> DataFrame:
    """(chunk_id, vector, fallback): each chunk's vector is the mean of its tokens' vectors in the text of its whole group.

    provider(texts) gives for each text (offsets [(start, end)], token vectors); it is called once a batch of groups, and once a batch of chunks that fall back. A chunk falls back to the
    mean of its own context's tokens where it has no group, the group is longer than 4 * max_seq_len characters (the limit of the design that is replaced), or its tokens
    can't be found or pooled. So only groups within that limit are gathered.
    """
    matrix = "struct<offsets:array<struct<start:int,end:int>>,vectors:array<array<double>>>"

    @F.pandas_udf("offsets array<struct<start:int,end:int>>, vectors array<array<double>>")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            found = provider([t or "" for t in s]) if len(s) else []
            offsets = pd.Series([[{"start": a, "end": b} for a, b in o] for o, _ in found], dtype="object")
            yield pd.DataFrame({"offsets": offsets, "vectors": pd.Series([[[float(x) for x in v] for v in m] for _, m in found], dtype="object")})

    rows = chunks.select("chunk_id", "lc_group_id", "position", "text", "context_text", "char_start", "char_end")
    length = rows.where("lc_group_id IS NOT NULL").groupBy("lc_group_id").agg((F.sum(F.length("text") + 1) - 1).alias("chars"))
    fits = length.where((F.col("chars") > 0) & (F.col("chars") <= 4 * max_seq_len)).select("lc_group_id")
    members = F.array_sort(F.collect_list(F.struct("position", "chunk_id", "text", "char_start", "char_end")))
    groups = rows.join(fits, "lc_group_id", "left_semi").groupBy("lc_group_id").agg(members.alias("members"))
    body = F.array_join(F.transform("members", lambda m: m["text"]), "\n")
    seen = groups.withColumn("m", tokens.asNondeterministic()(body).cast(matrix))

    def pooled(member: Column) -> Column:
        at = V.token_range(member["char_start"], member["char_end"], F.col("m.offsets"))
        return F.struct(member["chunk_id"].alias("chunk_id"), V.mean_pooled(F.col("m.vectors"), at["first"], at["end"]).alias("pooled"))

    of_groups = seen.select(F.inline(F.transform("members", pooled))).where(F.size("pooled") == dimension)
    joined = materialised(rows.join(of_groups, "chunk_id", "left").select("chunk_id", "context_text", "pooled"), "pooled")
    own = joined.where("pooled IS NULL").withColumn("m", tokens.asNondeterministic()(F.col("context_text")).cast(matrix))
    zeros = F.array_repeat(F.lit(0.0), dimension)
    alone = own.select("chunk_id", F.coalesce(V.mean_pooled(F.col("m.vectors"), F.lit(0), F.size("m.vectors")), zeros).alias("pooled"), F.lit(True).alias("fallback"))
    found = joined.where("pooled IS NOT NULL").select("chunk_id", "pooled", F.lit(False).alias("fallback")).unionByName(alone)
    return found.select("chunk_id", V.l2_normalized(F.col("pooled")).alias("vector"), "fallback")
