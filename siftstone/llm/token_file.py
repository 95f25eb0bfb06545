"""Token ids in patched frame-of-reference files.

Documents are range-partitioned and sorted by id, so partition order is file order. Each task tokenises its texts
once, appends the end id to each and cuts the stream of ids into frames at document ends; a frame is one row of a
Parquet table that Spark's own committer writes, so a lost executor leaves no half file. A frame holds the ids and
lengths of its documents, its start within the partition, and a payload:

    header        number of ids, number of blocks (unsigned 32-bit integers)
    index         by block: byte offset of its start, minimum (32-bit); width, number of exceptions (8-bit)
    blocks        128 ids less the minimum, packed at the width that holds PERCENTILE of them, lowest bit first;
                  then of each outlier its position (8-bit) and its bits above the width (32-bit)

Tokenisation is memoised by unit: a text is cut before each space and line feed. The byte-level pattern splits a run of
white space before its last character, or nowhere at the end of a text, so where runs are of two characters at most (one at
the end) the cuts are boundaries of the pattern, and a unit's ids do not depend on its surroundings. Other texts, and
texts that hold a special token's string, are encoded whole. Of a unit that is letters, or letters and a mark, the pattern
can't cut the letters, so they go to the tokenizer's model directly.

A null text is an empty one and gives only the end id. Null ids sort first; rows of the same id are ordered by text.
Every row gives one row; an empty table gives none.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.llm.common import arrow_rows, table, written

BLOCK, PERCENTILE, FRAME_IDS, MEMO_UNITS = 128, 0.99, 1 << 16, 700_000
#: White space in which a cut would change the ids, or that the cut into units would confuse.
_RUNS = re.compile(r"\s\s\s|\s\s\Z| \n").search
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def _unsafe(text: str) -> bool:
    if any(c in text for c in _OTHER_SPACE):
        return bool(_RUNS(text))
    return "  " in text or " \n" in text or "\n\n\n" in text or "\n\n " in text or text.endswith(("\n\n", "\n "))


# --- the codec -------------------------------------------------------------------------------------------------


def _to_bits(v: np.ndarray, w: int) -> np.ndarray:
    """Rows of values to rows of bytes with w bits a value."""
    kind = "u1" if w <= 8 else "<u2" if w <= 16 else "<u4"
    size = np.dtype(kind).itemsize
    raw = v.astype(kind).view(np.uint8).reshape(len(v), BLOCK, size)
    if w == 8 * size:
        return raw.reshape(len(v), -1)
    bits = np.unpackbits(raw, axis=2, bitorder="little")[:, :, :w]
    return np.packbits(bits.reshape(len(v), -1), axis=1, bitorder="little")


def _from_bits(packed: np.ndarray, w: int) -> np.ndarray:
    kind = "u1" if w <= 8 else "<u2" if w <= 16 else "<u4"
    size = np.dtype(kind).itemsize
    if w < 8 * size:
        wide = np.zeros((len(packed), BLOCK, 8 * size), np.uint8)
        wide[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), BLOCK, w)
        packed = np.packbits(wide, axis=2, bitorder="little").reshape(len(packed), -1)
    return np.ascontiguousarray(packed).view(kind).astype(np.uint32)


def pack(ids: np.ndarray) -> bytes:
    """Ids (unsigned 32-bit) to a payload."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.array([0, 0], "<u4").tobytes()
    v = np.full(blocks * BLOCK, ids[-1], np.uint32)
    v[:n] = ids
    v = v.reshape(blocks, BLOCK)
    least = v.min(axis=1)
    v = v - least[:, None]
    typical = np.partition(v, int(np.ceil(PERCENTILE * BLOCK)) - 1, axis=1)[:, int(np.ceil(PERCENTILE * BLOCK)) - 1]
    width = np.frexp(typical.astype(np.float64))[1].astype(np.uint8)
    over = v >> np.minimum(width, 31)[:, None]
    over[width > 31] = 0
    rows, cols = np.nonzero(over)
    n_over = np.bincount(rows, minlength=blocks)
    size = 16 * width.astype(np.int64) + 5 * n_over
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    body = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width):
        if w:
            sel = np.flatnonzero(width == w)
            body[start[sel][:, None] + np.arange(16 * int(w))] = _to_bits(v[sel], int(w))
    if len(rows):
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        at = (start + 16 * width.astype(np.int64))[rows]
        body[at + nth] = cols
        high = np.ascontiguousarray(over[rows, cols].astype("<u4")).view(np.uint8).reshape(-1, 4)
        body[(at + n_over[rows] + 4 * nth)[:, None] + np.arange(4)] = high
    return b"".join([np.array([n, blocks], "<u4").tobytes(), start.astype("<u4").tobytes(), least.astype("<u4").tobytes(), width.tobytes(), n_over.astype(np.uint8).tobytes(), body.tobytes()])


def unpack(payload: bytes) -> np.ndarray:
    """A payload to its ids."""
    n, blocks = (int(x) for x in np.frombuffer(payload, "<u4", 2))
    start = np.frombuffer(payload, "<u4", blocks, 8).astype(np.int64)
    least = np.frombuffer(payload, "<u4", blocks, 8 + 4 * blocks)
    width = np.frombuffer(payload, np.uint8, blocks, 8 + 8 * blocks)
    n_over = np.frombuffer(payload, np.uint8, blocks, 8 + 9 * blocks).astype(np.int64)
    body = np.frombuffer(payload, np.uint8, offset=8 + 10 * blocks)
    v = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            sel = np.flatnonzero(width == w)
            v[sel] = _from_bits(body[start[sel][:, None] + np.arange(16 * int(w))], int(w))
    rows = np.repeat(np.arange(blocks), n_over)
    if len(rows):
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        at = (start + 16 * width.astype(np.int64))[rows]
        high = np.ascontiguousarray(body[(at + n_over[rows] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
        v[rows, body[at + nth]] |= high << width[rows].astype(np.uint32)
    return (v + least[:, None]).ravel()[:n]


# --- tokenising ------------------------------------------------------------------------------------------------


#: How byte-level vocabularies write bytes: printable Latin-1 characters stand for themselves, the others follow from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_AS_WRITTEN = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_MARKS = frozenset(",.;:!?")


class UnitEncoder:
    """Texts to ids as little-endian bytes, memoised by unit in two generations: what the older one holds and is used again moves to the younger."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        parts = json.loads(self.tokenizer.to_str())
        split = parts["pre_tokenizer"] or {}
        #: A run of letters is one piece of this pattern, so the model alone gives its ids.
        self.direct = parts["normalizer"] is None and parts["model"]["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.model = self.tokenizer.model
        self.fixed = {c: self._encoded(c) for c in ("\n", *_MARKS)}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, word: str) -> bytes:
        written = word if word.isascii() and word[:1] != " " else word.encode().decode("latin-1").translate(_AS_WRITTEN)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        """Of a unit as it stands in the memo: without its space, or with its line feed."""
        if not self.direct:
            return self._encoded(unit if unit[:1] == "\n" else " " + unit)
        in_line = unit[:1] != "\n"
        bare = unit if in_line else unit[1:]
        if bare.isalpha():
            return self._letters(" " + bare) if in_line else self.fixed["\n"] + self._letters(bare)
        stem, mark = bare[:-1], self.fixed.get(bare[-1:])
        if mark and stem.isalpha():
            if in_line and stem not in self.young:
                self.young[stem] = self.old.get(stem) or self._letters(" " + stem)
            return self.young[stem] + mark if in_line else self.fixed["\n"] + self._letters(stem) + mark
        return self._encoded(" " + unit if in_line else unit)

    def one(self, text: str) -> bytes:
        if _unsafe(text) or any(s in text for s in self.special):
            return self._encoded(text)
        first, *units = text.replace("\n", " \n").split(" ")
        head = self._encoded(first)
        try:
            return head + b"".join(map(self.young.__getitem__, units))
        except KeyError:
            if len(self.young) > MEMO_UNITS:
                self.old, self.young = self.young, {}
            for u in units:
                if u not in self.young:
                    self.young[u] = self.old.get(u) or self._unit(u)
            return head + b"".join(map(self.young.__getitem__, units))

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self.one(t) for t in texts]


@cache
def _encoder(tokenizer_file: str) -> UnitEncoder:
    """One for each Python worker, so that later tasks find the memo filled."""
    return UnitEncoder(tokenizer_file)


_FRAME = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int32())), ("payload", pa.binary())])
_FRAME_DDL = "part int, start long, n_ids long, doc_ids array<long>, doc_lens array<int>, payload binary"


def _writer(tokenizer_file: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(tokenizer_file), np.array([end_id], "<u4").tobytes()
        part, at = TaskContext.get().partitionId(), 0
        ids, lens, stream, held = [], [], [], 0

        def frame():
            return pa.RecordBatch.from_pylist([{"part": part, "start": at, "n_ids": held, "doc_ids": ids, "doc_lens": lens, "payload": pack(np.frombuffer(b"".join(stream), "<u4"))}], schema=_FRAME)

        for batch in batches:
            for doc_id, coded in zip(batch["doc_id"].to_pylist(), encode([t or "" for t in batch["text"].to_pylist()])):
                ids.append(doc_id)
                lens.append(len(coded) // 4 + 1)
                stream += [coded, end]
                held += lens[-1]
                if held >= FRAME_IDS:
                    yield frame()
                    at, ids, lens, stream, held = at + held, [], [], [], 0
        if ids:
            yield frame()

    return write


def write_token_file(df: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Writes the frames to the shared folder and returns the table."""
    spark = df.sparkSession
    arrow_rows(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(rows.mapInArrow(_writer(tokenizer_file, end_id), _FRAME_DDL), "token-frames", compression="zstd")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, start, docs, lens, payload in zip(*(batch[c].to_pylist() for c in ("part", "start", "doc_ids", "doc_lens", "payload"))):
            ids = unpack(payload).astype("<u4")
            ends = np.cumsum(lens)
            crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lens)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(start + ends - np.asarray(lens), pa.int64()), pa.array(lens, pa.int64()), pa.array(crcs, pa.int64())],
                ["part", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_file(frames: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the payloads."""
    docs = frames.mapInArrow(_read, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each partition of the writer: their number is the setting spark.sql.shuffle.partitions.
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before.alias("before"))
    return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_token_file(write_token_file(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
