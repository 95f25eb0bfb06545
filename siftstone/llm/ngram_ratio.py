"""Quality rules: fixed rules on words, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into BUCKETS buckets. Two multinomials over the buckets are counted: the raw corpus, from every text of the
table, and the trusted target, from every text that labels call good. The target is smoothed towards the raw corpus by PRIOR
pseudo-counts. A text's ratio is the sum of ln(target / raw) over its words and pairs, divided by their number, so length doesn't count.

The threshold is the SHARE quantile of the trusted texts' own ratios, each taken with a target that was counted without its fold, so that
SHARE of the trusted texts would be lost. Every text is held against that one number. Counts are integers, so reruns agree to the bit.

Rules: a text fails with fewer than 20 words, or where words in 8-word windows that the text holds twice or more make up more than 30 %.

Bounds, parameters: BUCKETS numbers for each fold of the target and for the raw corpus on the driver and in each task. Both counts cover
all their texts whole, and grow with the input in time, not in memory. The threshold is exact: histograms close in on it.

Defined results: a null or empty text has no words and fails. Without any trusted text the ratio is null and the rules alone decide. An empty table
gives no rows. Each row gives one row, whatever its id; other columns are kept, and give way where they are named like a result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm.common import arrow_rows, table, written
from siftstone.llm.fitting import labelled_sample, part_of  # noqa: F401  tests take a text's part from labelled_sample()

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
FOLDS, PRIOR, SHARE = 4, float(BUCKETS), 0.002
#: Trusted ids that travel to the tasks at most, more take a shuffle join; bars of a histogram and numbers that the driver sorts at most.
BROADCAST_IDS, BARS = 500_000, 4096
MIN_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
MEMO_WORDS = 400_000
_UP = np.uint64(64 - BUCKET_BITS)
_ONE, _FIRST, _SECOND, _STEP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"
NAMES = [part.split(" ")[0] for part in RESULT.split(", ")]


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hashed(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def buckets(h: np.ndarray) -> np.ndarray:
    """The buckets of a text's words and of its pairs of words that follow one another."""
    pair = h[:-1] * _FIRST + h[1:] * _SECOND
    pair ^= pair >> np.uint64(29)
    return (np.concatenate([h, pair]) * _ONE >> _UP).astype(np.int64)


def repeated_words(words: list[bytes], h: np.ndarray) -> int:
    """Words in windows that stand in the text twice or more. Hashes find the windows, the words themselves decide."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    window = h[:n].copy()
    for k in range(1, WINDOW):
        window *= _STEP
        window += h[k : k + n]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    starts = np.flatnonzero(np.bincount(np.concatenate([order[1:][same], order[:-1][same]]), minlength=n)).tolist()
    of = [tuple(words[i : i + WINDOW]) for i in starts]
    times = Counter(of)
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.array([i for i, w in zip(starts, of) if times[w] > 1], np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def _counter(batches: Iterator[pa.RecordBatch], folds: int) -> Iterator[pa.RecordBatch]:
    """(fold, bucket, n): one row a bucket and fold at most for each task. Texts without a fold count in the last place, after the folds."""
    memo, total = WordHashes(), np.zeros((folds + 1, BUCKETS), np.int64)
    for batch in batches:
        found = [[] for _ in total]
        for f, text in zip(batch["fold"].fill_null(folds).to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
            found[f].append(buckets(hashed((text or b"").split(), memo)))
        for f, own in enumerate(found):
            if own:
                total[f] += np.bincount(np.concatenate(own), minlength=BUCKETS)
    fold, bucket = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(fold.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[fold, bucket])], ["fold", "bucket", "n"])


def counted(texts: DataFrame, folds: int = FOLDS) -> np.ndarray:
    """Counts by fold and bucket over all texts (text, fold), last those of null folds. The driver sees (folds + 1) * BUCKETS rows at most."""
    out = np.zeros((folds + 1, BUCKETS), np.int64)
    rows = texts.mapInArrow(lambda b: _counter(b, folds), "fold int, bucket int, n long").groupBy("fold", "bucket").agg(F.sum("n").alias("n")).toPandas()
    out[rows["fold"], rows["bucket"]] = rows["n"]
    return out


def nth_smallest(values: DataFrame, n: int) -> float:
    """The n-th smallest (from 0) of the finite numbers x in a table that is read several times. The driver sees BARS rows a round."""
    low, high = values.agg(F.min("x"), F.max("x")).first()
    while low < high:
        inside = values.where(F.col("x").between(low, high))
        # The bar of x rises with x, and low and high are never in one bar. Halves keep a width finite.
        by = 1.0 if np.isfinite(high - low) else 0.5
        bar = F.floor((F.col("x") * by - low * by) / (high * by - low * by) * (BARS - 1)).cast("int")
        bars = inside.groupBy(bar.alias("bar")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("bar").collect()
        below = 0
        for b in bars:
            if n < below + b.n:
                break
            below += b.n
        low, high, n = b.low, b.high, n - below
        if b.n <= BARS:
            return sorted(r.x for r in inside.where(F.col("x").between(low, high)).select("x").collect())[n]
    return low


def ratios(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """ln(target / raw) by bucket. A bucket that the raw corpus lacks has as little as one count in it."""
    share = np.maximum(raw, 1) / max(1, raw.sum())
    return np.log((target + prior * share) / (target.sum() + prior) / share)


def _ratio(of: np.ndarray, h: np.ndarray) -> float:
    b = buckets(h)
    return float(of[b].sum() / len(b))


class RulesModel:
    """ln(target / raw) by bucket, and the least ratio that is kept; None without trusted texts."""

    def __init__(self, ratio: np.ndarray | None, threshold: float):
        self.ratio, self.threshold = ratio, threshold


def trusted_folds(labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, fold): each document that labels mark 1, once."""
    return labels.where(F.col("doc_id").isNotNull() & (F.col(label) == 1)).select("doc_id").distinct().withColumn("fold", F.floor(part_of("doc_id") * FOLDS).cast("int"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", share: float = SHARE) -> RulesModel:
    """The model of docs (doc_id, text), whose documents that labels (doc_id, `label`) mark 1 are trusted."""
    arrow_rows(docs.sparkSession)
    chosen = written(trusted_folds(labels, label), "trusted")
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    # One pass for both: the raw corpus is the folds and what is in none.
    counts = counted(docs.select("doc_id", "text").join(few, "doc_id", "left").select("text", "fold"))
    target, raw = counts[:FOLDS], counts.sum(axis=0)
    if not target.any():
        return RulesModel(None, 0.0)
    others = [ratios(target.sum(axis=0) - own, raw) for own in target]

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            out = []
            for f, text in zip(batch["fold"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                if len(words) >= MIN_WORDS:
                    out.append(_ratio(others[f], hashed(words, memo)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], ["x"])

    # A number for each trusted text.
    own = written(docs.select("doc_id", "text").join(few, "doc_id").select("text", "fold").mapInArrow(unseen, "x double"), "ratios")
    n = own.count()
    return RulesModel(ratios(target.sum(axis=0), raw), nth_smallest(own, int(share * n)) if n else -np.inf)


def judged(df: DataFrame, model: RulesModel, text: str = "text") -> DataFrame:
    """The other columns of df, then RESULT for each row."""
    arrow_rows(df.sparkSession)
    names = [c for c in df.columns if c != text and c not in NAMES]
    rest = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(1).alias("_none"))
    rows = df.select(rest.alias("_rest"), F.col(f"`{text}`").cast("string").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            out = []
            for t in batch["text"].to_pylist():
                t = t or ""
                words = t.encode().split()
                h = hashed(words, memo)
                n, again = len(words), repeated_words(words, h)
                failed = n < MIN_WORDS or 100 * again > MOST_REPEATED * n
                llr = _ratio(model.ratio, h) if n and model.ratio is not None else None
                kept = not failed and (llr is None or llr >= model.threshold)
                out.append((n, len(t) - sum(map(t.count, SPACES)), sum(map(t.count, SYMBOLS)), duplicate_lines(t), again, failed, llr, kept))
            columns = zip(*out) if out else [[] for _ in NAMES]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch["_rest"], *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], ["_rest", *NAMES])

    schema = rows.select("_rest").schema
    for part in RESULT.split(", "):
        schema = schema.add(*part.split(" "))
    return rows.mapInArrow(judge, schema).select(*[F.col("_rest").getField(c).alias(c) for c in names], *NAMES)


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judged(docs.select("doc_id", "text"), train(docs, labels))
