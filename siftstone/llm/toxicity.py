"""Toxicity by maximum-scoring segments.

Training counts words and word beginnings of 4 to 8 letters in toxic and clean labelled documents. The log-odds of
a feature is taken with a Dirichlet prior, whose pseudo-counts follow the feature's share of the sample; a feature counts if
it stands in two toxic documents, its log-odds exceed MIN_ODDS and the signed root of the likelihood ratio exceeds what the largest of
so many standard normal variables reaches by chance, sqrt(2 ln(features)), a bar that follows the sample. A word
scores as its most significant feature; all other words share the log-odds of what is left, slightly below zero.

A text is then a sequence of scores. One linear scan (Ruzzo and Tompa) finds all its maximal-scoring segments. For
log-odds scores the extreme-value parameter is 1: a segment of score S in a text of m words has the p-value
1 - exp(-K m exp(-S)), K being fitted to the best segments of clean documents. Segments with p <= SIGNIFICANT are the
toxic passages. A document's score comes from its best and from the sum of its significant segments, each less
ln(K m), by a logistic calibration on labelled documents that the counts haven't seen.

Bounds, all parameters: SAMPLE labelled rows, FEATURES features. Every text is scanned whole. An empty or null text
is one without segments. Each row gives one row, whatever its id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from siftstone.llm.common import arrow_rows, crc32_of, table, written
from siftstone.llm.fitting import fit_logistic, labelled_sample, logistic

SAMPLE, FEATURES, PRIOR, MIN_DOCS, MIN_ODDS, TOP_SCORE, SIGNIFICANT, THRESHOLD = 20_000, 50_000, 500.0, 2, 1.0, 5.0, 0.05, 0.5
#: No document counts more than so many times for a feature.
PER_DOC = 3
MEMO_WORDS = 400_000
_WORD = re.compile(r"[^\W\d_]+")


def _of_word(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in range(4, 9) if len(word) >= k)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by feature and label, summed over each batch."""
    for batch in batches:
        times, docs, words = ({0: Counter(), 1: Counter()} for _ in range(3))
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
            seen: Counter = Counter()
            for word, n in Counter(w.lower() for w in _WORD.findall(text or "")).items():
                words[label][""] += n
                for f in _of_word(word):
                    seen[f] += n
            times[label].update({f: min(n, PER_DOC) for f, n in seen.items()})
            docs[label].update(seen.keys())
        rows = [(f, times[0][f], times[1][f], docs[1][f]) for f in times[0].keys() | times[1].keys()]
        rows.append(("", words[0][""], words[1][""], 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["feature", "clean", "toxic", "docs"])


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, last) of a sequence that has the given positive scores at the given
    positions and drift (below zero) at all others, in linear time."""
    found: list[list] = []  # left cumulative, right cumulative, first, last
    total, at = 0.0, -1
    for i, s in scores:
        total += drift * (i - at - 1)
        at = i
        new = [total, total + s, i, i]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= new[0]:
                j = found[j][4]
            if j < 0 or found[j][1] >= new[1]:
                found.append([*new[:4], j])
                break
            new[0], new[2] = found[j][0], found[j][2]
            del found[j:]
    return [(right - left, first, last) for left, right, first, last, _ in found]


class ToxicityModel:
    def __init__(self, features: dict[str, tuple[float, float]], drift: float):
        self.features, self.drift = features, drift
        self.log_k, self.weights = 0.0, np.zeros(3)
        self._memo: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_memo": {}}

    def _word(self, word: str) -> float:
        best = max((self.features[f] for f in _of_word(word.lower()) if f in self.features), key=lambda v: v[1], default=None)
        if len(self._memo) > MEMO_WORDS:
            self._memo.clear()
        value = self._memo[word] = best[0] if best else 0.0
        return value

    def scan(self, text: str) -> tuple[int, list[tuple[float, int, int]]]:
        """Number of words, and the segments in word positions."""
        words = _WORD.findall(text)
        memo, of = self._memo, self._word
        hits = []
        for i, w in enumerate(words):
            s = memo.get(w)
            if s is None:
                s = of(w)
            if s:
                hits.append((i, s))
        return len(words), segments(hits, self.drift) if hits else []

    def extremes(self, n: int, found: list[tuple[float, int, int]]) -> tuple[float, float]:
        level = math.log(n + 20)
        best = max((s for s, _, _ in found), default=0.0) - level
        bar = level + self.log_k - math.log(-math.log(1 - SIGNIFICANT))
        return best, math.log1p(sum(s - level - self.log_k for s, _, _ in found if s >= bar and s > level + self.log_k))

    def p_value(self, n: int, score: float) -> float:
        return -math.expm1(-math.exp(min(50.0, self.log_k + math.log(n + 20) - score)))


def train(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    arrow_rows(docs.sparkSession)
    rows = labelled_sample(docs, labels, label, held_out, sample)
    counts = (
        rows.where("part < 0.67").select("text", "label").mapInArrow(_count, "feature string, clean long, toxic long, docs long")
        .groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
    )
    counts = written(counts, "features")
    total = counts.where("feature = ''").first()
    n0, n1 = (max(1, total.clean), max(1, total.toxic)) if total else (1, 1)
    both = F.col("clean") + F.col("toxic")
    prior = PRIOR * both / (n0 + n1)
    odds = F.log((F.col("toxic") + prior) / (n1 + PRIOR)) - F.log((F.col("clean") + prior) / (n0 + PRIOR))
    share = lambda n: both * n / (n0 + n1)
    part = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / share(n))).otherwise(0.0)
    test = F.sqrt(F.greatest(F.lit(0.0), 2 * (part("toxic", n1) + part("clean", n0))))
    bar = math.sqrt(2 * math.log(max(2, counts.count())))
    kept = (
        counts.where((F.col("feature") != "") & (F.col("docs") >= MIN_DOCS))
        .select("feature", "clean", "toxic", odds.alias("odds"), test.alias("test"))
        .where((F.col("odds") > MIN_ODDS) & (F.col("test") > bar))
        .orderBy(F.desc("test"), "feature").limit(FEATURES).collect()
    )
    whole = [r for r in kept if len(r.feature) == 4 or r.feature.endswith("$")]
    left1, left0 = (1 - min(0.9, sum(getattr(r, c) for r in whole) / n / 2) for c, n in (("toxic", n1), ("clean", n0)))
    model = ToxicityModel({r.feature: (min(r.odds, TOP_SCORE), r.test) for r in kept}, min(-0.02, math.log(left1 / left0)))

    def best_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.scan(t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["label"], pa.array([n for n, _ in found], pa.int64()), pa.array([[s for s, _, _ in f] for _, f in found], pa.list_(pa.float64()))], ["label", "n", "scores"]
            )

    # At most the sample's calibration part: a label, a length and segment scores a row.
    fitted = rows.where("part >= 0.67").select("text", "label").mapInArrow(best_segments, "label int, n long, scores array<double>").collect()
    clean = [max(r.scores, default=0.0) - math.log(r.n + 20) for r in fitted if r.label == 0]
    # The mean of a standard Gumbel variable is Euler's constant.
    model.log_k = float(np.mean(clean)) - np.euler_gamma if clean else 0.0
    x = np.array([model.extremes(r.n, [(s, 0, 0) for s in r.scores]) for r in fitted]).reshape(-1, 2)
    model.weights = fit_logistic(x, np.array([r.label for r in fitted], float))
    return model


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The other columns of df, then score double and passages array<struct<start int, end int, segment_score double,
    p_value double>>: the significant passages in code points, ends exclusive."""
    arrow_rows(df.sparkSession)
    names = [c for c in df.columns if c not in (text, "score", "passages")]
    rest = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(1).alias("_none"))
    kept = df.select(rest.alias("_kept"), F.col(text).alias("text"))
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("segment_score", pa.float64()), ("p_value", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, passages = [], []
            for t in batch["text"].to_pylist():
                n, found = model.scan(t or "")
                x.append(model.extremes(n, found))
                told = [(s, a, b, p) for s, a, b in found if (p := model.p_value(n, s)) <= SIGNIFICANT]
                at = [m.span() for m in _WORD.finditer(t)] if told else []
                passages.append([{"start": at[a][0], "end": at[b][1], "segment_score": s, "p_value": p} for s, a, b, p in told])
            s = logistic(model.weights, np.array(x).reshape(-1, 2))
            yield pa.RecordBatch.from_arrays([batch["_kept"], pa.array(s), pa.array(passages, pa.list_(passage))], ["_kept", "score", "passages"])

    schema = kept.select("_kept").schema.add("score", "double").add("passages", ArrayType(StructType.fromDDL("start int, end int, segment_score double, p_value double")))
    return kept.mapInArrow(score, schema).select(*[F.col("_kept").getField(c).alias(c) for c in names], "score", "passages")


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.pmod(crc32_of(F.col("doc_id")), F.lit(5)) == 0, F.lit(False))
    model = train(docs, labels, held_out)
    return score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages")
    )
