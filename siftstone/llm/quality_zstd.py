"""Quality classifier by compression.

Two zstandard dictionaries are trained, on good and on bad labelled text. A text is cut into pieces, so that the
dictionary counts all along it, and compressed with each; the difference of the compressed sizes, normalised by the size of the text,
    (bad - good) / text
goes through a logistic calibration, which is fitted on labelled documents that the dictionaries haven't seen. Text that repeats itself
compresses alike under both, so it comes out near zero, between the classes.

Lines that stand in several documents of the sample are left out of the dictionaries: they tell the copy, not the class (a document with both labels counts as two).
Bounds, all parameters: SAMPLE labelled rows, DICT_PIECES pieces a class, DICT_BYTES a dictionary. Every text is scored whole.

An empty or null text gets the sample's share of good documents. Where the sample has one class or none, every score
is that share (0.5 without labels). Each row gives one row, whatever its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm.common import arrow_rows, crc32_of, table
from siftstone.llm.fitting import fit_logistic, labelled_sample, logistic

#: Share of the sample that the dictionaries see; the calibration has the rest.
SEEN = 0.7
SAMPLE, DICT_PIECES, DICT_BYTES, PIECE, LEVEL, THRESHOLD = 8000, 4000, 112_640, 2048, 3, 0.7


def _pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


class PairCompressor:
    """Normalised size differences of texts from two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for data in (good, bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: bytes) -> float:
        pieces = _pieces(text)
        good, bad = (sum(len(c.compress(p)) for p in pieces) for c in self.pair)
        return 50 * (bad - good) / len(text)


def _differences(good: bytes, bad: bytes):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = PairCompressor(good, bad)
        for batch in batches:
            rest = [c for c in batch.schema.names if c != "text"]
            found = [compressor(t) if t else None for t in batch["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(found, pa.float64())], [*rest, "difference"])

    return of


def _dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(pieces)[-DICT_BYTES:].rjust(8, b" ")


class QualityModel:
    """What training leaves: two dictionaries and the calibration."""

    def __init__(self, good: bytes | None, bad: bytes | None, weights: np.ndarray, share: float):
        self.good, self.bad, self.weights, self.share = good, bad, weights, share


def train(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", sample: int = SAMPLE) -> QualityModel:
    arrow_rows(docs.sparkSession)
    rows = labelled_sample(docs, labels, label, held_out, sample)
    lines = rows.where(F.col("part") < SEEN).select("doc_id", "label", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    # Each task hands on one row a line at most, however common the line.
    by_doc = lines.groupBy("line", "doc_id", "label").agg(F.collect_list("at").alias("ats"))
    own = by_doc.groupBy("line").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "label", "ats")]).where("n = 1")
    texts = (
        own.select("doc_id", "label", "line", F.explode("ats").alias("at"))
        .groupBy("doc_id", "label")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]), "\n").alias("text"))
    )
    cuts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int"))
    pieces = texts.where(F.length("text") > 0).select("doc_id", "label", F.explode(F.transform(cuts, lambda i: F.substr("text", i * PIECE + 1, F.lit(PIECE)))).alias("piece"))
    dictionaries = []
    for of in (1, 0):
        order = F.xxhash64("doc_id", "piece")
        chosen = pieces.where(F.col("label") == of).orderBy(order, "doc_id", "piece").limit(DICT_PIECES).select("piece").collect()
        dictionaries.append(_dictionary([r.piece.encode() for r in chosen]) if chosen else None)
    # The sample bounds what comes to the driver: a number and a label a row.
    if None in dictionaries:
        n, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        return QualityModel(None, None, np.zeros(2), (good + 0.5) / (n + 1))
    fitted = rows.where(F.col("part") >= SEEN).select("label", "text").mapInArrow(_differences(*dictionaries), "label int, difference double").toPandas()
    y, there = fitted["label"].to_numpy(float), fitted["difference"].notna().to_numpy()
    weights = fit_logistic(fitted.loc[there, ["difference"]].to_numpy(), y[there])
    return QualityModel(*dictionaries, weights, (y.sum() + 0.5) / (len(y) + 1))


def score_quality(df: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """df with `score`, without the text column if that isn't asked for: columns of df, then score double."""
    arrow_rows(df.sparkSession)
    if model.good is None:
        return df.withColumn("score", F.lit(model.share))
    names = [c for c in df.columns if c != "score"]
    kept = df.select(F.struct(*[F.col(f"`{c}`") for c in names if c != text]).alias("_kept"), F.col(text).alias("text"))
    differences, weights, share = _differences(model.good, model.bad), model.weights, model.share

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in differences(batches):
            x = batch["difference"].to_numpy(zero_copy_only=False)[:, None]
            s = np.where(np.isnan(x[:, 0]), share, logistic(weights, np.nan_to_num(x)))
            yield pa.RecordBatch.from_arrays([batch["_kept"], pa.array(s)], ["_kept", "score"])

    schema = kept.select("_kept").schema.add("score", "double")
    return kept.mapInArrow(score, schema).select(*[F.col("_kept").getField(c).alias(c) for c in names if c != text], "score")


def keep_good(df: DataFrame, model: QualityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df that score at least threshold, with all their columns."""
    arrow_rows(df.sparkSession)
    if model.good is None:
        return df.where(F.lit(model.share) >= threshold)
    weights, share = model.weights, model.share

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = PairCompressor(model.good, model.bad)
        for batch in batches:
            scores = [float(logistic(weights, np.array([compressor(t)]))) if t else share for t in batch[text].cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array([s >= threshold for s in scores], pa.bool_()))

    return df.mapInArrow(keep, df.schema)


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.pmod(crc32_of(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    model = train(docs, labels, held_out)
    return score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
