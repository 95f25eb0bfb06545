"""The classifiers: held-out accuracy, and what they do with odd input."""

import random
import zlib

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.llm import quality_zstd as Q
from siftstone.llm import toxicity as X
from siftstone.llm.fitting import fit_logistic, logistic
from siftstone.llm.queries import QUERIES

#: Large enough to learn from: 3,980 labels.
SF = compare.DATA.replace("0.001", "0.1")


def held_out_accuracy(spark, name, label):
    rows = QUERIES[name](spark, SF).toPandas()
    labels = compare.oracle(SF).sql(f"SELECT doc_id, {label} AS y FROM labels").df()
    assert rows.score.between(0, 1).all() and len(rows) == 10_000
    m = rows.merge(labels, on="doc_id")
    m = m[m.held_out]
    return m.y.to_numpy(), m.predicted.to_numpy(), rows


def auc(y, score):
    """Share of pairs of both classes in the right order, ties counting half."""
    a, b = score[y == 1][:, None], score[y == 0][None, :]
    return ((a > b) + 0.5 * (a == b)).mean()


@pytest.mark.parametrize(("name", "label"), [("op5_toxicity", "toxic"), ("op9_quality", "quality")])
def test_order_of_held_out_scores_at_a_small_scale(spark, name, label):
    """A few hundred labels are enough for scores that tell the classes apart."""
    small = compare.DATA.replace("0.001", "0.01")
    rows = QUERIES[name](spark, small).toPandas()
    m = rows.merge(compare.oracle(small).sql(f"SELECT doc_id, {label} AS y FROM labels").df(), on="doc_id")
    m = m[m.held_out]
    assert auc(m.y.to_numpy(), m.score.to_numpy()) > 0.8 and rows.score.nunique() > 100


def test_calibration_converges():
    """Separable and nearly separable features, on any scale, and features that point the wrong way."""
    rng = np.random.default_rng(1)
    y = np.r_[np.zeros(105), np.ones(14)]
    for gap, scale in ((80, 1), (3, 1), (0.1, 1), (3, 1000), (3, 0.001)):
        x = rng.normal(0, scale, (119, 1)) + gap * scale * y[:, None]
        for features in (x, np.c_[x, x], np.c_[x, -x], -x):
            w = fit_logistic(features, y)
            loss = lambda v: (np.logaddexp(0, v[0] + features @ v[1:]) - y * (v[0] + features @ v[1:])).sum()
            start = np.r_[np.log(14.5 / 105.5), np.zeros(features.shape[1])]
            assert np.isfinite(w).all() and (w[1:] > 0).all() and np.abs(w).max() < 1e6
            if features is not x and features.shape[1] == 1:
                continue
            assert loss(w) < loss(start) and auc(y, logistic(w, features)) == pytest.approx(auc(y, x[:, 0]), abs=0.02)


def test_quality_holds_out(spark):
    y, p, rows = held_out_accuracy(spark, "op9_quality", "quality")
    assert (rows.held_out == rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all() and (rows.predicted == (rows.score >= 0.7)).all()
    assert (y == p).mean() >= 0.98 and p[y == 1].mean() >= 0.98


def test_toxicity_holds_out(spark):
    y, p, rows = held_out_accuracy(spark, "op5_toxicity", "toxic")
    assert (rows.held_out == rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all() and (rows.predicted == (rows.score >= 0.5)).all()
    assert (y == p).mean() >= 0.97 and p[y == 0].mean() <= 0.02


@pytest.fixture
def labelled(spark, docs):
    random.seed(3)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    good = [" ".join(word() for _ in range(60)) for _ in range(60)]
    bad = [" | ".join(word()[:2] + "%%%" for _ in range(60)) for _ in range(60)]
    toxic = [f"{t} vileword nastyterm vileword" for t in good[:30]]
    odd = [None, "", " \n ", "x" * 200_000, good[0]]
    df = docs(*good, *bad, *toxic, *odd)
    labels = spark.createDataFrame([(n, int(not 60 <= n < 120), int(120 <= n < 150)) for n in range(150)] + [(None, 1, 1), (3, None, None), (5, 7, 7), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    return df, labels


def test_quality_of_odd_texts(spark, labelled):
    df, labels = labelled
    model = Q.train(df, labels, F.lit(False))
    scored = {r.doc_id: r for r in Q.score_quality(df.withColumn("ratio", F.lit("clash")), model).collect()}
    assert len(scored) == 155 and np.mean([scored[n].score >= 0.7 for n in range(60)]) > 0.9 and np.mean([scored[n].score < 0.7 for n in range(60, 120)]) > 0.9
    assert scored[150].score == scored[151].score == model.share and scored[154].score == scored[0].score and scored[0].ratio == "clash"
    kept = {r.doc_id for r in Q.keep_good(df, model).select("doc_id").collect()}
    assert kept == {i for i, r in scored.items() if r.score >= 0.7}


def test_quality_without_labels(spark, labelled):
    df, labels = labelled
    none = Q.train(df, labels.limit(0), F.lit(False))
    assert Q.score_quality(df, none).select("score").distinct().first().score == 0.5
    assert Q.score_quality(df.limit(0), Q.train(df, labels, F.lit(False))).count() == 0


def test_toxic_passages(spark, labelled):
    df, labels = labelled
    model = X.train(df, labels, F.lit(False))
    rows = {r.doc_id: r for r in X.score_toxicity(df.withColumn("score", F.lit(9)), model).collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    assert min(rows[n].score for n in range(120, 150)) > max(rows[n].score for n in range(120))
    p = rows[120].passages[0]
    assert texts[120][p.start : p.end] == "vileword nastyterm vileword" and p.p_value <= 0.05
    assert rows[150].score == rows[151].score and len(rows) == 155


def test_passages_after_letters_that_grow_in_lower_case(spark, labelled, docs):
    df, labels = labelled
    model = X.train(df, labels, F.lit(False))
    text = "\u0130x a\u0130b \u0130\u0130 Vileword NASTYTERM vileword and more"
    (p,) = X.score_toxicity(docs(text), model).first().passages
    assert text[p.start : p.end] == "Vileword NASTYTERM vileword"


def test_scores_equal_brute_force(spark, labelled):
    """Given a model, scores are those of plain loops over words, segments and compressed pieces."""
    df, labels = labelled
    model = X.train(df, labels, F.lit(False))
    scored = {r.doc_id: r.score for r in X.score_toxicity(df, model).collect()}
    for r in df.collect():
        values = []
        for w in X._WORD.findall(r.text or ""):
            best = max((model.features[f] for f in X._of_word(w.lower()) if f in model.features), key=lambda v: v[1], default=(0.0, 0))
            values.append(best[0] or model.drift)
        sums = []
        while values and max(values) > 0 and len(values) < 500:
            total, a, b = max((sum(values[i:j]), i, j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)) if len(values) < 80 else (0, 0, len(values))
            if not total:
                sums = None
                break
            sums.append(total)
            values[a:b] = [-1e9]
        if sums is None or len(values) >= 500:
            continue
        n = len(X._WORD.findall(r.text or ""))
        want = X.logistic(model.weights, np.array([model.extremes(n, [(s, 0, 0) for s in sums])]))[0]
        assert abs(scored[r.doc_id] - want) < 1e-9
    quality = Q.train(df, labels, F.lit(False))
    one = {r.doc_id: r.score for r in Q.score_quality(df, quality).collect()}
    pair = [Q.zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=Q.zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (quality.good, quality.bad)]
    for r in df.where("doc_id < 130").collect():
        raw = r.text.encode()
        good, bad = (sum(len(c.compress(raw[i : i + Q.PIECE])) for i in range(0, len(raw), Q.PIECE)) for c in pair)
        assert abs(one[r.doc_id] - Q.logistic(quality.weights, np.array([[50 * (bad - good) / len(raw)]]))[0]) < 1e-6


def test_segments_are_maximal():
    def brute(scores):
        """Repeatedly the best-scoring run of what is left, its first and shortest form."""
        out = []

        def within(a, b):
            best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
            if best and best[0] > 0:
                out.append((best[3], best[4] - 1))
                within(a, best[3])
                within(best[4], b)

        within(0, len(scores))
        return sorted(out)

    rng = random.Random(5)
    for _ in range(300):
        drift = -1.5
        scores = [rng.choice([drift, drift, 1.0, 2.25, 3.5]) for _ in range(rng.randint(1, 14))]
        found = X.segments([(i, s) for i, s in enumerate(scores) if s > 0], drift)
        assert [(a, b) for _, a, b in found] == brute(scores), scores
        assert all(abs(sum(scores[a : b + 1]) - s) < 1e-9 for s, a, b in found)


def test_toxicity_without_labels(spark, labelled):
    df, labels = labelled
    assert X.score_toxicity(df, X.train(df, labels.limit(0), F.lit(False))).where("score BETWEEN 0 AND 1").count() == 155
