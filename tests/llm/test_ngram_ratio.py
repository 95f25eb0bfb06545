"""The quality rules against plain loops, and what the ratio does on labelled and on odd texts."""

import re
from collections import Counter

import compare
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftstone.llm import ngram_ratio as R
from siftstone.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def plain(text):
    """The fixed rules, word by word."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    in_some = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(in_some), n < 20 or 100 * len(in_some) > 30 * n


ODD = [
    None, "", " \n\t\r\v\f ", "a", "one two\none two\n\n \none two \n", "x y   z\x1cq\x85w", "größe 漢字 é " * 9, "# * $ % & | < >" * 4, "a b c d e f g h " * 2, "a b c d e f g h i a b c d e f g h",
    "w " * 7, "w " * 8, "w " * 9, " ".join(map(str, range(60))), " ".join(map(str, range(40))) + " " + " ".join(map(str, range(8))), "long " * 60_000, "x" * 300_000, "\n".join(["same line of words"] * 500),
]


def test_rules_equal_brute_force(spark, docs):
    rng = np.random.default_rng(4)
    texts = ODD + [" ".join(rng.choice(["a", "b", "c\n", "|d"], rng.integers(0, 60))) for _ in range(150)]
    df = docs(*texts).withColumns({"kept": F.lit("clash"), "llr": F.lit(1), "_rest": F.lit(2), "n words.x": F.lit(3)})
    rows = {r.doc_id: r for r in R.judged(df, R.RulesModel(None, 0.0)).collect()}
    assert len(rows) == len(texts)
    for n, t in enumerate(texts):
        assert tuple(rows[n][c] for c in BASE) == plain(t), t and t[:80]
        assert rows[n].kept == (not rows[n].base_failed) and rows[n].llr is None and rows[n]["n words.x"] == 3 and rows[n]["_rest"] == 2


def brute_buckets(text):
    """Buckets of words and pairs by Python's whole numbers."""
    mask = (1 << 64) - 1
    h = [xxhash.xxh3_64_intdigest(w) for w in (text or "").encode().split()]
    pairs = [(a * 0xC2B2AE3D27D4EB4F + b * 0x165667B19E3779F9) & mask for a, b in zip(h, h[1:])]
    pairs = [p ^ (p >> 29) for p in pairs]
    return [((x * 0x9E3779B97F4A7C15) & mask) >> 48 for x in h + pairs]


def test_ratio_and_threshold_equal_brute_force(spark, docs):
    rng = np.random.default_rng(5)
    good = [" ".join(rng.choice([f"good{i}" for i in range(50)], 40)) for _ in range(40)]
    bad = [" ".join(rng.choice([f"spam{i}" for i in range(50)], 40)) for _ in range(40)]
    df = docs(*good, *bad, None, "", "too short")
    labels = spark.createDataFrame([(n, int(n < 40)) for n in range(80) if n % 4] + [(None, 1), (5, None), (6, 7), (9999, 1)], "doc_id long, quality int")
    model = R.train(df, labels)
    raw = Counter(b for t in good + bad + [None, "", "too short"] for b in brute_buckets(t))
    total = sum(raw.values())
    part = {r.doc_id: r.part for r in R.labelled_sample(df, labels.where("quality = 1"), "quality", F.lit(False), 1000).collect()}
    assert set(part) == {n for n in range(40) if n % 4}

    def score(text, fold):
        target = Counter(b for n, p in part.items() if int(p * R.FOLDS) != fold for b in brute_buckets(good[n]))
        n = sum(target.values())
        terms = [np.log((target[b] + R.PRIOR * raw[b] / total) / (n + R.PRIOR) / (raw[b] / total)) for b in brute_buckets(text)]
        return sum(terms) / len(terms)

    own = sorted(score(good[n], int(p * R.FOLDS)) for n, p in part.items())
    assert model.threshold == pytest.approx(own[0], abs=1e-12)
    for r in R.judged(df, model).collect():
        text = (good + bad + [None, "", "too short"])[r.doc_id]
        assert (r.llr is None) == (not (text or "").split())
        if text:
            assert r.llr == pytest.approx(score(text, None), abs=1e-9)
        assert r.kept == (not r.base_failed and r.llr >= model.threshold) and r.kept == (r.doc_id < 40)


def test_every_trusted_text_counts(spark, docs, monkeypatch):
    assert not hasattr(R, "SAMPLE")
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(300)], 30)) for _ in range(300)]
    df, labels = docs(*texts), spark.createDataFrame([(n, 1) for n in range(200)], "doc_id long, quality int")
    monkeypatch.setattr(R, "BARS", 4)
    model = R.train(df, labels, share=0.4)
    raw = np.bincount([b for t in texts for b in brute_buckets(t)], minlength=R.BUCKETS)
    folds = {r.doc_id: r.fold for r in R.trusted_folds(labels).collect()}
    target = np.array([np.bincount([b for n, f in folds.items() if f == k for b in brute_buckets(texts[n])], minlength=R.BUCKETS) for k in range(R.FOLDS)])
    assert np.array_equal(model.ratio, R.ratios(target.sum(axis=0), raw))
    own = sorted(np.mean(R.ratios(target.sum(axis=0) - target[f], raw)[brute_buckets(texts[n])]) for n, f in folds.items())
    assert model.threshold == pytest.approx(own[80], abs=1e-12) and own[79] < own[80] < own[81]
    # A shuffle join gives the same.
    monkeypatch.setattr(R, "BROADCAST_IDS", 0)
    assert R.train(df, labels, share=0.4).threshold == model.threshold


@pytest.mark.parametrize("values", [[1.0], [2.0] * 50, [-1.7e308, 1.7e308, 0.0, 0.0, 5e-324], [float(x) for x in np.random.default_rng(1).normal(size=500).round(1)]])
def test_nth_smallest(spark, monkeypatch, values):
    monkeypatch.setattr(R, "BARS", 4)
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [R.nth_smallest(df, n) for n in range(0, len(values), 1 + len(values) // 6)] == sorted(values)[:: 1 + len(values) // 6]


def test_tables_without_rows_or_labels(spark, docs):
    df = docs("word " * 5, " ".join(map(str, range(30))))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in R.judged(df, R.train(df, none)).orderBy("doc_id").collect()] == [False, True]
    some = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert R.judged(df.limit(0), R.train(df, some)).count() == 0 and R.train(df.limit(0), some).ratio is None


def test_query_keeps_good_documents(spark):
    sf = compare.DATA.replace("0.001", "0.1")
    rows = QUERIES["op12_quality_rules"](spark, sf).toPandas()
    con = compare.oracle(sf)
    texts = con.sql("SELECT doc_id, text FROM documents WHERE doc_id % 7 = 0").df().set_index("doc_id").text.to_dict()
    assert len(rows) == 10_000 and rows.doc_id.is_unique
    for r in rows[rows.doc_id.isin(texts)].itertuples():
        assert tuple(getattr(r, c) for c in BASE) == plain(texts[r.doc_id])
    m = rows.merge(con.sql("SELECT doc_id, quality AS y FROM labels").df(), on="doc_id")
    m = m[~m.base_failed]
    assert m[m.y == 1].kept.mean() >= 0.99 and m[m.y == 0].kept.mean() <= 0.05
    again = QUERIES["op12_quality_rules"](spark, sf).toPandas()
    assert dict(zip(again.doc_id, again.llr.fillna(0))) == dict(zip(rows.doc_id, rows.llr.fillna(0)))
