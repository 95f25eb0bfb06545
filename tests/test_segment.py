"""Segmentation against all ways of cutting short texts, discovery against plain counts, and search in two grain sizes."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftstone.operators import dense, lexical, segment
from siftstone.plans import ingest, query
from siftstone.plans.config import Retriever

WORDS = {"北京": 50, "大学": 80, "北京大学": 20, "学生": 60, "大学生": 30, "生": 5, "活": 5, "生活": 40, "前来": 10, "应聘": 10}


def all_cuts(run):
    if not run:
        yield []
    for j in range(1, len(run) + 1):
        for rest in all_cuts(run[j:]):
            yield [run[:j], *rest]


def test_the_coarse_path_is_the_likeliest_of_all():
    rng = random.Random(1)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 4))): rng.randint(1, 50) for _ in range(14)}
    d = segment.Dictionary(words)
    for _ in range(300):
        run = "".join(rng.choices("abcd", k=rng.randint(1, 9)))
        known = [c for c in all_cuts(run) if all(w in words or len(w) == 1 for w in c)]
        price = lambda c: sum(d.cost.get(w, d.unknown) for w in c)
        best = min((round(price(c), 9), len(c)) for c in known)
        got = d.coarse(run)
        assert "".join(got) == run and (round(price(got), 9), len(got)) == best
        # Fine terms: every word at every place, and what no word covers; coarse words are among them.
        places = Counter(run[i:j] for i in range(len(run)) for j in range(i + 1, len(run) + 1) if run[i:j] in words)
        bare = Counter(c for k, c in enumerate(run) if not any(run[i:j] in words for i in range(k + 1) for j in range(k + 1, len(run) + 1)))
        assert Counter(d.fine(run)) == places + bare and not Counter(got) - Counter(d.fine(run))


def test_texts_of_several_scripts(spark):
    df = spark.createDataFrame([(w, n) for w, n in WORDS.items()] + [(None, 3), (" ", 3), ("无", 0), ("大学", 1)], "word string, n int")
    d = segment.Dictionary.of(df)
    assert set(d.cost) == set(WORDS) and d.total == sum(WORDS.values()) + 1
    texts = spark.createDataFrame([(0, "北京大学生前来应聘 at PKU2"), (1, None), (2, ""), (3, "plain words, 3 of them"), (4, "龘北京"), (5, "生" * 3000)], "n int, t string")
    coarse, fine = ({r.n: r.x for r in texts.select("n", segment.tokens(d, g)(F.col("t")).alias("x")).collect()} for g in ("coarse", "fine"))
    assert coarse[0] == ["北京", "大学生", "前来", "应聘", "at", "pku2"] and fine[0] == ["北京大学", "北京", "大学生", "大学", "学生", "生", "前来", "应聘", "at", "pku2"]
    assert coarse[1] == fine[1] == coarse[2] == [] and coarse[3] == fine[3] == ["plain", "words", "3", "of", "them"] and coarse[4] == ["龘", "北京"] and len(coarse[5]) == 3000


def test_a_dictionary_beyond_its_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(segment, "MAX_WORDS", 10)
    with pytest.raises(ValueError, match="more than 10"):
        segment.Dictionary.of(spark.range(11).select(F.col("id").cast("string").alias("word"), F.lit(1).alias("n")))


def test_search_in_two_grains(spark):
    d = segment.Dictionary(WORDS)
    chunks = spark.createDataFrame([("a", "北京大学"), ("b", "大学生活"), ("c", "应聘"), ("d", "学生")], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "大学"), (2, "学生"), (3, "北京大学"), (4, "生活")], "query_id int, query string")
    index = lexical.postings(chunks, tokens=segment.tokens(d, "fine"))
    found = lexical.bm25_topk(index, queries, 5, tokens=segment.tokens(d, "coarse"))
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    # The whole word meets only the text that has it; its parts are found within longer words.
    assert set(got[1]) == {"a", "b"} and set(got[2]) == {"b", "d"} and got[3] == ["a"] and got[4] == ["b"]


def test_an_engine_with_a_dictionary(spark, tmp_path):
    engine = ingest.Engine(spark, str(tmp_path), {"v": (dense.hashing_provider(8), 8, "1")}, buckets=2, dictionary=segment.Dictionary(WORDS))
    engine.add(spark.createDataFrame([("a", "北京大学的学生"), ("b", "生活")], "doc_id string, raw_text string"))
    asked = query.preprocess(spark.createDataFrame([(1, "学生生活")], "query_id int, query string"))
    hits = query.retrieve(asked, engine.corpus(), [Retriever("l", "lexical")], query.Models(), query.Filters(), None)
    assert hits.count() == 2 and {r[0] for r in engine.table("postings").select("term").collect()} >= {"北京大学", "北京", "大学", "学生", "的", "生活"}


def test_discovery_equals_plain_counts(spark):
    rng = random.Random(3)
    pieces = ["alpha", "beta", "gam", "delt"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 6))) for _ in range(300)] + [None, "", "a1b", "x" * 2000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = segment.grams(df, 6, run="[a-z]")
    n = Counter()
    runs = [r for t in texts if t for r in t.replace("1", " ").split()]
    for r in runs:
        n.update(r[i : i + k] for k in range(1, 7) for i in range(len(r) - k + 1))
    assert {r.gram: r.n for r in counts.collect()} == dict(n)
    total = sum(v for g, v in n.items() if len(g) == 1)
    want = {}
    for w, c in n.items():
        if 2 <= len(w) <= 5 and c >= 5:
            held = min(math.log(c * total / n[w[:k]] / n[w[k:]]) for k in range(1, len(w)))
            free = min(math.log(c) - sum(v * math.log(v) for g, v in n.items() if len(g) == len(w) + 1 and inner(g) == w) / c for inner in (lambda g: g[:-1], lambda g: g[1:]))
            if held >= 1 and free >= 0.5:
                want[w] = (c, held, free)
    got = {r.word: (r.n, r.cohesion, r.freedom) for r in segment.discover(counts, 5).collect()}
    assert got.keys() == want.keys() and all(got[w] == pytest.approx(want[w], abs=1e-9) for w in want)
    assert {"alpha", "beta", "delt", "gam"} <= got.keys() and "lph" not in got
    assert segment.discover(segment.grams(df.limit(0), 6), 5).count() == 0
