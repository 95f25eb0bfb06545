"""Splits where likeness drops, against all ways of cutting."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from siftstone.operators import chunking
from siftstone.plans import config


def all_cuts(n):
    for k in range(n):
        yield from itertools.combinations(range(1, n), k)


def test_pieces_are_the_best_of_all_cuts():
    rng = random.Random(2)
    for _ in range(250):
        n = rng.randint(1, 8)
        sizes = [rng.randint(1, 12) for _ in range(n)]
        ends = list(itertools.accumulate(sizes))
        places = [(e - s, e) for s, e in zip(sizes, ends)]
        alike = [round(rng.uniform(-0.2, 1), 2) for _ in range(n)]
        budget, least, threshold = rng.randint(12, 30), rng.choice([0, 4]), 0.3
        cost = lambda a, b: b - a
        options = []
        for cut in all_cuts(n):
            borders = [0, *cut, n]
            pieces = [(places[a][0], places[b - 1][1]) for a, b in zip(borders, borders[1:])]
            if all(b - a <= budget for a, b in pieces):
                small = sum(b - a < least for a, b in pieces) if cut else 0
                options.append((small, round(sum(alike[i - 1] - threshold for i in cut), 9), len(cut), pieces))
        got = chunking.best_pieces(places, alike, cost, budget, least, threshold)
        best = min(o[:3] for o in options)
        assert any(o[3] == got and (o[0], pytest.approx(o[1], abs=1e-6), o[2]) == (best[0], best[1], best[2]) for o in options)


def topics():
    """A model that knows two topics, by their first letter."""
    return lambda texts: [[float(t[:1] in "AB"), float(t[:1] not in "AB")] for t in texts]


def flagged(spark, *texts):
    rows = [(f"c{n}", "d", t, t, ["H"], True, 1, 0, None, 0, len(t), 1, None) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, context_text string, heading_path array<string>, needs_semantic_split boolean, hierarchy_level int, position int, lc_group_id string, char_start int, char_end int, token_count int, parent_id string")


def test_chunks_are_cut_where_the_topic_changes(spark):
    text = "Apples are red. Also green ones grow. Bananas are yellow fruit. Zinc is a metal. Xenon is a gas. Yttrium is a rare thing indeed."
    budget = chunking.Budget(max_tokens=100, context_tokens=0, similarity=0.3)
    rows = chunking.semantic_split(flagged(spark, text), budget, topics()).orderBy("position").collect()
    assert [r.text for r in rows] == ["Apples are red. Also green ones grow. Bananas are yellow fruit.", "Zinc is a metal. Xenon is a gas. Yttrium is a rare thing indeed."]
    assert all(r.parent_id == "c0" and text[r.char_start : r.char_end] == r.text for r in rows)
    # Without a model the sentences are packed, and so they are where the model fails or a sentence is too long.
    assert chunking.semantic_split(flagged(spark, text), budget).count() == 1

    def down(texts):
        raise RuntimeError("down")

    assert chunking.semantic_split(flagged(spark, text), budget, down).count() == 1
    odd = chunking.semantic_split(flagged(spark, "x" * 1000, "", "One. Two."), budget, topics()).collect()
    assert "".join(r.text for r in odd if r.chunk_id.startswith("c0") or r.parent_id == "c0") == "x" * 1000


def test_the_budget_forces_cuts_between_the_least_alike(spark):
    sentences = [f"Apples number {n} are red and sweet and round." for n in range(12)]
    budget = chunking.Budget(max_tokens=60, context_tokens=0, similarity=-1.0)
    rows = chunking.semantic_split(flagged(spark, " ".join(sentences)), budget, topics()).withColumn("n", F.length("text")).orderBy("position").collect()
    assert len(rows) > 1 and " ".join(r.text for r in rows) == " ".join(sentences) and all((r.n + 2) // 3 <= 60 for r in rows)


def test_the_strategy_comes_from_the_configuration():
    assert chunking.Budget().similarity is None and config.Budget is chunking.Budget
