"""Segmentation of text without spaces by a dictionary, in two grain sizes, and discovery of words where there is no dictionary.

Fine, for indexing: every dictionary word that stands in a run, and each character that none covers. Coarse, for queries: the one path of words over
the run that is likeliest under the words' frequencies. Every word of the coarse path is among the fine ones, so a query meets what the
index has. A run is a maximal sequence of characters of the kind `run` (CJK by default); all other text is cut as lexical.lexical_tokens does.

A dictionary is a table (word, n). It travels to the tasks whole, so it is counted first and refused beyond MAX_WORDS.

Discovery counts all character sequences of a text's runs, up to a length, and keeps those that hold together (cohesion: how much likelier the word is
than its best split by chance) and stand freely (entropy of what comes before and after). It is joins and sums of counts only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.text import CJK

MAX_WORDS = 500_000


class Dictionary:
    """Words with their frequencies, as a trie of prefixes."""

    def __init__(self, words: dict[str, int]):
        self.total = max(1, sum(words.values()))
        self.cost = {w: -math.log(max(1, n) / self.total) for w, n in words.items() if w}
        #: A character that no word has costs more than any word.
        self.unknown = -math.log(0.5 / self.total)
        self.prefixes = {w[:k] for w in self.cost for k in range(1, len(w) + 1)}

    @staticmethod
    def of(table: DataFrame, word: str = "word", n: str = "n") -> Dictionary:
        """From a table of words, lower-cased; the counts of equal words add up. Null, blank and uncounted words count as not there."""
        words = table.select(F.lower(F.trim(F.col(word))).alias("word"), F.col(n).cast("long").alias("n")).where("word <> '' AND n > 0").groupBy("word").agg(F.sum("n").alias("n"))
        rows = words.limit(MAX_WORDS + 1).collect()
        if len(rows) > MAX_WORDS:
            raise ValueError(f"the dictionary has more than {MAX_WORDS} words")
        return Dictionary({r.word: r.n for r in rows})

    def matches(self, run: str) -> Iterator[tuple[int, int]]:
        """(start, end) of all words in a run, by start and then the longest first."""
        for i in range(len(run)):
            ends, j = [], i + 1
            while j <= len(run) and run[i:j] in self.prefixes:
                if run[i:j] in self.cost:
                    ends.append(j)
                j += 1
            for j in reversed(ends):
                yield i, j

    def fine(self, run: str) -> list[str]:
        out, covered = [], 0
        for i, j in self.matches(run):
            out += list(run[covered:i])
            out.append(run[i:j])
            covered = max(covered, j)
        return out + list(run[covered:])

    def coarse(self, run: str) -> list[str]:
        """The likeliest path; of equally likely ones that of fewer words, and then of the longer first word."""
        ends: list[list[int]] = [[] for _ in run]
        for i, j in self.matches(run):
            ends[i].append(j)
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)] * (len(run) + 1)
        for i in reversed(range(len(run))):
            steps = [(self.cost[run[i:j]] + best[j][0], best[j][1] + 1, j) for j in ends[i]]
            if i + 1 not in ends[i]:
                steps.append((self.unknown + best[i + 1][0], best[i + 1][1] + 1, i + 1))
            best[i] = min(steps, key=lambda s: (round(s[0], 9), s[1], -s[2]))
        out, i = [], 0
        while i < len(run):
            out.append(run[i : best[i][2]])
            i = best[i][2]
        return out


def tokens(dictionary: Dictionary, grain: str, run: str = CJK) -> Callable[[Column], Column]:
    """A tokeniser for lexical.tokenised() and query_terms(): grain is "fine" or "coarse", run a character class."""
    cut = {"fine": dictionary.fine, "coarse": dictionary.coarse}[grain]

    a_run = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), run) + "+")

    @F.pandas_udf("array<string>")
    def of_words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda words: [t for w in words for t in (cut(w) if a_run.fullmatch(w) else [w])])

    def of(text: Column) -> Column:
        spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"({run}+)", " $1 ")
        return of_words(F.regexp_extract_all(spaced, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))

    return of


def grams(texts: DataFrame, longest: int, text: str = "text", run: str = CJK) -> DataFrame:
    """(gram, n): the counts of all character sequences of up to `longest` characters within runs, summed in each task before they are dealt."""
    runs = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"{run}+"), F.lit(0))).alias("run"))
    at = lambda k: F.transform(F.sequence(F.lit(1), F.length("run") - k + 1), lambda i: F.substr("run", i, F.lit(k)))
    every = F.flatten(F.array(*[F.when(F.length("run") >= k, at(k)).otherwise(F.array().cast("array<string>")) for k in range(1, longest + 1)]))
    return runs.select(F.explode(every).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def discover(counts: DataFrame, longest: int, least: int = 5, cohesion: float = 1.0, entropy: float = 0.5) -> DataFrame:
    """(word, n, cohesion, freedom) of counts of grams() up to longest + 1 characters, a table: sequences of 2 to `longest` characters that occur `least` times.

    cohesion: the least of ln(p(word) / (p(left) p(right))) over its splits. freedom: the lesser of the entropies of what follows and what comes before; the
    ends of runs count as neighbours of their own each.
    """
    total = counts.where(F.length("gram") == 1).agg(F.sum("n").alias("total"))
    words = counts.where((F.length("gram") >= 2) & (F.length("gram") <= longest) & (F.col("n") >= least)).select(F.col("gram").alias("word"), "n")
    cuts = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k")).select("word", "n", F.expr("left(word, k)").alias("a"), F.expr("substr(word, k + 1)").alias("b"))
    part = lambda c: counts.select(F.col("gram").alias(c), F.col("n").alias(f"n_{c}"))
    held = cuts.join(part("a"), "a").join(part("b"), "b").join(F.broadcast(total)).groupBy("word", "n").agg(F.min(F.log(F.col("n") * F.col("total") / F.col("n_a") / F.col("n_b"))).alias("cohesion"))
    sides = []
    for side, inner in (("after", F.expr("left(gram, length(gram) - 1)")), ("before", F.expr("substr(gram, 2)"))):
        near = counts.where(F.length("gram") >= 3).select(inner.alias("word"), (F.col("n") * F.log("n")).alias("x")).groupBy("word").agg(F.sum("x").alias(side))
        sides.append(near)
    joined = reduce(lambda df, s: df.join(s, "word", "left"), sides, held.where(F.col("cohesion") >= cohesion))
    free = lambda side: F.log("n") - F.coalesce(side, F.lit(0.0)) / F.col("n")
    return joined.withColumn("freedom", F.least(free("after"), free("before"))).where(F.col("freedom") >= entropy).select("word", "n", "cohesion", "freedom")
