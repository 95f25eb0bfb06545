"""Benchmark decontamination by template windows.

Texts are cut at white space and each token is stripped of punctuation. A text has two forms. The plain one is its tokens in lower case; it finds
literal copies whatever they consist of and in any case. The template is a sequence of units: numbers, units of measure and names become typed placeholders,
other tokens their lower case. Number words in a row are one number, capitalised words in a row one name, and "5km" is a number and a unit, so values of
another number of tokens still align; a single capitalised word that begins a sentence is no name.

1. The windows of WINDOW units or tokens of the benchmark's distinct texts are a table (hash, item, place). A bit map of bounded size says which hashes it may have.
2. One pass over the documents writes those with a window that the map lets through: their text, and the hashes and places of these windows.
3. Their hashes are joined with the benchmark's, which is broadcast if its rows are few and shuffled if not; equal texts count once.
4. The hits of a text and an item on one diagonal (document place less item place) are merged to stretches, and stretches that follow one
   another in both to occurrences. An occurrence must be consistent in its slots: a value of the item's slot stands for one value of the document, and different
   values for different ones. So a question with other numbers and names still matches, and a text that merely has the same shape doesn't. Where that fails, stretches
   are cut at the slots in conflict (a pair of values stays where it is the commonest of both its values) and pieces of a window's width count.
A document leaks an item if stretches and pieces cover RUN tokens of it in one piece, or SHARE of its tokens in all.

Template windows with fewer than LITERALS other units are too vague to be looked up; windows of plain tokens all are. Items shorter than
WINDOW are one window. Items of equal text are one item, under their smallest id, with the number of them beside it.

Null and empty texts match nothing. Repeated rows are documents of their own. Ties don't arise: all leaked items are reported.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from siftstone.llm.common import arrow_rows, table, written

WINDOW, LITERALS, RUN, SHARE, MEMO_WORDS = 8, 4, 13, 0.5, 300_000
#: Bits of the map of window hashes, as a power of 2, and rows of a broadcast.
MAP_BITS, BROADCAST_ROWS = 27, 500_000
#: Unit words, number words, and capitalised words that are no names.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg lb lbs oz ml l s sec min h hr hrs meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
NO_NAMES = frozenset("a an the and or but if in on at of to for from by with as is are was were be been it its this that these those he she they we you i his her their our your my what which who whom whose when where why how do does did has have had can could will would shall should may might must not no".split())
LITERAL, NUM, WORD_NUM, UNIT, NAME, MEASURE = range(6)
_EDGE = re.compile(r"^[^\w$€£%+-]+|[^\w%]+$")
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_MEASURE = re.compile(r"([+-]?\d[\d.,]*)([A-Za-z]+)")


_WORDS = dict.fromkeys(NO_NAMES, LITERAL) | dict.fromkeys(UNITS, UNIT) | dict.fromkeys(NUMBERS, WORD_NUM)


def bare(token: str) -> str:
    return token if token.isalpha() else _EDGE.sub("", token)


def plain(token: str) -> str:
    """A token in lower case without punctuation, if that leaves something."""
    return (bare(token) or token).lower()


def _kind(b: str, low: str) -> int:
    if (k := _WORDS.get(low)) is not None:
        return k
    if not b.isalpha():
        if _NUMBER.fullmatch(b):
            return NUM
        if (m := _MEASURE.fullmatch(b)) and m[2].lower() in UNITS:
            return MEASURE
        if "-" in low and all(w in NUMBERS for w in low.split("-")):
            return WORD_NUM
    return NAME if b[:1].isupper() and b[1:].islower() else LITERAL


def kind(token: str) -> int:
    """What a token is, seen alone."""
    b = bare(token)
    return _kind(b, b.lower())


def _placeholder(k: int) -> int:
    """Odd for placeholders, even for literals; numbers in words and in digits are alike."""
    return xxhash.xxh3_64_intdigest(f"\x00{NUM if k == WORD_NUM else k}") | 1


_PLACEHOLDERS = np.array([_placeholder(k) for k in range(6)], np.uint64)


class Forms:
    """Tokens to their two forms."""

    def __init__(self):
        self.number, self.codes, self.kinds, self.ends = {}, array("Q"), array("b"), array("b")

    def _add(self, token: str) -> None:
        b = bare(token)
        low = b.lower()
        self.codes.append(xxhash.xxh3_64_intdigest(low or token.lower()) & ~1)
        self.kinds.append(_kind(b, low))
        self.ends.append(b is not token and (token[-1] in ".!?:" or token[-2:-1] in (".", "!", "?")))
        self.number[token] = len(self.number)

    def __call__(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(plain codes, unit codes, first token of each unit, kind of each unit)."""
        if not tokens:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none.astype(np.uint64), none, none
        if len(self.number) > MEMO_WORDS:
            self.__init__()
        try:
            at = np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            for token in tokens:
                if token not in self.number:
                    self._add(token)
            at = np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))
        codes = np.frombuffer(self.codes, np.uint64)[at]
        kinds = np.frombuffer(self.kinds, np.int8)[at].astype(np.int64)
        special = np.flatnonzero(kinds)
        if not len(special):
            return codes, codes, np.arange(len(codes)), kinds
        ends = np.frombuffer(self.ends, np.int8)[at]
        names = kinds == NAME
        alone = names & ~np.append(names[1:], False) & np.append(True, ends[:-1] > 0)
        kinds[alone] = LITERAL
        units = np.where(kinds > 0, _PLACEHOLDERS[kinds], codes)
        again = np.zeros(len(kinds), bool)
        again[1:] = (kinds[1:] == kinds[:-1]) & ((kinds[1:] == NAME) | (kinds[1:] == WORD_NUM)) & ~(ends[:-1] > 0)
        first = np.flatnonzero(~again)
        units, kinds = units[first], kinds[first]
        measures = kinds == MEASURE
        if measures.any():
            times = 1 + measures
            second = np.cumsum(times)[measures] - 1
            units, kinds, first = (np.repeat(x, times) for x in (units, kinds, first))
            units[second - 1], units[second] = _PLACEHOLDERS[NUM], _PLACEHOLDERS[UNIT]
            kinds[second - 1], kinds[second] = MEASURE, UNIT
        return codes, units, first, kinds


_MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(f"template {i}") | 1 for i in range(WINDOW)], np.uint64)


def _windows(codes: np.ndarray, width: int, template: bool) -> np.ndarray:
    """Hash of each window."""
    n = max(0, len(codes) - width + 1)
    h = np.full(n, 2 * width + template, np.uint64)
    mixed = codes ^ (codes >> np.uint64(29))
    for i in range(width):
        h += mixed[i : i + n] * _MULTIPLIERS[i]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _clear(codes: np.ndarray, width: int) -> np.ndarray:
    """Whether each window has enough literals."""
    literal = np.concatenate([[0], np.cumsum((codes & np.uint64(1)) == 0)])
    return literal[width:] - literal[:-width] >= min(LITERALS, width)


class Sample:
    """A text with its forms, as the comparison of two texts needs them."""

    def __init__(self, text: str, forms: Forms):
        self.tokens = text.split()
        _, _, first, self.kinds = forms(self.tokens)
        self.first = [*first.tolist(), len(self.tokens)]

    def span(self, unit: int) -> tuple[int, int]:
        """The tokens of a unit."""
        a = self.first[unit]
        return a, max(a + 1, self.first[unit + 1])

    def value(self, unit: int) -> str | None:
        """What stands in a slot; None for a literal."""
        if not self.kinds[unit]:
            return None
        a, b = self.span(unit)
        if m := _MEASURE.fullmatch(bare(self.tokens[a])):
            return m[1] if self.kinds[unit] == MEASURE else m[2].lower()
        return " ".join(bare(t) for t in self.tokens[a:b])


def leak(item: Sample, doc: Sample, hits: list[tuple[bool, int, int, int]]) -> tuple[int, int, int, bool] | None:
    """(covered tokens, first token, last token, verbatim) from hits (template, width, item place, document place), or None."""
    covered, spans, longest, verbatim = set(), [], 0, True
    for template in (False, True):
        diagonals = defaultdict(list)
        for of, width, i, p in hits:
            if of == template:
                diagonals[p - i].append((i, i + width))
        stretches = sorted((shift + a, a, b) for shift, places in diagonals.items() for a, b in _unions(sorted(places)))
        for occurrence in _occurrences(stretches) if template else [[s] for s in stretches]:
            for at, a, b in _consistent(item, doc, occurrence) if template else occurrence:
                if template:
                    a_, b_, at_, end_ = item.first[a], item.span(b - 1)[1], doc.first[at], doc.span(at + b - a - 1)[1]
                else:
                    a_, b_, at_, end_ = a, b, at, at + b - a
                covered.update(range(a_, b_))
                longest = max(longest, b_ - a_)
                spans.append((at_, end_ - 1))
                verbatim &= item.tokens[a_:b_] == doc.tokens[at_:end_]
    n = len(item.tokens)
    if covered and (longest >= min(RUN, n) or len(covered) >= SHARE * n):
        return len(covered), min(s for s, _ in spans), max(e for _, e in spans), verbatim
    return None


def _unions(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of overlapping or touching windows."""
    out: list[list[int]] = []
    for a, b in places:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _occurrences(stretches: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Stretches (document place, item start, item end) in document order, dealt into runs that go on in the item too."""
    out: list[list[tuple[int, int, int]]] = []
    for s in stretches:
        if out and s[1] >= out[-1][-1][2]:
            out[-1].append(s)
        else:
            out.append([s])
    return out


def _consistent(item: Sample, doc: Sample, occurrence: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The stretches of an occurrence where its slots agree, else the pieces between slots in conflict."""
    pairs = [[(item.value(a + k), doc.value(at + k)) if item.kinds[a + k] else None for k in range(b - a)] for at, a, b in occurrence]
    times = Counter(p for of in pairs for p in of if p)
    rivals = [defaultdict(list), defaultdict(list)]
    for pair, n in times.items():
        for side, value in zip(rivals, pair):
            side[value].append(n)
    if all(len(r) == 1 for side in rivals for r in side.values()):
        return occurrence
    stays = {p for p in times if all(max(r) == times[p] and r.count(times[p]) == 1 for r in (rivals[0][p[0]], rivals[1][p[1]]))}
    out = []
    for (at, a, b), of in zip(occurrence, pairs):
        width = min(WINDOW, b - a)
        edges = np.flatnonzero(np.diff(np.array([False, *(p is None or p in stays for p in of), False], np.int8)))
        out += [(at + int(s), a + int(s), a + int(e)) for s, e in zip(edges[::2], edges[1::2]) if e - s >= width]
    return out


# --- tables ----------------------------------------------------------------------------------------------------


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, item, template, width, place) of the windows of items (item, text)."""
    forms = Forms()
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist()):
            codes, units, _, _ = forms(text.split())
            for template, coded in ((False, codes), (True, units)):
                width = min(WINDOW, len(coded))
                if width:
                    h = _windows(coded, width, template)
                    for p in np.flatnonzero(_clear(coded, width)) if template else range(len(h)):
                        for column, value in zip(out, (int(h[p].view(np.int64)), item, template, width, int(p))):
                            column.append(value)
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["hash", "item", "template", "width", "place"])


def _word_bit(hash_: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(hash_, 64 - MAP_BITS + 6), F.shiftrightunsigned(hash_, 64 - MAP_BITS).bitwiseAND(63)


class Benchmark:
    """Distinct items (item, text, item_id, items), their windows, and the map of the hashes."""

    def __init__(self, benchmark: DataFrame, item_id: str = "item_id", text: str = "text"):
        arrow_rows(benchmark.sparkSession)
        rows = benchmark.where(F.length(F.trim(text)) > 0).select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
        distinct = rows.groupBy("text").agg(F.min("item_id").alias("item_id"), F.count("*").alias("items"))
        self.items = written(distinct.withColumn("item", F.monotonically_increasing_id()), "items")
        self.windows = written(self.items.select("item", "text").mapInArrow(_index_rows, "hash long, item long, template boolean, width int, place int"), "windows")
        word, bit = _word_bit(F.col("hash"))
        # The map has a fixed size, however many windows there are.
        one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))
        words = self.windows.groupBy(word.alias("w")).agg(F.bit_or(one).alias("bits")).toArrow()
        self.map = np.zeros(1 << (MAP_BITS - 6), np.uint64)
        self.map[np.asarray(words["w"])] = np.asarray(words["bits"]).view(np.uint64)
        self.widths = sorted((r.template, r.width) for r in self.windows.select("template", "width").distinct().collect())
        self.n_windows = self.windows.count()


def _looker(shared, widths: list[tuple[bool, int]]):
    """Rows whose text has windows that the map knows, with their hashes and places."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, forms = shared.value, Forms()
        for batch in batches:
            at, hashes, places, ends = [], [], [], [0]
            for n, text in enumerate(batch["text"].to_pylist()):
                found = []
                if text:
                    codes, units, _, _ = forms(text.split())
                    for template, width in widths:
                        h = _windows(units if template else codes, width, template)
                        where = np.flatnonzero((known[h >> np.uint64(64 - MAP_BITS + 6)] >> ((h >> np.uint64(64 - MAP_BITS)) & np.uint64(63))) & np.uint64(1))
                        if len(where):
                            found.append((h[where].view(np.int64), where))
                if found:
                    at.append(n)
                    hashes += [h for h, _ in found]
                    places += [p for _, p in found]
                    ends.append(ends[-1] + sum(len(p) for _, p in found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(c) if c else [], t)) for c, t in ((hashes, pa.int64()), (places, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns), *lists], [*batch.schema.names, "hashes", "places"])

    return look


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, item, covered, item_tokens, start, end, verbatim) of texts and the items that they may leak."""
    forms = Forms()
    for batch in batches:
        rows = []
        for k1, k2, text, candidates in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "text", "candidates"))):
            doc, spans = Sample(text, forms), None
            for c in candidates:
                item = Sample(c["text"], forms)
                found = leak(item, doc, [(h["template"], h["width"], h["place"], h["at"]) for h in c["hits"]])
                if found:
                    spans = spans or [m.span() for m in re.finditer(r"\S+", text)]
                    rows.append((k1, k2, c["item"], found[0], len(item.tokens), spans[found[1]][0], spans[found[2]][1], found[3]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, types)]
        yield pa.RecordBatch.from_arrays(cols, ["k1", "k2", "item", "covered", "item_tokens", "start", "end", "verbatim"])


_KEY = ["k1", "k2"]


def _keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _leaked_texts(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates (doc_id, k1, k2, text, hashes, places), leaks by text and item, items) for docs (doc_id, text)."""
    spark, of = docs.sparkSession, Benchmark(benchmark)
    shared = spark.sparkContext.broadcast(of.map)
    keyed = docs.select("doc_id", "text", *_keys(F.col("text")))
    schema = StructType([*keyed.schema.fields, StructField("hashes", ArrayType(LongType())), StructField("places", ArrayType(IntegerType()))])
    candidates = written(keyed.mapInArrow(_looker(shared, of.widths), schema), "candidates")
    shared.destroy()
    once = candidates.groupBy(*_KEY).agg(F.first("hashes").alias("hashes"), F.first("places").alias("places"))
    hits = once.select(*_KEY, F.explode(F.arrays_zip("hashes", "places")).alias("h")).select(*_KEY, F.col("h.hashes").alias("hash"), F.col("h.places").alias("at"))
    windows = F.broadcast(of.windows) if of.n_windows <= BROADCAST_ROWS else of.windows
    pairs = hits.join(windows, "hash").groupBy(*_KEY, "item").agg(F.collect_list(F.struct("template", "width", "place", "at")).alias("hits"))
    told = pairs.join(of.items.select("item", "text"), "item").groupBy(*_KEY).agg(F.collect_list(F.struct("item", "text", "hits")).alias("candidates"))
    met = written(told, "met")
    texts = candidates.join(F.broadcast(met.select(*_KEY)) if met.count() <= BROADCAST_ROWS else met.select(*_KEY), _KEY, "left_semi")
    texts = texts.groupBy(*_KEY).agg(F.first("text").alias("text"))
    judged = texts.join(met, _KEY).select(*_KEY, "text", "candidates").mapInArrow(_judge, "k1 long, k2 long, item long, covered int, item_tokens int, start int, end int, verbatim boolean")
    return candidates, written(judged, "leaks"), of.items


def find_leaks(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, items long, covered int, item_tokens int, start int, end int, verbatim boolean): a row for each distinct leaked item of each row of df.

    item_id is the smallest of the items with that text, items their number.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    candidates, leaks, items = _leaked_texts(docs, benchmark)
    named = leaks.join(items.select("item", "item_id", "items"), "item")
    named = F.broadcast(named) if leaks.count() <= BROADCAST_ROWS else named
    return candidates.select("doc_id", *_KEY).join(named, _KEY).select("doc_id", "item_id", "items", "covered", "item_tokens", "start", "end", "verbatim")


def drop_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """df without the rows that leak an item."""
    _, leaks, _ = _leaked_texts(df.select(F.lit(0).alias("doc_id"), F.col(text).alias("text")), benchmark)
    gone = written(leaks.select(*[F.col(c).alias(f"_leak_{c}") for c in _KEY]).distinct(), "leaked")
    k1, k2 = (F.xxhash64(*key) for key in ((df[text],), (F.lit(1), df[text])))
    small = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return df.join(small, (k1 == gone["_leak_k1"]) & (k2 == gone["_leak_k2"]), "left_anti")


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
