"""Ids, maps, vectors, fences and metrics as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of DNS names (RFC 4122), as hex.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def let(value: Column, use) -> Column:
    """use(value), with value computed once: a lambda's variable holds it."""
    return F.element_at(F.transform(F.array(value), use), 1)


# --- ids -----------------------------------------------------------------------------------------------------------


def _short_sha(text: Column) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, 16)


def chunk_id(doc_id: Column, level: Column, number: Column) -> Column:
    """Of a document's number-th chunk, counted from 1."""
    return _short_sha(F.concat_ws(":", doc_id.cast("string"), level.cast("string"), number.cast("string")))


def sub_chunk_id(parent_id: Column, number: Column) -> Column:
    """Of a chunk's number-th piece, counted from 0."""
    return _short_sha(F.concat(parent_id, F.lit(":sub:"), number.cast("string")))


def point_id(chunk: Column) -> Column:
    """Name-based UUID, version 5, in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), chunk.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def review_id(doc_id: Column, audited_at: Column) -> Column:
    return F.concat_ws("::", doc_id.cast("string"), audited_at.cast("string"))


def store_name(base: str, config_version: str, model_version: str) -> str:
    return f"{base}_{config_version}_{model_version}".replace(".", "_")


# --- maps ----------------------------------------------------------------------------------------------------------


def merged(a: Column, b: Column) -> Column:
    """Entries of both maps; of a common key, b's."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))


def versions_text(versions: Column) -> Column:
    entries = F.array_sort(F.map_entries(versions))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


# --- vectors -------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalized(v: Column) -> Column:
    """A vector of length one; the zero vector stays."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def mean_pooled(tokens: Column, first: Column, end: Column) -> Column:
    """Mean of the token vectors first to end - 1; null where the range is empty, leaves the matrix, or widths differ."""
    part = F.slice(tokens, first + 1, end - first)
    width = F.size(F.get(part, F.lit(0)))
    sums = F.aggregate(part, F.transform(F.get(part, F.lit(0)), lambda x: x.cast("double") * 0), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    fine = (first >= 0) & (end > first) & (end <= F.size(tokens)) & (width > 0) & F.forall(part, lambda v: F.size(v) == width)
    return F.when(fine, F.transform(sums, lambda x: x / (end - first)))


def token_range(char_start: Column, char_end: Column, offsets: Column) -> Column:
    """struct<first, end>: the tokens that overlap a span of characters, tokens without width left out; null where there is none."""
    numbers = F.transform(offsets, lambda o, i: F.when((o["end"] > o["start"]) & (o["start"] < char_end) & (o["end"] > char_start), i))
    hit = F.filter(numbers, lambda i: i.isNotNull())
    return F.when((F.size(hit) > 0) & (char_end > char_start), F.struct(F.array_min(hit).alias("first"), (F.array_max(hit) + 1).alias("end")))


# --- model replies -------------------------------------------------------------------------------------------------


def stripped(text: Column) -> Column:
    """text without white space at both ends."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def unfenced(reply: Column, everywhere: bool = False) -> Column:
    """A reply that begins with a Markdown fence without all lines that begin with one, or without the first and a last line of it; others as they are, stripped."""
    bare = stripped(reply)
    lines = F.split(bare, r"\r\n|\r|\n", -1)
    fence = lambda line: F.startswith(line, F.lit("```"))
    if everywhere:
        rest = F.filter(lines, lambda line: ~fence(line))
    else:
        last = stripped(F.element_at(lines, -1)) == "```"
        rest = F.filter(lines, lambda line, i: (i > 0) & ~((i == F.size(lines) - 1) & last))
    return F.when(fence(bare), stripped(F.array_join(rest, "\n"))).otherwise(bare)


# --- metrics over ranked lists -------------------------------------------------------------------------------------


def _hits(retrieved: Column, relevant: Column, k: Column | int) -> Column:
    return F.filter(F.slice(retrieved, F.lit(1), k if isinstance(k, Column) else F.lit(k)), lambda x: F.array_contains(relevant, x))


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    return F.when(F.size(relevant) > 0, F.size(_hits(retrieved, relevant, k)) / F.size(relevant)).otherwise(0.0)


def precision_at(retrieved: Column, relevant: Column, k: int) -> Column:
    return F.size(_hits(retrieved, relevant, k)) / F.lit(float(k)) if k else F.lit(0.0)


def reciprocal_rank(retrieved: Column, relevant: Column, k: int = 100) -> Column:
    ranks = F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), i + 1))
    return F.coalesce(1.0 / F.array_min(ranks), F.lit(0.0))


def dcg_at(retrieved: Column, relevant: Column, k: int) -> Column:
    gains = F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), 1.0 / F.log2(i + 2.0)).otherwise(0.0))
    return F.aggregate(gains, F.lit(0.0), lambda s, g: s + g)


def ndcg_at(retrieved: Column, relevant: Column, k: int) -> Column:
    n = F.least(F.size(relevant), F.lit(k))
    ideal = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return F.when(ideal > 0, dcg_at(retrieved, relevant, k) / ideal).otherwise(0.0)


def rejection(retrieved: Column) -> Column:
    """Of a query without an answer: 1 if nothing was retrieved."""
    return F.when(F.size(retrieved) == 0, 1.0).otherwise(0.0)
