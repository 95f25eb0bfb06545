"""Secret scan with multipart credential linking, in Spark expressions only.

Base findings need no company: assignments of a secret-like name, access identifiers and long hex runs. Weak
candidates (a bare 40-character key, an account identifier, an endpoint) say nothing alone. An interval join links them:
the parts of a text are intervals; a weak candidate is reported only when the parts that complete it lie within its
scope, SCOPE code points to either side:
    weak secret   an access identifier or account identifier
    account id    an endpoint and a secret (assigned or weak)
    endpoint      an identifier and a secret
Each reported candidate is a link and names all its parts: the spans of the kinds that complete it, within its scope. A part
may be a weak candidate that isn't reported itself. As spans of a kind don't overlap, the scope bounds the parts of a link.
The parts of a text stay in its row, so the join needs no shuffle and meets no other document's parts. The spans of a kind are in order and apart, so
those in a scope are one interval of them, whose ends two halving searches find: n candidates among m parts take n log m steps, and what is emitted is links.

Positions are code points, ends exclusive. A null text is an empty one; every row gives one row, repeated rows too.
Each kind's matches are leftmost and do not overlap; ties of start go by the order of KINDS.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCOPE = 400
#: The kinds in report order, and their patterns.
KINDS = ("assign", "access", "hex", "weak_secret", "account_id", "endpoint")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=-])"
ACCOUNT_ID = r"""(?i)(?<![a-z])(?:client|account|tenant|user|access)[_-]?(?:id|name|key[_-]?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}"""
ENDPOINT = r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\x00-\x20"'<>]*)?"""

#: What completes a weak candidate: a span of each of these sets of kinds.
NEEDS = {
    "weak_secret": (("access", "account_id"),),
    "account_id": (("endpoint",), ("assign", "weak_secret")),
    "endpoint": (("access", "account_id"), ("assign", "weak_secret")),
}

_SPANS = "array<struct<start:int,end:int,rank:int>>"


def _found(text: Column, kind: str, pattern: str, candidate: Column, keep=None) -> Column:
    """Spans of all matches that keep(match, group 2) accepts. Starts are running sums of the lengths of gaps and matches."""
    regex = F.lit(pattern)
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    groups = F.regexp_extract_all(text, regex, F.lit(2)) if kind == "assign" else matches
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("gap"), matches.alias("hit"), groups.alias("group"))
    rank = F.lit(KINDS.index(kind))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["gap"])
        end = start + F.length(m["hit"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), rank.alias("rank")))
        taken = span if keep is None else F.when(keep(m["hit"], m["group"]), span).otherwise(F.array().cast(_SPANS))
        return F.struct(end.alias("at"), F.concat(acc["out"], taken).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
    spans = F.aggregate(zipped, start, step, lambda acc: acc["out"])
    return F.when(candidate & F.rlike(text, regex), spans).otherwise(F.array().cast(_SPANS))


def _first(spans: Column, reached) -> Column:
    """The place of the first span for which reached() holds, by halving: it holds for all spans behind one for which it does. The number of spans where it holds for none."""

    def halved(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        there = F.coalesce(reached(F.get(spans, middle)), F.lit(True))
        return F.struct(F.when(there, acc["low"]).otherwise(F.least(middle + 1, acc["high"])).alias("low"), F.when(there, middle).otherwise(acc["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(spans).cast("long")))), start, halved, lambda acc: acc["low"])


def _within(spans: Column, at: Column, scope: int) -> Column:
    """Those of a kind's spans, which follow one another, that meet the scope of `at`: one interval of the array."""
    low = _first(spans, lambda s: s["end"] > at["start"] - scope)
    high = _first(spans, lambda s: s["start"] >= at["end"] + scope)
    return F.slice(spans, low + 1, F.greatest(F.lit(0), high - low))


def _ordered(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))


def scan_secrets(df: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """df with `secrets`, an array<struct<start, rank, end>> sorted by start and kind, and `links`, an array<struct<start, rank, end,
    parts array<struct<start, rank, end>>>> of the weak candidates among them, sorted likewise; rank indexes KINDS. Columns of df
    with these names give way."""
    names = [c for c in df.columns if c not in ("secrets", "links")]
    t = F.coalesce(F.col("_row.text"), F.lit(""))
    has = lambda part: F.contains(t, F.lit(part))
    mixed = lambda m, _: F.rlike(m, F.lit("[A-Z]")) & F.rlike(m, F.lit("[a-z]")) & F.rlike(m, F.lit("[0-9]"))
    anyway = F.lit(True)
    parts = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_kept"), F.struct(F.col(text).alias("text")).alias("_row")).select(
        "_kept",
        F.struct(
            _found(t, "assign", ASSIGN, has("=") | has(":"), lambda _, group: F.length(group) >= 8).alias("assign"),
            _found(t, "access", ACCESS, has("AKIA")).alias("access"),
            _found(t, "hex", HEX, anyway).alias("hex"),
            _found(t, "weak_secret", WEAK_SECRET, anyway, mixed).alias("weak_secret"),
            _found(t, "account_id", ACCOUNT_ID, has("=") | has(":")).alias("account_id"),
            _found(t, "endpoint", ENDPOINT, has("://")).alias("endpoint"),
        ).alias("_p"),
    )
    p = {k: F.col(f"_p.{k}") for k in KINDS}
    joined = lambda kinds: F.concat(*[p[k] for k in kinds])
    def linked(kind: str) -> Column:
        completing = [k for kinds in NEEDS[kind] for k in kinds]
        near = F.transform(p[kind], lambda at: F.struct(at.alias("at"), *[_within(p[k], at, scope).alias(k) for k in completing], *[F.size(_within(p[k], at, 0)).alias(f"on_{k}") for k in KINDS[:3]]))
        whole = lambda c: reduce(and_, [reduce(or_, [F.size(c[k]) > 0 for k in kinds]) for kinds in NEEDS[kind]])
        apart = lambda c: reduce(and_, [c[f"on_{k}"] == 0 for k in KINDS[:3]])
        return F.transform(
            F.filter(near, lambda c: whole(c) & apart(c)),
            lambda c: F.struct(c["at"]["start"].alias("start"), c["at"]["rank"].alias("rank"), c["at"]["end"].alias("end"), _ordered(F.concat(*[c[k] for k in completing])).alias("parts")),
        )

    base = parts.select("_kept", joined(KINDS[:3]).alias("_base"), F.array_sort(F.concat(*[linked(k) for k in NEEDS])).alias("_links"))
    found = base.select("_kept", "_links", F.array_sort(F.concat(_ordered(F.col("_base")), _ordered(F.col("_links")))).alias("_found"))
    return found.select(*[F.col("_kept").getField(c).alias(c) for c in names], F.col("_found").alias("secrets"), F.col("_links").alias("links"))


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm.common import table

    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    listed = lambda spans: F.array_join(F.transform(spans, told), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["rank"] == KINDS.index(k))).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(F.filter("secrets", lambda s: s["rank"] < 3)).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
        F.array_join(F.transform("links", lambda x: F.concat(told(x), F.lit("="), F.array_join(F.transform(x["parts"], told), "+"))), ",").alias("links"),
    )
