"""Model replies in JSON, read by Spark expressions under fixed rules of what to do with replies of another shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftstone.functions import values as V

#: Verdicts and confidences that count, the reason where none is given, and what a sufficient reply can say is missing.
VERDICTS = ("ok", "should_merge", "should_split", "boundary_issue")
CONFIDENCES = ("high", "medium", "low")
NO_REASON = "（LLM 未提供 reason）"
TOPIC_ABSENT, FACTUAL_NEGATION = "TOPIC_ABSENT", "FACTUAL_NEGATION"
#: The fields of an enhancement, by kind.
STRING_FIELDS, LIST_FIELDS = ("summary", "context_padding"), ("keywords", "entities", "potential_questions")


def _at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _kind(v: Column, name: str) -> Column:
    """STRING, BOOLEAN, ARRAY, VOID ..; null where there is no such field."""
    return F.regexp_extract(F.schema_of_variant(_at(v, name)), r"^\w+", 0)


def _is(v: Column, name: str, kind: str) -> Column:
    return F.coalesce(_kind(v, name) == kind, F.lit(False))


def _text(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def _items(v: Column, name: str) -> Column:
    """Items of a list as texts."""
    return F.coalesce(F.filter(F.try_variant_get(v, f"$.{name}", "array<string>"), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def _strings(v: Column, name: str) -> Column:
    """Items of a list that are strings."""
    items = F.try_variant_get(v, f"$.{name}", "array<variant>")
    there = F.filter(items, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
    return F.coalesce(F.transform(there, lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))


def _object(bare: Column) -> Column:
    """The reply as a variant; null where it is no JSON object."""
    v = F.try_parse_json(bare)
    return F.when(F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)), v)


def verdict(reply: Column, chunk_ids: Column) -> Column:
    """struct<verdict, confidence, reason, affected>: a reply that is no JSON object or has an unknown verdict is audit_failed, an unknown confidence none; affected ids are those of chunk_ids."""

    def of(v: Column) -> Column:
        named = _text(v, "verdict")
        known = F.coalesce(named.isin(*VERDICTS), F.lit(False))
        why = F.when(v.isNull(), F.lit("the reply is no JSON object")).otherwise(F.concat(F.lit("unknown verdict: "), F.coalesce(named, F.lit(""))))
        reason = F.coalesce(F.nullif(V.stripped(_text(v, "reason")), F.lit("")), F.lit(NO_REASON))
        affected = F.filter(_items(v, "affected_chunk_ids"), lambda x: F.array_contains(chunk_ids, x))
        return F.struct(
            F.when(known, named).otherwise("audit_failed").alias("verdict"),
            F.when(known & _text(v, "confidence").isin(*CONFIDENCES), _text(v, "confidence")).alias("confidence"),
            F.when(known, reason).otherwise(why).alias("reason"),
            F.when(known, affected).otherwise(F.array().cast("array<string>")).alias("affected"),
        )

    return V.let(_object(V.unfenced(F.coalesce(reply, F.lit("")), everywhere=True)), of)


def self_evaluation(reply: Column, most: int = 2) -> Column:
    """struct<sufficient, confidence, missing, sub_queries, parsed>. A reply counts as sufficient, with low confidence, if it is no JSON object, if sufficient is no boolean,
    confidence none of the three, missing_aspects no string or sub_queries no list, or if it is insufficient without sub-queries."""

    def of(v: Column) -> Column:
        subs = F.slice(F.filter(F.transform(_strings(v, "sub_queries"), V.stripped), lambda q: F.length(q) > 0), 1, most)
        enough = F.try_variant_get(v, "$.sufficient", "boolean")
        fine = (
            _is(v, "sufficient", "BOOLEAN") & _is(v, "confidence", "STRING") & F.coalesce(_text(v, "confidence").isin(*CONFIDENCES), F.lit(False))
            & _is(v, "missing_aspects", "STRING") & _is(v, "sub_queries", "ARRAY") & (F.coalesce(enough, F.lit(True)) | (F.size(subs) > 0))
        )
        return F.struct(
            F.when(fine, enough).otherwise(F.lit(True)).alias("sufficient"),
            F.when(fine, _text(v, "confidence")).otherwise("low").alias("confidence"),
            F.when(fine, _text(v, "missing_aspects")).otherwise("").alias("missing"),
            F.when(fine & ~enough, subs).otherwise(F.array().cast("array<string>")).alias("sub_queries"),
            fine.alias("parsed"),
        )

    return V.let(_object(V.unfenced(F.coalesce(reply, F.lit("")))), of)


def says(evaluation: Column, sentinel: str) -> Column:
    """Whether a sufficient reply names the sentinel as what is missing."""
    return evaluation["sufficient"] & (V.stripped(evaluation["missing"]) == sentinel)


def enhancement(reply: Column, wanted: tuple[str, ...]) -> Column:
    """struct<error, the wanted fields>: text fields are stripped, lists for them joined by a space; a reply that is no JSON object, a missing field
    or one of another type is an error, and then all fields are null."""

    def of(v: Column) -> Column:
        errors = [F.when(v.isNull(), F.lit("the reply is no JSON object"))]
        values = {}
        for name in wanted:
            lists, kind = name in LIST_FIELDS, _kind(v, name)
            gone = F.coalesce(kind, F.lit("VOID")) == "VOID"
            fits = kind.isin("ARRAY") if lists else kind.isin("ARRAY", "STRING")
            errors.append(F.when(gone, F.lit(f"missing field {name}")).when(~fits, F.lit(f"field {name} has another type")))
            whole = F.when(kind == "ARRAY", F.array_join(_items(v, name), " ")).otherwise(_text(v, name))
            values[name] = _items(v, name) if lists else V.stripped(whole)
        error = F.coalesce(*errors)
        return F.struct(error.alias("error"), *[F.when(error.isNull(), value).alias(name) for name, value in values.items()])

    return V.let(_object(V.unfenced(F.coalesce(reply, F.lit("")), everywhere=True)), of)
