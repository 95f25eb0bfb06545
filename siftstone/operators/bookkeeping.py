"""Dual writes with failure records, retry and reconciliation, and chunk reviews, as table functions.

Each function takes the tables and gives the new ones; siftstone.sources.tables.Warehouse makes results live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions import values as V
from siftstone.operators import replies
from siftstone.sources.tables import FAILURES

#: Columns that a retry can restore from a vector row.
RESTORABLE = ("chunk_id", "doc_id", "parent_id", "hierarchy_level", "position", "text", "business_type", "config_version", "embedding_model_versions", "enhanced")


# --- serialising ---------------------------------------------------------------------------------------------------


def _flattened(chunks: DataFrame, keys: list[str]) -> list[Column]:
    """Metadata keys as columns, without those that chunks have themselves."""
    if "source_metadata" not in chunks.columns:
        return []
    return [F.element_at("source_metadata", F.lit(k)).alias(k) for k in keys if k not in chunks.columns]


def _versions(chunks: DataFrame) -> Column:
    return (V.versions_text(F.col("embedding_model_versions")) if "embedding_model_versions" in chunks.columns else F.lit("")).alias("embedding_model_versions")


def lexical_rows(chunks: DataFrame, metadata_keys: list[str] = ()) -> DataFrame:
    """Rows of the lexical table: text is the context, lists are joined by a space, and derived fields stay null where they are."""
    joined = lambda c: F.array_join(F.col(c), " ")
    derived = {"keywords": "derived_keywords", "entities": "derived_entities", "potential_questions": "derived_questions"}
    plain = [c for c in ("chunk_id", "doc_id", "parent_id", "hierarchy_level", "position", "business_type", "config_version", "lc_group_id") if c in chunks.columns]
    lists = [joined(c).alias(name) for c, name in derived.items() if c in chunks.columns] + [joined("heading_path").alias("heading_path")]
    enhanced = F.coalesce("enhanced", F.lit(False)) if "enhanced" in chunks.columns else F.lit(False)
    return chunks.select(*plain, F.col("context_text").alias("text"), *lists, _versions(chunks), enhanced.alias("enhanced"), *_flattened(chunks, list(metadata_keys)))


def vector_rows(chunks: DataFrame, metadata_keys: list[str] = ()) -> DataFrame:
    """Rows of the vector table: point id, vectors by name and payload, without derived fields."""
    plain = [c for c in ("chunk_id", "doc_id", "parent_id", "hierarchy_level", "position", "text", "business_type", "config_version", "named_vectors") if c in chunks.columns]
    enhanced = F.coalesce("enhanced", F.lit(False)) if "enhanced" in chunks.columns else F.lit(False)
    return chunks.select(V.point_id(F.col("chunk_id")).alias("point_id"), *plain, _versions(chunks), enhanced.alias("enhanced"), *_flattened(chunks, list(metadata_keys)))


def failure_mode(lexical_failed: Column, vector_failed: Column) -> Column:
    return F.when(lexical_failed & vector_failed, "both").when(lexical_failed, "es_write").when(vector_failed, "qdrant_write")


def dual_write(chunks: DataFrame, lexical_error: Column, vector_error: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows for the lexical table, rows for the vector table, failures (chunk_id, doc_id, failure_mode, error_msg)).

    The error columns are null for rows that can be written. A row that one side refuses still goes to the other.
    """
    checked = chunks.withColumn("_le", lexical_error).withColumn("_ve", vector_error)
    failed = checked.where("_le IS NOT NULL OR _ve IS NOT NULL").select(
        "chunk_id", F.col("doc_id").cast("string").alias("doc_id"), failure_mode(F.col("_le").isNotNull(), F.col("_ve").isNotNull()).alias("failure_mode"), F.concat_ws("; ", "_le", "_ve").alias("error_msg")
    )
    return checked.where("_le IS NULL").drop("_le", "_ve"), checked.where("_ve IS NULL").drop("_le", "_ve"), failed


def index_result(chunks: DataFrame, failed: DataFrame) -> DataFrame:
    """(doc_id, indexed, failed, failed_ids)."""
    bad = failed.select("chunk_id").distinct().withColumn("_bad", F.lit(True))
    rows = chunks.join(bad, "chunk_id", "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
    return rows.groupBy("doc_id").agg(F.count_if(~F.col("_bad")).alias("indexed"), F.count_if("_bad").alias("failed"), F.array_sort(F.collect_list(F.when(F.col("_bad"), F.col("chunk_id")))).alias("failed_ids"))


# --- digests -------------------------------------------------------------------------------------------------------

#: Parts of a bucket that have a digest of their own.
SUB_BUCKETS = 64


def _sub() -> Column:
    return F.pmod(F.xxhash64("chunk_id", F.lit(3)), F.lit(SUB_BUCKETS)).cast("int")


def digests(rows: DataFrame) -> DataFrame:
    """(bucket, sub, n, total, crossed): what tells the sets of chunk ids of rows (bucket, chunk_id) apart, summed in each task; the order of rows doesn't count."""
    total = F.sum(F.xxhash64("chunk_id").cast("decimal(38, 0)")).alias("total")
    return rows.groupBy("bucket", _sub().alias("sub")).agg(F.count("*").alias("n"), total, F.bit_xor(F.xxhash64("chunk_id", F.lit(4))).alias("crossed"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bucket, sub, same, n): the sub-buckets of two tables' digests, whether they agree, and the rows of those that do."""
    keys, told = ["bucket", "sub"], ("n", "total", "crossed")
    other = b.select(*keys, *[F.col(c).alias(f"_{c}") for c in told])
    both = a.join(other, keys, "full_outer")
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("total").eqNullSafe(F.col("_total")) & F.col("crossed").eqNullSafe(F.col("_crossed"))
    return both.select(*keys, same.alias("same"), "n")


def of_differing(rows: DataFrame, apart: DataFrame) -> DataFrame:
    """Those of rows (bucket, chunk_id, ..) that lie in sub-buckets of apart (bucket, sub), of which there are as many as buckets times SUB_BUCKETS at most."""
    return rows.withColumn("sub", _sub()).join(apart.select("bucket", "sub"), ["bucket", "sub"], "left_semi").drop("sub")


# --- failure records -----------------------------------------------------------------------------------------------


def record_failures(records: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """records with new failures: an unresolved record of the chunk gets another attempt and the new message, else a record starts with 0."""
    latest = new.groupBy("chunk_id").agg(F.max(F.struct("doc_id", "failure_mode", "error_msg")).alias("n"), F.count("*").alias("_times"))
    open_ = records.where("NOT resolved").join(latest, "chunk_id", "full_outer")
    known = F.col("id").isNotNull()
    merged = open_.select(
        F.coalesce("id", F.sha1(F.concat_ws(":", F.col("chunk_id"), now.cast("string")).cast("binary"))).alias("id"), "chunk_id",
        F.coalesce("doc_id", "n.doc_id").alias("doc_id"), F.coalesce("n.failure_mode", "failure_mode").alias("failure_mode"), F.coalesce("n.error_msg", "error_msg").alias("error_msg"),
        (F.when(known, F.col("attempt_count") + F.coalesce("_times", F.lit(0))).otherwise(F.col("_times") - 1)).cast("int").alias("attempt_count"),
        F.coalesce("created_at", now).alias("created_at"), F.when(F.col("n").isNotNull(), now).otherwise(F.col("last_attempt")).alias("last_attempt"), F.lit(False).alias("resolved"),
    )
    return records.where("resolved").unionByName(merged).select(*FAILURES.names)


def pending(records: DataFrame, limit: int | None = 500, max_attempts: int | None = None) -> DataFrame:
    """Unresolved records under the attempt limit, oldest first; without a limit all of them, in no order."""
    open_ = records.where("NOT resolved")
    if max_attempts is not None:
        open_ = open_.where(F.col("attempt_count") < max_attempts)
    return open_ if limit is None else open_.orderBy("created_at", "id").limit(limit)


def mark(records: DataFrame, outcome: DataFrame, now: Column) -> DataFrame:
    """records with the outcome (id, resolved, error_msg) of attempts."""
    o = outcome.select("id", F.col("resolved").alias("_ok"), F.col("error_msg").alias("_msg"))
    joined = records.join(o, "id", "left")
    tried = F.col("_ok").isNotNull()
    return joined.select(
        "id", "chunk_id", "doc_id", "failure_mode", F.when(tried & ~F.col("_ok"), F.coalesce("_msg", "error_msg")).otherwise(F.col("error_msg")).alias("error_msg"),
        (F.col("attempt_count") + F.when(tried & ~F.col("_ok"), 1).otherwise(0)).cast("int").alias("attempt_count"), "created_at",
        F.when(tried, now).otherwise(F.col("last_attempt")).alias("last_attempt"), (F.col("resolved") | F.coalesce("_ok", F.lit(False))).alias("resolved"),
    )


def retry(records: DataFrame, vectors: DataFrame, limit: int | None = 500, max_attempts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lexical rows to upsert, outcomes). A missing lexical row is restored from the vector row, with the columns that has; a missing vector can't be restored, its document must be ingested again."""
    due = pending(records, limit, max_attempts)
    cols = [c for c in RESTORABLE if c in vectors.columns]
    there = vectors.select(*cols)
    wants_lexical = due.where(F.col("failure_mode").isin("es_write", "both"))
    restored = wants_lexical.select("chunk_id").join(there, "chunk_id")
    found = due.join(there.select("chunk_id").distinct().withColumn("_has", F.lit(True)), "chunk_id", "left")
    done = (F.col("failure_mode") == "es_write") & F.coalesce("_has", F.lit(False))
    outcome = found.select("id", "chunk_id", done.alias("resolved"), F.when(~done, "retry failed").alias("error_msg"))
    return restored, outcome


def reconcile(lexical: DataFrame, vectors: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counters of one row, failures to record): chunks that only one table has, without those whose failure is pending."""
    a = lexical.select("chunk_id", F.col("doc_id").cast("string").alias("a")).dropDuplicates(["chunk_id"])
    b = vectors.select("chunk_id", F.col("doc_id").cast("string").alias("b")).dropDuplicates(["chunk_id"])
    waiting = records.where("NOT resolved").select("chunk_id").distinct().withColumn("waits", F.lit(True))
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), "chunk_id", "full_outer").join(waiting, "chunk_id", "left")
    only_a, only_b = F.col("_b").isNull(), F.col("_a").isNull()
    waits = F.coalesce("waits", F.lit(False))
    counters = both.agg(
        F.count_if(only_a).alias("lexical_only"), F.count_if(only_b).alias("vector_only"), F.count_if(~only_a & ~only_b).alias("in_sync"),
        F.count_if((only_a | only_b) & ~waits).alias("newly_recorded"), F.count_if((only_a | only_b) & waits).alias("already_pending"),
    )
    drift = both.where((only_a | only_b) & ~waits).select(
        "chunk_id", F.coalesce("a", "b", F.lit("unknown")).alias("doc_id"), F.when(only_a, "qdrant_write").otherwise("es_write").alias("failure_mode"),
        F.concat(F.lit("detected by reconciliation: missing from the "), F.when(only_a, "vector").otherwise("lexical"), F.lit(" table")).alias("error_msg"),
    )
    return counters, drift


# --- reviews -------------------------------------------------------------------------------------------------------


def _group_keys(chunks: DataFrame) -> DataFrame:
    """chunks with grouping_type and group_key: lc_group_id if any chunk of the document has one, else the parent, or the chunk itself where it has none."""
    grouped = chunks.where("lc_group_id IS NOT NULL").select("doc_id").distinct().withColumn("_lc", F.lit(True))
    by_lc = F.coalesce("_lc", F.lit(False))
    by_parent = F.coalesce("parent_id", F.concat(F.lit("root:"), F.col("chunk_id")))
    keyed = chunks.join(grouped, "doc_id", "left").withColumn("grouping_type", F.when(by_lc, "lc_group_id").otherwise("parent_id_fallback"))
    return keyed.withColumn("group_key", F.when(by_lc, F.col("lc_group_id")).otherwise(by_parent)).drop("_lc")


def audit_groups(chunks: DataFrame, chars: int = 800, most: int = 4000) -> DataFrame:
    """(doc_id, group_key, grouping_type, first, chunk_ids, prompt): the chunks of a document that belong together, in order; first is the place of the first of them.

    Chunks without an lc_group_id in a document that has some can't be grouped and are left out.
    """
    part = F.struct("hierarchy_level", "position", "chunk_id", F.substring("text", 1, chars).alias("text"))
    rows = _group_keys(chunks).where("group_key IS NOT NULL").groupBy("doc_id", "group_key", "grouping_type").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    prompt = F.substring(F.array_join(F.transform("parts", lambda p: F.concat(F.lit("["), p["chunk_id"], F.lit("] "), p["text"])), "\n"), 1, most)
    first = F.get("parts", F.lit(0))
    place = F.struct(first["hierarchy_level"].alias("level"), first["position"].alias("position"))
    return rows.select("doc_id", "group_key", "grouping_type", place.alias("first"), F.transform("parts", lambda p: p["chunk_id"]).alias("chunk_ids"), prompt.alias("prompt"))


def ungroupable(chunks: DataFrame) -> DataFrame:
    """(doc_id, skipped): how many chunks audit_groups() leaves out."""
    return _group_keys(chunks).groupBy("doc_id").agg(F.count_if(F.col("group_key").isNull()).alias("skipped"))


def verdicts(groups: DataFrame, reply: str = "reply") -> DataFrame:
    """groups with verdict, confidence, reason and affected, read from a model's JSON reply."""
    return groups.withColumn("_r", replies.verdict(F.col(reply), F.col("chunk_ids"))).select(*groups.columns, "_r.*")


def review_report(audited: DataFrame, skipped: DataFrame, now: Column) -> DataFrame:
    """A row for each document: counters by verdict and the groups in order of their first chunk."""
    count = lambda v: F.count_if(F.col("verdict") == v).cast("int").alias(v)
    fields = ("group_key", "grouping_type", "verdict", "confidence", "reason", "affected")
    ordered = F.array_sort(F.collect_list(F.struct("first", *fields)))
    groups = F.transform(ordered, lambda g: F.struct(*[g[c].alias(c) for c in fields]))
    rows = audited.groupBy("doc_id").agg(F.count("*").cast("int").alias("total_groups"), *[count(v) for v in (*replies.VERDICTS, "audit_failed")], groups.alias("groups"))
    out = rows.join(skipped.select("doc_id", F.col("skipped").cast("int").alias("skipped")), "doc_id", "left").withColumn("skipped", F.coalesce("skipped", F.lit(0))).withColumn("audited_at", now)
    return out.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("review_id", V.review_id(F.col("doc_id"), F.col("audited_at")))


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """Each document's last review; partial sums leave one row a document and task, however many reviews it has."""
    return reviews.groupBy("doc_id").agg(F.max_by(F.struct(*reviews.columns), F.struct("audited_at", "review_id")).alias("_r")).select("_r.*")


def reviews_of(reviews: DataFrame, doc_id: str, limit: int = 20) -> DataFrame:
    return reviews.where(F.col("doc_id") == doc_id).orderBy(F.desc("audited_at")).limit(limit)


def reviewed(reviews: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, reviewed) for each of doc_ids."""
    there = reviews.select("doc_id").distinct().withColumn("reviewed", F.lit(True))
    return doc_ids.select("doc_id").join(there, "doc_id", "left").select("doc_id", F.coalesce("reviewed", F.lit(False)).alias("reviewed"))


def pending_count(records: DataFrame) -> DataFrame:
    """(records, chunks): unresolved failure records, and the distinct chunks that they are of."""
    return records.where("NOT resolved").agg(F.count("*").alias("records"), F.count_distinct("chunk_id").alias("chunks"))


def pending_reviews(chunks: DataFrame, reviews: DataFrame, limit: int | None = 100) -> DataFrame:
    """doc_ids without a review, of the 4 * limit documents with the most chunks, in order; without a limit of all documents, in no order."""
    if limit is None:
        return chunks.select("doc_id").distinct().join(reviews.select("doc_id").distinct(), "doc_id", "left_anti")
    top = chunks.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").limit(4 * limit)
    return top.join(reviews.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id").orderBy("doc_id").limit(limit)
