"""Documents to tables: clean, enhance, chunk, embed, index; add, update, delete and rebuild."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import text as T
from siftstone.functions import values as V
from siftstone.operators import bookkeeping, chunking, dense, lexical, replies, segment
from siftstone.operators.chunking import Budget
from siftstone.plans.query import Corpus
from siftstone.sources.tables import FAILURES, ORIGINALS, QUARANTINE, REVIEWS, Change, Store, Warehouse, delete_where, materialised, upsert

#: The reference design's own limit of what an enhancement model is shown.
ENHANCED_TEXT = 6000
KNOWN = {"originals": ORIGINALS, "failures": FAILURES, "reviews": REVIEWS, "quarantine": QUARANTINE}


def enhance(docs: DataFrame, model: Callable | None, wanted: tuple[str, ...] = ("summary", "keywords", "entities"), policy: str = "rules_only_and_flag") -> DataFrame:
    """docs with the derived fields from one model call a document (its first 6000 characters), enhanced and enhancement_error.

    model(texts) gives JSON replies, which replies.enhancement() reads. On errors the fields stay null under rules_only_and_flag, and the job fails under fail_fast.
    """
    empty = {**dict.fromkeys(replies.STRING_FIELDS, "string"), **dict.fromkeys(replies.LIST_FIELDS, "array<string>")}
    if model is None:
        for name, kind in empty.items():
            docs = docs.withColumn(name, F.lit(None).cast(kind))
        return docs.withColumn("enhanced", F.lit(False)).withColumn("enhancement_error", F.lit(None).cast("string"))

    @F.pandas_udf("reply string, error string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            try:
                yield pd.DataFrame({"reply": model(list(s)), "error": None})
            except Exception as e:  # noqa: BLE001  a model may fail in any way; the policy decides
                yield pd.DataFrame({"reply": None, "error": [str(e)] * len(s)})

    docs = docs.withColumn("_m", ask(F.substring("text", 1, ENHANCED_TEXT)))
    docs = docs.withColumn("_v", replies.enhancement(F.col("_m.reply"), wanted))
    error = F.coalesce("_m.error", "_v.error")
    if policy == "fail_fast":
        error = F.when(error.isNotNull(), F.raise_error(error).cast("string"))
    docs = docs.withColumn("enhancement_error", error)
    fine = F.col("enhancement_error").isNull()
    for name, kind in empty.items():
        docs = docs.withColumn(name, F.when(fine, F.col(f"_v.{name}")) if name in wanted else F.lit(None).cast(kind))
    return docs.withColumn("enhanced", fine).drop("_m", "_v")


def build_chunks(docs: DataFrame, budget: Budget = Budget(), config_version: str = "", profile: T.CleaningProfile = T.CleaningProfile(), model: Callable | None = None, provider: Callable | None = None) -> DataFrame:
    """Originals (doc_id, raw_text, business_type, source_metadata) to chunks. The cleaned and enhanced documents are a table of their own, as several steps read them."""
    cleaned = T.clean(docs.withColumn("doc_id", F.col("doc_id").cast("string")), "raw_text", profile)
    ready = materialised(enhance(cleaned, model), "enhanced")
    nodes = chunking.parse(ready.where(F.length(T.strip(F.col("text"))) > 0), budget.levels)
    return chunking.semantic_split(chunking.chunk(nodes, ready, budget, config_version), budget, provider)


def with_vectors(chunks: DataFrame, providers: dict[str, tuple[Callable, int, str]]) -> DataFrame:
    """chunks with named_vectors and embedding_model_versions from {vector_name: (provider, dimension, version)}, and error: what providers said of texts that they failed on."""
    for name, (provider, dimension, _) in providers.items():
        chunks = dense.embed_each(chunks, provider, dimension, out=f"_v_{name}", error=f"_e_{name}")
    there = F.map_filter(F.create_map(*[x for n in providers for x in (F.lit(n), F.col(f"_v_{n}"))]), lambda _, v: v.isNotNull())
    versions = F.create_map(*[x for n, (_, _, v) in providers.items() for x in (F.lit(n), F.lit(v))])
    said = F.concat_ws("; ", *[F.col(f"_e_{n}") for n in providers])
    chunks = chunks.withColumn("named_vectors", there).withColumn("embedding_model_versions", versions).withColumn("error", F.nullif(said, F.lit("")))
    return chunks.drop(*[f"_{k}_{n}" for n in providers for k in "ve"])


def isolated_failures(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, stage, error_msg), a row a document that a stage failed on: documents without an id or a text, then those of whose chunks one has an error (the first one's is told)."""
    bad = docs.where(invalid(docs)).select("doc_id", F.lit("validate").alias("stage"), F.lit("no id or no text").alias("error_msg"))
    failed = chunks.where("error IS NOT NULL").groupBy("doc_id").agg(F.min_by("error", F.struct("hierarchy_level", "position", "chunk_id")).alias("error_msg"))
    return bad.distinct().unionByName(failed.select("doc_id", F.lit("embed").alias("stage"), "error_msg"))


def checked_request(docs: DataFrame, most: int = 50) -> DataFrame:
    """docs as an interactive request may bring them: 1 to 50 rows, each with an id and a text of a character at least. Batch jobs have no such limits; add() takes any number."""
    n, bad = docs.limit(most + 1).agg(F.count("*"), F.count_if(invalid(docs) | (F.length("raw_text") == 0))).first()
    if not 1 <= n <= most:
        raise ValueError(f"a request has 1 to {most} documents")
    if bad:
        raise ValueError("every document of a request needs an id and a text")
    return docs


def invalid(docs: DataFrame) -> Column:
    return F.col("doc_id").isNull() | (F.length(F.trim(F.col("doc_id").cast("string"))) == 0) | F.col("raw_text").isNull()


@dataclass
class Engine:
    """The tables of one deployment below `root`, and the jobs on them.

    All tables lie in `buckets` parts by hash of the document, so that a change replaces only the parts of the documents that it touches; take
    thousands at scale. Every job changes its tables together, by one new version of the warehouse (sources.tables): readers keep the version that they
    began with, and a job that fails leaves none. A document that a stage fails on goes to the quarantine table with its reason, and the
    others of its batch go on. With a token provider (see chunking.late_chunk_vectors) the vectors of `late` come from the chunks' groups.
    metadata_keys become columns of the lexical and vector rows. With a dictionary, text without spaces is indexed in its fine and queried in its coarse grain.
    """

    spark: SparkSession
    root: str
    providers: dict
    budget: Budget = Budget(whole_nodes=True)
    config_version: str = "1"
    model: Callable | None = None
    profile: T.CleaningProfile = T.CleaningProfile()
    buckets: int = 16
    metadata_keys: tuple[str, ...] = ("title", "source", "author", "category", "created_time")
    late: dict[str, tuple[Callable, int, str, int]] = field(default_factory=dict)
    dictionary: segment.Dictionary | None = None
    #: Buckets that the last reconcile() read.
    scanned: int | None = None

    @property
    def warehouse(self) -> Warehouse:
        return Warehouse(self.spark, self.root)

    def store(self, name: str) -> Store:
        return Store(self.warehouse, name)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version, the live one by default."""
        return self.warehouse.read(name, KNOWN.get(name), version=version).drop("bucket")

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(self.buckets)).cast("int"))

    def _touched(self, doc_ids: DataFrame) -> list[int]:
        """The buckets of some documents: as many as there are buckets at most."""
        return sorted(r[0] for r in self._bucketed(doc_ids.select("doc_id")).select("bucket").distinct().collect())

    def _upsert(self, change: Change, name: str, new: DataFrame, gone: DataFrame | None, keys: list[str], touched: list[int]) -> None:
        """Within the touched buckets: rows that gone (some of the key columns or doc_id) names go, new rows replace those of the same keys."""
        new = self._bucketed(new)
        current = change.read(name, new.schema, touched)
        current = current if gone is None else current.join(gone, gone.columns, "left_anti")
        change.put(name, upsert(current, new, keys), "bucket", touched)
        self._digest(change, name, touched)

    def _digest(self, change: Change, name: str, touched: list[int] | None) -> None:
        """Digests of the touched buckets of a table that reconcile() compares, each with the folder that it is of."""
        if name in ("lexical", "vectors"):
            change.put(f"{name}_digests", self._digests_of(change, name, touched), "bucket", touched if f"{name}_digests" in change.tables else None)

    def _digests_of(self, change: Change, name: str, buckets: list[int] | None) -> DataFrame:
        folders = [(int(b), f) for b, f in change.tables[name]["parts"].items() if b and (buckets is None or int(b) in buckets)]
        of = self.spark.createDataFrame(folders, "bucket int, part string")
        return bookkeeping.digests(change.read(name, buckets=buckets).select("bucket", "chunk_id")).join(F.broadcast(of), "bucket")

    def _known_digests(self, change: Change, name: str) -> DataFrame:
        """The digests of a table's live folders; where a folder has none, as after a write that went round the engine, they are made now."""
        now = self.spark.createDataFrame([(int(b), f) for b, f in change.tables[name]["parts"].items() if b], "bucket int, part string")
        kept = f"{name}_digests"
        if kept not in change.tables:
            return self._digests_of(change, name, None)
        there = change.read(kept).join(F.broadcast(now), ["bucket", "part"], "left_semi")
        lacking = [r[0] for r in now.join(there.select("bucket", "part").distinct(), ["bucket", "part"], "left_anti").select("bucket").collect()]  # as many as buckets at most
        return there.unionByName(self._digests_of(change, name, lacking)) if lacking else there

    def _index(self, change: Change, touched: list[int] | None = None) -> None:
        """Postings of all searched fields, of the touched buckets or of all."""
        rows = change.read("lexical", buckets=touched)
        fields = {c: c for c in lexical.BOOSTS if c in rows.columns}
        change.put("postings", lexical.postings(rows, fields=fields, keep=("bucket",), tokens=self._tokens("fine")), "bucket", touched if "postings" in change.tables else None)

    def _tokens(self, grain: str) -> Callable:
        return segment.tokens(self.dictionary, grain) if self.dictionary else T.lexical_tokens

    def _record(self, change: Change, failures: DataFrame) -> None:
        """Failure records of chunks (chunk_id, doc_id, failure_mode, error_msg), in their documents' buckets."""
        touched = self._touched(failures)
        if touched:
            records = change.read("failures", FAILURES, touched).drop("bucket")
            change.put("failures", self._bucketed(bookkeeping.record_failures(records, failures, F.current_timestamp())), "bucket", touched)

    def _quarantine(self, change: Change, docs: DataFrame, failed: DataFrame) -> None:
        """Documents that failed are recorded, those that got through leave."""
        touched = self._touched(docs)
        old = change.read("quarantine", QUARANTINE, touched).drop("bucket")
        if "quarantine" not in change.tables and not failed.limit(1).count():
            return
        now, before = F.current_timestamp(), old.select("doc_id", "attempts", "first_at")
        new = failed.alias("f").join(before, F.col("f.doc_id").eqNullSafe(before["doc_id"]), "left").select(
            "f.doc_id", "stage", "error_msg", (F.coalesce("attempts", F.lit(0)) + 1).cast("int").alias("attempts"), F.coalesce("first_at", now).alias("first_at"), now.alias("last_at")
        )
        tried = docs.select(F.col("doc_id").alias("_tried")).distinct()
        stays = old.join(tried, F.col("doc_id").eqNullSafe(F.col("_tried")), "left_anti")
        change.put("quarantine", self._bucketed(stays.unionByName(new)), "bucket", touched)

    def _chunks(self, docs: DataFrame) -> DataFrame:
        """The chunks of valid documents with their vectors, and error where a provider failed on one."""
        chunks = with_vectors(build_chunks(docs.where(~invalid(docs)), self.budget, self.config_version, self.profile, self.model, next((p for p, _, _ in self.providers.values()), None)), self.providers)
        if self.late:
            chunks = materialised(chunks, "chunks")
            for name, (provider, dimension, version, max_seq_len) in self.late.items():
                late = chunking.late_chunk_vectors(chunks, provider, dimension, max_seq_len).select("chunk_id", F.col("vector").alias("_late"))
                chunks = chunks.join(late, "chunk_id", "left")
                chunks = chunks.withColumn("named_vectors", V.merged(F.col("named_vectors"), F.create_map(F.lit(name), F.col("_late")))).drop("_late")
                chunks = chunks.withColumn("embedding_model_versions", V.merged(F.col("embedding_model_versions"), F.create_map(F.lit(name), F.lit(version))))
        return materialised(chunks, "chunks")

    def _write(self, change: Change, docs: DataFrame, gone: DataFrame | None, touched: list[int]) -> DataFrame:
        made = self._chunks(docs)
        bad = materialised(isolated_failures(docs, made), "isolated")
        self._quarantine(change, docs, bad)
        chunks = made.join(bad.select("doc_id"), "doc_id", "left_anti").drop("error")
        if gone is not None:
            # What is indexed of a document that failed stays as it was.
            gone = gone.join(bad.select("doc_id"), "doc_id", "left_anti")
        bad_vector = F.when(F.size("named_vectors") < len(self.providers) + len(self.late), F.lit("a vector is missing"))
        for_lexical, for_vectors, failed = bookkeeping.dual_write(chunks, F.when(F.length("chunk_id") == 0, F.lit("no id")), bad_vector)
        failures = materialised(failed, "failed")
        self._record(change, failures)
        self._upsert(change, "lexical", bookkeeping.lexical_rows(for_lexical, self.metadata_keys), gone, ["chunk_id"], touched)
        self._upsert(change, "vectors", bookkeeping.vector_rows(for_vectors, self.metadata_keys), gone, ["chunk_id"], touched)
        self._index(change, touched)
        result = bookkeeping.index_result(chunks, failures).withColumn("error_msg", F.lit(None).cast("string"))
        lost = made.join(bad.drop("error_msg"), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("chunk_id")).alias("ids"))
        told = bad.join(lost, "doc_id", "left").select("doc_id", F.lit(0).cast("long").alias("indexed"), F.coalesce("n", F.lit(0)).alias("failed"), F.coalesce("ids", F.array().cast("array<string>")).alias("failed_ids"), F.concat_ws(": ", "stage", "error_msg").alias("error_msg"))
        return result.unionByName(told)

    def add(self, docs: DataFrame, replace: bool = True) -> DataFrame:
        """Puts originals and indexes them, as one change: (doc_id, indexed, failed, failed_ids, error_msg).

        With replace, chunks of these documents that are no longer made go; without it they stay, as a plain upsert leaves them. A document that a
        stage fails on has an error_msg, is in the table quarantine, and keeps what was indexed of it before.
        """
        docs = materialised(docs.select("doc_id", "raw_text", *[c for c in ("business_type", "source_metadata") if c in docs.columns]).withColumn("stored_at", F.current_timestamp()), "incoming")
        touched, change = self._touched(docs), self.warehouse.change()
        full = docs.where(~invalid(docs)).select(*[F.col(f.name) if f.name in docs.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in ORIGINALS])
        self._upsert(change, "originals", full, None, ["doc_id"], touched)
        result = materialised(self._write(change, docs, docs.select("doc_id").distinct() if replace else None, touched), "result")
        change.commit()
        return result

    def update(self, docs: DataFrame) -> DataFrame:
        """add() with the old metadata where a row brings none."""
        old = self.table("originals").select("doc_id", F.col("source_metadata").alias("_old"))
        meta = F.coalesce("source_metadata", "_old") if "source_metadata" in docs.columns else F.col("_old")
        return self.add(docs.join(old, "doc_id", "left").withColumn("source_metadata", meta).drop("_old"))

    def retry_quarantined(self) -> DataFrame:
        """add() for the documents in quarantine whose originals are there."""
        return self.add(self.table("originals").join(self.table("quarantine").select("doc_id"), "doc_id", "left_semi"))

    def get(self, doc_id: str) -> DataFrame:
        return self.table("originals").where(F.col("doc_id") == doc_id)

    def list_ids(self) -> DataFrame:
        return self.table("originals").select("doc_id").orderBy("doc_id")

    def chunks_of(self, doc_id: str) -> DataFrame:
        """A document's lexical rows in order."""
        return self.table("lexical").where(F.col("doc_id") == doc_id).orderBy("hierarchy_level", "position", "chunk_id")

    def _remove(self, gone: DataFrame, touched: list[int], names: tuple[str, ...]) -> dict[str, int]:
        """Rows that gone names by its column go from the tables, as one change; their numbers."""
        counts, change = {}, self.warehouse.change()
        for name in names:
            if name in change.tables:
                current = change.read(name, buckets=touched)
                counts[name] = current.join(gone, gone.columns, "left_semi").count()
                if counts[name]:
                    change.put(name, current.join(gone, gone.columns, "left_anti"), "bucket", touched)
                    self._digest(change, name, touched)
        if counts.get("lexical"):
            self._index(change, touched)
        if any(counts.values()):
            change.commit()
        return counts

    def delete(self, doc_id: str) -> dict[str, int]:
        """Removes a document everywhere; the numbers of rows that went."""
        gone = self.spark.createDataFrame([(doc_id,)], "doc_id string")
        return self._remove(gone, self._touched(gone), ("originals", "lexical", "vectors"))

    def delete_chunks(self, chunk_ids: DataFrame) -> dict[str, int]:
        """Removes chunks (chunk_id) from both tables; the numbers of rows that went."""
        gone = materialised(chunk_ids.select("chunk_id").distinct(), "gone")
        rows = self.table("lexical").select("chunk_id", "doc_id").unionByName(self.table("vectors").select("chunk_id", "doc_id"))
        return self._remove(gone, self._touched(rows.join(gone, "chunk_id", "left_semi")), ("lexical", "vectors"))

    def add_reviews(self, reviews: DataFrame) -> None:
        """Puts review rows in their documents' buckets."""
        reviews, change = materialised(reviews.select(*REVIEWS.names), "reviews"), self.warehouse.change()
        self._upsert(change, "reviews", reviews, None, ["review_id"], self._touched(reviews))
        change.commit()

    def clear_reviews(self, doc_id: str) -> int:
        """Removes a document's reviews, so that the next sweep takes it again; their number."""
        gone = self.spark.createDataFrame([(doc_id,)], "doc_id string")
        return self._remove(gone, self._touched(gone), ("reviews",)).get("reviews", 0)

    def corpus(self, version: int | None = None) -> Corpus:
        """The tables as a query reads them, all of one version."""
        version = self.warehouse.live() if version is None else version
        vectors = self.table("vectors", version)
        named = {n: vectors.select("chunk_id", F.element_at("named_vectors", F.lit(n)).alias("vector")).where("vector IS NOT NULL") for n in (*self.providers, *self.late)}
        return Corpus(self.table("lexical", version), self.table("postings", version), named, query_tokens=self._tokens("coarse"))

    def rebuild(self, progress: Callable[[dict], None] | None = None, batches: int = 1, keep: int = 1) -> dict:
        """Chunks and indexes all originals anew, and commits only if no row failed; the old version stays until then.

        The originals go in `batches` groups of buckets. progress is told of the phases provision, index (after each batch, with counts so far), switch, cleanup and
        done, or of error. Counts are observed while rows are written. Versions but the last `keep` are removed at the end.
        """
        tell = progress or (lambda _: None)
        change = self.warehouse.change()
        counts = {"documents": 0, "indexed_documents": 0, "chunks": 0, "split_chunks": 0, "failed": 0}
        try:
            tell({"phase": "provision", **counts})
            for name in ("lexical", "vectors", "postings", "quarantine", "lexical_digests", "vectors_digests"):
                change.tables = {n: t for n, t in change.tables.items() if n != name}
            groups = [list(range(n, self.buckets, batches)) for n in range(min(batches, self.buckets))]
            for touched in groups:
                self._rebuilt(change, touched, counts)
                tell({"phase": "index", **counts})
            if counts["failed"]:
                tell({"phase": "error", "error": f"{counts['failed']} chunks or documents failed", **counts})
                return {"switched": False, **counts}
            tell({"phase": "switch", **counts})
            change.commit()
            tell({"phase": "cleanup", **counts})
            self.warehouse.expire(keep)
            tell({"phase": "done", **counts})
            return {"switched": True, **counts}
        except Exception as e:
            tell({"phase": "error", "error": str(e), **counts})
            raise

    def _rebuilt(self, change: Change, touched: list[int], counts: dict) -> None:
        """Lexical, vector and posting rows of the originals of some buckets, and what was seen while they were written added to counts."""
        read, made = Observation(), Observation()
        docs = materialised(change.read("originals", self._bucketed(self.spark.createDataFrame([], ORIGINALS)).schema, touched).drop("bucket").observe(read, F.count("*").alias("n")), "originals")
        chunks = self._chunks(docs)
        short = F.size("named_vectors") < len(self.providers) + len(self.late)
        rows = bookkeeping.lexical_rows(chunks, self.metadata_keys)
        seen = chunks.observe(made, F.count("*").alias("n"), F.count_if(F.startswith("lc_group_id", F.lit("sem:"))).alias("split"), F.count_if(short | F.col("error").isNotNull()).alias("failed"))
        self._put_new(change, "lexical", rows, touched)
        self._put_new(change, "vectors", bookkeeping.vector_rows(seen, self.metadata_keys), touched)
        self._index(change, touched)
        found = made.get
        for name, n in (("documents", read.get["n"]), ("indexed_documents", chunks.select("doc_id").distinct().count()), ("chunks", found["n"]), ("split_chunks", found["split"]), ("failed", found["failed"])):
            counts[name] += n or 0

    def _put_new(self, change: Change, name: str, rows: DataFrame, touched: list[int]) -> None:
        change.put(name, self._bucketed(rows), "bucket", touched)
        self._digest(change, name, touched)

    def reconcile(self) -> dict:
        """Records chunks that only one of the two tables has. Digests are compared first: only buckets that differ are read, and of these only the sub-buckets that do."""
        change = self.warehouse.change()
        told = materialised(bookkeeping.differing(*(self._known_digests(change, n) for n in ("lexical", "vectors"))), "differing")
        apart = told.where("NOT same")
        buckets = sorted(r[0] for r in apart.select("bucket").distinct().collect())  # as many as buckets at most
        sides = (bookkeeping.of_differing(change.read(n, buckets=buckets), F.broadcast(apart)) for n in ("lexical", "vectors"))
        counters, drift = bookkeeping.reconcile(*sides, change.read("failures", FAILURES))
        out = counters.first().asDict()
        out["in_sync"] += told.where("same").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.scanned = len(buckets)
        if out["newly_recorded"]:
            self._record(change, materialised(drift, "drift"))
            change.commit()
        return out

    def retry(self, limit: int = 500, max_attempts: int | None = None) -> dict:
        change = self.warehouse.change()
        records = change.read("failures", FAILURES)
        restored, outcome = bookkeeping.retry(records.drop("bucket"), change.read("vectors"), limit, max_attempts)
        return self._settle(change, materialised(restored, "restored"), materialised(outcome.join(records.select("id", "doc_id"), "id"), "outcome"))

    def settle(self, outcomes: DataFrame) -> dict:
        """What a retry queue (streaming.retries) found, (chunk_id, resolved, error_msg), for the open failure records of these chunks: rows that can be restored are, and the records marked."""
        change = self.warehouse.change()
        told = outcomes.groupBy("chunk_id").agg(F.max("resolved").alias("resolved"), F.max("error_msg").alias("error_msg"))
        records = change.read("failures", FAILURES).where("NOT resolved").drop("error_msg", "resolved")
        outcome = materialised(records.join(told, "chunk_id").select("id", "chunk_id", "doc_id", "failure_mode", "resolved", "error_msg"), "outcome")
        vectors = change.read("vectors")
        there = vectors.select(*[c for c in bookkeeping.RESTORABLE if c in vectors.columns])
        restored = materialised(there.join(outcome.where("resolved AND failure_mode = 'es_write'").select("chunk_id").distinct(), "chunk_id", "left_semi"), "restored")
        return self._settle(change, restored, outcome)

    def _settle(self, change: Change, restored: DataFrame, outcome: DataFrame) -> dict:
        touched = self._touched(restored)
        if touched:
            self._upsert(change, "lexical", restored, None, ["chunk_id"], touched)
            self._index(change, touched)
        marked = self._touched(outcome)
        if marked:
            change.put("failures", self._bucketed(bookkeeping.mark(change.read("failures", buckets=marked).drop("bucket"), outcome, F.current_timestamp())), "bucket", marked)
            change.commit()
        n, ok = outcome.agg(F.count("*"), F.count_if("resolved")).first()
        return {"attempted": n, "resolved": ok, "still_failing": n - ok}

    def purge_resolved(self) -> int:
        change = self.warehouse.change()
        records = change.read("failures", FAILURES)
        done = self._touched(records.where("resolved"))
        if not done:
            return 0
        kept, _ = delete_where(change.read("failures", buckets=done), F.col("resolved"))
        n = records.agg(F.count_if("resolved")).first()[0]
        change.put("failures", kept, "bucket", done)
        change.commit()
        return n

    def lexical_row(self, chunk_id: str) -> DataFrame:
        """A chunk's lexical row, if it is there."""
        return self.table("lexical").where(F.col("chunk_id") == chunk_id)

    def pending(self) -> DataFrame:
        """(records, chunks): open failure records and the chunks that they are of."""
        return bookkeeping.pending_count(self.table("failures"))

    def reviews(self, doc_id: str, limit: int = 20) -> DataFrame:
        """A document's reviews, the newest first."""
        return bookkeeping.reviews_of(self.table("reviews"), doc_id, limit)

    def due_reviews(self, limit: int | None = 20) -> DataFrame:
        """(doc_id) of documents that an audit would take next."""
        return bookkeeping.pending_reviews(self.table("lexical"), self.table("reviews"), limit)

    def status(self) -> DataFrame:
        """(name, rows) of the tables."""
        there = self.warehouse.manifest()
        counts = [self.table(n).agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n in ("originals", "lexical", "vectors", "failures") if n in ("originals", "failures") or n in there]
        return reduce(DataFrame.unionAll, counts)
