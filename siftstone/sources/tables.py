"""Tables of the engine as Parquet folders: originals, golden sets, reports, and a warehouse of tables with common versions.

A version of the warehouse is a manifest: for each table its schema and the folder of each of its buckets. Folders are written once and never
changed; a change writes new folders and then, in one step, the next manifest. So a reader that holds a version keeps it whatever is written
later, all tables change together, and a change that fails or dies leaves nothing that a reader sees. Folders that only old versions name go by expire().
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _TIME, _INT = T.StringType(), T.TimestampType(), T.IntegerType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


ORIGINALS = _struct(doc_id=_TEXT, raw_text=_TEXT, business_type=_TEXT, source_metadata=T.MapType(_TEXT, _TEXT), stored_at=_TIME)
FAILURES = _struct(id=_TEXT, chunk_id=_TEXT, doc_id=_TEXT, failure_mode=_TEXT, error_msg=_TEXT, attempt_count=_INT, created_at=_TIME, last_attempt=_TIME, resolved=T.BooleanType())
#: Documents that a stage failed on, until they get through.
QUARANTINE = _struct(doc_id=_TEXT, stage=_TEXT, error_msg=_TEXT, attempts=_INT, first_at=_TIME, last_at=_TIME)
REVIEWS = _struct(
    review_id=_TEXT, doc_id=_TEXT, audited_at=_TIME, total_groups=_INT, ok=_INT, should_merge=_INT, should_split=_INT, boundary_issue=_INT, audit_failed=_INT, skipped=_INT,
    groups=T.ArrayType(_struct(group_key=_TEXT, grouping_type=_TEXT, verdict=_TEXT, confidence=_TEXT, reason=_TEXT, affected=T.ArrayType(_TEXT))),
)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session on one machine gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="siftstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    # The shuffle files of this write aren't needed once the table is there.
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the folder of a materialised() table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_json_originals(spark: SparkSession, path: str) -> DataFrame:
    """Originals from a folder of JSON files, one a document; files that don't parse are left out. The id is the file's stem where the record has none."""
    schema = T.StructType([*ORIGINALS.fields, T.StructField("_corrupt", _TEXT)])
    raw = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return raw.select("*", stem.alias("_stem")).where("_corrupt IS NULL").withColumn("doc_id", F.coalesce("doc_id", "_stem")).select(*ORIGINALS.names)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(id, query, relevant_doc_ids, relevant_chunk_ids, notes, expected_empty) of a golden set file."""
    schema = "version string, business_type string, items array<struct<id:string,query:string,relevant_doc_ids:array<string>,relevant_chunk_ids:array<string>,notes:string>>"
    items = spark.read.schema(schema).option("multiLine", True).json(path).select("business_type", F.explode("items").alias("i")).select("business_type", "i.*")
    return items.withColumn("expected_empty", F.contains(F.coalesce("notes", F.lit("")), F.lit("expected_empty=true")))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report of write_report()."""
    return spark.read.json(path)


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """current with new's rows in place of those of the same keys. Of several new rows with a key the one of the largest hash stays, so reruns agree."""
    new = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), F.xxhash64(*[F.to_json(F.struct(c)) for c in new.columns])).alias("_row")).select("_row.*")
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_where(current: DataFrame, condition: Column) -> tuple[DataFrame, Column]:
    """What stays, and the aggregate that counts what goes."""
    gone = F.coalesce(condition, F.lit(False))
    return current.where(~gone), F.count_if(gone)


class Conflict(Exception):
    """Another change was committed first; begin anew."""


@dataclass
class Warehouse:
    """Tables below `root` whose versions are numbered manifests; the highest is live."""

    spark: SparkSession
    root: str

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(), self._path(f"{self.root}/{folder}")
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and n[0].isdigit())

    def live(self) -> int:
        """The live version; 0 before the first change."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{table: {schema, parts: {bucket or "": folder}}} of a version, the live one by default."""
        version = self.live() if version is None else version
        if not version:
            return {}
        path = f"{self.root}/manifests/{version:010d}.json"
        if not self._fs().exists(self._path(path)):
            raise ValueError(f"no version {version}")
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def read(self, name: str, schema: T.StructType | None = None, buckets: list[int] | None = None, version: int | None = None, of: dict | None = None) -> DataFrame:
        """A table of a version, or of the manifest `of`; with buckets, only these are read. schema is that of a table that isn't there yet."""
        entry = (self.manifest(version) if of is None else of).get(name)
        if entry is None:
            if schema is None:
                raise ValueError(f"there is no table {name}")
            return self.spark.createDataFrame([], schema)
        known = T.StructType.fromJson(entry["schema"])
        paths = [f"{self.root}/data/{folder}" for bucket, folder in entry["parts"].items() if buckets is None or not bucket or int(bucket) in buckets]
        return self.spark.read.schema(known).parquet(*paths) if paths else self.spark.createDataFrame([], known)

    def change(self) -> Change:
        return Change(self)

    def switch(self, version: int) -> int:
        """Makes an older version's tables live again, as a new version; returns the version before."""
        change = self.change()
        change.tables = self.manifest(version)
        return change.commit() - 1

    def expire(self, keep: int = 1) -> int:
        """Removes all but the last `keep` versions and the folders that only they name; the number of folders removed. Don't run it beside a change."""
        versions, fs = self.versions(), self._fs()
        stay, go = versions[-keep:], versions[: -keep or None]
        named = {folder.split("/")[0] for v in stay for entry in self.manifest(v).values() for folder in entry["parts"].values()}
        for v in go:
            fs.delete(self._path(f"{self.root}/manifests/{v:010d}.json"), False)
        gone = [n for n in self._names("data") if n not in named]
        for n in gone:
            fs.delete(self._path(f"{self.root}/data/{n}"), True)
        return len(gone)


class Change:
    """A version in the making: nothing is live before commit()."""

    def __init__(self, warehouse: Warehouse):
        self.warehouse, self.base = warehouse, warehouse.live()
        self.tables: dict = warehouse.manifest(self.base)

    def read(self, name: str, schema: T.StructType | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as this change has it so far."""
        return self.warehouse.read(name, schema, buckets, of=self.tables)

    def put(self, name: str, df: DataFrame, by: str | None = None, touched: list[int] | None = None) -> None:
        """Rows of df in place of the touched buckets of a table (of all, where touched is None). by names the column with the bucket, an int; df may read any table.

        Large buckets get several files: rows are rebalanced by bucket, not gathered in a task a bucket.
        """
        w = self.warehouse
        folder = f"{name}-{uuid.uuid4().hex}"
        if by is None:
            df.write.parquet(f"{w.root}/data/{folder}")
            parts = {"": folder}
        else:
            df.withColumn("bucket_no", F.col(by)).hint("rebalance", "bucket_no").write.partitionBy("bucket_no").parquet(f"{w.root}/data/{folder}")
            parts = {n.removeprefix("bucket_no="): f"{folder}/{n}" for n in w._names(f"data/{folder}") if n.startswith("bucket_no=")}
        old = {} if touched is None or name not in self.tables else {b: f for b, f in self.tables[name]["parts"].items() if b and int(b) not in touched}
        self.tables = self.tables | {name: {"schema": json.loads(df.schema.json()), "parts": old | parts}}

    def commit(self) -> int:
        """Makes the change live; its version. Raises Conflict where another change came first."""
        w, fs, version = self.warehouse, self.warehouse._fs(), self.base + 1
        draft, final = (w._path(f"{w.root}/manifests/{n}.json") for n in (f"draft-{uuid.uuid4().hex}", f"{version:010d}"))
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(self.tables).encode()))
        out.close()
        jvm, gateway = w.spark._jvm, w.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), w.spark._jsc.hadoopConfiguration())
        try:
            # Without the option to overwrite, the rename fails where the version is there.
            context.rename(draft, final, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"version {version} is there already") from e
            raise
        return version


@dataclass
class Store:
    """One table of a warehouse."""

    warehouse: Warehouse
    name: str

    def exists(self) -> bool:
        return self.name in self.warehouse.manifest()

    def read(self, schema: T.StructType | None = None, buckets: list[int] | None = None) -> DataFrame:
        return self.warehouse.read(self.name, schema, buckets)

    def replace(self, df: DataFrame, by: str | None = None) -> int:
        """df as the whole table, live; the version."""
        change = self.warehouse.change()
        change.put(self.name, df, by)
        return change.commit()


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def dump(config) -> str:
    return json.dumps(config, default=lambda o: o.__dict__, ensure_ascii=False, indent=2)
