"""Writers: state tables in versions, decision logs and text files made of ordered parts."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BUCKET = "book_bucket"
_MANIFEST = re.compile(r"version-(\d{10})\.json$")


class ConcurrentWrite(RuntimeError):
    """Another writer made the next version of the table meanwhile."""


@dataclass(frozen=True)
class Manifest:
    """One version of a state table: its columns and the folder of every bucket that has rows."""

    version: int
    schema: str
    folders: dict[int, str]


class _Storage:
    """The few file operations that a table of versions needs, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(path).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._hadoop.Path(path)

    def names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return [status.getPath().getName() for status in self._fs.listStatus(self._path(folder))]

    def read(self, file: str) -> str:
        stream = self._fs.open(self._path(file))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, file: str, content: str) -> None:
        stream = self._fs.create(self._path(file), False)
        try:
            stream.write(bytearray(content.encode()))
        finally:
            stream.close()

    def rename(self, source: str, target: str) -> bool:
        """Give a file its name; false if there is a file of that name."""
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self._gateway.new_array(self._gateway.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(self._path(source)), self._fs.makeQualified(self._path(target)), none)
        except Py4JJavaError as failed:
            if failed.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


def versions(spark: SparkSession, path: str, name: str) -> list[int]:
    """The versions of a table that can be read, the oldest first."""
    found = map(_MANIFEST.match, _Storage(spark, path).names(f"{path}/{name}"))
    return sorted(int(m.group(1)) for m in found if m)


def manifest(spark: SparkSession, path: str, name: str, version: int | None = None) -> Manifest | None:
    """A version of a table, the newest one by default; None before the first write."""
    if version is None:
        version = max(versions(spark, path, name), default=None)
        if version is None:
            return None
    content = json.loads(_Storage(spark, path).read(f"{path}/{name}/version-{version:010d}.json"))
    return Manifest(version, json.dumps(content["schema"]), {int(k): v for k, v in content["folders"].items()})


def _rows(spark: SparkSession, path: str, name: str, found: Manifest, buckets: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(found.schema))
    folders = [f"{path}/{name}/{f}" for b, f in sorted(found.folders.items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def save_tables(tables: dict[str, DataFrame], path: str, buckets: int = 64, books: DataFrame | None = None) -> None:
    """Write state tables; every book in ``books`` is replaced, all others stay.

    ``books`` (``doc_id``) defaults to the books that have rows in the table; a book in it
    without rows is removed. Books are hashed to ``buckets`` folders instead of getting one
    folder each, which would make as many files as books. The folders of the written books
    are written anew, with the new rows and the rows of their other books, beside the old
    ones. Then a manifest with the folders of all buckets gets its name by one rename: who
    reads meanwhile sees the version before or this one as a whole, and a failed write
    leaves the table as it was. If another writer made the same version, nothing changes and
    ``ConcurrentWrite`` is raised. :func:`drop_old_versions` deletes what is no longer read.
    """
    for name, df in tables.items():
        spark = df.sparkSession
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
        old, rows, folders, schema = manifest(spark, path, name), df, {}, df.schema
        if old is not None:
            replaced = (df if books is None else books).select("doc_id").distinct()
            # At most one number for each bucket.
            touched = [row[0] for row in replaced.select(bucket).distinct().collect()]
            others = _rows(spark, path, name, old, touched).join(replaced, "doc_id", "left_anti")
            rows = df.unionByName(others, allowMissingColumns=True)
            folders = {b: f for b, f in old.folders.items() if b not in touched}
            schema = df.limit(0).unionByName(_rows(spark, path, name, old, []), allowMissingColumns=True).schema
        version = old.version + 1 if old else 0
        written = f"data-{version:010d}-{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, bucket).write.partitionBy(BUCKET).parquet(f"{path}/{name}/{written}")
        storage = _Storage(spark, path)
        for part in storage.names(f"{path}/{name}/{written}"):
            if part.startswith(f"{BUCKET}="):
                folders[int(part.split("=")[1])] = f"{written}/{part}"
        content = json.dumps({"schema": json.loads(schema.json()), "folders": folders})
        draft = f"{path}/{name}/draft-{uuid.uuid4().hex}"
        storage.write(draft, content)
        if not storage.rename(draft, f"{path}/{name}/version-{version:010d}.json"):
            storage.delete(draft)
            storage.delete(f"{path}/{name}/{written}")
            raise ConcurrentWrite(f"{name}: version {version} was written by another job")


def load_table(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """The rows of the newest version when it is called, or of a given one; later writes do not change them."""
    found = manifest(spark, path, name, version)
    if found is None:
        raise ValueError(f"there is no table {name} in {path}")
    return _rows(spark, path, name, found)


def drop_old_versions(spark: SparkSession, path: str, name: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` versions, and the folders that only they have."""
    known = versions(spark, path, name)
    kept, gone = known[-keep:], known[:-keep]
    storage = _Storage(spark, path)
    used = {f for v in kept for f in manifest(spark, path, name, v).folders.values()}
    # First the names, then the rows: a version that has a name is whole.
    stale = {f for v in gone for f in manifest(spark, path, name, v).folders.values()} - used
    for v in gone:
        storage.delete(f"{path}/{name}/version-{v:010d}.json")
    for folder in stale:
        storage.delete(f"{path}/{name}/{folder}")


def qc_log_append(decisions: DataFrame, path: str) -> None:
    """Append decision records as JSON lines."""
    decisions.write.mode("append").json(path)


def write_parts(parts: DataFrame, text: str, path: str) -> None:
    """Write exported parts as text files, in order of book and part."""
    ordered = parts.repartitionByRange("doc_id", "part_no").sortWithinPartitions("doc_id", "part_no")
    ordered.select(text).write.mode("overwrite").text(path)
