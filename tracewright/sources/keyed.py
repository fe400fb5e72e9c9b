"""Tables whose rows are replaced by key, one commit after the other.

Rows lie in files by a hash of their key. A commit is a small list of which folder holds which bucket; it is written aside and
then renamed, so a reader sees the table before or after a write and never between, and a write that dies leaves folders
that no commit names. A write touches the buckets of its own keys only and writes their other rows again. There is one
writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.staging import delete
from .logs import replaced, upserted

BUCKETS = 64
#: Files of a bucket, so that a key that holds much of a table isn't written by one task.
SPREAD = 8
COMMIT = "bucket int, folder string"


def path_of(spark: SparkSession, path: str):
    """The path and its file system, as Spark's own."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, where = path_of(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


class KeyedTable:
    """A table at a path, of a schema, whose rows belong to ``keys``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def _names(self, path: str) -> list[str]:
        return names_in(self.spark, path)

    def version(self) -> int:
        """Number of the last commit, 0 before the first."""
        return max(map(int, self._names(f"{self.path}/commits")), default=0)

    def folders(self) -> dict[int, str]:
        """Bucket -> folder as of the last commit; a row for each bucket at most."""
        n = self.version()
        return {r["bucket"]: r["folder"] for r in self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits/{n:08d}").collect()} if n else {}

    def _rows(self, folders: dict[int, str]) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self.folders())

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, touched: set[int], rows, before: dict[int, str]) -> int:
        folder, n = uuid.uuid4().hex, self.version()
        old = self._rows({b: f for b, f in before.items() if b in touched})
        out = rows(old).select(*self.schema.names).withColumn("bucket", self._bucket())
        out.repartition("bucket", F.pmod(F.xxhash64(*self.schema.names), F.lit(SPREAD))).write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        written = {int(x.split("=")[1]) for x in self._names(f"{self.path}/data/{folder}") if x.startswith("bucket=")}
        after = {b: f for b, f in before.items() if b not in touched} | dict.fromkeys(written, folder)
        aside = f"{self.path}/aside-{folder}"
        self.spark.createDataFrame(sorted(after.items()), COMMIT).coalesce(1).write.parquet(aside)
        fs, source = path_of(self.spark, aside)
        to = path_of(self.spark, f"{self.path}/commits/{n + 1:08d}")[1]
        fs.mkdirs(to.getParent())
        if fs.exists(to) or not fs.rename(source, to):
            raise RuntimeError(f"another writer made commit {n + 1} of {self.path}")
        return n + 1

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect()}

    def replace(self, new: DataFrame, gone: DataFrame | None = None) -> int:
        """All rows of the keys in ``new`` and in ``gone`` (keys only) make room for the rows of ``new``; gives the commit's number.

        ``new`` is read twice: stage it if that is dear or not the same each time.
        """
        keys = new.select(*self.keys) if gone is None else new.select(*self.keys).unionByName(gone.select(*self.keys))
        return self._write(self._touched(keys), lambda old: replaced(old.join(keys.distinct(), self.keys, "left_anti"), new.select(*old.columns), self.keys), self.folders())

    def upsert(self, new: DataFrame, row_keys: list[str]) -> int:
        """Rows with the same ``row_keys`` (the table's keys among them) get the values of ``new`` that aren't null."""
        return self._write(self._touched(new), lambda old: upserted(old, new.select(*old.columns), row_keys), self.folders())

    def vacuum(self, keep: int = 1) -> None:
        """Deletes commits before the last ``keep`` and folders that no commit left names."""
        commits = self._names(f"{self.path}/commits")
        for n in commits[:-keep]:
            delete(self.spark, f"{self.path}/commits/{n}")
        named = {r["folder"] for n in commits[-keep:] for r in self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits/{n}").select("folder").distinct().collect()}
        for folder in self._names(f"{self.path}/data"):
            if folder not in named:
                delete(self.spark, f"{self.path}/data/{folder}")
