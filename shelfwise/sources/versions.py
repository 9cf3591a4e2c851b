"""Folders for intermediate and versioned tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_owned: dict[tuple[str, str], str] = {}


def scratch(spark: SparkSession) -> str:
    """A new place below ``spark.checkpoint.dir``, which driver and executors share; on a single machine a
    temporary folder stands in where that isn't set. All places of an application lie in one folder, which
    goes when its driver ends; what isn't needed so long can be deleted before."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ""
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = (spark.sparkContext.applicationId, base)
    if own not in _owned:
        folder = f"{(base or 'file://' + tempfile.mkdtemp(prefix='shelfwise-')).rstrip('/')}/{uuid.uuid4().hex}"
        path, fs = _hadoop(spark, folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _owned[own] = folder
    return f"{_owned[own]}/{uuid.uuid4().hex}"


#: Spark's setting by which a frame's shuffle files go when its run ends, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to a folder of their own and read back: computed once, however often they are used.
    What was shuffled for them goes from disk when they are written."""
    spark, folder = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.parquet(folder)  # a frame of its own, which runs this once
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def delete(spark: SparkSession, folder: str) -> None:
    path, fs = _hadoop(spark, folder)
    fs.delete(path, True)


def drop(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


class VersionedTable:
    """A table as numbered Parquet folders: a version is written whole before readers can see it, so a
    rewrite may read the version that it replaces, and one that fails hinders no other. Of the versions
    only the last ``keep`` stay. What was read here is what a write follows: if another writer has put a
    version in between, the write is an error, and nothing of the other's is lost."""

    def __init__(self, spark: SparkSession, folder: str, partition_by: tuple[str, ...] = ("site",), keep: int = 3):
        self.spark, self.folder, self.partition_by, self.keep = spark, folder.rstrip("/"), partition_by, keep
        self._seen: int | None = None

    def _path(self, name: str):
        return _hadoop(self.spark, f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[int]:
        path, fs = self._path("")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def read(self, schema: str | None = None) -> DataFrame:
        """The newest version, or an empty table of ``schema``."""
        found = self.versions()
        self._seen = found[-1] if found else 0
        if not found:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.folder}/v{found[-1]:08d}")

    def write(self, df: DataFrame) -> int:
        """Write the version after the one that was read last (without any, the newest) and return its number."""
        number, attempt = (self._seen if self._seen is not None else (self.versions() or [0])[-1]) + 1, f".next-{uuid.uuid4().hex}"
        source, fs = self._path(attempt)
        target, _ = self._path(f"v{number:08d}")
        try:
            df.write.partitionBy(*[c for c in self.partition_by if c in df.columns]).parquet(f"{self.folder}/{attempt}")
            if (self.versions() or [0])[-1] >= number or not fs.rename(source, target):
                raise OSError(f"version {number} exists already: the table has changed since it was read")
        finally:
            fs.delete(source, True)
        self._seen = number
        for old in self.versions()[: -self.keep]:
            fs.delete(self._path(f"v{old:08d}")[0], True)
        return number
