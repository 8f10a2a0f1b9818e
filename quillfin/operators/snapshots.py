"""Versioned Parquet tables: a commit replaces only the buckets that changed, and succeeds only if nobody else has committed meanwhile."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16


class Conflict(RuntimeError):
    """Another writer has committed the version that this commit was to become."""


class Versioned:
    """A table in a folder: data folders, and a log with one small file for each version that names the folder of each bucket.

    A version is committed when its log file exists, which only one writer can create. Readers see whole versions, old ones stay readable. A writer that dies leaves a
    data folder that no version names, and nothing else. Rows are put in buckets by a hash of their keys.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def _fs(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _entry(self, version: int) -> dict[str, str] | None:
        """Folders by bucket; null while a version's file isn't whole."""
        fs, at = self._fs(f"log/{version:09d}")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except json.JSONDecodeError:
            return None

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        fs, at = self._fs("log")
        if not fs.exists(at):
            return 0
        last = max((int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()), default=0)
        return last if last == 0 or self._entry(last) is not None else last - 1

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        folders = sorted(set((self._entry(version) or {}).values())) if version else []
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        entry = self._entry(version)
        pieces = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in entry.items()]
        return self.spark.read.schema(self.schema).parquet(*pieces)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def commit(self, rows: DataFrame, expected: int) -> dict[str, int]:
        """The table becomes ``rows`` (one for each key): version ``expected`` + 1. Counts rows written anew, and keys added, changed and removed.

        Buckets in which no row differs from version ``expected`` keep their files. Where nothing differs there is no new version.
        """
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields))
        old = self.read(expected)
        mark = lambda df, name: df.select(*self.keys, F.struct(F.xxhash64(*df.columns).alias("h")).alias(name))
        both = mark(old, "_o").join(mark(rows, "_n"), self.keys, "full_outer")
        change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "changed")
        found = both.select(self._bucket().alias("bucket"), change.alias("change")).where("change is not null").groupBy("bucket", "change").count().collect()  # a few numbers a bucket
        touched = sorted({r["bucket"] for r in found})
        out = {k: sum(r["count"] for r in found if r["change"] == k) for k in ("added", "changed", "removed")}
        if not touched and expected:
            return out | {"buckets": 0, "version": expected}
        folder = uuid.uuid4().hex
        own = rows.withColumn("bucket", self._bucket())
        own.where(F.col("bucket").isin(touched)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        entry = {b: f for b, f in (self._entry(expected) or {}).items() if int(b) not in touched} if expected else {}
        for b in touched:
            fs, at = self._fs(f"data/{folder}/bucket={b}")
            if fs.exists(at):  # else the bucket has become empty
                entry[str(b)] = folder
        self._claim(expected + 1, entry)
        return out | {"buckets": len(touched), "version": expected + 1}

    def _claim(self, version: int, entry: dict[str, str]) -> None:
        fs, at = self._fs(f"log/{version:09d}")
        try:
            stream = fs.create(at, False)  # only where there is none
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"version {version} of {self.path} is taken") from e
            raise
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()

    def update(self, change: Callable[[DataFrame], DataFrame], attempts: int = 5) -> dict[str, int]:
        """``change`` applied to the last version; tried again from the version that came between."""
        for _ in range(attempts):
            version = self.version()
            try:
                return self.commit(change(self.read(version)), version)
            except Conflict:
                continue
        raise Conflict(f"{self.path} changes faster than this commit")
