"""A keyed table in hash buckets: writers rewrite the buckets that they touch, and one manifest at a time says which files count.

A manifest has a number, one series for all writers, the folder of each bucket, and the last batch of each writer. It is created only if
its number is still free, so of two writers at once one goes again from the other's result. A batch that is done isn't done again.
Readers see one manifest; folders that none of the last ones names are deleted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class VesselTable:
    """One row per key, of every field the newest value by ``order`` that a row carried; a field that new rows lack stays as it was."""

    def __init__(self, spark: SparkSession, path: str, key: str = "mmsi", order: str = "seq", buckets: int = 16, keep: int = 3):
        self.spark, self.path, self.key, self.order, self.buckets, self.keep = spark, path.rstrip("/"), key, order, buckets, keep
        self._paths = spark._jvm.org.apache.hadoop.fs
        self._store = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._paths.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """The numbers of the manifests that are kept."""
        folder = self._at("manifests")
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._store.listStatus(folder) if s.getPath().getName().endswith(".json")) if self._store.exists(folder) else []

    def manifest(self, version: int | None = None) -> dict:
        """A manifest, the newest one if no number is given."""
        numbers = self.versions() if version is None else [version]
        if not numbers:
            return {"version": 0, "buckets": {}, "done": {}, "schema": None}
        text = self.spark.read.text(f"{self.path}/manifests/{numbers[-1]:012d}.json", wholetext=True)
        return json.loads(text.first()[0])

    def _commit(self, manifest: dict) -> bool:
        """Whether the manifest's number was free. It is written aside and renamed, which takes place or doesn't where a rename
        doesn't replace files; a store whose renames do needs one writer at a time.
        """
        aside, to = self._at(f"manifests/.{uuid.uuid4().hex}"), self._at(f"manifests/{manifest['version']:012d}.json")
        out = self._store.create(aside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        done = not self._store.exists(to) and self._store.rename(aside, to)
        if not done:
            self._store.delete(aside, False)
        return done

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest one if none is given."""
        return self._rows(self.manifest(version))

    def _rows(self, manifest: dict, only: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{folder}" for b, folder in manifest["buckets"].items() if only is None or int(b) in only]
        schema = StructType.fromJson(manifest["schema"]) if manifest["schema"] else StructType()
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def upsert(self, batch: DataFrame, batch_id: int, writer: str = "stream") -> None:
        """Merges a batch; as a foreachBatch sink it may come again after a failure, whole or done."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())  # ``buckets`` rows at most
        while (old := self.manifest())["done"].get(writer, -1) < batch_id:
            fields = [c for c in batch.columns if c not in (self.key, self.order)]
            rows = batch
            if known := [b for b in touched if str(b) in old["buckets"]]:
                rows = self._rows(old, known).unionByName(batch, allowMissingColumns=True)
                fields = [c for c in rows.columns if c not in (self.key, self.order)]
            merged = rows.groupBy(self.key).agg(F.max(self.order).alias(self.order), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(self.order))).alias(c) for c in fields))
            number = old["version"] + 1
            folder = f"data/{number:012d}-{uuid.uuid4().hex}"
            merged.withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
            new = {"version": number, "buckets": old["buckets"] | {str(b): f"{folder}/__bucket={b}" for b in touched}, "done": old["done"] | {writer: batch_id}, "schema": json.loads(merged.schema.json())}
            if self._commit(new):
                break
            self._store.delete(self._at(folder), True)
        self._vacuum()

    def __call__(self, batch: DataFrame, batch_id: int, writer: str = "stream") -> None:
        self.upsert(batch, batch_id, writer)

    def _vacuum(self) -> None:
        """Deletes what no manifest of the last ``keep`` names, but for what a writer under way may have begun."""
        numbers = self.versions()
        for n in numbers[: -self.keep]:
            self._store.delete(self._at(f"manifests/{n:012d}.json"), False)
        try:
            used = {f.split("/")[1] for n in numbers[-self.keep :] for f in self.manifest(n)["buckets"].values()}
        except PySparkException:  # another writer has just deleted one of them: it also tidies
            return
        for s in self._store.listStatus(self._at("data")) if self._store.exists(self._at("data")) else ():
            name = s.getPath().getName()
            if name not in used and int(name.split("-")[0]) < numbers[-1]:
                self._store.delete(s.getPath(), True)
