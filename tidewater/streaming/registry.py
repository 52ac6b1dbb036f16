"""ST6: the vessel registry as a base table and deltas.

A pass writes only the vessels it scored, as ``delta/v=<batch>``; a vessel's row is the
one of the latest version that has it. Every ``compact_every`` deltas are folded into a new
base, ``base/v=<version>``: of the ``BUCKETS`` parts, by hash of the vessel id, those that the deltas
touch are written anew, the others stay where they are (``parts`` of the base says where
every bucket lies). So a pass costs what it scored, and a compaction what changed.

Versions are batch ids. A compaction before batch n folds in versions below n alone, so a
batch that is replayed after a failure overwrites its own delta and nothing else needs it; what
a compaction supersedes is deleted once the new base is complete.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import path_exists

BUCKETS = 64
PARTS = "bucket int, version long"


class Registry:
    """Rows of ``schema`` by ``key``; ``root`` must be on shared storage."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "mmsi", compact_every: int = 8,
                 buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key
        self.compact_every, self.buckets = compact_every, buckets

    def _list(self, folder: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []

    def _delete(self, folder: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _versions(self, folder: str) -> list[int]:
        """The complete versions of a folder, ascending."""
        found = [int(m[1]) for m in (re.fullmatch(r"v=(\d+)", n) for n in self._list(folder)) if m]
        return sorted(v for v in found if path_exists(self.spark, f"{self.root}/{folder}/v={v}/_SUCCESS"))

    def base_version(self) -> int:
        """The version that the base holds, -1 without a base."""
        return max(self._versions("parts"), default=-1)

    def deltas(self, below: int | None = None) -> list[int]:
        base = self.base_version()
        return [v for v in self._versions("delta") if v > base and (below is None or v < below)]

    def _parts(self, base: int) -> list:
        """(bucket, version of the files that hold it) of a base: at most ``buckets`` rows."""
        return [tuple(r) for r in self.spark.read.schema(PARTS).parquet(f"{self.root}/parts/v={base}").collect()] if base >= 0 else []

    def _base(self, parts: list) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(
            *[f"{self.root}/base/v={v}/bucket={b}" for b, v in parts])

    def _changes(self, versions: list[int]) -> DataFrame:
        """The latest row of each key in deltas, with ``version``."""
        if not versions:
            return self.spark.createDataFrame([], f"{self.schema}, version long")
        frames = self.spark.read.schema(f"{self.schema}, v long").option("basePath", f"{self.root}/delta") \
            .parquet(*[f"{self.root}/delta/v={v}" for v in versions])
        rest = [c for c in frames.columns if c not in (self.key, "v")]
        return (frames.groupBy(self.key).agg(F.max_by(F.struct(*rest), "v").alias("r"), F.max("v").alias("version"))
                .select(self.key, "r.*", "version"))

    def read(self) -> DataFrame:
        """All keys with their latest rows; empty with schema before the first delta."""
        base = self._base(self._parts(self.base_version()))
        new = self._changes(self.deltas()).drop("version")
        return base.join(new.select(self.key), self.key, "left_anti").unionByName(new)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """The rows of one batch, one for each key. Compacts what came before them first, when it is time."""
        if len(self.deltas(batch_id)) >= self.compact_every:
            self.compact(batch_id)
        names = [c.split()[0] for c in self.schema.split(", ")]
        rows.select(*names).write.mode("overwrite").parquet(f"{self.root}/delta/v={batch_id}")

    def compact(self, below: int) -> None:
        """Folds the deltas below a version into the base."""
        old, versions = self.base_version(), self.deltas(below)
        if not versions:
            return
        to, parts = versions[-1], self._parts(old)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = self._changes(versions).drop("version").withColumn("bucket", bucket)
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        kept = self._base([p for p in parts if p[0] in touched])
        whole = kept.join(new.select(self.key), self.key, "left_anti").withColumn("bucket", bucket).unionByName(new)
        (whole.repartition(F.col("bucket")).sortWithinPartitions("bucket", self.key)
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/base/v={to}"))
        parts = [p for p in parts if p[0] not in touched] + [(b, to) for b in touched]
        self.spark.createDataFrame(parts, PARTS).write.mode("overwrite").parquet(f"{self.root}/parts/v={to}")
        # the new base stands: away with what only the old one used
        for v in self._versions("delta"):
            if v <= to:
                self._delete(f"delta/v={v}")
        for v in self._versions("parts")[:-1]:
            self._delete(f"parts/v={v}")
        where = {v for _, v in parts}
        for name in self._list("base"):
            m = re.fullmatch(r"v=(\d+)", name)
            if m and int(m[1]) not in where:
                self._delete(f"base/{name}")
            elif m and int(m[1]) != to:
                for b in self._list(f"base/{name}"):
                    if b.startswith("bucket=") and (int(b[7:]), int(m[1])) not in parts:
                        self._delete(f"base/{name}/{b}")
