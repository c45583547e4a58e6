"""Size-tiered compaction of append-only shards under versioned manifests.

A dataset is a folder that all executors share. Arrivals are appended as small immutable Parquet shards; compaction merges shards of similar size
(a tier holds those up to ``growth`` times as large as the last) into shards of about the target size, and a version is a manifest: a table of the
shards that are live, with their rows, bytes, arrival and tier. A version is committed by one rename of a finished manifest folder to its number, which
fails if another writer took that number first; readers follow the newest committed manifest and so see whole versions only. Shards that a crashed writer
left behind belong to no manifest and are never read.

Merging reads each tier's shards in packed splits and writes one shard for each group of splits, without a shuffle. Manifests are read and written by Spark
(they grow with the number of shards); the driver sees counts for each tier.

Defined results: an empty arrival commits a version without new shards, and a dataset of such arrivals alone is an empty frame; rows are kept as they are, repeated ones, nulls and extra columns
included; columns named like the manifest's don't clash with it, as the manifest is a table of its own."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES = 128 << 20
#: A tier holds files up to so many times as large as the last; the first ends at SMALLEST_BYTES.
GROWTH = 4
SMALLEST_BYTES = 1 << 20
#: Shards that a tier must have before it is merged.
FANOUT = 4
#: Where a path names a shard from the dataset's folder on.
SHARD = r"shards/[0-9a-f]{32}/.*$"
MANIFEST = "file string, arrival long, rows long, bytes long, tier int"


class Conflict(RuntimeError):
    """Another writer has committed the same version."""


class Dataset:
    def __init__(self, spark: SparkSession, folder: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, growth: int = GROWTH):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.target_bytes, self.fanout, self.growth = target_bytes, fanout, growth

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        fs, base = self._fs(), self._path("manifests")
        if not fs.exists(base):
            return 0
        return max((int(s.getPath().getName()[1:]) for s in fs.listStatus(base) if s.getPath().getName()[:1] == "v"), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifests/v{version:08d}")

    def _commit(self, manifest: DataFrame, base: int) -> int:
        """Makes manifest version base + 1."""
        fs, draft, final = self._fs(), self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"manifests/v{base + 1:08d}")
        manifest.write.parquet(draft.toString())
        fs.mkdirs(self._path("manifests"))
        if fs.exists(final) or not fs.rename(draft, final) or fs.exists(self._path(f"manifests/v{base + 1:08d}/{draft.getName()}")):
            raise Conflict(f"version {base + 1} is taken")
        return base + 1

    def _tier(self) -> Column:
        steps = F.log(F.greatest(F.col("bytes") / SMALLEST_BYTES, F.lit(1.0))) / math.log(self.growth)
        return F.ceil(F.round(steps, 9)).cast("int")

    def _files(self, folder: str) -> DataFrame:
        """file (its path from the dataset's folder) and bytes of the Parquet files under folder."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
        return files.select(F.regexp_extract("path", SHARD, 0).alias("file"), F.col("length").alias("bytes"))

    def _shards(self, folder: str) -> DataFrame:
        """The shards under folder as manifest rows without arrival: rows are counted from the files' footers."""
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(folder).select(F.regexp_extract("_metadata.file_path", SHARD, 0).alias("file"))
        joined = self._files(folder).join(rows.groupBy("file").agg(F.count("*").alias("rows")), "file")
        return joined.select("file", "rows", "bytes", self._tier().alias("tier"))

    def append(self, arrivals: DataFrame, key: str | None = None) -> int:
        """Commits arrivals as new shards: one version, or with key (an integer column that numbers arrivals, and isn't kept) one for each number, in
        their order. All are written by one job."""
        self.spark.createDataFrame([], (arrivals if key is None else arrivals.drop(key)).schema).write.mode("ignore").parquet(f"{self.folder}/schema")
        if arrivals.isEmpty():
            version = self.version()
            return self._commit(self.manifest(version), version)
        target = f"{self.folder}/shards/{uuid.uuid4().hex}"
        if key is None:
            arrivals.write.parquet(target)
        else:
            arrivals.write.partitionBy(key).parquet(target)
        found = self._shards(target)
        number = F.lit(0) if key is None else F.regexp_extract("file", rf"/{key}=(-?\d+)/", 1).cast("long")
        found = found.select("file", number.cast("long").alias("number"), "rows", "bytes", "tier")
        draft = f"{self.folder}/drafts/{uuid.uuid4().hex}"
        found.write.parquet(draft)
        found = self.spark.read.parquet(draft)
        numbers = [0] if key is None else [r["number"] for r in found.select("number").distinct().orderBy("number").collect()]
        version = self.version()
        for n in numbers:  # one for each arrival
            new = found.where(F.col("number") == n).withColumn("arrival", F.lit(version + 1).cast("long")).select("file", "arrival", "rows", "bytes", "tier")
            version = self._commit(self.manifest(version).unionByName(new).coalesce(1), version)
        return version

    def compact(self) -> int:
        """Merges, from the smallest tier on, each tier that has fanout shards or more and is below the target, until none has. Returns the version."""
        while True:
            version = self.version()
            tiers = self.manifest(version).where(F.col("bytes") < self.target_bytes // 2).groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).orderBy("tier").collect()
            due = next((t for t in tiers if t["n"] >= self.fanout), None)
            if due is None:
                return version
            live = self.manifest(version)
            chosen = (F.col("tier") == due["tier"]) & (F.col("bytes") < self.target_bytes // 2)
            merged = self._merge(live.where(chosen), max(1, round(due["bytes"] / self.target_bytes)))
            new = merged.withColumn("arrival", F.lit(version + 1).cast("long")).select("file", "arrival", "rows", "bytes", "tier")
            self._commit(live.where(~chosen).unionByName(new).coalesce(1), version)

    def _merge(self, old: DataFrame, n_shards: int) -> DataFrame:
        """Writes the rows of the old shards as n_shards new ones."""
        target = f"{self.folder}/shards/{uuid.uuid4().hex}"
        self._rows(old).coalesce(n_shards).write.parquet(target)
        return self._shards(target)

    def _rows(self, shards: DataFrame) -> DataFrame:
        """The rows of shards. Their paths are the driver's list of what to read, as in any Spark scan."""
        paths = [f"{self.folder}/{r['file']}" for r in shards.select("file").orderBy("file").toLocalIterator()]
        return self.spark.read.parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default; without shards an empty frame of the first arrival's columns."""
        shards = self.manifest(version)
        return self.spark.read.parquet(f"{self.folder}/schema") if shards.isEmpty() else self._rows(shards)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the shards that the newest keep manifests don't name, and the older manifests; shards of a writer that hasn't committed must not be
        there. Returns how many files went."""
        newest, fs = self.version(), self._fs()
        kept = None
        for v in range(max(1, newest - keep + 1), newest + 1):
            files = self.manifest(v).select("file")
            kept = files if kept is None else kept.union(files)
        if kept is None:
            return 0
        there = self._files(f"{self.folder}/shards")
        gone = 0
        for row in there.join(kept.distinct(), "file", "left_anti").toLocalIterator():
            gone += bool(fs.delete(self._path(row["file"]), False))
        for v in range(1, newest - keep + 1):
            fs.delete(self._path(f"manifests/v{v:08d}"), True)
        fs.delete(self._path("drafts"), True)
        return gone
