"""Parquet tables with versions: a write puts new files beside the old ones, and then one small file that says which of them are the table.

A table is cut into parts by a label of its rows (a date, a month, a bucket of its key). A change reads and writes the parts alone that arrivals touch; the files of all others
stay as they are. Readers see the version before or the one after, and a write that fails leaves the one before. Labels, and so the entries of a version, are as many as the
table has parts, whatever its rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_PART = "_part"
_WHOLE = "all"


class Refused(ValueError):
    """A write that its guard forbids."""


class Conflict(RuntimeError):
    """Another writer has made the same version."""


def bucket_of(keys: Sequence[str], n: int) -> Column:
    """A label for each of n buckets of a key."""
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("string")


class Table:
    def __init__(self, spark: SparkSession, folder: str, schema: StructType, label: Column | None = None):
        """label: an expression of a row's part, in letters, digits, ``-``, ``_`` and ``.``; without it the table is one part."""
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        own = F.lit(_WHOLE) if label is None else F.coalesce(label.cast("string"), F.lit("none"))
        self.label = F.when(own.rlike(r"^[A-Za-z0-9_.-]+$"), own).otherwise(F.raise_error(F.concat(F.lit("not a label: "), own)).cast("string"))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version; 0 if there is none."""
        fs, base = self._fs(), self._path("versions")
        return max((int(s.getPath().getName()[1:]) for s in fs.listStatus(base)), default=0) if fs.exists(base) else 0

    def _entries(self, version: int) -> tuple[dict[str, str], int]:
        """The folder of each part, and the batch that was last put in (-1: none)."""
        if not version:
            return {}, -1
        lines = [r.value.split("\t") for r in self.spark.read.text(f"{self.folder}/versions/v{version:08d}").collect()]
        return {name: at for name, at in lines if name != "#batch"}, next(int(at) for name, at in lines if name == "#batch")

    def batch(self) -> int:
        return self._entries(self.version())[1]

    def read(self, labels: Sequence[str] | None = None, version: int | None = None) -> DataFrame:
        """The table, or those of its parts that are asked for."""
        entries, _ = self._entries(self.version() if version is None else version)
        paths = [f"{self.folder}/{at}" for name, at in entries.items() if labels is None or name in labels]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*paths)

    def _stage(self, rows: DataFrame) -> tuple[dict[str, str], int]:
        """Writes rows to a folder of their own, and counts them on the way. A part that is large is dealt to several files."""
        at, seen = f"data/{uuid.uuid4().hex}", Observation()
        shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], self.label.alias(_PART))
        counted = shaped.observe(seen, F.count(F.lit(1)).alias("n"))
        counted.hint("rebalance", _PART).write.partitionBy(_PART).parquet(f"{self.folder}/{at}")
        found = [s.getPath().getName() for s in self._fs().listStatus(self._path(at)) if s.isDirectory()]
        return {name.removeprefix(f"{_PART}="): f"{at}/{name}" for name in found if name.startswith(f"{_PART}=")}, seen.get["n"]

    def _commit(self, entries: dict[str, str], base: int, batch: int) -> int:
        """Makes version base + 1 by a rename that doesn't replace."""
        fs, draft, final = self._fs(), self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"versions/v{base + 1:08d}")
        out = fs.create(draft)
        out.write(bytearray("".join(f"{name}\t{at}\n" for name, at in [("#batch", str(batch)), *sorted(entries.items())]).encode()))
        out.close()
        fs.mkdirs(self._path("versions"))
        if fs.exists(final) or not fs.rename(draft, final):
            raise Conflict(f"version {base + 1} is taken")
        return base + 1

    def replace(self, rows: DataFrame, allow_empty: bool = False, dry_run: bool = False) -> int:
        """Makes rows the whole table, in one pass, and gives their number. No rows are refused, unless they are allowed; a dry run counts only."""
        if dry_run:
            return rows.count()
        base = self.version()
        entries, n = self._stage(rows)
        if not n and not allow_empty:
            raise Refused("nothing to publish")
        self._commit(entries, base, self._entries(base)[1])
        return n

    def change(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None) -> list[str]:
        """Puts merge(old, rows) in place of the parts that rows touch, where old is what these parts hold, and gives their labels. A batch that was put in before is left out, so that
        it may run again."""
        base = self.version()
        entries, last = self._entries(base)
        touched = [r[0] for r in rows.select(self.label).distinct().collect()]  # a row for each part
        if batch is None or batch > last:
            staged = self._stage(merge(self.read(touched, base), rows))[0] if touched else {}
            self._commit({k: v for k, v in entries.items() if k not in touched} | staged, base, last if batch is None else batch)
        return touched

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the newest versions, and the parts that none of these has."""
        fs, last = self._fs(), self.version()
        versions = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(self._path("versions"))) if last else []
        used = {at for n in versions[-keep:] for at in self._entries(n)[0].values()}
        for n in versions[:-keep]:
            fs.delete(self._path(f"versions/v{n:08d}"), False)
        for write in fs.listStatus(self._path("data")) if last else []:
            for part in fs.listStatus(write.getPath()):
                if part.isDirectory() and f"data/{write.getPath().getName()}/{part.getPath().getName()}" not in used:
                    fs.delete(part.getPath(), True)
