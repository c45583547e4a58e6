"""Substring deduplication by content-defined chunks.

A gear rolling hash (Xia et al., 2014) over the last 32 bytes of the UTF-8 text decides where chunks may end; chunks hold ``min_bytes`` to
``max_bytes`` bytes and end at character bounds. As the bounds depend on the bytes near them alone, an insertion moves only the
chunks around it. Chunks are told apart by a 128-bit digest; of equal chunks the one of the least (doc_id, place) stays, the others are
repeats. Runs of repeats of ``min_run`` bytes or more are dropped, so that chance repeats of short phrases stay.

The hash is summed by doubling over whole blocks of text with numpy; only the digests, ids and places of chunks are shuffled, never text.

Defined results: null and empty texts have no chunks; a text shorter than min_bytes is one chunk; the last chunk of a text may be
shorter than min_bytes; rows without doc_id have chunks that neither repeat nor are repeated; rows that share a doc_id are told apart by text, and rows that
are wholly equal give equal results, of which the first row's chunks stay in each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm.common import OWN, cut, join_hot

MIN_BYTES, MAX_BYTES = 32, 256
#: A bound follows about every 32nd byte once a chunk has min_bytes: chunks of some 64 bytes.
MASK_BITS = 5
MIN_RUN = 64
SEED = 11
#: Bytes whose hashes are computed at once.
BLOCK = 1 << 20
_GEAR = np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """For each byte the gear hash of it and the 31 before: the sum of their values, each shifted by its distance."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def bounds(data: bytes, min_bytes: int = MIN_BYTES, max_bytes: int = MAX_BYTES, mask_bits: int = MASK_BITS) -> list[int]:
    """Where the chunks of UTF-8 text end."""
    raw, n = np.frombuffer(data, np.uint8), len(data)
    found = []
    for at in range(0, n, BLOCK):  # each block is hashed with the 31 bytes before it
        low = max(0, at - 31)
        hashes = gear(raw[low : at + BLOCK])[at - low :]
        found.append(np.flatnonzero(hashes >> np.uint32(32 - mask_bits) == 0) + at + 1)
    marks = np.concatenate(found) if found else np.empty(0, np.int64)
    marks = marks[marks < n]
    marks = marks[(raw[marks] & 0xC0) != 0x80].tolist()  # no character is cut
    ends, last = [], 0
    for mark in [*marks, n]:
        while mark - last > max_bytes:
            end = last + max_bytes
            while data[end] & 0xC0 == 0x80:
                end -= 1
            ends.append(end)
            last = end
        if mark - last >= min_bytes or mark == n and mark > last:
            ends.append(mark)
            last = mark
    return ends


def chunks(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text_hash, at (first byte), size, d1, d2 (digest): a row for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, sizes, digests = [], [], [], []

            def out() -> pa.RecordBatch:
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                take = pa.array(rows, pa.int32())
                arrays = [batch.column(0).take(take), batch.column(1).take(take), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
                for held in (rows, starts, sizes, digests):
                    held.clear()
                return pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "at", "size", "d1", "d2"])

            for row, text in enumerate(batch.column(2)):
                data, last = (text.as_py() or "").encode("utf-8", "replace"), 0
                for end in bounds(data, **options):
                    rows.append(row)
                    starts.append(last)
                    sizes.append(end - last)
                    digests.append(xxhash.xxh3_128_digest(data[last:end]))
                    last = end
                if len(rows) >= 50_000:
                    yield out()
            if rows:
                yield out()

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    fields = [("doc_id", docs.schema["doc_id"].dataType), ("text_hash", T.LongType()), ("at", T.IntegerType()), ("size", T.IntegerType()), ("d1", T.LongType()), ("d2", T.LongType())]
    return rows.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))


def repeats(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text_hash, at, size, keeper (the doc_id that keeps the chunk): a row for each chunk that repeats another. Digests are counted before the
    exchange. The chunks are cut anew for the join: that is cheaper than keeping them."""
    found = chunks(docs.where(F.col("doc_id").isNotNull()), **options)
    place = F.struct("doc_id", "text_hash", "at")
    first = found.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = join_hot(found, cut(first), ["d1", "d2"]).where(place != F.col("first"))
    return again.select("doc_id", "text_hash", "at", "size", F.col("first.doc_id").alias("keeper")).dropDuplicates(["doc_id", "text_hash", "at"])


def runs(repeated: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, text_hash, runs: for documents with any, the stretches of adjacent repeats that hold min_run bytes or more, as sorted structs of at, size and keepers."""
    order = Window.partitionBy("doc_id", "text_hash").orderBy("at")
    fresh = F.coalesce(F.lag(F.col("at") + F.col("size")).over(order) != F.col("at"), F.lit(True)).cast("long")
    numbered = repeated.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    joined = numbered.groupBy("doc_id", "text_hash", "run").agg(F.min("at").alias("at"), F.sum("size").cast("int").alias("size"), F.array_sort(F.collect_set("keeper")).alias("keepers"))
    return joined.where(F.col("size") >= min_run).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("at", "size", "keepers"))).alias("runs"))


def repeated_runs(docs: DataFrame, min_run: int = MIN_RUN, **options) -> DataFrame:
    """doc_id, text_hash, n_bytes, runs for each row of docs: the stretches of its text that repeat chunks kept elsewhere, or earlier in it."""
    found = runs(repeats(docs, **options), min_run).withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    both = rows.join(found, (rows["doc_id"] == found["found_id"]) & (rows["text_hash"] == found["found_hash"]), "left")
    none = F.array().cast(found.schema["runs"].dataType)
    return both.select("doc_id", "text_hash", "n_bytes", F.coalesce("runs", none).alias("runs"))


def drop_repeats(docs: DataFrame, min_run: int = MIN_RUN, **options) -> DataFrame:
    """docs with the repeated stretches cut out of text."""
    found = runs(repeats(docs, **options), min_run)
    found = found.select(F.col("doc_id").alias(f"{OWN}id"), F.col("text_hash").alias(f"{OWN}right"), F.col("runs").alias(f"{OWN}runs"))
    own = docs.withColumn(f"{OWN}hash", F.xxhash64("text"))
    both = own.join(found, (own["doc_id"] == found[f"{OWN}id"]) & (own[f"{OWN}hash"] == found[f"{OWN}right"]), "left").withColumn(f"{OWN}data", F.col("text").cast("string").cast("binary"))
    cuts = F.col(f"{OWN}runs")
    part = lambda low, high: F.decode(F.substring(F.col(f"{OWN}data"), low + 1, high - low), "utf-8")
    end = lambda i: F.coalesce(F.get(cuts, i)["at"] + F.get(cuts, i)["size"], F.lit(0))
    kept = F.concat(F.array_join(F.transform(cuts, lambda x, i: part(end(i - 1), x["at"])), ""), part(end(F.size(cuts) - 1), F.octet_length(f"{OWN}data")))
    text = F.when(cuts.isNull(), own["text"]).otherwise(kept)
    return both.select(*[text.alias(c) if c == "text" else own[f"`{c}`"] for c in docs.columns])
