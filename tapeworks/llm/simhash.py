"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments. By the pigeonhole principle two fingerprints that differ in at
most two bits agree wholly in one segment, and in each other one they differ in at most two bits. The perfect binary
Golay code (23, 12) puts every 23-bit word within three bits of exactly one codeword. A segment is padded to 23 bits;
its keys are the codewords that the words within one bit of it decode to: one key if it lies within two bits of a
codeword, else six. Segments within two bits of each other have a word halfway, and so share a key. A join key is thus
an exact segment with a codeword of the next segment: 34 bits, about 16 keys a fingerprint. Pairs that share one are
verified by counting bits.

Buckets with more than ``bucket`` fingerprints aren't paired: their members are linked through the words one bit away
(65 each), and two fingerprints that have such a word in common differ in at most two bits, and the reverse. That is
exact and linear in the bucket's size.

Defined results: texts without words (null, empty, blank) have fingerprint zero, and link like any other; rows
without doc_id get a fingerprint and no component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm.common import OWN, cut, join_hot, keep_rows
from tapeworks.llm.components import components

SEED = 42
#: (first bit, bits) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0xAE3
BUCKET = 64
#: Shingles whose hashes are held at once while a text's bits are counted.
BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, each counted as often as it occurs."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    n = min(words, len(parts))
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[n - 1 :]
    digest, total = xxhash.xxh64_intdigest, len(ends)
    counts = np.zeros(64, np.int64)
    for at in range(0, total, BLOCK):
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int((counts * 2 > total).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_hash, fp (signed 64 bits) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), words) for t in batch.column(2)]
            fps = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["doc_id", "text_hash", "fp"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(run, schema)


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator: 11 bits, 0 for codewords."""
    left = words.astype(np.int64)
    for bit in range(22, 10, -1):
        left = np.where((left >> bit) & 1 == 1, left ^ (GENERATOR << (bit - 11)), left)
    return left


def _error_table() -> np.ndarray:
    """For each syndrome the only pattern of at most three errors that has it."""
    one = 1 << np.arange(23, dtype=np.int64)
    two = np.array([one[i] | one[j] for i in range(23) for j in range(i)])
    three = np.array([one[i] | one[j] | one[k] for i in range(23) for j in range(i) for k in range(j)])
    patterns = np.concatenate([np.zeros(1, np.int64), one, two, three])
    table = np.zeros(2048, np.int64)
    table[_syndromes(patterns)] = patterns
    return table


def codewords(segments: np.ndarray) -> np.ndarray:
    """For each segment (padded to 23 bits) the 12-bit indices of the codewords that it and the 23 words one bit from it
    decode to: rows of 24, with repeats."""
    near = segments.astype(np.int64)[:, None] ^ np.concatenate([np.zeros(1, np.int64), 1 << np.arange(23, dtype=np.int64)])
    return (near ^ _error_table()[_syndromes(near)]) >> 11


def golay_keys(fps: np.ndarray) -> list[np.ndarray]:
    """For each fingerprint its join keys, without repeats: 2 bits of segment, 22 of the exact segment, 12 of a codeword."""
    words = fps.view(np.uint64)
    parts = [((words >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    all_keys = []
    for i in range(3):
        index = codewords(parts[(i + 1) % 3])
        all_keys.append((np.int64(i) << 34) | (parts[i][:, None] << 12) | index)
    return [np.unique(row) for row in np.concatenate(all_keys, axis=1)]


def with_keys(fps: DataFrame) -> DataFrame:
    """fp, key: a row for each Golay key of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 4096):
                part = values[at : at + 4096]
                keys = golay_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, [len(k) for k in keys])), pa.array(np.concatenate(keys))], ["fp", "key"])

    return fps.select("fp").mapInArrow(run, "fp long, key long")


def links(fps: DataFrame, max_bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """a, b: pairs of different fingerprints (fp, without repeats) of at most max_bits (0 to 2) differing bits, a < b
    for pairs from small buckets; fingerprints of large buckets are linked by stars that join the same fingerprints."""
    if not 0 <= max_bits <= 2:
        raise ValueError("Golay keys find up to two differing bits")
    keys = cut(with_keys(fps))
    sizes = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    sized = cut(join_hot(keys, sizes, ["key"]))  # the rows of shared keys, dealt out once for the pairs' two sides and the large buckets
    small = sized.where(F.col("n") <= bucket).select("key", "fp")
    other = small.select("key", F.col("fp").alias("b"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = small.join(other, "key").where((F.col("fp") < F.col("b")) & close).select(F.col("fp").alias("a"), "b")
    large = sized.where(F.col("n") > bucket).select("fp").distinct()
    one_bit_away = F.array(*[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)])
    if max_bits == 2:
        halfway = large.select("fp", F.explode(F.concat(F.array("fp"), one_bit_away)).alias("word"))
        least = halfway.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("word", "a")
        stars = halfway.join(least, "word").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b"))
        return pairs.unionByName(stars).distinct()
    if max_bits == 1:
        near = large.select(F.col("fp").alias("a"), F.explode(one_bit_away).alias("b"))
        return pairs.unionByName(near.where("a < b").join(large.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b")).distinct()
    return pairs


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """doc_id, text_hash, fp, component_id for each row of docs: component_id is the least doc_id among the documents
    that can be reached over links of at most max_bits differing bits."""
    fps = cut(fingerprints(docs, words))
    ids = fps.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    ids = cut(ids)
    found = links(ids, max_bits, bucket)
    edges = found.join(ids.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(ids.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    classes = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    named = cut(ids.join(classes, ids["least"] == classes["node"], "left").select("fp", F.coalesce("component", "least").alias("component_id"), "n"))
    alone = fps.where(F.col("doc_id").isNull()).select("doc_id", "text_hash", "fp", F.col("doc_id").alias("component_id"))
    return join_hot(fps.where(F.col("doc_id").isNotNull()), named, ["fp"]).select("doc_id", "text_hash", "fp", "component_id").unionByName(alone)


def drop_near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """docs with one document of each group of near-duplicates: that of the least doc_id (of rows that share it, all whose
    texts are the same). Rows without doc_id stay."""
    found = near_duplicates(docs.where(F.col("doc_id").isNotNull()), words, max_bits)
    copies = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id", "text_hash", F.lit(True).alias(f"{OWN}copy")).distinct()
    return keep_rows(docs, copies, F.col(f"{OWN}copy").isNull())
