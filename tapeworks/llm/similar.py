"""Near copies by SimHash and by the Jaccard similarity of five-word shingles.

Texts with the same set of shingles are one node. Texts whose fingerprints differ in two bits or fewer, found by the Golay keys of ``simhash``, are candidates, and so are those that share a band of MinHash, as
fingerprints of a pair at a similarity of 0.8 differ in about ten bits; all are checked on the whole sets, since fingerprints count a repeated line each time. A set's minima under 144 hash functions are cut into 24 bands of six;
two sets of similarity 0.8 share a band with a probability of 0.9993, and more similar ones with a higher one. Every pair that
shares a band is either checked on the whole sets, or already linked through others that were, or too different by what it has in common: first each bucket's members
are checked against a centre, in a few rounds while these help, which is linear in the bucket's size. The sets of buckets whose members aren't linked by then meet again by their rarest hashes (prefix filtering with
bounds by size and place; Xiao et al., 2008), which leaves pairs that have a template in common and little else apart. Whole sets are read from one table for each check; those of centres, which are few, are broadcast where they are small.

Defined results: words are split at ASCII white space and compared with A-Z in lower case; a text of fewer than five words is one
shingle; texts without words are copies of each other; rows without doc_id stay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm import simhash
from tapeworks.llm.common import OWN, Scratch, cut, join_hot, keep_rows, tidy_shuffles
from tapeworks.llm.components import components
from tapeworks.shipping import ship

SEED = 42
WORDS = 5
#: Least similarity, as a fraction, so that it is compared in whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 24, 6
#: Factor of the sizes of one class.
CLASS = 1.05
#: Most rounds in which buckets are linked through a centre before the pairs left are checked; a round that leaves over nine tenths of them open is the last.
ROUNDS = 3
OPEN = 0.9
#: Sets of centres are broadcast if their hashes take at most so many bytes.
CENTRE_BYTES = 16 << 20
#: Pairs of one set that are looked up in one place.
SPREAD = 64
BLOCK = 1 << 12
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = np.random.default_rng(SEED + 1).integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of a text's different word shingles."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    n = min(words, len(parts))
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[n - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(ends)))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of a set's minima; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK]
        least = np.minimum(least, ((block[None, :] ^ _MASK[:, None]) * _ODD[:, None]).min(axis=1))
    values = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(values, np.uint64).view(np.int64).tolist()


def _set_id(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, id (of the set of shingles), fp (of simhash), keys for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingles(t.as_py()) for t in batch.column(2))
            rows = [(_set_id(s), band_keys(s)) for s in sets]
            fps = np.array([simhash.fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array([i for i, _ in rows], pa.int64()), pa.array(fps), pa.array([k for _, k in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "id", "fp", "keys"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("id", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(run, schema)


def _sets(texts: DataFrame) -> DataFrame:
    """id, hashes of texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t.as_py()).view(np.int64) for t in part.column(1)]
                offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))], ["id", "hashes"])

    return texts.select("id", "text").mapInArrow(run, "id long, hashes array<long>")


def _looked_up(pairs: DataFrame, side: str, other: str, sets: DataFrame) -> DataFrame:
    """pairs with the hashes of one side. A set that many pairs name is dealt out with them, so that no key is hot."""
    slots = pairs.groupBy(side).agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("slots"))
    dealt = pairs.join(slots, side).withColumn("slot", F.pmod(F.xxhash64(other), F.col("slots")).cast("int")).drop("slots")
    copies = sets.withColumnsRenamed({"id": side, "hashes": f"{side}_hashes"}).join(slots, side).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
    return dealt.join(copies, [side, "slot"]).drop("slot")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by their whole sets."""
    first = sets.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    size = first.agg(F.sum(F.size("hashes") * 8)).first()[0] or 0
    both = _looked_up(pairs, "b", "a", sets)
    if size <= CENTRE_BYTES:
        both = both.join(F.broadcast(first.withColumnsRenamed({"id": "a", "hashes": "a_hashes"})), "a")
    else:
        both = _looked_up(both, "a", "b", sets)
    shared = F.size(F.array_intersect("a_hashes", "b_hashes"))
    return both.where(shared * LEAST[1] >= (F.size("a_hashes") + F.size("b_hashes") - shared) * LEAST[0]).select("a", "b")


def _size_class(size: Column) -> Column:
    """Sizes within a factor of CLASS or less of each other have the same class."""
    return F.floor(F.log(size) / F.log(F.lit(CLASS))).cast("int")


def rare_pairs(sets: DataFrame) -> DataFrame:
    """a, b: of sets (id, part, hashes) all pairs of different parts that may be similar. A set's hashes are put in order from the rarest on. Sets with enough hashes in common meet in the first one that they
    have in common, so early that what follows suffices for both; sets that have a frequent part in common, and little else, don't meet there. Sizes are dealt to classes, so that how early is
    early enough is known before two sets meet."""
    each = sets.select("id", "part", F.size("hashes").alias("size"), F.explode("hashes").alias("hash"))
    shared = cut(each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    met = join_hot(each, shared, ["hash"])
    listed = met.groupBy("id", "part", "size").agg(F.array_sort(F.collect_list(F.struct("n", "hash"))).alias("shared"))  # a set's own hashes at most
    placed = listed.select("id", "part", "size", (F.col("size") - F.size("shared")).alias("alone"), F.posexplode("shared").alias("at", "x"))
    own = placed.select("id", "part", "size", F.col("x.hash").alias("hash"), (F.col("size") - F.col("alone") - F.col("at")).alias("rest"))
    least, most = LEAST
    smallest, largest = F.ceil(F.col("size") * least / most), F.floor(F.col("size") * most / least)
    classes = own.where(F.col("rest") * (least + most) >= least * (F.col("size") + smallest)).select(
        "*", _size_class(F.col("size")).alias("class"), F.explode(F.sequence(_size_class(smallest), _size_class(largest))).alias("other")
    )
    # no size of a class is less than this
    bound = F.greatest(smallest, F.floor(F.pow(F.lit(CLASS), F.col("other"))) - 1)
    early = classes.where(F.col("rest") * (least + most) >= least * (F.col("size") + bound))
    key = ["hash", "low", "high"]
    early = early.select("id", "part", "size", "rest", "class", "hash", F.least("class", "other").alias("low"), F.greatest("class", "other").alias("high"))
    several = early.groupBy(*key).agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select(*key)
    early = cut(early.join(several, key))
    right = early.select(*key, *[F.col(c).alias(f"b_{c}") for c in ("id", "part", "size", "rest", "class")])
    suffices = F.least("rest", "b_rest") * (least + most) >= least * (F.col("size") + F.col("b_size"))
    apart = (F.col("low") == F.col("high")) | (F.col("class") != F.col("b_class"))
    return early.join(right, key).where((F.col("id") < F.col("b_id")) & (F.col("part") != F.col("b_part")) & apart & suffices).select(F.col("id").alias("a"), F.col("b_id").alias("b")).distinct()


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: of sets (id, fp) those that the links of simhash join: each with the least of its fingerprint, and the least ones of fingerprints that differ in two bits or fewer."""
    least = cut(nodes.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    same = join_hot(nodes.select("id", "fp"), least, ["fp"]).where("id != least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    ends = [least.select(F.col("fp").alias(side), F.col("least").alias(name)) for side, name in (("a", "x"), ("b", "y"))]
    close = simhash.links(least).join(ends[0], "a").join(ends[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return same.unionByName(close)


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: links between sets that join the same sets as all similar pairs that share a band or have close fingerprints. nodes: id, fp, keys; texts: id, text, of which
    only those with candidates are read."""
    scratch = Scratch(nodes.sparkSession)
    close = cut(fingerprint_pairs(nodes))
    keys = nodes.select("id", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keys = cut(join_hot(keys, cut(shared), ["key"]).select("key", "id"))
    # a checkpoint is read row by row; Parquet would be read in batches of some thousand sets, each of them as long as its text
    met = keys.select("id").unionByName(close.select(F.col("a").alias("id"))).unionByName(close.select(F.col("b").alias("id"))).distinct()
    sets = cut(_sets(texts.join(met, "id", "left_semi")))
    found = nodes.sparkSession.createDataFrame([], "a long, b long")
    open_keys = keys.withColumn("part", F.col("id"))
    left = keys.count()
    for turn in range(ROUNDS):
        centres = open_keys.groupBy("key").agg(F.min_by(F.struct("id", "part"), F.xxhash64("id", F.lit(turn))).alias("centre"), F.count("*").alias("n"))
        spokes = join_hot(open_keys, cut(centres), ["key"]).where(F.col("part") != F.col("centre.part"))
        pairs = spokes.select(F.col("centre.id").alias("a"), F.col("id").alias("b"))
        pairs = scratch.put("spokes", (pairs if turn else pairs.unionByName(close)).distinct())
        classes = components(scratch.put("found", found.unionByName(_similar(pairs, sets))), scratch)
        found = classes.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        still = open_keys.select("key", "id")  # what is one part stays one
        parts = still.join(classes, still["id"] == classes["node"], "left").select("key", "id", F.coalesce("component", "id").alias("part"))
        # both of a bucket of two have been checked
        several = parts.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("n")).where("x < y AND n > 2").select("key", "n")
        open_keys = scratch.put("open", join_hot(parts, cut(several), ["key"]).select("key", "id", "part"))
        before, left = left, open_keys.count()
        if not left or left > OPEN * before:
            break
    if left:
        rest = rare_pairs(sets.join(open_keys.select("id", "part").distinct(), "id").dropDuplicates(["id"]))  # repeated rows give a set twice
        found = scratch.put("found", found.unionByName(_similar(scratch.put("spokes", rest), sets)))
    scratch.drop("spokes", "open")
    return found


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, component_id for each row of docs: the least doc_id among the documents that can be reached over
    links of similarity 0.8 or more."""
    ship(docs.sparkSession)
    with tidy_shuffles(docs.sparkSession):
        return _near_copies(docs)


def _near_copies(docs: DataFrame) -> DataFrame:
    rows = cut(signatures(docs))
    nodes = cut(rows.groupBy("id").agg(F.min(F.struct("doc_id", "text_hash", "fp")).alias("first"), F.first("keys").alias("keys"), F.count("*").alias("n")))
    first = nodes.select("id", "first.doc_id", "first.text_hash").where(F.col("doc_id").isNotNull()).withColumnsRenamed({"doc_id": f"{OWN}id", "text_hash": f"{OWN}hash"})
    named = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    texts = named.join(first, (F.col("doc_id") == F.col(f"{OWN}id")) & (F.col("text_hash") == F.col(f"{OWN}hash")))
    classes = components(links(nodes.select("id", "first.fp", "keys"), texts.select("id", "text")))
    placed = cut(nodes.join(classes, nodes["id"] == classes["node"], "left").select("id", "n", "first.doc_id", F.coalesce("component", "id").alias("component")))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = cut(placed.join(least, "component").select("id", "n", "component_id"))
    return join_hot(rows.drop("keys", "fp"), named, ["id"]).select("doc_id", "text_hash", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near copies: that of the least doc_id. Rows without doc_id stay."""
    found = near_copies(docs.where(F.col("doc_id").isNotNull()))
    copies = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id", "text_hash", F.lit(True).alias(f"{OWN}copy")).distinct()
    return keep_rows(docs, copies, F.col(f"{OWN}copy").isNull())
