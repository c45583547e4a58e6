"""Phrase collocation mining with mergeable Misra-Gries summaries (Misra and Gries, 1982; Agarwal et al., 2012).

Phrases are word sequences within pieces of text, told apart by language. A first pass hashes them, deals the hashes to partitions and keeps a summary for each:
counters, of which the least are subtracted from all whenever there are more than the capacity. A partition's capacity (``COUNTERS`` at least) exceeds its mass (the occurrences dealt to it) divided by the
threshold, so no hash loses ``threshold`` of its count, and every frequent phrase survives. Map tasks send the counts of a stretch of text as a summary that was never cut, after the
stretch's mass, so a partition knows its whole mass before it merges the first one. Words and pairs are mined first; phrases of three or more words go in a second time over the texts,
and only where all their pairs have survived.

The last pass counts exactly, by the words themselves: occurrences of all phrases whose hash is in a table of ``BITS`` bits of the survivors. What the table lets through by chance has its exact
count, too, and goes by that; so the table needs no other size when there are more survivors.

Defined results: null texts are empty, a null lang is ``und``; repeated rows and rows that share a doc_id all count; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.common import OWN, cut
from tapeworks.llm.decontam import looked_up
from tapeworks.shipping import ship

UNKNOWN = "und"
LONGEST, THRESHOLD, TOP = 5, 100, 2000
#: A-Z in lower case; what ends a piece as a line feed; a tab as a space.
_PLAIN = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP = re.compile(rb"\n+")
#: Bytes of text that are hashed at once, and different hashes that a map task holds before it sends them.
STRETCH, HELD = 4 << 20, 3 << 20
#: Phrases whose exact counts a map task holds before it sends them.
COUNTED = 600_000
#: Counters that a hash partition has in any case: the more, the less is cut, and the fewer rare phrases survive.
COUNTERS = 1 << 20
#: Bits of the table of survivors, and how many of them each sets.
BITS, PROBES = 1 << 27, 2
#: Groups that a language's phrases are dealt to before its first ones are chosen.
SALTS = 64
_MULTIPLIER, _MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """A number for each different word; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def numbered(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words of texts by number, with 0 between pieces and texts, and the words. Lower-cases A-Z in UTF-8, in which no other letter holds these bytes."""
    tokens = _GAP.sub(b" \n ", b"\n".join(texts).translate(_PLAIN)).split(b" ")
    numbers = _Words({b"\n": 0, b"": -1})
    found = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
    found = found[found >= 0]
    del numbers[b""]
    return np.where(found > 0, found - 1, 0), list(numbers)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIXER
    return x ^ (x >> np.uint64(29))


def phrase_hashes(lang: str, numbers: np.ndarray, words: list[bytes], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of words: the hashes of the phrases that begin at each place, and whether one does."""
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))[numbers]
    hashes, whole = _mixed(own ^ np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 1))), numbers > 0
    for size in range(1, longest + 1):
        if size > 1:
            hashes, whole = _mixed(hashes[:-1] * _MULTIPLIER + own[size - 1 :]), whole[:-1] & (numbers[size - 1 :] > 0)
        yield size, hashes, whole


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


class Summary:
    """A Misra-Gries summary: at most ``capacity`` counters after each cut. A key's count is too low by at most ``removed``."""

    def __init__(self, capacity: int):
        self.capacity, self.removed = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = merged([self.keys, keys], [self.counts, counts])
        if len(self.keys) > self.capacity:
            least = np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1]
            stay = self.counts > least
            self.keys, self.counts, self.removed = self.keys[stay], self.counts[stay] - least, self.removed + int(least)

    def survivors(self, threshold: int) -> np.ndarray:
        return self.keys[self.counts + self.removed >= threshold]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts by language, in stretches."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            held.setdefault(lang, []).append(text)
            size += len(text) + 64
            if size >= STRETCH:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def _in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for probe in range(PROBES):
        at = (hashes >> np.uint64(32 * probe)) % np.uint64(len(table) * 8)
        found &= (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def _mined_sizes(lang: str, texts: list[bytes], sizes: range, table: np.ndarray | None) -> list[np.ndarray]:
    """The hashes of all occurrences of phrases of these sizes; of three or more words only where each pair of them is in the table."""
    numbers, words = numbered(texts)
    out, linked = [], None
    for size, hashes, whole in phrase_hashes(lang, numbers, words, sizes[-1]):
        if table is not None and size == 2:
            pairs = whole.copy()
            pairs[whole] = _in_table(table, hashes[whole])
            linked = pairs
        elif table is not None and size > 2:
            linked = linked[:-1] & pairs[size - 2 :]
        if size in sizes:
            out.append(hashes[whole if linked is None else linked])
    return out


def _summarise(batches: Iterator[pa.RecordBatch], sizes: range, n_parts: int, table: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """part, kind (0: mass alone, 1: counters), mass, keys, counts: summaries of stretches, cut up by hash partition."""
    keys, counts, held = [], [], 0

    def sent() -> Iterator[pa.RecordBatch]:
        k, c = merged(keys, counts)
        part = k % np.uint64(n_parts)
        order = np.argsort(part, kind="stable")
        k, c, part = k[order], c[order], part[order]
        bounds = np.searchsorted(part, np.arange(n_parts + 1, dtype=np.uint64))
        rows = [(p, int(low), int(high)) for p, (low, high) in enumerate(zip(bounds, bounds[1:])) if high > low]
        small = np.uint8 if len(c) and c.max() < 256 else np.int64
        for at in range(0, len(rows), 64):
            some = rows[at : at + 64]
            masses = [int(c[low:high].sum()) for _, low, high in some]
            none = [b""] * len(some)
            for kind, mass, ks, cs in ((0, masses, none, none), (1, [0] * len(some), [k[a:b].tobytes() for _, a, b in some], [bytes([small().itemsize]) + c[a:b].astype(small).tobytes() for _, a, b in some])):
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in some], pa.int32()), pa.array([kind] * len(some), pa.int32()), pa.array(mass, pa.int64()), pa.array(ks, pa.binary()), pa.array(cs, pa.binary())], ["part", "kind", "mass", "keys", "counts"])

    for lang, texts in _stretches(batches):
        for hashes in _mined_sizes(lang, texts, sizes, table.value if table else None):
            k, c = np.unique(hashes, return_counts=True)
            keys.append(k)
            counts.append(c.astype(np.int64))
            held += len(k)
        if held >= HELD:
            k, c = merged(keys, counts)
            keys, counts, held = [k], [c], len(k)
            if held >= HELD // 2:
                yield from sent()
                keys, counts, held = [], [], 0
    if held:
        yield from sent()


def _merge(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """key: what survives of each hash partition. Rows come by partition, masses first."""
    part, mass, summary = None, 0, None

    def survivors() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(summary.survivors(threshold).view(np.int64))], ["key"])

    for batch in batches:
        for p, kind, m, ks, cs in zip(*[batch.column(i).to_pylist() for i in range(5)]):
            if p != part:
                if summary:
                    yield survivors()
                part, mass, summary = p, 0, None
            mass += m
            if kind == 1:
                summary = summary or Summary(max(mass // threshold + 1, COUNTERS))
                summary.merge(np.frombuffer(ks, np.uint64), np.frombuffer(cs[1:], np.uint8 if cs[0] == 1 else np.int64).astype(np.int64))
    if summary:
        yield survivors()


def frequent(texts: DataFrame, sizes: range, threshold: int, table: Broadcast | None = None) -> DataFrame:
    """key: hashes of phrases of these sizes (lang, text), among them those of all that occur threshold times or more."""
    spark = texts.sparkSession
    most = (texts.agg(F.sum(F.octet_length("text") + 2)).first()[0] or 0) // 2 * len(sizes)
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), most // (threshold * COUNTERS) + 1)
    sent = texts.mapInArrow(lambda batches: _summarise(batches, sizes, n_parts, table), "part int, kind int, mass long, keys binary, counts binary")
    dealt = sent.repartition(n_parts, "part").sortWithinPartitions("part", "kind")
    return cut(dealt.mapInArrow(lambda batches: _merge(batches, threshold), "key long"))


def bit_table(keys: DataFrame) -> Broadcast:
    """A table of BITS bits of the keys (key: long), put together from 64-bit words, for map tasks."""
    probes = F.array(*[F.pmod(F.shiftrightunsigned("key", 32 * probe), F.lit(BITS).cast("long")) for probe in range(PROBES)])
    words = keys.select(F.explode(probes).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits")).toArrow()
    table = np.zeros(BITS // 64, np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(table.view(np.uint8))


def _exact(lang: str, texts: list[bytes], longest: int, table: np.ndarray) -> tuple[list[str], list[int]]:
    """Phrases and their counts in a stretch, by the words; the empty phrase counts all words."""
    numbers, words = numbered(texts)
    phrases, counts = [""], [int((numbers > 0).sum())]
    same, found = numbers, None  # same: a number for each different phrase of the size before, where there is one
    for size, hashes, whole in phrase_hashes(lang, numbers, words, longest):
        if size > 1:
            same = same[:-1] * len(words) + numbers[size - 1 :]
        # a phrase is frequent only where the one before, which it begins with, is
        live = whole if found is None else whole & found[: len(whole)]
        at = np.flatnonzero(live)
        at = at[_in_table(table, hashes[at])]
        found = np.zeros(len(whole), bool)
        found[at] = True
        _, first, inverse, n = np.unique(same[at], return_index=True, return_inverse=True, return_counts=True)
        phrases += [b" ".join(words[w] for w in numbers[i : i + size]).decode("utf-8", "replace") for i in at[first].tolist()]
        counts += n.tolist()
        dense = np.zeros(len(same), np.int64)
        dense[at] = inverse
        same = dense
    return phrases, counts


def _counted(batches: Iterator[pa.RecordBatch], longest: int, table: Broadcast, n_parts: int) -> Iterator[pa.RecordBatch]:
    """part, lang, phrases (by lines), counts: exact counts of stretches, cut up by hash partition."""
    held: dict[str, dict[str, int]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, found in held.items():
            parts: dict[int, list[str]] = {}
            for phrase in found:
                parts.setdefault(zlib.crc32(phrase.encode()) % n_parts, []).append(phrase)
            columns = [pa.array(list(parts), pa.int32()), pa.array([lang] * len(parts), pa.string()), pa.array(["\n".join(some) for some in parts.values()], pa.string()), pa.array([np.array([found[p] for p in some], np.int64).tobytes() for some in parts.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "lang", "phrases", "counts"])
        held.clear()

    for lang, some in _stretches(batches):
        own = held.setdefault(lang, {})
        for phrase, n in zip(*_exact(lang, some, longest, table.value)):
            own[phrase] = own.get(phrase, 0) + n
        if sum(map(len, held.values())) >= COUNTED:
            yield from sent()
    yield from sent()


def _totals(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """lang, phrase, size, n of the phrases that are frequent, and of the empty one. Rows come by partition."""
    part, sums = None, {}

    def frequent_ones() -> Iterator[pa.RecordBatch]:
        for lang, found in sums.items():
            rows = [(p, n) for p, n in found.items() if n >= threshold or not p]
            columns = [pa.array([lang] * len(rows), pa.string()), pa.array([p for p, _ in rows], pa.string()), pa.array([p.count(" ") + 1 if p else 0 for p, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "size", "n"])

    for batch in batches:
        for p, lang, phrases, counts in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if p != part:
                yield from frequent_ones()
                part, sums = p, {}
            own = sums.setdefault(lang, {})
            for phrase, n in zip(phrases.split("\n"), np.frombuffer(counts, np.int64).tolist()):
                own[phrase] = own.get(phrase, 0) + n
    yield from frequent_ones()


def phrase_counts(texts: DataFrame, longest: int, threshold: int, table: Broadcast) -> DataFrame:
    """lang, phrase, size, n: exact counts of all phrases of up to longest words with threshold occurrences or more, and of all words as the phrase of size 0. Tasks send what they have counted by hash
    partition, as they send summaries, so that words that all stretches hold cross the exchange in a few rows for each task."""
    n_parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = texts.mapInArrow(lambda batches: _counted(batches, longest, table, n_parts), "part int, lang string, phrases string, counts binary")
    dealt = sent.repartition(n_parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(lambda batches: _totals(batches, threshold), "lang string, phrase string, size int, n long")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, n, score of all phrases of two words or more: that of their lowest-scoring cut."""
    key = lambda phrase: F.concat(F.col("lang"), F.lit("\t"), phrase)  # noqa: E731  (no phrase has a tab)
    phrases = counts.where("size > 0")
    every = counts.where("size = 0").select("lang", F.col("n").alias("all"))
    known = phrases.select(key(F.col("phrase")).alias("key"), "n")
    words = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    cuts = phrases.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": key(part(F.lit(1), F.col("k"))), "right": key(part(F.col("k") + 1, F.col("size")))})
    with_left = looked_up(cuts, known.withColumnsRenamed({"key": "left", "n": "l"}), "left")
    both = looked_up(looked_up(with_left, known.withColumnsRenamed({"key": "right", "n": "r"}), "right"), every, "lang")
    score = F.expr("(1000 * cast(a AS decimal(19,0)) * cast(all AS decimal(19,0))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))")
    each = both.select("lang", "phrase", "size", "a", F.col("all").alias("n"), F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    lowest = each.groupBy("lang", "phrase", "size", "a", "n").agg(F.array_min(F.collect_list("cut")).alias("cut"))  # a phrase has a few cuts
    return lowest.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score")


def redundant(counts: DataFrame) -> DataFrame:
    """lang, phrase: those that a longer phrase holds as often as they occur. Each phrase between the two is as frequent, so the next longer ones decide."""
    words = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(words, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("size") - 1), " "))
    longer = counts.where("size > 2").select("lang", F.explode(inner).alias("phrase"), F.lit(None).cast("long").alias("own"), F.col("n").alias("longer"))
    own = counts.where("size > 1").select("lang", "phrase", F.col("n").alias("own"), F.lit(None).cast("long").alias("longer"))
    return own.unionByName(longer).groupBy("lang", "phrase").agg(F.max("own").alias("own"), F.max("longer").alias("longer")).where("longer >= own").select("lang", "phrase")


def first_of(rows: DataFrame, top: int = TOP, salts: int = SALTS) -> DataFrame:
    """The first rows of each language with their rank. Each of salts groups of a language gives its own first ones before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt, place = f"{OWN}salt", f"{OWN}place"
    some = rows.withColumn(salt, F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn(place, F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col(place) <= top)
    ranked = some.drop(salt, place).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top)


def collocations(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of two to longest words that occur threshold times or more."""
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = frequent(texts, range(1, min(longest, 2) + 1), threshold)
    keys = short
    if longest > 2:
        keys = short.unionByName(frequent(texts, range(3, longest + 1), threshold, bit_table(short)))
    counts = cut(phrase_counts(texts, longest, threshold, bit_table(keys)))
    gone = redundant(counts)
    kept = scored(counts).join(gone, ["lang", "phrase"], "left_anti")
    return first_of(kept, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
