"""Language identification by hyperdimensional profiles (Joshi, Halseth and Kanerva, 2016).

Each letter has a random vector of +1 and -1; a trigram's vector is the product of its letters' vectors, rotated by their
places; a text's vector is the sum over its trigrams; a language's prototype is the sum over its training texts, each
scaled to length one. A text is of the language whose prototype has the greatest cosine.

Letters are lower-cased, and everything else is one space. Vectors come from the code point alone, so every worker draws
the same ones. Prototypes are fitted on at most ``max_docs_per_lang`` different texts of each language, those least by a hash
of the text, each taken once however many copies it has. Prototypes are sent to the workers in blocks of about ``block_langs`` languages; more
languages than that take a pass over the texts for each block, and a text has the best of all of them.

A text of n trigrams shows its language less clearly the smaller n is: its expected cosine grows as sqrt(n / (n + c)). The score that
``keep_identified`` asks for follows that curve, so that texts of all lengths are judged.

Defined results: texts that are null or have no letter are ``und`` with score 0; without training texts every text is
``und``; of equal cosines the language first by name wins; rows without lang are never trained on."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.llm.common import OWN, cut
from tapeworks.llm.decontam import looked_up

UNKNOWN = "und"
DIMENSIONS = 512
#: Letters share vectors by code point modulo this.
ROWS = 1 << 12
SEED = 7
#: Letters dealt at random, and scripts without a prototype, stay below this score (they reach some 2 / sqrt(dimensions)); long texts of
#: a known language stay above it. A text of SETTLING trigrams needs the share sqrt(1 / 2) of it.
MIN_SCORE = 0.1
SETTLING = 50
#: Languages whose prototypes are sent together (16 MB at 512 dimensions), and whose sums a task holds at once.
BLOCK_LANGS = 8000
HELD_LANGS = 1000
#: Texts whose vectors are computed at once hold about so many characters; trigrams that are bound at once.
BATCH_CHARS = 1 << 18
BOUND = 1 << 12


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool)


@cache
def _vectors(dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors as they stand first, second and third in a trigram."""
    plain = (np.random.default_rng(SEED).integers(0, 2, (ROWS, dimensions), dtype=np.int8) * 2 - 1).astype(np.int8)
    return np.roll(plain, 2, axis=1), np.roll(plain, 1, axis=1), plain


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of a text's letters, words set off by single spaces, and how often they occur."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(_letters()[points], points % (ROWS - 1) + 1, 0).astype(np.int64)
    if not codes.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.concatenate([[0], codes, [0]])
    codes = codes[(codes != 0) | (np.append(codes[1:], 1) != 0)]  # the last space of each run
    return np.unique(codes[:-2] * ROWS * ROWS + codes[1:-1] * ROWS + codes[2:], return_counts=True)


def text_vectors(texts: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """A row of length one for each text (zeros for texts without letters), and how many trigrams each has."""
    found = [trigram_counts(t) for t in texts]
    used = np.unique(np.concatenate([codes for codes, _ in found])) if found else np.empty(0, np.int64)
    first, second, third = _vectors(dimensions)
    bundled = np.zeros((len(texts), dimensions), np.float32)
    for at in range(0, len(used), BOUND):
        part = used[at : at + BOUND]
        bound = first[part // (ROWS * ROWS)] * second[part // ROWS % ROWS] * third[part % ROWS]
        bound = bound.astype(np.float32)
        for row, (codes, counts) in zip(bundled, found):
            low, high = np.searchsorted(codes, part[0]), np.searchsorted(codes, part[-1], "right")
            if low < high:
                row += counts[low:high].astype(np.float32) @ bound[np.searchsorted(part, codes[low:high])]
    length = np.linalg.norm(bundled, axis=1, keepdims=True)
    return bundled / np.where(length == 0, 1, length), np.array([counts.sum() for _, counts in found], np.int64)


def _slices(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about BATCH_CHARS together; a longer text is alone."""
    at = size = 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) > BATCH_CHARS:
            yield slice(at, i)
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield slice(at, len(texts))


def sampled(labelled: DataFrame, max_docs_per_lang: int) -> DataFrame:
    """lang, text: at most max_docs_per_lang different texts of each language, those least by hash, each once. What is dealt by language
    are hashes, of about 1.5 times as many texts."""
    text, key = F.col("text").cast("string"), F.shiftrightunsigned(F.xxhash64(F.col("text").cast("string")), 1)
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(text.alias("text"), F.col("lang").cast("string").alias("lang"), key.alias("key"))
    texts = cut(usable.groupBy("lang").agg(F.approx_count_distinct("key").alias("texts")))
    near = looked_up(usable.select("lang", "key"), texts, "lang").where(F.col("key") <= F.lit(float(1 << 63)) * 1.5 * max_docs_per_lang / F.col("texts"))
    ranked = near.select("lang", "key").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key")))
    last = cut(ranked.where(F.col("rank") <= max_docs_per_lang).groupBy("lang").agg(F.max("key").alias("last")))
    return looked_up(usable, last, "lang").where("key <= last").groupBy("lang", "key").agg(F.min("text").alias("text")).select("lang", "text")


def fit_prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS, max_docs_per_lang: int = 10_000) -> DataFrame:
    """lang and v (its prototype as an array, not scaled) for each language in labelled (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(dimensions, dtype=np.int32)
        sums: dict[str, np.ndarray] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for lang, total in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * dimensions), pa.array(at), pa.array(total)], ["lang", "at", "value"])
            sums.clear()

        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist()
            for part in _slices(texts):
                vectors, _ = text_vectors(texts[part], dimensions)
                for lang in np.unique(langs[part]):
                    sums[lang] = sums.get(lang, 0) + vectors[langs[part] == lang].sum(axis=0, dtype=np.float64)
                if len(sums) > HELD_LANGS:
                    yield from given()
        yield from given()

    parts = sampled(labelled, max_docs_per_lang).mapInArrow(run, "lang string, at int, value double")
    sums = parts.groupBy("lang", "at").agg(F.sum("value").alias("value"))
    return cut(sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v")).select("lang", "v.value").withColumnRenamed("value", "v"))


def blocks(prototypes: DataFrame, dimensions: int, block_langs: int = BLOCK_LANGS) -> Iterator[tuple[list[str], np.ndarray]]:
    """Names and prototypes (rows of length one) of about block_langs languages at a time; one block without languages if there are none."""
    n = -(-prototypes.count() // block_langs)
    if not n:
        yield [], np.zeros((0, dimensions), np.float32)
    for part in range(n):
        rows = prototypes.where(F.pmod(F.xxhash64("lang"), F.lit(n)) == part).orderBy("lang").collect()
        if rows:
            matrix = np.array([r["v"] for r in rows])
            length = np.linalg.norm(matrix, axis=1, keepdims=True)
            yield [r["lang"] for r in rows], (matrix / np.where(length == 0, 1, length)).astype(np.float32)


def predicted(spark: SparkSession, text: Column, names: list[str], prototypes: np.ndarray) -> Column:
    """A struct for a text: lang_pred, score (the cosine, 0 to 1), cosine, and its number of trigrams."""
    dimensions = prototypes.shape[1]
    shipped = spark.sparkContext.broadcast((names, prototypes))

    def predict(column: pa.Array) -> pa.Array:
        known, matrix = shipped.value
        texts = [t or "" for t in column.to_pylist()]
        langs, best, sizes = [], [], []
        for part in _slices(texts):
            vectors, trigrams = text_vectors(texts[part], dimensions)
            some = (vectors != 0).any(axis=1) & bool(known)
            cosines = vectors @ matrix.T if known else np.zeros((len(vectors), 1))
            langs += [known[b] if ok else UNKNOWN for b, ok in zip(cosines.argmax(axis=1), some)]
            best += np.where(some, cosines.max(axis=1), 0).tolist()
            sizes += trigrams.tolist()
        arrays = [pa.array(langs, pa.string()), pa.array(np.clip(np.array(best, np.float64), 0, 1)), pa.array(best, pa.float64()), pa.array(sizes, pa.int64())]
        return pa.StructArray.from_arrays(arrays, ["lang_pred", "score", "cosine", "trigrams"])

    kind = "struct<lang_pred: string, score: double, cosine: double, trigrams: bigint>"
    return F.arrow_udf(predict, kind)(text.cast("string"))


def in_training(doc_id: Column) -> Column:
    """Whether a document may be trained on: three of four, by the CRC of its id. Null ids aren't."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2, F.lit(False))


def identify(docs: DataFrame, training: DataFrame, dimensions: int = DIMENSIONS, block_langs: int = BLOCK_LANGS, **options) -> DataFrame:
    """docs with a struct column __tw_lang (lang_pred, score, cosine, trigrams), learned from training (text, lang)."""
    name, found = f"{OWN}lang", None
    for names, matrix in blocks(fit_prototypes(training, dimensions, **options), dimensions, block_langs):
        new = predicted(docs.sparkSession, F.col("text"), names, matrix)
        if found is None:
            found = docs.withColumn(name, new)
            continue
        # each block is a pass of its own, so that a worker holds one
        both = cut(found).withColumn(f"{OWN}new", new)
        a, b = F.col(name), F.col(f"{OWN}new")
        better = (b["cosine"] > a["cosine"]) | ((b["cosine"] == a["cosine"]) & (b["lang_pred"] < a["lang_pred"]))
        found = both.withColumn(name, F.when(better, b).otherwise(a)).drop(f"{OWN}new")
    return found


def keep_identified(docs: DataFrame, training: DataFrame, min_score: float = MIN_SCORE, settling: float = SETTLING, **options) -> DataFrame:
    """The rows of docs whose text has a language: not und, and a score of min_score x sqrt(n / (n + settling)) or more at n trigrams."""
    found = identify(docs, training, **options)
    n = F.greatest(F.col(f"{OWN}lang.trigrams"), F.lit(1))
    kept = (F.col(f"{OWN}lang.lang_pred") != UNKNOWN) & (F.col(f"{OWN}lang.score") >= min_score * F.sqrt(n / (n + settling)))
    return found.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
