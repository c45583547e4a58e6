"""Line deduplication (native): range-partitioned line hashes, streamed in (document, position) order,
give the documents' keep bitmaps; texts are cut by them only when asked for. A bitmap is compressed: of its 64-bit words
only those are held in which a line goes, and all others are ones.

Defined results: a null or empty text is one empty line. Keys shorter than ``min_chars`` never go. A line
whose document has no doc_id stays and isn't counted. Rows that share a doc_id count as one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.common import BLANKS, OWN, ascii_lower, cut, join_hot, row_key, text_of

#: A key's documents are dealt over so many groups, so that a line held by a third of all documents
#: is sorted by as many tasks; the groups' counts are then added up.
SALTS = 64


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """doc_id, text_hash, pos and the 128-bit hash (h1, h2) of each line's key of min_chars code points or more."""
    key = ascii_lower(F.btrim(F.col("line"), F.lit(BLANKS)))
    return (
        row_key(docs)
        .where(F.col("doc_id").isNotNull())
        .select("doc_id", "text_hash", F.posexplode(lines_of(text_of())).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def shared_keys(hashes: DataFrame, min_docs: int = 3, salts: int = SALTS) -> DataFrame:
    """(h1, h2, n, keeper): keys found in n documents, min_docs or more, and the largest doc_id that holds each.
    The hashes are dealt out by range and sorted by document and position, so that one pass over a
    partition sees each document's first occurrence of a key; what crosses the next exchange is one row
    for each key and group."""
    dealt = hashes.select("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), "doc_id", "pos")
    ranged = dealt.repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", "doc_id", "pos")
    stream = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "pos")
    before = F.lag("doc_id").over(stream)
    first = ranged.withColumn("first", before.isNull() | (before != F.col("doc_id"))).where("first")
    return first.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)


def line_bitmaps(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """doc_id, text_hash, n_dropped, kept: for documents that lose lines, their keep bitmap: sorted structs of word (line number over 64) and bits (set: the
    line stays) of the words that aren't all ones."""
    hashes = cut(line_hashes(docs, min_chars))
    gone = join_hot(hashes, cut(shared_keys(hashes, min_docs)), ["h1", "h2"]).where(F.col("doc_id") < F.col("keeper"))
    bit = F.expr("shiftleft(1L, pos & 63)")
    words = gone.select("doc_id", "text_hash", F.shiftright("pos", 6).alias("word"), bit.alias("bit")).groupBy("doc_id", "text_hash", "word").agg(F.bit_or("bit").alias("bits"))
    kept = F.struct("word", F.bitwise_not("bits").alias("bits"))
    return words.groupBy("doc_id", "text_hash").agg(F.sum(F.bit_count("bits")).alias("n_dropped"), F.array_sort(F.collect_list(kept)).alias("kept"))


def unpacked(kept: str) -> Column:
    """A keep bitmap with all its words up to the last that is held."""
    return F.expr(f"flatten(transform({kept}, (x, i) -> concat(array_repeat(-1L, x.word - coalesce(get({kept}, i - 1).word, -1) - 1), array(x.bits))))")


def cut_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with a column kept_text: the text without its dropped lines. Texts that lose none are left as they are
    (null: null)."""
    own = docs.withColumn(f"{OWN}hash", F.xxhash64("text"))
    right = bitmaps.select(
        F.col("doc_id").alias(f"{OWN}id"), F.col("text_hash").alias(f"{OWN}right"),
        unpacked("kept").alias(f"{OWN}bits"), F.col("n_dropped").alias(f"{OWN}n"),
    )
    joined = own.join(right, (own["doc_id"] == right[f"{OWN}id"]) & (own[f"{OWN}hash"] == right[f"{OWN}right"]), "left")
    bits = lambda i: F.coalesce(F.get(F.col(f"{OWN}bits"), F.shiftright(i, 6)), F.lit(-1).cast("long"))
    stays = lambda x, i: F.getbit(bits(i), i.bitwiseAND(63)) == 1
    kept = F.array_join(F.filter(lines_of(own["text"]), stays), "\n")
    return joined.withColumn(f"{OWN}kept", F.when(F.col(f"{OWN}n").isNull(), own["text"]).otherwise(kept))


def kept_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept_text for each row of docs."""
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    done = cut_lines(plain, line_bitmaps(plain, min_docs, min_chars))
    return done.select(
        "doc_id",
        F.size(lines_of(text_of())).cast("long").alias("n_lines"),
        F.coalesce(f"{OWN}n", F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(f"{OWN}kept", F.lit("")).alias("kept_text"),
    )


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """docs with their shared lines taken out of text (and n_chars, where there is one, counted anew); a document that
    loses every line stays, with an empty text."""
    done = cut_lines(docs, line_bitmaps(docs, min_docs, min_chars))
    lost = F.col(f"{OWN}n").isNotNull()
    columns = {"text": F.col(f"{OWN}kept")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(lost, F.length(f"{OWN}kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns])
