"""Benchmark decontamination (native): a positional inverted index of the training tokens.

The texts are split into words once. A posting is a document, a term and a position; those of the benchmark's terms are stored, together with an
end mark, whose position is the document's number of words. All else reads the index: how often each term occurs; the places of
each window's rarest term, shifted by its place in the window; of these the ones where the second rarest term's list has the position that the
window asks for; and of these the ones where the other terms' lists have theirs, too, which is an exact match. A posting with fewer benchmark words
around it than the shortest window has can't be part of a match (``dense`` is false) and isn't joined. Proximity matches are places of an item's rarest
term with the item's next rarest terms within ``span`` words, in any order.

Before words are joined with the vocabulary they are looked up in a bit table of fixed size (``SLOTS``); what it lets through by chance goes in the join.
Vocabularies and windows are broadcast where they hold at most ``BROADCAST_BYTES``; above it they are joined by a shuffle with a salt,
so that no common term is one task's. Postings are shuffled without their document's words.

Defined results: null and empty texts have no words; an item without words has no window and matches nothing; items without item_id match but aren't
listed; rows that share a doc_id, or have none, are told apart by text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import OWN, ascii_lower, cut, fresh_dir, keep_rows, row_key, text_of

#: What stands between the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 64 << 20
#: Copies of a table that is joined by a shuffle, over which a common key's rows are dealt.
SALTS = 32
#: Bits of the table that words are looked up in first, in 64-bit words.
SLOTS = 1 << 20
END = -1
DOC = ["doc_id", "text_hash"]


def parts_of(text: Column) -> Column:
    """The words of a text in lower case, with an empty one before and after where it begins or ends otherwise. Splitting at what is between words
    costs a sixth of matching the words."""
    return F.split(ascii_lower(text), SEPARATORS, -1)


def words_in(parts: Column) -> Column:
    """The words among parts, which should be a column: the array is used several times."""
    before, after = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0), F.when(F.get(parts, F.size(parts) - 1) == "", 1).otherwise(0)
    return F.slice(parts, before + 1, F.greatest(F.size(parts) - before - after, F.lit(0)))


def is_bounded(df: DataFrame) -> bool:
    """Whether df's values take at most BROADCAST_BYTES. Computes df."""
    wide = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    size = F.lit(32 + 16 * len(df.columns)).cast("long")
    for w in wide:
        size = size + w
    return (df.select(size.alias("size")).agg(F.sum("size")).first()[0] or 0) <= BROADCAST_BYTES


def looked_up(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """rows joined with small, by broadcast where small is bounded; else each key's rows are dealt over copies of small."""
    if is_bounded(small):
        return rows.join(F.broadcast(small), key)
    salt = f"{OWN}salt"
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, salt]).drop(salt)


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def _slots(vocabulary: DataFrame) -> DataFrame:
    """One row: an array of SLOTS booleans, true at the slots of the vocabulary's words. It is put together from 64-bit words."""
    at = F.col("slot")
    bits = vocabulary.select(_slot(F.col("word")).alias("slot")).groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits"))
    every = vocabulary.sparkSession.range(SLOTS // 64).select(F.col("id").cast("int").alias("at"))
    dense = every.join(bits, "at", "left").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("x"))
    spread = F.flatten(F.transform("x.bits", lambda w: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit(w, k) == 1)))
    return dense.select(spread.alias("slots"))


class Benchmark:
    """The benchmark's windows and vocabulary. items: item_id (string), words; phrases: phrase_id, size, words; phrase_items: phrase_id, item_id;
    vocabulary: word, term. ``least`` is the shortest window's number of words."""

    def __init__(self, benchmark: DataFrame, size: int = 10):
        parts = benchmark.select(F.col("item_id").cast("string").alias("item_id"), parts_of(text_of()).alias("parts"))
        self.items = cut(parts.select("item_id", words_in(F.col("parts")).alias("words")).where(F.size("words") > 0))
        starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
        each = self.items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("words"), i, F.lit(size)))).alias("phrase"))
        self.phrases = cut(each.groupBy("phrase").agg(F.collect_set("item_id").alias("items")).select(F.monotonically_increasing_id().alias("phrase_id"), F.size("phrase").alias("size"), "phrase", "items"))
        self.phrase_items = self.phrases.select("phrase_id", F.explode("items").alias("item_id"))
        words = self.items.select(F.explode("words").alias("word")).distinct()
        self.vocabulary = cut(words.select("word", F.monotonically_increasing_id().alias("term")))
        self.least = self.phrases.agg(F.min("size")).first()[0] or size


def build_index(docs: DataFrame, bench: Benchmark) -> DataFrame:
    """doc_id, text_hash, term, pos, dense: the postings of the benchmark's terms and of the end mark, stored in the shared folder."""
    spark, least = docs.sparkSession, bench.least
    parts = row_key(docs).select(*DOC, parts_of(text_of()).alias("parts"))
    marked = F.concat(words_in(F.col("parts")), F.array(F.lit("")))
    rows = parts.select(*DOC, marked.alias("words"), _slots(bench.vocabulary).scalar().alias("slots"))
    known = F.transform("words", lambda w: F.when(F.get(F.col("slots"), _slot(w)), "1").otherwise("0"))
    flags = F.concat(F.lit("0" * least), F.array_join(known, ""), F.lit("0" * least)).cast("binary")
    flagged = rows.select(*DOC, "words", flags.alias("flags"))
    # the arrays are never empty; a plain posexplode would be filtered by their size first, which splits each text twice
    each = flagged.select(*DOC, "flags", F.posexplode_outer("words").alias("pos", "word"))
    own = F.substring(F.col("flags"), F.col("pos") + least + 1, F.lit(1)) == F.lit("1").cast("binary")
    around = F.substring(F.col("flags"), F.col("pos") + 2, F.lit(2 * least - 1))
    kept = each.where(own | (F.col("word") == "")).select(*DOC, "pos", "word", F.contains(around, F.lit("1" * least).cast("binary")).alias("dense"))
    terms = bench.vocabulary.unionByName(spark.createDataFrame([("", END)], "word string, term long"))
    folder = fresh_dir(spark, "index")
    looked_up(kept, terms, "word").select(*DOC, "term", "pos", "dense").write.parquet(folder)
    return spark.read.parquet(folder)


def term_counts(index: DataFrame) -> DataFrame:
    """term, n: how often each term occurs, over all documents; terms that never occur have no row."""
    return index.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("n"))


def phrase_matches(index: DataFrame, bench: Benchmark, counts: DataFrame) -> DataFrame:
    """doc_id, text_hash, phrase_id, start, size: every place where a window occurs exactly. Windows with a term that occurs nowhere are left out."""
    placed = bench.phrases.select("phrase_id", "size", F.posexplode("phrase").alias("place", "word")).join(bench.vocabulary, "word").join(counts, "term", "left")
    by_rarity = F.array_sort(F.collect_list(F.struct("n", "place", "term")))  # a window has size terms at most
    ranked = placed.groupBy("phrase_id", "size").agg(by_rarity.alias("terms"), F.count("n").alias("known")).where(F.col("known") == F.col("size"))
    terms = cut(ranked.select("phrase_id", "size", F.posexplode("terms").alias("rank", "x")).select("phrase_id", "size", "rank", "x.place", "x.term"))
    dense = index.where(F.col("dense") & (F.col("term") != END))
    first = looked_up(dense, terms.where("rank = 0").drop("rank"), "term")
    found = first.select(*DOC, "phrase_id", "size", (F.col("pos") - F.col("place")).alias("start")).where("start >= 0").distinct()
    lists = dense.select(*DOC, "pos", "term").distinct().withColumnsRenamed({c: f"{OWN}{c}" for c in DOC})
    same = [F.col(c).eqNullSafe(F.col(f"{OWN}{c}")) for c in DOC]

    def intersected(found: DataFrame, low: int, high: int | None) -> DataFrame:
        """Those of found where the lists of the terms ranked low to high (exclusive) have the positions asked for."""
        ranks = terms.where((F.col("rank") >= low) & (F.lit(True) if high is None else F.col("rank") < high)).select("phrase_id", "place", F.col("term").alias("asked"))
        asked = looked_up(found, ranks, "phrase_id").withColumn("at", F.col("start") + F.col("place"))
        met = asked.join(lists, [*same, F.col("at") == F.col("pos"), F.col("asked") == F.col("term")])
        n = F.col("size") - low if high is None else F.least(F.col("size"), F.lit(high)) - low
        whole = met.groupBy(*DOC, "phrase_id", "size", "start").agg(F.count("*").alias("n")).where(F.col("n") == n).drop("n")
        return whole.unionByName(found.where(F.col("size") <= low))

    return intersected(cut(intersected(cut(found), 1, 2)), 2, None)


def proximity_matches(index: DataFrame, bench: Benchmark, counts: DataFrame, n_terms: int = 3, span: int = 20) -> DataFrame:
    """doc_id, text_hash, item_id, pos: places of an item's rarest term that have its next n_terms - 1 rarest terms, in any order,
    within span words. Items of fewer different terms, or with one that occurs nowhere among them, match nothing."""
    placed = bench.items.where(F.col("item_id").isNotNull()).select("item_id", F.explode("words").alias("word")).distinct().join(bench.vocabulary, "word").join(counts, "term", "left")
    rarest = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "term"))), 1, n_terms)  # an item's words at most
    usable = placed.groupBy("item_id").agg(rarest.alias("rare")).where((F.size("rare") == n_terms) & (F.col("rare")[0]["n"] > 0))
    terms = cut(usable.select("item_id", F.posexplode("rare").alias("rank", "x")).select("item_id", "rank", "x.term"))
    lists = looked_up(index.where(F.col("term") != END), terms, "term").select(*DOC, "item_id", "rank", "pos").distinct()
    near = F.lit(True)
    for rank in range(1, n_terms):
        near = near & F.expr(f"max(rank = {rank}) OVER (PARTITION BY doc_id, text_hash, item_id ORDER BY pos RANGE BETWEEN {span} PRECEDING AND {span} FOLLOWING)")
    return lists.withColumn("near", near).where("rank = 0 AND near").select(*DOC, "item_id", "pos")


def summary(matches: DataFrame, bench: Benchmark, near: DataFrame | None = None) -> DataFrame:
    """doc_id, text_hash, n_hit, items (sorted strings) and n_near (items that match by proximity) of the documents with any match."""
    none = [F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("item"), F.lit(None).cast("string").alias("near")]
    hits = matches.select(*DOC, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos")).distinct().select(*DOC, "pos", *none[1:])
    named = looked_up(matches.select(*DOC, "phrase_id").distinct(), bench.phrase_items, "phrase_id").select(*DOC, "item_id").distinct()
    rows = hits.unionByName(named.select(*DOC, none[0], F.col("item_id").alias("item"), none[2]))
    if near is not None:
        rows = rows.unionByName(near.select(*DOC, "item_id").distinct().select(*DOC, none[0], none[1], F.col("item_id").alias("near")))
    # an item is listed once, so that a list is no longer than the benchmark
    return rows.groupBy(*DOC).agg(F.count("pos").alias("n_hit"), F.array_sort(F.collect_list("item")).alias("items"), F.count("near").alias("n_near"))


def overlap_report(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, items, n_near for each row of docs."""
    bench = Benchmark(benchmark, size)
    index = build_index(docs, bench)
    counts = cut(term_counts(index))
    matches = cut(phrase_matches(index, bench, counts))
    found = summary(matches, bench, proximity_matches(index, bench, counts)).withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    ends = index.where(F.col("term") == END)
    both = ends.join(found, ends["doc_id"].eqNullSafe(found["found_id"]) & (ends["text_hash"] == found["found_hash"]), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select("doc_id", F.col("pos").cast("long").alias("n_words"), zero("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), zero("n_near"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs."""
    bench = Benchmark(benchmark, size)
    index = build_index(docs, bench)
    found = phrase_matches(index, bench, cut(term_counts(index))).select(*DOC).distinct()
    return keep_rows(docs, found.withColumn(f"{OWN}hit", F.lit(True)), F.col(f"{OWN}hit").isNull())
