"""License scan (native): a positional index of the rarest words of license notices.

A template is a run of words with a label and key phrases. Its rarest words, by their share of documents in the corpus, are its postings: word, template, place in it. Each text's
words are looked up there; a word found at p that stands at t in a template proposes the template at p - t. A proposal counts if the template's key phrases stand
where the template begins or later, within its length and ``SLACK`` words; proposals of one template at one place are intersected, and their share of the postings' weight (inverse document
frequency) is the score. Base phrases are templates of one posting whose every word is a key word at its own place, so each of their places is found once.

Texts are cut into overlapping blocks of words before anything is exploded, so that what a row holds is bounded whatever the text's length. Templates are fixed, so the index is some
hundred rows and is held in the plan.

Defined results: null and empty texts have no words and no label; repeated rows have the same result each; rows that share a doc_id are told apart by text; other columns are ignored."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import text_of
from tapeworks.llm.decontam import parts_of, words_in

#: Base phrases and their labels.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: Words of public license notices, by label: a notice and the phrases that it can't do without.
TEMPLATES: dict[str, list[tuple[str, list[str]]]] = {
    "apache-2.0": [
        ("licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
        ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache org licenses license 2 0"]),
    ],
    "mit": [
        ("released under the mit license", ["mit license"]),
        ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ],
    "isc": [("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"])],
    "bsd": [("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"])],
    "gpl-2.0": [("under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ["gnu general public license", "version 2"])],
    "gpl-3.0": [
        ("licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
        ("under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license", "version 3"]),
    ],
    "lgpl": [("under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"])],
    "agpl-3.0": [("under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ["gnu affero general public license"])],
    "mpl-2.0": [("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"])],
    "cc-by-4.0": [("licensed under cc by 4 0", ["cc by 4 0"])],
    "cc-by-sa-4.0": [("licensed under cc by sa 4 0", ["cc by sa 4 0"])],
    "cc-by-nc-4.0": [("licensed under cc by nc 4 0", ["cc by nc 4 0"])],
    "unlicense": [("this is free and unencumbered software released into the public domain", ["free and unencumbered software", "public domain"])],
}
#: Postings of a template; words that may have come in between its beginning and a key phrase's end; the least share of the postings' weight.
POSTINGS, SLACK, LEAST = 4, 6, 0.6
#: Words of a block, and how far a row looks to both sides of one.
BLOCK = 1024
DOC = ["doc_id", "text_hash"]


def template_rows(base: Mapping[str, str] = BASE, templates: Mapping[str, Sequence[tuple[str, Sequence[str]]]] = TEMPLATES) -> list[tuple[int, str, bool, list[str], list[str]]]:
    """template, label, is_base, words, key phrases."""
    rows = [(label, True, phrase.split(), [phrase]) for label, phrase in base.items()]
    rows += [(label, False, notice.split(), list(keys)) for label, notices in templates.items() for notice, keys in notices]
    return [(i, *row) for i, row in enumerate(rows)]


def _words(docs: DataFrame) -> DataFrame:
    parts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), parts_of(text_of()).alias("parts"))
    return parts.select(*DOC, words_in(F.col("parts")).alias("words"))


def document_frequencies(docs: DataFrame, words: Sequence[str]) -> tuple[dict[str, int], int]:
    """In how many rows each of some known words stands, and the number of rows."""
    known = F.array(*[F.lit(w) for w in words])
    each = _words(docs).select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect("words", known))).alias("word"))
    found = {r.word: r.n for r in each.groupBy("word").agg(F.count("*").alias("n")).collect()}  # a row for each known word at most
    return {w: found.get(w, 0) for w in words}, found.get("", 0)


def _weights(words: Sequence[str], found: Mapping[str, int], n: int) -> list[float]:
    """Shares of the words' inverse document frequencies."""
    idf = [log((n + 1) / (found[w] + 1)) + 1 for w in words]
    return [x / sum(idf) for x in idf]


def index_rows(rows: list[tuple[int, str, bool, list[str], list[str]]], found: Mapping[str, int], n: int, postings: int = POSTINGS) -> list[tuple[str, int, int, int, float]]:
    """word, template, place, bit, weight: each template's rarest words. A base phrase has one; of equally rare words the first by name goes before, and of a word's places the first counts."""
    out = []
    for template, _, is_base, words, _ in rows:
        rarest = sorted(set(words), key=lambda w: (found[w], w))[: 1 if is_base else postings]
        weights = _weights(rarest, found, n)
        out += [(w, template, words.index(w), bit, weight) for bit, (w, weight) in enumerate(zip(rarest, weights))]
    return out


def hits(docs: DataFrame, index: Sequence[tuple[str, int, int, int, float]], reach: int, block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, n_words, pos, word, around: a row for each word of a text that the index has, with reach words to both sides of it (joined by spaces, with
    one before and after); and one for each text with pos -1."""
    words = _words(docs)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(block))
    inside = lambda s: F.slice(F.col("words"), F.greatest(s - reach, F.lit(0)) + 1, F.lit(block) + F.least(s, F.lit(reach)) + reach)
    blocks = words.select(*DOC, F.size("words").cast("long").alias("n_words"), F.explode(F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s, F.lit(reach)).alias("lead"), inside(s).alias("words")))).alias("b"))
    blocks = blocks.select(*DOC, "n_words", "b.*")
    known = sorted({w for w, *_ in index})
    place = F.transform("words", lambda w, i: F.when(w.isin(known) & (i >= F.col("lead")) & (i < F.col("lead") + block), i))
    mark = F.when(F.col("start") == 0, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
    around = lambda i: F.concat(F.lit(" "), F.array_join(F.slice(F.col("words"), F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + reach), " "), F.lit(" "))
    before = lambda i: F.when(i < 0, -1).otherwise(F.least(i, F.lit(reach)))
    found = F.transform(F.concat(mark, F.array_compact(place)), lambda i: F.struct(F.when(i < 0, -1).otherwise(F.col("start") - F.col("lead") + i).alias("pos"), before(i).alias("lead"), F.when(i >= 0, F.get(F.col("words"), i)).alias("word"), F.when(i >= 0, around(i)).alias("around")))
    # not a plain explode: that is filtered by the array's size first, which computes it twice
    rows = blocks.select(*DOC, "n_words", F.explode_outer(found).alias("x")).where("x IS NOT NULL")
    return rows.select(*DOC, "n_words", "x.*")


def scan(docs: DataFrame, base: Mapping[str, str] = BASE, templates: Mapping[str, Sequence[tuple[str, Sequence[str]]]] = TEMPLATES, slack: int = SLACK, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays without order), score for each row of docs. The score is the best share of a labelled notice's weight
    that was found; a base phrase's is 1."""
    spark = docs.sparkSession
    rows = template_rows(base, templates)
    found, n = document_frequencies(docs, sorted({w for _, _, _, words, _ in rows for w in words}))
    index = index_rows(rows, found, n)
    reach = max(len(words) for _, _, _, words, _ in rows) + slack
    postings = spark.createDataFrame(index, "word string, template int, place int, bit int, weight double")  # as many as the fixed templates have
    met = hits(docs, index, reach, block).join(F.broadcast(postings), "word", "left")

    ahead = lambda extra: F.concat(F.lit(" "), F.array_join(F.slice(F.split(F.btrim("around"), " "), F.greatest(F.col("lead") - F.col("place"), F.lit(0)) + 1, extra), " "), F.lit(" "))
    verified = F.lit(False)
    for template, _, is_base, words, keys in rows:
        window = ahead(F.lit(len(words) + (0 if is_base else slack)))
        whole = F.lit(True)
        for key in keys:
            whole = whole & F.contains(window, F.lit(f" {key} "))
        verified = F.when(F.col("template") == template, whole & (F.col("lead") >= F.col("place"))).otherwise(verified)
    proposed = met.where((F.col("pos") < 0) | verified).select(*DOC, "n_words", "template", (F.col("pos") - F.coalesce("place", F.lit(0))).alias("at"), F.expr("shiftleft(1L, bit)").alias("bit"))
    # repeated rows propose the same; the marks are counted, so that each row has its result
    intersected = proposed.groupBy(*DOC, "template", "at").agg(F.max("n_words").alias("n_words"), F.bit_or("bit").alias("bits"), F.count("*").alias("copies"))
    weights = {t: {} for t, *_ in rows}
    for _, template, _, bit, weight in index:
        weights[template][bit] = weight
    share, label, is_own_base = F.lit(0.0), F.lit(None).cast("string"), F.lit(False)
    for template, name, is_base, *_ in rows:
        own = sum((F.when(F.getbit("bits", F.lit(bit)) == 1, weight).otherwise(0.0) for bit, weight in sorted(weights[template].items())), F.lit(0.0))
        here = F.col("template") == template
        share, label = F.when(here, F.lit(1.0) if is_base else own).otherwise(share), F.when(here, name).otherwise(label)
        if is_base:
            is_own_base = is_own_base | here
    judged = intersected.select(*DOC, "n_words", "at", "copies", "template", share.alias("share"), label.alias("label"), F.coalesce(is_own_base, F.lit(False)).alias("is_base"))
    kept = judged.where(F.col("template").isNull() | (F.col("share") >= least))
    by_doc = kept.groupBy(*DOC).agg(
        F.max("n_words").alias("n_words"), F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"), F.count(F.when(F.col("is_base"), 1)).alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("at"))).cast("long").alias("first_word"), F.max(F.when(F.col("is_base"), F.col("at"))).cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("is_base"), F.col("label"))).alias("base_labels"), F.collect_set("label").alias("labels"), F.max(F.when(F.col("template").isNotNull(), F.col("share"))).alias("score"),
    )
    each = by_doc.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0)).alias("score"))

