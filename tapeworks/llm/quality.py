"""Quality rules by tokeniser fertility, next to plain word and line rules.

Two public vocabularies read each text's words: a byte-level BPE gives characters per token and the entropy of the token
distribution, a piece model with byte fallback the share of its tokens that are single bytes. Texts whose measures lie far
outside those of their group are rejected: the group is the language where it is known, else the script. The language's quartiles are drawn towards those of
the script that most of its documents have, as if ``shrink`` documents more had those; a script has its own median, and the distances of its quartiles are drawn
towards those of all documents. So no group is too small to be judged, and a rare script isn't measured by a common one. A band is the median, less ``width[0]`` times the lower quartile's distance from it, to ``width[1]`` times the upper
one's above it, and never narrower than ``floors``. Bands are computed over all documents that have words.
The measures of a short text scatter more: the distances of a text of n words are those of its group times the square root of (1 + ``settling`` / n) over
(1 + ``settling`` / m), where m is the group's median of words, so that texts of all lengths are judged.

Defined results: null and empty texts have no words and fail the base rules; rows are judged one by one, so that repeated
rows and ids get equal results."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm.common import cut
from tapeworks.llm.decontam import SALTS, is_bounded
from tapeworks.llm.tokens import MEMO_BYTES, STRETCH, Memo, byte_bpe

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
#: Quartile distances below and above the median that a measure may lie away, and the least such distances.
WIDTH = (6.0, 12.0)
FLOORS = {"chars_per_token": 0.1, "byte_share": 0.1, "entropy": 0.3}
SHRINK = 5
#: Words at which a text's measures scatter as much by its shortness as between long texts.
SETTLING = 50
#: What a piece that begins a word starts with, and how many words are read at once.
SPACE = "\u2581"
RUN_WORDS = 500
#: First code point of some scripts' blocks.
SCRIPTS = ((0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"))


class Pieces:
    """For each word how many of its pieces are single bytes, and how many there are."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)], bool)
        self.starts = np.array([self.model.id_to_piece(i)[:1] == SPACE for i in range(size)], bool)
        self.memo = Memo(MEMO_BYTES // 2)

    def _learn(self, words: list[str]) -> dict[str, complex]:
        """Words are read in runs, as no piece reaches into the next word; a run whose words can't be told apart is read word by word."""
        found: dict[str, complex] = {}
        for at in range(0, len(words), RUN_WORDS):
            run = words[at : at + RUN_WORDS]
            ids = np.array(self.model.encode(" ".join(run)), np.int64)
            firsts = np.flatnonzero(self.starts[ids])
            if len(firsts) == len(run) and firsts[0] == 0 and SPACE not in "".join(run):
                n = np.diff(np.append(firsts, len(ids)))
                found |= self.memo.add(run, (n + 1j * np.add.reduceat(self.is_byte[ids].astype(np.int64), firsts)).tolist())
            else:
                found |= self.memo.add(run, [complex(len(own), int(self.is_byte[own].sum()) if own else 0) for own in self.model.encode(run, num_threads=1)])
        return found

    def counts(self, words: list[str]) -> complex:
        """Pieces (real part) and byte pieces (imaginary part) of words, each read alone."""
        return sum((self._counts(words[at : at + STRETCH]) for at in range(0, len(words), STRETCH)), 0j)

    def _counts(self, words: list[str]) -> complex:
        known = self.memo.known
        try:
            return sum([known[w] for w in words])
        except KeyError:
            new = self._learn([*set(words).difference(known)])
            return sum([known[w] if w in known else new[w] for w in words])


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def script(text: str) -> str:
    """The script of most of the text's letters, by code point blocks."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    starts = np.array([s for s, _ in SCRIPTS])
    blocks = np.bincount(np.searchsorted(starts, points[points >= 0x41], "right") - 1, minlength=len(starts))
    totals: dict[str, int] = {}
    for (_, name), n in zip(SCRIPTS, blocks.tolist()):
        totals[name] = totals.get(name, 0) + n
    return max(totals, key=totals.get)


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of size words which occurs twice or more."""
    n = len(words)
    if n <= size:
        return 0
    if size == 5 and len(set(zip(words, words[1:], words[2:], words[3:], words[4:]))) == n - 4:
        return 0  # as in most texts
    number: dict[bytes, int] = {}
    rank = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    code, length = rank, 1
    while length < size:  # windows are numbered anew after each word, so that no code overflows
        code = code[: n - length] * len(number) + rank[length:]
        length += 1
        if length < size:
            code = np.unique(code, return_inverse=True)[1]
    _, at, counts = np.unique(code, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[at] > 1)
    if not len(twice):
        return 0
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + size, -1)
    return int((np.cumsum(change[:n]) > 0).sum())


_VISIBLE = re.compile(rb"[^ \t-\r]")


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if _VISIBLE.search(line)]
    return len(lines) - len(set(lines))


def rules(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return 0, 0, len(data.translate(None, _NOT_SYMBOLS)), 0, 0
    chars = len(text) - sum(data.count(b) for b in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    return len(words), chars, len(data.translate(None, _NOT_SYMBOLS)), duplicate_lines(data), repeated_words(words)


MEASURES = ("chars_per_token", "byte_share", "entropy")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame, bpe_path: str, piece_path: str) -> DataFrame:
    """doc_id, lang, script, the five counts and the three measures (null without words) for each row of docs.
    The entropy is that of the text's tokens in bits, over the logarithm of their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        bpe, model = byte_bpe(bpe_path), pieces(piece_path)
        for batch in batches:
            scripts, rows = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                counts = rules(text)
                if counts[0]:
                    ids = np.frombuffer(bpe.ids(text), np.uint32)
                    shares = np.bincount(ids)
                    shares = shares[shares > 0] / len(ids)
                    entropy = float(-(shares * np.log2(shares)).sum()) / max(1.0, float(np.log2(len(ids))))
                    total = model.counts(text.split())
                    rows.append((*counts, len(text) / len(ids), total.imag / max(1.0, total.real), entropy))
                else:
                    rows.append((*counts, None, None, None))
                scripts.append(script(text))
            columns = list(zip(*rows)) or [()] * 8
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.float64()) for c in columns[5:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scripts, pa.string()), *arrays], ["doc_id", "lang", "script", *COUNTS, *MEASURES])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), lang.alias("lang"))
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang", T.StringType()), T.StructField("script", T.StringType())]
    fields += [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in MEASURES]
    return rows.mapInArrow(run, T.StructType(fields))


def bands(measured: DataFrame, width: tuple[float, float] = WIDTH, shrink: int = SHRINK, settling: float = SETTLING) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three frames of limits (an array of middle, below and above for each measure: the median, and how far a text of very many words may lie from it, floors aside): by lang, by script, and one row for
    all documents."""
    judged, drawn = measured.where(F.col("n_words") > 0), [*MEASURES, "n_words"]
    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 10_000).alias(m) for m in drawn]
    every = judged.agg(F.count("*").alias("n"), *quartiles).where("n > 0")
    above = lambda rows, by: F.broadcast(rows.select(*by, *[F.col(m).alias(f"up_{m}") for m in drawn]))
    mean = lambda x, y: (x * F.col("n") + y * shrink) / (F.col("n") + shrink)
    spread = lambda m: F.transform(f"up_{m}", lambda y: y - F.col(f"up_{m}")[1] + F.col(m)[1])
    plain = judged.groupBy("script").agg(F.count("*").alias("n"), *quartiles).join(above(every, []), F.lit(True))
    by_script = cut(plain.select("script", "n", *[F.zip_with(m, spread(m), mean).alias(m) for m in drawn]))  # a row for each script
    known = judged.where(F.col("lang").isNotNull())
    main = known.groupBy("lang", "script").agg(F.count("*").alias("k")).groupBy("lang").agg(F.max_by("script", F.struct("k", "script")).alias("script"))
    named = known.groupBy("lang").agg(F.count("*").alias("n"), *quartiles).join(main, "lang").join(above(by_script, ["script"]), "script")
    by_lang = named.select("lang", *[F.zip_with(m, f"up_{m}", mean).alias(m) for m in drawn])

    def limits(rows: DataFrame, by: list[str]) -> DataFrame:
        q = {m: F.col(m) for m in MEASURES}
        long = F.sqrt(1 + settling / F.col("n_words")[1])
        below = {m: (q[m][1] - q[m][0]) * width[0] / long for m in MEASURES}
        above = {m: (q[m][2] - q[m][1]) * width[1] / long for m in MEASURES}
        return rows.select(*by, F.array(*[F.struct(q[m][1].alias("middle"), below[m].alias("below"), above[m].alias("above")) for m in MEASURES]).alias("limits"))

    return limits(by_lang, ["lang"]), limits(by_script, ["script"]), limits(every, [])


def verdicts(docs: DataFrame, bpe_path: str, piece_path: str, settling: float = SETTLING, floors: dict[str, float] = FLOORS, **options) -> DataFrame:
    """measures() with base_failed and kept for each row of docs."""
    measured = cut(measures(docs, bpe_path, piece_path))
    by_lang, by_script, every = (cut(x) for x in bands(measured, settling=settling, **options))
    own = by_lang.select(F.col("lang").alias("_lang"), F.col("limits").alias("_own"))
    if is_bounded(own.select("_lang")):
        named = measured.join(F.broadcast(own), F.col("lang") == F.col("_lang"), "left")
    else:  # a language's rows are dealt over copies of its limits
        dealt = measured.withColumn("_salt", F.pmod(F.xxhash64(*measured.columns), F.lit(SALTS)))
        copies = own.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        named = dealt.join(copies, (F.col("lang") == F.col("_lang")) & (F.col("_salt") == F.col("_copy")), "left")
    named = named.join(F.broadcast(by_script.withColumnRenamed("limits", "_of_script")), "script", "left")
    filled = named.join(F.broadcast(every.withColumnRenamed("limits", "_of_all")), F.lit(True), "left").withColumn("_limits", F.coalesce("_own", "_of_script", "_of_all"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    wider = F.sqrt(1 + settling / F.greatest(F.col("n_words"), F.lit(1)))
    inside = F.lit(True)
    for i, m in enumerate(MEASURES):
        limit, least = F.col("_limits")[i], F.lit(floors[m])
        low, high = limit["middle"] - F.greatest(limit["below"] * wider, least), limit["middle"] + F.greatest(limit["above"] * wider, least)
        inside &= F.coalesce(F.col(m).between(low, high), F.lit(True))
    return filled.select(*measured.columns, failed.alias("base_failed"), (~failed & inside).alias("kept"))
