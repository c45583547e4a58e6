"""Sum-of-squares online packing of token sequences (Csirik et al., 2006).

Each task packs the documents of its own partition in their order, so no data are shuffled. Tokens of a document that
fill whole windows are cut off as full sequences; the rest is placed at the fill level h that makes the sum of N(h)^2
least, N(h) being the number of windows filled up to h, kept in an array by level. At the end of a partition the windows
that are still open are cut up and filled from each other, so that at most one sequence of a partition is padded.

Defined results: a null or empty text is the closing id alone. Rows are packed as they come; repeated rows and ids and
null ids are documents like any other. Sequence ids hold the partition's number in their upper bits, and a partition that
is computed again gives the same rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm.tokens import byte_bpe

WINDOW = 1024
CLOSING_ID = 0


class Packer:
    """Open windows by fill level. A piece is (document, start, length); a window is a list of pieces."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.closed = np.full(window + 1, 1 << 40, np.int64)  # added to levels at which no window stands
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]

    def place(self, piece: tuple) -> list[tuple] | None:
        """Puts a piece shorter than a window where sum N(h)^2 grows least (of ties the lowest level). Returns a window that is full.
        Moving a window from h to h + s changes the sum by 2 (N(h + s) - N(h) + 1); a new one by 2 N(s) + 1, and one that
        gets full, and so leaves, by 1 - 2 N(h)."""
        size, window, n = piece[2], self.window, self.counts
        growth = n[size:] - n[: window + 1 - size]
        growth += self.closed[: window + 1 - size]
        growth *= 2
        growth += 2
        growth[0] = 2 * n[size] + 1
        growth[-1] -= 1
        level = int(growth.argmin())
        bin_ = self.open[level].pop() if level else []
        if level:
            self._count(level, -1)
        bin_.append(piece)
        if level + size == window:
            return bin_
        self._count(level + size, 1)
        self.open[level + size].append(bin_)
        return None

    def _count(self, level: int, change: int) -> None:
        self.counts[level] += change
        self.closed[level] = 0 if self.counts[level] else 1 << 40

    def rest(self) -> Iterator[list[tuple]]:
        """The windows that are still open, filled from each other by cutting pieces."""
        bin_, left = [], self.window
        for level in range(self.window - 1, 0, -1):
            for pieces in self.open[level]:
                for doc, start, length in pieces:
                    while length:
                        cut = min(length, left)
                        bin_.append((doc, start, cut))
                        start, length, left = start + cut, length - cut, left - cut
                        if not left:
                            yield bin_
                            bin_, left = [], self.window
        if bin_:
            yield bin_


SCHEMA = [
    ("start", pa.int64(), T.LongType()), ("length", pa.int64(), T.LongType()), ("ids_crc32", pa.int64(), T.LongType()),
    ("doc_tokens", pa.int64(), T.LongType()), ("sequence_id", pa.int64(), T.LongType()), ("offset", pa.int64(), T.LongType()),
]


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if with_ids, ids: the piece's
    token ids. docs: doc_id and text."""
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = byte_bpe(tokenizer_path), Packer(window)
        closing = np.array([CLOSING_ID], np.uint32).tobytes()
        held: dict[int, tuple] = {}  # documents with pieces in open windows: id, tokens, the first piece's start and the ids from there
        base = TaskContext.get().partitionId() << 33
        made, rows = 0, []

        def add(doc_id, start: int, part: bytes, total: int, at: int) -> None:
            ids = np.frombuffer(part, np.int32) if with_ids else None
            rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total, base + made, at, ids))

        def emit(bin_: list[tuple]) -> None:
            nonlocal made
            at = 0
            for doc, start, length in bin_:
                doc_id, total, first, data = held[doc]
                add(doc_id, start, data[4 * (start - first) : 4 * (start - first + length)], total, at)
                at += length
                if length == total - first:
                    del held[doc]
            made += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows))
            arrays = [pa.array(columns[0], pa_id)] + [pa.array(c, kind) for c, (_, kind, _) in zip(columns[1:], SCHEMA)]
            names = ["doc_id", *(n for n, _, _ in SCHEMA)]
            if with_ids:
                arrays, names = [*arrays, pa.array(columns[7], pa.list_(pa.int32()))], [*names, "ids"]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        pa_id, number = pa.int64(), 0
        for batch in batches:
            pa_id = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                key, ids = doc_id.as_py(), bpe.ids(text.as_py() or "") + closing
                total = len(ids) // 4
                full = total // window * window
                for start in range(0, full, window):
                    add(key, start, ids[4 * start : 4 * (start + window)], total, 0)
                    made += 1
                if total > full:
                    held[number] = (key, total, full, ids[4 * full :])
                    if (done := packer.place((number, full, total - full))) is not None:
                        emit(done)
                    number += 1
                if len(rows) >= 2000:
                    yield flush()
        for bin_ in packer.rest():
            emit(bin_)
            if len(rows) >= 2000:
                yield flush()
        if rows:
            yield flush()

    fields = [T.StructField("doc_id", id_type)] + [T.StructField(n, kind) for n, _, kind in SCHEMA]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType(fields))
