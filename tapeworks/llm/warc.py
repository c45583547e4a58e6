"""WARC archives compressed with Zstandard, one frame a record, with a dictionary in a leading skippable frame.

Each task writes the records of its own partition, cut into archives of about ``archive_bytes`` of payload. An archive's
dictionary is trained on its own first records (``sample_bytes`` of them at most) and stands, compressed, in the skippable frame; archives
too small to train one have none. A file gets its final name by one rename once it is whole, and a task that runs again writes the same
bytes, so lost executors leave no half archives. The folder must be one that all executors share.

Defined results: a null or empty payload is an empty block; a null url is left out and control characters in one are percent-encoded; rows
without page_id are always responses; archives of other writers are read, too (WARC/1.0 and 1.1, any record type, date, id and dictionary); of equal payloads under ``min_revisit`` bytes each is a response; rows that share a page_id
and a payload are told apart by nothing, and each gives the same record."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIPPABLE = 0x184D2A5D
VERSION = b"WARC/1.1"
VERSIONS = (b"WARC/1.0", VERSION)
DATE = b"2024-01-01T00:00:00Z"
MIN_REVISIT = 100
ARCHIVE_BYTES = 16 << 20
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 16 << 10
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def mark_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload (bytes), digest (hex SHA-256), refers_to: of equal payloads of min_revisit bytes or more the least page_id's is the
    response that the others refer to. The html itself isn't shuffled by its digest, which a third of all pages may share: digests are counted,
    and the few rows of repeated ones are joined back by page_id."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    large = rows.where(F.col("page_id").isNotNull() & (F.octet_length("payload") >= min_revisit)).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("low"), F.count("*").alias("n")).where("n > 1").select("digest", "low")
    later = large.join(first, "digest").where(F.col("page_id") > F.col("low")).select(F.col("page_id").alias("later_id"), F.col("digest").alias("later_digest"), "low").distinct()
    both = rows.join(later, (rows["page_id"] == later["later_id"]) & (rows["digest"] == later["later_digest"]), "left")
    return both.select("page_id", "url", "payload", "digest", F.col("low").alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: its headers, an empty line, its block, and two line ends."""
    head = [VERSION, b"WARC-Type: " + (b"response" if refers_to is None else b"revisit")]
    head.append(b"WARC-Record-ID: <urn:page:%s>" % (b"none" if page_id is None else str(page_id).encode()))
    head.append(b"WARC-Date: " + DATE)
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url).encode("utf-8", "replace"))
    head.append(b"WARC-Payload-Digest: sha256:" + digest.encode())
    block = HTTP % len(payload)
    if refers_to is None:
        block += payload
    else:
        head.append(b"WARC-Refers-To: <urn:page:%s>" % str(refers_to).encode())
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(b"Content-Type: application/http; msgtype=response")
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """The bytes of a .warc.zst file: the dictionary's skippable frame, where there is one, and a frame for each record."""
    out, samples, size = [], [], 0
    for r in records:
        if size >= sample_bytes:
            break
        samples.append(r[: 128 << 10])  # a dictionary learns nothing from further into a record
        size += len(samples[-1])
    dictionary = None
    if len(samples) >= 16 and size >= 8 * DICTIONARY_BYTES:
        try:
            dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 8), samples, k=256, d=8)
        except zstandard.ZstdError:  # too little in common
            dictionary = None
    if dictionary is not None:
        packed = zstandard.ZstdCompressor(level=3).compress(dictionary.as_bytes())
        out.append(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
    compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True, write_checksum=True)
    out += [compressor.compress(r) for r in records]
    return b"".join(out)


class Damaged(ValueError):
    """An archive or record that isn't as its headers say."""


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of a .warc.zst file, one frame at a time."""
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        length = struct.unpack_from("<I", data, 4)[0]
        if 8 + length > len(data):
            raise Damaged("the dictionary's frame is cut off")
        raw = data[8 : 8 + length]
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + length
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        if len(data) - at >= 8 and struct.unpack_from("<I", data, at)[0] & 0xFFFFFFF0 == SKIPPABLE & 0xFFFFFFF0:  # what else is to be skipped
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        frame = reader.decompressobj()
        parts, here = [], at
        while not frame.eof:
            if here >= len(data):
                raise Damaged("a record's frame is cut off")
            try:
                parts.append(frame.decompress(view[here : here + (1 << 16)]))
            except zstandard.ZstdError as error:
                raise Damaged(str(error)) from error
            here += 1 << 16
        at = min(here, len(data)) - len(frame.unused_data)
        yield b"".join(parts)


def fields_of(head: bytes) -> dict[bytes, list[bytes]]:
    """The named fields of a record's or an HTTP message's head by lower-case name, without its first line; folded lines are joined."""
    fields: dict[bytes, list[bytes]] = {}
    last: list[bytes] = []
    for line in head.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and last:
            last[-1] += b" " + line.strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damaged(f"bad header line {line[:80]!r}")
        last = fields.setdefault(name.strip().lower(), [])
        last.append(value.strip())
    return fields


def holds(digest: str, data: bytes) -> bool | None:
    """Whether a labelled digest (hex or Base32) is that of data; None for algorithms that aren't known."""
    label, _, value = digest.partition(":")
    if label.lower().replace("-", "") not in ("sha1", "sha256", "sha512", "md5"):
        return None
    own = hashlib.new(label.lower().replace("-", ""), data).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def page_of(record_id: str | None) -> int | None:
    """The number in an id that this module wrote."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def parse(data: bytes) -> dict:
    """record_id, record_type, date, url, refers_to_id, page_id and refers_to (of ids that this module wrote), payload_bytes, payload_digest (hex SHA-256; what the
    header says for a revisit) and payload (None for revisits) of a WARC/1.0 or 1.1 record of any type. The payload is the body of an HTTP message, or the block.
    Headers, lengths and digests are validated."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or head.split(b"\r\n", 1)[0] not in VERSIONS:
        raise Damaged("not a WARC/1.0 or 1.1 record")
    fields = fields_of(head)
    repeated = [name for name, values in fields.items() if len(values) > 1 and name != b"warc-concurrent-to"]
    missing = [name for name in (b"warc-record-id", b"warc-date", b"warc-type", b"content-length") if name not in fields]
    if repeated or missing:
        raise Damaged(f"headers repeated {repeated} or missing {missing}")
    text = {name: values[0].decode("utf-8", "replace") for name, values in fields.items()}
    if not re.fullmatch(r"\d{4}-\d\d-\d\d(T\d\d:\d\d(:\d\d(\.\d{1,9})?)?Z)?|\d{4}(-\d\d)?", text[b"warc-date"]) or not re.fullmatch(r"<[^<>\s]+>", text[b"warc-record-id"]) or not text[b"content-length"].isdigit():
        raise Damaged("a date, an id or a length is malformed")
    length, kind = int(text[b"content-length"]), text[b"warc-type"]
    block = rest[:length]
    if rest[length:] != b"\r\n\r\n":
        raise Damaged("the block is not as long as Content-Length says")
    if b"warc-block-digest" in text and holds(text[b"warc-block-digest"], block) is False:
        raise Damaged("the block is not as its digest says")
    payload, said = block, None
    if text.get(b"content-type", "").startswith("application/http"):
        http, split, payload = block.partition(b"\r\n\r\n")
        own = fields_of(http) if split else {}
        if b"content-length" in own and own[b"content-length"][0].isdigit():
            said = int(own[b"content-length"][0])
    digest = text.get(b"warc-payload-digest")
    if kind == "revisit":
        if payload and said is not None and len(payload) > said:
            raise Damaged("a revisit holds more than its payload")
        shown = (digest or "").partition(":")[2] or None
    else:
        if b"warc-truncated" not in text and said is not None and said != len(payload) or digest and b"warc-truncated" not in text and holds(digest, payload) is False:
            raise Damaged("the payload is not as its headers say")
        shown = hashlib.sha256(payload).hexdigest()
    refers = text.get(b"warc-refers-to")
    return {
        "page_id": page_of(text[b"warc-record-id"]), "url": text.get(b"warc-target-uri"), "record_type": kind, "refers_to": page_of(refers), "payload_bytes": said if kind == "revisit" and said is not None else len(payload),
        "payload_digest": shown, "record_id": text[b"warc-record-id"], "refers_to_id": refers, "date": text[b"warc-date"], "payload": None if kind == "revisit" else payload,
    }


def _store(folder: str, name: str, data: bytes) -> None:
    """Writes a file under a temporary name and renames it."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    context = TaskContext.get()
    draft = f"{base}/_{name}.{context.taskAttemptId() if context else os.getpid()}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, f"{base}/{name}")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes pages (page_id, url, html) as archives to folder, a URI that all executors share. Returns name, records and bytes of each; nothing
    is written before it is read."""
    uri = folder if ":" in folder.split("/")[0] else f"file://{folder}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size, made = [], 0, 0
        names = ["name", "records", "bytes"]
        types = [pa.string(), pa.int64(), pa.int64()]

        def flush() -> pa.RecordBatch:
            nonlocal records, size, made
            name, data = f"pages-{TaskContext.get().partitionId():06d}-{made:04d}.warc.zst", archive(records)
            _store(uri, name, data)
            row = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((name, len(records), len(data)), types)], names)
            records, size, made = [], 0, made + 1
            return row

        for batch in batches:
            for values in zip(*batch.columns):
                records.append(record(*(v.as_py() for v in values)))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield flush()
        if records:
            yield flush()

    # sorted, so that a task that runs again cuts the same archives
    rows = mark_revisits(pages, min_revisit).select("page_id", "url", "payload", "digest", "refers_to").sortWithinPartitions("page_id", "digest", "url")
    return rows.mapInArrow(run, "name string, records long, bytes long")


SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("url", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_id", T.StringType()), ("refers_to_id", T.StringType()), ("date", T.StringType()), ("payload", T.BinaryType()))]
)


def read_archives(spark: SparkSession, folder: str, written: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """The records of the archives in folder, of those named in written only if it is given. A damaged archive is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    if written is not None:
        files = files.join(written.select("name"), F.element_at(F.split("path", "/"), -1) == F.col("name"), "left_semi")
    schema = SCHEMA if payloads else T.StructType(SCHEMA.fields[:-1])
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.binary()][: len(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema.names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for data in read_archive(content.as_py()):
                    found = parse(data)
                    rows.append(tuple(found[n] for n in schema.names))
                    size += len(data)
                    if size >= 8 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return files.select("content").mapInArrow(run, schema)
