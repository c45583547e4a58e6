"""Sharding, substring and near-duplicates, archives, packing and the pipeline: round trips, brute force and edge cases."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tapeworks.llm import packing, sharding, similar, simhash, substring, warc
from tapeworks.llm.components import components
from tapeworks.llm.queries import tokenizer_path
from tapeworks.shipping import ship

PATH = tokenizer_path("byte_bpe_50k.json")


def test_golay_keys_meet_within_two_bits():
    rng = random.Random(1)
    a = np.array([rng.getrandbits(64) for _ in range(500)], np.uint64)
    b = a.copy()
    for i in range(500):
        for bit in rng.sample(range(64), rng.choice([0, 1, 2])):
            b[i] ^= np.uint64(1 << bit)
    assert all(len(np.intersect1d(x, y)) for x, y in zip(simhash.golay_keys(a.view(np.int64)), simhash.golay_keys(b.view(np.int64))))


def brute_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("bucket", [64, 1])
def test_near_duplicates_match_brute_force(spark, bucket):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(20 + i, texts[i % 4].upper() if i % 2 else texts[i % 4]) for i in range(8)]
    for i in range(20):  # a word changed in a long text moves few bits
        w = texts[i % 3].split()
        w[rng.randrange(len(w))] = "other"
        rows.append((40 + i, " ".join(w)))
    rows += [(90, None), (91, ""), (92, " \n"), (93, "one"), (94, "One"), (None, texts[0]), (1, texts[1])]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, component_id int")
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs, bucket=bucket).collect()]
    fps = {(i, brute_fingerprint(t)) for i, t in rows}
    known = [(i, f) for i, f in fps if i is not None]
    root = {i: i for i, _ in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in known:
        for j, g in known:
            if (f ^ g).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(got, key=str) == sorted([(i, brute_fingerprint(t), None if i is None else find(i)) for i, t in rows], key=str)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {find(i) for i, _ in known} | {None}
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_shared_keys_are_dealt_out_once(spark):
    fps = spark.range(200).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(fps)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # the pairs' two sides, and the stars: none deals the keys out again


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 202), (None, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {200: 200, 201: 200, 202: 200}


def brute_gear(data):
    return [sum(int(substring._GEAR[data[i - j]]) << j for j in range(min(32, i + 1))) & 0xFFFFFFFF for i in range(len(data))]


def test_gear_and_bounds():
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(500))
    assert substring.gear(np.frombuffer(data, np.uint8)).tolist() == brute_gear(data)
    text = ("naïve café 😀 " * 400).encode()
    ends = substring.bounds(text)
    assert ends[-1] == len(text) and all(0 < b - a <= 256 for a, b in zip([0, *ends], ends))
    "".join(text[a:b].decode() for a, b in zip([0, *ends], ends))  # no character is cut
    assert substring.bounds(b"") == [] and substring.bounds(b"short") == [5]


def test_repeated_passages_are_found(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(120))
    rows = [(i, " ".join(word() for _ in range(80)) + " " + (passage if i % 4 == 0 else "") + " ".join(word() for _ in range(80))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "tiny"), (53, "tiny"), (None, passage), (60, rows[1][1]), (60, "other text with the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r.runs for r in substring.repeated_runs(docs).collect()}
    assert len(got) == len(rows)
    flagged = {i for (i, _), runs in got.items() if runs}
    assert flagged == {i for i in range(4, 40, 4)} | {60}
    assert all(0 in runs[0].keepers for (i, _), runs in got.items() if runs and i != 60)
    cut = {r.doc_id: r.text for r in substring.drop_repeats(docs).collect() if r.doc_id != 60}
    assert cut[0] == rows[0][1] and all(len(cut[i]) < len(rows[i][1]) - 300 for i in range(4, 40, 4)) and cut[50] is None and cut[1] == rows[1][1]
    assert substring.repeated_runs(docs.where("false")).count() == 0


def brute_bounds(data, least=32, most=256, bits=5):
    """Where chunks end, byte by byte."""
    ends, last = [], 0
    inside = lambda at: at < len(data) and data[at] & 0xC0 == 0x80
    for at, h in enumerate(brute_gear(data), 1):
        mark = (h >> (32 - bits) == 0 and at < len(data) and not inside(at)) or at == len(data)
        while mark and at - last > most:  # too long a chunk is cut at its greatest length, or at the character before it
            end = last + most
            while inside(end):
                end -= 1
            ends.append(end)
            last = end
        if mark and (at - last >= least or at == len(data)):
            ends.append(at)
            last = at
    return ends


def brute_runs(rows, min_run=64):
    """(doc_id, text, runs) by looking every chunk up in all others."""
    cuts = {}
    for i, text in rows:
        data, last = (text or "").encode(), 0
        for end in brute_bounds(data) if i is not None else ():
            cuts.setdefault(data[last:end], []).append((i, text or "", last))
            last = end
    out = []
    for i, text in rows:
        data, last, found = (text or "").encode(), 0, []
        for end in brute_bounds(data) if i is not None else ():
            places = cuts[data[last:end]]
            least = min(places, key=lambda p: (p[0], HASHES[p[1]], p[2]))
            if least != (i, text or "", last):
                if found and found[-1][0] + found[-1][1] == last:
                    found[-1] = (found[-1][0], found[-1][1] + end - last, found[-1][2] | {least[0]})
                else:
                    found.append((last, end - last, {least[0]}))
            last = end
        out.append((i, text, tuple((a, n, tuple(sorted(k))) for a, n, k in found if n >= min_run)))
    return out


HASHES = {}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_repeats_match_brute_force(spark, kind):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopé", k=rng.randint(2, 9)))
    shared = [" ".join(word() for _ in range(k)) for k in (15, 40, 90)]
    rows = [(i, " ".join([*(word() for _ in range(rng.randint(0, 30))), rng.choice(shared), *(word() for _ in range(rng.randint(0, 30))), rng.choice(shared)])) for i in range(14)]
    rows += [(20, rows[3][1]), (20, "another text " + shared[2]), (21, rows[3][1]), (21, rows[3][1]), (22, None), (23, ""), (None, shared[2]), (24, "tiny"), (25, "x" * 3000), (26, "x" * 3000)]
    rows = [(None if i is None else str(i) if kind == "string" else i, t) for i, t in rows]
    docs = spark.createDataFrame([(i, t, 5, "clash") for i, t in rows], f"doc_id {kind}, text string, at int, runs string").repartition(3)
    HASHES.update({r.t: r.h for r in docs.where("text is not null").select(F.col("text").alias("t"), F.xxhash64("text").alias("h")).collect()})
    want = brute_runs(rows)
    got = [(r.doc_id, r.text_hash, tuple((x.at, x.size, tuple(x.keepers)) for x in r.runs)) for r in substring.repeated_runs(docs).collect()]
    nulls = {r.h for r in docs.where("text is null").select(F.xxhash64("text").alias("h")).collect()}
    key = lambda x: (str(x[0]), x[1], x[2])
    assert sorted(got, key=key) == sorted([(i, HASHES[t] if t is not None else min(nulls), runs) for i, t, runs in want], key=key) and sum(len(x[2]) for x in got) > 10
    cut = substring.drop_repeats(docs)
    assert cut.columns == docs.columns
    plain = []
    for i, t, runs in want:
        data, out, at = (t or "").encode(), b"", 0
        for a, n, _ in runs:
            out, at = out + data[at:a], a + n
        plain.append((i, None if t is None else (out + data[at:]).decode()))
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=str) == sorted(plain, key=str)


def test_hot_joins_match_plain_ones(spark, monkeypatch):
    from tapeworks.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 2)
    rows = spark.range(3000).select((F.col("id") % 50).alias("k"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("j"), F.lit("x").alias("rest"), "id")
    small = rows.groupBy("k", "j").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("k % 4 != 1")
    got, want = common.join_hot(rows, small, ["k", "j"]), rows.join(small, ["k", "j"])
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count() > 1000


def test_archives_round_trip(spark, tmp_path):
    big = "<html>" + "x" * 3_000_000 + "é"
    rows = [(i, f"http://a.example/{i}\r\nx", f"<p>page {i % 7} " + "text " * 40) for i in range(300)]
    rows += [(900, None, None), (901, "u", ""), (902, "u", "short"), (903, "u", "short"), (904, "é", big), (905, "é", big), (None, "u", big), (1000, "u", "a\r\n\r\nb" * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "warc")
    made = warc.write_archives(pages, folder, archive_bytes=1 << 20).collect()
    assert sum(r.records for r in made) == len(rows)
    got = {r.page_id: r for r in warc.read_archives(spark, folder).collect()}
    first = {}
    for i, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (html or "").encode()
        revisit = len(data) >= 100 and data in first
        r = got[i]
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(data), "revisit" if revisit else "response", first.get(data) if revisit else None)
        assert revisit or bytes(r.payload) == data
        first.setdefault(data, i)
    assert got[None].record_type == "response"
    assert warc.write_archives(pages.where("false"), str(tmp_path / "none")).count() == 0


def test_damaged_archives_are_refused():
    record = warc.record(1, "u", b"payload" * 30, __import__("hashlib").sha256(b"payload" * 30).hexdigest(), None)
    data = warc.archive([record] * 40)
    assert list(warc.read_archive(data)) == [record] * 40
    with pytest.raises(warc.Damaged):
        list(warc.read_archive(data[:-5]))
    for bad in (record.replace(b"payloadpay", b"payloadPay", 1), record[:-1], record.replace(b"WARC/1.1", b"WARC/9"), record.replace(b"Content-Length: 2", b"Content-Length: 9", 1)):
        with pytest.raises(warc.Damaged):
            warc.parse(bad)


def foreign(version, headers, block):
    return version + b"\r\n" + b"".join(b"%s: %s\r\n" % h for h in headers) + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    import base64
    import hashlib
    import struct

    import zstandard

    body = b"<html>caf\xc3\xa9</html>"
    base = [(b"WARC-Date", b"2019-07-01T12:34:56Z")]
    sha1 = b"sha1:" + base64.b32encode(hashlib.sha1(body).digest())
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n folded\r\ncontent-length: %d\r\n\r\n" % len(body)
    records = [
        foreign(b"WARC/1.0", [(b"WARC-Type", b"warcinfo"), (b"WARC-Record-ID", b"<urn:uuid:1>"), *base, (b"Content-Type", b"application/warc-fields")], b"software: other\r\n"),
        foreign(b"WARC/1.0", [(b"WARC-Type", b"response"), (b"WARC-Record-ID", b"<urn:uuid:2>"), *base, (b"WARC-Target-URI", b"http://a/"), (b"Content-Type", b"application/http; msgtype=response"), (b"WARC-Payload-Digest", sha1), (b"WARC-Concurrent-To", b"<urn:uuid:3>"), (b"WARC-Concurrent-To", b"<urn:uuid:4>")], http + body),
        foreign(b"WARC/1.1", [(b"WARC-Type", b"request"), (b"WARC-Record-ID", b"<urn:uuid:3>"), (b"WARC-Date", b"2019-07-01T12:34:56.123456Z"), (b"Content-Type", b"application/http; msgtype=request")], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        foreign(b"WARC/1.1", [(b"WARC-Type", b"metadata"), (b"WARC-Record-ID", b"<urn:uuid:4>"), *base], b"fetchTimeMs: 1\r\n"),
        foreign(b"WARC/1.1", [(b"WARC-Type", b"revisit"), (b"WARC-Record-ID", b"<urn:uuid:5>"), *base, (b"WARC-Refers-To", b"<urn:uuid:2>"), (b"WARC-Payload-Digest", sha1), (b"Content-Type", b"application/http; msgtype=response")], http),
        foreign(b"WARC/1.0", [(b"WARC-Type", b"resource"), (b"WARC-Record-ID", b"<urn:uuid:6>"), *base, (b"WARC-Block-Digest", b"md5:" + hashlib.md5(b"x").hexdigest().encode())], b"x"),
    ]
    dictionary = zstandard.train_dictionary(2048, [r[:40] + b"%d" % i * 30 + r for i in range(400) for r in records[:3]])
    (tmp_path / "w").mkdir()
    for name, raw in (("plain", True), ("packed", False)):
        kept = dictionary.as_bytes() if raw else zstandard.ZstdCompressor().compress(dictionary.as_bytes())
        pack = zstandard.ZstdCompressor(dict_data=dictionary).compress
        between = struct.pack("<II", 0x184D2A50, 3) + b"abc"
        (tmp_path / "w" / f"{name}.warc.zst").write_bytes(struct.pack("<II", warc.SKIPPABLE, len(kept)) + kept + between.join(pack(r) for r in records))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == 2 * len(records)
    by = {r.record_id: r for r in got}
    assert [by[f"<urn:uuid:{i}>"].record_type for i in range(1, 7)] == ["warcinfo", "response", "request", "metadata", "revisit", "resource"]
    page, again = by["<urn:uuid:2>"], by["<urn:uuid:5>"]
    assert bytes(page.payload) == body and page.payload_digest == hashlib.sha256(body).hexdigest() and page.url == "http://a/" and page.page_id is None
    assert again.payload is None and again.refers_to_id == "<urn:uuid:2>" and again.payload_bytes == len(body) and by["<urn:uuid:3>"].date.endswith(".123456Z")
    bad = [records[1].replace(b"caf", b"cag"), records[5].replace(b"\r\n\r\nx", b"\r\n\r\ny"), records[3].replace(b"WARC-Date: 2019", b"WARC-Date: x"), records[0].replace(b"<urn:uuid:1>", b"urn:uuid:1"), records[2].replace(b"WARC-Type: request", b"WARC-Type: request\r\nWARC-Type: x"), b"WARC/0.9" + records[0][8:]]
    for record in bad:
        with pytest.raises(warc.Damaged):
            warc.parse(record)


def test_packing_covers_every_id(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["alpha", "béta", "gamma,", "x\n", "12"], k=rng.randint(0, 900)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "long " * 30000), (503, "a  b \n c\t"), (503, "a  b \n c\t"), (None, "null id"), (504, "<|endoftext|> 中文 😀")]
    docs = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "doc_id long, text string").repartition(3)
    tokenizer = Tokenizer.from_file(PATH)
    ids = {n: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], np.uint32) for n, (_, t) in enumerate(rows)}
    pieces = packing.pack(docs, PATH).collect()
    at = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.start == at.get(p.doc_id, 0) and p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(part.tobytes()) and list(p.ids) == part.tolist()
        at[p.doc_id] = p.start + p.length
    assert at == {n: len(x) for n, x in ids.items()}
    fill = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
    assert max(fill.values()) == 1024 and sum(n < 1024 for n in fill.values()) <= 3
    assert packing.pack(docs.where("false"), PATH).count() == 0


def test_placement_follows_the_sum_of_squares():
    rng, packer = random.Random(6), packing.Packer(32)
    for i in range(400):
        size = rng.randint(1, 31)
        before = packer.counts.copy()
        best = min(_sum_after(before, h, size, 32) for h in range(33 - size) if h == 0 or before[h])
        packer.place((i, 0, size))
        assert int((packer.counts[1:32] ** 2).sum()) == best


def _sum_after(counts, level, size, window):
    new = counts.copy()
    if level:
        new[level] -= 1
    if level + size < window:
        new[level + size] += 1
    return int((new[1:window] ** 2).sum())


def test_sharding_versions(spark, tmp_path):
    data = sharding.Dataset(spark, str(tmp_path / "set"), target_bytes=1 << 20)
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"), F.lit("x").alias("file"), F.lit(None).cast("string").alias("rows"))
    assert data.version() == 0 and data.manifest().count() == 0
    for k in range(5):
        data.append(rows.where(F.col("doc_id") % 5 == k).repartition(2))
    assert data.version() == 5 and data.read(1).count() == 800
    assert data.compact() == 6
    assert data.manifest().count() == 1 and data.manifest(5).count() == 10
    assert data.read().exceptAll(rows).count() == 0 and data.read().count() == 4000
    assert data.append(rows.where("false")) == 7 and data.read().count() == 4000
    assert data.vacuum() >= 10 and data.read().count() == 4000
    with pytest.raises(sharding.Conflict):
        data._commit(data.manifest(), 6)


def test_sharding_arrivals_by_key_and_empty_tables(spark, tmp_path):
    data = sharding.Dataset(spark, str(tmp_path / "set"))
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"), (F.col("id") % 3).alias("arrival"))
    assert data.append(rows.where("false").withColumn("k", F.lit(1)), key="k") == 1
    assert data.read().columns == rows.columns and data.read().count() == 0
    assert data.append(rows.withColumn("k", F.col("doc_id") % 6), key="k") == 7
    data.compact()
    assert data.read().columns == rows.columns and data.read().exceptAll(rows).count() == 0 and data.read().count() == 100


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8)))
    clean = [(i, " ".join(word() for _ in range(60)), "en") for i in range(30)]
    passage = " ".join(word() for _ in range(40))
    rows = clean + [(100, clean[0][1], "en"), (101, clean[1][1].upper(), "en"), (102, f"{clean[2][1]} {passage}", "en"), (103, "123 456", "en"), (104, None, None)]
    folder = str(tmp_path / "in")
    spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()} == {i for i, _, _ in clean}


def test_near_copy_stage_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    rows, doc = [(0, ""), (1, " \n"), (2, None)], 3
    for base in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(3, 400)))]
        rows.append((doc, " ".join(words)))
        doc += 1
        for changed in (0, 1, 2, 4, 8, 12)[: 2 + base % 5]:
            copy = list(words)
            for at in rng.choice(len(words), min(changed, len(words)), replace=False):
                copy[at] = f"other{doc}"
            rows.append((doc, " ".join(copy).upper()))
            doc += 1
    hot = [f"h{x}" for x in rng.integers(0, 5000, 200)]
    for at in range(150):  # a group of copies, each with a word changed at another place: many of its pairs are under 0.95
        rows.append((doc, " ".join([*hot[:at], f"new{at}", *hot[at + 1 :]])))
        doc += 1

    def sets(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    all_sets, root = [sets(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    middle = 0
    for i, a in enumerate(all_sets):
        for j in range(i):
            b = all_sets[j]
            shared, both = len(a & b), len(a | b)
            if both == 0 or shared * 5 >= both * 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
                middle += both > 0 and shared * 20 < both * 19
    assert middle > 100
    docs = spark.createDataFrame([*rows, (None, rows[-1][1])], "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == [*(i for i in range(len(rows)) if find(i) == i), None]
    assert similar.near_copies(docs.where("false")).count() == 0


def template_pages(rng, n, shared, own):
    """Pages of one template, each with words of its own in one place."""
    template = [f"t{x}" for x in range(shared)]
    return [" ".join([*template[: shared // 2], *[f"p{i}x{k}" for k in range(own)], *template[shared // 2 :]]) for i in range(n)]


def brute_similar(sets):
    return {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4}


def test_pairs_to_check_grow_in_proportion(spark):
    """Pages that have a template in common, at a similarity of 0.6 to 0.75, don't meet in all pairs."""
    ship(spark)
    rng, n_pairs = random.Random(1), {}
    for n in (200, 400):
        texts = [t for own in (40, 60) for t in template_pages(rng, n // 2, 240, own)] + ["a b c d e f g"] * 1
        rows = [(i, i, similar.shingles(t).view(np.int64).tolist()) for i, t in enumerate(texts)]
        sets = [set(h) for _, _, h in rows]
        first, other = sets[0], sets[1]
        assert 0.6 < len(first & other) / len(first | other) < 0.8
        n_pairs[n] = similar.rare_pairs(spark.createDataFrame(rows, "id long, part long, hashes array<long>")).count()
    assert n_pairs[400] <= 400 and n_pairs[200] <= 200


def test_rare_pairs_lose_none(spark):
    ship(spark)
    rng = random.Random(2)
    sets = []
    for _ in range(12):
        base = rng.sample(range(2000), rng.randint(1, 120))
        for _ in range(12):
            keep = [x for x in base if rng.random() < rng.choice((0.8, 0.9, 0.95, 1.0))]
            sets.append({*keep, *rng.sample(range(2000, 4000), rng.randint(0, max(1, len(base) // 8)))} or {1})
    for i in range(30):  # at the very limit
        sets += [set(range(5000 + 100 * i, 5000 + 100 * i + 9)), set(range(5001 + 100 * i, 5000 + 100 * i + 10))]
    parts = [rng.randint(0, 40) for _ in sets]
    frame = spark.createDataFrame([(i, p, sorted(s)) for i, (p, s) in enumerate(zip(parts, sets))], "id long, part long, hashes array<long>")
    found = {tuple(sorted((r.a, r.b))) for r in similar.rare_pairs(frame).collect()}
    want = {(i, j) for i, j in brute_similar(sets) if parts[i] != parts[j]}
    assert len(want) > 100 and want <= found and all(parts[i] != parts[j] for i, j in found)


def test_near_copies_of_repeated_rows_and_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "x", 1), (5, text, "y", 2), (5, "another text under the same id", "z", 3), (2, text + " w60", "x", 4), (None, text, "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, keys int")
    got = {(r.doc_id, r.component_id) for r in similar.near_copies(docs.where("doc_id IS NOT NULL")).collect()}
    assert got == {(5, 2), (5, 5), (2, 2)} and similar.near_copies(docs.where("doc_id IS NOT NULL")).count() == 4
    assert sorted(r["keys"] for r in similar.drop_near_copies(docs).collect()) == [3, 4, 5]
    assert similar.near_copies(docs.limit(0)).count() == 0


def test_near_copies_take_the_links_of_fingerprints(spark):
    """Sets without a band in common are linked if their fingerprints are close and their shingles similar, and those whose fingerprints agree by a repeated line alone aren't."""
    ship(spark)
    long = [f"w{i}" for i in range(2000)]
    repeated = "the same few words again and again " * 300
    texts = [" ".join(long), " ".join([*long, "end"]), repeated + " ".join(f"a{i}" for i in range(40)), repeated + " ".join(f"b{i}" for i in range(40)), " ".join(f"c{i}" for i in range(200))]
    fps = [int(np.uint64(simhash.fingerprint(t)).astype(np.int64)) for t in texts]
    assert all((fps[i] ^ fps[i + 1]).bit_count() <= 2 for i in (0, 2)) and brute_similar([set(similar.shingles(t).tolist()) for t in texts]) == {(0, 1)}
    nodes = spark.createDataFrame([(i, fp, [10 * i]) for i, fp in enumerate(fps)], "id long, fp long, keys array<long>")
    assert {tuple(sorted(p)) for p in similar.fingerprint_pairs(nodes).collect()} == {(0, 1), (2, 3)}
    found = similar.links(nodes, spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()
    assert {tuple(sorted(p)) for p in found} == {(0, 1)}
