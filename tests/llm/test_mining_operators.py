"""Phrase mining, conversation repair and the license scan against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import conversations, licenses, phrases
from tapeworks.shipping import ship

SPACE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_collocations(rows, least, longest, top):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i : i + k])
                    counts[key] = counts.get(key, 0) + 1
    frequent = {k: n for k, n in counts.items() if n >= least}
    found = []
    for (lang, words), a in frequent.items():
        if len(words) < 2:
            continue
        holds = lambda long: any(long[i : i + len(words)] == words for i in range(len(long) - len(words) + 1))
        if any(other == lang and len(long) > len(words) and n >= a and holds(long) for (other, long), n in frequent.items()):
            continue
        cuts = [(1000 * a * total[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k, counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        found.append((lang, " ".join(words), a, left, right, total[lang], score))
    out = []
    for lang in {f[0] for f in found}:
        ranked = sorted((f for f in found if f[0] == lang), key=lambda f: (-f[6], -f[2], f[1].encode()))
        out += [(lang, i, *f[1:]) for i, f in enumerate(ranked[:top], 1)]
    return sorted(out)


def prose(rng, n):
    words = ["The", "fox", "jumps", "ÉTÉ", "été", "a", "naïve", "of", "　", "x\x00y"]
    return "".join(rng.choices(words, weights=[9, 3, 3, 1, 2, 8, 2, 8, 1, 1])[0] + rng.choices([" ", "\t ", ", ", ".\n", "\r", "  "], weights=[20, 2, 1, 1, 1, 2])[0] for _ in range(n))


@pytest.mark.parametrize("longest", [2, 5])
def test_phrases_match_brute_force(spark, longest):
    rng = random.Random(5)
    rows = [(prose(rng, rng.randint(0, 60)), rng.choice(["en", "xx", None, "und"])) for _ in range(120)]
    rows += [("new york city hall", "en")] * 40 + [(None, "en"), ("", None), (".,;", "xx"), ("one", "zz"), ("again and again and again and again", "en")] * 12
    df = spark.createDataFrame([(i % 9, *r, "other") for i, r in enumerate(rows)], "doc_id long, text string, lang string, phrase string")
    got = phrases.collocations(df, threshold=10, longest=longest, top=15)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 10, longest, 15)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_a_table_that_lets_everything_through_changes_nothing(spark):
    rng = random.Random(6)
    rows = [(prose(rng, 50), "en") for _ in range(30)]
    df = spark.createDataFrame(rows, "text string, lang string")
    ship(spark)
    full = spark.sparkContext.broadcast(np.full(1 << 10, 255, np.uint8))
    some = phrases.bit_table(phrases.frequent(df, range(1, 3), 10))
    by = lambda table: sorted(map(tuple, phrases.phrase_counts(df, 2, 10, table).collect()))
    assert by(full) == by(some) and len(by(full)) > 10


def test_summaries_keep_what_is_frequent():
    rng = np.random.default_rng(3)
    for threshold in (2, 10, 50):
        stream = np.concatenate([rng.zipf(1.3, 20_000).astype(np.uint64) % 5000, np.repeat(np.arange(9000, 9040, dtype=np.uint64), threshold)])
        rng.shuffle(stream)
        summary = phrases.Summary(len(stream) // threshold + 1)
        for part in np.array_split(stream, 17):
            summary.merge(*np.unique(part, return_counts=True))
        keys, counts = np.unique(stream, return_counts=True)
        assert set(keys[counts >= threshold]) <= set(summary.survivors(threshold))
        assert summary.removed < threshold and len(summary.keys) <= summary.capacity
    tight = phrases.Summary(3)
    tight.merge(np.arange(10, dtype=np.uint64), np.arange(1, 11))
    assert tight.removed == 7 and dict(zip(tight.keys.tolist(), tight.counts.tolist())) == {7: 1, 8: 2, 9: 3}


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        role, text = show(role), show(text)
        way = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = "user" if way == 4 else role, "" if way == 1 else re.sub(r"[.!?]", "", text) if way == 2 else text
        out += [] if way == 0 else [(conv, turn, role, text)] * (2 if way == 3 else 1)
    return out


def brute_repair(rows):
    """Every state's cheapest audit is kept whole, row by row."""
    seen, faults = set(), []
    for _, role, text in rows:
        words = text.strip(SPACE)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    names = {0: "user", 1: "user", 2: "assistant", 3: "user"}

    def insertions(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                way = (cost + 3, audit + "I", [*lines, f"{names[state]}:"])
                best[after[state]] = min(best.get(after[state], way), way, key=lambda w: w[:2])
        return best

    best = {0: (0, "", [])}
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for state, (cost, audit, lines) in insertions(best).items():
            ways = [(state, cost + 4, audit + "D", lines)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                ways.append((after[state], cost + 3 + more, audit + "R", [*lines, f"{names[state]}:{text}"]))
                if role[:1] == names[state][0]:
                    ways.append((after[state], cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                if role[:1] == "s" and state == 0:
                    ways.append((1, cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            for to, *way in ways:
                new[to] = min(new.get(to, tuple(way)), tuple(way), key=lambda w: w[:2])
        best = new
    cost, audit, lines = min((w for s, w in insertions(best).items() if s in (0, 3)), key=lambda w: w[:2])
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def signed_hash(spark, texts):
    return {r.t: r.h for r in spark.createDataFrame([(t,) for t in set(texts)], "t string").select("t", F.xxhash64("t").alias("h")).collect()}


def brute_conversations(spark, rows):
    kept = brute_damage(rows)
    h = signed_hash(spark, [r[3] for r in kept])
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in kept if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], h[r[2]]))
        out[conv] = brute_repair(own)
    return out


def conversation_rows(rng, n, longest):
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "Yes. ", "été.", "Thanks", None]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system"] * 2 + ["user", "assistant"] * 5 + ["tool", "", None]) if rng.random() < 0.5 else ["user", "assistant"][turn % 2]
            rows.append((conv if conv else None, None if rng.random() < 0.03 else turn + (turn > 4), role, rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randint(0, 500)}."))
    return rows


@pytest.mark.parametrize("segment", [7, 4096])
def test_repairs_match_brute_force(spark, segment):
    rng = random.Random(segment)
    rows = conversation_rows(rng, 60, 14) + [(1000, t, r, x) for _, t, r, x in conversation_rows(rng, 25, 20)] + [(1001, None, None, None), (1002, 5, "user", "same."), (1002, 5, "user", "same.")]
    rows += [(2000 + i, 0, "user", "Alone.") for i in range(40)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n long, audit string").repartition(5)
    found = conversations.repaired(df, segment)
    got = {r[0]: tuple(r[1:]) for r in found.collect()}
    want = brute_conversations(spark, rows)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {k for k in want if got.get(k) != want[k]} == set() and len(got) == len(want)
    assert any(w[6] == "" and w[7] == hashlib.sha256(b"").hexdigest() for w in want.values())
    assert conversations.repaired(df.limit(0)).count() == 0


def test_crossings_agree_with_whole_audits():
    rng = random.Random(8)
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["", "a.", "b.", "c", "d!"])) for _ in range(rng.randint(0, 12))]
        seen, faults = set(), []
        for r in rows:
            faults.append(conversations.fault_of(*r, r in seen))
            seen.add(r)
        cost, audit, lines = conversations.repair([(*r, f) for r, f in zip(rows, faults)])
        want = brute_repair([(None, *r) for r in rows])
        assert (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()) == want[5:]


def test_a_conversation_of_many_rows_is_several_tasks(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"Text {t}.") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = conversations.repaired(df, 100).collect()
    assert [tuple(r[1:]) for r in got] == [brute_conversations(spark, rows)[1]]


def brute_scan(texts, postings=licenses.POSTINGS):
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) for t in texts]
    templates = [(label, True, p.split(), [p]) for label, p in licenses.BASE.items()] + [(label, False, n.split(), k) for label, ns in licenses.TEMPLATES.items() for n, k in ns]
    df = Counter(w for ws in words for w in set(ws))
    out = []
    for ws in words:
        labels, base, spots, score = set(), set(), [], 0.0
        for label, is_base, notice, keys in templates:
            rarest = sorted(set(notice), key=lambda w: (df[w], w))[: 1 if is_base else postings]
            weight = {w: math.log((len(texts) + 1) / (df[w] + 1)) + 1 for w in rarest}
            for at in range(len(ws)):
                window = f" {' '.join(ws[at : at + len(notice) + (0 if is_base else licenses.SLACK)])} "
                share = sum(weight[w] for w in rarest if ws[at + notice.index(w) : at + notice.index(w) + 1] == [w]) / sum(weight.values())
                if share >= licenses.LEAST and all(f" {k} " in window for k in keys):
                    labels.add(label)
                    score = max(score, 1.0 if is_base else share)
                    if is_base:
                        base.add(label)
                        spots.append(at)
        out.append((len(ws), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(min(score, 1.0), 6)))
    return out


@pytest.mark.parametrize("block", [16, licenses.BLOCK])
def test_licenses_match_brute_force(spark, block):
    rng = random.Random(block)
    notices = [n for ns in licenses.TEMPLATES.values() for n, _ in ns] + list(licenses.BASE.values()) + ["Licensed under CC BY-NC 4.0.", "ALL RIGHTS RESERVED all rights, reserved", "cc by cc by", "cc by", "Apache License", "the MIT license by itself"]
    filler = lambda n: " ".join(rng.choices(["the", "of", "word", "été", "license", "version", "2", "by"], k=n))
    texts = [None, "", "--", "cc", "cc by", "all rights", *notices]
    texts += [f"{filler(rng.randint(0, 50))} {rng.choice(notices)} {filler(rng.randint(0, 50))}\n{rng.choice(notices)}" for _ in range(60)]
    for _ in range(20):  # words in between, and a word changed
        ws = rng.choice(notices).split()
        ws[rng.randrange(len(ws)) :][:0] = ["oops"]
        texts.append(" ".join(ws))
        ws = rng.choice(notices).split()
        ws.insert(rng.randrange(len(ws)), "oops")
        texts.append(f"{filler(5)} {' '.join(ws)} {filler(9)}")
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts)]
    rows += rows[:9]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, words string"), block=block)
    named = [(r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_base, r.first_word, r.last_word, ",".join(sorted(r.base_labels)), ",".join(sorted(r.labels)), round(r.score, 6)) for r in got.collect()]
    want = [(d if d is not None else -1, *found) for (d, *_), found in zip(rows, brute_scan([t for _, t, _ in rows]))]
    assert Counter(named) == Counter(want)
    assert {label for w in want for label in w[6].split(",")} >= {"apache-2.0", "mit", "gpl", "reserved", "cc-by", "cc-by-nc-4.0", "isc", "mpl-2.0"}
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_license_scan_stays_in_the_jvm(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "MIT License")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
