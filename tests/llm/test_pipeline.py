"""The corpus pipeline against a brute-force version of its five stages."""

import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from tapeworks.llm import langid
from tapeworks.llm.queries import tokenizer_path
from tests.llm.test_text_operators import brute_lines, brute_overlap, brute_profile, brute_trigrams


def brute_languages(rows):
    sums = {}
    for text, lang in {(text, lang) for _, text, lang in rows}:
        if lang and brute_profile(text) is not None:
            sums[lang] = sums.get(lang, 0) + brute_profile(text)
    matrix = np.stack([v / np.linalg.norm(v) for v in sums.values()])
    kept = []
    for row in rows:
        v = brute_profile(row[1])
        if v is not None and (matrix @ v).max() >= langid.MIN_SCORE * np.sqrt((n := brute_trigrams(row[1])) / (n + langid.SETTLING)):
            kept.append(row)
    return kept


def brute_near(rows):
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(t) for _, t, _ in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if (not a and not sets[j]) or len(a & sets[j]) * 5 >= len(a | sets[j]) * 4:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    least = {}
    for i, (doc, *_) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return [r for i, r in enumerate(rows) if least[find(i)] == r[0]]


def test_pipeline_matches_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(17)
    words = {k: ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(400)] for k, letters in (("en", "abcdefghijklmn"), ("xx", "opqrstuvwxyzé"))}
    prose = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    licence = "This line stands under very many documents"
    passages = [prose("en", 14), prose("xx", 30)]
    rows = [(i, f"{prose(lang, rng.randint(40, 160))}\n{licence if i % 3 else prose(lang, 8)}\n{prose(lang, 9)}", lang) for i, lang in enumerate(["en", "xx"] * 25)]
    for i in range(20):  # copies with some words changed, from the same to too different
        w = rows[i][1].split(" ")
        for at in rng.sample(range(len(w)), i % 7):
            w[at] = "changed"
        rows.append((100 + i, " ".join(w), rows[i][2]))
    rows += [(200, f"{prose('en', 40)} {passages[0].upper()}, {prose('en', 30)}", "en"), (201, f"{prose('xx', 50)}\n{passages[1]}\n{prose('xx', 20)}", "xx"), (202, "123 456", "en"), (203, None, None), (204, "", "xx"), (205, licence, "en"), (206, "中文字" * 150, None), (207, "ok", None)]
    folder = str(tmp_path / "in")
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    items = [(1, passages[0]), (2, passages[1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()

    langs = {i: lang for i, _, lang in rows}
    kept = brute_languages(rows)
    kept = [(i, text, langs[i]) for i, _, _, text in brute_lines([(i, t) for i, t, _ in kept])]
    kept = brute_near(kept)
    hit = {i for i, _, n, _ in brute_overlap([(i, t) for i, t, _ in kept], items) if n}
    kept = [r for r in kept if r[0] not in hit]
    assert hit == {200, 201} and 40 < len(kept) < len(rows) - 10
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], np.uint32) for i, t, _ in kept}
    assert {p.doc_id for p in got} == set(ids)
    covered = Counter()
    for p in got:
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        covered[p.doc_id] += p.length
    assert covered == {i: len(x) for i, x in ids.items()}
