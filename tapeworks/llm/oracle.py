"""DuckDB SQL with the same results as the queries that SQL can express."""

from __future__ import annotations

from tapeworks.llm import licenses

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP4 = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM parts),
k AS (SELECT doc_id, pos, line, translate(trim(line, {BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, pos, line, (keeper IS NOT NULL AND k.doc_id < keeper) AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP5 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS p FROM starts),
ks AS (SELECT DISTINCT len(p) AS k FROM win),
places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks),
m AS (SELECT doc_id, i, k, item_id FROM (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS p FROM places) JOIN win USING (p)),
pos AS (SELECT DISTINCT doc_id, i + unnest(range(0, k)) AS place FROM m),
h AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id),
tok AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d),
cnt AS (SELECT word, count(*) AS n FROM tok GROUP BY word),
terms AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, unnest(w) AS word FROM b WHERE item_id IS NOT NULL),
ranked AS (SELECT item, word, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY item ORDER BY coalesce(df.n, 0), word) AS r FROM terms LEFT JOIN cnt USING (word)),
rare AS (SELECT *, count(*) OVER (PARTITION BY item) AS k, min(n) OVER (PARTITION BY item) AS least FROM ranked WHERE r <= 3),
lists AS (SELECT doc_id, item, r, pos FROM tok JOIN rare USING (word) WHERE k = 3 AND least > 0),
nr AS (SELECT x.doc_id, count(DISTINCT x.item) AS n_near FROM lists x
  JOIN lists y ON x.doc_id = y.doc_id AND x.item = y.item AND abs(x.pos - y.pos) <= 20 JOIN lists z ON x.doc_id = z.doc_id AND x.item = z.item AND abs(x.pos - z.pos) <= 20
  WHERE x.r = 1 AND y.r = 2 AND z.r = 3 GROUP BY x.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nr USING (doc_id)
"""

OP8 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS low FROM p GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > low THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > low THEN low END AS refers_to
FROM p JOIN f USING (payload_digest)
"""

OP11 = f"""
WITH p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, {LOWERED} AS t FROM documents)),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS c FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, n.n, c.c,
    (1000::HUGEINT * c.a::HUGEINT * n.n::HUGEINT) // (l.a::HUGEINT * r.a::HUGEINT) AS score
  FROM cuts c JOIN n USING (lang) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.c], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.c + 1:], ' ')),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
gone AS (SELECT DISTINCT x.lang, x.phrase FROM f x JOIN f y ON x.lang = y.lang AND y.k > x.k AND 100 * y.a >= 100 * x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM low ANTI JOIN gone USING (lang, phrase))
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


def _license_sql() -> str:
    """The scan of license notices, with the operator's templates as a table."""
    rows = licenses.template_rows()
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    values = ", ".join(f"({t}, '{label}', {is_base}, {listed(words)}, {listed(keys)})" for t, label, is_base, words, keys in rows)
    return f"""
WITH t(template, label, is_base, words, keys) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
total AS (SELECT count(*) AS n FROM d),
tw AS (SELECT template, is_base, unnest(list_distinct(words)) AS word FROM t),
df AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT rid, word FROM (SELECT rid, unnest(w) AS word FROM d) JOIN (SELECT DISTINCT word FROM tw) USING (word)) GROUP BY word),
ranked AS (SELECT template, is_base, word, row_number() OVER (PARTITION BY template ORDER BY coalesce(df.n, 0), word) AS r, ln((total.n + 1) / (coalesce(df.n, 0) + 1)) + 1 AS idf FROM tw LEFT JOIN df USING (word), total),
rare AS (SELECT template, word, idf / sum(idf) OVER (PARTITION BY template) AS weight FROM ranked WHERE r <= CASE WHEN is_base THEN 1 ELSE {licenses.POSTINGS} END),
ix AS (SELECT rare.template, word, weight, list_position(words, word) - 1 AS place, label, is_base, words, keys FROM rare JOIN t USING (template)),
tok AS (SELECT rid, w, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d),
hit AS (SELECT rid, template, label, is_base, pos - place AS spot, word, weight, keys,
    ' ' || array_to_string(w[pos - place + 1:pos - place + len(words) + CASE WHEN is_base THEN 0 ELSE {licenses.SLACK} END], ' ') || ' ' AS win
  FROM tok JOIN ix USING (word) WHERE pos >= place),
good AS (SELECT rid, template, label, is_base, spot, sum(weight) AS share FROM hit WHERE len(list_filter(keys, lambda k: NOT contains(win, ' ' || k || ' '))) = 0
  GROUP BY rid, template, label, is_base, spot HAVING sum(weight) >= {licenses.LEAST}),
doc AS (SELECT rid, count(*) FILTER (WHERE is_base) AS n_base, min(spot) FILTER (WHERE is_base) AS first_word, max(spot) FILTER (WHERE is_base) AS last_word, max(share) AS score,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM good GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(least(coalesce(score, 0), 1), 6) AS score
FROM d LEFT JOIN doc USING (rid)
"""


OP1 = "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents"

ORACLE = {"op1_sharding": OP1, "op4_line_dedup": OP4, "op5_decontamination": OP5, "op8_warc": OP8, "op11_phrases": OP11, "op13_license_scan": _license_sql()}
