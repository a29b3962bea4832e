"""SQL for DuckDB with the rows of those queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
      FROM documents)
"""

#: SHA-1 in base 32: twenty bits at a time.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS origin FROM p)
SELECT page_id,
       octet_length(encode(h)) AS payload_bytes,
       translate(upper(array_to_string(list_transform(range(8), lambda i: to_base(CAST('0x' || substr(x, CAST(i * 5 + 1 AS INT), 5) AS BIGINT), 32, 4)), '')),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> origin THEN origin END AS refers_to
FROM g
"""

SUBSTRING_DEDUP = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM dup, (SELECT unnest(range(20)) AS k)),
word AS (SELECT doc_id, j, ws[j] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

CHAT = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?SYS\]|/?INST\]|/?ROLE\]|SEP\])', '\1\\\2\3', 'g')) AS n,
             length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?SYS\]|/?INST\]|/?ROLE\]|SEP\])', '\1\\\2\3', 'g')) AS m FROM r)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(n + CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 13 WHEN 'system' THEN 11 ELSE 18 + m END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')"

#: Seeds of another kind than the operator's: the longest run of words that substitutions must leave somewhere.
DECONTAMINATION = f"""
WITH b AS (SELECT item_id, b, len(b) AS n, CASE WHEN len(b) >= 12 THEN 3 ELSE ceil((len(b) - others) / (others + 1))::INT END AS run
           FROM (SELECT *, len(b) - ceil(len(b) * 4 / 5)::INT AS others FROM (SELECT DISTINCT item_id, {_WORDS} AS b FROM benchmark)) WHERE len(b) > 0),
d AS (SELECT DISTINCT doc_id, {_WORDS} AS h FROM documents),
bs AS (SELECT item_id, run, j, array_to_string(b[j + 1:j + run], ' ') AS key FROM (SELECT *, unnest(range(n - run + 1)) AS j FROM b)),
ds AS (SELECT doc_id, run, i, array_to_string(h[i + 1:i + run], ' ') AS key
       FROM (SELECT *, unnest(range(len(h) - run + 1)) AS i FROM d, (SELECT DISTINCT run FROM b) WHERE len(h) >= run)),
lay AS (SELECT DISTINCT doc_id, item_id, i - j AS s FROM bs JOIN ds USING (run, key)),
eq AS (SELECT doc_id, item_id, s, list_transform(range(greatest(0, -s), least(n, len(h) - s)), lambda x: (b[x + 1] = h[x + s + 1])::INT) AS e
       FROM lay JOIN b USING (item_id) JOIN d USING (doc_id) WHERE least(n, len(h) - s) - greatest(0, -s) >= least(n, 12)),
reg AS (SELECT *, least(24, len(e)) AS r FROM eq WHERE list_sum(e) * 5 >= 4 * least(24, len(e))),
cmp AS (SELECT *, list_max(list_transform(range(len(e) - r + 1), lambda a: list_sum(e[a + 1:a + r]))) AS agree FROM reg),
best AS (SELECT *, agree / r::DOUBLE AS sim, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY agree / r::DOUBLE DESC, list_sum(e) DESC, s) AS k FROM cmp WHERE agree * 5 >= r * 4)
SELECT doc_id, item_id, sim AS similarity, list_sum(e)::INT AS equal_words, len(e)::INT AS overlap_words FROM best WHERE k = 1
"""

#: CRC-32 of a string, from a table of 256 that its polynomial gives.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS tab)"


def _crc(text: str) -> str:
    bytes_of = f"list_transform(range(octet_length(encode({text}))), lambda k: CAST('0x' || substr(hex(encode({text})), CAST(k * 2 + 1 AS INT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_of}), lambda c, b: xor(tab[xor(c, b) % 256 + 1], c >> 8)), 4294967295)"


PREFIX_TRIE = f"""
WITH {_CRC_TABLE},
t AS (SELECT conv_id AS c, turn, length(x) AS k, sha256(concat(length(r), ':', r, x)) AS d
      FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
o AS (SELECT c, list({{'d': d, 'k': k}} ORDER BY turn NULLS FIRST, d) AS ts FROM t GROUP BY c),
h AS (SELECT c, ts, {_crc("CAST(c AS VARCHAR)")} % 6 AS h FROM o, crc),
r AS (SELECT h.c, list_concat(coalesce(o.ts[1:h], []), h.ts[h + 1:]) AS ts FROM h LEFT JOIN o ON o.c = h.c - h.c % 100),
p AS (SELECT c, d, array_to_string(list_transform(ts[1:d], lambda x: x.d), ',') AS key, d = len(ts) AS last, CASE WHEN d > 0 THEN ts[d].k ELSE 0 END AS k
      FROM (SELECT *, unnest(range(len(ts) + 1)) AS d FROM r)),
n AS (SELECT key, d, min(c) AS least, count(*) AS m, (count(*) - 1) * min(k) AS own, sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (last), '')) AS e FROM p GROUP BY key, d),
kids AS (SELECT left(key, greatest((d - 1) * 65 - 1, 0)) AS key, d - 1 AS d, count(*) AS q FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(q, 0) AS q FROM n LEFT JOIN kids USING (key, d)),
up AS (SELECT left(key, greatest(a * 65 - 1, 0)) AS key, a AS d, sum((q = 0)::INT) AS leaves, sum(own) AS saved FROM (SELECT *, unnest(range(d + 1)) AS a FROM m) GROUP BY ALL)
SELECT m.least AS conv_id, m.d AS depth, w.least AS parent_conv_id, m.m AS n_convs, m.q AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, m.e AS ends_sha256
FROM m JOIN up USING (key, d) LEFT JOIN n w ON w.d = m.d - 1 AND w.key = left(m.key, greatest((m.d - 1) * 65 - 1, 0))
"""

SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{6,}}')) AS run FROM documents) GROUP BY ALL),
h AS (SELECT *, {_crc("concat(doc_id, ':', run)")} AS h FROM runs, crc),
w AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 199 = 0 THEN concat(left(run, (h % length(run))::INT), substr(run, (h % length(run) + 2)::INT)) ELSE run END AS word FROM h)
      WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
del AS (SELECT word, n, i, concat(left(word, i::INT), substr(word, (i + 2)::INT)) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM del a JOIN del b USING (i, rest) WHERE a.word <> b.word
         UNION SELECT del.word, w.word, w.n FROM del JOIN w ON w.word = rest UNION SELECT w.word, del.word, del.n FROM del JOIN w ON w.word = rest),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
form AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, 0 AS step FROM form UNION ALL SELECT walk.word, form.form, step + 1 FROM walk JOIN form ON form.word = walk.root WHERE form.form IS NOT NULL)
SELECT form.word, form, n, n_near::BIGINT AS n_near, form_n, (SELECT arg_max(root, step) FROM walk WHERE walk.word = form.word) AS root FROM form
"""

#: Links by counting shared shingles; classes by spreading minima.
NGRAM_JOIN = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 2], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, ways.b FROM reach r JOIN ways ON ways.a = r.b)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, (SELECT min(b) FROM reach WHERE reach.a = w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id)
"""

ORACLES = {
    "op3_warc_normaliser": WARC,
    "op4_benchmark_decontamination": DECONTAMINATION,
    "op5_substring_dedup": SUBSTRING_DEDUP,
    "op7_exact_dedup": EXACT_DEDUP,
    "op10_chat_formatting": CHAT,
    "op11_ngram_join": NGRAM_JOIN,
    "op12_prefix_trie": PREFIX_TRIE,
    "op13_spelling_variants": SPELLING,
}
