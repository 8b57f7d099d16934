"""Comparison SQL of the operators that SQL can express, for tables that hold each doc_id once."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MINHASH_DEDUP = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), {WORDS}) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""
SUBSTRING_DEDUP = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
starts AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i + 1:i + 35], ' ') AS key FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 34, 0))) AS i FROM w)),
repeated AS (SELECT key FROM starts GROUP BY key HAVING count(*) > 1),
covered AS MATERIALIZED (SELECT DISTINCT doc_id, i + j AS p FROM starts JOIN repeated USING (key), unnest(range(35)) u(j)),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM placed ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
SUFFIX_DEDUP = r"""
WITH b AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
starts AS MATERIALIZED (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS key FROM (SELECT doc_id, h, unnest(range(greatest(n - 49, 0))) AS i FROM b)),
least AS (SELECT key, min(doc_id) AS first FROM starts GROUP BY key HAVING min(doc_id) < max(doc_id)),
hits AS MATERIALIZED (SELECT doc_id, i FROM starts JOIN least USING (key) WHERE doc_id > first),
spans AS MATERIALIZED (SELECT doc_id, min(i) AS low, max(i) + 50 AS high FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span
    FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM hits)) GROUP BY doc_id, span),
gone AS (SELECT doc_id, CAST(sum(high - low) AS BIGINT) AS n_removed, count(*) AS n_spans, list([low, high] ORDER BY low) AS cuts FROM spans GROUP BY doc_id),
edges AS (SELECT b.doc_id, h, n, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    list_concat([CAST(0 AS BIGINT)], coalesce(flatten(cuts), []), [n]) AS e FROM b LEFT JOIN gone USING (doc_id))
SELECT doc_id, n AS n_bytes, n_removed, n_spans,
    sha256(unhex(array_to_string(list_transform(range(len(e) // 2), lambda k: substr(h, 2 * e[2 * k + 1] + 1, 2 * (e[2 * k + 2] - e[2 * k + 1]))), ''))) AS kept_sha256
FROM edges
"""

SPELLING_VARIANTS = r"""
WITH RECURSIVE
crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY doc_id, run),
named AS (SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195, unicode(ch) - 64] END)) AS bytes FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INT)])), 4294967295) AS h
    FROM named, crc_table),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gaps AS MATERIALIZED (SELECT word, n, k, left(word, CAST(k AS INT)) AS front, substr(word, CAST(k AS INT) + 2) AS rest FROM words, unnest(range(length(word))) u(k)),
near AS MATERIALIZED (
    SELECT a.word, a.n, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.k = b.k AND a.front = b.front AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM words a JOIN gaps b ON a.word = b.front || b.rest
    UNION SELECT b.word, b.n, a.word, a.n FROM words a JOIN gaps b ON a.word = b.front || b.rest),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, arg_min(other, (-m, other)) AS form, max(m) AS form_n FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
    FROM words LEFT JOIN (SELECT word, n_near, form, form_n FROM best) USING (word)),
walk AS (SELECT word, word AS root FROM formed UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.root WHERE formed.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN formed ON formed.word = walk.root WHERE formed.form IS NULL)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
