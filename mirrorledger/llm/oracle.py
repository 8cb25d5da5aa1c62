"""SQL counterparts of those queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
spans AS (
  SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT s.r, s.i, s.n, o.item_id FROM spans s JOIN windows o ON s.n = o.n AND s.x = o.x),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

OP1 = r"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.host || r.path) DESC) AS k
  FROM (SELECT DISTINCT * FROM p) p
  JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM p LEFT JOIN best b ON p.page_id IS NOT DISTINCT FROM b.page_id AND p.host = b.host AND p.path = b.path AND b.k = 1
"""

_HEX = "sha1(encode(coalesce(html, '')))"
# Base 32 of 20 bytes: 32 letters of 5 bits each, the bits taken from the digest's hexadecimal digits.
OP10 = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, {_HEX} AS h FROM pages),
bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right(bin(16 + instr('0123456789abcdef', substr(h, i, 1)) - 1), 4)), '') AS b
  FROM p),
named AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(
    list_transform(range(0, 5), lambda j: CASE WHEN substr(b, 5 * i + j + 1, 1) = '1' THEN 1 << (4 - j) ELSE 0 END)) AS INTEGER), 1)), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY h) AS first
  FROM bits)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM named
"""

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
post AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
idf AS (SELECT t, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, stats GROUP BY t, n),
scored AS (
  SELECT q.r AS q, p.r, sum(idf.idf * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * len(d.w) / mean))) AS score
  FROM post q JOIN d dq ON dq.r = q.r AND dq.doc_id % 100 = 0 JOIN post p ON p.t = q.t JOIN idf ON idf.t = p.t
  JOIN d ON d.r = p.r, stats
  GROUP BY q.r, p.r),
ranked AS (
  SELECT dq.doc_id AS query_id, d.doc_id, round(score, 6) AS score,
    row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, d.doc_id) AS rank
  FROM scored JOIN d dq ON dq.r = q JOIN d ON d.r = scored.r)
SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

# The check sum of the ASCII text conv_id:turn, byte by byte and bit by bit; then rows after damage, numbered in order; then
# the best edits up to each row for each state of the pattern (0 nothing, 1 after s, 2 after u, 3 after a) as the least list
# of cost, audit and repaired text.
OP11 = r"""
WITH RECURSIVE raw AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
summed AS (
  SELECT k, (4294967295 - list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20 AS h
  FROM (SELECT DISTINCT k FROM raw)),
damaged AS (
  SELECT c, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN h = 0 THEN 0 WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw JOIN summed USING (k)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS occurrence,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final
  FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial, final = '' AS is_blank, final <> '' AND occurrence > 1 AS is_again,
    final <> '' AND occurrence = 1 AND final NOT IN ('.', '!', '?') AS is_cut,
    lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS before
  FROM placed),
counts AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_again) AS duplicate, count(*) FILTER (is_cut) AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY c),
leads(initial, q, p) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
inserts(q, p, n, added) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''),
    (0, 2, 1, chr(10) || 'user:'), (1, 2, 1, chr(10) || 'user:'), (3, 2, 1, chr(10) || 'user:'), (2, 3, 1, chr(10) || 'assistant:'),
    (0, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'),
    (3, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 2, chr(10) || 'assistant:' || chr(10) || 'user:')),
edits AS (
  SELECT c, i, q, q AS p, 4 AS cost, 'D' AS letter, '' AS added FROM judged, (VALUES (0), (1), (2), (3)) AS states(q)
  UNION ALL
  SELECT c, i, q, p, CASE WHEN is_cut THEN 3 ELSE 0 END, 'K', chr(10) || role || ':' || text
  FROM judged JOIN leads USING (initial) WHERE NOT is_blank AND NOT is_again
  UNION ALL
  SELECT c, i, q, p, CASE WHEN is_cut THEN 6 ELSE 3 END, 'R', chr(10) || name || ':' || text
  FROM judged, (VALUES ('u', 'user'), ('a', 'assistant')) AS names(initial, name) JOIN leads ON leads.initial = names.initial
  WHERE NOT is_blank AND NOT is_again),
best(c, i, q, b) AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT), 0, ['000000000', '', ''] FROM raw
  UNION ALL
  SELECT best.c, best.i + 1, e.p,
    min([lpad(CAST(CAST(b[1] AS BIGINT) + 3 * t.n + e.cost AS VARCHAR), 9, '0'), b[2] || repeat('I', t.n) || e.letter, b[3] || t.added || e.added])
  FROM best JOIN inserts t ON t.q = best.q JOIN edits e ON e.c = best.c AND e.i = best.i + 1 AND e.q = t.p
  GROUP BY best.c, best.i, e.p),
done AS (
  SELECT best.c, min([lpad(CAST(CAST(b[1] AS BIGINT) + 3 * t.n AS VARCHAR), 9, '0'), b[2] || repeat('I', t.n), b[3] || t.added]) AS b
  FROM best JOIN inserts t ON t.q = best.q LEFT JOIN counts ON counts.c = best.c
  WHERE best.i = coalesce(counts.n, 0) AND t.p IN (0, 3)
  GROUP BY best.c)
SELECT r.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(b[1] AS BIGINT) AS cost, b[2] AS audit,
  sha256(substr(b[3], 2)) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM raw) r JOIN done ON done.c = r.c LEFT JOIN counts ON counts.c = r.c
"""

# Products pass 64 bits, so they are HUGEINT; // floors.
OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
f AS (
  SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, range(1, 6) AS r(m) WHERE len(w) >= m)
  GROUP BY ALL HAVING count(*) >= 100),
longer AS (
  SELECT lang, phrase, max(f) AS most FROM (
    SELECT lang, array_to_string(string_split(phrase, ' ')[1:m - 1], ' ') AS phrase, f FROM f
    UNION ALL SELECT lang, array_to_string(string_split(phrase, ' ')[2:m], ' '), f FROM f)
  GROUP BY ALL),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head,
    array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') AS rest
  FROM (SELECT f.*, unnest(range(1, m)) AS k FROM f LEFT JOIN longer USING (lang, phrase) WHERE m > 1 AND coalesce(most, 0) < f)),
scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n,
    (CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
  JOIN sizes s ON s.lang = c.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE place = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

OP13 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT r, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS x
  FROM (SELECT r, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS p, b.r AS q, count(*) AS common FROM shingles a JOIN shingles b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r),
links AS (
  SELECT p, q FROM shared JOIN sizes x ON x.r = p JOIN sizes y ON y.r = q WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach AS (SELECT r AS p, r AS q FROM d UNION SELECT reach.p, links.q FROM reach JOIN links ON links.p = reach.q),
lows AS (SELECT p AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.q GROUP BY p)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN lows USING (r) LEFT JOIN sizes USING (r)
"""


def sql() -> dict[str, str]:
    return {"op1_url_filter": OP1, "op10_warc": OP10, "op11_conversation_repair": OP11, "op12_collocations": OP12, "op13_near_duplicates": OP13, "op6_decontamination": OP6, "op7_search": OP7}
