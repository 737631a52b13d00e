"""DuckDB SQL for the operators that SQL can express."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, list_slice(ws, i, i + 9) AS w FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
n AS (SELECT DISTINCT len(w) AS n FROM bw),
dw AS (SELECT doc_id, i, n, list_slice(ws, i, i + n - 1) AS w FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, n)),
m AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (w)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP4 = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP7 = """
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
t AS (SELECT *, trim(raw) AS line FROM l),
b AS (SELECT line, min((doc_id, pos)) AS first FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
m AS (SELECT t.doc_id, t.pos, t.raw, b.line IS NOT NULL AND (t.doc_id, t.pos) <> b.first AS gone FROM t LEFT JOIN b USING (line))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP2 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM r)),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN g USING (doc_id, p) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_ESCAPED = r"(length({0}) + length({0}) - length(regexp_replace({0}, '[\\<\[|]', '', 'g')))"

OP8 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS idx, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 2 AS tok FROM c),
p AS (SELECT *, coalesce(sum(tok) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre,
             max(CASE WHEN idx = 0 AND role = 'system' THEN tok END) OVER (PARTITION BY conv_id) AS st FROM t),
q AS (SELECT *, coalesce(st, 0) AS s, greatest(512 - coalesce(st, 0) - 128, 1) AS room FROM p),
z AS (SELECT *, floor((pre - s) / room) AS a, greatest(floor((pre - s) / room), floor((pre + tok - s - 1) / room)) AS b FROM q),
y AS (SELECT *, a * 2 + CAST(b > a AS INTEGER) AS own FROM z),
l AS (SELECT *, CASE WHEN st IS NOT NULL AND idx = 0 THEN coalesce(lead(own) OVER (PARTITION BY conv_id ORDER BY idx), 0) ELSE own END AS cell FROM y),
w AS (SELECT conv_id, cell, min(idx) AS first, min(pre) AS first_pre, max(st) AS st FROM l GROUP BY 1, 2),
f AS (SELECT conv_id, role, text FROM l
      UNION ALL SELECT l.conv_id, l.role, l.text FROM l JOIN w ON l.conv_id = w.conv_id AND w.first BETWEEN l.idx + 1 AND l.idx + 2 AND l.pre >= w.first_pre - 128 WHERE NOT (l.st IS NOT NULL AND l.idx = 0)
      UNION ALL SELECT w.conv_id, 'system', l.text FROM w JOIN l ON l.conv_id = w.conv_id AND l.idx = 0 WHERE w.st IS NOT NULL AND w.first > 0),
n AS (SELECT conv_id, CAST(sum(11 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS BIGINT) AS formatted_chars FROM f GROUP BY 1),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
             CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
             sha256(coalesce(string_agg(text, '' ORDER BY idx) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256 FROM t GROUP BY 1)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM g JOIN n USING (conv_id)
"""

#: A run's words, its length less its period apart, are equal for 16 words at least; so equal 16-word strings find every run.
OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
                  list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                              lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END))) AS c FROM documents),
h AS (SELECT r, doc_id, w, len(w) AS n, xor(c, 4294967295) AS h FROM d),
a AS (SELECT *, (h // 10) % greatest(n, 1) AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
t AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
g AS (SELECT r, i, array_to_string(list_slice(w, i + 1, i + 16), ' ') AS s FROM (SELECT r, w, unnest(range(n - 15)) AS i FROM t)),
e AS (SELECT x.r, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.r = y.r AND x.s = y.s AND y.i > x.i),
k AS (SELECT r, q, min(i) AS s, max(i) + 16 + q - min(i) AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e) GROUP BY r, q, island),
u AS (SELECT r, s, l, min(q) AS q FROM k WHERE l >= greatest(24, 3 * q) GROUP BY r, s, l),
b AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY CAST(l AS DOUBLE) / q DESC, s, q) AS place FROM u),
z AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM u GROUP BY r),
o AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM u),
v AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM t),
c AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM v ANTI JOIN o USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN z USING (r) LEFT JOIN (SELECT * FROM b WHERE place = 1) USING (r) LEFT JOIN c USING (r)
"""

OP13 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 2), ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
b AS (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.r < y.r GROUP BY 1, 2),
l AS (SELECT a, b FROM b JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(a, b) AS (SELECT r, r FROM d UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
m AS (SELECT c.a AS r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.b GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN m USING (r) LEFT JOIN n USING (r)
"""

OP12 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, c.r AS cr, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.x, c.x) AS BIGINT) AS score FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, cr) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.r, p.cr ORDER BY s.score DESC, s.vec_id, s.cr) AS INTEGER) AS rank
      FROM p JOIN s ON s.r = p.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
