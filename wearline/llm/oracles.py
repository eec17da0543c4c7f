"""DuckDB SQL, straight from the definitions, for operators whose result SQL can state."""

WORDS = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"

#: smallest node reachable over ``links(a, b)``; ``nodes(n)`` holds all
_REACH = """
both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT n, n AS m FROM nodes UNION SELECT r.n, e.b FROM reach r JOIN both_ e ON r.m = e.a),
comp AS (SELECT n, min(m) AS component_id FROM reach GROUP BY n)"""

OP2 = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
nodes AS (SELECT vec_id AS n FROM v),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
{_REACH}
SELECT n AS vec_id, (SELECT count(*) FROM both_ WHERE both_.a = comp.n) AS n_links, component_id, component_id = n AS kept FROM comp
"""

OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_transform({WORDS.format('text')}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w ELSE [] END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.x = y.x AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared.k >= 80 * (p.k + q.k - shared.k)),
nodes AS (SELECT doc_id AS n FROM d),
{_REACH}
SELECT comp.n AS doc_id, coalesce(n.k, 0) AS n_shingles, component_id, component_id = comp.n AS kept FROM comp LEFT JOIN n ON n.doc_id = comp.n
"""

OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT *, unnest(range(0, len(x) // 2 - 199)) AS i FROM d)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
step AS (SELECT *, i > lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) + 200 AS fresh FROM again),
run AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM step),
span AS (SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM run GROUP BY doc_id, g),
gap AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM span),
kept AS (
  SELECT doc_id, any_value(x) AS x, sum(e - s) AS n_removed, count(*) AS n_spans,
         string_agg(substr(x, 2 * p + 1, 2 * (s - p)), '' ORDER BY s) || substr(any_value(x), 2 * max(e) + 1) AS k
  FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (len(d.x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN d.x ELSE k END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP8 = f"""
WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS k, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: unsigned CRC-32 (of decimal numbers): ``key(id)`` in, ``crc(id, c)`` out
_CRC = """
byte AS (SELECT id, unnest(list_transform(split(id::VARCHAR, ''), lambda x: ascii(x))) AS b, unnest(range(length(id::VARCHAR))) AS i FROM key),
step AS (SELECT n, list_reduce(range(8), lambda acc, k: CASE WHEN acc & 1 = 1 THEN xor(3988292384::BIGINT, acc >> 1) ELSE acc >> 1 END, n::BIGINT) AS v FROM (SELECT unnest(range(256)) AS n)),
steps AS (SELECT list(v ORDER BY n) AS t FROM step),
crc AS (
  SELECT id, xor(4294967295::BIGINT, list_reduce(list(b ORDER BY i), lambda acc, x: xor(acc >> 8, t[(xor(acc, x::BIGINT) & 255) + 1]), 4294967295::BIGINT)) AS c
  FROM byte, steps GROUP BY id, t)"""


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


OP12 = f"""
WITH RECURSIVE key AS (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IS NOT NULL), {_CRC},
doc AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars')} AS head, text,
         CASE WHEN coalesce(c % 2 = 0, false) THEN replace(text, chr(10), '') ELSE text END AS seen FROM documents LEFT JOIN crc ON id = doc_id),
leaf AS (SELECT r, doc_id, source, sha256(head || {_field('text')}) AS leaf, sha256(head || {_field('seen')}) AS found FROM doc),
pos AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, found) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaf),
low AS (
  SELECT source, 0 AS lvl, idx, leaf AS d, n FROM pos
  UNION ALL
  SELECT source, lvl + 1, idx // 3, sha256(string_agg(d, '' ORDER BY idx)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY source, lvl, idx // 3, n),
sub AS (SELECT source, d, lvl AS h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, idx, d, n FROM sub
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(d, '' ORDER BY idx)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY lvl, idx // 3, n),
root AS (SELECT d AS root, lvl AS h FROM high WHERE n = 1),
near AS (
  SELECT a.source, a.lvl, a.idx, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM low a JOIN low b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL),
far AS (
  SELECT a.lvl, a.idx, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM high a JOIN high b ON a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL),
path AS (
  SELECT pos.r, near.lvl AS k, near.l, near.r AS t FROM pos JOIN near ON near.source IS NOT DISTINCT FROM pos.source AND near.idx = pos.idx // (3 ** near.lvl)::BIGINT
  UNION ALL
  SELECT pos.r, sub.h + far.lvl, far.l, far.r FROM pos JOIN sub ON sub.source IS NOT DISTINCT FROM pos.source JOIN far ON far.idx = sub.idx // (3 ** far.lvl)::BIGINT),
steps_ AS (SELECT r, list(l || '|' || t ORDER BY k) AS p FROM path GROUP BY r),
done AS (
  SELECT pos.*, sub.d AS subroot, root, coalesce(p, []) AS p,
         list_reduce(coalesce(p, []), lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2)), found) AS folded_root
  FROM pos JOIN sub ON sub.source IS NOT DISTINCT FROM pos.source CROSS JOIN root LEFT JOIN steps_ ON steps_.r = pos.r)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(p, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM done
"""

OP13 = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, md5(strlen(r) || ':' || r || x)) AS s FROM t GROUP BY conv_id),
key AS (SELECT conv_id AS id FROM own), {_CRC},
seq AS (
  SELECT o.conv_id, list_concat(coalesce(b.s, [])[1:c % 4], o.s[c % 4 + 1:]) AS s FROM own o JOIN crc ON id = o.conv_id LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
member AS (SELECT conv_id, len(s) AS n, d, s[1:d] AS p FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM seq)),
node AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE len({WORDS.format("coalesce(p[d].x, '')")}) END AS w FROM member GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY 1),
below AS (
  SELECT u.p, sum((v.n_convs - 1) * v.w)::BIGINT AS saved_tokens, count(*) FILTER (k.k IS NULL) AS n_leaves
  FROM node u JOIN node v ON v.d >= u.d AND v.p[1:u.d] = u.p LEFT JOIN kids k ON k.p = v.p GROUP BY u.p)
SELECT node.conv_id, node.d::BIGINT AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(k.k, 0) AS n_children, n_leaves, saved_tokens, node.ends_sha256
FROM node JOIN below ON below.p = node.p LEFT JOIN kids k ON k.p = node.p LEFT JOIN node up ON node.d > 0 AND up.d = node.d - 1 AND up.p = node.p[1:node.d - 1]
"""
