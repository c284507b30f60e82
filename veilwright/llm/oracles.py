"""DuckDB SQL for the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SPACELESS = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

OP1 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM win),
sizes AS (SELECT DISTINCT n FROM windows),
cand AS (SELECT r, s.n, unnest(range(1, len(w) - s.n + 2)) AS i, w FROM d, sizes s WHERE len(w) >= s.n),
hit AS (SELECT a.r, a.i, a.n, g.item_id FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM cand) a JOIN windows g ON a.g = g.g AND a.n = g.n),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""

OP2 = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, {_SPACELESS} AS t FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w AS nth
      FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(t) AS text_sha256 FROM r
"""


OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM r
"""

OP5 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 90 * (p.n + q.n - shared)),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(low.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.x = w.doc_id
"""


# The table of crc32, from its polynomial, and the sum of a text's bytes.
_CRC = "SELECT list_transform(range(0, 256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"


def _crc32(text: str) -> str:
    b = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda y: ('0x' || y)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {b}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


OP11 = rf"""
WITH RECURSIVE crc AS MATERIALIZED ({_CRC}),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE length(run) > 5 GROUP BY 1, 2),
h AS (SELECT run, n, {_crc32("doc_id || ':' || run")} AS h FROM runs, crc),
said AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM said WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
cut AS (SELECT word, n, left(word, i) || substr(word, i + 2) AS k, i FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
near AS MATERIALIZED (
  SELECT DISTINCT a, b, nb FROM (
    SELECT x.word AS a, y.word AS b, y.n AS nb FROM cut x JOIN cut y ON x.k = y.k AND x.i = y.i AND x.word <> y.word
    UNION ALL SELECT x.word, y.word, y.n FROM cut x JOIN w y ON x.k = y.word
    UNION ALL SELECT y.word, x.word, x.n FROM cut x JOIN w y ON x.k = y.word)),
best AS (SELECT a, count(*) AS n_near, min(struct_pack(m := -nb, b := b)) AS m FROM near GROUP BY a),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -m.m >= 5 * n THEN m.b END AS form, CASE WHEN -m.m >= 5 * n THEN -m.m END AS form_n FROM w LEFT JOIN best ON a = word),
way(word, root) AS (SELECT word, word FROM f UNION SELECT way.word, f.form FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.root, f.n, f.n_near, f.form_n FROM f JOIN way USING (word) JOIN f AS last ON last.word = way.root WHERE last.form IS NULL
"""

OP12 = """
WITH x AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
e AS (SELECT r, vec_id, label, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS q FROM x),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS o, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, o) AS nth FROM s WHERE same),
c AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.nth ORDER BY s.score DESC, s.vec_id, s.o) AS rank
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.nth <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM c WHERE rank <= 3
"""

OP13 = f"""
WITH crc AS MATERIALIZED ({_CRC}),
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents, crc),
u AS (SELECT d.*, j, ('0x' || substr(md5(concat_ws('|', j, k)), 1, 13))::BIGINT AS bits FROM d, range(0, 17) g(j)),
m AS (
  SELECT r, arg_max(j, bits) FILTER (j < 16) AS shard, max(bits) FILTER (j < 16) AS bits, arg_max(j, bits) AS grown_shard FROM u GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY bits, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM d JOIN m USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1, "op2_exact_dedup": OP2, "op3_warc": OP3, "op5_ngram_jaccard_join": OP5, "op11_spelling_variants": OP11, "op12_hard_negatives": OP12, "op13_sharding": OP13}
