"""DuckDB SQL for the queries whose results SQL can express."""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

CHAT_FORMAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + 2 * length(role) - length(translate(role, '\#<:' || chr(10), '')) + 2 * length(text) - length(translate(text, '\#<', ''))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

MINHASH_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) AS BIGINT) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT DISTINCT doc_id, md5(array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN m ON m.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, CAST(len(w) AS BIGINT) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT r, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + k AS j FROM rep, range(35) g(k)),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, CAST(len(w) AS BIGINT) + 1)) AS j FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS k FROM word ANTI JOIN gone USING (r, j) GROUP BY r),
cut AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN cut USING (r)"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m ON m.x = vec_id"""

#: crc32 of a word is worked out from the bits of the polynomial, for each different word once.
IMPORTANCE = r"""
WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark),
w AS (SELECT r, unnest(w) AS x FROM d),
v AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM w UNION SELECT x FROM b)),
k AS (SELECT x, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(h), 2), lambda i: CAST(16 * (strpos('0123456789ABCDEF', substr(h, i, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, i + 1, 1)) - 1 AS BIGINT))),
  lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM v, crc),
s AS (SELECT bucket, count(*) AS n FROM w JOIN k USING (x) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM b JOIN k USING (x) GROUP BY bucket),
g AS (SELECT s.bucket, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM s) + 10000))::DOUBLE / ((s.n + 1) * (coalesce((SELECT sum(n) FROM t), 0) + 10000))::DOUBLE)) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
f AS (SELECT r, sum(gain) AS weight FROM w JOIN k USING (x) JOIN g USING (bucket) GROUP BY r),
e AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN f USING (r)),
o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM o"""

#: On the given pages the text is what stands in the article; blocks end at tags that are not inline.
HTML_EXTRACTION = r"""
WITH a AS (SELECT row_number() OVER () AS r, page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages),
b AS (SELECT r, unnest(regexp_split_to_array(regexp_replace(x, '</?(b|i|a|em|strong|span)( [^>]*)?>', '', 'g'), '<[^>]*>')) AS t, unnest(range(len(regexp_split_to_array(regexp_replace(x, '</?(b|i|a|em|strong|span)( [^>]*)?>', '', 'g'), '<[^>]*>')))) AS i FROM a),
c AS (SELECT r, i, trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;', '&'), '[\x09-\x0D ]+', ' ', 'g')) AS t FROM b),
j AS (SELECT r, string_agg(regexp_replace(t, '&amp$', '&'), chr(10) ORDER BY i) AS text FROM c WHERE t <> '' GROUP BY r)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM a LEFT JOIN j USING (r)"""

ORACLES = {"op2_chat_format": CHAT_FORMAT, "op5_minhash_dedup": MINHASH_DEDUP, "op8_substring_dedup": SUBSTRING_DEDUP, "op9_embedding_dedup": EMBEDDING_DEDUP, "op12_importance_resampling": IMPORTANCE, "op13_html_extraction": HTML_EXTRACTION}
