"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"

MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce({WORDS}, 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3.0::DOUBLE) OVER w, 0))
          / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM sources
  WINDOW w AS (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(source_size * 3.0::DOUBLE, (SELECT max(level) FROM levels) * weight) AS target FROM levels)
SELECT s.doc_id, s.size, t.source_size, t.target,
       ((CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END
         + CASE WHEN source_size > 0 AND u < target / source_size - floor(target / source_size) THEN 1 ELSE 0 END) * s.size)::BIGINT AS taken
FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
"""

B32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
k AS (SELECT body, max(page_id) AS keeper FROM p GROUP BY body),
d AS (SELECT page_id, keeper, strlen(p.body) AS payload_bytes, hex, p.body FROM p JOIN k ON p.body = k.body)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr({B32}, 1 + (
         (('0x' || substr(hex || '000', 1 + (i * 5) // 4, 3))::INT >> (12 - 5 - (i * 5) % 4)) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM d
"""

VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
"""

LINES = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS MATERIALIZED (SELECT doc_id, pos, line, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS ws FROM l),
c AS MATERIALIZED (SELECT ws, len(ws) AS n, min((doc_id, pos)) AS first FROM s WHERE len(ws) > 0 GROUP BY ws),
df AS (SELECT w, count(*) AS df FROM (SELECT unnest(ws) AS w FROM c) GROUP BY w),
o AS (SELECT c.first, x.w, row_number() OVER (PARTITION BY c.first ORDER BY df.df, x.w) AS i, c.n
      FROM c, (SELECT first AS f, unnest(ws) AS w FROM c) x, df WHERE c.first = x.f AND x.w = df.w),
p AS MATERIALIZED (SELECT first, w, n FROM o WHERE i <= n - (4 * n + 4) // 5 + 1),
pairs AS (SELECT DISTINCT a.first AS f, b.first AS e FROM p a JOIN p b ON a.w = b.w AND b.first < a.first AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
gone AS (
  SELECT DISTINCT f FROM pairs JOIN c a ON a.first = f JOIN c b ON b.first = e
  WHERE 5 * len(list_intersect(a.ws, b.ws)) >= 4 * (a.n + b.n - len(list_intersect(a.ws, b.ws)))),
fate AS (
  SELECT s.doc_id, s.pos, s.line, len(s.ws) = 0 OR ((s.doc_id, s.pos) = c.first AND c.first NOT IN (SELECT f FROM gone)) AS keep
  FROM s LEFT JOIN c ON s.ws = c.ws)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '') AS text, count(*) FILTER (NOT keep)::BIGINT AS n_removed
FROM fate GROUP BY doc_id
"""

PHRASES = r"""
WITH lang_of AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, d, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM lang_of),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, m, list_aggregate(ws[i:i + m - 1], 'string_agg', ' ') AS phrase
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM lists, range(1, 6) t(m) WHERE len(ws) >= m)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE f >= 100),
cand AS (SELECT * FROM often WHERE m >= 2),
parts AS (
  SELECT lang, m, phrase, f AS a, unnest(range(1, m)) AS k, ws FROM cand),
cuts AS (
  SELECT p.lang, p.phrase, p.m, p.a, p.k, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * p.a * n.n) // (x.f * y.f) AS score
  FROM parts p JOIN often x ON x.lang = p.lang AND x.phrase = list_aggregate(p.ws[1:p.k], 'string_agg', ' ')
  JOIN often y ON y.lang = p.lang AND y.phrase = list_aggregate(p.ws[p.k + 1:], 'string_agg', ' ')
  JOIN n ON n.lang = p.lang),
least_cut AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
  SELECT lang, list_aggregate(ws[i:i + s - 1], 'string_agg', ' ') AS phrase, max(f) AS f
  FROM (SELECT lang, ws, f, s, unnest(range(1, m - s + 2)) AS i FROM cand, range(2, 5) t(s) WHERE s < m) GROUP BY ALL),
kept AS (
  SELECT c.* FROM least_cut c LEFT JOIN held h ON h.lang = c.lang AND h.phrase = c.phrase WHERE h.f IS NULL OR 100 * h.f < 100 * c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C")::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""

#: The crc32 of a text's bytes: eight steps a byte, which enters at the first.
CRC = "(xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(range(strlen({x})), lambda i: [('0x' || substr(hex(encode({x})), 2 * i::INT + 1, 2))::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT]))), lambda c, b: CASE WHEN xor(c, b) % 2 = 1 THEN xor(xor(c, b) // 2, 3988292384::UBIGINT) ELSE xor(c, b) // 2 END), 4294967295::UBIGINT))"

REPAIR = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
dealt AS (SELECT *, {CRC.format(x="name")} % 20 AS k FROM keyed),
damaged AS (
  SELECT conv_id, c, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM dealt),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged),
r AS MATERIALIZED (
  SELECT c, turn, role, text, i, substr(role, 1, 1) AS x, lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault FROM placed),
s AS (
  SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM r),
counts AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM s GROUP BY c),
-- costs to go before row i + 1: nothing yet (b), after s, u and a
back AS (
  SELECT c, n AS i, 0::BIGINT AS b, 4::BIGINT AS s, 2::BIGINT AS u, 0::BIGINT AS a FROM counts
  UNION ALL
  SELECT c, i, least(b, 2 + least(u, 2 + a)) AS b, least(s, 2 + least(u, 2 + a)) AS s, least(u, 2 + a) AS u, least(a, 2 + u) AS a FROM (
    SELECT k.c, k.i - 1 AS i,
      CASE WHEN gone THEN 3 + b ELSE least(3 + b, 2 + cut + u, CASE x WHEN 's' THEN cut + k.s WHEN 'u' THEN cut + u END) END AS b,
      CASE WHEN gone THEN 3 + k.s ELSE least(3 + k.s, 2 + cut + u, CASE x WHEN 'u' THEN cut + u END) END AS s,
      CASE WHEN gone THEN 3 + u ELSE least(3 + u, 2 + cut + a, CASE x WHEN 'a' THEN cut + a END) END AS u,
      CASE WHEN gone THEN 3 + a ELSE least(3 + a, 2 + cut + u, CASE x WHEN 'u' THEN cut + u END) END AS a
    FROM back k JOIN s ON s.c = k.c AND s.i = k.i)),
cost AS MATERIALIZED (SELECT c, i, unnest(['b', 's', 'u', 'a']) AS g, unnest([b, s, u, a]) AS go FROM back),
-- every edit from place i and state g to place j and state h
moves AS MATERIALIZED (
  SELECT k.c, k.i, k.g, e.edit, CASE WHEN e.edit = 'I' THEN k.i ELSE k.i + 1 END AS j,
         CASE e.edit WHEN 'D' THEN k.g WHEN 'K' THEN s.x ELSE CASE WHEN k.g = 'u' THEN 'a' ELSE 'u' END END AS h,
         CASE e.edit WHEN 'D' THEN 3 WHEN 'I' THEN 2 WHEN 'R' THEN 2 + s.cut ELSE s.cut END AS price, k.go, s.role, s.text
  FROM cost k CROSS JOIN (VALUES ('D'), ('I'), ('K'), ('R')) e(edit) LEFT JOIN s ON s.c = k.c AND s.i = k.i + 1
  WHERE e.edit IN ('D', 'I') AND (s.i IS NOT NULL OR e.edit = 'I')
     OR s.i IS NOT NULL AND NOT s.gone AND (e.edit = 'R' OR e.edit = 'K' AND k.g || s.x IN ('bs', 'bu', 'su', 'ua', 'au'))),
tight AS MATERIALIZED (
  SELECT m.* FROM moves m JOIN cost k ON k.c = m.c AND k.i = m.j AND k.g = m.h WHERE m.go = m.price + k.go
  QUALIFY row_number() OVER (PARTITION BY m.c, m.i, m.g ORDER BY m.edit) = 1),
walk AS (
  SELECT c, 0::BIGINT AS i, 'b' AS g, '' AS audit, []::VARCHAR[] AS made FROM counts
  UNION ALL
  SELECT w.c, t.j, t.h, audit || edit,
    CASE edit WHEN 'D' THEN made WHEN 'K' THEN list_append(made, role || ':' || text)
      ELSE list_append(made, CASE t.h WHEN 'u' THEN 'user:' ELSE 'assistant:' END || CASE edit WHEN 'R' THEN text ELSE '' END) END
  FROM walk w JOIN tight t ON t.c = w.c AND t.i = w.i AND t.g = w.g),
ends AS (SELECT w.* FROM walk w LEFT JOIN tight t ON t.c = w.c AND t.i = w.i AND t.g = w.g WHERE t.c IS NULL),
ids AS (SELECT DISTINCT conv_id, c FROM keyed)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(k.go, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counts USING (c) LEFT JOIN ends USING (c) LEFT JOIN cost k ON k.c = ids.c AND k.i = 0 AND k.g = 'b'
"""

CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
t AS (
  SELECT *, length('<|im_start|>') + length(replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '|', '\p')) + 1
         + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length('<|im_end|>') + 1 AS chars,
         CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS x FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       regexp_full_match(string_agg(x, '' ORDER BY turn NULLS FIRST, role, text), 's?(ua)+') AS legal
FROM t GROUP BY conv_id
"""

ORACLES: dict[str, str] = {"op2_vectors": VECTORS, "op4_lines": LINES, "op6_mixing": MIXING, "op7_warc": WARC, "op11_phrases": PHRASES, "op12_repair": REPAIR, "op13_chat": CHAT}
