"""DuckDB SQL of the operators on conversations, runs and repeated phrases: the same results by other ways (a walk over places instead of a chart,
matches of word pairs instead of Lyndon roots, a sort of all windows instead of automata)."""

#: table of CRC-32 (polynomial EDB88320) and the checksum of ``{0}``
_CRC_TABLE = """(SELECT list(list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY c) AS t
  FROM (SELECT unnest(range(256)) AS c))"""
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(range(1, length({0}) + 1), lambda i: CAST(ord({0}[i]) AS BIGINT))),
  lambda x, y: xor(x >> 8, t[CAST(xor(x, y) & 255 AS BIGINT) + 1])), 4294967295)"""

OP11_SQL = f"""
WITH RECURSIVE crc AS {_CRC_TABLE},
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
hit AS (SELECT src.*, {_CRC.format("id")} % 20 AS kind FROM src, crc),
dam AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE kind <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM dam),
seen AS (
  SELECT *, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS cut, left(role, 1) AS h,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
row_ AS (
  SELECT *, CASE WHEN cut = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM seen),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || h NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM row_ GROUP BY conv_id),
-- insertions (from, to, audit): none, one, two or three empty rows
ins(p, q, c, a) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (2, 3, 2, 'I'), (3, 2, 2, 'I'),
                           (0, 3, 4, 'II'), (1, 3, 4, 'II')),
leads(p, h, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edit AS (
  SELECT conv_id, i, p, p AS q, 3 AS c, 'D' AS e FROM row_, (SELECT unnest(range(4)) AS p)
  UNION ALL SELECT conv_id, i, p, q, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'K' FROM row_ JOIN leads USING (h) WHERE fault IS NULL OR fault = 'truncated'
  UNION ALL SELECT conv_id, i, p, q, CASE WHEN fault = 'truncated' THEN 3 ELSE 2 END, 'R' FROM row_, leads WHERE leads.h <> 's' AND (fault IS NULL OR fault = 'truncated')),
walk AS (
  SELECT conv_id, 0 AS i, q, CAST(c AS BIGINT) AS c, a FROM counted, ins WHERE p = 0
  UNION ALL
  SELECT conv_id, i, q, b.c, b.a FROM (
    SELECT w.conv_id, e.i, n.q, min(struct_pack(c := w.c + e.c + n.c, a := w.a || e.e || n.a)) AS b
    FROM walk w JOIN edit e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.p = w.q JOIN ins n ON n.p = e.q
    GROUP BY w.conv_id, e.i, n.q)),
best AS (
  SELECT k.conv_id, min(struct_pack(c := w.c, a := w.a)) AS b
  FROM counted k JOIN walk w ON w.conv_id IS NOT DISTINCT FROM k.conv_id AND w.i = k.n WHERE w.q IN (0, 3) GROUP BY k.conv_id),
letter AS (SELECT conv_id, b.a AS a, unnest(range(1, length(b.a) + 1)) AS j FROM best),
placed AS (
  SELECT conv_id, j, a[j] AS e, length(replace(left(a, j), 'I', '')) AS i, length(replace(left(a, j), 'D', '')) AS o FROM letter),
begun AS (  -- 1 if the first turn that is left is a kept system row
  SELECT p.conv_id, max(CASE WHEN p.o = 1 AND p.e = 'K' AND r.h = 's' THEN 1 ELSE 0 END) AS s
  FROM placed p LEFT JOIN row_ r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i WHERE p.e <> 'D' GROUP BY p.conv_id),
line AS (
  SELECT p.conv_id, p.j, CASE WHEN p.e = 'K' THEN r.role WHEN (p.o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN p.e = 'I' THEN '' ELSE r.text END AS l
  FROM placed p JOIN begun g ON g.conv_id IS NOT DISTINCT FROM p.conv_id LEFT JOIN row_ r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i WHERE p.e <> 'D'),
repaired AS (SELECT conv_id, string_agg(l, chr(10) ORDER BY j) AS text FROM line GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT v.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost,
       coalesce(b.a, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM every v LEFT JOIN counted k ON k.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM v.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM v.conv_id
"""

OP12_SQL = f"""
WITH crc AS {_CRC_TABLE},
doc AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
hash AS (SELECT doc_id, w, len(w) AS n, {_CRC.format("id")} AS h FROM doc, crc),
tail AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM hash),
d AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE w END AS w FROM tail),
gram AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 5)) AS i FROM d WHERE len(w) >= 12)),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM gram x JOIN gram y ON x.doc_id = y.doc_id AND x.s = y.s AND y.i > x.i),
isle AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair),
stretch AS (SELECT doc_id, q, min(i) AS s, max(i) + 6 + q AS e FROM isle GROUP BY doc_id, q, k),
run AS (SELECT doc_id, s, e - s AS m, min(q) AS q FROM stretch WHERE e - s >= greatest(12, 2 * q) GROUP BY doc_id, s, e),
summed AS (
  SELECT doc_id, count(*) AS n_runs, max(struct_pack(m := m, s := -s, q := -q)) AS b, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS l
  FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM run),
word AS (SELECT doc_id, i, w[i + 1] AS v FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d)),
kept AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(-b.s AS BIGINT) AS start, CAST(b.m AS BIGINT) AS length, CAST(-b.q AS BIGINT) AS period,
       CAST(1000 * b.m // -b.q AS BIGINT) AS exponent_milli, sha256(coalesce(l, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN summed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS nth FROM win) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM later),
word AS (SELECT doc_id, p, w[p] AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT doc_id, string_agg(v, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
