"""DuckDB statements for the queries that SQL can express."""

from ledgerwash.llm.licenses import NOTICES, PHRASES

_TEMPLATES = ", ".join(f"({i}, '{label}', {i < len(PHRASES)}, '{text}')" for i, (label, text) in enumerate((*PHRASES, *NOTICES)))

ORACLE_SQL = {
    "op1_chat": r"""
WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL
  SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
                        (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
), rows AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(role) + 2 * len(regexp_extract_all(role, '[%<\n]')) + 1
                + length(text) + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
""",
    "op4_url_filter": r"""
WITH rules(host, path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), places AS (
  SELECT row_number() OVER () AS k, page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages)
), fits AS (
  SELECT p.k, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.k ORDER BY length(r.host || r.path) DESC) AS n
  FROM places p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM places p LEFT JOIN fits f ON p.k = f.k AND f.n = 1
""",
    "op7_licenses": r"""
WITH templates(no, label, base, text) AS (VALUES {templates}
), marks AS (
  SELECT no, label, base, len(w) - 2 AS votes, i - 1 AS tpos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT *, string_split(text, ' ') AS w FROM templates), unnest(range(1, len(w) - 1)) AS u(i)
), docs AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), spread AS (
  SELECT k, unnest(w) AS word, unnest(range(len(w))) AS pos FROM docs
), grams AS (
  SELECT k, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS gram
  FROM spread WINDOW o AS (PARTITION BY k ORDER BY pos)
), hits AS (
  SELECT k, no, label, base, votes, tpos, pos - tpos AS diagonal FROM grams JOIN marks USING (gram)
), diagonals AS (
  SELECT k, no, label, base, votes, diagonal, base AND count(*) = votes AS exact FROM hits
  GROUP BY k, no, label, base, votes, diagonal
), steps AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= 3 THEN 0 ELSE 1 END AS new
  FROM diagonals WINDOW w AS (PARTITION BY k, no ORDER BY diagonal)
), spans AS (
  SELECT *, sum(new) OVER (PARTITION BY k, no ORDER BY diagonal) AS span FROM steps
), seen AS (
  SELECT k, no, span, count(DISTINCT tpos) AS seen FROM hits JOIN spans USING (k, no, diagonal) GROUP BY k, no, span
), merged AS (
  SELECT k, label, base, seen / votes AS share, places, first_word, last_word
  FROM (SELECT k, no, label, base, votes, span, count(*) FILTER (WHERE exact) AS places,
               min(diagonal) FILTER (WHERE exact) AS first_word, max(diagonal) FILTER (WHERE exact) AS last_word
        FROM spans GROUP BY k, no, label, base, votes, span) JOIN seen USING (k, no, span)
), found AS (
  SELECT k, sum(places) AS n_base, min(first_word) AS first_word, max(last_word) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE places > 0) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE CASE WHEN base THEN places > 0 ELSE share >= 0.8 END) AS labels,
         max(share) FILTER (WHERE CASE WHEN base THEN places > 0 ELSE share >= 0.8 END) AS score
  FROM merged GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN found USING (k)
""",
    "op10_decontamination": r"""
WITH words AS (
  SELECT 'd' AS kind, row_number() OVER () AS k, doc_id AS id,
         regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, item_id,
         regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), spread AS (
  SELECT kind, k, unnest(w) AS word, unnest(range(len(w))) AS pos FROM words
), grammed AS (
  SELECT kind, k, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o
         || ' ' || lead(word, 4) OVER o AS gram
  FROM spread WINDOW o AS (PARTITION BY kind, k ORDER BY pos)
), listed AS (
  SELECT kind, k, list(gram ORDER BY pos) AS grams FROM grammed WHERE gram IS NOT NULL GROUP BY kind, k
), places AS (
  SELECT k AS item, len(grams) AS n, pos AS item_at, gram FROM grammed JOIN listed USING (kind, k) WHERE kind = 'b' AND gram IS NOT NULL
), spots AS (
  SELECT g.k, len(grams) AS held, g.pos AS dpos, g.gram FROM grammed g JOIN listed l ON g.kind = l.kind AND g.k = l.k
  WHERE g.kind = 'd' AND g.gram IN (SELECT gram FROM places)
), aligned AS (
  SELECT DISTINCT k, item, n, greatest(least(dpos, held - n), 0) AS start FROM spots JOIN places USING (gram)
), windows AS (
  SELECT a.k, a.item, d.grams[a.start + 1:a.start + a.n] AS w, b.grams AS g
  FROM aligned a JOIN listed d ON d.kind = 'd' AND d.k = a.k JOIN listed b ON b.kind = 'b' AND b.k = a.item
), shared AS (
  SELECT k, item, len(w) + len(g) AS sizes,
         list_sum(list_transform(list_distinct(g), lambda x: least(len(list_filter(w, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))) AS common
  FROM windows
), found AS (
  SELECT k, item, max(CAST(common AS DOUBLE) / CAST(sizes - common AS DOUBLE)) AS similarity FROM shared
  GROUP BY k, item HAVING max(CAST(common AS DOUBLE) / CAST(sizes - common AS DOUBLE)) >= 0.8
)
SELECT d.id AS doc_id, count(f.item) > 0 AS contaminated, count(f.item) AS n_items,
       coalesce(string_agg(CAST(f.item AS VARCHAR), ',' ORDER BY f.item), '') AS item_ids, max(f.similarity) AS similarity
FROM words d LEFT JOIN found f ON d.k = f.k WHERE d.kind = 'd' GROUP BY d.k, d.id
""",
}
ORACLE_SQL["op7_licenses"] = ORACLE_SQL["op7_licenses"].replace("{templates}", _TEMPLATES)
