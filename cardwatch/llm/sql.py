"""SQL for the queries that SQL can express, as DuckDB runs it."""

from cardwatch.llm.licenses import templates

#: Jump consistent hashing with 64-bit arithmetic in HUGEINT, and CRC-32 from a table made by its rule.
SHARDS = """
WITH RECURSIVE
crc_table AS (
  SELECT list(list_reduce(list_prepend(range, range(8)),
              lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)
              ORDER BY range) AS t
  FROM range(256)),
texts AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                        lambda h: ('0x' || h)::BIGINT) AS bytes
  FROM documents),
digests AS (
  SELECT doc_id, size::BIGINT AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM texts, crc_table),
keys AS (
  SELECT DISTINCT doc_id,
         (coalesce(doc_id, -1)::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT AS key
  FROM documents),
jumps(doc_id, state, b, j) AS (
  SELECT doc_id, key, -1::BIGINT, 0::BIGINT FROM keys
  UNION ALL
  SELECT doc_id, s, j, floor((j + 1) * (2147483648.0::DOUBLE / ((s // 8589934592::HUGEINT) + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, b, j, (state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS s
        FROM jumps WHERE j < 25)),
shards AS (
  SELECT doc_id, (max(b) FILTER (b < 24))::INTEGER AS shard, max(b)::INTEGER AS grown_shard
  FROM jumps GROUP BY doc_id),
firsts AS (
  SELECT doc_id, ((key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT) // 8589934592::HUGEINT AS n
  FROM keys),
buckets AS (SELECT greatest(1, ceil(count(*) / 1200000))::HUGEINT AS n FROM documents)
SELECT d.doc_id, d.size, d.text_crc32, 'key' AS law, s.shard,
       row_number() OVER (PARTITION BY s.shard
                          ORDER BY (f.n + d.text_crc32) % k.n, d.doc_id, d.size, d.text_crc32) - 1 AS slot,
       s.grown_shard
FROM digests d
JOIN shards s ON d.doc_id IS NOT DISTINCT FROM s.doc_id
JOIN firsts f ON d.doc_id IS NOT DISTINCT FROM f.doc_id, buckets k
"""

#: Every query against every row.
TOP_K = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id IS DISTINCT FROM c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
WHERE rank <= 20
"""


#: One edit is a deletion that gives the other word, or the same word with one place left open.
VARIANTS = """
WITH RECURSIVE
crc_table AS (
  SELECT list(list_reduce(list_prepend(range, range(8)),
              lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)
              ORDER BY range) AS t
  FROM range(256)),
runs AS (
  SELECT doc_id, run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[a-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents)
  GROUP BY ALL),
hashed AS (
  SELECT run, c,
         xor(list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'),
                              lambda h: ('0x' || h)::BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM runs, crc_table),
words AS (
  SELECT word, sum(c)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0
                    THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c
        FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
shorter AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
opened AS (SELECT word, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS rest FROM places),
met AS (
  SELECT a.word, b.word AS other FROM opened a JOIN opened b USING (rest) WHERE a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.rest = w.word),
ranked AS (
  SELECT m.word, m.other, o.n AS other_n, count(*) OVER (PARTITION BY m.word) AS n_near,
         row_number() OVER (PARTITION BY m.word ORDER BY o.n DESC, m.other) AS r
  FROM met m JOIN words o ON o.word = m.other),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
         CASE WHEN b.other_n >= 2 * w.n THEN b.other END AS form,
         CASE WHEN b.other_n >= 2 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN ranked b ON b.word = w.word AND b.r = 1),
followed(word, root) AS (
  SELECT word, word FROM formed
  UNION ALL
  SELECT f.word, s.form FROM followed f JOIN formed s ON s.word = f.root WHERE s.form IS NOT NULL)
SELECT s.word, s.form, f.root, s.n, s.n_near, s.form_n
FROM formed s JOIN followed f ON f.word = s.word JOIN formed e ON e.word = f.root AND e.form IS NULL
"""

#: Every pair of a label.
TILES = """
WITH RECURSIVE
valid AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.93),
reached(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT e.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, r.least AS component_id, e.vec_id = r.least AS kept
FROM embeddings e
JOIN (SELECT vec_id, min(other) AS least FROM reached GROUP BY vec_id) r USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) l USING (vec_id)
"""


def _licenses() -> str:
    """Every block of every template, without filters."""
    rows = ",\n    ".join(
        f"({k}, '{t.label}', {str(t.base).lower()}, {t.need}, {[*t.phrase]})" for k, t in enumerate(templates())
    )
    return f"""
WITH templates(k, label, base, need, phrase) AS (VALUES
    {rows}),
sized AS (SELECT *, len(phrase)::BIGINT AS step, len(list_distinct(phrase)) AS size FROM templates),
texts AS (
  SELECT row_number() OVER () AS line, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
spread AS (
  SELECT line, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM texts),
template_words AS (SELECT DISTINCT k, unnest(phrase) AS word FROM sized),
held AS (
  SELECT s.line, t.k, b.block, count(DISTINCT s.word) AS n
  FROM spread s JOIN template_words w USING (word) JOIN sized t USING (k),
       LATERAL (SELECT unnest([s.pos // t.step, s.pos // t.step - 1]) AS block) b
  WHERE b.block >= 0
  GROUP BY ALL),
met AS (
  SELECT line, list(DISTINCT label) AS labels, max(n / size) AS score
  FROM held JOIN sized USING (k) WHERE NOT base AND n >= need GROUP BY line),
places AS (
  SELECT s.line, s.pos, t.label
  FROM spread s JOIN sized t ON t.base AND s.word = t.phrase[1]
  JOIN texts x ON x.line = s.line AND x.words[s.pos + 1 : s.pos + t.step] = t.phrase),
based AS (
  SELECT line, count(*) AS n, min(pos) AS first, max(pos) AS last, list(DISTINCT label) AS labels
  FROM places GROUP BY line)
SELECT x.doc_id, len(x.words)::BIGINT AS n_words, coalesce(b.n, 0) AS n_base,
       b.first AS first_word, b.last AS last_word,
       array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
       greatest(coalesce(m.score, 0), CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE 0 END)::DOUBLE AS score
FROM texts x LEFT JOIN met m USING (line) LEFT JOIN based b USING (line)
"""


LICENSES = _licenses()
