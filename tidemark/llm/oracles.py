"""DuckDB SQL of the corpus queries that it can run on whole small tables."""

from __future__ import annotations

_UPPER, _LOWER = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))


def _grams(words: str) -> str:
    return f"""CASE WHEN len({words}) >= 5 THEN list_distinct(list_transform(range(1, len({words}) - 3), lambda i: array_to_string({words}[i : i + 4], ' ')))
      WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE [] END"""


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


_REACHED = "reached AS (SELECT DISTINCT a AS id, a AS c FROM links UNION SELECT l.b, r.c FROM reached r JOIN links l ON l.a = r.id)"

LINES = f"""WITH lines AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
  grams AS (SELECT doc_id, line_no, row_number() OVER (ORDER BY doc_id, line_no) AS id, list_sort({_grams('w')}) AS g FROM (SELECT doc_id, line_no, {_words('lower(line)')} AS w FROM lines)),
  sets AS MATERIALIZED (SELECT doc_id, line_no, id, g, min(id) OVER (PARTITION BY g) AS head FROM grams WHERE len(g) > 0),
  tokens AS MATERIALIZED (SELECT id, len(g) AS n, unnest(g) AS t FROM sets WHERE id = head),
  near AS (SELECT b.id FROM tokens a JOIN tokens b ON a.t = b.t AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
  gone AS (SELECT doc_id, line_no FROM sets WHERE id <> head OR id IN (SELECT id FROM near)),
  of AS (SELECT doc_id, count(*) AS n, string_agg(line_no, ',' ORDER BY line_no) AS removed FROM gone GROUP BY 1)
  SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(n, 0) AS n_removed, coalesce(removed, '') AS removed_lines
  FROM documents LEFT JOIN of USING (doc_id)"""

NGRAMS = f"""WITH RECURSIVE sets AS MATERIALIZED (SELECT doc_id, {_grams('w')} AS g FROM (SELECT doc_id, {_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents)),
  tokens AS MATERIALIZED (SELECT doc_id AS id, len(g) AS n, unnest(g) AS t FROM sets),
  pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n
    HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
  links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), {_REACHED}
  SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id FROM sets LEFT JOIN (SELECT id, min(c) AS c FROM reached GROUP BY 1) ON id = doc_id"""

VECTORS = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
  links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9), {_REACHED},
  known AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1), parts AS (SELECT id AS vec_id, min(c) AS c FROM reached GROUP BY 1)
  SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
  FROM embeddings LEFT JOIN known USING (vec_id) LEFT JOIN parts USING (vec_id)"""

# the CRC-32 bit by bit: a byte is added, then come eight steps
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_concat(flatten(list_transform(string_split({0}, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [unicode(c), -1, -1, -1, -1, -1, -1, -1, -1] ELSE [195, -1, -1, -1, -1, -1, -1, -1, -1, unicode(c) - 64, -1, -1, -1, -1, -1, -1, -1, -1] END)), []::BIGINT[]),
  lambda h, b: CASE WHEN b >= 0 THEN xor(h, b) WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END), 4294967295)"""

SPELLING = f"""WITH RECURSIVE found AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
  runs AS (SELECT id, run, count(*) AS k FROM found GROUP BY ALL),
  hashed AS (SELECT run, k, {_CRC.format("id || ':' || run")} AS h FROM runs),
  words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM hashed),
  vocab AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
  cut AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM vocab),
  near AS MATERIALIZED (SELECT x.word, y.word AS near FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION SELECT x.word, v.word FROM cut x JOIN vocab v ON x.a || x.b = v.word UNION SELECT v.word, x.word FROM cut x JOIN vocab v ON x.a || x.b = v.word),
  best AS (SELECT near.word, count(*) AS n_near, first({{'w': near, 'n': v.n}} ORDER BY v.n DESC, encode(near)) AS f FROM near JOIN vocab v ON v.word = near GROUP BY near.word),
  forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN f.n >= 5 * n THEN f.w END AS form, CASE WHEN f.n >= 5 * n THEN f.n END AS form_n FROM vocab LEFT JOIN best USING (word)),
  path AS (SELECT word, word AS here, 0 AS d FROM forms UNION ALL SELECT p.word, f.form, d + 1 FROM path p JOIN forms f ON f.word = p.here WHERE f.form IS NOT NULL),
  roots AS (SELECT word, arg_max(here, d) AS root FROM path GROUP BY word)
  SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""

DIVERGENCE = """WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
  t AS MATERIALIZED (SELECT lang, source, r, unnest(w) AS term FROM d),
  kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
  langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
  counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
  groups AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
  p AS MATERIALIZED (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.total + 5 * v) AS p, 1 + 1000000000::HUGEINT * (k.n + 5) // (l.total + 5 * v) AS q
    FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
  pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS s FROM p x JOIN p y USING (lang, term) GROUP BY ALL) z ON z.lang = a.lang AND z.source = a.source AND z.other = b.source),
  all_ AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
  FROM all_ QUALIFY part = 'pair' OR rank <= 50"""
