"""DuckDB SQL with the rows of each query that SQL can express."""

from __future__ import annotations

_INTER = """inter AS (SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(epoch(o_orderdate) AS BIGINT) AS ts,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey) AS seq
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
_META = """meta AS (SELECT p_partkey AS item_id, p_name AS title, CASE WHEN p_partkey % 19 <> 0 THEN p_type END AS main_category,
  CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS store, CAST(p_size % 5 + 1 AS DOUBLE) AS average_rating,
  CAST(p_size AS BIGINT) AS rating_number, CASE WHEN p_partkey % 17 <> 0 THEN p_retailprice END AS price FROM part)"""
_CLICKS = """clicks AS (SELECT user_id, (event_id * 7919) % (SELECT count(*) FROM documents) AS item_id, epoch_us(ts) AS ts
  FROM events WHERE event_type IN ('view', 'click', 'purchase')), cseen AS (SELECT DISTINCT user_id, item_id FROM clicks)"""
_SPLIT = f"""{_INTER}, numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS r,
  count(*) OVER (PARTITION BY user_id) AS n FROM inter),
  train AS (SELECT user_id, item_id, ts, seq FROM numbered WHERE NOT (n >= 5 AND r > n - greatest(1, n // 5))),
  val AS (SELECT user_id, item_id, ts, seq FROM numbered WHERE n >= 5 AND r > n - greatest(1, n // 5))"""


def _popular(inter: str, users: str, k: int, pool: int = 50, name: str = "recs") -> str:
    return f"""{name} AS (SELECT user_id, item_id, n, rank FROM (SELECT u.user_id, p.item_id, p.n,
      row_number() OVER (PARTITION BY u.user_id ORDER BY p.n DESC, p.item_id) AS rank
      FROM (SELECT DISTINCT user_id FROM {users}) u
      CROSS JOIN (SELECT item_id, count(*) AS n FROM {inter} GROUP BY 1 ORDER BY n DESC, item_id LIMIT {pool}) p
      WHERE NOT EXISTS (SELECT 1 FROM {inter} s WHERE s.user_id = u.user_id AND s.item_id = p.item_id)) WHERE rank <= {k})"""


def _recall(recs: str, targets: str) -> str:
    return f"""(SELECT round(coalesce(avg(coalesce(h, 0) / n), 0), 6) FROM (SELECT user_id, count(*) AS n FROM {targets} GROUP BY 1)
      LEFT JOIN (SELECT user_id, count(*) AS h FROM (SELECT DISTINCT user_id, item_id FROM {targets}) JOIN
      (SELECT DISTINCT user_id, item_id FROM {recs}) USING (user_id, item_id) GROUP BY 1) USING (user_id))"""


def _features(inter: str = "inter") -> str:
    return f"""itemf AS (SELECT item_id, ln(1 + coalesce(n, 0)) AS item_popularity, main_category, store, average_rating,
      ln(1 + rating_number) AS log_rating_number, price FROM (SELECT item_id, count(*) AS n FROM {inter} GROUP BY 1) FULL JOIN meta USING (item_id)),
    aug AS (SELECT i.user_id, f.* FROM {inter} i LEFT JOIN itemf f USING (item_id)),
    userf AS (SELECT user_id, ln(1 + count(*)) AS user_interaction_count, avg(price) AS user_avg_price, avg(average_rating) AS user_avg_item_rating,
      avg(log_rating_number) AS user_avg_log_rating_number, count(DISTINCT main_category) AS user_category_diversity,
      count(DISTINCT store) AS user_store_diversity FROM aug GROUP BY 1),
    modes AS (SELECT user_id,
      coalesce((SELECT v FROM (SELECT user_id AS u, main_category AS v, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, main_category) AS r
        FROM aug WHERE main_category IS NOT NULL GROUP BY 1, 2) WHERE r = 1 AND u = x.user_id), 'UNKNOWN') AS user_dominant_category,
      coalesce((SELECT v FROM (SELECT user_id AS u, store AS v, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, store) AS r
        FROM aug WHERE store IS NOT NULL GROUP BY 1, 2) WHERE r = 1 AND u = x.user_id), 'UNKNOWN') AS user_dominant_store
      FROM (SELECT DISTINCT user_id FROM {inter}) x)"""


_CROSS = """CAST(coalesce(main_category = user_dominant_category, false) AS INT) AS category_match,
  CAST(coalesce(store = user_dominant_store, false) AS INT) AS store_match"""


def _similarity(inter: str) -> str:
    return f"""ui AS (SELECT user_id, item_id, CAST(count(*) AS DOUBLE) AS c FROM {inter} GROUP BY 1, 2),
    unit AS (SELECT user_id, item_id, c / sqrt(sum(c * c) OVER (PARTITION BY item_id)) AS w FROM ui),
    sim AS (SELECT a.item_id AS item_i, b.item_id AS item_j, sum(a.w * b.w) AS sim FROM unit a JOIN unit b
      ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2)"""


def _decay(inter: str, tau: float) -> str:
    return f"""decay AS (SELECT user_id, item_id, sum(w) AS w FROM (SELECT user_id, item_id,
      exp(-(max(ts) OVER (PARTITION BY user_id) - ts) / {tau!r}) AS w FROM {inter}) GROUP BY 1, 2)"""


_TAU = 365 * 24 * 60 * 60.0
_COOC = f"""{_CLICKS}, {_similarity('clicks')}, {_decay('clicks', _TAU * 1e6)},
  cooc AS (SELECT user_id, item_j AS item_id, sum(w * sim) AS score FROM decay JOIN sim ON item_id = item_i GROUP BY 1, 2)"""
_BM25_TERMS = r"post AS (SELECT doc_id AS item_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '[\s\x1c-\x1f\x85\x{A0}\x{2000}-\x{200A}\x{3000}]+')) AS term FROM documents) WHERE term <> '' GROUP BY 1, 2)"
_BM25 = f"""{_BM25_TERMS}, raw AS (SELECT term, ln((SELECT count(*) FROM documents) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY 1),
  idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
  dl AS (SELECT item_id, sum(tf) AS dl FROM post GROUP BY 1),
  wt AS (SELECT item_id, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / ((SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents)))) AS w
    FROM post JOIN dl USING (item_id) JOIN idf USING (term)),
  prof AS (SELECT user_id, term, CAST(sum(tf) AS DOUBLE) AS q FROM cseen JOIN post USING (item_id) GROUP BY 1, 2),
  matched AS (SELECT user_id, w.item_id, sum(q * w) AS score FROM prof JOIN wt w USING (term) GROUP BY 1, 2)"""
_TFIDF_TERMS = r"""words AS (SELECT doc_id AS item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
  terms AS (SELECT item_id, list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM words)"""
_VOCAB = f"""{_TFIDF_TERMS}, cnt AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(t) AS term FROM terms) GROUP BY 1, 2),
  vocab AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM cnt GROUP BY 1
    HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM documents) ORDER BY total DESC, term LIMIT 20000)"""
_TFIDF = f"""{_VOCAB}, x AS (SELECT item_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS x FROM cnt JOIN vocab USING (term)),
  wt AS (SELECT item_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS w FROM x),
  p0 AS (SELECT user_id, term, sum(w) AS q FROM cseen JOIN wt USING (item_id) GROUP BY 1, 2),
  prof AS (SELECT user_id, term, q / sqrt(sum(q * q) OVER (PARTITION BY user_id)) AS q FROM p0),
  matched AS (SELECT user_id, w.item_id, sum(q * w) AS score FROM prof JOIN wt w USING (term) GROUP BY 1, 2)"""
_CAND = """cand AS (SELECT user_id, item_id FROM (SELECT DISTINCT user_id FROM clicks) CROSS JOIN
  (SELECT item_id FROM (SELECT item_id, count(*) AS n FROM clicks GROUP BY 1 ORDER BY n DESC, item_id LIMIT 20) UNION ALL SELECT -1))"""


def _top(scores: str, k: int, digits: int = 9, seen: str = "cseen", name: str = "top") -> str:
    return f"""{name} AS (SELECT user_id, item_id, score, rank FROM (SELECT s.user_id, s.item_id, score,
      row_number() OVER (PARTITION BY s.user_id ORDER BY round(score, {digits}) DESC, s.item_id) AS rank
      FROM {scores} s ANTI JOIN {seen} x ON s.user_id = x.user_id AND s.item_id = x.item_id) WHERE rank <= {k})"""


_FACTORS = """uf AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings WHERE vec_id % 2 = 0),
  vf AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings WHERE vec_id % 2 = 1)"""
_DOT = f"{_FACTORS}, scored AS (SELECT u.id AS user_id, v.id AS item_id, list_dot_product(u.f, v.f) AS score FROM uf u CROSS JOIN vf v)"
_TRIPLES = f"""{_FACTORS}, tri AS (SELECT u.id AS user_id, i.id AS item_id, j.id AS negative_id, u.f AS fu, i.f AS fi, j.f AS fj,
  list_dot_product(u.f, i.f) - list_dot_product(u.f, j.f) AS x FROM uf u JOIN vf i ON i.id = u.id + 1 JOIN vf j ON j.id = u.id + 3)"""
_SCORES = f"""{_INTER}, {_META}, {_features()}, pairs AS (SELECT DISTINCT user_id, item_id FROM inter),
  scores AS (SELECT user_id, item_id, item_popularity, coalesce(price, 0.0) AS price FROM pairs JOIN itemf USING (item_id)),
  mm AS (SELECT user_id, item_id,
    CASE WHEN max(item_popularity) OVER u = min(item_popularity) OVER u THEN 0.0 ELSE (item_popularity - min(item_popularity) OVER u) / (max(item_popularity) OVER u - min(item_popularity) OVER u) END AS item_popularity,
    CASE WHEN max(price) OVER u = min(price) OVER u THEN 0.0 ELSE (price - min(price) OVER u) / (max(price) OVER u - min(price) OVER u) END AS price
    FROM scores WINDOW u AS (PARTITION BY user_id)),
  ens AS (SELECT user_id, item_id, score, rank FROM (SELECT user_id, item_id, 0.5 * item_popularity + 0.5 * price AS score,
    row_number() OVER (PARTITION BY user_id ORDER BY round(0.5 * item_popularity + 0.5 * price, 9) DESC, item_id) AS rank FROM mm) WHERE rank <= 10)"""
_TRAIN = f"""{_SPLIT}, {_META}, {_features('train')}, {_popular('train', 'val', 50, name='pool')}"""
# the same on clicks without each user's last ones
_CTRAIN = """every AS (SELECT user_id, (event_id * 7919) % (SELECT count(*) FROM documents) AS item_id, epoch_us(ts) AS ts
  FROM events WHERE event_type IN ('view', 'click', 'purchase')),
  placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM every),
  clicks AS (SELECT user_id, item_id, ts FROM placed WHERE NOT (n >= 5 AND r > n - greatest(1, n // 5))),
  cval AS (SELECT user_id, item_id FROM placed WHERE n >= 5 AND r > n - greatest(1, n // 5)), cseen AS (SELECT DISTINCT user_id, item_id FROM clicks)"""
_HELD = f"""{_COOC.replace(_CLICKS, _CTRAIN)}, {_TFIDF}, uf AS (SELECT vec_id // 2 AS id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings WHERE vec_id % 2 = 0 AND vec_id // 2 IN (SELECT user_id FROM cval)),
  vf AS (SELECT vec_id // 2 AS id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings WHERE vec_id % 2 = 1),
  dots AS (SELECT u.id AS user_id, v.id AS item_id, list_dot_product(u.f, v.f) AS score FROM uf u CROSS JOIN vf v),
  {_top('dots', 20, name='a')}, {_top('matched', 20, name='b')}, {_top('cooc', 20, name='c')},
  two AS (SELECT user_id, item_id FROM a UNION SELECT user_id, item_id FROM b), three AS (SELECT * FROM two UNION SELECT user_id, item_id FROM c),
  cands AS (SELECT user_id, item_id, coalesce(a.rank - 1, -1) AS bpr_rank, coalesce(b.rank - 1, -1) AS tfidf_rank, coalesce(c.rank - 1, -1) AS cooc_rank, d.score AS bpr_score,
    CASE WHEN item_id IN (SELECT doc_id FROM documents) AND user_id IN (SELECT user_id FROM prof) THEN coalesce(m.score, 0.0) END AS tfidf_score,
    CASE WHEN item_id IN (SELECT item_id FROM clicks) AND user_id IN (SELECT user_id FROM clicks) THEN coalesce(o.score, 0.0) END AS cooc_score
    FROM three LEFT JOIN a USING (user_id, item_id) LEFT JOIN b USING (user_id, item_id) LEFT JOIN c USING (user_id, item_id) LEFT JOIN dots d USING (user_id, item_id)
    LEFT JOIN matched m USING (user_id, item_id) LEFT JOIN cooc o USING (user_id, item_id) WHERE user_id IN (SELECT user_id FROM cval))"""


def _scaled(c: str) -> str:
    low, high = f"min(coalesce({c}, 0)) OVER w", f"max(coalesce({c}, 0)) OVER w"
    return f"CASE WHEN {high} = {low} THEN 0.0 ELSE (coalesce({c}, 0) - {low}) / ({high} - {low}) END"


ORACLES = {
    "interactions_ordered": f"WITH {_INTER} SELECT * FROM inter",
    "user_history": f"WITH {_INTER} SELECT user_id, string_agg(item_id, ',' ORDER BY ts, seq) AS items, count(*) AS n FROM inter GROUP BY 1",
    "user_seen": f"WITH {_INTER} SELECT DISTINCT user_id, item_id FROM inter",
    "timed_history_stats": f"WITH {_INTER} SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM inter GROUP BY 1",
    "temporal_split_train": f"WITH {_SPLIT} SELECT * FROM train",
    "temporal_split_val": f"WITH {_SPLIT} SELECT * FROM val",
    "split_summary": f"""WITH {_SPLIT} SELECT part, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items
      FROM (SELECT 'train' AS part, * FROM train UNION ALL SELECT 'val', * FROM val) GROUP BY 1""",
    "query_users": f"WITH {_SPLIT} SELECT DISTINCT user_id FROM val",
    "targets_filtered": f"WITH {_SPLIT}, {_CLICKS} SELECT user_id, item_id FROM val WHERE user_id IN (SELECT user_id FROM clicks)",
    "popularity_top50": f"WITH {_INTER} SELECT item_id, count(*) AS n FROM inter GROUP BY 1 ORDER BY n DESC, item_id LIMIT 50",
    "popularity_recs_top10": f"WITH {_INTER}, {_popular('inter', 'inter', 10)} SELECT * FROM recs",
    "popularity_recall": f"WITH {_SPLIT}, {_popular('train', 'val', 10)} SELECT {_recall('recs', 'val')} AS recall",
    "dataset_summary": f"""WITH {_SPLIT} SELECT 'train rows' AS name, count(*) AS n FROM inter UNION ALL SELECT 'train_split rows', count(*) FROM train
      UNION ALL SELECT 'val users', count(DISTINCT user_id) FROM val UNION ALL SELECT 'items with text', count(*) FROM part""",
    "item_text_documents": f"WITH {_META} SELECT item_id, concat_ws(' ', title, main_category, '', '', '') AS text FROM meta",
    "item_features": f"""WITH {_INTER}, {_META}, {_features()} SELECT item_id, round(item_popularity, 6) AS item_popularity, main_category, store,
      average_rating, round(log_rating_number, 6) AS log_rating_number, price FROM itemf""",
    "user_features": f"""WITH {_INTER}, {_META}, {_features()} SELECT user_id, round(user_interaction_count, 8) AS user_interaction_count,
      round(user_avg_price, 8) AS user_avg_price, round(user_avg_item_rating, 8) AS user_avg_item_rating,
      round(user_avg_log_rating_number, 8) AS user_avg_log_rating_number, user_category_diversity, user_store_diversity FROM userf""",
    "user_dominant": f"WITH {_INTER}, {_META}, {_features()} SELECT * FROM modes",
    "cross_features": f"""WITH {_INTER}, {_META}, {_features()} SELECT user_id, item_id, {_CROSS}, round(abs(price - user_avg_price), 8) AS price_diff_from_user_avg,
      round(abs(average_rating - user_avg_item_rating), 8) AS rating_diff_from_user_avg,
      round(abs(log_rating_number - user_avg_log_rating_number), 8) AS rating_number_diff_from_user_avg
      FROM (SELECT DISTINCT user_id, item_id FROM inter) JOIN itemf USING (item_id) JOIN userf USING (user_id) JOIN modes USING (user_id)""",
    "labelled_pairs": f"""WITH {_SPLIT} SELECT user_id, item_id, CAST((user_id, item_id) IN (SELECT (user_id, item_id) FROM val) AS INT) AS label
      FROM (SELECT DISTINCT user_id, item_id FROM train)""",
    "positive_groups": f"""WITH {_SPLIT}, l AS (SELECT user_id, item_id, CAST((user_id, item_id) IN (SELECT (user_id, item_id) FROM val) AS INT) AS label
      FROM (SELECT DISTINCT user_id, item_id FROM train)) SELECT * FROM l WHERE user_id IN (SELECT user_id FROM l WHERE label = 1)""",
    "group_sizes": f"WITH {_INTER} SELECT user_id, count(DISTINCT item_id) AS n FROM inter GROUP BY 1",
    "compact_types": f"""WITH {_INTER}, {_META}, {_features()} SELECT item_id, round(CAST(CAST(item_popularity AS FLOAT) AS DOUBLE), 3) AS item_popularity,
      round(CAST(CAST(average_rating AS FLOAT) AS DOUBLE), 3) AS average_rating, round(CAST(CAST(log_rating_number AS FLOAT) AS DOUBLE), 3) AS log_rating_number,
      round(CAST(CAST(price AS FLOAT) AS DOUBLE), 3) AS price FROM itemf""",
    "category_codes": f"WITH {_META} SELECT main_category AS value, row_number() OVER (ORDER BY main_category) - 1 AS code FROM (SELECT DISTINCT main_category FROM meta WHERE main_category IS NOT NULL)",
    "cooc_similarity": f"WITH {_INTER}, {_similarity('inter')} SELECT item_i, item_j, round(sim, 6) AS sim FROM sim",
    "decay_weights": f"WITH {_INTER}, {_decay('inter', _TAU)} SELECT user_id, item_id, round(w, 6) AS w FROM decay",
    "cooc_scores": f"WITH {_COOC} SELECT user_id, item_id, round(score, 6) AS score FROM cooc",
    "cooc_top10": f"WITH {_COOC}, {_top('cooc', 10)} SELECT user_id, item_id, rank, round(score, 6) AS score FROM top",
    "cooc_top10_padded": f"""WITH {_COOC}, padded AS (SELECT user_id, item_id, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT user_id FROM clicks)
      CROSS JOIN (SELECT DISTINCT item_id FROM clicks) LEFT JOIN cooc USING (user_id, item_id)), {_top('padded', 10)}
      SELECT user_id, item_id, rank, round(score, 6) AS score FROM top""",
    "cooc_candidate_scores": f"""WITH {_COOC}, {_CAND} SELECT user_id, item_id, CASE WHEN item_id IN (SELECT item_id FROM clicks) THEN round(coalesce(score, 0.0), 6) END AS cooc_score
      FROM cand LEFT JOIN cooc USING (user_id, item_id)""",
    "bm25_token_counts": f"WITH {_BM25_TERMS} SELECT doc_id AS item_id, CAST(coalesce(sum(tf), 0) AS BIGINT) AS n, count(term) AS n_distinct FROM documents LEFT JOIN post ON item_id = doc_id GROUP BY 1",
    "bm25_idf": f"""WITH {_BM25_TERMS.replace('AS (', 'AS MATERIALIZED (', 1)}, df AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY 1),
      raw AS MATERIALIZED (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df CROSS JOIN (SELECT count(*) AS n FROM documents))
      SELECT term, round(CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END, 6) AS idf FROM raw CROSS JOIN (SELECT avg(raw) AS mean FROM raw)""",
    "bm25_top10": f"WITH {_CLICKS}, {_BM25}, {_top('matched', 10, 6)} SELECT user_id, item_id, rank, round(score, 4) AS score FROM top",
    "bm25_candidate_scores": f"""WITH {_CLICKS}, {_BM25}, {_CAND} SELECT user_id, item_id, CASE WHEN item_id IN (SELECT doc_id FROM documents) AND
      user_id IN (SELECT user_id FROM prof) THEN round(coalesce(score, 0.0), 4) END AS bm25_score FROM cand LEFT JOIN matched USING (user_id, item_id)""",
    "tfidf_token_counts": f"WITH {_TFIDF_TERMS} SELECT item_id, len(t) AS n FROM terms",
    "tfidf_vocab": f"WITH {_VOCAB} SELECT * FROM vocab",
    "tfidf_weights": f"WITH {_CLICKS}, {_TFIDF} SELECT item_id, term, round(w, 6) AS w FROM wt",
    "tfidf_profile": f"WITH {_CLICKS}, {_TFIDF} SELECT user_id, term, round(q, 6) AS q FROM prof",
    "tfidf_top10": f"WITH {_CLICKS}, {_TFIDF}, {_top('matched', 10)} SELECT user_id, item_id, rank, round(score, 6) AS score FROM top",
    "tfidf_candidate_scores": f"""WITH {_CLICKS}, {_TFIDF}, {_CAND} SELECT user_id, item_id, CASE WHEN item_id IN (SELECT doc_id FROM documents) AND
      user_id IN (SELECT user_id FROM prof) THEN round(coalesce(score, 0.0), 6) END AS tfidf_score FROM cand LEFT JOIN matched USING (user_id, item_id)""",
    "bpr_dot_scores": f"WITH {_DOT} SELECT user_id, item_id, round(score, 6) AS score FROM scored",
    "bpr_top10": f"""WITH {_DOT} SELECT user_id, item_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER
      (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM scored) WHERE rank <= 10""",
    "bpr_candidate_scores": f"""WITH {_FACTORS}, c AS (SELECT id AS user_id, f AS fu, unnest([id + 1, id + 3, -1]) AS item_id FROM uf)
      SELECT user_id, item_id, round(list_dot_product(fu, f), 6) AS bpr_score FROM c LEFT JOIN vf ON item_id = id""",
    "bpr_loss_given_factors": f"WITH {_TRIPLES} SELECT round(avg(ln(1 + exp(-x))), 6) AS loss FROM tri",
    "bpr_one_gradient": f"""WITH {_TRIPLES}, z AS (SELECT *, unnest(range(len(fu))) AS k FROM tri)
      SELECT user_id, item_id, negative_id, CAST(k AS INT) AS k, round(fu[k + 1] + 0.01 * (1 / (1 + exp(x)) * (fi[k + 1] - fj[k + 1]) - 0.01 * fu[k + 1]), 6) AS f FROM z""",
    "bpr_item_gradient": f"""WITH {_TRIPLES}, z AS (SELECT *, 1 / (1 + exp(x)) AS g, unnest(range(len(fu))) AS k FROM tri),
      s AS (SELECT *, fi[k + 1] AS i, fj[k + 1] AS j, fu[k + 1] + 0.01 * (g * (fi[k + 1] - fj[k + 1]) - 0.01 * fu[k + 1]) AS u FROM z)
      SELECT user_id, item_id, negative_id, CAST(k AS INT) AS k, round(i + 0.01 * (g * u - 0.01 * i), 6) AS fi, round(j + 0.01 * (-g * u - 0.01 * j), 6) AS fj FROM s""",
    "candidate_generation": f"""WITH {_COOC}, {_TFIDF}, uf AS (SELECT vec_id // 2 AS id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings WHERE vec_id % 2 = 0 AND vec_id // 2 IN (SELECT user_id FROM clicks)),
      vf AS (SELECT vec_id // 2 AS id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings WHERE vec_id % 2 = 1),
      dots AS (SELECT u.id AS user_id, v.id AS item_id, list_dot_product(u.f, v.f) AS score FROM uf u CROSS JOIN vf v),
      {_top('dots', 20, name='a')}, {_top('matched', 20, name='b')}, {_top('cooc', 20, name='c')},
      u AS (SELECT user_id, item_id, 'bpr' AS s, rank FROM a UNION ALL SELECT user_id, item_id, 'tfidf', rank FROM b UNION ALL SELECT user_id, item_id, 'cooc', rank FROM c),
      p AS (SELECT user_id, item_id, coalesce(max(rank) FILTER (s = 'bpr') - 1, -1) AS bpr_rank, coalesce(max(rank) FILTER (s = 'tfidf') - 1, -1) AS tfidf_rank,
        coalesce(max(rank) FILTER (s = 'cooc') - 1, -1) AS cooc_rank FROM u GROUP BY 1, 2)
      SELECT p.*, round(d.score, 6) AS bpr_score,
        CASE WHEN p.item_id IN (SELECT doc_id FROM documents) AND p.user_id IN (SELECT user_id FROM prof) THEN round(coalesce(m.score, 0.0), 6) END AS tfidf_score,
        CASE WHEN p.item_id IN (SELECT item_id FROM clicks) AND p.user_id IN (SELECT user_id FROM clicks) THEN round(coalesce(o.score, 0.0), 6) END AS cooc_score
      FROM p LEFT JOIN dots d ON d.user_id = p.user_id AND d.item_id = p.item_id LEFT JOIN matched m ON m.user_id = p.user_id AND m.item_id = p.item_id
      LEFT JOIN cooc o ON o.user_id = p.user_id AND o.item_id = p.item_id""",
    "candidate_union": f"""WITH {_COOC}, {_TFIDF}, {_top('cooc', 20, name='a')}, {_top('matched', 20, name='b')}, {_popular('clicks', 'clicks', 20, name='c')},
      u AS (SELECT user_id, item_id, 'cooc' AS s, rank FROM a UNION ALL SELECT user_id, item_id, 'tfidf', rank FROM b UNION ALL SELECT user_id, item_id, 'popular', rank FROM c)
      SELECT user_id, item_id, coalesce(max(rank) FILTER (s = 'cooc') - 1, -1) AS cooc_rank, coalesce(max(rank) FILTER (s = 'tfidf') - 1, -1) AS tfidf_rank,
      coalesce(max(rank) FILTER (s = 'popular') - 1, -1) AS popular_rank FROM u GROUP BY 1, 2""",
    "pool_recall": f"""WITH {_HELD} SELECT 'bpr' AS name, {_recall('a', 'cval')} AS recall UNION ALL SELECT 'tfidf', {_recall('b', 'cval')} UNION ALL SELECT 'cooc', {_recall('c', 'cval')}
      UNION ALL SELECT 'bpr_content', {_recall('two', 'cval')} UNION ALL SELECT 'all', {_recall('three', 'cval')}""",
    "baseline_recall": f"""WITH {_HELD}, {_popular('clicks', 'cval', 10, name='pop')}, e AS (SELECT user_id, item_id, 0.5 * {_scaled('bpr_score')} + 0.5 * {_scaled('cooc_score')} AS score FROM cands WINDOW w AS (PARTITION BY user_id)),
      pipe AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM e) WHERE rank <= 10),
      a10 AS (SELECT * FROM a WHERE rank <= 10), b10 AS (SELECT * FROM b WHERE rank <= 10)
      SELECT 'popularity' AS name, {_recall('pop', 'cval')} AS recall UNION ALL SELECT 'content', {_recall('b10', 'cval')} UNION ALL SELECT 'bpr', {_recall('a10', 'cval')} UNION ALL SELECT 'pipeline', {_recall('pipe', 'cval')}""",
    "reranker_frame": f"""WITH {_HELD}, {_META}, {_features('clicks')} SELECT p.user_id, p.item_id, bpr_rank, tfidf_rank, cooc_rank, round(bpr_score, 6) AS bpr_score, round(tfidf_score, 6) AS tfidf_score,
      round(cooc_score, 6) AS cooc_score, round(item_popularity, 6) AS item_popularity, store, user_dominant_category, {_CROSS}, round(user_interaction_count, 6) AS user_interaction_count,
      round(user_avg_price, 8) AS user_avg_price, CAST((p.user_id, p.item_id) IN (SELECT (user_id, item_id) FROM cval) AS INT) AS label
      FROM cands p LEFT JOIN itemf USING (item_id) LEFT JOIN userf USING (user_id) LEFT JOIN modes USING (user_id)""",
    "candidate_recall_report": f"""WITH {_SPLIT}, {_popular('train', 'val', 10, name='a')}, {_popular('train', 'val', 50, name='b')},
      c AS (SELECT user_id, item_id FROM b UNION SELECT user_id, item_id FROM train)
      SELECT 'popular_10' AS pool, {_recall('a', 'val')} AS recall UNION ALL SELECT 'popular_50', {_recall('b', 'val')}
      UNION ALL SELECT 'repeat', {_recall('train', 'val')} UNION ALL SELECT 'union', {_recall('c', 'val')}""",
    "minmax_norm": f"WITH {_SCORES} SELECT user_id, item_id, round(item_popularity, 6) AS item_popularity, round(price, 6) AS price FROM mm",
    "ensemble_top10": f"WITH {_SCORES} SELECT user_id, item_id, rank, round(score, 6) AS score FROM ens",
    "recall_at_10": f"""WITH {_SCORES}, val AS (SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS r,
      count(*) OVER (PARTITION BY user_id) AS n FROM inter) WHERE n >= 5 AND r > n - greatest(1, n // 5)) SELECT {_recall('ens', 'val')} AS recall""",
    "recall_duplicate_targets": f"""WITH {_INTER}, r AS (SELECT * FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS rank
      FROM (SELECT DISTINCT user_id, item_id FROM inter)) WHERE rank <= 10) SELECT {_recall('r', 'inter')} AS recall""",
    "submission_rows": f"""WITH {_INTER}, {_popular('inter', 'inter', 10)} SELECT row_number() OVER (ORDER BY user_id) - 1 AS ID, user_id, item_id
      FROM (SELECT user_id, string_agg(item_id, ',' ORDER BY rank) AS item_id FROM recs GROUP BY 1)""",
    "submission_violations": f"""WITH {_SCORES} SELECT user_id, n, n_distinct FROM (SELECT user_id, count(item_id) AS n, count(DISTINCT item_id) AS n_distinct
      FROM (SELECT DISTINCT user_id FROM inter) LEFT JOIN ens USING (user_id) GROUP BY 1) WHERE n <> 10 OR n_distinct <> 10""",
    "baseline_comparison": f"""WITH {_SPLIT}, {_popular('train', 'val', 10)}, p AS (SELECT item_id, count(*) AS n FROM train GROUP BY 1),
      again AS (SELECT * FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item_id) AS rank
      FROM (SELECT DISTINCT user_id, item_id FROM train) JOIN p USING (item_id)) WHERE rank <= 10)
      SELECT 'popularity' AS name, {_recall('recs', 'val')} AS recall UNION ALL SELECT 'seen again', {_recall('again', 'val')}""",
    "reranker_features": f"""WITH {_TRAIN} SELECT p.user_id, p.item_id, rank AS popular_rank, round(item_popularity, 6) AS item_popularity, {_CROSS},
      round(user_avg_price, 8) AS user_avg_price, CAST((p.user_id, p.item_id) IN (SELECT (user_id, item_id) FROM val) AS INT) AS label
      FROM pool p JOIN itemf USING (item_id) JOIN userf USING (user_id) JOIN modes USING (user_id)""",
    "category_statistics": f"""WITH {_TRAIN}, r AS (SELECT store, main_category, CAST((p.user_id, p.item_id) IN (SELECT (user_id, item_id) FROM val) AS INT) AS y FROM pool p LEFT JOIN itemf USING (item_id)),
      v AS (SELECT 'store' AS "column", coalesce(store, 'MISSING') AS value, y FROM r UNION ALL SELECT 'main_category', coalesce(main_category, 'MISSING'), y FROM r)
      SELECT "column", value, count(*) AS n, CAST(sum(y) AS DOUBLE) AS positives, round((sum(y) + 2 * 0.1) / (count(*) + 2), 6) AS number FROM v GROUP BY 1, 2""",
    "lambda_gradients": f"""WITH {_TRAIN}, l AS (SELECT user_id, item_id, rank, CAST((user_id, item_id) IN (SELECT (user_id, item_id) FROM val) AS INT) AS y FROM pool),
      r AS (SELECT *, 1 / log2(row_number() OVER (PARTITION BY user_id ORDER BY rank, item_id) + 1) AS gain, sum(y) OVER (PARTITION BY user_id) AS pos FROM l),
      own AS (SELECT * FROM r WHERE pos > 0),
      best AS (SELECT user_id, sum(1 / log2(i + 2)) AS best FROM (SELECT DISTINCT user_id, unnest(range(CAST(pos AS BIGINT))) AS i FROM own) GROUP BY 1),
      pairs AS (SELECT a.user_id, a.item_id AS a, b.item_id AS b, 1 / (1 + exp((b.rank - a.rank) / 10.0)) AS rho, abs(a.gain - b.gain) / best AS change
        FROM own a JOIN own b USING (user_id) JOIN best USING (user_id) WHERE a.y = 1 AND b.y = 0),
      ends AS (SELECT user_id, a AS item_id, rho * change AS lam, rho * (1 - rho) * change AS weight FROM pairs UNION ALL SELECT user_id, b, -rho * change, rho * (1 - rho) * change FROM pairs)
      SELECT o.user_id, o.item_id, round(coalesce(sum(lam), 0.0), 6) AS lam, round(coalesce(sum(weight), 0.0), 6) AS weight FROM own o LEFT JOIN ends USING (user_id, item_id) GROUP BY 1, 2""",
    "ranking_ndcg": f"""WITH {_TRAIN}, l AS (SELECT user_id, item_id, item_popularity AS s, CAST((user_id, item_id) IN (SELECT (user_id, item_id) FROM val) AS INT) AS y FROM pool JOIN itemf USING (item_id)),
      r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, item_id) AS place, row_number() OVER (PARTITION BY user_id ORDER BY y DESC) AS ideal FROM l),
      per AS (SELECT k, user_id, sum(CASE WHEN y = 1 AND place <= k THEN 1 / log2(place + 1) ELSE 0 END) / nullif(sum(CASE WHEN y = 1 AND ideal <= k THEN 1 / log2(ideal + 1) ELSE 0 END), 0) AS x
        FROM r, (SELECT unnest([10, 1000000000]) AS k) GROUP BY 1, 2)
      SELECT CASE k WHEN 10 THEN 'at 10' ELSE 'all' END AS name, round(coalesce(avg(x), 0), 6) AS ndcg FROM per GROUP BY 1, k""",
    "interactions_csv": f"WITH {_INTER} SELECT * FROM inter",
    "item_meta_csv": f"WITH {_META} SELECT item_id, title, main_category, store, average_rating, CAST(rating_number AS DOUBLE) AS rating_number, price FROM meta",
    "targets_csv": f"WITH {_SPLIT}, {_CLICKS} SELECT user_id, item_id FROM val WHERE user_id IN (SELECT user_id FROM clicks)",
    "loaded_counts": f"""WITH {_SPLIT}, {_CLICKS} SELECT 'train' AS name, count(*) AS n FROM inter UNION ALL SELECT 'train_split', count(*) FROM train
      UNION ALL SELECT 'validation', count(*) FROM val UNION ALL SELECT 'items', count(*) FROM part UNION ALL SELECT 'texts', count(*) FROM part
      UNION ALL SELECT 'users', count(DISTINCT user_id) FROM clicks UNION ALL SELECT 'targets', count(*) FROM val WHERE user_id IN (SELECT user_id FROM clicks)""",
    "positives_summary": f"""WITH {_TRAIN}, d AS (SELECT user_id, CAST((user_id, item_id) IN (SELECT (user_id, item_id) FROM val) AS INT) AS label FROM pool)
      SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (label = 1) AS users_with_positives FROM d""",
    "inference_features": f"""WITH {_SPLIT}, {_META}, {_features()}, {_popular('inter', 'val', 50, name='pool')}
      SELECT p.user_id, p.item_id, rank AS popular_rank, round(item_popularity, 6) AS item_popularity, {_CROSS}, round(user_avg_price, 8) AS user_avg_price
      FROM pool p JOIN itemf USING (item_id) JOIN userf USING (user_id) JOIN modes USING (user_id)""",
}
ORACLES["submission_csv"] = ORACLES["submission_rows"]
ORACLES["cached_item_features"] = ORACLES["item_features"]
