"""Packed texts against the long forms of profiles, matches and rankings."""

import numpy as np
import pytest
from conftest import as_rows
from pyspark.sql import functions as F

from tidemark.operators import core, packed, retrieval


def test_pack():
    rng = np.random.default_rng(2)
    t = np.sort(rng.choice(20_000, 240, replace=False))
    tf, df = rng.integers(1, 4, 240), rng.integers(2, 300, 240)
    data = packed.pack(t, tf, df)
    assert all((a == b).all() for a, b in zip(packed.unpack(data), (t, tf, df), strict=True))
    assert len(data) < 4.5 * 240  # a row of a term and a weight took over 20 bytes


@pytest.mark.parametrize("content", ["tfidf", "bm25"])
def test_packed_equals_long_form(spark, monkeypatch, content):
    monkeypatch.setattr(packed, "PAIRS", 8)
    monkeypatch.setattr(packed, "MET", 9)
    rng = np.random.default_rng(7)
    texts = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, 12) % 40) + " everywhere") for i in range(50)] + [(50, None), (51, "alone")]
    d = spark.createDataFrame(texts, "item_id long, text string")
    n = len(texts)
    seen = spark.createDataFrame([(u, int(i)) for u in range(12) for i in rng.choice(50, 1 + u, replace=False)] + [(12, 50), (None, 3), (4, None), (5, 777)], "user_id long, item_id long")
    if content == "tfidf":
        v = retrieval.tfidf_vocabulary(d, n, 60)
        of = packed.tfidf(retrieval.tfidf_words(d), v, n)
        weights = retrieval.tfidf_weights(retrieval.tfidf_counts(d, v), v, n)
        profile = retrieval.tfidf_profile(seen, weights)
    else:
        of = packed.bm25(retrieval.bm25_terms(d), n)
        postings = retrieval.bm25_postings(d)
        weights, profile = retrieval.bm25_weights(postings, n), retrieval.bm25_profile(seen, postings)
    r = lambda df, c: as_rows(df.withColumn(c, F.round(c, 8)))
    assert r(packed.profile_terms(seen, of), "q") == r(profile, "q")
    asked = spark.createDataFrame([(u, i) for u in range(14) for i in (0, 7, 33, 50, 51, -1)], "user_id long, item_id long")
    assert r(packed.match(asked, seen, of, d, "s"), "s") == r(retrieval.score_candidates(asked, profile, weights, d, "s"), "s")
    monkeypatch.setattr(packed, "CHUNK", 7)
    monkeypatch.setattr(packed, "DENSE", 90)
    every = profile.where("user_id is not null").join(weights, "term").groupBy("user_id", "item_id").agg(F.sum(F.col("q") * F.col("w")).alias("score"))
    for k in (3, 100):
        assert r(packed.top(seen, of, k), "score") == r(core.ranked(core.unseen(every, seen), k), "score")


def test_padded_top_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    items = spark.createDataFrame([(i,) for i in range(30)], "item_id long")
    users = spark.createDataFrame([(u,) for u in range(9)], "user_id long")
    scores = spark.createDataFrame([(u, int(i), float(x)) for u in range(7) for i in rng.choice(30, 1 + 3 * u, replace=False) for x in [rng.choice([0.0, 1e-12, 0.5, 1.0, 2.0])]], "user_id long, item_id long, score double")
    seen = spark.createDataFrame([(u, int(i)) for u in range(8) for i in rng.choice(30, 1 + 3 * u, replace=False)] + [(8, i) for i in range(30)], "user_id long, item_id long")
    for k in (3, 10, 40):
        got, want = core.padded_top(scores, users, items, seen, k), core.ranked(core.pad(scores, users, items, seen), k)
        assert as_rows(got) == as_rows(want)
    meetings = core.padded_top(scores, users, items, seen, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in meetings and "Join Inner\n" not in meetings  # no user meets all items
