"""Forms that make fewer rows, against the plain ones."""

import numpy as np
from conftest import as_rows
from pyspark.sql import functions as F

from tidemark.operators import core, features
from tidemark.operators.encoding import TargetStatistics


def _leaves(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_popular_lists_equal_pairs(spark):
    rows = [(u, i, 0, 0) for u in range(9) for i in range(12) if (u * 7 + i * 5) % 4 == 0]
    rows += [(None, 3, 0, 0), (1, None, 0, 0), (2, None, 0, 0)]
    inter = spark.createDataFrame(rows, "user_id long, item_id long, ts long, seq long")
    users, seen = inter.select("user_id").distinct(), core.seen(inter)
    top = core.top_items(inter, 8)
    pairs = core.unseen(users.crossJoin(top), seen).withColumnRenamed("n", "score")
    want = core.ranked(pairs, 4).select("user_id", "item_id", "score", "rank")
    got = core.popular_for_users(inter, users, seen, 4, 8)
    assert as_rows(got) == as_rows(want)
    targets = spark.createDataFrame([(0, 1), (0, 1), (3, 2), (4, 99), (None, 0)], "user_id long, item_id long")
    lists = core.popular_lists(top, users, seen, 4)
    plain = features.labelled(want, targets)
    assert as_rows(features.labelled_lists(lists, targets, top)) == as_rows(plain)
    assert as_rows(features.labelled_lists(lists, targets, top, positives=True)) == as_rows(features.with_positives(plain))


def test_popular_items_are_not_shuffled_for_every_user(spark):
    inter = spark.range(40).select((F.col("id") % 8).alias("user_id"), (F.col("id") % 11).alias("item_id"))
    d = core.popular_for_users(inter, inter.select("user_id").distinct(), core.seen(inter), 5)
    assert "Window" not in d._jdf.queryExecution().optimizedPlan().toString()  # ranks needed all pairs before


def test_encoding_reads_its_rows_in_proportion_to_the_columns(spark):
    rows = spark.range(60).select(F.col("id").alias("user_id"), F.col("id").alias("item_id"), (F.col("id") % 2).alias("label"), *[(F.col("id") % n).cast("string").alias(c) for n, c in ((3, "a"), (4, "b"), (5, "c"), (6, "d"))])
    d = TargetStatistics(["a", "b", "c", "d"]).fit_transform(rows)
    assert _leaves(d) <= 5  # was 16


def test_cooc_blocks_equal_the_joins(spark, monkeypatch):
    from tidemark.operators import retrieval, together

    rows = [(u, (u * 7 + i * i) % 41 - 5, 1000 * i + u) for u in range(30) for i in range(1 + u % 9)]
    rows += [(3, 7, 5000), (3, 7, 6000), (None, 7, 10), (None, 11, 20), (4, None, 5), (99, 1000, 1)]
    inter = spark.createDataFrame(rows, "user_id long, item_id long, ts long")
    mine = inter.where("user_id is null or user_id % 3 = 0")
    scores = retrieval.cooc_scores(mine, retrieval.similarity(inter), 2000.0)
    monkeypatch.setattr(together, "PART", 40)
    monkeypatch.setattr(together, "WIDE", 9)
    monkeypatch.setattr(together, "SUMS", 36)
    six = lambda d: d.withColumn("score", F.round("score", 8))
    for seen in (core.seen(mine), core.seen(mine).where("item_id % 2 = 0")):
        want = core.ranked(core.unseen(scores, seen), 4).select("user_id", "item_id", "rank", "score")
        got = together.cooc_top(mine, inter, 2000.0, 4, seen).select("user_id", "item_id", "rank", "score")
        assert as_rows(six(got)) == as_rows(six(want))
    asked = core.seen(mine).select("user_id", F.explode(F.array("item_id", F.col("item_id") + 3, F.lit(2))).alias("item_id")).distinct()
    want = retrieval.cooc_of_candidates(asked, scores, inter).withColumn("cooc_score", F.round("cooc_score", 8))
    got = retrieval.cooc_of_candidates(asked, together.cooc_asked(mine, inter, 2000.0, asked), inter).withColumn("cooc_score", F.round("cooc_score", 8))
    assert as_rows(got) == as_rows(want)


def test_cooc_top_makes_no_row_for_a_score(spark):
    """Before, all scores were grouped by user and item."""
    from tidemark.operators import together

    inter = spark.range(300).select((F.col("id") % 10).alias("user_id"), (F.col("id") * 7 % 31).alias("item_id"), F.col("id").alias("ts"))
    plan = together.cooc_top(inter, inter, 100.0, 3, core.seen(inter))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Cross" in plan


def test_packed_items_go_to_a_block_once(spark, monkeypatch):
    import re

    from tidemark.operators import packed, retrieval

    texts = spark.createDataFrame([(i, f"aa w{i % 4}x w{i % 3}y bb") for i in range(9)], "item_id long, text string")
    seen = spark.createDataFrame([(u, i) for u in range(3) for i in range(9) if i % 3 == u], "user_id long, item_id long")  # a block that has seen all
    vocabulary = retrieval.tfidf_vocabulary(texts, 9)
    of = packed.tfidf(retrieval.tfidf_words(texts), vocabulary, 9)
    weights = retrieval.tfidf_weights(retrieval.tfidf_counts(texts, vocabulary), vocabulary, 9)
    want = retrieval.text_top(retrieval.tfidf_profile(seen, weights), weights, 4, seen)
    for pairs in (1 << 16, 4):
        monkeypatch.setattr(packed, "MET", pairs)
        got = packed.top(seen, of, 4)
        columns = ["user_id", "item_id", "rank", F.round("score", 8).alias("score")]
        assert as_rows(got.select(columns)) == as_rows(want.select(columns))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[item_id#\d+L?,\s*v#\d+\]", plan)) == 1  # was 2: for profiles and again for all


def test_factor_scores_of_packs(spark, monkeypatch):
    """Every pair by matrix products; before, each was an expression over two arrays."""
    from tidemark.operators import retrieval

    odd = [(None, [1.0, 2.0]), (7, None), (8, [1.0, None]), (9, [3.0]), (10, []), (10, [0.5, float("nan")]), (11, [float("inf"), 0.0])]
    users = spark.createDataFrame([(i, [float(i), i / 7]) for i in range(5)] + odd, "id long, f array<double>")
    items = spark.createDataFrame([(i, [i / 3, -float(i)]) for i in range(9)] + odd, "id long, f array<double>")
    monkeypatch.setattr(retrieval, "MEET_USERS", 4)
    monkeypatch.setattr(retrieval, "MEET_ITEMS", 3)
    pairs = users.selectExpr("id AS user_id", "f AS fu").crossJoin(items.selectExpr("id AS item_id", "f AS fi"))
    want = pairs.select("user_id", "item_id", retrieval.dot("fu", "fi").alias("score"))
    got = retrieval.factor_scores(users, items)
    text = lambda d: sorted(map(str, d.select("user_id", "item_id", F.round("score", 9).alias("score")).collect()))
    assert text(got) == text(want) and got.count() == 12 * 16
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan
    assert retrieval.factor_scores(users.limit(0), items).count() == 0


def test_packed_items_are_not_shuffled_to_blocks(spark):
    """Before, each block of users got a copy of every item by an exchange."""
    from tidemark.operators import packed, retrieval

    texts = spark.createDataFrame([(i, f"aa w{i % 4}x w{i % 3}y bb") for i in range(9)], "item_id long, text string")
    seen = spark.createDataFrame([(u, u + i) for u in range(3) for i in range(3)], "user_id long, item_id long")
    of = packed.tfidf(retrieval.tfidf_words(texts), retrieval.tfidf_vocabulary(texts, 9), 9)
    plan = packed.top(seen, of, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "shuffle_replicate_nl" in plan and "Union" not in plan


def test_similar_equals_the_join(spark, monkeypatch):
    """Before, pairs of items were grouped as rows, some twenty bytes each."""
    from tidemark.operators import retrieval, together

    rows = [(u, (u * 7 + i * i) % 41 - 5) for u in range(30) for i in range(1 + u % 9)]
    rows += [(3, 7), (3, 7), (None, 7), (None, 11), (4, None), (99, 1000)] + [(50, i) for i in range(25)] + [(51, 3)] * 3 + [(51, 4)] * 2
    inter = spark.createDataFrame(rows, "user_id long, item_id long")
    monkeypatch.setattr(together, "MERGED", 60)
    monkeypatch.setattr(together, "HELD", 30)
    monkeypatch.setattr(together, "HISTORY_ITEMS", 6)
    eight = lambda d: as_rows(d.withColumn("sim", F.round("sim", 8)))
    got = together.similar(inter)
    assert eight(got) == eight(retrieval.similarity(inter))
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert together.similar(inter.limit(0)).count() == 0
    rng = np.random.default_rng(3)
    keys = np.sort(rng.choice(1 << 34, 5000, replace=False))
    data = together._planes(keys, np.ones(5000, np.int64))
    assert (together._whole(data)[0] == keys).all() and len(data) < 4.5 * 5000


def test_cooc_all_equals_the_join(spark, monkeypatch):
    """Before, a row was shuffled for each neighbour of each item of a user."""
    from tidemark.operators import retrieval, together

    rows = [(u, 3 * ((u * 7 + i * i) % 41) - 5, 1000 * i + u) for u in range(30) for i in range(1 + u % 9)]
    rows += [(3, 7, 5000), (3, 7, 6000), (None, 7, 10), (None, 11, 20), (4, None, 5), (99, 1000, 1), (98, 4, 0), (98, 1, 10**9)]
    inter = spark.createDataFrame(rows, "user_id long, item_id long, ts long")
    want = retrieval.cooc_scores(inter, retrieval.similarity(inter), 2000.0)
    monkeypatch.setattr(together, "PART", 40)
    monkeypatch.setattr(together, "WIDE", 9)
    monkeypatch.setattr(together, "SUMS", 36)
    got = together.cooc_all(inter, inter, 2000.0)
    eight = lambda d: as_rows(d.select("user_id", "item_id", F.round("score", 8).alias("score")))
    assert eight(got) == eight(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Inner" not in plan
    assert together.cooc_all(inter.limit(0), inter.limit(0), 1.0).count() == 0
