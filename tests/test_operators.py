"""Edge cases on small frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bpr, core, features, rankers, retrieval

I = "user_id long, item_id long, ts long, seq long"  # noqa: E741


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_split_thresholds(spark):
    data = [(n, i, i, i) for n in (1, 4, 5, 9, 10) for i in range(n)]
    train, val = core.split(spark.createDataFrame(data, I))
    assert rows(val, "user_id", "item_id") == [(10, 8), (10, 9), (5, 4), (9, 8)]
    assert train.count() + val.count() == len(data)


def test_split_ties_follow_seq(spark):
    _, val = core.split(spark.createDataFrame([(1, 10 - s, 7, s) for s in range(6)], I))
    assert rows(val, "item_id") == [(5,)]


def test_recall_counts_repeated_targets(spark):
    targets = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "user_id long, item_id long")
    recs = spark.createDataFrame([(1, 1, 1), (2, 5, 1)], "user_id long, item_id long, rank int")
    assert core.recall(recs, targets).first()[0] == pytest.approx(1 / 3)
    assert core.recall(recs, targets.where("user_id = 9")).first()[0] == 0.0


def test_minmax_of_equal_scores_is_zero(spark):
    d = spark.createDataFrame([(1, 1, 3.0), (1, 2, 3.0), (2, 1, 1.0), (2, 2, 5.0)], "user_id long, item_id long, s double")
    assert rows(core.minmax(d, "s"), "user_id", "item_id", "s") == [(1, 1, 0.0), (1, 2, 0.0), (2, 1, 0.0), (2, 2, 1.0)]


def test_ranking_ties_and_missing(spark):
    d = spark.createDataFrame([(1, 3, 1.0), (1, 2, 1.0), (1, 1, None)], "user_id long, item_id long, score double")
    assert rows(core.ranked(d), "rank", "item_id") == [(1, 2), (2, 3), (3, 1)]


def test_submission_validation(spark, tmp_path):
    recs = spark.createDataFrame([(1, i, i + 1) for i in range(9)], "user_id long, item_id long, rank int")
    users = spark.createDataFrame([(1,)], "user_id long")
    with pytest.raises(ValueError, match="user 1 has 9"):
        core.write_submission(recs, users, str(tmp_path / "x"))
    core.write_submission(recs, users, str(tmp_path / "x"), k=9)
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).first()["item_id"] == "0,1,2,3,4,5,6,7,8"


def test_features_of_missing_values(spark):
    meta = spark.createDataFrame([(1, "a", None, 4.0, 3, None), (2, "b", "s", 2.0, 0, 5.0)], "item_id long, main_category string, store string, average_rating double, rating_number long, price double")
    inter = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 2, 2), (2, 9, 1, 1)], I)
    items = features.item_features(meta, inter)
    users = {r["user_id"]: r for r in features.user_features(inter, items).collect()}
    assert items.count() == 3 and users[1]["user_dominant_category"] == "a" and users[1]["user_avg_price"] == 5.0
    assert users[2]["user_dominant_store"] == "UNKNOWN" and users[2]["user_category_diversity"] == 0
    crossed = features.with_features(core.seen(inter), items, features.user_features(inter, items))
    assert rows(crossed, "user_id", "item_id", "category_match", "store_match") == [(1, 1, 1, 0), (1, 2, 0, 1), (2, 9, 0, 0)]


def test_cold_and_unknown_candidates(spark):
    inter = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 5, 1), (2, 2, 0, 0), (2, 3, 1, 1)], I)
    scores = retrieval.cooc_scores(inter, retrieval.similarity(inter), 10.0)
    cand = spark.createDataFrame([(1, 3), (1, 99), (7, 1)], "user_id long, item_id long")
    got = {(r["user_id"], r["item_id"]): r["cooc_score"] for r in retrieval.cooc_of_candidates(cand, scores, inter).collect()}
    assert got[1, 3] == pytest.approx(1 / np.sqrt(2)) and got[1, 99] is None and got[7, 1] is None


def test_blocked_top_equals_every_pair(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "USERS", 3)
    monkeypatch.setattr(retrieval, "ITEMS", 4)
    rng = np.random.default_rng(1)
    big = 1 << 60  # ids that doubles cannot tell apart
    make = lambda n: [(big + i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(n)] + [(big + n, None)]
    users, items = (spark.createDataFrame(make(n), "id long, f array<double>") for n in (8, 17))
    seen = spark.createDataFrame([(big, big + i) for i in range(15)] + [(big + 1, big + 3), (5, big), (big + 2, 7)], "user_id long, item_id long")
    for of in (seen, None):
        every = retrieval.factor_scores(users, items).where("score is not null")
        want = core.ranked(core.unseen(every, of) if of else every, 5)
        got = retrieval.factor_top(users, items, 5, of)
        assert rows(got, "user_id", "rank", "item_id", "score") == rows(want, "user_id", "rank", "item_id", "score")
    assert retrieval.factor_top(users, items.limit(0), 5).count() == 0


def test_file_order_of_equal_times(spark, tmp_path):
    from tidemark.sources import readers

    (tmp_path / "t").mkdir()
    for k in range(3):  # the later, the longer
        lines = "".join(f"1,{100 * k + i},7\n" for i in range(1 + 40 * k))
        (tmp_path / "t" / f"part-{k}.csv").write_text("user_id,item_id,timestamp\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        got = readers.interactions(spark, str(tmp_path / "t")).orderBy("ts", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["item_id"] for r in got] == [100 * k + i for k in range(3) for i in range(1 + 40 * k)]


def test_negative_idf_is_replaced(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a")], "item_id long, text string")
    idf = {r["term"]: r["idf"] for r in retrieval.bm25_idf(retrieval.bm25_postings(texts), 3).collect()}
    raw = {"a": np.log(0.5) - np.log(3.5), "b": np.log(2.5) - np.log(1.5), "c": np.log(2.5) - np.log(1.5)}
    assert idf["a"] == pytest.approx(0.25 * np.mean(list(raw.values()))) and idf["b"] == pytest.approx(raw["b"])


def test_bpr_step_uses_the_new_user():
    u, i, j = np.array([1.0, 0.0]), np.array([0.5, 0.5]), np.array([0.0, 1.0])
    loss = bpr.step(u, i, j, 0.1, 0.01)
    g = 1 / (1 + np.exp(0.5))
    new = np.array([1.0, 0.0]) + 0.1 * (g * np.array([0.5, -0.5]) - 0.01 * np.array([1.0, 0.0]))
    assert loss == pytest.approx(np.log1p(np.exp(-0.5))) and u == pytest.approx(new)
    assert i == pytest.approx(np.array([0.5, 0.5]) + 0.1 * (g * new - 0.01 * np.array([0.5, 0.5])))


def test_bpr_training_learns_and_skips_full_users(spark):
    data = [(u, i, 0, 0) for u in range(20) for i in range(10) if (u + i) % 2 == 0] + [(99, i, 0, 0) for i in range(10)]
    users, items, losses = bpr.train(spark.createDataFrame(data, I), factors=8, epochs=15, lr=0.5, parts=2)
    assert users.count() == 21 and items.count() == 10 and losses[-1] < losses[0]


def test_resumed_training_equals_uninterrupted(spark, tmp_path):
    data = spark.createDataFrame([(u, (u * 7 + k * 3) % 20, k, k) for u in range(12) for k in range(6)], I)
    run = lambda epochs, saved=None: bpr.train(data, factors=4, epochs=epochs, lr=0.3, parts=2, saved=saved, every=2)
    users, items, losses = run(5)
    run(3, str(tmp_path / "s"))  # stops after 3
    assert [p.name for p in sorted((tmp_path / "s").iterdir())] == ["2", "3"]
    again = run(5, str(tmp_path / "s"))
    factors = lambda d: {r["id"]: r["f"] for r in d.collect()}
    for a, b in ((users, again[0]), (items, again[1])):
        a, b = factors(a), factors(b)
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-4, abs=1e-6) for k in a)
    assert losses == pytest.approx(again[2])


def test_lambdas_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(u, i, int(rng.random() < 0.3) if u else 0, float(rng.randrange(6))) for u in range(4) for i in range(12)]
    got = {(r["user_id"], r["item_id"]): (r["lam"], r["weight"]) for r in rankers.lambdas(spark.createDataFrame(rows, "user_id long, item_id long, label int, s double")).collect()}
    for u in range(4):
        mine = sorted((-s, i, y) for v, i, y, s in rows if v == u)
        gain = {i: 1 / math.log2(r + 2) for r, (_, i, _) in enumerate(mine)}
        best = sum(1 / math.log2(r + 2) for r in range(sum(y for *_, y in mine)))
        want = {i: [0.0, 0.0] for i in gain}
        for a, i, y in mine:
            for b, j, z in mine:
                if y == 1 and z == 0:
                    rho, change = 1 / (1 + math.exp(b - a)), abs(gain[i] - gain[j]) / best
                    want[i][0] += rho * change
                    want[j][0] -= rho * change
                    for k in (i, j):
                        want[k][1] += rho * (1 - rho) * change
        for i, w in want.items():
            assert got[u, i] == pytest.approx(w)


def test_rankers_use_categories(spark):
    rng = random.Random(3)
    rows = [(u, i, f"c{i % 3}" if i % 7 else None, float(rng.random()), int(i % 3 == 1 and i % 7 != 0)) for u in range(30) for i in range(12)]
    d = spark.createDataFrame(rows, "user_id long, item_id long, main_category string, price double, label int")
    for model in (rankers.LambdaTreeRanker(rounds=3, rate=0.5), rankers.PairwiseLinearRanker()):
        s = {(r["user_id"], r["item_id"]): r["score"] for r in model.fit(d).predict(d.withColumn("main_category", d.main_category)).collect()}
        assert min(s[u, i] for u, i, *_, y in rows if y) > max(s[u, i] for u, i, *_, y in rows if not y)
        new = d.limit(3).selectExpr("user_id", "item_id", "'unknown' AS main_category", "price")
        assert model.predict(new).count() == 3


def test_ranker_surface(spark, tmp_path):
    data = [(u, i, float(i), None if i % 3 else 1.0, int(i > 7)) for u in range(8) for i in range(10)]
    d = spark.createDataFrame(data, "user_id long, item_id long, a double, b double, label int")
    for name in ("linear", "lambda"):
        model = rankers.ranker(name)
        if name == "lambda":
            model.rounds = 2
        top = core.ranked(model.fit(d).predict(d), 2)
        assert {r["item_id"] for r in top.collect()} == {8, 9}
        model.save(str(tmp_path / name))
        again = rankers.ranker(name).load(spark, str(tmp_path / name))
        assert sorted(again.predict(d).collect()) == sorted(model.predict(d).collect())
    with pytest.raises(ValueError):
        rankers.ranker("none")


def test_dirty_csv(spark, tmp_path):
    from tidemark.sources import readers

    (tmp_path / "m.csv").write_text('item_id,title,price,store\n1,"a, ""b""\nc",NaN,NA\n2,x,3.5,s\n')
    got = {r["item_id"]: r for r in readers.item_meta(spark, str(tmp_path / "m.csv")).collect()}
    assert got[1]["title"] == 'a, "b"\nc' and got[1]["price"] is None and got[1]["store"] is None and got[2]["price"] == 3.5
    assert readers.cached(spark, str(tmp_path / "none")) is None


def test_negatives_of_a_user_with_nearly_every_item():
    from tidemark.operators.bpr import _draw

    own = set(range(1000)) - {17, 600}
    drawn = [_draw(1, 0, 5, i, 1000, own) for i in range(300)]
    assert set(drawn) == {17, 600} and 100 < drawn.count(17) < 200
    assert _draw(1, 0, 5, 3, 1000, set(range(1000))) is None


def test_meetings_that_lengths_rule_out_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "USERS", 5)
    monkeypatch.setattr(retrieval, "ITEMS", 10)
    rng = np.random.default_rng(2)
    of = lambda n, scale: spark.createDataFrame([(i, (scale(i) * rng.normal(size=4)).tolist()) for i in range(n)] + [(n, [0.0] * 4)], "id long, f array<double>")
    users, items = of(12, lambda i: 1.0), of(100, lambda i: 3.0 / (1 + i))
    seen = spark.createDataFrame([(u, i) for u in range(13) for i in range(u % 4)] + [(3, i) for i in range(95)], "user_id long, item_id long")
    for of_users in (seen, None):
        near, far = retrieval.factor_meetings(users, items, 3, of_users)
        first = retrieval._met(*near, 3)
        met = far(first)[0].where("not pair").count()
        assert 0 < met < 0.5 * 13 * 10  # copies of users that other blocks get
        every = retrieval.factor_scores(users, items)
        want = core.ranked(core.unseen(every, of_users) if of_users else every, 3)
        got = retrieval.factor_top(users, items, 3, of_users)
        assert rows(got, "user_id", "rank", "item_id") == rows(want, "user_id", "rank", "item_id")


def test_items_of_one_length_are_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ITEMS", 4)
    d = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(30)], "id long, f array<double>")
    near, far = retrieval.factor_meetings(d.limit(2), d, 3)
    assert max(r["count"] for r in near[1].groupBy("ub", "ib").count().collect()) < 12
    got = retrieval.factor_top(d.where("id < 2"), d, 3)
    assert rows(got, "user_id", "rank", "item_id") == [(0, 1, 0), (0, 2, 2), (0, 3, 4), (1, 1, 1), (1, 2, 3), (1, 3, 5)]


def test_long_history_meets_in_parts(spark, monkeypatch):
    data = [(1, i % 40, 0, i) for i in range(60)] + [(u, (u * 7 + k) % 40, 0, k) for u in range(2, 9) for k in range(5)]
    inter = spark.createDataFrame(data, I)
    pairs = lambda: {(r["item_i"], r["item_j"]): r["sim"] for r in retrieval.similarity(inter).collect()}
    want = pairs()
    monkeypatch.setattr(retrieval, "HISTORY", 6)
    got = pairs()
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_numbers_over_ranges(spark):
    data = [(i * 37 % 501, i) for i in range(501)] + [(None, -1)]
    got = core.numbered(spark.createDataFrame(data, "k long, v long").repartition(6), "k").collect()
    assert sorted((r["ID"], r["k"], r["v"]) for r in got)[0] == (0, None, -1)
    assert [r["k"] for r in sorted(got, key=lambda r: r["ID"])[1:]] == list(range(501)) and {r["ID"] for r in got} == set(range(502))
    assert core.numbered(spark.createDataFrame([], "k long"), "k").count() == 0


@pytest.mark.parametrize("signs", [False, True])
def test_text_top_in_blocks_equals_all_postings(spark, monkeypatch, signs):
    rng = np.random.default_rng(5)
    value = lambda: float(rng.choice([-0.5, 0.0, 0.5, 1.0]) if signs else rng.choice([0.25, 0.5, 1.0]))
    vectors = lambda n, m: [(i, f"t{t}", value()) for i in range(n) for t in rng.choice(40, m, replace=False)]
    profile = spark.createDataFrame(vectors(23, 4), "user_id long, term string, q double")
    weights = spark.createDataFrame(vectors(61, 3) + [(100 + i, "t1", 0.5) for i in range(30)], "item_id long, term string, w double")
    seen = spark.createDataFrame([(u, i) for u in range(30) for i in range(u, 80, 9)] + [(None, 3), (4, None)], "user_id long, item_id long")
    every = profile.join(weights, "term").groupBy("user_id", "item_id").agg(F.sum(F.col("q") * F.col("w")).alias("score"))
    monkeypatch.setattr(retrieval, "TEXT_USERS", 7)
    monkeypatch.setattr(retrieval, "TEXT_ITEMS", 20)
    for of in (seen, None):
        for k in (5, 200):
            want = core.ranked(core.unseen(every, of) if of else every, k)
            got = retrieval.text_top(profile, weights, k, of)
            assert rows(got, "user_id", "rank", "item_id", "score") == rows(want, "user_id", "rank", "item_id", "score")
    assert retrieval.text_top(profile.limit(0), weights, 5, seen).count() == 0
    assert retrieval.text_top(profile, weights.limit(0), 5, seen).count() == 0


@pytest.mark.parametrize("counters", [3, 64, 1 << 22])
def test_vocabulary_by_counters_equals_counting_all(spark, monkeypatch, counters):
    rng = np.random.default_rng(9)
    words = [f"w{int(x)}" for x in rng.zipf(1.5, 900) % 70]
    texts = [(i, " ".join(words[i * 20 : i * 20 + 20]) + " everywhere") for i in range(45)] + [(45, None), (46, ""), (0, "w1 w1 everywhere")]
    d = spark.createDataFrame(texts, "item_id long, text string")
    df, total = {}, {}
    for item, text in texts:
        w = [x for x in (text or "").split() if len(x) > 1]
        for term in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]:
            total[term] = total.get(term, 0) + 1
            df.setdefault(term, set()).add(item)
    monkeypatch.setattr(retrieval, "COUNTERS", counters)
    for most in (3, 25, 5000):
        want = sorted((-total[t], t, len(df[t])) for t in total if 2 <= len(df[t]) <= 0.9 * 47)[:most]
        got = retrieval.tfidf_vocabulary(d, 47, most, 2, 0.9)
        assert sorted((-r["total"], r["term"], r["df"]) for r in got.collect()) == want
    assert retrieval.tfidf_vocabulary(d.limit(0), 0).count() == 0
