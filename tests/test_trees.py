"""Histogram trees, ranking gradients and target statistics against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import core, encoding, rankers, trees
from tidemark.operators.trees import UNIT, Growth

R = "user_id long, item_id long, label int, main_category string, a double, b double, c double"


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    out = []
    for u in range(40):
        for i in r.sample(range(300), r.choice((1, 6, 14))):
            a, b = r.random(), None if r.random() < 0.3 else float(r.randrange(5))
            y = int(r.random() < 0.1 + 0.5 * (a > 0.6) + 0.3 * (b is None))
            out.append((u, i, y, f"c{i % 40}" if i % 9 else None, a, b, math.nan if i % 11 == 0 else 7.0))
    return spark.createDataFrame(out, R).repartition(5)


COLUMNS = ["a", "b", "c"]


def unpacked(state, width):
    """(label, bins, grad) of all rows, users in order."""
    got = sorted(state.collect(), key=lambda r: r["user_id"])
    get = lambda c, kind: np.frombuffer(b"".join(bytes(r[c]) for r in got), kind)
    return get("label", np.float64), get("bins", np.uint8).reshape(-1, width), get("grad", np.int64).reshape(-1, 2)


@pytest.fixture(scope="module")
def state(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("state") / "s")
    bounds = trees.boundaries(rows, COLUMNS, bins=12)
    packed = trees.pack(rows, COLUMNS, bounds)
    trees.advanced(packed, [], 0.1, trees.lambda_gradients, 1, 0, 3).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def all_splits(bins, grad, at, min_rows, grow):
    """(gain, feature, cut, missing left, rows on the left) of each split of rows ``at``."""
    value = lambda x: (x[:, 0].sum() / UNIT) ** 2 / max(x[:, 1].sum() / UNIT + grow.l2, 1e-12)
    for side in (False, True):
        for f in range(bins.shape[1]):
            for cut in range(256):
                b = bins[at, f]
                left = np.where(b == 0, side, b <= cut)
                x, y = grad[at[left]], grad[at[~left]]
                gain = value(x) + value(y) - value(grad[at])
                if min(len(x), len(y)) < min_rows or min(x[:, 1].sum(), y[:, 1].sum()) / UNIT < grow.min_curvature:
                    gain = -math.inf
                yield gain, f, cut, side, left


def brute_leaf_wise(bins, grad, grow):
    min_rows = max(1, min(grow.min_rows, len(bins) // 10))
    leaves = [np.arange(len(bins))]
    while len(leaves) < grow.leaves:
        options = [(max(all_splits(bins, grad, at, min_rows, grow), key=lambda s: s[0]), k) for k, at in enumerate(leaves)]
        (gain, *_, left), k = max(options, key=lambda x: x[0][0])
        if gain <= 0:
            break
        at = leaves.pop(k)
        leaves += [at[left], at[~left]]
    return leaves


def test_leaf_wise_tree_equals_brute_force(state):
    _, bins, grad = unpacked(state, 3)
    for grow in (Growth(leaves=9, min_rows=5), Growth(leaves=40, min_rows=2), Growth(leaves=2, min_rows=20)):
        calls = []

        def sums(tree, nodes, calls=calls):
            calls.append(len(nodes))
            return trees.histogram_sums(state, tree, nodes, 3)

        tree = trees.grow_tree(sums, grow)
        want = brute_leaf_wise(bins, grad, grow)
        got = {}
        for row, leaf in enumerate(tree.nodes(bins)):
            got.setdefault(int(leaf), []).append(row)
        assert sorted(map(tuple, got.values())) == sorted(tuple(sorted(x.tolist())) for x in want)
        for leaf, at in got.items():
            assert tree.value[leaf] == pytest.approx(grad[at, 0].sum() / grad[at, 1].sum())
        assert len(calls) < 16  # passes go with the depth, not with the leaves


def test_symmetric_tree_equals_brute_force(state):
    _, bins, grad = unpacked(state, 3)
    grow = Growth(depth=3, min_rows=4, l2=3.0, min_curvature=0.0, symmetric=True)
    tree = trees.grow_tree(lambda t, nodes: trees.histogram_sums(state, t, nodes, 3), grow)
    min_rows, leaves = 4, [np.arange(len(bins))]
    for _ in range(3):
        each = [list(all_splits(bins, grad, at, min_rows, grow)) for at in leaves]
        total = [sum(s[0] for s in same if s[0] > -math.inf) for same in zip(*each, strict=True)]
        k = int(np.argmax(total))
        leaves = [side for at, splits in zip(leaves, each, strict=True) for side in (at[splits[k][4]], at[~splits[k][4]])]
    of = tree.nodes(bins)
    assert len(tree.feature) == 15
    for at in leaves:
        if len(at):
            assert len(set(of[at])) == 1
            assert tree.value[of[at[0]]] == pytest.approx(grad[at, 0].sum() / (grad[at, 1].sum() + 3 * UNIT))


def test_histograms_do_not_depend_on_how_rows_are_dealt(state, monkeypatch):
    tree = trees.Tree()
    tree.split(0, 1, 3, True)
    one = trees.histogram_sums(state.coalesce(1), tree, [2, 1], 3)
    monkeypatch.setattr(trees, "ROWS", 10)
    assert np.array_equal(one, trees.histogram_sums(state.repartition(7), tree, [2, 1], 3))
    _, bins, grad = unpacked(state, 3)
    left = tree.nodes(bins) == 1
    assert one[1, 0, :, 0].sum() == grad[left, 0].sum() and one[0, 2, :, 2].sum() == (~left).sum()


def test_bins():
    x = np.array([[math.nan, 1.0], [-5.0, 2.0], [1.0, 2.5], [1.5, 9.0]])
    assert trees.binned(x, [[1.0], []]).tolist() == [[0, 1], [1, 1], [1, 1], [2, 1]]


def test_lambda_gradients_equal_the_joins(spark):
    r = random.Random(2)
    data = [(u, i, int(r.random() < 0.3) if u else 0, float(r.randrange(6))) for u in range(5) for i in range(14)]
    got = {(x["user_id"], x["item_id"]): (x["lam"], x["weight"]) for x in rankers.lambdas(spark.createDataFrame(data, "user_id long, item_id long, label int, s double")).collect()}
    for u in range(5):
        mine = [x for x in data if x[0] == u]
        g, h = trees.lambda_gradients(np.array([float(x[2]) for x in mine]), np.array([x[3] for x in mine]))
        for x, a, b in zip(mine, g, h, strict=True):
            assert (a, b) == pytest.approx(got[u, x[1]])


def neighbours_loop(label, score, orders):
    """Gradients over the neighbours of given orders, pair by pair; each order with a weight."""
    g, h = np.zeros(len(label)), np.zeros(len(label))
    for p, order in orders:
        for k, (a, b) in enumerate(itertools.pairwise(order), 1):
            if label[a] != label[b]:
                up, down = (a, b) if label[a] > label[b] else (b, a)
                rho = 1 / (1 + math.exp(score[up] - score[down]))
                for x, sign in ((up, 1), (down, -1)):
                    g[x] += sign * p * rho / k
                    h[x] += p * rho * (1 - rho) / k
    return g, h


def test_permutation_gradients_of_drawn_orders():
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 30):
        label, score, items = r.integers(0, 2, n).astype(float), r.normal(size=n), np.sort(r.choice(1000, n, replace=False))
        z = trees.drawn_scores(score, 17, items, 5, 2)
        orders = [(1 / len(z), sorted(range(n), key=lambda i, row=row: -row[i])) for row in z]
        got, want = trees.permutation_gradients(label, score, 17, items, 5, 2), neighbours_loop(label, score, orders)
        assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])
    assert not np.array_equal(trees.drawn_scores(score, 17, items, 5, 2), trees.drawn_scores(score, 17, items, 5, 3))


def test_permutation_gradients_come_to_all_orders(monkeypatch):
    """Of equal scores every order is as likely: the mean of many is that of all."""
    label, score, items = np.array([1.0, 0.0, 0.0, 1.0]), np.zeros(4), np.arange(4)
    monkeypatch.setattr(trees, "drawn_scores", lambda s, u, i, seed, step, f=trees.drawn_scores: f(s, u, i, seed, step, 40_000))
    every = list(itertools.permutations(range(4)))
    want = neighbours_loop(label, score, [(1 / len(every), o) for o in every])
    got = trees.permutation_gradients(label, score, 1, items, 42, 0)
    assert np.allclose(got[0], want[0], atol=0.01) and np.allclose(got[1], want[1], atol=0.01)


@pytest.mark.parametrize("name", ["lambda", "yeti"])
def test_interrupted_fit_equals_uninterrupted(rows, tmp_path, name):
    make = lambda rounds, saved=None: rankers.ranker(name, rounds=rounds, rate=0.3, saved=saved, every=2)
    whole = make(5).fit(rows)
    make(3, str(tmp_path / "s")).fit(rows)
    again = make(5, str(tmp_path / "s")).fit(rows.repartition(2))
    assert whole.trees == again.trees and len(whole.trees) == 5
    assert [t for t in whole.trees if len(t.feature) > 1]


@pytest.mark.parametrize("name", ["lambda", "yeti"])
def test_boosting_ranks_better(rows, name):
    model = rankers.ranker(name, rounds=8, rate=0.3).fit(rows)
    first = core.ndcg(rows.select("user_id", "item_id", "label", (-rows.item_id).alias("score"))).first()["ndcg"]
    scored = model.predict(rows).join(rows.select("user_id", "item_id", "label"), ["user_id", "item_id"])
    assert core.ndcg(scored).first()["ndcg"] > first + 0.1
    # the scores of the fit are those of predict, but for the numbers of categoricals
    assert scored.count() == rows.count()


def test_ndcg(spark):
    data = [(1, 1, 1, 0.1), (1, 2, 0, 0.9), (1, 3, 1, 0.9), (2, 1, 0, 1.0), (3, 5, 1, None), (3, 6, 0, -1.0)]
    d = spark.createDataFrame(data, "user_id long, item_id long, label int, score double")
    one = (1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3))
    assert core.ndcg(d).first()["ndcg"] == pytest.approx((one + 1 / math.log2(3)) / 2)  # user 2 has no positive
    assert core.ndcg(d, 1).first()["ndcg"] == 0.0
    assert core.ndcg(d.limit(0)).first()["ndcg"] == 0.0


# target statistics


def test_ordered_statistics_use_only_rows_before(spark):
    r = random.Random(6)
    data = [(u, i, int(r.random() < 0.4), r.choice(["hot", "hot", "x", "y", None])) for u in range(60) for i in range(10)]
    d = spark.createDataFrame(data, "user_id long, item_id long, label int, v string").repartition(4)
    h = {(x["user_id"], x["item_id"]): x["h"] & (1 << 64) - 1 for x in d.selectExpr("user_id", "item_id", "xxhash64(42, user_id, item_id) AS h").collect()}
    for missing in (None, "MISSING"):
        got = {(x["user_id"], x["item_id"]): x["number"] for x in encoding.ordered_statistics(d, "v", 0.25, 2.0, missing).collect()}
        sums: dict = {}
        for u, i, y, v in sorted(data, key=lambda x: h[x[0], x[1]]):
            v = missing if v is None else v
            n, s = sums.get(v, (0, 0))
            assert got[u, i] == (None if v is None else pytest.approx((s + 0.5) / (n + 2)))
            sums[v] = n + 1, s + y
        full = {x["value"]: (x["n"], x["positives"]) for x in encoding.statistics(d, "v", 0.25, 2.0, missing).collect()}
        assert full == {v: x for v, x in sums.items() if v is not None}


def test_own_label_never_enters(spark):
    data = [(u, 1, u % 2, f"v{u % 3}") for u in range(40)]
    schema = "user_id long, item_id long, label int, v string"
    number = lambda rows: {x["user_id"]: x["number"] for x in encoding.ordered_statistics(spark.createDataFrame(rows, schema), "v", 0.5).collect()}
    before = number(data)
    for u in (3, 17, 38):
        turned = [(a, b, 1 - y if a == u else y, v) for a, b, y, v in data]
        assert number(turned)[u] == before[u]


def test_each_of_many_values_has_its_own_number(spark):
    values = 10_000
    d = spark.range(values).selectExpr("explode(sequence(0, id)) AS k", "id").where("k < 3 OR k % 997 = 0")
    d = d.selectExpr("k AS user_id", "id AS item_id", "concat('v', id) AS store", "CAST(xxhash64(k, id) % 2 = 0 AS INT) AS label")
    got = encoding.TargetStatistics(["store"])
    train = got.fit_transform(d)
    assert train.count() == d.count() and got.table.count() == values
    n = {x["store"]: (x["n"], x["s"]) for x in d.groupBy("store").agg(F.count("label").alias("n"), F.sum("label").alias("s")).collect()}
    prior = sum(s for _, s in n.values()) / sum(k for k, _ in n.values())
    assert all(x["number"] == pytest.approx((n[x["value"]][1] + prior) / (n[x["value"]][0] + 1)) for x in got.table.collect())
    later = got.transform(spark.createDataFrame([("v17",), ("other",), (None,)], "store string")).collect()
    known = {x["value"]: x["number"] for x in got.table.collect()}
    assert {x["store"]: x["store_number"] for x in later} == {"v17": known["v17"], "other": None, None: known.get("MISSING")}


def test_no_features(spark):
    d = spark.createDataFrame([(1, 1, 1)], "user_id long, item_id long, label int")
    for name in rankers.RANKERS:
        with pytest.raises(ValueError, match="no feature"):
            rankers.ranker(name).fit(d)
