"""Boosted trees for ranking, grown by distributed sums of histograms.

Numbers are binned once; a user's candidates are one row of packed bytes, so a group is
never torn apart. Each pass over the rows gives the sums of gradient, curvature and count
by (node, feature, bin): tasks sum what they read, a shuffle adds the tasks' sums, and only
those sums, whose size depends on nodes, features and bins but not on rows, decide the
splits. Of two sisters only the smaller is summed, the other is their mother's rest.
Gradients are whole multiples of 2^-24, so sums are exact and trees do not depend on how
rows are dealt: a fit that is resumed equals an uninterrupted one.

``leaf_wise`` trees split the leaf of most gain next; a pass looks at all leaves that
may be split soon, and as many passes as the tree is deep suffice. ``symmetric`` trees
split all leaves of a level alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.readers import exists
from ..sources.shipping import ship
from .bpr import _hashed

#: Bins of a number, 0 for missing ones.
BINS = 255
#: Rows that a task looks at together.
ROWS = 200_000
UNIT = float(1 << 24)
_PACKED = "user_id long, items binary, label binary, bins binary, score binary, grad binary"
_COLUMNS = ["user_id", "items", "label", "bins", "score", "grad"]
_PACKED_ARROW = pa.schema([("user_id", pa.int64())] + [(c, pa.binary()) for c in _COLUMNS[1:]])


# gradients of one user's candidates, by ascending item: (gradient, curvature)


def _order(score: np.ndarray) -> np.ndarray:
    """Places by descending score, ties by item."""
    return np.argsort(-score, kind="stable")


def lambda_gradients(label: np.ndarray, score: np.ndarray, user: int = 0, items: np.ndarray | None = None, seed: int = 42, step: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairwise logistic loss, each pair of a positive and a negative weighted by what
    swapping them changes NDCG by."""
    n, pos = len(label), label > 0
    g, h = np.zeros(n), np.zeros(n)
    if not pos.any() or pos.all():
        return g, h
    gain = np.empty(n)
    gain[_order(score)] = 1 / np.log2(np.arange(2, n + 2))
    best = (1 / np.log2(np.arange(2, pos.sum() + 2))).sum()
    rho = 1 / (1 + np.exp(score[pos][:, None] - score[~pos][None, :]))
    change = np.abs(gain[pos][:, None] - gain[~pos][None, :]) / best
    lam, weight = rho * change, rho * (1 - rho) * change
    g[pos], g[~pos] = lam.sum(axis=1), -lam.sum(axis=0)
    h[pos], h[~pos] = weight.sum(axis=1), weight.sum(axis=0)
    return g, h


#: Orders that are drawn for a user in a round.
ORDERS = 10


def drawn_scores(score: np.ndarray, user: int, items: np.ndarray, seed: int, step: int, orders: int = ORDERS) -> np.ndarray:
    """A row per order: scores with logistic noise, a pure function of all that is given."""
    u = (_hashed(seed, step, user, items[None, :], np.arange(orders)[:, None]) >> np.uint64(11)).astype(np.float64)
    u = (u + 0.5) / float(1 << 53)
    return score + np.log(u / (1 - u))


def permutation_gradients(label: np.ndarray, score: np.ndarray, user: int = 0, items: np.ndarray | None = None, seed: int = 42, step: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairwise logistic loss over neighbours in drawn orders: neighbours at places
    k and k + 1 weigh 1 / k if their labels differ, averaged over the orders."""
    n = len(label)
    g, h = np.zeros(n), np.zeros(n)
    if n < 2 or (label == label[0]).all():
        return g, h
    items = np.arange(n) if items is None else items
    z = drawn_scores(score, user, items, seed, step)
    at = np.argsort(-z, axis=1, kind="stable")
    a, b = at[:, :-1], at[:, 1:]
    weight = np.broadcast_to(1 / np.arange(1, n), a.shape) * np.abs(label[a] - label[b]) / len(z)
    up = np.where(label[a] > label[b], a, b)
    down = np.where(label[a] > label[b], b, a)
    rho = 1 / (1 + np.exp(score[up] - score[down]))
    for x, y, sign in ((rho * weight, g, -1), (rho * (1 - rho) * weight, h, 1)):
        np.add.at(y, up, x)
        np.add.at(y, down, sign * x)
    return g, h


# trees


@dataclass
class Tree:
    """Nodes by number, 0 the root. feature is -1 in a leaf; else a row goes left if its bin
    is 1 to ``cut``, or is 0 and ``missing_left``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.missing_left[node] = feature, cut, missing_left
        self.left[node], self.right[node] = n = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            for name, x in (("feature", -1), ("cut", 0), ("missing_left", False), ("left", -1), ("right", -1), ("value", 0.0)):
                getattr(self, name).append(x)
        return n

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``bins``."""
        at = np.zeros(len(bins), np.int32)
        f, cut, ml, left, right = (np.array(getattr(self, c)) for c in ("feature", "cut", "missing_left", "left", "right"))
        open_ = np.flatnonzero(f[at] >= 0)
        while len(open_):
            k = at[open_]
            b = bins[open_, f[k]]
            goes = np.where(b == 0, ml[k], b <= cut[k])
            at[open_] = np.where(goes, left[k], right[k])
            open_ = open_[f[at[open_]] >= 0]
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Growth:
    leaves: int = 63
    depth: int = 6
    #: Rows of a leaf at least; a tenth of all rows if that is less.
    min_rows: int = 20
    min_curvature: float = 1e-3
    l2: float = 0.0
    symmetric: bool = False


def _score(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g * g / np.maximum(h + l2, 1e-12)


def gains(hist: np.ndarray, min_rows: int, grow: Growth) -> np.ndarray:
    """From sums (feature, bin, 3) the gain of each (missing side, feature, cut); -inf where
    a side would be too small."""
    g, h, c = (hist[:, :, k].astype(np.float64) for k in range(3))
    g, h = g / UNIT, h / UNIT
    total = [x[0].sum() for x in (g, h, c)]
    out = np.full((2, *g.shape), -np.inf)
    for side in (0, 1):  # missing right, missing left
        left = [np.cumsum(np.where(np.arange(x.shape[1]) == 0, x * side, x), axis=1) for x in (g, h, c)]
        right = [t - x for t, x in zip(total, left, strict=True)]
        ok = (left[2] >= min_rows) & (right[2] >= min_rows) & (left[1] >= grow.min_curvature) & (right[1] >= grow.min_curvature)
        gain = _score(left[0], left[1], grow.l2) + _score(right[0], right[1], grow.l2) - _score(np.array(total[0]), np.array(total[1]), grow.l2)
        out[side] = np.where(ok, gain, -np.inf)
    return out


def _best(gain: np.ndarray) -> tuple[float, int, int, bool]:
    """(gain, feature, cut, missing left); of equal ones the first."""
    side, f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[side, f, b]), int(f), int(b), bool(side)


Sums = Callable[[Tree, list[int]], np.ndarray]


def _left(tree: Tree, mother: int, hist: np.ndarray) -> np.ndarray:
    """Gradient, curvature and count of the left side of a split node."""
    x = hist[tree.feature[mother]]
    return x[1 : tree.cut[mother] + 1].sum(axis=0) + x[0] * tree.missing_left[mother]


def _all_sums(tree: Tree, nodes: list[int], known: dict[int, np.ndarray], mother: dict[int, int], sums: Sums) -> None:
    """Fills ``known`` for ``nodes``: the smaller of two sisters by a pass, the other as rest."""
    passed, rest = [n for n in nodes if n not in mother], []
    for m in dict.fromkeys(mother[n] for n in nodes if n in mother):
        a, b = tree.left[m], tree.right[m]
        if 2 * _left(tree, m, known[m])[2] > known[m][0, :, 2].sum():
            a, b = b, a
        passed.append(a)
        rest.append((m, a, b))
    for n, x in zip(passed, sums(tree, passed), strict=True):
        known[n] = x
    for m, a, b in rest:
        known[b] = known[m] - known[a]


def grow_tree(sums: Sums, grow: Growth) -> Tree:
    """A tree by ``sums``, which gives the sums (node, feature, bin, 3) of given nodes."""
    tree, known, mother = Tree(), {}, {}
    _all_sums(tree, [0], known, mother, sums)
    total = known[0][0].sum(axis=0)
    min_rows = max(1, min(grow.min_rows, int(total[2]) // 10))
    (_symmetric if grow.symmetric else _leaf_wise)(tree, known, mother, sums, min_rows, grow)
    for n, f in enumerate(tree.feature):
        if f < 0 and (n not in mother or tree.feature[mother[n]] >= 0):
            of = total
            if n in mother:
                of = _left(tree, m := mother[n], known[m])
                of = of if n == tree.left[m] else known[m][0].sum(axis=0) - of
            h = of[1] / UNIT + grow.l2
            tree.value[n] = float(of[0] / UNIT / h) if h > 0 else 0.0
    return tree


def _leaf_wise(tree: Tree, known, mother, sums: Sums, min_rows: int, grow: Growth) -> None:
    """Best first. Each pass sums the leaves that best-first order comes to, as far as known
    gains tell; when it meets only known ones, that order is the true one."""
    best: dict[int, tuple] = {0: _best(gains(known[0], min_rows, grow))}
    children: dict[int, tuple[int, int]] = {}
    while True:
        chosen, leaves, missing = [], [0], []
        while len(chosen) < grow.leaves - 1:
            ready = [n for n in leaves if n in best and best[n][0] > 0]
            missing += [n for n in leaves if n not in best and n not in missing]
            if not ready:
                break
            n = max(ready, key=lambda k: (best[k][0], -k))
            if n not in children:
                children[n] = tree.split(n, *best[n][1:])
                mother.update(dict.fromkeys(children[n], n))
            chosen.append(n)
            leaves.remove(n)
            leaves += children[n]
        if not missing:
            break
        _all_sums(tree, missing, known, mother, sums)
        for n in missing:
            best[n] = _best(gains(known[n], min_rows, grow))
    for n in set(children) - set(chosen):  # looked at, but not among the best
        tree.feature[n] = -1


def _symmetric(tree: Tree, known, mother, sums: Sums, min_rows: int, grow: Growth) -> None:
    """All leaves of a level by the split of most gain in sum. A leaf that would get a side
    that is too small adds nothing, and is split all the same."""
    leaves = [0]
    for level in range(grow.depth):
        if level:
            _all_sums(tree, leaves, known, mother, sums)
        each = np.stack([gains(known[n], min_rows, grow) for n in leaves])
        total = np.where(np.isfinite(each), each, 0).sum(axis=0)
        gain, *split = _best(total)
        if gain <= 0:
            return
        below = []
        for n in leaves:
            below += (both := tree.split(n, *split))
            mother.update(dict.fromkeys(both, n))
        leaves = below


# rows


def boundaries(rows: DataFrame, columns: list[str], bins: int = BINS) -> list[list[float]]:
    """For each column the upper bounds of its bins but the last, from quantiles of all rows."""
    at = F.array(*[F.lit(k / (bins - 1)) for k in range(1, bins - 1)])
    found = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), at, F.lit(10_000)).alias(f"q{i}") for i, c in enumerate(columns)]).first() if columns else []
    return [sorted(set(q or [])) for q in found]


def binned(x: np.ndarray, bounds: list[list[float]]) -> np.ndarray:
    """Bins of the columns of ``x``: 0 for NaN, else 1 + the bounds below the value."""
    out = np.zeros(x.shape, np.uint8)
    for f, b in enumerate(bounds):
        out[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(np.array(b, np.float64), x[:, f], "left"))
    return out


def pack(rows: DataFrame, columns: list[str], bounds: list[list[float]]) -> DataFrame:
    """One row per user: its candidates by item, as bytes; scores 0."""
    ship(rows.sparkSession)
    features = F.array(*[F.col(c).cast("double") for c in columns]).cast("array<double>")
    one = F.struct("item_id", F.col("label").cast("double").alias("label"), features.alias("x"))
    groups = rows.select("user_id", one.alias("r")).groupBy("user_id").agg(F.sort_array(F.collect_list("r")).alias("r"))

    def run(batches):
        for b in batches:
            for user, r in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                r = r.values
                n = len(r)
                x = r.field("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, len(columns))
                cols = [r.field("item_id").to_numpy(zero_copy_only=False).astype(np.int64), r.field("label").to_numpy(zero_copy_only=False).astype(np.float64), binned(x, bounds), np.zeros(n), np.zeros((n, 2), np.int64)]
                yield pa.record_batch([pa.array([user], pa.int64())] + [pa.array([c.tobytes()], pa.binary()) for c in cols], schema=_PACKED_ARROW)

    return groups.mapInArrow(run, _PACKED)


def _chunks(batches, width: int, *names: str) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray], np.ndarray]]:
    """Parts of batches of some :data:`ROWS` candidates, with their columns ``names`` in one
    array each, and the number of each user's candidates."""
    kinds = {"items": np.int64, "label": np.float64, "bins": np.uint8, "score": np.float64, "grad": np.int64}
    shapes = {"bins": (-1, width), "grad": (-1, 2)}
    for b in batches:
        column = lambda d, c: d.column(d.schema.get_field_index(c)).to_pylist()
        sizes = np.array([len(x) // 8 for x in column(b, "score")], np.int64)
        first = 0
        while first < b.num_rows:
            end = max(first + 1, first + int(np.searchsorted(np.cumsum(sizes[first:]), ROWS, "right")))
            part = b.slice(first, end - first)
            cols = {c: np.frombuffer(b"".join(column(part, c)), kinds[c]).reshape(shapes.get(c, -1)) for c in names}
            yield part, cols, sizes[first:end]
            first = end


def histogram_sums(state: DataFrame, tree: Tree, nodes: list[int], width: int) -> np.ndarray:
    """Sums (node, feature, bin, 3) of gradient, curvature (in units) and count."""
    size = len(nodes) * 256

    def run(batches):
        of = np.full(len(tree.feature), -1, np.int64)
        of[nodes] = np.arange(len(nodes))
        total = np.zeros((3, width, size), np.int64)
        for _, c, _ in _chunks(batches, width, "bins", "grad"):
            slot = of[tree.nodes(c["bins"])]
            here = slot >= 0
            slot, bins, grad = slot[here] * 256, c["bins"][here], c["grad"][here].astype(np.float64)
            for f in range(width):
                at = slot + bins[:, f]
                for k in (0, 1):  # whole numbers below 2^53: these sums are exact
                    total[k, f] += np.bincount(at, weights=grad[:, k], minlength=size).astype(np.int64)
                total[2, f] += np.bincount(at, minlength=size)
        total = total.reshape(3, -1)
        key = np.flatnonzero(total[2])
        yield pa.record_batch([pa.array(x) for x in (key, *total[:, key])], ["key", "g", "h", "c"])

    d = state.select("bins", "score", "grad").mapInArrow(run, "key long, g long, h long, c long")
    rows = d.groupBy("key").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("c").alias("c")).toArrow()
    out = np.zeros((width * size, 3), np.int64)
    for k, c in enumerate("ghc"):
        out[rows["key"].to_numpy(), k] = rows[c].to_numpy()
    return out.reshape(width, len(nodes), 256, 3).transpose(1, 0, 2, 3)


def advanced(state: DataFrame, trees: list[Tree], rate: float, gradients, seed: int, step: int, width: int, anew: bool = False) -> DataFrame:
    """The state after ``trees``: scores (from 0 if ``anew``) and the gradients of ``step``."""

    def run(batches):
        for part, c, sizes in _chunks(batches, width, "items", "label", "bins", "score"):
            score = np.zeros(len(c["score"])) if anew else c["score"].copy()
            for tree in trees:
                score += rate * tree.scores(c["bins"])
            ends = np.cumsum(sizes)
            users, out_s, out_g = part.column(0).to_pylist(), [], []
            for user, a, b in zip(users, ends - sizes, ends, strict=True):
                g, h = gradients(c["label"][a:b], score[a:b], user, c["items"][a:b], seed, step)
                out_s.append(score[a:b].tobytes())
                out_g.append(np.rint(np.stack([g, h], axis=1) * UNIT).astype(np.int64).tobytes())
            cols = [part.column(i) for i in range(4)] + [pa.array(out_s, pa.binary()), pa.array(out_g, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema=_PACKED_ARROW)

    return state.select(*_COLUMNS).mapInArrow(run, _PACKED)


_TREES = "tree int, feature array<int>, cut array<int>, missing_left array<boolean>, left array<int>, right array<int>, value array<double>"


def save_trees(spark: SparkSession, trees: list[Tree], path: str) -> None:
    rows = [(i, t.feature, t.cut, t.missing_left, t.left, t.right, t.value) for i, t in enumerate(trees)]
    spark.createDataFrame(rows, _TREES).write.mode("overwrite").parquet(path)


def load_trees(spark: SparkSession, path: str) -> list[Tree]:
    return [Tree(*r[1:]) for r in sorted(spark.read.schema(_TREES).parquet(path).collect(), key=lambda r: r["tree"])]


def boost(
    rows: DataFrame, columns: list[str], gradients, rounds: int, rate: float, grow: Growth, seed: int = 42, saved: str | None = None, every: int = 10
) -> tuple[list[Tree], list[list[float]]]:
    """(trees, bounds of bins) fitted to (user_id, item_id, label, columns). A user's
    candidates meet in one task; rows without a user or an item are left out.

    ``saved``: a folder that gets the packed rows, the bounds, and the trees after every so
    many rounds. A later call with the same arguments goes on from there. Otherwise a
    round's state is in a scratch folder until the next one is whole.
    """
    spark = rows.sparkSession
    ship(spark)
    work, width = saved or scratch.folder(spark), len(columns)
    if not width:
        raise ValueError("there are no feature columns")
    rows = rows.where("user_id IS NOT NULL AND item_id IS NOT NULL")
    if saved and exists(spark, f"{saved}/bounds/_SUCCESS") and exists(spark, f"{saved}/rows/_SUCCESS"):
        bounds = [r["b"] for r in sorted(spark.read.parquet(f"{saved}/bounds").collect(), key=lambda r: r["i"])]
    else:
        numbers = f"{scratch.folder(spark)}/numbers"  # quantiles and packing read them
        rows.select("user_id", "item_id", "label", *columns).write.parquet(numbers)
        rows = spark.read.parquet(numbers)
        bounds = boundaries(rows, columns)
        pack(rows, columns, bounds).write.mode("overwrite").parquet(f"{work}/rows")
        scratch.remove(spark, numbers)
        spark.createDataFrame(list(enumerate(bounds)), "i int, b array<double>").write.mode("overwrite").parquet(f"{work}/bounds")
    read = lambda path: spark.read.schema(_PACKED).parquet(path)
    base = read(f"{work}/rows")
    if (base.agg(F.sum(F.length("score"))).first()[0] or 0) <= 8 * ROWS:  # what one task looks at together needs no shuffle
        read = lambda path: spark.read.schema(_PACKED).parquet(path).coalesce(1)
    marks = [r for r in range(1, rounds + 1) if r % every == 0 or r == rounds] if saved else []
    done = next((r for r in reversed(marks) if exists(spark, f"{saved}/trees-{r}/_SUCCESS")), 0)
    trees = load_trees(spark, f"{saved}/trees-{done}") if done else []
    states = scratch.folder(spark)
    before, state, since = None, base, trees
    for r in range(done, rounds):
        to = f"{states}/{uuid.uuid4().hex[:8]}"
        advanced(state, since, rate, gradients, seed, r, width, anew=state is base).write.parquet(to)
        state = read(to)
        if before:
            scratch.remove(spark, before)
        before = to
        tree = grow_tree(lambda t, nodes, state=state: histogram_sums(state, t, nodes, width), grow)
        trees.append(tree)
        since = [tree]
        if r + 1 in marks:
            save_trees(spark, trees, f"{saved}/trees-{r + 1}")
    if before:
        scratch.remove(spark, before)
    return trees, bounds


def predicted(rows: DataFrame, columns: list[str], trees: list[Tree], bounds: list[list[float]], rate: float) -> DataFrame:
    """user_id, item_id, score of rows; no group and no shuffle is needed."""
    ship(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.select("user_id", "item_id").schema}

    def run(batches):
        for b in batches:
            n = b.num_rows
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, len(columns))
            bins, score = binned(x, bounds), np.zeros(n)
            for tree in trees:
                score += rate * tree.scores(bins)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], ["user_id", "item_id", "score"])

    x = F.array(*[F.col(c).cast("double") for c in columns]).cast("array<double>")
    return rows.select("user_id", "item_id", x.alias("x")).mapInArrow(run, f"user_id {kinds['user_id']}, item_id {kinds['item_id']}, score double")
