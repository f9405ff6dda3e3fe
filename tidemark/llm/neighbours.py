"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

A bounded sample trains coarse centroids and, per group of dimensions, a codebook of
residuals. Every vector is put into the cell of its centroid with the codes of its
residual and the length of what the codes miss; cells are dealt to parts, large cells in
pieces. A query goes to the parts that hold the cells that promise most, by centroid and
longest residual, once to each. There the codes of these cells are ranked by tables of the
query's products with the codebooks, and exact products are computed for all whose codes
may err too much to leave them out. How many cells a query takes, and how much of its
longest residual a cell promises, is measured on the sample with some of the queries, by
brute force; it takes more where they hold fewer vectors than it needs. The longest
vectors, which may be near to all, are in the sample.

Inner products become distances by one more dimension, which brings all vectors to
the length of the longest, so cells suit vectors of any length.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stash, partitions, ship, stash, table
from .vectors import groups, matrix, usable

K = 20
#: Most cells; there are twice the root of the number of vectors.
MAX_CELLS = 8192
#: Least and most vectors that train the index, and come to the driver: 16 a cell.
SAMPLE = 10_000, 16 * MAX_CELLS
CODES = 256
GROUPS = 32
#: Share of the sample's true neighbours that the probed cells must hold.
COVER = 0.97
#: Shares of a cell's spread, times the root of the dimensions, from which one is chosen.
HOPES = 0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0
#: Vectors are scored exactly unless their codes err by more than this many times what a
#: product with an error in a random direction would.
DOUBT = 4.0
#: Vectors in a part at most, and their components; fewer, if there are fewer than
#: partitions would take.
PART, NUMBERS = 1 << 16, 1 << 22
SEED = 5


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int32)
    half = (c * c).sum(1) / 2
    for s in range(0, len(x), 4096):
        out[s : s + 4096] = (half - x[s : s + 4096] @ c.T).argmin(1)
    return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8, weight: np.ndarray | None = None) -> np.ndarray:
    """Centroids; with ``weight`` half of the first ones are drawn by it, so the few rows that
    hold most of it have centroids of their own."""
    first = rng.permutation(len(x))[:k]
    if weight is not None and k > 1:
        heavy = np.argsort(-weight * rng.random(len(x)), kind="stable")[: k // 2]
        first = np.concatenate([heavy, np.setdiff1d(rng.permutation(len(x))[: 2 * k], heavy)])[:k]
    c = x[first].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Index:
    """Centroids, codebooks and the number of cells to probe; of bounded size."""

    def __init__(self, sample: np.ndarray, n: int, longest: float, k: int = K, asked: np.ndarray | None = None, scale: float = 1.0) -> None:
        """``sample`` are different vectors, ``asked`` some of the queries (the sample's if None),
        ``scale`` what all are divided by, ``longest`` the largest square of a length then."""
        rng = np.random.default_rng(SEED)
        self.longest, self.scale = longest, scale
        x = self.lift(sample)
        d = x.shape[1]
        most = max(1, min(MAX_CELLS, len(x) // 16, int(2 * math.sqrt(n))))
        self.cells = kmeans(x, most, rng, weight=(x[:, :-1] ** 2).sum(1))
        self.cuts = np.linspace(0, d, min(GROUPS, d) + 1).astype(int)
        at = _nearest(x, self.cells)
        part = rng.permutation(len(x))[:5000]
        rest = x[part] - self.cells[at[part]]
        self.books = [kmeans(rest[:, a:b], min(CODES, len(rest)), rng) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.miss = np.inf
        self.miss = self.encode(sample)[3].max()  # codes that miss more than ever in the sample don't decide less
        spread = np.zeros(len(self.cells))
        np.maximum.at(spread, at, np.sqrt(((x - self.cells[at])[:, :-1] ** 2).sum(1)))
        self.hope, self.probes = self._calibrate(x, at, spread, rng, k, asked)

    def lift(self, v: np.ndarray) -> np.ndarray:
        v = v / self.scale
        more = np.sqrt(np.maximum(0, self.longest - (v * v).sum(1)))
        return np.hstack([v, more[:, None]])

    def _calibrate(self, x: np.ndarray, at: np.ndarray, spread: np.ndarray, rng: np.random.Generator, k: int, asked: np.ndarray | None) -> tuple[float, int]:
        """How much of its spread a cell is hoped to reach in a query's direction, and how
        many cells a query takes: what scans the fewest of the sample's vectors."""
        v = x[:, :-1]
        q = v[rng.permutation(len(v))[:300]] if asked is None else asked[:300] / self.scale
        s = q @ v.T
        length = (v * v).sum(1)
        for i, row in enumerate(s):  # itself is no neighbour
            same = np.flatnonzero(np.abs(length - q[i] @ q[i]) <= 1e-9 * length)
            row[same[(v[same] == q[i]).all(1)]] = -np.inf
        near = np.argsort(-s, axis=1)[:, :k]
        size = np.bincount(at, minlength=len(self.cells))
        best = None
        for hope in HOPES:
            order = self._order(q, spread, hope / math.sqrt(v.shape[1]))
            rank = np.argsort(order, axis=1)
            need = np.sort(np.take_along_axis(rank, at[near], axis=1).ravel())
            m = int(need[min(len(need) - 1, int(COVER * len(need)))]) + 1 if len(need) else 1
            cost = size[order[:, :m]].sum()
            if best is None or cost < best[0]:
                best = cost, hope / math.sqrt(v.shape[1]), m
        return best[1:]

    def _order(self, q: np.ndarray, spread: np.ndarray, hope: float) -> np.ndarray:
        promise = q @ self.cells[:, :-1].T
        promise += hope * np.sqrt((q * q).sum(1))[:, None] * spread
        return np.argsort(-promise, axis=1, kind="stable")

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per vector its cell, codes, and the lengths of its residual and of what the codes miss."""
        x = self.lift(v)
        cell = _nearest(x, self.cells)
        rest = x - self.cells[cell]
        away = np.sqrt((rest[:, :-1] ** 2).sum(1))
        codes = []
        for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True):
            codes.append(_nearest(rest[:, a:b], book))
            rest[:, a:b] -= book[codes[-1]]
        return cell, np.stack(codes, axis=1).astype(np.uint8), away, np.minimum(self.miss, np.sqrt((rest[:, :-1] ** 2).sum(1)))

    def order(self, q: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """The cells, those that promise most first; ``spread`` is each cell's longest residual."""
        return self._order(q / self.scale, spread, self.hope)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Per group of dimensions, the products of its codebook with the queries."""
        q = np.hstack([q / self.scale, np.zeros((len(q), 1))])
        return [book @ q[:, a:b].T for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]

    def promised(self, cell: int, codes: np.ndarray, q: np.ndarray, tables: list[np.ndarray], who: np.ndarray) -> np.ndarray:
        """What the coded vectors of a cell promise to the queries ``who`` of q."""
        out = np.tile(q[who] / self.scale @ self.cells[cell, :-1], (len(codes), 1))
        for g, table_ in enumerate(tables):
            out += table_[:, who][codes[:, g]]
        return out


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest, largest first; ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        over = np.flatnonzero(scores > least)
        tied = np.flatnonzero(scores == least)
        tied = tied[np.argsort(ids[tied], kind="stable")[: k - len(over)]]
        at = np.concatenate([over, tied])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort([ids[at], -scores[at]])]


def _best(batches, index: Index, k: int):
    """From the rows of parts, the coded vectors of each before its queries: per query
    and part, the best by exact products of those that promise most."""
    own, have = None, []
    for b in groups(batches, 2):  # part, kind
        part, kind = (b.column(i)[0].as_py() for i in (0, 1))
        if kind == 0:
            own = part
            ids, cell, err = (b.column(c).to_numpy() for c in ("vec_id", "cell", "err"))
            order = np.argsort(cell, kind="stable")
            ids, cell, err = ids[order], cell[order], err[order]
            codes, v = (np.frombuffer(b"".join(b.column(c).to_pylist()), t).reshape(len(order), -1)[order] for c, t in (("codes", np.uint8), ("v", np.float64)))
            cut = np.searchsorted(cell, np.arange(len(index.cells) + 1))
            have = np.flatnonzero(np.diff(cut)).tolist()
            continue
        if part != own:
            continue  # pieces of cells that are empty after all
        step = max(1, min(256, (1 << 22) // len(ids)))
        for s in range(0, b.num_rows, step):
            some = b.slice(s, step)
            q = np.frombuffer(b"".join(some.column("v").to_pylist()), np.float64).reshape(some.num_rows, -1)
            probed = np.zeros((some.num_rows, len(index.cells)), bool)
            for i, x in enumerate(some.column("codes").to_pylist()):
                probed[i, np.frombuffer(x, np.int32)] = True
            tables = index.tables(q)
            scores = np.full((len(ids), some.num_rows), -np.inf)
            for c in have:
                who = np.flatnonzero(probed[:, c])
                if len(who):
                    scores[cut[c] : cut[c + 1], who] = index.promised(c, codes[cut[c] : cut[c + 1]], q, tables, who)
            scores[ids[:, None] == some.column("vec_id").to_numpy()] = -np.inf
            out = []
            for x, score in zip(q, np.ascontiguousarray(scores.T), strict=True):
                doubt = DOUBT * np.linalg.norm(x / index.scale) / math.sqrt(len(x)) * err
                low = score - doubt
                least = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
                at = np.flatnonzero((score > -np.inf) & (score + doubt >= least))
                exact = (v[at] * x).sum(1)  # the same for equal vectors, wherever they stand
                best = top(exact, ids[at], k)
                out.append((ids[at][best].tobytes(), exact[best].tobytes()))
            yield pa.record_batch([some.column("query"), some.column("vec_id"), *(pa.array([r[i] for r in out], pa.binary()) for i in (0, 1))], ["query", "query_id", "ids", "scores"])


def _ranked(batches, k: int):
    """The k best of all parts, from rows that stand together by query."""
    for b in groups(batches, 1):
        ids, score = (np.frombuffer(b"".join(b.column(c).to_pylist()), t) for c, t in (("ids", np.int64), ("scores", np.float64)))
        at = top(score, ids, k)
        m = len(at)
        cols = [np.full(m, b.column("query_id")[0].as_py()), np.arange(1, m + 1, dtype=np.int32), ids[at], score[at]]
        yield pa.record_batch([pa.array(c) for c in cols], ["query_id", "rank", "vec_id", "score"])


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank from 1, vec_id, score: for each of ``queries`` the k rows of
    ``rows`` with other ids that have the largest inner products found; ties to the
    smaller vec_id. Both: (vec_id, embedding).

    Vectors that are null, zero, or hold null or non-finite components take no part,
    nor do vectors of another length than the sample's most frequent one, or rows with
    a null vec_id. Repeated rows count each as candidates; as queries, equal rows are
    one. A query with fewer candidates than k gets all. No queries or no candidates, no rows.
    """
    spark = rows.sparkSession
    ship(spark)
    p = partitions(spark)
    good = lambda df: df.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    rows, queries = good(rows), good(queries)
    n, scale, d = rows.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("v", F.abs))), F.mode(F.size("v"), True)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, queries = rows.where(F.size("v") == d), queries.where(F.size("v") == d)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / scale) * (x / scale))
    longest = rows.agg(F.max(square)).first()[0]
    repeated = rows.groupBy("vec_id").count().agg(F.max("count")).first()[0]
    size = max(SAMPLE[0], min(SAMPLE[1], 16 * int(2 * math.sqrt(n))))

    def some(df: DataFrame, size: int, n: int) -> np.ndarray:
        chance = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
        found = df.withColumn("h", chance).where(F.col("h") < min(1 << 40, (3 * size << 40) // n + 1))  # some three times the sample
        found = found.orderBy("h", "vec_id").limit(size).select("v").toArrow()
        if not found.num_rows:  # all rows share a few ids
            found = df.limit(size).select("v").toArrow()
        return matrix(found.column("v").combine_chunks()) if found.num_rows else np.zeros((0, d))

    longer = rows.select("v", square.alias("square")).orderBy(F.desc("square")).limit(size // 8).select("v").toArrow()  # few, but near to all
    sample = np.vstack([some(rows, size, n), matrix(longer.column("v").combine_chunks())])
    asked = some(queries, 300, max(1, queries.count()))
    if not len(asked):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = Index(np.unique(sample, axis=0), n, longest, k, asked, scale)  # copies train nothing

    def coded(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for b in batches:
            v = matrix(b.column("v"))
            cell, codes, away, err = index.encode(v)
            uid = np.arange(at, at + b.num_rows)
            at += b.num_rows
            data = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (codes, v)]
            yield pa.record_batch([pa.array(uid), b.column("vec_id"), pa.array(cell), pa.array(away), pa.array(err), *data], ["uid", "vec_id", "cell", "away", "err", "codes", "v"])

    stored = stash(rows.mapInArrow(coded, "uid long, vec_id long, cell int, away double, err double, codes binary, v binary"), "vectors")
    asked = stash(queries.distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    # pieces of cells, dealt to parts from the largest on
    about = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect()  # at most MAX_CELLS rows
    sizes = {r["cell"]: r["n"] for r in about}
    most = min(PART, max(1, NUMBERS // d), max(4096, -(-n // p)))
    parts = [(c, i, s / -(-s // most)) for c, s in sizes.items() for i in range(-(-s // most))]
    loads = [(0.0, x) for x in range(-(-n // most))]
    dealt = []
    for c, i, s in sorted(parts, key=lambda x: -x[2]):
        load, x = heapq.heappop(loads)
        heapq.heappush(loads, (load + s, x))
        dealt.append((c, i, x))
    pieces: dict[int, list[int]] = {}
    for c, _, x in dealt:
        pieces.setdefault(c, []).append(x)
    where = spark.createDataFrame([(c, i, len(pieces[c]), x) for c in pieces for i, x in enumerate(pieces[c])], "cell int, piece int, pieces int, part int")
    counts = np.array([sizes.get(c, 0) for c in range(len(index.cells))])
    spread = np.zeros(len(index.cells))
    for r in about:
        spread[r["cell"]] = r["away"]

    def aimed(batches):
        for b in batches:
            out = []
            q = matrix(b.column("v"))
            for s in range(0, len(q), 256):
                order = index.order(q[s : s + 256], spread)
                enough = (np.cumsum(counts[order], axis=1) < k + repeated).sum(1) + 1
                for i, (cells, m) in enumerate(zip(order, enough, strict=True)):
                    to: dict[int, list[int]] = {}
                    for c in cells[: max(m, index.probes)].tolist():
                        for x in pieces.get(c, ()):
                            to.setdefault(x, []).append(c)
                    data = q[s + i].tobytes()
                    out += [(x, 1, b.column("query")[s + i].as_py(), b.column("vec_id")[s + i].as_py(), None, None, np.array(c, np.int32).tobytes(), data) for x, c in to.items()]
            if out:
                types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], _PARTS)

    _PARTS = ["part", "kind", "query", "vec_id", "cell", "err", "codes", "v"]
    looking = asked.select("query", "vec_id", "v").mapInArrow(aimed, "part int, kind int, query long, vec_id long, cell int, err double, codes binary, v binary")
    own = stored.join(F.broadcast(where.groupBy("cell").agg(F.max("pieces").alias("pieces"))), "cell")  # as many rows as cells
    own = own.withColumn("piece", F.pmod(F.xxhash64("uid"), "pieces").cast("int")).join(F.broadcast(where.select("cell", "piece", "part")), ["cell", "piece"])
    own = own.select("part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query"), "vec_id", "cell", "err", "codes", "v")
    both = own.unionByName(looking).repartitionById(max(1, len(loads)), F.col("part")).sortWithinPartitions("part", "kind")
    found = both.mapInArrow(lambda b: _best(b, index, k), "query long, query_id long, ids binary, scores binary")
    found = found.repartition(p, "query").sortWithinPartitions("query")
    out = stash(found.mapInArrow(lambda b: _ranked(b, k), "query_id long, rank int, vec_id long, score double"), "found")
    drop_stash(stored, asked)
    return out


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of embeddings, each vec_id divisible by 20 against all rows."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))
