"""Co-occurrence, BM25, TF-IDF and factor retrieval; sparse throughout."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bm25_tokens, tfidf_terms
from ..sources import scratch
from ..sources.shipping import ship
from .core import numbered, ranked

#: Users and items of a block, whose factors one task holds at a time.
USERS, ITEMS = 8192, 16384
#: The same where every pair is a row.
MEET_USERS, MEET_ITEMS = 256, 1024
#: Items of a user that meet all of the user's items in one task.
HISTORY = 1000
#: Counters of terms, eight bytes each.
COUNTERS = 1 << 22
#: Users, items and entries of their vectors in a block, which one task holds at a time.
TEXT_USERS, TEXT_ITEMS, ENTRIES = 256, 2048, 1 << 22

# co-occurrence


def similarity(inter: DataFrame) -> DataFrame:
    """item_i, item_j, sim: cosines of the items' user counts, without the diagonal."""
    ui = inter.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).cast("double").alias("c"))
    norm = ui.groupBy("item_id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    ui = ui.join(norm, "item_id").select("user_id", "item_id", (F.col("c") / F.col("norm")).alias("w"))
    # a user with many items meets itself in several parts, each with all items on one side
    parts = ui.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / HISTORY).cast("int").alias("parts"))
    ui = ui.join(parts, "user_id")
    a = ui.select("user_id", F.pmod(F.xxhash64("item_id"), "parts").cast("int").alias("part"), F.col("item_id").alias("item_i"), F.col("w").alias("wi"))
    b = ui.select("user_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("item_id").alias("item_j"), F.col("w").alias("wj"))
    pairs = a.join(b, ["user_id", "part"]).where("item_i < item_j")  # one direction; the sums are mirrored
    sims = pairs.groupBy("item_i", "item_j").agg(F.sum(F.col("wi") * F.col("wj")).alias("sim"))
    ways = F.array(F.struct("item_i", "item_j"), F.struct(F.col("item_j").alias("item_i"), F.col("item_i").alias("item_j")))
    return sims.select(F.explode(ways).alias("p"), "sim").select("p.item_i", "p.item_j", "sim")


def decay(inter: DataFrame, tau: float) -> DataFrame:
    """user_id, item_id, w: exp(-age / tau), age from the user's last row; repeats add."""
    age = F.max("ts").over(W.partitionBy("user_id")) - F.col("ts")
    return inter.select("user_id", "item_id", F.exp(-age / F.lit(tau)).alias("w")).groupBy("user_id", "item_id").agg(F.sum("w").alias("w"))


def cooc_scores(inter: DataFrame, sim: DataFrame, tau: float) -> DataFrame:
    """user_id, item_id, score over items that co-occur with the user's history."""
    d = decay(inter, tau).join(sim, F.col("item_id") == F.col("item_i"))
    return d.groupBy("user_id", F.col("item_j").alias("item_id")).agg(F.sum(F.col("w") * F.col("sim")).alias("score"))


def cooc_of_candidates(candidates: DataFrame, scores: DataFrame, inter: DataFrame) -> DataFrame:
    """cooc_score: 0 for items of the catalog that are unrelated; null for others, and
    for users without history. No table of users or items passes through the driver."""
    items = inter.select("item_id").distinct().withColumn("_i", F.lit(True)).hint("merge")
    users = inter.select("user_id").distinct().withColumn("_u", F.lit(True)).hint("merge")
    d = candidates.join(scores.hint("merge").select("user_id", "item_id", F.col("score").alias("_s")), ["user_id", "item_id"], "left")
    d = d.join(items, "item_id", "left").join(users, "user_id", "left")
    return d.withColumn("cooc_score", F.when(F.col("_i") & F.col("_u"), F.coalesce("_s", F.lit(0.0)))).drop("_s", "_i", "_u")


# BM25


def bm25_terms(texts: DataFrame) -> DataFrame:
    """item_id, term; a row an occurrence."""
    return texts.select("item_id", F.explode(bm25_tokens(F.coalesce("text", F.lit("")))).alias("term"))


def bm25_postings(texts: DataFrame) -> DataFrame:
    """item_id, term, tf."""
    return bm25_terms(texts).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_idf(postings: DataFrame, n_items: int, epsilon: float = 0.25) -> DataFrame:
    """term, idf; a negative one becomes epsilon times the mean over all terms."""
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("term", (F.ln(n_items - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    mean = idf.agg(F.avg("raw").alias("mean"))  # one row
    return idf.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_weights(postings: DataFrame, n_items: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """item_id, term, w: what a term of a query adds to an item's score."""
    dl = postings.groupBy("item_id").agg(F.sum("tf").alias("dl"))
    mean = dl.agg((F.sum("dl") / n_items).alias("avgdl"))  # one row
    d = postings.join(dl, "item_id").crossJoin(F.broadcast(mean)).join(bm25_idf(postings, n_items), "term")
    w = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return d.select("item_id", "term", w.alias("w"))


def bm25_profile(seen_: DataFrame, postings: DataFrame) -> DataFrame:
    """user_id, term, q: how often the term occurs in all that the user has seen."""
    d = seen_.select("user_id", "item_id").distinct().join(postings, "item_id")
    return d.groupBy("user_id", "term").agg(F.sum("tf").cast("double").alias("q"))


# TF-IDF


def tfidf_words(texts: DataFrame) -> DataFrame:
    """item_id, term; a row an occurrence of a word or pair."""
    return texts.select("item_id", F.explode(tfidf_terms(F.coalesce("text", F.lit("")))).alias("term"))


def tfidf_counts(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """item_id, term, tf over single words and pairs of the vocabulary, whose size is a
    parameter of its own."""
    t = tfidf_words(texts).join(F.broadcast(vocabulary.select("term")), "term", "left_semi")
    return t.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_vocabulary(texts: DataFrame, n_items: int, most: int = 20_000, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    """term, df, total: the ``most`` terms with the highest counts among those in
    ``min_df`` items or more, and in ``max_df`` of all items or fewer.

    A first pass counts hashes of terms into COUNTERS numbers. No term, and no number of
    items with it, exceeds its counter, so only the terms of the highest counters are
    shuffled as strings and counted exactly. Other counters that reach the last count
    found so are counted in a further pass, which is there for collisions.
    """
    return tfidf_kept(texts, n_items, most, min_df, max_df)[0]


def tfidf_kept(texts: DataFrame, n_items: int, most: int = 20_000, min_df: int = 2, max_df: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """The vocabulary, and (item_id, term) rows with all occurrences of its terms, a few others
    among them: written when they are first made, so that texts are not cut again."""
    t = tfidf_words(texts).withColumn("counter", F.pmod(F.xxhash64("term"), F.lit(COUNTERS)).cast("int"))
    counters = scratch.stash(t.groupBy("counter").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_df))
    highest = scratch.stash(counters.orderBy(F.desc("n"), "counter").limit(2 * most).select("counter"))

    kept = []

    def exact(some: DataFrame) -> DataFrame:
        kept.append(scratch.stash(t.join(some, "counter", "left_semi").select("item_id", "term")))
        v = kept[-1].groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("tf"))
        v = v.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
        return scratch.stash(v.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_items)))

    found = exact(F.broadcast(highest))  # 2 * most numbers
    n, least = found.orderBy(F.desc("total")).limit(most).agg(F.count(F.lit(1)), F.min("total")).first()
    others = counters.where(F.col("n") >= (least if n == most else 0)).join(highest, "counter", "left_anti").select("counter")
    if not others.isEmpty():
        found = found.unionByName(exact(others))
    return found.orderBy(F.desc("total"), "term").limit(most), reduce(DataFrame.unionByName, kept)


def tfidf_weights(counts: DataFrame, vocabulary: DataFrame, n_items: int) -> DataFrame:
    """item_id, term, w: tf times smoothed idf, each item of length 1."""
    d = counts.join(vocabulary.select("term", "df"), "term")
    d = d.select("item_id", "term", (F.col("tf") * (F.ln((1 + n_items) / (1 + F.col("df"))) + 1)).alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("item_id")))
    return d.select("item_id", "term", (F.col("x") / length).alias("w"))


def tfidf_profile(seen_: DataFrame, weights: DataFrame) -> DataFrame:
    """user_id, term, q: the sum of the seen items' vectors, scaled to length 1."""
    d = seen_.select("user_id", "item_id").distinct().join(weights, "item_id")
    d = d.groupBy("user_id", "term").agg(F.sum("w").alias("q"))
    length = F.sqrt(F.sum(F.col("q") * F.col("q")).over(W.partitionBy("user_id")))
    return d.select("user_id", "term", (F.col("q") / length).alias("q"))


def text_top(profile: DataFrame, weights: DataFrame, k: int, seen_: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """user_id, item_id, rank, score: each user's k best items that are not in ``seen_``,
    ranked as by :func:`ranked` by the sum of q * w over the terms that both share; items
    that share none are not listed.

    Users and items are dealt into blocks by hash. Each block of users meets each block of
    items as a matrix product over the terms that both have, some terms at a time, and
    passes on k items a user, so no row is made for a posting or for a pair.
    """
    terms = numbered(weights.select("term").distinct(), "term", "t")

    def vectors(rows: DataFrame, key: str, x: str) -> DataFrame:
        rows = rows.where(F.col(x).isNotNull()).join(terms, "term").groupBy(F.col(key).alias("id")).agg(F.collect_list(F.struct("t", F.col(x).alias("x"))).alias("v"))
        return scratch.stash(rows.select("id", "v.t", "v.x"))

    def blocks(rows: DataFrame, size: int) -> int:
        n, entries = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("t")), F.lit(0))).first()
        return max(n // size, entries // ENTRIES) + 1

    users, items = vectors(profile, "user_id", "q"), vectors(weights, "item_id", "w")
    nu, ni = blocks(users, TEXT_USERS), blocks(items, TEXT_ITEMS)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = users.select(deal("id", nu).alias("ub"), every(ni).alias("ib"), "id", "t", "x", F.lit(0).cast("long").alias("item"))
    if seen_ is not None:
        mine = seen_.select(F.col("user_id").alias("id"), F.col("item_id").alias("item")).where("id is not null and item is not null")
        left = left.unionByName(mine.select(deal("id", nu).alias("ub"), deal("item", ni).alias("ib"), "id", F.lit(None).cast("array<long>").alias("t"), F.lit(None).cast("array<double>").alias("x"), "item"))
    first = _largest()
    right = items.select(deal("id", ni).alias("ib"), every(nu).alias("ub"), "id", "t", "x")

    def best(a, b):
        import numpy as np
        import pandas as pd

        def entries(d):
            """Rows, terms and values, by terms."""
            t = np.concatenate(d["t"].to_numpy())
            order = np.argsort(t, kind="stable")
            return np.repeat(np.arange(len(d)), d["t"].map(len))[order], t[order], np.concatenate(d["x"].to_numpy())[order]

        own, pairs = a[a["t"].notna()], a[a["t"].isna()]
        none = pd.DataFrame({"user_id": [], "item_id": [], "score": []}).astype({"user_id": "int64", "item_id": "int64"})
        if own.empty or b.empty:
            return none
        b = b.sort_values("id")
        ids = b["id"].to_numpy()
        (ur, ut, ux), (ir, it, ix) = entries(own), entries(b)
        common = np.intersect1d(ut, it)
        scores = np.zeros((len(own), len(b)))
        plain = ux.min() > 0 and ix.min() > 0  # then a score above 0 tells that a term is shared
        shared = None if plain else np.zeros(scores.shape, np.float32)
        for at in range(0, len(common), 2048):  # a product over at most 2048 terms is held
            some = common[at : at + 2048]

            def dense(n, rows, terms, values, some=some):
                lo, hi = np.searchsorted(terms, some[0]), np.searchsorted(terms, some[-1], "right")
                place = np.searchsorted(some, terms[lo:hi])
                hit = some[place] == terms[lo:hi]
                m, there = np.zeros((n, len(some))), (rows[lo:hi][hit], place[hit])
                m[there] = values[lo:hi][hit]
                return m, there

            p, at_p = dense(len(own), ur, ut, ux)
            w, at_w = dense(len(b), ir, it, ix)
            scores += p @ w.T
            if not plain:
                p, w = np.zeros(p.shape, np.float32), np.zeros(w.shape, np.float32)
                p[at_p], w[at_w] = 1, 1
                shared += p @ w.T
        free = scores > 0 if plain else shared > 0
        row_of = {u: i for i, u in enumerate(own["id"])}
        row, col = pairs["id"].map(row_of), np.searchsorted(ids, pairs["item"])
        known = row.notna().to_numpy() & (ids[np.minimum(col, len(ids) - 1)] == pairs["item"].to_numpy())
        free[row[known].astype(int), col[known]] = False
        out = [none]
        for user, x, may in zip(own["id"].to_numpy(), scores, free, strict=True):
            may = np.flatnonzero(may)
            may = may[first(np.round(x[may], digits), k)]
            out.append(pd.DataFrame({"user_id": user, "item_id": ids[may], "score": x[may]}))
        return pd.concat(out)

    met = left.groupBy("ub", "ib").cogroup(right.groupBy("ub", "ib")).applyInPandas(best, "user_id long, item_id long, score double")
    return ranked(met, k, digits=digits)


def score_candidates(candidates: DataFrame, profile: DataFrame, weights: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """Only the candidates' scores: null without a profile or for items without
    metadata, else the match, which may be 0."""
    d = candidates.select("user_id", "item_id").join(weights, "item_id").join(profile, ["user_id", "term"])
    s = d.groupBy("user_id", "item_id").agg(F.sum(F.col("q") * F.col("w")).alias("_s"))
    known, users = texts.select("item_id").distinct().withColumn("_i", F.lit(True)), profile.select("user_id").distinct().withColumn("_u", F.lit(True))
    d = candidates.join(s, ["user_id", "item_id"], "left").join(known, "item_id", "left").join(users, "user_id", "left")
    return d.withColumn(name, F.when(F.col("_i") & F.col("_u"), F.coalesce("_s", F.lit(0.0)))).drop("_s", "_i", "_u")


# factors


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def factor_scores(users: DataFrame, items: DataFrame) -> DataFrame:
    """user_id, item_id, score of every pair of (id, f) rows: what ranking by factors asks for.

    Rows are packed some hundreds at a time; each pack of users meets each of items as one
    matrix product. Packs of items are read again for each task, nothing is shuffled for a pair.
    A score is null where either side's factors are null or hold one, or differ in length."""
    ship(users.sparkSession)
    left = scratch.stash(_packs(users, MEET_USERS))
    left = left.repartition(max(1, min(left.count(), 2000))).select(F.col("v").alias("u"))
    met = left.crossJoin(scratch.stash(_packs(items, MEET_ITEMS)).coalesce(1).hint("shuffle_replicate_nl"))
    return met.select("u", "v").mapInArrow(_products, "user_id long, item_id long, score double")


def _packs(rows: DataFrame, size: int) -> DataFrame:
    """v: (id, f) rows, up to ``size`` of them as one blob: their number and width, ids, what
    is odd (1: no id, 2: no score), lengths, factors filled up with 0."""

    def packed(rows: pa.Table) -> bytes:
        f = rows["f"].to_pylist()
        odd = np.array([x is None or None in x for x in f], bool)
        n = np.array([0 if x is None else len(x) for x in f], np.int64)
        m = np.zeros((len(f), int(n.max())))
        for i in np.flatnonzero(~odd):
            m[i, : n[i]] = f[i]
        ids = rows["id"].combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        odd = np.array(ids.is_null()).astype(np.int8) + 2 * odd.astype(np.int8)
        return b"".join(x.tobytes() for x in (np.array(m.shape, np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), odd, n, m))

    def run(batches):
        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, size):
                held.append(b.slice(at, size))
                n += held[-1].num_rows
                while n >= size:
                    t = pa.Table.from_batches(held)
                    yield pa.record_batch([pa.array([packed(t.slice(0, size))], pa.binary())], ["v"])
                    held, n = t.slice(size).to_batches(), n - size
        if n:
            yield pa.record_batch([pa.array([packed(pa.Table.from_batches(held))], pa.binary())], ["v"])

    return rows.select("id", "f").mapInArrow(run, "v binary")


def _products(batches):
    """user_id, item_id, score of the pairs of packs."""

    def unpacked(data):
        n, wide = np.frombuffer(data, np.int64, 2).tolist()
        out, at = [], 16
        for kind, count in ((np.int64, n), (np.int8, n), (np.int64, n), (np.float64, n * wide)):
            out.append(np.frombuffer(data, kind, count, at))
            at += count * np.dtype(kind).itemsize
        return *out[:3], out[3].reshape(n, wide)

    for b in batches:
        for u, v in zip(b.column(0), b.column(1), strict=True):
            (uid, uodd, un, a), (iid, iodd, im, c) = unpacked(u.as_buffer()), unpacked(v.as_buffer())
            wide = min(a.shape[1], c.shape[1])
            with np.errstate(all="ignore"):
                x = a[:, :wide] @ c[:, :wide].T
            none = ((uodd & 2) > 0)[:, None] | ((iodd & 2) > 0)[None, :] | (un[:, None] != im[None, :])
            for at in range(0, len(uid), 16):  # some 16,384 rows a batch
                some = slice(at, at + 16)
                k = len(uid[some])
                masks = np.repeat((uodd[some] & 1) > 0, len(iid)), np.tile((iodd & 1) > 0, k), none[some].ravel()
                cols = np.repeat(uid[some], len(iid)), np.tile(iid, k), x[some].ravel()
                yield pa.record_batch([pa.array(c, mask=m if m.any() else None) for c, m in zip(cols, masks, strict=True)], ["user_id", "item_id", "score"])


def _lengths(items: DataFrame, size: int) -> list[float]:
    """Descending lengths that part the items into bands of some ``size``, the longest
    first; one number a band."""
    n = items.count()
    parts = n // size + 1
    if parts == 1:
        return []
    at = F.array(*[F.lit(1 - k / parts) for k in range(1, parts)])
    found = items.agg(F.percentile_approx("length", at, F.lit(10_000))).first()[0]
    return sorted(set(found), reverse=True)


def factor_top(users: DataFrame, items: DataFrame, k: int, seen_: DataFrame | None = None) -> DataFrame:
    """user_id, item_id, rank, score: each user's k best items of (id, f) rows that are
    not in ``seen_``, ranked as by :func:`ranked`; rows without factors take no part.

    Blocks of users meet blocks of items, which are parts of bands of lengths. A meeting
    multiplies the two matrices, some users at a time, and passes on k items a user. All
    users meet the longest items. The k-th score there tells which other blocks a user has
    to meet: by Cauchy and Schwarz no score exceeds the product of both lengths. So copies
    of a user's factors go to those blocks only, and the rows are those of meeting all.
    """
    near, far = factor_meetings(users, items, k, seen_)
    if far is None:
        return ranked(_met(*near, k), k)
    first = scratch.stash(_met(*near, k))
    return ranked(first.unionByName(_met(*far(first), k)), k)


def factor_meetings(users: DataFrame, items: DataFrame, k: int, seen_: DataFrame | None = None):
    """The (users, items) rows of the meetings with the longest items, and a function that
    gives those of the other meetings from the first scores; None if there are no others."""
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    users = users.select("id", "f").where("f is not null").withColumn("length", length("f"))
    items = items.selectExpr("id AS item", "f AS v").where("v is not null").withColumn("length", length("v"))  # both may come from one table
    bounds = _lengths(items, ITEMS)
    n_users = users.count() // USERS + 1
    band = sum(((F.col("length") < x).cast("int") for x in bounds), F.lit(0))
    sizes = {r["band"]: r["n"] for r in items.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()} if bounds else {0: 1}
    parts = [-(-sizes.get(i, 0) // ITEMS) or 1 for i in range(len(bounds) + 1)]  # equal lengths are in one band, however many
    firsts, near = [sum(parts[:i]) for i in range(len(parts))], parts[0]
    of = lambda values: F.array(*map(F.lit, values))[F.col("band")]
    block = F.pmod(F.xxhash64("id"), F.lit(n_users)).cast("int")
    items = items.withColumn("band", band).withColumn("ib", (of(firsts) + F.pmod(F.xxhash64("item"), of(parts))).cast("int"))
    right = items.select("item", "v", "ib", F.explode(F.sequence(F.lit(0), F.lit(n_users - 1))).alias("ub"))
    left = users.withColumn("ub", block)
    mine = None
    if seen_ is not None:
        mine = seen_.select(F.col("user_id").alias("id"), F.col("item_id").alias("item")).withColumn("ub", block).join(items.select("item", "ib"), "item")

    def meeting(left: DataFrame, some) -> tuple[DataFrame, DataFrame]:
        a = left.select("ub", "ib", "id", "f", F.lit(False).alias("pair"), F.lit(0).cast("long").alias("item"))
        if mine is not None:
            a = a.unionByName(mine.where(some).select("ub", "ib", "id", F.lit(None).cast("array<double>").alias("f"), F.lit(True).alias("pair"), "item"))
        return a, right.where(some).select("ub", "ib", "item", "v")

    def far(first: DataFrame) -> tuple[DataFrame, DataFrame]:
        least = ranked(first, k).groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        # no item of a band is as long as the bound above it
        longest = [float(bounds[i - 1]) for i in range(1, len(parts)) for _ in range(parts[i])]
        d = left.join(least, "id", "left").withColumn("ib", F.explode(F.sequence(F.lit(near), F.lit(sum(parts) - 1))))
        reach = F.col("length") * F.array(*map(F.lit, longest))[F.col("ib") - near] * (1 + 1e-9) + 1e-8  # scores that agree to 9 digits are ties
        return meeting(d.where((F.coalesce("n", F.lit(0)) < k) | (reach >= F.col("least"))), F.col("ib") >= near)

    first = left.withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(near - 1))))
    return meeting(first, F.col("ib") < near), far if bounds else None


def _largest():
    """A function that tells which of some numbers are the k largest; of ties the first.
    Made here, so that it goes to the executors by value."""

    def first(x, k: int):
        import numpy as np

        if len(x) <= k:
            return np.ones(len(x), bool)
        least = np.partition(x, len(x) - k)[len(x) - k]
        take = x > least
        take[np.flatnonzero(x == least)[: k - take.sum()]] = True
        return take

    return first


def _met(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """user_id, item_id, score: the k best items of each user in each block that it meets."""
    first = _largest()

    def best(a, b):
        import numpy as np
        import pandas as pd

        own, pairs = a[~a["pair"]], a[a["pair"]]
        if own.empty or b.empty:
            return pd.DataFrame({"user_id": [], "item_id": [], "score": []}).astype({"user_id": "int64", "item_id": "int64"})
        order = np.argsort(b["item"].to_numpy(), kind="stable")
        ids, v = b["item"].to_numpy()[order], np.array(b["v"].tolist(), float)[order]
        met = {u: np.searchsorted(ids, g.to_numpy()) for u, g in pairs[pairs["item"].isin(ids)].groupby("id")["item"]}
        out = []
        for at in range(0, len(own), 256):  # a product of at most 256 rows is held
            some = own.iloc[at : at + 256]
            scores = np.array(some["f"].tolist(), float) @ v.T
            for user, row in zip(some["id"].to_numpy(), scores, strict=True):
                free = np.ones(len(ids), bool)
                free[met.get(user, [])] = False
                free = np.flatnonzero(free)
                free = free[first(np.round(row[free], 9), k)]
                out.append(pd.DataFrame({"user_id": user, "item_id": ids[free], "score": row[free]}))
        return pd.concat(out)

    return left.groupBy("ub", "ib").cogroup(right.groupBy("ub", "ib")).applyInPandas(best, "user_id long, item_id long, score double")


def factor_of_candidates(candidates: DataFrame, users: DataFrame, items: DataFrame, name: str = "bpr_score") -> DataFrame:
    """Null for users or items without factors."""
    d = candidates.join(users.selectExpr("id AS user_id", "f AS fu"), "user_id", "left").join(items.selectExpr("id AS item_id", "f AS fi"), "item_id", "left")
    return d.withColumn(name, F.when(F.col("fu").isNotNull() & F.col("fi").isNotNull(), dot("fu", "fi"))).drop("fu", "fi")
