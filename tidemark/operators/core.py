"""Histories, splits, popularity, ranking, set and metric operators.

All take and return DataFrames. Interactions are (user_id, item_id, ts, seq); ties in
every ranking go to the smaller item_id, and missing scores come last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import scratch


def seen(inter: DataFrame) -> DataFrame:
    return inter.select("user_id", "item_id").distinct()


def histories(inter: DataFrame) -> DataFrame:
    """user_id, items in time order, n."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "seq", "item_id")))
    return inter.groupBy("user_id").agg(F.transform(ordered, lambda x: x["item_id"]).alias("items"), F.count(F.lit(1)).alias("n"))


def split(inter: DataFrame, ratio: float = 0.2, min_rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """(train, validation): of users with ``min_rows`` rows or more, the last
    max(1, floor(n * ratio)) rows are for validation."""
    d = held_out(inter, ratio, min_rows)
    return d.where("NOT late").drop("late"), d.where("late").drop("late")


def held_out(inter: DataFrame, ratio: float = 0.2, min_rows: int = 5) -> DataFrame:
    """``inter`` with ``late``, which tells the rows that :func:`split` gives for validation."""
    user = W.partitionBy("user_id")
    d = inter.withColumns({"_r": F.row_number().over(user.orderBy("ts", "seq")), "_n": F.count(F.lit(1)).over(user)})
    late = (F.col("_n") >= min_rows) & (F.col("_r") > F.col("_n") - F.greatest(F.lit(1), F.floor(F.col("_n") * ratio + 1e-9)))
    return d.withColumn("late", late).drop("_r", "_n")


def popularity(inter: DataFrame) -> DataFrame:
    return inter.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def ranked(scores: DataFrame, k: int | None = None, score: str = "score", digits: int | None = 9) -> DataFrame:
    """Adds rank (from 1) per user; at most ``k`` rows each. Scores that agree to
    ``digits`` are ties, so sums in another order give the same ranks."""
    s = F.round(score, digits) if digits is not None else F.col(score)
    d = scores.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(s.desc_nulls_last(), "item_id")))
    return d.where(F.col("rank") <= k) if k else d


def unseen(scores: DataFrame, seen_: DataFrame) -> DataFrame:
    return scores.join(seen_.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def top_items(inter: DataFrame, n: int = 50) -> DataFrame:
    """The n most frequent items; n is a constant, so this is a table of fixed size."""
    return popularity(inter).orderBy(F.desc("n"), "item_id").limit(n)


def popular_for_users(inter: DataFrame, users: DataFrame, seen_: DataFrame, k: int = 10, pool: int = 50) -> DataFrame:
    """The first k of the most popular items that a user has not seen."""
    d = popular_lists(top_items(inter, pool), users, seen_, k)
    return d.select("user_id", F.explode("list").alias("x")).select("user_id", "x.item_id", "x.score", "x.rank")


def popular_lists(top: DataFrame, users: DataFrame, seen_: DataFrame, k: int) -> DataFrame:
    """user_id, list of (item_id, score, rank): the first k of the few items (item_id, n) of
    ``top`` that a user has not seen. Only what users have seen of these is shuffled, not
    every user with every item."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "item_id")))
    pool = top.agg(order.alias("_pool"))  # one row
    old = seen_.join(F.broadcast(top.select("item_id")), "item_id", "left_semi").groupBy("user_id").agg(F.collect_set("item_id").alias("_old"))
    d = users.select("user_id").join(old, "user_id", "left").crossJoin(F.broadcast(pool))
    new = F.slice(F.filter("_pool", lambda x: ~F.coalesce(F.array_contains("_old", x["item_id"]), F.lit(False))), 1, k)
    return d.select("user_id", F.transform(new, lambda x, i: F.struct(x["item_id"].alias("item_id"), (-x["n"]).alias("score"), (i + 1).alias("rank"))).alias("list"))


def pad(scores: DataFrame, users: DataFrame, items: DataFrame, seen_: DataFrame) -> DataFrame:
    """All unseen items for each user, 0 where there is no score; for small catalogs."""
    every = unseen(users.select("user_id").crossJoin(items.select("item_id")), seen_)
    return every.join(scores, ["user_id", "item_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def padded_top(scores: DataFrame, users: DataFrame, items: DataFrame, seen_: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """What :func:`ranked` gives of :func:`pad`, without its pairs, for scores of 0 or more
    of ``items``. A user with fewer than k scores above 0 is filled up with the first items
    that the user has neither seen nor scored above 0; these are among the first k and as many
    more as the user has seen or scored so."""
    users, items = users.select("user_id").distinct(), items.select("item_id").distinct()
    scores, seen_ = scratch.stash(scores.select("user_id", "item_id", "score")), scratch.stash(seen_.select("user_id", "item_id").distinct())
    high = F.round("score", digits) > 0
    best = ranked(unseen(scores.where(high), seen_).join(users, "user_id", "left_semi"), k, digits=digits).drop("rank")
    best = scratch.stash(best)
    n = best.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    short = users.join(n, "user_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("user_id")
    out = seen_.unionByName(scores.where(high).select("user_id", "item_id")).join(short, "user_id", "left_semi").distinct()
    reach = short.join(out.groupBy("user_id").agg(F.count(F.lit(1)).alias("m")), "user_id", "left")
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("m", F.lit(0)) + F.lit(k - 1).cast("long"))).alias("place")
    fill = reach.select("user_id", place).join(numbered(items, "item_id", "place"), "place").select("user_id", "item_id")
    low = scores.where(~high).withColumnRenamed("score", "_s")
    fill = unseen(fill, out).join(low, ["user_id", "item_id"], "left").select("user_id", "item_id", F.coalesce("_s", F.lit(0.0)).alias("score"))
    return ranked(best.select("user_id", "item_id", "score").unionByName(fill), k, digits=digits)


def recall(recs: DataFrame, targets: DataFrame, k: int | None = 10) -> DataFrame:
    """One row, ``recall``: mean over target users of distinct hits among the first k (all
    if None), divided by the number of target rows, repeats included."""
    r = (recs.where(F.col("rank") <= k) if k else recs).select("user_id", "item_id").distinct()
    size = targets.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    hits = targets.select("user_id", "item_id").distinct().join(r, ["user_id", "item_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"))
    per = size.join(hits, "user_id", "left").select((F.coalesce("hits", F.lit(0)) / F.col("n")).alias("r"))
    return per.agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("recall"))


def ndcg(scores: DataFrame, k: int | None = None) -> DataFrame:
    """One row, ``ndcg``: mean over the users with a positive ``label`` of the discounted gain
    of their first k rows by ``score`` (all if None), divided by the largest possible."""
    user = W.partitionBy("user_id")
    d = scores.select("user_id", (F.col("label") > 0).cast("int").alias("y"), F.row_number().over(user.orderBy(F.col("score").desc_nulls_last(), "item_id")).alias("rank"))
    d = d.withColumn("ideal", F.row_number().over(user.orderBy(F.desc("y"))))
    gain = lambda place: F.sum(F.when((F.col("y") == 1) & (F.col(place) <= k if k else F.lit(True)), 1 / F.log2(F.col(place) + 1.0)).otherwise(0.0))
    per = d.groupBy("user_id").agg(gain("rank").alias("dcg"), gain("ideal").alias("best")).where("best > 0")
    return per.agg(F.coalesce(F.avg(F.col("dcg") / F.col("best")), F.lit(0.0)).alias("ndcg"))


def minmax(scores: DataFrame, *columns: str) -> DataFrame:
    """Each column scaled to [0, 1] per user; 0 where all are equal."""
    user = W.partitionBy("user_id")

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(user), F.max(c).over(user)
        return F.when(high == low, 0.0).otherwise((F.col(c) - low) / (high - low))

    return scores.withColumns({c: scaled(c) for c in columns})


def ensemble(scores: DataFrame, a: str, b: str, weight: float = 0.5, k: int = 10) -> DataFrame:
    d = minmax(scores, a, b)
    return ranked(d.select("user_id", "item_id", (weight * F.col(a) + (1 - weight) * F.col(b)).alias("score")), k)


def union_candidates(**sources: DataFrame) -> DataFrame:
    """user_id, item_id, and per source its 0-based rank, -1 where it did not retrieve
    the item. One shuffle for any number of sources."""
    tagged = [df.select("user_id", "item_id", (F.col("rank") - 1).alias("rank"), F.lit(name).alias("source")) for name, df in sources.items()]
    all_ = reduce(DataFrame.unionByName, tagged)
    rank = lambda name: F.coalesce(F.max(F.when(F.col("source") == name, F.col("rank"))), F.lit(-1)).alias(f"{name}_rank")
    return all_.groupBy("user_id", "item_id").agg(*[rank(name) for name in sources])


def numbered(rows: DataFrame, order: str, name: str = "ID") -> DataFrame:
    """``rows`` with ``name``, gapless numbers from 0 by ``order``, nulls first. Rows are sorted
    by ranges and written; a range's first number is the count of those before, so only
    one number per range passes through the driver."""
    d = scratch.stash(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["p"], r["n"]) for r in d.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    first, firsts = 0, []
    for p, n in counts:
        firsts += [F.lit(p), F.lit(first)]
        first += n
    start = F.create_map(*firsts)[part] if firsts else F.lit(0)
    return d.withColumn(name, (start + place).cast("long")).drop("_m")


def submission(recs: DataFrame) -> DataFrame:
    """ID, user_id, item_id: the ranked items joined by commas."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"].cast("string"))
    rows = recs.groupBy("user_id").agg(F.array_join(items, ",").alias("item_id"))
    return numbered(rows, "user_id").select(F.col("ID").cast("int").alias("ID"), "user_id", "item_id")


def violations(recs: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """Query users without exactly k distinct items."""
    n = recs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("n_distinct"))
    d = users.select("user_id").distinct().join(n, "user_id", "left").fillna(0, ["n", "n_distinct"])
    return d.where((F.col("n") != k) | (F.col("n_distinct") != k))


def write_submission(recs: DataFrame, users: DataFrame, path: str, k: int = 10) -> None:
    bad = violations(recs, users, k).orderBy("user_id").first()
    if bad:
        raise ValueError(f"user {bad['user_id']} has {bad['n']} items, {bad['n_distinct']} distinct; {k} are needed")
    submission(recs).repartitionByRange("ID").sortWithinPartitions("ID").write.mode("overwrite").option("header", True).csv(path)
