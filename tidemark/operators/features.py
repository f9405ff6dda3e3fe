"""Item, user and cross features of (user, candidate) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM_COLUMNS = ("main_category", "store", "average_rating", "log_rating_number", "price")
# fixed values: the compact types of the reranker's columns
FLOATS = (
    "bpr_score", "tfidf_score", "cooc_score", "item_popularity", "average_rating", "log_rating_number", "price", "user_interaction_count",
    "user_avg_price", "user_avg_item_rating", "user_avg_log_rating_number", "price_diff_from_user_avg", "rating_diff_from_user_avg",
    "rating_number_diff_from_user_avg",
)
INTS = {"user_id": "int", "item_id": "int", "bpr_rank": "smallint", "tfidf_rank": "smallint", "cooc_rank": "smallint", "category_match": "tinyint",
        "store_match": "tinyint", "user_category_diversity": "smallint", "user_store_diversity": "smallint", "label": "tinyint"}


def item_features(meta: DataFrame, inter: DataFrame) -> DataFrame:
    """Of every item that was met or has metadata; item_popularity is log1p of its count."""
    n = inter.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"))
    d = n.join(item_columns(meta), "item_id", "full")
    return d.select("item_id", F.log1p(F.coalesce("_n", F.lit(0)).cast("double")).alias("item_popularity"), *ITEM_COLUMNS)


def item_columns(meta: DataFrame) -> DataFrame:
    """What metadata alone tell of an item."""
    return meta.select("item_id", "main_category", "store", "average_rating", F.log1p(F.col("rating_number").cast("double")).alias("log_rating_number"), "price")


def user_features(inter: DataFrame, items: DataFrame) -> DataFrame:
    """Means over interaction rows, so repeats weigh; user_interaction_count is log1p of
    the rows; ties of the dominant value go to the smallest, none is UNKNOWN."""
    d = inter.select("user_id", "item_id").join(items.select("item_id", *ITEM_COLUMNS), "item_id", "left")
    d = d.drop("item_id").repartition("user_id")  # a row takes less than the partial sums of its user
    mode = lambda c: F.coalesce(F.mode(c, True), F.lit("UNKNOWN"))
    different = lambda c: F.size(F.collect_set(c)).cast("long")  # no row is made for each
    return d.groupBy("user_id").agg(
        F.log1p(F.count(F.lit(1)).cast("double")).alias("user_interaction_count"),
        F.avg("price").alias("user_avg_price"), F.avg("average_rating").alias("user_avg_item_rating"),
        F.avg("log_rating_number").alias("user_avg_log_rating_number"),
        different("main_category").alias("user_category_diversity"), different("store").alias("user_store_diversity"),
        mode("main_category").alias("user_dominant_category"), mode("store").alias("user_dominant_store"),
    )


def with_features(candidates: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """Joins both and adds the cross features; missing values match nothing."""
    d = candidates.join(items, "item_id", "left").join(users, "user_id", "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("int")
    return d.withColumns({
        "category_match": same("main_category", "user_dominant_category"), "store_match": same("store", "user_dominant_store"),
        "price_diff_from_user_avg": F.abs(F.col("price") - F.col("user_avg_price")),
        "rating_diff_from_user_avg": F.abs(F.col("average_rating") - F.col("user_avg_item_rating")),
        "rating_number_diff_from_user_avg": F.abs(F.col("log_rating_number") - F.col("user_avg_log_rating_number")),
    })


def labelled(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    hit = targets.select("user_id", "item_id").distinct().withColumn("_hit", F.lit(True))
    d = candidates.join(hit, ["user_id", "item_id"], "left")
    return d.withColumn("label", F.col("_hit").isNotNull().cast("int")).drop("_hit")


def labelled_lists(lists: DataFrame, targets: DataFrame, top: DataFrame, positives: bool = False) -> DataFrame:
    """:func:`labelled` for lists out of the few items of ``top``: user_id, item_id, score,
    rank, label. With ``positives`` only users that have a positive label."""
    hits = targets.join(F.broadcast(top.select("item_id")), "item_id", "left_semi").groupBy("user_id").agg(F.collect_set("item_id").alias("_hits"))
    d = lists.join(hits, "user_id", "inner" if positives else "left")
    if positives:
        d = d.where(F.exists("list", lambda x: F.array_contains("_hits", x["item_id"])))
    label = F.coalesce(F.array_contains("_hits", F.col("x.item_id")), F.lit(False)).cast("int")
    return d.select("user_id", F.explode("list").alias("x"), "_hits").select("user_id", "x.item_id", "x.score", "x.rank", label.alias("label"))


def with_positives(rows: DataFrame) -> DataFrame:
    """Only users that have a positive label."""
    return rows.join(rows.where("label = 1").select("user_id").distinct(), "user_id", "left_semi")


def group_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def compact(rows: DataFrame) -> DataFrame:
    types = {c: "float" for c in FLOATS} | INTS
    return rows.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in rows.columns})


def category_codes(rows: DataFrame, column: str) -> DataFrame:
    """The dictionary of a categorical: value, code from 0 in order; values that were
    not there when it was made have no code."""
    from pyspark.sql import Window as W

    values = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return values.withColumn("code", F.row_number().over(W.orderBy("value")) - 1)  # one row per value
