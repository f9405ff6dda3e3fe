"""Balanced label propagation of linked documents over shards.

Every document starts in a shard drawn by its number. In rounds, linked documents
propose to move to the shard where most of their neighbours are; a shard accepts
proposals while it has room, so links get cut less while no shard outgrows its
quota. Documents without links then fill all shards to counts at most one apart.

Equal texts are linked as two-level stars: the members of a chunk of a group to the
chunk's first member, and those to the group's first. A group larger than a shard so
moves chunk by chunk and is cut in few places only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered, partitions, stash, table, utf8

SHARDS = 8
ROUNDS = 6
SEED = 7


def running(df: DataFrame, key: str, order: list[Column], weight: str, out: str) -> DataFrame:
    """Sum of ``weight`` up to and including the row, within ``key``, in the order of a
    hash bucket and then ``order``; only the buckets' sums pass through one window."""
    n = partitions(df.sparkSession) * 4
    d = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n)))
    sums = d.groupBy(key, "_b").agg(F.sum(weight).alias("_w"))
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_o", F.coalesce(F.sum("_w").over(before), F.lit(0))).drop("_w")
    inner = W.partitionBy(key, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_r", F.sum(weight).over(inner))
    return d.join(sums, [key, "_b"]).withColumn(out, F.col("_o") + F.col("_r")).drop("_b", "_o", "_r")


def equal_text_links(nodes: DataFrame, chunk: int) -> DataFrame:
    """(a, b, turn, weight): b is linked to a, moves in rounds of ``turn``, and brings
    ``weight`` documents. ``nodes``: (uid, group), group null for rows without a text."""
    many = nodes.where("group is not null").groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    m = numbered(nodes.join(many.select("group"), "group", "left_semi").select("group", "uid"), ["group"], ["uid"], "rank")
    m = stash(m.withColumn("chunk", F.floor(F.col("rank") / chunk)), "members")
    heads = m.groupBy("group", "chunk").agg(F.min(F.struct("rank", "uid"))["uid"].alias("head"), F.count(F.lit(1)).alias("weight"))
    heads = stash(heads, "heads")
    leaves = m.join(heads, ["group", "chunk"]).where("uid <> head")
    leaves = leaves.select(F.col("head").alias("a"), F.col("uid").alias("b"), F.lit(1).alias("turn"), F.lit(1).cast("long").alias("weight"))
    firsts = heads.where("chunk = 0").select("group", F.col("head").alias("a"))
    tops = heads.where("chunk > 0").join(firsts, "group").select("a", F.col("head").alias("b"), F.lit(0).alias("turn"), "weight")
    return leaves.unionByName(tops)


def propagate(nodes: DataFrame, links: DataFrame, shards: int, quota: int, rounds: int = ROUNDS) -> DataFrame:
    """(uid, shard) of the linked nodes after ``rounds``; at most ``quota`` of them, by
    weight, move into a shard. Rounds take turns: nodes move in rounds of their turn."""
    links = stash(links, "links")
    heads = links.select(F.col("a").alias("uid"), F.lit(0).alias("turn"), F.lit(1).cast("long").alias("weight"))
    own = links.select(F.col("b").alias("uid"), "turn", "weight").unionByName(heads)
    state = own.groupBy("uid").agg(F.max("turn").alias("turn"), F.max("weight").alias("weight"))
    state = stash(state.withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED), "uid"), F.lit(shards)).cast("int")), "labels")
    for r in range(rounds):
        turn = r % 2
        labels = state.select("uid", "shard")
        # what a node sees: the head it is linked to, and the nodes linked to it
        up = links.join(labels.withColumnRenamed("uid", "a"), "a").select(F.col("b").alias("uid"), "shard", F.col("weight").alias("w"))
        down = links.join(labels.withColumnRenamed("uid", "b"), "b").select(F.col("a").alias("uid"), "shard", F.lit(1).cast("long").alias("w"))
        seen = up.unionByName(down).groupBy("uid", "shard").agg(F.sum("w").alias("w"))
        best = seen.groupBy("uid").agg(F.max(F.struct("w", (-F.col("shard")).alias("s")))["s"].alias("s"))
        moves = state.where(F.col("turn") == turn).join(best, "uid")
        moves = moves.select("uid", "weight", (-F.col("s")).alias("to"), "shard").where(F.col("to") != F.col("shard"))
        weight = F.when(F.lit(turn == 0), F.col("weight")).otherwise(1)
        full = {x["shard"]: x["w"] for x in state.groupBy("shard").agg(F.sum(weight).alias("w")).collect()}  # a row per shard
        room = F.create_map(*[F.lit(v) for s in range(shards) for v in (s, max(0, quota - full.get(s, 0)))])
        moves = running(moves.withColumn("m", weight), "to", [F.col("uid")], "m", "sum")
        moves = moves.where(F.col("sum") <= room[F.col("to")]).select("uid", "to")
        state = state.join(moves, "uid", "left").select("uid", "turn", "weight", F.coalesce("to", "shard").alias("shard"))
        state = stash(state, "labels")
    return state.select("uid", "shard")


def shard_rows(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Shard and slot of every row of ``docs`` (doc_id, text): counts at most one apart.

    size is the text's UTF-8 bytes (null: none) plus 1, text_crc32 the unsigned CRC of
    those bytes. Null texts have no links; empty texts are equal texts; repeated rows and
    rows without a doc_id are documents of their own; texts of any length are read
    whole; other columns, whatever their names, are left out; an empty table gives no
    rows. Slots count from 0 in each shard.
    """
    bytes_ = utf8(F.col("text"))
    base = docs.select(
        "doc_id", (F.octet_length(bytes_) + 1).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.unhex(F.md5(bytes_))).alias("group"),
    )
    base = stash(numbered(base, [], ["doc_id", "group"], "uid"), "rows")
    n = base.count()
    quota, extra = divmod(n, shards)
    links = equal_text_links(base.select("uid", "group"), max(2, quota // 8))
    linked = propagate(base.select("uid"), links, shards, quota, rounds)
    linked = stash(numbered(linked, ["shard"], ["uid"], "place"), "linked")
    goal = F.lit(quota) + (F.col("shard") < extra).cast("int")
    kept = linked.where(F.col("place") < goal).select("uid", "shard")
    held = {x["shard"]: x["n"] for x in kept.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per shard
    free = stash(numbered(base.select("uid").join(kept, "uid", "left_anti"), [], ["uid"], "number"), "free")
    to, at = F.lit(None).cast("int"), 0
    for s in range(shards):
        at += quota + (s < extra) - held.get(s, 0)
        to = F.coalesce(to, F.when(F.col("number") < at, s))
    placed = kept.select("uid", F.col("shard").cast("int").alias("shard")).unionByName(free.select("uid", to.alias("shard")))
    placed = numbered(placed, ["shard"], ["uid"], "slot")
    return base.join(placed, "uid").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7."""
    return shard_rows(table(spark, sf_dir, "documents", "doc_id", "text"))
