"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies that each of its
documents should have. The whole part is certain; the rest is the document's
fractional probability. Two fractional documents at a time, words move from one to
the other, in a direction drawn without bias, until one of them is integral; the words
of the pair stay the same. Blocks of documents are reduced so to one fractional
document each, blocks of those again, and so on: a reduction tree with some 256
children per node, each level a grouped aggregation. What a source takes therefore
differs from its target by less than the one document, a short one if there are any,
that is left at its root and rounded.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stash, table

FAN = 256
CAP = 3
SEED = 20
_EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size, n, target) from rows (source, size).

    Sources in code point order, null last, weigh 1, 2, 3, 1, ... and share all words
    by weight; none gets more than ``cap`` times its size, and what is over is shared
    anew. In closed form: target = min(cap * size, level * weight), where the level
    is found by running sums over the sources sorted by cap * size / weight. These
    windows see one row per source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("weight", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    s = s.withColumn("most", (F.lit(cap) * F.col("source_size")).cast("double"))
    by = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    s = s.withColumns({"_k": F.row_number().over(by), "_level": level})
    fits = F.when(F.col("_level") <= F.col("most") / F.col("weight"), F.struct("_k", "_level"))
    level = F.min(fits).over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["_level"]
    target = F.least(F.col("most"), level * F.col("weight"))
    return s.select("source", "source_size", "n", target.alias("target"))


def _let(value: Column, f) -> Column:
    return F.transform(F.array(value), f)[0]


def _chance(*cols: Column) -> Column:
    """In [0, 1), from a hash: the same in every run."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _whole(f: Column) -> Column:
    return (f < _EPS) | (f > 1 - _EPS)


def _fold(items: Column, level: int) -> Column:
    """Settles all of ``items`` (key, size, f), in their order, but the last one held.

    The held document draws whether it goes up (with chance f) or down, and gets
    words from the next documents, or gives words to them, until it is integral; then
    the one it last met, integral or not, is held.
    """

    def held(x: Column, f: Column, up: Column | None = None) -> Column:
        up = _chance(F.lit(SEED + level), x["key"]) < f if up is None else up
        return F.struct(x["key"].alias("key"), x["size"].alias("size"), f.alias("f"), up.alias("up"))

    def step(acc: Column, b: Column) -> Column:
        a = acc["held"]
        gain = F.least((1 - a["f"]) * a["size"], b["f"] * b["size"])
        lose = F.least(a["f"] * a["size"], (1 - b["f"]) * b["size"])
        words = F.when(a["up"], gain).otherwise(-lose)

        def met(w: Column) -> Column:
            fa, fb = a["f"] + w / a["size"], b["f"] - w / b["size"]
            a_done = F.struct(F.array_append(acc["out"], _item(a, fa)).alias("out"), held(b, fb).alias("held"))
            b_done = F.struct(F.array_append(acc["out"], _item(b, fb)).alias("out"), held(a, fa, a["up"]).alias("held"))
            return F.when(_whole(fa), a_done).otherwise(b_done)

        settled = F.struct(F.array_append(acc["out"], _item(a, a["f"])).alias("out"), held(b, b["f"]).alias("held"))
        return F.when(_whole(a["f"]), settled).otherwise(_let(words, met))

    first = items[0]
    start = F.struct(F.slice(items, 1, 0).alias("out"), held(first, first["f"]).alias("held"))
    rest = F.slice(items, F.lit(2), F.size(items))
    return F.aggregate(rest, start, step, lambda acc: F.array_append(acc["out"], _item(acc["held"], acc["held"]["f"])))


def _item(x: Column, f: Column) -> Column:
    return F.struct(x["key"].alias("key"), x["size"].alias("size"), f.alias("f"))


def mix(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """One row per row of ``docs`` (key, source, size): key, source, size, source_size,
    target, copies.

    Rows without words get the whole part of their copies, plus one by their own
    chance: they carry no words to move. Equal rows are documents of their own, and a
    null key is a key like others. A null source comes last. Other columns, whatever
    their names, are left out. An empty table gives no rows. The draw depends on keys and
    sizes only.
    """
    d = docs.select("key", "source", F.col("size").cast("long").alias("size"))
    t = source_targets(d, cap)
    t = t.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0))
    t = t.withColumn("ratio", F.when(F.abs(F.col("ratio") - F.round("ratio")) < _EPS, F.round("ratio")).otherwise(F.col("ratio")))
    t = t.withColumn("blocks", F.ceil(F.col("n") / FAN).cast("long"))
    t = stash(t.withColumn("base", F.floor("ratio").cast("long")).withColumnRenamed("source", "_s"), "targets")
    d = d.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    lone = (F.col("size") == 0) | (F.col("ratio") == F.col("base"))
    done = d.where(lone).select(
        "source", "key", "size", "base",
        F.when(_chance(F.lit(SEED), "key") < F.col("ratio") - F.col("base"), 1).otherwise(0).alias("up"), "source_size", "target",
    )
    rest = d.where(~lone).select(
        "source", "base", "source_size", "target", "blocks", F.pmod(F.xxhash64(F.lit(SEED), "key"), "blocks").alias("block"),
        "key", "size", (F.col("ratio") - F.col("base")).alias("f"),
    )
    most = t.agg(F.max("blocks")).first()[0] or 0
    level = 0
    node = ["source", "base", "source_size", "target", "blocks", "block"]
    while True:
        # in random order, but by powers of 8 of the size: long ones settle before short ones
        item = F.struct(
            (-F.floor(F.log2("size") / 3)).alias("_o"), F.xxhash64(F.lit(SEED + 1), "key").alias("_h"),
            F.col("key").alias("key"), F.col("size").alias("size"), F.col("f").alias("f"),
        )
        grouped = rest.groupBy(*node).agg(F.sort_array(F.collect_list(item)).alias("items"))
        items = F.transform("items", lambda x: _item(x, x["f"]))
        grouped = grouped.select(*node, F.explode(_fold(items, level)).alias("x"))
        grouped = stash(grouped.select(*node, "x.key", "x.size", "x.f"), f"pivotal{level}")
        last = most <= 1
        settled = grouped if last else grouped.where(_whole(F.col("f")))
        done = done.unionByName(settled.select("source", "key", "size", "base", (F.col("f") >= 0.5).cast("int").alias("up"), "source_size", "target"))
        if last:
            break
        rest = grouped.where(~_whole(F.col("f"))).withColumns(
            {"block": F.floor(F.col("block") / FAN), "blocks": F.ceil(F.col("blocks") / FAN).cast("long")}
        )
        most = -(-most // FAN)
        level += 1
    return done.select("key", "source", "size", "source_size", "target", (F.col("base") + F.col("up")).alias("copies"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to the sources' targets."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    sizes = stash(docs.select(F.col("doc_id").alias("key"), "source", word_count(F.col("text")).alias("size")), "sizes")
    return mix(sizes).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )
