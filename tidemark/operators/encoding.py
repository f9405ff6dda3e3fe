"""Numbers for categoricals of any size: ordered target statistics.

A value's number is the smoothed mean label of its rows. While a ranker is fitted, a row
gets the mean over the rows before it in a random order only, so its own label never
enters its number; later rows get the mean over all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import scratch

#: Parts of the order that are summed apart, a power of two; a value that a third of all
#: rows have meets in that many tasks.
PARTS_LOG2 = 8
MISSING = "MISSING"


def _value(column: str, missing: str | None) -> Column:
    v = F.col(column).cast("string")
    return v if missing is None else F.coalesce(v, F.lit(missing))


def statistics(rows: DataFrame, column: str, prior: float, weight: float = 1.0, missing: str | None = None) -> DataFrame:
    """value, n, positives, number of each value of ``column``: (positives + weight *
    prior) / (n + weight). Missing values are the value ``missing``, or have no row."""
    d = rows.select(_value(column, missing).alias("value"), F.col("label").cast("double").alias("y")).where("value IS NOT NULL")
    d = d.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))
    return d.withColumn("number", (F.col("positives") + weight * prior) / (F.col("n") + weight))


def ordered_statistics(rows: DataFrame, column: str, prior: float, weight: float = 1.0, missing: str | None = None, seed: int = 42, out: str = "number", base: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``out``: the number of the row's value over the rows before it, in the
    order of a hash of seed, user_id and item_id. Rows are summed within parts of that
    order and part by part, so no window holds all rows of a frequent value.

    ``base``: the same rows by a shorter plan, for the parts' sums."""
    h = F.xxhash64(F.lit(seed), "user_id", "item_id")
    more = {"_v": _value(column, missing), "_h": h, "_p": F.shiftrightunsigned(h, 64 - PARTS_LOG2).cast("int"), "_y": F.col("label").cast("double")}
    d = rows.withColumns(more).withColumn("_h", F.col("_h").bitwiseXOR(F.lit(-(1 << 63))))  # signed order is that of the parts
    sums = (rows if base is None else base).withColumns(more).groupBy("_v", "_p").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_s"))
    before = W.partitionBy("_v").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("_v").alias("_w"), F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"))
    here = W.partitionBy("_v", "_p").orderBy("_h", "user_id", "item_id").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumns({"_n": F.coalesce(F.count(F.lit(1)).over(here), F.lit(0)), "_s": F.coalesce(F.sum("_y").over(here), F.lit(0.0))})
    d = d.join(sums, d["_v"].eqNullSafe(sums["_w"]) & (d["_p"] == sums["_q"]))
    number = (F.col("_s0") + F.col("_s") + weight * prior) / (F.col("_n0") + F.col("_n") + weight)
    return d.withColumn(out, F.when(F.col("_v").isNotNull(), number)).select(*rows.columns, out)


class TargetStatistics:
    """Numbers of several categoricals; what is learned is a table (column, value, number),
    however many values there are."""

    def __init__(self, columns: list[str], weight: float = 1.0, missing: str | None = None, seed: int = 42) -> None:
        self.columns, self.weight, self.missing, self.seed = columns, weight, missing, seed

    def fit_transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with each column's number as ``<column>_number``, from the rows before.
        They are read several times a column."""
        self.table = None
        if not self.columns:
            return rows
        prior = rows.agg(F.avg(F.col("label").cast("double"))).first()[0] or 0.0
        d = rows
        for c in self.columns:
            one = statistics(rows, c, prior, self.weight, self.missing).select(F.lit(c).alias("column"), "value", "number")
            self.table = one if self.table is None else self.table.unionByName(one)
            d = ordered_statistics(d, c, prior, self.weight, self.missing, self.seed, f"{c}_number", rows)
        self.table = scratch.stash(self.table)  # of known size, so that a small one is not joined by a shuffle
        return d

    def transform(self, rows: DataFrame) -> DataFrame:
        """The same columns from all rows that were fitted; of unknown values null."""
        d = rows
        for c in self.columns:
            of = self.table.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("number").alias(f"{c}_number"))
            d = d.withColumn("_u", _value(c, self.missing))
            d = d.join(of, d["_u"] == of["_v"], "left").drop("_u", "_v")
        return d

    def save(self, path: str) -> None:
        if self.columns:
            self.table.write.mode("overwrite").parquet(path)

    def load(self, spark, path: str) -> TargetStatistics:
        self.table = spark.read.parquet(path) if self.columns else None
        return self
