"""Learned rerankers with one surface: fit, predict, save, load.

The usual boosted-tree ranking libraries are not part of Spark; their objectives and tree
shapes are fitted here by distributed histogram sums (:mod:`.trees`). Scores differ from
theirs: bins, ties and regularisation are this module's own.
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..settings import CATEGORICAL, NOT_FEATURES
from ..sources import scratch
from . import trees as T
from .encoding import MISSING, TargetStatistics


def feature_columns(rows: DataFrame) -> list[str]:
    """All but keys and label, numbers before categoricals; captured when a ranker is fitted."""
    numbers = [c for c, t in rows.dtypes if c not in (*NOT_FEATURES, *CATEGORICAL) and t != "string"]
    return numbers + [c for c in CATEGORICAL if c in rows.columns]


def _inputs(columns: list[str]) -> list[str]:
    """The numbers that a ranker sees of ``columns``."""
    return [f"{c}_number" if c in CATEGORICAL else c for c in columns]


def lambdas(rows: DataFrame, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """user_id, item_id, lam, weight from (user_id, item_id, label, s): the gradient and the
    curvature of the pairwise logistic loss, each pair of a positive and a negative of a
    user weighted by what swapping them in the order of scores changes NDCG by.

    ``noise`` > 0 perturbs scores first, by logistic noise of that scale. Rows of users
    with one class only have no pairs, lam 0 and weight 0.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), "user_id", "item_id"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    z = F.col("s") + noise * F.ln((u + 1e-9) / (1 - u + 1e-9)) if noise else F.col("s")
    user = W.partitionBy("user_id")
    d = rows.select("user_id", "item_id", "label", z.alias("z")).withColumn("rank", F.row_number().over(user.orderBy(F.desc("z"), "item_id")))
    d = d.withColumn("gain", 1 / F.log2(F.col("rank") + 1.0))
    ideal = F.row_number().over(user.orderBy(F.desc("label"), "item_id"))
    d = d.withColumn("ideal", ideal).withColumn("best", F.sum(F.when(F.col("label") == 1, 1 / F.log2(F.col("ideal") + 1.0))).over(user))
    side = lambda k: [F.col("user_id"), *[F.col(c).alias(f"{c}_{k}") for c in ("item_id", "z", "gain")]]
    pairs = d.where("label = 1").select(*side("a"), "best").join(d.where("label = 0").select(*side("b")), "user_id")  # of one user's candidates
    rho, change = 1 / (1 + F.exp(F.col("z_a") - F.col("z_b"))), F.abs(F.col("gain_a") - F.col("gain_b")) / F.col("best")
    pairs = pairs.withColumns({"lam": rho * change, "weight": rho * (1 - rho) * change})
    ends = F.explode(F.array(F.struct(F.col("item_id_a").alias("item_id"), F.lit(1.0).alias("sign")), F.struct(F.col("item_id_b").alias("item_id"), F.lit(-1.0).alias("sign")))).alias("e")
    sums = pairs.select("user_id", ends, "lam", "weight").groupBy("user_id", F.col("e.item_id").alias("item_id"))
    sums = sums.agg(F.sum(F.col("lam") * F.col("e.sign")).alias("lam"), F.sum("weight").alias("weight"))
    out = rows.select("user_id", "item_id").join(sums, ["user_id", "item_id"], "left")
    return out.select("user_id", "item_id", F.coalesce("lam", F.lit(0.0)).alias("lam"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


class _Ranker:
    """What all rankers share: columns, and numbers in place of categoricals."""

    #: The value that missing categoricals have; None if they stay missing.
    missing: str | None = MISSING
    seed = 42

    def _encoded(self, rows: DataFrame) -> DataFrame:
        """Captures the columns of ``rows``, and gives the numbers to fit with."""
        self.columns = feature_columns(rows)
        if not self.columns:
            raise ValueError("there are no feature columns")
        self.statistics = TargetStatistics([c for c in self.columns if c in CATEGORICAL], missing=self.missing, seed=self.seed)
        return self.statistics.fit_transform(scratch.stash(rows))

    def _save(self, spark, path: str) -> None:
        self.statistics.save(f"{path}/statistics")  # columns last: they tell that a ranker is whole
        spark.createDataFrame([(i, c) for i, c in enumerate(self.columns)], "i int, c string").coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")

    def _load(self, spark, path: str) -> None:
        self.columns = [r["c"] for r in spark.read.parquet(f"{path}/columns").orderBy("i").collect()]
        self.statistics = TargetStatistics([c for c in self.columns if c in CATEGORICAL], missing=self.missing, seed=self.seed).load(spark, f"{path}/statistics")


class PairwiseLinearRanker(_Ranker):
    """Logistic regression on differences of a user's positive rows and the mean of the
    user's negative ones. Missing numbers are medians, with a flag."""

    def _numbers(self, d: DataFrame) -> DataFrame:
        inputs = _inputs(self.columns)
        d = d.withColumns({c: F.col(c).cast("double") for c in inputs})
        return d.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in inputs})

    def fit(self, rows: DataFrame) -> PairwiseLinearRanker:
        from pyspark.ml.functions import array_to_vector

        d = scratch.stash(self._numbers(self._encoded(rows)))  # read again by each step
        inputs = _inputs(self.columns)
        fill = Imputer(inputCols=inputs, outputCols=[f"{c}_filled" for c in inputs], strategy="median")
        self.vectors = Pipeline(stages=[fill, VectorAssembler(inputCols=[f"{c}_{x}" for x in ("filled", "missing") for c in inputs], outputCol="features")]).fit(d)
        d = self.vectors.transform(d).select("user_id", "label", vector_to_array("features").alias("v"))
        mean = d.where("label = 0").select("user_id", F.posexplode("v").alias("k", "x")).groupBy("user_id", "k").agg(F.avg("x").alias("x"))
        mean = mean.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda z: z["x"]).alias("m"))
        pairs = d.where("label = 1").join(mean, "user_id")
        up, down = F.zip_with("v", "m", lambda a, b: a - b), F.zip_with("m", "v", lambda a, b: a - b)
        both = pairs.select(array_to_vector(up).alias("features"), F.lit(1.0).alias("label"))
        both = both.unionByName(pairs.select(array_to_vector(down).alias("features"), F.lit(0.0).alias("label")))
        self.model = LogisticRegression(fitIntercept=False, regParam=0.01).fit(both)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        d = self.vectors.transform(self._numbers(self.statistics.transform(rows)))
        weights = F.array(*[F.lit(float(x)) for x in self.model.coefficients])
        s = F.aggregate(F.zip_with(vector_to_array("features"), weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return d.select("user_id", "item_id", s.alias("score"))

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession

        self.vectors.write().overwrite().save(f"{path}/vectors")
        self.model.write().overwrite().save(f"{path}/model")
        self._save(SparkSession.active(), path)

    def load(self, spark, path: str) -> PairwiseLinearRanker:
        from pyspark.ml.classification import LogisticRegressionModel

        self._load(spark, path)
        self.vectors, self.model = PipelineModel.load(f"{path}/vectors"), LogisticRegressionModel.load(f"{path}/model")
        return self


class TreeRanker(_Ranker):
    """Boosted trees on gradients within users: each leaf holds a Newton step.

    ``saved``: a folder for the state of a fit after every ``every`` rounds; a later fit of
    the same rows and settings goes on from there.
    """

    gradients = staticmethod(T.lambda_gradients)

    def __init__(self, rounds: int = 500, rate: float = 0.05, grow: T.Growth | None = None, seed: int = 42, saved: str | None = None, every: int = 10) -> None:
        self.rounds, self.rate, self.seed, self.saved, self.every = rounds, rate, seed, saved, every
        self.grow = grow or self.default_growth()

    def fit(self, rows: DataFrame) -> TreeRanker:
        d = self._encoded(rows)
        self.trees, self.bounds = T.boost(d, _inputs(self.columns), self.gradients, self.rounds, self.rate, self.grow, self.seed, self.saved, self.every)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return T.predicted(self.statistics.transform(rows), _inputs(self.columns), self.trees, self.bounds, self.rate)

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession

        spark = SparkSession.active()
        T.save_trees(spark, self.trees, f"{path}/trees")
        spark.createDataFrame([(json.dumps({"bounds": self.bounds, "rate": self.rate}),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
        self._save(spark, path)

    def load(self, spark, path: str) -> TreeRanker:
        self._load(spark, path)
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        self.trees, self.bounds, self.rate = T.load_trees(spark, f"{path}/trees"), about["bounds"], about["rate"]
        return self


class LambdaTreeRanker(TreeRanker):
    """Leaf-wise trees of 63 leaves with 20 rows or more on :func:`.trees.lambda_gradients`.
    Missing and unknown categoricals are missing numbers."""

    missing = None

    @staticmethod
    def default_growth() -> T.Growth:
        return T.Growth(leaves=63, min_rows=20)


class YetiTreeRanker(TreeRanker):
    """Symmetric trees of depth 6 on :func:`.trees.permutation_gradients`. Missing
    categoricals are a value of their own."""

    gradients = staticmethod(T.permutation_gradients)

    @staticmethod
    def default_growth() -> T.Growth:
        return T.Growth(depth=6, min_rows=1, min_curvature=0.0, l2=3.0, symmetric=True)


RANKERS = {"lambda": LambdaTreeRanker, "yeti": YetiTreeRanker, "linear": PairwiseLinearRanker}


def ranker(name: str, **settings):
    """The ranker of that name; ``settings`` are for tree rankers."""
    if name not in RANKERS:
        raise ValueError(f"no ranker is named {name}; there are {', '.join(sorted(RANKERS))}")
    return RANKERS[name](**settings)
