"""The modes of the recommender and a thin command line.

Caches are Parquet tables keyed by a hash of their parameters; ``--force`` writes anew.
"""

from __future__ import annotations

import argparse
import dataclasses
import hashlib
import json
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import item_text
from ..operators import bpr, core, features, rankers, retrieval
from ..settings import Settings
from ..sources import readers, scratch

MODES = ("train_bpr", "train_tfidf", "train_bm25", "train_reranker", "evaluate", "compare_baselines", "candidate_recall", "submit", "ensemble_evaluate", "ensemble_submit")


_ALL = tuple(f.name for f in dataclasses.fields(Settings))


def mark(rows: DataFrame) -> list:
    """Count and sum of hashes; the sum passes a long's limit at some 17 million rows."""
    n, total = rows.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 40)).cast("decimal(38,0)"))).first()
    return [n, total if total is None else int(total)]


class Recommender:
    """Lazy data of a folder (train.csv, test.csv, item_meta.csv, sample_submission.csv) and what is derived."""

    def __init__(self, spark: SparkSession, folder: str, out: str, settings: Settings = Settings(), content: str = "tfidf", force: bool = False) -> None:  # noqa: B008
        if content not in ("tfidf", "bm25"):
            raise ValueError(f"no content model is named {content}")
        self.spark, self.folder, self.out, self.s, self.content, self.force = spark, folder, out, settings, content, force
        self.made: set[str] = set()
        self.train = readers.interactions(spark, f"{folder}/train.csv")
        self.meta = readers.item_meta(spark, f"{folder}/item_meta.csv")
        self.texts = item_text(self.meta)
        self.fit_part, self.val = core.split(self.train, settings.holdout, settings.min_rows)

    def users(self) -> DataFrame:
        return readers.query_users(self.spark, f"{self.folder}/sample_submission.csv")

    def targets(self) -> DataFrame:
        return readers.targets(self.spark, f"{self.folder}/test.csv", self.users())

    @cached_property
    def data_mark(self) -> list:
        """What tells these data from others; one scan."""
        return [*mark(self.train.select("user_id", "item_id", "ts")), *mark(self.meta)]

    def path(self, name: str, *keys: str, **key) -> str:
        """Where ``name`` is kept: by the data, the settings ``keys``, and ``key``."""
        about = [key, {k: getattr(self.s, k) for k in keys}, self.data_mark]
        return f"{self.out}/{name}-{hashlib.sha256(json.dumps(about, sort_keys=True, default=str).encode()).hexdigest()[:12]}"

    def cache(self, name: str, make, *keys: str, **key) -> DataFrame:
        path = self.path(name, *keys, **key)
        found = None if self.force and path not in self.made else readers.cached(self.spark, path)
        if found is None:
            make().write.mode("overwrite").parquet(path)
            self.made.add(path)  # forced once: what reads it already must not lose it
            found = self.spark.read.parquet(path)
        return found

    # models

    def factors(self, full: bool) -> tuple[DataFrame, DataFrame]:
        s, data = self.s, self.train if full else self.fit_part
        split = ("holdout", "min_rows", "factors", "learning_rate", "regularization", "seed")

        def make() -> DataFrame:
            saved = None if self.force else self.path("bpr-state", *split, full=full)  # without the number of iterations: more go on
            users, items, history = bpr.train(data, s.factors, s.iterations, s.learning_rate, s.regularization, s.seed, saved=saved)
            losses = [(i + 1, float(x)) for i, x in enumerate(history)]
            self.spark.createDataFrame(losses, "iteration int, loss double").coalesce(1).write.mode("overwrite").json(f"{self.out}/bpr_loss_{'full' if full else 'split'}")
            return users.withColumn("kind", F.lit("user")).unionByName(items.withColumn("kind", F.lit("item")))

        f = self.cache("bpr", make, *split, "iterations", full=full)
        return f.where("kind = 'user'").drop("kind"), f.where("kind = 'item'").drop("kind")

    def weights(self) -> DataFrame:
        n = self.texts.count()
        if self.content == "bm25":
            return self.cache("bm25", lambda: retrieval.bm25_weights(retrieval.bm25_postings(self.texts), n))
        s = self.s

        def weights() -> DataFrame:
            v = scratch.stash(retrieval.tfidf_vocabulary(self.texts, n, s.max_features, s.min_df, s.max_df))
            return retrieval.tfidf_weights(retrieval.tfidf_counts(self.texts, v), v, n)

        return self.cache("tfidf", weights, "max_features", "min_df", "max_df")

    def profile(self, seen: DataFrame) -> DataFrame:
        if self.content == "bm25":
            return retrieval.bm25_profile(seen, retrieval.bm25_postings(self.texts))
        return retrieval.tfidf_profile(seen, self.weights())

    # candidates and features

    def pools(self, data: DataFrame, users: DataFrame, full: bool, k: int) -> dict[str, DataFrame]:
        mine = data.join(users.select("user_id"), "user_id", "left_semi")
        seen = core.seen(mine)
        fu, fi = self.factors(full)
        fu = fu.join(users.select(F.col("user_id").alias("id")), "id", "left_semi")
        cooc = retrieval.cooc_scores(mine, retrieval.similarity(data), self.s.tau)
        best = lambda scores: core.ranked(core.unseen(scores, seen), k)
        return {"bpr": retrieval.factor_top(fu, fi, k, seen), "tfidf": retrieval.text_top(scratch.stash(self.profile(seen)), self.weights(), k, seen), "cooc": best(cooc)}

    def dataset(self, data: DataFrame, users: DataFrame, full: bool, targets: DataFrame | None) -> DataFrame:
        """Every candidate scored by all retrievers, with all features."""
        mine = data.join(users.select("user_id"), "user_id", "left_semi")
        d = core.union_candidates(**self.pools(data, users, full, self.s.k_retrieval))
        d = retrieval.factor_of_candidates(d, *self.factors(full))
        d = retrieval.score_candidates(d, self.profile(core.seen(mine)), self.weights(), self.texts, "tfidf_score")
        d = retrieval.cooc_of_candidates(d, retrieval.cooc_scores(mine, retrieval.similarity(data), self.s.tau), data)
        items = features.item_features(self.meta, data)
        d = features.with_features(d, items, features.user_features(data, items))
        return features.compact(d if targets is None else features.labelled(d, targets))

    def training_rows(self) -> DataFrame:
        users = self.val.select("user_id").distinct()
        rows = self.cache("reranker_train", lambda: self.dataset(self.fit_part, users, False, self.val), *_ALL, content=self.content)
        return features.with_positives(rows)

    def inference_rows(self) -> DataFrame:
        return self.cache("reranker_inference", lambda: self.dataset(self.train, self.users(), True, None), *_ALL, content=self.content)

    def ranker_path(self, name: str) -> str:
        """A ranker is kept by the data, the settings and the content model it was fitted with."""
        return self.path(f"ranker-{name}", *_ALL, content=self.content)

    def train_ranker(self, name: str) -> None:
        """Keeps a fitted ranker; one that is kept stays, unless forced. Tree rankers go on
        from where an interrupted fit, or one of fewer rounds, stopped."""
        path = self.ranker_path(name)
        if not self.force and readers.exists(self.spark, f"{path}/columns/_SUCCESS"):
            return
        settings = {}
        if name != "linear":
            rest = [k for k in _ALL if k != "rounds"]
            settings = {"rounds": self.s.rounds, "seed": self.s.seed, "saved": None if self.force else self.path(f"ranker-state-{name}", *rest, content=self.content)}
        rankers.ranker(name, **settings).fit(self.training_rows()).save(path)

    def predictions(self, name: str) -> DataFrame:
        return rankers.ranker(name).load(self.spark, self.ranker_path(name)).predict(self.inference_rows())

    def top(self, name: str) -> DataFrame:
        return core.ranked(self.predictions(name), self.s.top_k)

    def ensemble(self, weight: float) -> DataFrame:
        a = self.predictions("lambda").withColumnRenamed("score", "a")
        b = self.predictions("yeti").withColumnRenamed("score", "b")
        return core.ensemble(a.join(b, ["user_id", "item_id"]), "a", "b", weight, self.s.top_k)

    # reports

    def compare_baselines(self, name: str) -> DataFrame:
        users, targets = self.users(), self.targets()
        pools = self.pools(self.train, users, True, self.s.top_k)
        recs = {"popularity": core.popular_for_users(self.train, users, core.seen(self.train), self.s.top_k), "content": pools["tfidf"], "bpr": pools["bpr"], "pipeline": self.top(name)}
        return self._report({k: core.recall(r, targets, self.s.top_k) for k, r in recs.items()})

    def candidate_recall(self, k: int = 100) -> DataFrame:
        p, targets = self.pools(self.train, self.users(), True, k), self.targets()
        p = {n: d.select("user_id", "item_id", "rank") for n, d in p.items()}
        p["bpr+content"] = p["bpr"].unionByName(p["tfidf"])
        p["all"] = p["bpr+content"].unionByName(p["cooc"])
        d = self._report({n: core.recall(x, targets, None) for n, x in p.items()})
        better = F.col("recall") >= self.s.baseline_union_recall + self.s.improvement
        return d.withColumn("improves", F.when((F.col("name") == "all") & F.lit(k == 500), better))

    def _report(self, parts: dict[str, DataFrame]) -> DataFrame:
        out = None
        for name, d in parts.items():
            d = d.select(F.lit(name).alias("name"), "recall")
            out = d if out is None else out.unionByName(d)
        return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--mode", choices=MODES, required=True)
    p.add_argument("--data", default="Data")
    p.add_argument("--out", default="artifacts")
    p.add_argument("--full", action="store_true")
    p.add_argument("--force", action="store_true")
    p.add_argument("--reranker", choices=sorted(rankers.RANKERS), default="lambda")
    p.add_argument("--content", choices=("tfidf", "bm25"), default="tfidf")
    p.add_argument("--candidate-k", type=int, default=100)
    p.add_argument("--cooc-tau", type=float, default=Settings.tau)
    p.add_argument("--lgbm-weight", type=float, default=0.5)
    p.add_argument("--iterations", type=int, default=Settings.iterations)
    p.add_argument("--rounds", type=int, default=Settings.rounds)
    a = p.parse_args(argv)
    spark = SparkSession.getActiveSession()
    if spark is None:
        from ..session import session

        spark = session()
    r = Recommender(spark, a.data, a.out, Settings(tau=a.cooc_tau, iterations=a.iterations, rounds=a.rounds), a.content, a.force)
    if a.mode == "train_bpr":
        r.factors(a.full)
    elif a.mode in ("train_tfidf", "train_bm25"):
        r.content = a.mode.removeprefix("train_")
        r.weights()
    elif a.mode == "train_reranker":
        r.train_ranker(a.reranker)
    elif a.mode in ("evaluate", "ensemble_evaluate"):
        recs = r.top(a.reranker) if a.mode == "evaluate" else r.ensemble(a.lgbm_weight)
        print(f"Recall@{r.s.top_k}: {core.recall(recs, r.targets(), r.s.top_k).first()[0]:.4f}")
    elif a.mode in ("submit", "ensemble_submit"):
        recs = r.top(a.reranker) if a.mode == "submit" else r.ensemble(a.lgbm_weight)
        core.write_submission(recs, r.users(), f"{a.out}/submission", r.s.top_k)
    else:
        report = r.compare_baselines(a.reranker) if a.mode == "compare_baselines" else r.candidate_recall(a.candidate_k)
        for row in report.collect():
            print(*row)


if __name__ == "__main__":
    main()
