"""All modes run on a small planted data set."""

import random

import pytest

from tidemark.plans import modes


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d, r = tmp_path_factory.mktemp("data"), random.Random(0)
    taste = {u: u % 2 for u in range(12)}
    pick = lambda u: 2 * r.randrange(15) + taste[u]
    rows = [(u, pick(u), t) for u in taste for t in range(8)]
    write = lambda name, head, lines: (d / name).write_text("\n".join([head, *(",".join(map(str, x)) for x in lines)]) + "\n")
    write("train.csv", "user_id,item_id,timestamp", rows)
    write("test.csv", "user_id,item_id,timestamp", [(u, pick(u), 99) for u in taste])
    words = ["steel beaker lab", "paper pen office"]
    write("item_meta.csv", "item_id,title,main_category,features,description,categories,store,average_rating,rating_number,price",
          [(i, f"item{i} {words[i % 2]}", f"c{i % 2}", "", "", "", f"s{i % 3}", 1 + i % 5, i, 2.5 * i) for i in range(30)])
    write("sample_submission.csv", "ID,user_id,item_id", [(i, u, "") for i, u in enumerate(taste)])
    return d


def test_modes(spark, folder, tmp_path, capsys):
    common = ["--data", str(folder), "--out", str(tmp_path), "--iterations", "2", "--rounds", "3", "--cooc-tau", "10"]
    run = lambda mode, *more: modes.main(["--mode", mode, *common, *more])
    for mode in ("train_bpr", "train_tfidf"):
        run(mode)
    run("train_reranker", "--reranker", "linear")
    run("evaluate", "--reranker", "linear")
    assert "Recall@10" in capsys.readouterr().out
    run("submit", "--reranker", "linear")
    assert spark.read.option("header", True).csv(f"{tmp_path}/submission").count() == 12
    run("candidate_recall", "--candidate-k", "20")
    assert "bpr+content" in capsys.readouterr().out
    run("compare_baselines", "--reranker", "linear")
    out = capsys.readouterr().out
    assert all(name in out for name in ("popularity", "content", "bpr", "pipeline"))
    for name in ("lambda", "yeti"):
        run("train_reranker", "--reranker", name)
    run("ensemble_evaluate", "--lgbm-weight", "0.3")
    assert "Recall@10" in capsys.readouterr().out
    run("ensemble_submit")
    assert spark.read.option("header", True).csv(f"{tmp_path}/submission").count() == 12
    # another content model has its own rankers
    run("train_bm25")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|doesn't exist"):
        run("evaluate", "--reranker", "linear", "--content", "bm25")
    run("train_reranker", "--reranker", "linear", "--content", "bm25")
    run("evaluate", "--reranker", "linear", "--content", "bm25")
    assert "Recall@10" in capsys.readouterr().out


def test_force_and_full(spark, folder, tmp_path):
    common = ["--data", str(folder), "--out", str(tmp_path), "--iterations", "2"]
    run = lambda *more: modes.main(["--mode", "train_bpr", *common, *more])
    made = lambda: {str(p): p.stat().st_mtime_ns for p in tmp_path.glob("bpr-*/_SUCCESS")}
    run()
    split = made()
    run()
    assert made() == split and len(split) == 1  # what is there stays
    run("--full")
    both = made()
    assert len(both) == 2 and both.items() >= split.items()  # all data have a model of their own
    assert (tmp_path / "bpr_loss_full").exists() and (tmp_path / "bpr_loss_split").exists()
    run("--full", "--force")
    again = made()
    (full,) = both.keys() - split.keys()
    assert again.keys() == both.keys() and again[full] > both[full] and again.items() >= split.items()
    whole = spark.read.parquet(full.removesuffix("/_SUCCESS"))
    assert whole.where("kind = 'user'").count() == 12


def test_kept_ranker_stays_unless_forced(spark, folder, tmp_path):
    common = ["--data", str(folder), "--out", str(tmp_path), "--iterations", "1", "--cooc-tau", "10", "--reranker", "yeti"]
    run = lambda *more: modes.main(["--mode", "train_reranker", *common, *more])
    made = lambda: {str(p): p.stat().st_mtime_ns for p in tmp_path.glob("ranker-yeti-*/columns/_SUCCESS")}
    run("--rounds", "2")
    first = made()
    run("--rounds", "2")
    assert made() == first and len(first) == 1
    states = {p.name for p in tmp_path.glob("ranker-state-yeti-*/trees-*")}
    run("--rounds", "4")  # goes on from the two trees that are there
    assert len(made()) == 2 and states == {"trees-2"} and len(list(tmp_path.glob("ranker-state-yeti-*/trees-4"))) == 1
    run("--rounds", "2", "--force")
    again = made()
    assert len(again) == 2 and all(again[k] > t for k, t in first.items())


def test_mark_of_many_rows(spark):
    n, total = modes.mark(spark.range(18_000_000))
    assert n == 18_000_000 and total > 2**63  # the sum of a long's hashes failed
    assert modes.mark(spark.range(0)) == [0, None]
