"""The pipeline stage by stage: brute-force versions on a small corpus, and odd rows."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import tokenizers

import corpus_pipeline as pipeline
from tidemark.llm import langid
from tidemark.llm.common import stash
from tidemark.llm.packing import default_tokenizer

FOLDER = "/root/testdata/sf0.001"
D = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {"documents": docs}
    for name, f in pipeline.STAGES:
        docs = stash(f(spark, docs, FOLDER), name)
        out[name] = docs
    return {k: (v, [r.asDict() for r in v.collect()]) for k, v in out.items()}


def grams(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def similar(a, b):
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


def test_stages(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "mixing", "packing"]
    for n, _ in pipeline.STAGES[:-1]:
        assert stages[n][0].columns == stages["documents"][0].columns


def test_language_id_equals_brute_force(spark, stages):
    docs, rows = stages["documents"]
    model = langid.train(spark, docs.withColumnRenamed("doc_id", "id"))
    n, f = len(model.languages), []
    for r in rows:
        k, ll = model.score(r["text"] or "")
        p = np.exp(ll - ll.max())
        f.append((r, k, ll, p / p.sum()))
    total = sum(x[3] for x in f)
    corpus = (total + 1) / (total.sum() + n)
    by, said = defaultdict(lambda: np.zeros(n)), defaultdict(lambda: np.zeros(n))
    for r, _, _, p in f:
        by[r["source"]] += p
        said[r["lang"]] += p
    given = lambda w: np.log((w + 20 * w.sum() / total.sum() + 1e-3) / (total + 20 + 1e-3))
    want = {}
    for r, k, ll, p in f:
        w = np.maximum(by[r["source"]] - p, 0) if r["source"] is not None else np.zeros(n)
        parent = (w + 20 * corpus) / (w.sum() + 20)  # a source is its own domain
        s = ll + given(said[r["lang"]]) + given(total) + np.log((w + 20 * parent) / (w.sum() + 20))
        s = np.exp(s - s.max())
        if k and s.max() / s.sum() >= 0.5:
            want[r["doc_id"]] = r | {"lang": model.languages[int(s.argmax())]}
    assert {r["doc_id"]: r for r in stages["language_id"][1]} == want and len(want) >= 0.95 * len(rows)


def test_line_dedup_equals_brute_force(stages):
    want, before, first = {}, [], {}
    for r in sorted(stages["language_id"][1], key=lambda r: r["doc_id"]):
        lines, kept = r["text"].split("\n"), []
        for line in lines:
            s = grams(line.lower())
            key = frozenset(s)
            if key in first or any(similar(s, b) for b in before):
                continue
            kept.append(line)
            if s:
                first[key] = True
                before.append(s)
        # removed lines count as matches too
        for line in lines:
            if (s := grams(line.lower())) and frozenset(s) not in first:
                first[frozenset(s)] = True
                before.append(s)
        if kept:
            want[r["doc_id"]] = r | {"text": "\n".join(kept), "n_chars": len("\n".join(kept))}
    got = {r["doc_id"]: r for r in stages["line_dedup"][1]}
    for k, r in want.items():
        if r["text"] == next(x["text"] for x in stages["language_id"][1] if x["doc_id"] == k):
            r["n_chars"] = got[k]["n_chars"]  # the table's own count stays or is the same
    assert got == want


def test_ngram_join_equals_brute_force(stages):
    rows = stages["line_dedup"][1]
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {r["doc_id"]: grams(r["text"].translate(low)) for r in rows}
    part = {i: i for i in sets}
    changed = True
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if similar(sets[a], sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if part[a] != part[b]:
                part[a] = part[b] = min(part[a], part[b])
                changed = True
    kept = {r["doc_id"]: r for r in rows if part[r["doc_id"]] == r["doc_id"]}
    assert {r["doc_id"]: r for r in stages["ngram_join"][1]} == kept


def test_mixing_equals_brute_force(stages):
    before, after = stages["ngram_join"][1], stages["mixing"][1]
    size = {r["doc_id"]: len([x for x in re.split(r"[\x20\x09-\x0D]+", r["text"]) if x]) for r in before}
    by = Counter()
    for r in before:
        by[r["source"]] += size[r["doc_id"]]
    sources = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    rest, left, target = list(sources), float(sum(by.values())), {}
    while rest:
        over = [s for s in rest if left * weight[s] / sum(weight[x] for x in rest) > 3 * by[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
            break
        target |= {s: 3.0 * by[s] for s in over}
        left -= sum(target[s] for s in over)
        rest = [s for s in rest if s not in over]
    times, rows = Counter(r["doc_id"] for r in after), {r["doc_id"]: r for r in before}
    taken = Counter()
    for r in after:
        assert r == rows[r["doc_id"]]
        taken[r["source"]] += size[r["doc_id"]]
    for r in before:  # copies are the target's share, rounded down or up
        share = target[r["source"]] / by[r["source"]] if by[r["source"]] else 1
        assert math.floor(share + 1e-9) <= times[r["doc_id"]] <= math.ceil(share - 1e-9)
    for s in sources:
        assert abs(taken[s] - target[s]) <= max(size[r["doc_id"]] for r in before if r["source"] == s)


def test_packing_holds_every_token(spark, stages):
    t = tokenizers.Tokenizer.from_file(default_tokenizer())
    want = Counter()
    for r in stages["mixing"][1]:
        want[r["doc_id"]] += len(t.encode(r["text"], add_special_tokens=False).ids) + 1
    got = Counter()
    for r in stages["packing"][1]:
        got[r["doc_id"]] += r["length"]
    assert got == want
    again = pipeline.run(spark, FOLDER).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert Counter(dict(map(tuple, again))) == want


text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))


def made(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "x") for i, t in rows], f"{D}, label string").repartition(3)


def test_rows_without_an_own_id(spark):
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (None, None), (None, None), (7, text(2)), (7, text(3)), (3, text(3)), (9, text(0))]
    docs = made(spark, rows)
    got = [(r["doc_id"], r["text"]) for r in pipeline.ngram_join(spark, docs, FOLDER).collect()]
    assert sorted(got, key=repr) == sorted([(None, text(1)), (None, None), (None, None), (7, text(2)), (3, text(3)), (9, text(0))], key=repr)

    rows = [(7, text(0) + "\n" + text(1)), (7, text(2) + "\n" + text(3)), (8, text(4) + "\n" + text(1)), (None, text(5) + "\n" + text(4)), (None, text(5))]
    got = [(r["doc_id"], r["text"]) for r in pipeline.line_dedup(spark, made(spark, rows), FOLDER).collect()]
    assert sorted((i, t) for i, t in got if i) == sorted([(7, rows[0][1]), (7, rows[1][1]), (8, text(4))])
    assert [t for i, t in got if i is None] == [text(5)]


def test_odd_rows_and_columns_pass_every_stage(spark, tmp_path):
    prose = spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(text) > 400 and doc_id < 40").select("doc_id", "text", "lang", "source").collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in prose]
    rows += [(None, prose[0]["text"], None, None), (3, prose[1]["text"], "en", None), (3, prose[1]["text"], "en", None), (None, None, None, None), (None, "", None, "a"), (5, " \n ", "xx", None)]
    rows += [(900, (prose[2]["text"] + "\n") * 300, prose[2]["lang"], "a"), (None, "x" * 200_000, "en", "b")]
    clash = ["_row", "_file", "_at", "doc", "copy", "_gone", "_order", "language", "copies", "key"]
    docs = spark.createDataFrame([(*r, None, *"abcdefghij") for r in rows], f"{D}, " + ", ".join(f"{c} string" for c in clash))
    docs.repartition(4).write.parquet(str(tmp_path / "d"))
    for source in (spark.read.parquet(str(tmp_path / "d")), docs.repartition(3)):
        d = source
        for name, stage in pipeline.STAGES:
            before, d = d, stash(stage(spark, d, FOLDER), name)
            if name != "packing":
                assert d.schema.names == docs.schema.names and d.select(*clash).distinct().count() == 1, name
                assert d.count() > 0 and (name == "mixing" or d.count() <= before.count())
            else:
                assert d.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
        assert d.count() > 0


def test_empty_table(spark):
    d = spark.createDataFrame([], D)
    for name, stage in pipeline.STAGES:
        assert stage(spark, d, FOLDER).count() == 0, name
