"""The corpus operators against brute force, on small hostile tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from conftest import as_rows

from tidemark.llm import langid, lines, mixing, near_vectors, neighbours, ngram_join, packing, sharding, suffix_dedup, warc
from tidemark.llm.components import connected_components

D = "doc_id long, text string, lang string, source string, n_chars long, label string"
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words, n))
    passage, base = prose(60), prose(120)
    out = [None, "", " \n ", "one", "one two", "One TWO", "one two three four five", "x" * 700, "ab" * 300, base, base, base.upper()]
    for k in range(12):  # near copies
        w = base.split()
        for i in rng.integers(0, len(w), k // 4 + 1):
            w[i] = prose(1)
        out.append(" ".join(w))
    for k in range(12):  # a passage that many share
        out.append(prose(k * 9) + "\n" + passage + "\n" + prose(40))
    out += ["\n".join([prose(12)] * 3 + [prose(9)]), passage, prose(6000), "é" * 150 + " " + passage]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", None][i % 2], [None, "a", "b"][i % 3], None, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, D).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], D)


# op1


def removed(texts):
    data = [(t or "").encode() for t in texts]
    n = collections.Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    for b in data:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if n[b[i : i + 200]] > 1:
                cover[i] += 1
                cover[i + 200] -= 1
        yield np.cumsum(cover)[: len(b)] > 0


def test_suffix_dedup(docs, empty, texts):
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    for i, cut in enumerate(removed(texts)):
        b = (texts[i] or "").encode()
        kept = np.frombuffer(b, np.uint8)[~cut].tobytes()
        spans = int((np.diff(np.concatenate([[0], cut.astype(int)])) == 1).sum())
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) == (len(b), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest(), kept), i
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_of_short_texts_only(spark):
    few = [None, "", "a", "ab" * 40, "ab" * 40, "é", None, "x" * 150]
    d = spark.createDataFrame(list(enumerate(few)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(d).collect()}
    assert got == {i: (len(b), 0, b) for i, b in enumerate((t or "").encode() for t in few)}


def test_suffix_dedup_within_and_across_blocks(spark):
    rng = np.random.default_rng(8)
    text = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    p, q, r, s = (text(n) for n in (300, 250, 220, 700))
    few = [text(50) + p, p + text(90), text(30) + q + text(70) + q, r + text(40), text(99), text(80) + p + text(10), text(500), text(20) + r, s, text(60), s, s + text(5) + s]
    d = spark.createDataFrame(list(enumerate(few)), "doc_id long, text string").repartitionByRange(3, "doc_id")
    got = {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in suffix_dedup.remove_repeats(d).collect()}
    want = {i: (int(c.sum()), int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())) for i, c in enumerate(removed(few))}
    assert got == want and [want[i][0] for i in (0, 2, 3, 8, 11)] == [300, 500, 220, 700, 1400]


def test_suffix_dedup_of_odd_ids(spark):
    last, long = 2**63 - 1, "".join(map(str, range(300)))
    few = [(None, long), (last, long), (5, long[:400] + "x"), (5, "y" + long[:400]), (None, None), (5, "short"), (5, "short")]
    d = spark.createDataFrame([(i, t, "z") for i, t in few], "doc_id long, text string, kept string").repartition(3)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(d).collect()), key=repr)
    want = [(i, len(t or ""), int(c.sum()), int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())) for (i, t), c in zip(few, removed([t for _, t in few]), strict=True)]
    assert got == sorted(want, key=repr) and want[0][2] == len(long)


def test_loser_tree_and_front_coding():
    rng = np.random.default_rng(0)
    for k in (1, 2, 3, 7):
        runs = [sorted((bytes(rng.choice([97, 98], rng.integers(0, 9))), b"x", int(r), i, 0) for i in range(rng.integers(0, 30))) for r in range(k)]
        out = list(suffix_dedup.merge([suffix_dedup.front_decode(suffix_dedup.front_code(r)) for r in runs]))
        assert [s[0] for s, _ in out] == sorted(s[0] for r in runs for s in r)
        assert [c for _, c in out[1:]] == [suffix_dedup.shared(a[0][0], b[0][0]) for a, b in zip(out[:-1], out[1:], strict=True)]


def test_long_text_is_cut_with_overlap(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 1000)
    t = bytes(np.random.default_rng(2).integers(97, 101, 5000).astype(np.uint8))
    h, p, s1, s2 = suffix_dedup.text_anchors([t])[0]
    assert s1[0] == 0 and s2[-1] == len(t) - 200 and (s1[1:] == s2[:-1] + 1).all()
    assert ((p >= s2) & (p <= s1 + 152)).all()


# op2


def matching_lines(texts):
    found, before = set(), []
    for d, t in enumerate(texts):
        for i, line in enumerate((t or "").split("\n")):
            w = [x for x in re.split(r"[\x20\x09-\x0D]+", line.lower()) if x]
            s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
            if s:
                if any(100 * len(s & b) >= 75 * len(s | b) for b in before):
                    found.add((d, i))
                before.append(s)
    return found


def test_line_dedup(docs, empty, texts):
    want = matching_lines(texts)
    assert {tuple(r) for r in lines.line_matches(docs).collect()} == want and want
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    for d, t in enumerate(texts):
        kept = [x for i, x in enumerate((t or "").split("\n")) if (d, i) not in want]
        if t is None:
            assert got[d]["text"] is None
        elif kept:
            assert got[d]["text"] == "\n".join(kept) and got[d]["n_chars"] == len(got[d]["text"]) and got[d]["label"] == "x"
        else:
            assert d not in got
    assert lines.line_matches(empty).count() == 0


def test_short_lines_count_where_asked(spark, docs, texts):
    found, before = set(), []
    for d, t in enumerate(texts):
        for i, line in enumerate((t or "").split("\n")):
            if s := shingles(line):
                if any(100 * len(s & b) >= 75 * len(s | b) for b in before):
                    found.add((d, i))
                before.append(s)
    assert {tuple(r) for r in lines.line_matches(docs, short=True).collect()} == found > matching_lines(texts)
    few = [(0, "All rights reserved.\n\nb c"), (1, "all  RIGHTS reserved.\n\nc b\n \nb"), (2, "b c\nb c d")]
    few = spark.createDataFrame(few, "doc_id long, text string")
    assert {tuple(r) for r in lines.line_matches(few, short=True).collect()} == {(1, 0), (2, 0)}


# op3


def test_shards(spark, docs, empty, texts):
    many = docs.unionByName(spark.createDataFrame([(100 + i, "copy " * 9, None, None, None, "") for i in range(60)], D))
    got = sharding.shard_rows(many).toPandas()
    n = got.groupby("shard").slot.agg(["size", "min", "max", "nunique"])
    assert len(got) == len(texts) + 60 and n["size"].max() - n["size"].min() <= 1
    assert (n["min"] == 0).all() and (n["max"] == n["size"] - 1).all() and (n["nunique"] == n["size"]).all()
    by = got.set_index("doc_id")
    for i, t in enumerate(texts):
        b = (t or "").encode()
        assert by.loc[i, "size"] == len(b) + 1 and by.loc[i, "text_crc32"] == zlib.crc32(b)
    assert by.loc[100:, "shard"].value_counts().max() >= len(got) // 8 - 1  # the large group fills a shard
    assert sharding.shard_rows(empty).count() == 0 and sharding.shard_rows(docs.limit(3)).count() == 3


# op4


def test_mixing(spark, empty):
    rng = np.random.default_rng(3)
    data = [(int(i), ["a", "b", "c", "d", None][int(x)], int(s)) for i, (x, s) in enumerate(zip(rng.choice(5, 900, p=[0.5, 0.2, 0.2, 0.07, 0.03]), rng.integers(0, 300, 900), strict=True))]
    data.append((9000, "a", 20_000))
    d = spark.createDataFrame(data, "key long, source string, size long")
    got = mixing.mix(d).toPandas()
    size = pd.DataFrame(data, columns=["key", "source", "size"]).groupby("source", dropna=False)["size"].sum()
    order = sorted(size.index, key=lambda s: (s is None or s != s, str(s)))
    weight, target, left = {s: 1 + i % 3 for i, s in enumerate(order)}, {}, float(size.sum())
    rest = list(order)
    while rest:  # share by weight; what is over the cap is shared anew
        over = [s for s in rest if left * weight[s] / sum(weight[x] for x in rest) > 3 * size[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(target[s] for s in over)
        rest = [s for s in rest if s not in over]
    for s, g in got.groupby("source", dropna=False):
        assert g.target.iloc[0] == pytest.approx(target[s if s == s and s else order[-1]])
        assert abs((g.copies * g["size"]).sum() - g.target.iloc[0]) <= 300
    assert len(got) == len(data) and got.copies.between(0, 3).all()
    assert sorted(map(tuple, mixing.mix(d.repartition(7)).select("key", "copies").collect())) == sorted(map(tuple, got[["key", "copies"]].values))
    assert mixing.mix(spark.createDataFrame([], "key long, source string, size long")).count() == 0


# op5


def shingles(t):
    w = (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_ngram_join(docs, empty, texts):
    sets = [shingles(t) for t in texts]
    part = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    part[i] = part[j] = min(part[i], part[j])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs).collect()}
    assert got == {i: (len(s), part[i]) for i, s in enumerate(sets)}
    assert ngram_join.ngram_components(empty).count() == 0


def test_ngram_join_where_the_differences_are_frequent(spark):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words, n))
    passages = [prose(int(rng.integers(8, 14))) for _ in range(12)]
    texts = []
    for _ in range(60):  # three of a family end in passages of other families; rare hashes come first
        base, rare = prose(100), [prose(7), prose(7)]
        for k in range(3):
            texts.append("\n".join([rare[k % 2], base, *rng.choice(passages, 1, replace=False)]))
        texts += [r + "\n" + prose(60) for r in rare]
    sets = [shingles(t) for t in texts]
    part = list(range(len(sets)))
    for _ in range(5):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 100 * len(a & b) >= 75 * len(a | b):
                    part[i] = part[j] = min(part[i], part[j])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(rows).collect()}
    assert got == dict(enumerate(part))


def test_prefix_tree_walk():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, int(k)).astype(np.uint64)) for k in rng.integers(2, 40, 80)]
    sets += [sets[0], sets[1][:3], sets[1]]
    sizes, none = [len(s) for s in sets], [-1 - i for i in range(len(sets))]
    tree = ngram_join.Tree(sets, sizes, none)
    for at, x in enumerate(sets):
        got = {tree.order[i]: n for i, n in tree.walk(x, len(x), 0, at, lambda g: False) if tree.order[i] > at}
        need = lambda s, x=x: -(-75 * (len(x) + len(s)) // 175)
        assert got == {at + 1 + i: k for i, s in enumerate(sets[at + 1 :]) if (k := len(np.intersect1d(x, s))) >= need(s)}
    # of one component: nothing to find
    assert not list(ngram_join.Tree(sets, sizes, [7] * len(sets)).walk(sets[0], sizes[0], 0, -1, lambda g: g == 7))


def test_words_of_long_texts(monkeypatch):
    rng = np.random.default_rng(6)
    text = "".join(rng.choice(list("abcé \t\n\x0b\x0c\r"), 4000, p=[0.3, 0.3, 0.2, 0.05] + [0.025] * 6)).encode()
    text = b"\r" + text + b"x" * 700 + b"\x0c" + text + b"y" * 300
    whole = ngram_join._words(np.frombuffer(text, np.uint8))[0]
    monkeypatch.setattr(ngram_join, "_SEGMENT", 128)
    assert (ngram_join._long_words(text) == whole).all() and len(whole) == len(text.split())
    for c in " \t\n\x0b\x0c\r":
        words = [f"w{i}".encode() for i in range(500)]
        sets = ngram_join.shingle_sets([c.encode().join(words), b" ".join(words), b"z" * 1000])
        assert len(sets[0]) == 496 and (sets[0] == sets[1]).all() and len(sets[2]) == 1


def test_ngram_join_of_odd_ids(spark):
    last = 2**63 - 1
    rows = [(None, "a b c d e f"), (last, "a b c d e f"), (5, "q r s"), (5, "q r s"), (5, None), (None, "Q R S"), (None, ""), (7, "z " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, ngram_join.ngram_components(df).collect()), key=repr)
    assert got == sorted([(None, 2, last), (last, 2, last), (5, 1, 5), (5, 1, 5), (5, 0, 5), (None, 1, 5), (None, 0, None), (7, 1, 7)], key=repr)
    one = spark.createDataFrame(rows[:1], "doc_id long, text string")
    assert list(map(tuple, ngram_join.ngram_components(one).collect())) == [(None, 2, None)]


# op6, op7


def vectors(n=600, d=16):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[100:140] = x[0] + 0.02 * rng.standard_normal((40, d))
    x[200:230] = x[1]
    x[300:320] = 3 * x[2]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    return x, rows + [(1000, None, 0), (1001, [0.0] * d, 0), (1002, [None] + [1.0] * (d - 1), 0), (1003, [float("nan")] * d, 0), (1004, [float("inf")] * d, 0)]


V = "vec_id long, embedding array<float>, label int"


def test_neighbours(spark):
    x, rows = vectors()
    df = spark.createDataFrame(rows, V)
    got = neighbours.search(df, df.where("vec_id % 20 = 0")).toPandas()
    x = x.astype(float)
    hits = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and q not in set(g.vec_id) and g.vec_id.is_unique
        assert np.allclose(g.score, s[g.vec_id])
        assert list(g.vec_id) == list(g.iloc[np.lexsort([g.vec_id, -g.score])].vec_id)
        s[q] = -np.inf
        hits += len(set(g.vec_id) & set(np.lexsort([np.arange(len(s)), -s])[:20]))
    assert got.query_id.nunique() == 30 and hits / (30 * 20) >= 0.9
    few = df.where("vec_id < 5")
    assert neighbours.search(few, few.where("vec_id = 0")).count() == 4
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


def test_codes_decide_what_is_scored(spark, monkeypatch):
    _, rows = vectors(900)
    df = spark.createDataFrame(rows, V)
    before = [tuple(r)[:3] for r in neighbours.search(df, df.where("vec_id % 20 = 0")).collect()]

    def blank(self, *args):
        made(self, *args)
        self.books = [0 * b for b in self.books]

    made = neighbours.Index.__init__
    monkeypatch.setattr(neighbours.Index, "__init__", blank)
    after = [tuple(r)[:3] for r in neighbours.search(df, df.where("vec_id % 20 = 0")).collect()]
    assert len(after) == len(before) and len(set(after) & set(before)) < 0.95 * len(before)


def test_neighbours_of_repeated_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 64)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    x[40:200] = x[40]  # a hot vector, in a cell of several parts
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[0]] * 3 + [rows[7]] * 2 + [(None, x[0].tolist()), (20, [1.0]), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = neighbours.search(df, df.where("vec_id % 20 = 0")).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and q not in set(g.vec_id)
        every = [(-(x[q] * v).sum(), i) for i, v in [*enumerate(x), *[(0, x[0])] * 3, *[(7, x[7])] * 2] if i != q]
        want = sorted(every)[:20]
        hits += len(collections.Counter(zip(-g.score, g.vec_id, strict=True)) & collections.Counter(want))
    assert got.query_id.nunique() == 15 and hits >= 0.9 * 300, hits
    ties = [i for i in got[got.query_id == 60].sort_values("rank").vec_id if 40 <= i < 200]
    assert len(ties) > 10 and ties == list(range(40, 40 + len(ties)))  # equal products: the smaller ids


def test_neighbours_of_uneven_lengths(spark):
    """Few long vectors are near to all; most of their true neighbours were missed."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((12000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[rng.permutation(12000)[:40]] *= 30
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}))
    got = neighbours.search(df, df.where("vec_id % 400 = 0")).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        hits += len(set(g.vec_id) & set(np.argsort(-s)[:20]))
    assert got.query_id.nunique() == 30 and hits >= 0.9 * 600, hits


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    x, rows = vectors()
    got = near_vectors.near_vectors(spark.createDataFrame(rows, V)).toPandas().set_index("vec_id").sort_index()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    part = np.arange(len(x))
    for _ in range(5):
        part = np.array([min(part[i], part[near[i]].min(initial=10**9)) for i in range(len(x))])
    assert (got.n_links.loc[: len(x) - 1] <= near.sum(1)).all() and got.n_links.sum() >= 0.95 * near.sum()
    assert (got.component_id.loc[: len(x) - 1] == part).mean() > 0.99
    bad = got.loc[1000:]
    assert (bad.n_links == 0).all() and (bad.component_id == bad.index).all() and bad.kept.all()
    assert near_vectors.near_vectors(spark.createDataFrame([], V)).count() == 0


def test_near_vectors_of_doubles_lengths_and_ids(spark):
    rows = [(1, [1e39, 0.0]), (2, [1e39, 0.0]), (3, [1e200, 1e198]), (4, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [1e-300, 0.0]), (None, [1e39, 0.0]), (None, None), (6, [0.0, 1.0]), (7, [])]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (5, 3, 1, False), (4, 1, 4, True), (4, 1, 4, True), (None, 0, None, True), (None, 0, None, True), (6, 0, 6, True), (7, 0, 7, True)], key=repr
    )


def test_near_vectors_in_large_groups(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((900, 24))
    x[:300] = x[0] + 0.01 * rng.standard_normal((300, 24))  # all linked with each other
    got = near_vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas().set_index("vec_id").sort_index()
    assert (got.n_links.loc[:299] == 299).mean() > 0.99 and (got.component_id.loc[:299] == 0).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, j) for j in range(101, 160)] + [(7, 7), (500, 500)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)} | {500: 500}


# op8


def test_packing(docs, empty, texts):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(docs, packing.default_tokenizer()).toPandas()
    for i, text in enumerate(texts):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in got[got.doc_id == i].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        n = int(s.length.sum())
        assert n <= 2048 and n & (n - 1) == 0 and list(s.offset) == list(s.length.cumsum() - s.length)
    assert packing.pack(empty, packing.default_tokenizer()).count() == 0


def test_special_tokens_and_odd_white_space():
    e = packing.Encoder(packing.default_tokenizer())
    assert e.fast is not None
    for text in ["a<|endoftext|>b", "a\x1c b", "  x \n\n y\t", "'s it's", "中文 12a", "\x85"]:
        assert e(text).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


# op9


def test_language_id(spark, empty):
    docs = spark.read.parquet(f"{FOLDER}/../sf0.01/documents.parquet")
    held = docs.where("doc_id % 3 = 0")
    model = langid.train(spark, docs.where("doc_id % 3 <> 0").withColumnRenamed("doc_id", "id"))
    got = langid.identify_documents(held.withColumn("lang", docs.lang.substr(9, 2)), model).toPandas()  # nothing is declared
    truth = held.select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    assert (both.language == both.lang).mean() > 0.98 and both.accepted.mean() > 0.99
    odd = spark.createDataFrame([(1, None, None, None, None, ""), (2, "", "en", "a", None, ""), (3, "12 %%%", "xx", "a", None, "")], D)
    assert not langid.identify_documents(odd, model).toPandas().accepted.any()
    assert langid.identify_documents(empty, model).count() == 0
    none = langid.train(spark, empty.withColumnRenamed("doc_id", "id"))
    assert langid.identify_documents(odd, none).count() == 3


def test_pages_fuse_evidence(spark):
    model = langid.train(spark, spark.read.parquet(f"{FOLDER}/documents.parquet").withColumnRenamed("doc_id", "id"))
    assert langid.declared('<!DOCTYPE html><HTML class="a" lang="FR-ca">') == "fr" and langid.declared("<p lang=de>") is None
    assert langid.address("https://a.b.Example.org:8/x") == ("a.b.example.org", "example.org", "org") and langid.address(None) == (None, None, None)
    rows = [(i, "https://x.example.de/1", f"<html lang='{lang}'><script>the the</script><p>...</p>", None) for i, lang in enumerate(["de"] * 5 + [""])]
    pages = spark.createDataFrame(rows + [(9, None, None, None)], "id long, url string, text string, declared string")
    got = langid.identify(langid.features(pages, model, True), model.languages).toPandas()
    assert len(got) == 7 and not got.accepted.any()


def test_posterior_equals_brute_force(spark):
    """The fused evidence of some thousand pages, with rare values, nulls and a hot host."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumnRenamed("doc_id", "id")
    model = langid.train(spark, docs)
    some = [r["text"] for r in docs.orderBy("id").limit(40).collect()]
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        host = rng.choice(["a.one.de", "b.one.de", "two.fr", f"h{i}.x{i}"], p=[0.4, 0.1, 0.2, 0.3])
        said = rng.choice(["", " lang=de", ' lang="fr"', f" lang='q{chr(97 + i % 26)}{chr(97 + i // 26)}'"])
        rows.append((i, None if i % 50 == 0 else f"http://{host}/{i}", None if i % 70 == 0 else f"<html{said}><b>{some[i % 40][: 30 + i % 90] if i % 9 else '1 2'}", None))
    got = {r["id"]: r for r in langid.identify(langid.features(spark.createDataFrame(rows, "id long, url string, text string, declared string"), model, True), model.languages).collect()}
    n, f = len(model.languages), []
    for i, url, text, _ in rows:
        host, domain, suffix = langid.address(url)
        k, ll = model.score(langid.visible(text or ""))
        p = np.exp(ll - ll.max())
        f.append((i, host, domain, suffix, langid.declared(text or ""), k, ll, p / p.sum()))
    total = sum(x[7] for x in f)
    corpus = (total + 1) / (total.sum() + n)

    def given(at):
        w = collections.defaultdict(lambda: np.zeros(n))
        for x in f:
            w[x[at]] += x[7]
        return {v: np.log((x + 20 * x.sum() / total.sum() + 1e-3) / (total + 20 + 1e-3)) for v, x in w.items()}

    said, suffixes = given(4), given(3)
    for i, host, domain, suffix, lang, k, ll, p in f:
        of = lambda at, v, p=p: np.maximum(sum((x[7] for x in f if x[at] == v and x[1] is not None), np.zeros(n)) - p, 0) if v is not None else np.zeros(n)
        wd, w = of(2, domain), of(1, host)
        parent = (wd + 20 * corpus) / (wd.sum() + 20)
        prior = (w + 20 * parent) / (w.sum() + 20)
        s = ll + said[lang] + suffixes[suffix] + np.log(prior)
        s = np.exp(s - s.max())
        s /= s.sum()
        assert got[i]["probability"] == pytest.approx(s.max(), rel=1e-6) and got[i]["language"] == model.languages[int(s.argmax())], i
        assert got[i]["accepted"] == (k > 0 and s.max() >= 0.5) and got[i]["text_probability"] == pytest.approx(p.max())


def test_markup_in_one_pass():
    from time import perf_counter

    cases = {"a<!-- x --> b": "a  b", "<p>a<script>x<b></SCRIPT >b": " a b", "a <!-- b": "a <!-- b", "<!-- a>b": " b", "1 < 2": "1 < 2", "<style>a&amp;b": " a&b", "<p": "<p", "<template>a</templates></template\n>&lt;": " <"}
    for page, text in cases.items():
        assert langid.visible(page) == text, page
    began = perf_counter()
    for piece in ("<script>", "<!--", "<html ", "<style></style", "<"):
        langid.visible(piece * 100_000)
        langid.declared(piece * 100_000)
    assert perf_counter() - began < 10


def test_all_of_a_long_text_counts_and_the_mean_is_tempered():
    model = langid.TextModel({"a": np.bincount(langid.trigrams("aaa bbb"), minlength=langid.BUCKETS), "b": np.bincount(langid.trigrams("ccc ddd"), minlength=langid.BUCKETS)}, most=10)
    n, ll = model.score("aaa " * 50 + "ccc " * 5000)
    assert n > 10_000 and ll.argmax() == 1
    assert np.allclose(ll, 10 * model.logp[langid.trigrams("aaa " * 50 + "ccc " * 5000)].mean(0, dtype=float), rtol=1e-4)


# op10


P = "page_id long, url string, html string, extra int"


def test_warc_round_trip(spark, oracle, tmp_path):
    big = "".join(f"line {i}\r\n\r\n" for i in range(20_000))
    html = [None, "", "a", "a", "a\r\n", "\r\n", "\r", "\n", big, big, "x" * 65_535 + "\r\n" + "y", "x" * 65_536, "é" * 50_000]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y" if i % 2 else None, h, 1) for i, h in enumerate(html)], P)
    warc.write_archives(warc.mark_revisits(pages), str(tmp_path / "w"))
    chunks = warc.read_archives(spark, str(tmp_path / "w"))
    data = collections.defaultdict(dict)
    for r in chunks.collect():
        assert len(r["data"] or b"") <= warc.CHUNK
        data[r["page_id"]][r["chunk_no"]] = bytes(r["data"] or b"")
    got = {r["page_id"]: r for r in warc.records(chunks).collect()}
    first = {}
    for i, h in enumerate(html):
        b = (h or "").encode()
        first.setdefault(b, i)
        r = got[i]
        assert r["payload_bytes"] == len(b) and r["payload_digest"] == warc.base32_sha1(hashlib.sha1(b))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[b] == i else ("revisit", first[b]))
        if first[b] == i:
            assert b"".join(v for _, v in sorted(data[i].items())) == b
    assert as_rows(warc.op10(spark, FOLDER)) == as_rows(oracle(warc.ORACLE, FOLDER))


def test_warc_edges(spark, tmp_path):
    nothing = spark.createDataFrame([], P)
    warc.write_archives(warc.mark_revisits(nothing), str(tmp_path / "e"))
    assert warc.records(warc.read_archives(spark, str(tmp_path / "e"))).count() == 0
    p = warc.Parser()
    plain = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 9\r\n\r\nab\r\n\r\ncde\r\n\r\n"
    for line in plain.split(b"\r\n")[:-1]:
        p.feed(line)
    p.end()
    assert p.out[0][6] == b"ab\r\n\r\ncde" and p.out[0][7] == 9
    short = warc.mark_revisits(spark.createDataFrame([(1, None, "ab", 0), (2, None, "ab", 0), (2, None, "ab", 0), (None, None, "ab", 0)], P), min_bytes=3)
    assert short.where("refers_to is not null").count() == 0 and short.count() == 4


# SQL


@pytest.mark.parametrize("name", ["op2_line_dedup", "op5_ngram_jaccard_join", "op7_embedding_near_dedup"])
def test_same_rows_as_sql(spark, oracle, name):
    from tidemark.llm import queries

    assert as_rows(queries.QUERIES[name](spark, FOLDER)) == as_rows(oracle(queries.ORACLES[name], FOLDER))


def test_line_sets_are_written_once_in_48_bits(spark, monkeypatch):
    import random
    from pathlib import Path

    sizes, plain = {}, lines.stash

    def stash(df, name, **options):
        out = plain(df, name, **options)
        sizes.setdefault(name, []).append(sum(p.stat().st_size for p in Path(out._tidemark_path.removeprefix("file://")).glob("*.parquet")))
        return out

    monkeypatch.setattr(lines, "stash", stash)
    rng = random.Random(3)
    texts = ["\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(204)) for _ in range(20)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts)], "doc_id long, text string")
    assert lines.line_matches(docs).count() == 400  # the copies
    grams = 400 * 200
    assert sum(sizes["grams"]) < 7 * grams  # eight bytes each, before; copies have none
    assert sum(sum(v) for v in sizes.values()) < 8 * grams  # nor is another table of their size written


def test_lines_of_equal_sets_and_frequent_passages(spark):
    five = "one two three four five six seven eight"
    rows = [(3, five.upper()), (1, f"  {five}\nx"), (2, five.replace(" ", "\t")), (4, f"{five}\n{five}"), (5, "\n\n \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(2, 0), (3, 0), (4, 0), (4, 1)}
    assert {tuple(r) for r in lines.line_matches(docs).collect()} == want
    assert {tuple(r) for r in lines.line_matches(docs, short=True).collect()} == want


def test_shuffle_files_are_freed(spark, tmp_path):
    import time

    from tidemark.llm.common import free_shuffles, stash

    def files():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return sum(blocks.getAllFiles().apply(i).getName().endswith(".data") for i in range(blocks.getAllFiles().length()))

    def work():
        return stash(spark.range(100_000).repartition(4, "id"), "freed").count()

    free_shuffles(spark)
    free_shuffles(spark)
    time.sleep(1)
    before = files()
    work()
    free_shuffles(spark)
    time.sleep(1)
    assert files() <= before
