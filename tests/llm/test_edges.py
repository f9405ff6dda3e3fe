"""Sharding against a loop, and odd rows of sharding, mixing, packing and language ID."""

import collections
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, packing, sharding

D = "doc_id long, text string, lang string, source string, size long, shard int, key string, n long"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows, long texts, and columns named like internal ones."""
    texts = [None, "", "a b c", "a b c", "word " * 60_000, "é\0\t\n" * 5000, "copy of this"]
    rows = [(None if i % 3 == 0 else i // 2, texts[i % len(texts)], "en", [None, "", "s", "t"][i % 4], -5, 99, "k", 0) for i in range(42)]
    rows += [rows[4]] * 3 + [(None, None, None, None, None, None, None, None)] * 2
    return spark.createDataFrame(rows, D).repartition(3)


def loop(links, shards, quota, rounds, at, place):
    """Propagation of (a, b, turn, weight): label by label. ``at``: first shards; ``place``:
    the order in which a shard looks at proposals."""
    turn, weight = collections.Counter(), collections.Counter()
    for a, b, t, w in links:
        turn[b], weight[b] = max(turn[b], t), max(weight[b], w)
        turn[a], weight[a] = max(turn[a], 0), max(weight[a], 1)
    at = {u: at[u] for u in weight}
    for r in range(rounds):
        now = r % 2
        seen = collections.defaultdict(collections.Counter)
        for a, b, _, w in links:
            seen[b][at[a]] += w
            seen[a][at[b]] += 1
        moves = collections.defaultdict(list)
        for u in at:
            best = min(seen[u], key=lambda s: (-seen[u][s], s))
            if turn[u] == now and best != at[u]:
                moves[best].append(u)
        of = lambda u: weight[u] if now == 0 else 1
        full = collections.Counter()
        for u, s in at.items():
            full[s] += of(u)
        for s, asked in moves.items():
            total = 0
            for u in sorted(asked, key=place.__getitem__):
                total += of(u)
                if total <= max(0, quota - full[s]):
                    at[u] = s
    return at


def test_propagation_equals_a_loop(spark):
    groups = [0] * 40 + [1] * 9 + [2] * 7 + [3] * 2 + [None] * 5 + [4]
    nodes = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "uid long, group long")
    n = spark.conf.get("spark.sql.shuffle.partitions")
    h = nodes.select("uid", F.pmod(F.xxhash64(F.lit(sharding.SEED), "uid"), F.lit(4)), F.pmod(F.xxhash64("uid"), F.lit(int(n) * 4))).collect()
    first, place = {r[0]: r[1] for r in h}, {r[0]: (r[2], r[0]) for r in h}
    for chunk, quota in ((4, 16), (3, 12), (50, 64)):
        links = sharding.equal_text_links(nodes, chunk)
        pairs = [tuple(r) for r in links.select("a", "b", "turn", "weight").collect()]
        sizes = collections.Counter(g for g in groups if g is not None)
        assert len(pairs) == sum(k - 1 for k in sizes.values() if k > 1)  # a tree for each group
        assert all(groups[a] == groups[b] for a, b, *_ in pairs)
        cut = [sum(first[a] != first[b] for a, b, *_ in pairs)]
        for rounds in (1, 2, 6):
            got = {r["uid"]: r["shard"] for r in sharding.propagate(nodes.select("uid"), links, 4, quota, rounds).collect()}
            assert got == loop(pairs, 4, quota, rounds, first, place)
            cut.append(sum(got[a] != got[b] for a, b, *_ in pairs))
        assert cut[-1] < 0.7 * cut[0] if quota * 4 > len(groups) + 3 else cut[-1] <= cut[0]  # shards without room take nothing


def test_shards_of_odd_rows(odd):
    got = sharding.shard_rows(odd)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = got.collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in odd.collect()]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_mix_of_odd_rows(odd):
    d = odd.select(F.col("doc_id").alias("key"), "source", mixing.word_count(F.col("text")).alias("size"), "shard", F.col("n").alias("target"), F.col("n").alias("copies"))
    got = mixing.mix(d)
    assert got.columns == ["key", "source", "size", "source_size", "target", "copies"]
    rows = got.collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r["key"], r["source"], r["size"]) for r in rows), key=key) == sorted(map(tuple, d.select("key", "source", "size").collect()), key=key)
    assert all(0 <= r["copies"] <= 3 for r in rows)
    again = mixing.mix(d.repartition(5)).collect()
    assert collections.Counter(tuple(r) for r in again) == collections.Counter(tuple(r) for r in rows)


def test_packs_of_odd_rows(odd):
    path = packing.default_tokenizer()
    encode = packing.Encoder(path)
    got = packing.pack(odd, path).collect()
    pieces = collections.Counter()
    for r in got:
        pieces[r["doc_id"]] += r["length"]
        assert r["start"] + r["length"] <= r["doc_tokens"] and r["length"] > 0
    want = collections.Counter()
    for r in odd.collect():
        want[r["doc_id"]] += len(encode(r["text"])) + 1
    assert pieces == want
    placed = collections.defaultdict(list)
    for r in got:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in placed.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048


def test_languages_of_odd_rows(spark):
    words = {"en": "the quick brown fox jumps over a lazy dog and the cat", "de": "der schnelle braune fuchs springt ueber den faulen hund und"}
    train = spark.createDataFrame([(i, words[k] + f" {i}", k) for i in range(20) for k in words], "id long, text string, lang string")
    model = langid.train(spark, train)
    pages = [(None, "http://a.de/x", words["de"]), (None, "http://a.com/x", words["en"]), (7, None, words["en"]), (7, None, words["de"]), (7, None, words["de"]), (8, None, None), (9, "::", ""), (10, "", words["en"] * 20_000)]
    d = spark.createDataFrame([(*p, None) for p in pages], "id long, url string, text string, declared string")
    got = langid.identify(langid.features(d, model, True), model.languages).collect()
    assert len(got) == len(pages)
    of = collections.defaultdict(collections.Counter)
    for r in got:
        of[r["id"]][r["language"] if r["accepted"] else None] += 1
    assert of[None] == {"de": 1, "en": 1} and of[7] == {"en": 1, "de": 2} and of[8] == {None: 1} and of[9] == {None: 1} and of[10] == {"en": 1}
