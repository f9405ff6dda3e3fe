"""Media columns, spelling variants and the source audit against brute force."""

import collections
import hashlib
import io
import re
import struct
import wave
import zlib

import numpy as np
import pytest

from tidemark.llm import divergence, media, oracles, spelling

D = "doc_id long, text string, lang string, source string, media binary, n long"
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def prose():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdé"), rng.integers(3, 8))) for _ in range(60)]
    return lambda n: " ".join(rng.choice(words, n))


def frame(spark, rows):
    return spark.createDataFrame([(*r, b"x", 7) for r in rows], D).repartition(3)


# op11


def brute_codes(x):
    """Peaks and pairs of one sound, frame by frame."""
    n = 1 + max(0, -(-(len(x) - 256) // 128))
    x = np.concatenate([x, np.zeros((n - 1) * 128 + 256 - len(x))])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(256), np.arange(129)) / 256)
    level = np.rint(1000 * np.log10(np.abs((x[np.arange(256) + 128 * np.arange(n)[:, None]] * window) @ turn) ** 2 + 1)).astype(int)
    found = []
    for t in range(n):
        for a, b in zip(media.BANDS, media.BANDS[1:], strict=False):
            top = level[t, a:b].max()
            before = [level[s, a:b].max() for s in range(max(0, t - 3), t)]
            after = [level[s, a:b].max() for s in range(t + 1, min(n, t + 4))]
            if top > 0 and all(top > v for v in before) and all(top >= v for v in after):
                found.append((t, a + int(level[t, a:b].argmax())))
    return n, len(found), sorted(t << 22 | f << 14 | g << 6 | s - t for i, (t, f) in enumerate(found) for s, g in found[i + 1 : i + 6] if s - t <= 63)


def test_media_round_trip_and_fingerprints(spark, prose, tmp_path):
    texts = [None, "", "a", "é" * 32, "x" * 64, "x" * 65, "ab" * 300, prose(800), prose(40), "same", "same", "\0\n" * 50, prose(90_000)]
    ids = [None if i == 3 else 5 if i in (9, 10) else 100 + i for i in range(len(texts))]
    d = frame(spark, [(i, t, None, None) for i, t in zip(ids, texts, strict=True)])
    media.write_media(d, str(tmp_path / "m"))
    got = media.fingerprints(media.read_media(spark, str(tmp_path / "m"))).collect()
    assert len(got) == len(texts)
    want = collections.Counter()
    for i, t in zip(ids, texts, strict=True):
        b = (t or "").encode()
        p = b + b"\0" * (-len(b) % 64 if b else 64)
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, 8000, len(p), "NONE", "NONE"))
            w.writeframes(p)
        m = out.getvalue()
        assert m[-len(p) :] == p
        codes = brute_codes(np.frombuffer(p, np.uint8).astype(float) - 128) if len(p) < 100_000 else None
        want[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), repr(codes)] += 1
    have = collections.Counter()
    for r in got:
        codes = (r["frames"], r["peaks"], list(r["codes"])) if r["payload_bytes"] < 100_000 else None
        assert r["codes"] == sorted(r["codes"]) and r["error"] is None and r["rate"] == 8000
        have[r["id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"], repr(codes)] += 1
    assert have == want
    assert media.fingerprints(media.media_column(d.limit(0))).count() == 0


def test_blocks_of_frames_change_nothing(monkeypatch):
    x = np.random.default_rng(1).integers(-128, 128, 40_000)
    whole = media.peaks(x)
    monkeypatch.setattr(media, "BLOCK", 7)
    for a, b in zip(whole, media.peaks(x), strict=True):
        assert np.array_equal(a, b)


def test_sounds_of_other_formats(spark):
    x = (8000 * np.sin(2 * np.pi * 1000 * np.arange(4000) / 8000)).astype(int)

    def wav(width, channels):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((channels, width, 8000, 0, "NONE", "NONE"))
            w.writeframes(b"".join(struct.pack("<i", int(v) << 8 * (width - 2))[:width] * channels for v in x))
        return out.getvalue()

    rows = [(1, 0, wav(2, 1)), (2, 0, wav(2, 2)), (3, 0, wav(3, 1)), (4, 0, None), (5, 0, b"no sound"), (6, 0, b"")]
    got = {r["id"]: r for r in media.fingerprints(spark.createDataFrame(rows, media.MEDIA)).collect()}
    for i in (1, 2, 3):  # a tone of 1000 Hz is in bin 32, the last of its band
        bins = {c >> 14 & 255 for c in got[i]["codes"]} | {c >> 6 & 255 for c in got[i]["codes"]}
        assert 32 in bins and got[i]["frames"] == 31
    assert got[1]["channels"] == 1 and got[2]["channels"] == 2 and got[3]["sample_bytes"] == 3
    assert got[4]["error"] is None and got[4]["frames"] is None
    assert got[5]["error"] and got[6]["error"] and got[5]["media_bytes"] == 8 and got[6]["codes"] is None


def test_op11_of_given_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    by_text = collections.defaultdict(set)
    for r in media.op11(spark, FOLDER).collect():
        b = (texts.pop(r["doc_id"]) or "").encode()
        p = media.padded(b)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(b), len(p), hashlib.sha256(p).hexdigest())
        by_text[b].add(tuple(r)[1:])
    assert not texts and all(len(x) == 1 for x in by_text.values())
    assert len({next(iter(x))[-1] for x in by_text.values()}) > 0.95 * len(by_text)  # but for some near copies, others sound different


# op12


def brute_words(rows):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, all_ in near.items():
        best = min(all_, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.fixture(scope="module")
def spelled():
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcdefé"), rng.integers(6, 11))) for _ in range(40)] + ["aaaaaaa", "aaaaaa", "abababab", "ÀÉÎõüÿ", "÷×÷×÷×"]
    out = []
    for w in base:
        out += [w] * int(rng.integers(5, 900))
        for _ in range(4):
            i = int(rng.integers(0, len(w)))
            v = [w[:i] + w[i + 1 :], w[:i] + "zZ"[i % 2] + w[i + 1 :], w[:i] + w[i] + w[i:], w + "g"][int(rng.integers(0, 4))]
            out += [v] * int(rng.integers(1, 60))
    rng.shuffle(out)
    texts = [" ".join(x) if k % 2 else "-1\n".join(x) for k, x in enumerate(np.array_split(out, 30))]
    return [*enumerate(texts), (3, texts[3]), (None, texts[4]), (77, None), (78, ""), (80, "lonelyone " * 6), (79, "日本語 1234 " + "x" * 5000)]


def test_words_and_variants(spark, spelled):
    n = brute_words(spelled)
    d = frame(spark, [(i, t, None, None) for i, t in spelled])
    vocab = spelling.vocabulary(spelling.runs(d))
    assert {r["word"]: r["n"] for r in vocab.collect()} == n
    got = spelling.variants(vocab).collect()
    want = brute_variants(n)
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert any(r["form"] and r["root"] != r["form"] for r in got) and any(r["n_near"] == 0 for r in got)


def test_roots_of_long_paths_and_ties(spark):
    n = {"a" * k: 5**k for k in range(6, 18)} | {"bbbbbb": 1, "bbbbbc": 5, "bbbbba": 5, "cccccc": 2, "ccccccc": 9}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert set(map(tuple, got)) == brute_variants(n)
    by = {r["word"]: r for r in got}
    assert by["a" * 6]["root"] == "a" * 17 and by["bbbbbb"]["form"] == "bbbbba" and by["cccccc"]["form"] is None
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_neighbourhood_is_distinct_and_whole(spark):
    v = spark.createDataFrame([("aab", 1), ("b", 1), ("\U0001f600a", 1)], "word string, n long")
    letters = spelling.alphabet(v).first()["letters"]
    assert letters == ["a", "b", "\U0001f600"]
    for w in ("aab", "b", "\U0001f600a", "aaaa"):
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for c in letters for k in (0, 1) for i in range(len(w) + 1 - k)}
        got = list(spelling.neighbourhood(w, letters, 0, 99))
        assert len(set(got)) == len(got) and set(got) == edits - {w}
        assert got == [x for i in range(len(w) + 1) for x in spelling.neighbourhood(w, letters, i, i + 1)]


@pytest.mark.parametrize("shortest", [1, 2, 3, 4, 5, 6, 7])
def test_near_words_of_any_length(spark, shortest):
    rng = np.random.default_rng(shortest)
    words = sorted({"".join(rng.choice(list("ab\U0001f600" if shortest < 5 else "ab"), rng.integers(shortest, shortest + 3))) for _ in range(250)})
    n = {w: int(rng.integers(1, 20)) for w in words}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    want = {(w, len(x), best := min(x, key=lambda v: (-n[v], v)), n[best]) for w, x in near.items() if x}
    d = spark.createDataFrame([*n.items(), ("", 99)], "word string, n long")
    got = spelling.near_words(d, size=7 if shortest % 2 else 20_000).collect()  # several parts for a place
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_op12_is_its_sql(spark, oracle):
    want = oracle(oracles.SPELLING, FOLDER).astype(object)
    rows = lambda d: sorted(d.where(d.notna(), None).values.tolist(), key=repr)
    got = spelling.op12(spark, FOLDER)
    assert sorted(map(list, got.select(*want.columns).collect()), key=repr) == rows(want)
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert {r["word"]: r["n"] for r in got.collect()} == brute_words(documents)


# op13


def brute_audit(rows, min_docs, top=50):
    docs, lang_n, own, groups = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang].add(source)
        docs.update((lang, t) for t in set(terms))
        for t in terms:
            lang_n[lang, t] += 1
            own[lang, source, t] += 1
    out = set()
    for lang, sources in groups.items():
        kept = [t for (x, t), k in docs.items() if x == lang and k >= min_docs]
        p = lambda n, total: 1 + 10**9 * (n + 5) // (total + 5 * len(kept))
        shares = {s: {t: p(own[lang, s, t], sum(own[lang, s, u] for u in kept)) for t in kept} for s in sources}
        q = {t: p(lang_n[lang, t], sum(lang_n[lang, u] for u in kept)) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o.encode(), o) for o in sources - {s}]
            terms = [(q[t] - shares[s][t], t.encode(), t) for t in kept if own[lang, s, t] and shares[s][t] > q[t]]
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(terms)[:top], 1)}
    return out


@pytest.fixture(scope="module")
def mixed(prose):
    rng = np.random.default_rng(8)
    rows = [(["en", "de", None, "x"][i % 4], f"s{int(rng.integers(0, 9))}" if i % 7 else None, prose(int(rng.integers(0, 60)))) for i in range(160)]
    rows += [("en", "empty", ""), ("en", "null", None), ("en", "only", "zzz " * 9), ("solo", "s1", "word " * 40), ("solo", "s2", None), ("alone", "s1", "a"), ("en", "ß\U0001f600", "\U0001f600 ÀB\0c"), rows[0], rows[0]]
    rows.append(("de", "s1", prose(20_000) + " Zürich" * 3))
    return rows


@pytest.mark.parametrize(("min_docs", "block", "chunk", "span"), [(3, 128, 512, 512), (2, 2, 4, 3), (3, 3, 7, 1), (10_000, 2, 4, 3)])
def test_audit(spark, mixed, min_docs, block, chunk, span):
    d = frame(spark, [(1, t, lang, s) for lang, s, t in mixed])
    got = divergence.audit(d, min_docs=min_docs, top=4, block=block, chunk=chunk, span=span).collect()
    want = brute_audit(mixed, min_docs, top=4)
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_shares_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(int(n), int(n + extra), int(v)) for n, extra, v in zip(rng.integers(0, 10**14, 300), rng.integers(0, 10**15, 300), rng.integers(1, 10**9, 300), strict=True)] + [(7, 7, 1), (0, 0, 1)]
    got = spark.createDataFrame(rows, "n long, total long, v long").select("*", divergence.share("n", "total", "v").alias("p")).collect()
    for r in got:
        want = 1 + 10**9 * (r["n"] + 5) // (r["total"] + 5 * r["v"])
        assert r["p"] == want == int(divergence._shares(np.array([r["n"]]), np.array([r["total"]]), r["v"], 5)[0])


def test_empty_table(spark):
    assert divergence.audit(frame(spark, [(1, "a", "b", "c")]).limit(0)).count() == 0


def test_op13_is_its_sql(spark, oracle):
    want = oracle(oracles.DIVERGENCE, FOLDER)
    got = divergence.op13(spark, FOLDER)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.values.tolist()))
    documents = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("lang", "source", "text").collect()]
    assert set(map(tuple, got.collect())) == brute_audit(documents, 30)
