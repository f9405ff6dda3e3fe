"""Suffix-array dedup: removal of every byte that a repeated 200-byte string covers.

The suffix array is sparse. Of each 200-byte window the suffix at one place counts, the
first one with the least hash of its next 48 bytes; equal windows have it at the same
place, and neighbouring windows mostly share it, so a few in a hundred suffixes remain.
Those whose 48 bytes occur once in the corpus can't repeat and go (a hash exchange, to
which each block of some 16 MB of texts sends a hash once, however often it has it).

Distributed merge sort: each task sorts its suffixes, cuts the run by splitters drawn
from a sample of the corpus, front-codes the parts, and sends each to its range. There
a loser tree merges the runs: a player carries how many bytes it shares with the last
winner, so bytes known to be equal are never compared again, and the merged order
comes with the lengths of common prefixes.

Within a stretch of suffixes that share 48 bytes or more, sets are united from the
longest common prefix down. Each keeps the texts before its suffixes in order, so a
new member meets those it shares most with on that side as neighbours; where both
sides together reach 200 bytes, the common string is a repeat. Windows that might
repeat across a splitter are settled by a last exchange of their hashes.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, ship, stash, table, utf8
from .vectors import groups

LENGTH = 200
GRAM = 48
#: Most sampled suffixes from which splitters are drawn.
SAMPLE = 10_000
_SEGMENT = 1 << 20
_U = np.uint64
_NULL = (1 << 63) - 1
_REACH = LENGTH - GRAM  # a window's suffix starts at most so far behind the window


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xD6E8FEB86659FD93
    back = pow(base, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([[_U(1)], np.full(n, _U(b))]), dtype=np.uint64) for b in (base, back))


_POWER, _BACK = _tables(_SEGMENT + LENGTH + 1)
_BYTE = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


def _anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """The hashes of the suffixes of ``data``, and the suffix that each window selects.
    Windows across text ends are the caller's to drop."""
    n = len(data)
    if n < LENGTH:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.concatenate([[_U(0)], np.cumsum(_BYTE[data] * _POWER[:n], dtype=np.uint64)])
    h = _mixed((total[GRAM:] - total[:-GRAM]) * _BACK[: n - GRAM + 1])
    least = (h & ~_U((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)  # ties: the first
    width, done = _REACH + 1, 1
    while 2 * done <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
    at = (least & _U((1 << 24) - 1)).astype(np.int64)
    return h, at


def text_anchors(texts: list[bytes]) -> list[tuple[np.ndarray, ...]]:
    """Per text: (hash, suffix, first window, last window) of its suffixes that count."""
    out: list = [None] * len(texts)

    def solve(group: list[int]) -> None:
        starts = np.cumsum([0] + [len(texts[i]) for i in group])
        data = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
        h, at = _anchors(data)
        for i, a, b in zip(group, starts[:-1], starts[1:], strict=True):
            out[i] = _runs(h, at[a : b - LENGTH + 1], a) if b - a >= LENGTH else _runs(h, at[:0], a)

    group, held = [], 0
    for i, t in enumerate(texts):
        if len(t) > _SEGMENT:  # in pieces that overlap by a window
            parts = []
            for s in range(0, len(t) - LENGTH + 1, _SEGMENT):
                h, at = _anchors(np.frombuffer(t[s : s + _SEGMENT + LENGTH - 1], np.uint8))
                x = _runs(h, at, 0)
                parts.append((x[0], x[1] + s, x[2] + s, x[3] + s))
            out[i] = tuple(np.concatenate(c) for c in zip(*parts, strict=True))
            continue
        if held + len(t) > _SEGMENT and group:
            solve(group)
            group, held = [], 0
        group.append(i)
        held += len(t)
    if group:
        solve(group)
    return out


def _runs(h: np.ndarray, at: np.ndarray, start: int) -> tuple[np.ndarray, ...]:
    if not len(at):
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    return h[at[first]], at[first] - start, first, last


def _record(kind: str):
    names = [c.split()[0] for c in kind.split(", ")]
    types = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in kind.split(", ")]
    return lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


#: Marks a place whose 48 bytes its block has more than once.
_KNOWN = _U(1 << 63)
_SETTLED = -(1 << 29)


def _bucket(uid: np.ndarray, buckets: int) -> np.ndarray:
    return (uid >> 8) % buckets


_DEALT = "shard int, base long, counts binary, hashes binary, places binary, extra binary"
_dealt = _record(_DEALT)


def _deal(batches, shards: int):
    """Per shard, the suffixes' hashes and places, each hash once, its place with _KNOWN if
    it is here more often; from shard _SETTLED the places that this leaves out, by buckets
    of documents; in shard -1 - x documents, in shard -(1 << 30) samples of suffixes."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 40
    docs, digests, found, texts, held = [], [], [], [], 0

    def rows():
        sizes = np.array([len(f[0]) for f in found])
        h, p, s1, s2 = (np.concatenate(c) for c in zip(*found, strict=True))
        doc = np.repeat(np.arange(len(found)), sizes)
        place = p.astype(np.uint64) << _U(16) | (p - s1).astype(np.uint64) << _U(8) | (p - s2).astype(np.uint64)
        order = np.argsort(h, kind="stable")
        again = np.append(np.zeros(min(len(h), 1), bool), h[order][1:] == h[order][:-1])
        place[order[np.append(again[1:], np.zeros(min(len(h), 1), bool)) & ~again]] |= _KNOWN
        out, rest = [], order[again]
        uid = base + doc[rest]
        bucket = _bucket(uid, 4 * shards)
        by_doc = np.lexsort([uid, bucket])
        edge = np.flatnonzero(np.diff(bucket[by_doc], prepend=-1, append=-1)) if len(rest) else []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            own = by_doc[a:b]
            out.append((_SETTLED + (base + len(docs)) % shards, int(bucket[own[0]]), uid[own].tobytes(), None, place[rest[own]].tobytes(), None))
        shard = (h % _U(shards)).astype(np.int64)
        sent = np.sort(order[~again])
        order = sent[np.argsort(shard[sent], kind="stable")]
        cut = np.searchsorted(shard[order], np.arange(shards + 1))
        for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b > a:
                own = order[a:b]
                out.append((k, base, np.bincount(doc[own], minlength=len(found)).astype(np.uint32).tobytes(), h[own].tobytes(), place[own].tobytes(), None))
        out.append((-1 - (base + len(docs)) % shards, base, np.array(docs, np.int64).tobytes(), None, None, b"".join(digests)))
        for i in np.argsort(_mixed(h ^ (p.astype(np.uint64) * _U(0x9E3779B97F4A7C15))))[:64]:
            out.append((-(1 << 30), 0, None, None, None, texts[doc[i]][p[i] : p[i] + LENGTH]))
        return _dealt(out)

    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            new = part.column("text").to_pylist()
            docs += part.column("doc_id").to_pylist()
            digests += part.column("digest").to_pylist()
            found += text_anchors(new)
            texts += new
            held += sum(map(len, new))
            if held > 16 << 20:
                yield rows()
                base += len(docs)
                docs, digests, found, texts, held = [], [], [], [], 0
    if docs:
        yield rows()


_SHARED = "kind int, bucket int, uid binary, data binary, extra binary"
_shared_rows = _record(_SHARED)


def _shared(batches, buckets: int):
    """Places of suffixes whose hash is there twice or more (kind 0), by buckets of
    documents; settled places, documents (kind 1) and samples (kind 2) pass."""
    hashes, places, docs, own = [], [], [], None

    def flush():
        h, v, d = np.concatenate(hashes), np.concatenate(places), np.concatenate(docs)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        many = order[np.append(same, False) | np.append(False, same) | (v[order] >= _KNOWN)]
        d, v = d[many], v[many] & ~_KNOWN
        bucket = _bucket(d, buckets)
        order = np.lexsort([v, d, bucket])
        d, v = d[order], v[order]
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        return [(0, k, d[a:b].tobytes(), v[a:b].tobytes(), None) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]

    for b in batches:
        for shard, base, counts, h, v, extra in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if shard == -(1 << 30):
                yield _shared_rows([(2, 0, None, None, extra)])
                continue
            if shard < _SETTLED + (1 << 28):
                yield _shared_rows([(0, base, counts, v, None)])
                continue
            if shard < 0:
                ids = np.frombuffer(counts, np.int64)
                uid = base + np.arange(len(ids))
                block = uid >> 8
                cut = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(uid)]
                yield _shared_rows([(1, int(block[a]) % buckets, uid[a:e].tobytes(), ids[a:e].tobytes(), extra[16 * a : 16 * e]) for a, e in zip(cut[:-1], cut[1:], strict=True)])
                continue
            if own is not None and shard != own:
                if rows := flush():
                    yield _shared_rows(rows)
                hashes, places, docs = [], [], []
            own = shard
            hashes.append(np.frombuffer(h, np.uint64))
            places.append(np.frombuffer(v, np.uint64))
            docs.append(base + np.repeat(np.arange(len(counts) // 4), np.frombuffer(counts, np.uint32)))
    if own is not None and (rows := flush()):
        yield _shared_rows(rows)


def _listed(batches):
    for b in batches:
        for uid, ids, extra in zip(*(b.column(c).to_pylist() for c in ("uid", "data", "extra")), strict=True):
            digests = [extra[i : i + 16] for i in range(0, len(extra), 16)]
            yield pa.record_batch([pa.array(np.frombuffer(uid, np.int64)), pa.array(np.frombuffer(ids, np.int64)), pa.array(digests, pa.binary())], ["uid", "doc_id", "digest"])


def _by_document(batches):
    for b in groups(batches, 1):
        uid = np.concatenate([np.frombuffer(x, np.int64) for x in b.column("uid").to_pylist()])
        v = np.concatenate([np.frombuffer(x, np.uint64) for x in b.column("data").to_pylist()])
        order = np.lexsort([v, uid])
        uid, v = uid[order], v[order]
        cut = np.concatenate([[0], np.flatnonzero(uid[1:] != uid[:-1]) + 1, [len(uid)]])
        yield pa.record_batch(
            [pa.array(uid[cut[:-1]]), pa.array([v[a:e].tobytes() for a, e in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["uid", "places"]
        )


# A suffix: (right, left, uid, place, many). right: the bytes from it on that its windows
# cover; left: those before it; many: whether its task had it more than once.


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """How many leading bytes a and b share, if they share ``known``."""
    m = min(len(a), len(b))
    x = int.from_bytes(a[known:m]) ^ int.from_bytes(b[known:m])
    return m - (x.bit_length() + 7) // 8


def front_code(run: list[tuple]) -> bytes:
    """A sorted run as bytes: of each suffix only what it doesn't share with the last."""
    head = np.zeros((len(run), 4), np.uint8)
    refs = np.zeros((len(run), 2), np.int64)
    body, last = [], b""
    for i, (right, left, uid, place, many) in enumerate(run):
        k = shared(right, last)
        head[i] = k, len(right), len(left), many
        refs[i] = uid, place
        body += [right[k:], left]
        last = right
    return len(run).to_bytes(4, "little") + head.tobytes() + refs.tobytes() + b"".join(body)


def front_decode(data: bytes):
    """Yields (suffix, bytes shared with the one before)."""
    n = int.from_bytes(data[:4], "little")
    head = np.frombuffer(data, np.uint8, 4 * n, 4).reshape(n, 4).tolist()
    refs = np.frombuffer(data, np.int64, 2 * n, 4 + 4 * n).reshape(n, 2).tolist()
    at, last = 4 + 20 * n, b""
    for (k, r, lft, many), (uid, place) in zip(head, refs, strict=True):
        last = last[:k] + data[at : at + r - k]
        at += r - k
        yield (last, data[at : at + lft], uid, place, many), k
        at += lft


def merge(runs: list):
    """Loser tree over runs of (suffix, bytes shared with the one before): yields
    (suffix, bytes shared with the last one yielded) in order of their right sides.

    Each waiting player knows how many bytes it shares with the last winner. Of two
    players the one that shares more is smaller; only on a tie are bytes compared, from
    there on."""
    k = 1
    while k < len(runs):
        k *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    runs = [*runs, *[iter(())] * (k - len(runs))]
    common = [0] * k  # bytes shared with the last winner
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser then shares common[loser] bytes with the winner."""
        if heads[a] is None:
            return b, a
        if heads[b] is None or common[a] > common[b]:
            return a, b
        if common[a] < common[b]:
            return b, a
        x, y = heads[a][0][0], heads[b][0][0]
        m = shared(x, y, common[a])
        if x[m : m + 1] <= y[m : m + 1]:
            common[b] = m
            return a, b
        common[a] = m
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while heads[winner] is not None:
        yield heads[winner][0], common[winner]
        heads[winner] = next(runs[winner], None)
        common[winner] = heads[winner][1] if heads[winner] else 0
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def repeats(group: list[tuple], common: list[int]):
    """Yields (suffix, start, end): strings of LENGTH bytes or more, around suffixes of
    the group, that occur around another one as well. ``common``: bytes that each
    shares with the one before."""
    # equal on both sides: all their windows repeat
    classes: list[tuple] = []
    of: list[list[tuple]] = []
    lcp: list[int] = []
    seen: dict = {}
    low = LENGTH
    for s, c in zip(group, common, strict=True):
        low = min(low, c)
        if not classes or low < len(s[0]):  # another right side than the last
            seen = {}
        if s[1] in seen:
            of[seen[s[1]]].append(s)
            continue
        seen[s[1]] = len(classes)
        classes.append(s)
        of.append([s])
        lcp.append(low)
        low = LENGTH
    for members in of:
        if len(members) > 1:
            for m in members:
                yield m, m[3] - len(m[1]), m[3] + len(m[0])
    if len(classes) < 2:
        return
    back = [s[1][::-1] for s in classes]
    sets: dict[int, list] = {i: [(back[i], i)] for i in range(len(classes))}
    parent = list(range(len(classes)))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i in sorted(range(1, len(classes)), key=lcp.__getitem__, reverse=True):
        r = lcp[i]
        a, b = find(i - 1), find(i)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        into = sets[a]
        for x in sets.pop(b):
            at = bisect.bisect_left(into, x)
            for y in into[max(0, at - 1) : at + 1]:
                m = shared(x[0], y[0])
                if m + r >= LENGTH:
                    for z in (x[1], y[1]):
                        for s in of[z]:
                            yield s, s[3] - m, s[3] + r
            into.insert(at, x)
        parent[b] = a


def _united(spans: np.ndarray) -> np.ndarray:
    """Overlapping spans (uid, start, end) of a text as one."""
    spans = spans[np.lexsort([spans[:, 1], spans[:, 0]])]
    new = np.append(True, spans[1:, 0] != spans[:-1, 0])
    high = np.cumsum(new) * (int(spans[:, 2].max()) + 1)  # ends of each text above those of the text before
    end = np.maximum.accumulate(spans[:, 2] + high)
    new[1:] |= spans[1:, 1] + high[1:] > end[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(spans)) - 1
    return np.column_stack([spans[first, :2], end[last] - high[last]])


_SORTED = "shard int, data binary"
_sorted = _record(_SORTED)


def _sort_runs(batches, splitters: list[bytes]):
    """Each task's suffixes as sorted, front-coded parts by range; what repeats within
    the task is reported at once (shards below 0) and sent once."""
    from pyspark import TaskContext

    run, size, spread = [], 0, TaskContext.get().partitionId()

    def flush():
        run.sort()
        kept, spans = [], []
        a = 0
        for b in range(1, len(run) + 1):
            if b == len(run) or run[b][:2] != run[a][:2]:
                right, left, uid, place, _ = run[a]
                if b - a > 1:
                    spans += [(u, p - len(left), p + len(right)) for _, _, u, p, _ in run[a:b]]
                kept.append((right, left, uid, place, int(b - a > 1)))
                a = b
        rows, rights = [], [s[0] for s in kept]
        cut = [0, *(bisect.bisect_left(rights, x) for x in splitters), len(kept)]
        for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b > a:
                rows.append((k, front_code(kept[a:b])))
        if spans:
            rows.append((-1 - spread % (len(splitters) + 1), _united(np.array(spans, np.int64)).tobytes()))
        return rows

    for batch in batches:
        for text, uid, places in zip(*(batch.column(c) for c in ("text", "uid", "places")), strict=True):
            text, uid = text.as_py(), uid.as_py()
            for v in np.frombuffer(places.as_py(), np.uint64).tolist():
                p, before, after = v >> 16, v >> 8 & 255, v & 255
                run.append((text[p : p - after + LENGTH], text[p - before : p], uid, p, 0))
            size += len(places.as_py())
            if size > 8 * 150_000:
                yield _sorted(flush())
                run, size = [], 0
                spread += 7
    if run:
        yield _sorted(flush())


_FOUND = "kind int, uid long, start long, end long, digest binary, n long"
_found = _record(_FOUND)


def _merge_runs(batches, splitters: list[bytes]):
    """Repeats (kind 0), and the windows that may repeat across a splitter (kind 1)."""
    for b in groups(batches, 1):
        own = b.column(0)[0].as_py()
        data = b.column(1).to_pylist()
        out: list = []
        if own < 0:
            for x in data:
                yield _found([(0, u, s, e, None, 1) for u, s, e in np.frombuffer(x, np.int64).reshape(-1, 3).tolist()])
            continue
        ends = [x for x in (splitters[own - 1] if own else None, splitters[own] if own < len(splitters) else None) if x is not None]
        windows: dict[bytes, list] = {}
        group: list[tuple] = []
        common: list[int] = []

        def close(out=out, windows=windows, ends=ends) -> None:
            nonlocal group, common
            spans: dict = {}
            for s, a, e in repeats(group, common):
                spans[s[2], a] = max(e, spans.get((s[2], a), 0))
            out += [(0, u, a, e, None, 1) for (u, a), e in spans.items()]
            for s in group:
                reach = max((shared(s[0], x) for x in ends), default=0)
                if reach >= GRAM:
                    right, left, uid, place, many = s
                    whole = left + right
                    for start in range(max(place - len(left), 0), place + len(right) - LENGTH + 1):
                        if LENGTH - (place - start) <= reach:
                            at = start - place + len(left)
                            key = hashlib.blake2b(whole[at : at + LENGTH], digest_size=16).digest()
                            if key in windows:
                                windows[key][1] = 2
                            else:
                                windows[key] = [(uid, start), 2 if many else 1]
            group, common = [], []

        for s, c in merge([front_decode(x) for x in data]):
            if c < GRAM and group:
                close()
            group.append(s)
            common.append(c)
            if len(out) > 50_000:
                yield _found(out)
                out.clear()
        if group:
            close()
        out += [(1, u, a, a + LENGTH, k, n) for k, ((u, a), n) in windows.items()]
        for at in range(0, len(out), 50_000):
            yield _found(out[at : at + 50_000])


def remove_repeats(docs: DataFrame, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and if asked for kept (the bytes
    that stay) for every row of ``docs`` (doc_id, text).

    Null texts are empty; matches never cross texts; rows that repeat a text lose it
    whole if it has 200 bytes. Rows that share a doc_id, or have none, count each. No
    rows, no result.
    """
    spark = docs.sparkSession
    ship(spark)
    p = partitions(spark)
    text = utf8(F.col("text"))
    docs = docs.select(F.coalesce("doc_id", F.lit(_NULL)).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"), F.col("doc_id").isNotNull().alias("known"))
    dealt = docs.drop("known").mapInArrow(lambda b: _deal(b, p), _DEALT)
    dealt = dealt.repartitionById(p, F.pmod(F.col("shard"), F.lit(p)).cast("int")).sortWithinPartitions("shard")
    known = stash(dealt.mapInArrow(lambda b: _shared(b, 4 * p), _SHARED), "shared")
    sample = known.where("kind = 2").select("extra").orderBy(F.xxhash64("extra")).limit(SAMPLE).collect()
    sample = sorted({bytes(r["extra"]) for r in sample})
    splitters = sorted({sample[i * len(sample) // p] for i in range(1, p)}) if sample else []

    rows = stash(known.where("kind = 1").mapInArrow(_listed, "uid long, doc_id long, digest binary"), "documents")
    texts = rows.groupBy("digest").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("n"))
    rows = rows.select("doc_id", "digest").distinct().join(texts, "digest")
    heads = rows.select(F.col("rep").alias("uid"), "digest", "doc_id").groupBy("uid").agg(F.min("doc_id").alias("doc_id"), F.first("digest").alias("digest"))
    places = known.where("kind = 0").select("bucket", "uid", "data").repartition(p, "bucket").sortWithinPartitions("bucket")
    places = places.mapInArrow(_by_document, "uid long, places binary").join(heads, "uid")
    runs = docs.join(places, ["doc_id", "digest"]).select("text", "uid", "places").mapInArrow(lambda b: _sort_runs(b, splitters), _SORTED)
    runs = runs.repartitionById(p, F.pmod(F.col("shard"), F.lit(p)).cast("int")).sortWithinPartitions("shard")
    found = stash(runs.mapInArrow(lambda b: _merge_runs(b, splitters), _FOUND), "found")
    across = found.where("kind = 1").groupBy("digest").agg(F.sum("n").alias("n"), F.collect_list(F.struct("uid", "start", "end")).alias("at"))  # one per range
    across = across.where("n > 1").select(F.explode("at").alias("at")).select("at.*")
    spans = found.where("kind = 0").select("uid", "start", "end").unionByName(across)
    spans = spans.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # of one text
    spans = rows.join(spans.withColumnRenamed("uid", "rep"), "rep", "left").select("doc_id", "digest", "n", "spans")

    def kept(batches):
        for b in batches:
            out = []
            for doc_id, text, n, spans in zip(*(b.column(c) for c in ("id", "text", "n", "spans")), strict=True):
                text, cut = text.as_py(), []
                size = len(text)
                if n.as_py() > 1 and size >= LENGTH:
                    cut = [[0, size]]
                elif spans.is_valid:
                    for s, e in sorted((x["start"], x["end"]) for x in spans.as_py()):
                        if cut and s <= cut[-1][1]:
                            cut[-1][1] = max(e, cut[-1][1])
                        else:
                            cut.append([s, e])
                at, parts = 0, []
                for s, e in cut:
                    parts.append(text[at:s])
                    at = e
                rest = b"".join([*parts, text[at:]])
                out.append((doc_id.as_py(), size, size - len(rest), len(cut), hashlib.sha256(rest).hexdigest(), rest if with_kept else None))
            if out:
                types = [*[pa.int64()] * 4, pa.string(), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    whole = docs.join(spans, ["doc_id", "digest"]).select(F.when(F.col("known"), F.col("doc_id")).alias("id"), "text", "n", "spans")
    out = whole.mapInArrow(kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_kept else out.drop("kept")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), with_kept=False)
