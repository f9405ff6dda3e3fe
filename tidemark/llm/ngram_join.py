"""N-gram Jaccard join of documents by a prefix tree.

1. Every text becomes the set of hashes of its 5-word shingles. Hashes are dealt to
   shards that find those of two documents or more; each document gets these back,
   with how frequent they are. A document of which a quarter is its own alone has no
   partner and is done. Most are.
2. The others' shared hashes are ordered globally, rare ones first. Partners share one
   of the rarest of each (their prefixes), so documents meet in the buckets of their
   prefix hashes. A bucket keeps its sets in a prefix tree, whose nodes are common
   beginnings: a document walks it once, the overlap counted along a beginning is shared
   by all sets below, and a node whose longest set can't reach the overlap that its
   smallest needs is left with all below it.
3. Equal sets are collapsed first, and passes over a few hashes of each document link
   most of each group of copies. Then all prefix hashes count, but only documents of
   several components are searched that meet there, are of similar size, and have room
   for the overlap they need; in one of the buckets where they meet, in bounded blocks.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_stash, partitions, ship, stash, table, utf8
from .components import connected_components
from .vectors import groups

WORDS = 5
PERCENT = 75
BLOCK = 400
#: Prefix hashes of each document in the first pass, from the rarest to the most frequent.
FIRST = 3
#: Passes that link most of each group, before all that is left is searched.
PASSES = 3
_SEGMENT = 1 << 20
_U = np.uint64
_NULL = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    power = np.cumprod(np.concatenate([[_U(1)], np.full(n, _U(_BASE))]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[_U(1)], np.full(n, _U(inverse))]), dtype=np.uint64)
    return power, back


_POWER, _BACK = _tables(_SEGMENT + 1)
_RNG = np.random.default_rng(5)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_PLACE = _RNG.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BLANKS = [bytes([b]) for b in (32, 9, 10, 11, 12, 13)]
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of at most ``_SEGMENT`` bytes."""
    space = np.concatenate([[True], _SPACE[data], [True]])
    turn = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turn[::2], turn[1::2]
    total = np.concatenate([[_U(0)], np.cumsum(_BYTE[data] * _POWER[: len(data)], dtype=np.uint64)])
    return _mixed((total[ends] - total[starts]) * _BACK[starts]), starts


def _long_word(word: bytes) -> np.ndarray:
    """The hash of a word of any length, the same as that of ``_words``."""
    h = 0
    for at in range(0, len(word), _SEGMENT):
        part = np.frombuffer(word, np.uint8, min(_SEGMENT, len(word) - at), at)
        h += int((_BYTE[part] * _POWER[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return _mixed(np.array([h & ((1 << 64) - 1)], np.uint64))


def _long_words(text: bytes) -> np.ndarray:
    """The hashes of the words of a long text, taken in segments that end at white space;
    a word that has none within a segment is taken alone."""
    at, out = 0, []
    while at < len(text):
        end = min(len(text), at + _SEGMENT)
        cut = end if end == len(text) else max(text.rfind(c, at, end) for c in _BLANKS) + 1
        if cut > at:
            out.append(_words(np.frombuffer(text, np.uint8, cut - at, at))[0])
        else:
            blank = _BLANK.search(text, end)
            cut = blank.start() if blank else len(text)
            out.append(_long_word(text[at:cut]))
        at = cut
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _shingles(words: np.ndarray) -> np.ndarray:
    n = len(words)
    if n < WORDS:
        return words[:0] if not n else _mixed((words * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + _PLACE[WORDS:] * np.array([n], np.uint64))
    h = np.zeros(n - WORDS + 1, np.uint64)
    for k in range(WORDS):
        h += words[k : n - WORDS + 1 + k] * _PLACE[k]
    return _mixed(h)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0

    def close() -> None:
        starts = np.cumsum([0] + [len(t) + 1 for t in group])
        words, at = _words(np.frombuffer(b" ".join(group), np.uint8))
        cut = np.searchsorted(at, starts)
        out.extend(np.unique(_shingles(words[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True))

    for t in texts:
        if held + len(t) + 1 > _SEGMENT and group:
            close()
            group, held = [], 0
        if len(t) >= _SEGMENT:
            out.append(np.unique(_shingles(_long_words(t))))
        else:
            group.append(t)
            held += len(t) + 1
    if group:
        close()
    return out


_DEALT = "shard int, base long, counts binary, low binary, high binary, docs binary"


def _deal(batches, shards: int):
    """Per shard a row with the hashes of some hundred documents; 40 bits of each, as
    the shard tells the rest. Rows of shard -1 - x have the documents and set sizes. The last column
    is the text, those before it tell documents apart."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 40
    ids, sets, held = [], [], 0

    def rows():
        sizes = np.array([len(s) for s in sets])
        h, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        shard = ((h >> _U(40)) % _U(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        h, doc, shard = h[order], doc[order], shard[order]
        cut = np.searchsorted(shard, np.arange(shards + 1))
        out = []
        for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b > a:
                part = h[a:b]
                counts = np.bincount(doc[a:b], minlength=len(sets)).astype(np.uint32)
                high = ((part >> _U(32)) & _U(255)).astype(np.uint8)
                out.append((s, base, counts.tobytes(), part.astype(np.uint32).tobytes(), high.tobytes(), None))
        out.append((-1 - (base + len(ids)) % shards, base, sizes.astype(np.int64).tobytes(), None, None, np.array(ids, np.int64).tobytes()))
        types = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["shard", "base", "counts", "low", "high", "docs"])

    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            new = shingle_sets(part.column(part.num_columns - 1).to_pylist())
            ids += zip(*(c.to_pylist() for c in part.columns[:-1]), strict=True)
            sets += new
            held += sum(map(len, new))
            if held > 1_500_000:
                yield rows()
                base += len(ids)
                ids, sets, held = [], [], 0
    if ids:
        yield rows()


_BACKED = "kind int, bucket int, uid binary, n binary, data binary"


def _shared(batches, shards: int, buckets: int):
    """The hashes of a shard that two documents or more have, back to these: value =
    frequency class << 56 | shard << 40 | hash, by buckets of documents."""
    low, high, doc, own = [], [], [], None

    def row(kind, bucket, uid, n, data):
        return [kind, bucket, uid.tobytes(), None if n is None else n.tobytes(), None if data is None else data.tobytes()]

    def flush():
        h = np.concatenate(high).astype(np.uint64) << _U(32) | np.concatenate(low).astype(np.uint64)
        d = np.concatenate(doc)
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        df = np.diff(np.append(first, len(h)))
        df = np.repeat(df, df)
        many = df > 1
        h, d, df = h[many], d[many], df[many]
        level = np.minimum(np.floor(np.log2(df) * 4), 127).astype(np.uint64)
        value = level << _U(56) | _U(own) << _U(40) | h
        bucket = (d >> 8) % buckets
        order = np.lexsort([d, bucket])
        d, value, bucket = d[order], value[order], bucket[order]
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        return [row(0, k, d[a:b], None, value[a:b]) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]

    def batch(rows):
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 3]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["kind", "bucket", "uid", "n", "data"])

    for b in batches:
        for shard, base, counts, lo, hi, docs in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if shard < 0:
                n = np.frombuffer(counts, np.int64)
                ids = np.frombuffer(docs, np.int64).reshape(len(n), -1)
                uid = base + np.arange(len(n))
                block = uid >> 8
                cut = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(n)]
                yield batch([row(1, int(block[a]) % buckets, uid[a:e], n[a:e], ids[a:e]) for a, e in zip(cut[:-1], cut[1:], strict=True)])
                continue
            if own is not None and shard != own and low:
                if rows := flush():
                    yield batch(rows)
                low, high, doc = [], [], []
            own = shard
            c = np.frombuffer(counts, np.uint32)
            low.append(np.frombuffer(lo, np.uint32))
            high.append(np.frombuffer(hi, np.uint8))
            doc.append(base + np.repeat(np.arange(len(c)), c))
    if low and (rows := flush()):
        yield batch(rows)


_SETS = "uid long, n long, data binary"


def _survivors(batches):
    """Documents whose shared hashes are enough of them to have a partner."""
    from collections import defaultdict

    for b in groups(batches, 1):
        n, uid, value = {}, [], []
        for kind, u, sizes, data in zip(*(b.column(c).to_pylist() for c in ("kind", "uid", "n", "data")), strict=True):
            u = np.frombuffer(u, np.int64)
            if kind == 1:
                n |= zip(u.tolist(), np.frombuffer(sizes, np.int64).tolist(), strict=True)
            else:
                uid.append(u)
                value.append(np.frombuffer(data, np.uint64))
        if not uid:
            continue
        uid, value = np.concatenate(uid), np.concatenate(value)
        order = np.lexsort([value, uid])
        uid, value = uid[order], value[order]
        cut = np.concatenate([[0], np.flatnonzero(uid[1:] != uid[:-1]) + 1, [len(uid)]])
        out = defaultdict(list)
        for a, e in zip(cut[:-1], cut[1:], strict=True):
            u = int(uid[a])
            if 100 * (e - a) >= PERCENT * n[u]:
                for k, x in zip(("uid", "n", "data"), (u, n[u], value[a:e].tobytes()), strict=True):
                    out[k].append(x)
        if out:
            yield pa.record_batch([pa.array(out["uid"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["data"], pa.binary())], list(out))


def _prefix(n: int, values: np.ndarray) -> np.ndarray:
    """The hashes of which partners must share one: a document's own alone come first."""
    p = n - -(-PERCENT * n // 100) + 1 - (n - len(values))
    return values[: max(p, 0)]


def _least(a: int, b: int) -> int:
    """The overlap that sets of these sizes need."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


class Node:
    """Sets order[lo:hi] of a tree: ``part`` is what their beginnings share beyond the
    node above. longest: what any of them has from there on; least and most: of their
    whole sizes; group: their component, if it is one; last: the last of them as given."""

    __slots__ = ("below", "group", "last", "least", "longest", "lo", "most", "part")


class Tree:
    """Sorted sets by their common beginnings. ``sizes``: of the whole documents;
    ``groups``: their components."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int], groups: list[int]) -> None:
        keys = [s.astype(">u8").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.sizes, self.groups = [sizes[i] for i in self.order], [groups[i] for i in self.order]
        common = [0]
        for a, b in zip(self.sets[:-1], self.sets[1:], strict=True):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common.append(int(differ[0]) if len(differ) else m)
        self.top: list[Node] = []
        common = np.array(common)
        todo = [(0, len(sets), 0, self.top)] if sets else []
        while todo:
            lo, hi, depth, into = todo.pop()
            node = Node()
            to = int(common[lo + 1 : hi].min()) if hi - lo > 1 else len(self.sets[lo])
            node.lo, node.part, node.below = lo, self.sets[lo][depth:to], []
            node.longest = max(len(x) for x in self.sets[lo:hi]) - depth
            node.last = max(self.order[lo:hi])
            node.least, node.most = min(self.sizes[lo:hi]), max(self.sizes[lo:hi])
            node.group = self.groups[lo] if min(self.groups[lo:hi]) == max(self.groups[lo:hi]) else None
            into.append(node)
            if hi - lo > 1:
                cut = [lo, *(lo + 1 + np.flatnonzero(common[lo + 1 : hi] == to)).tolist(), hi]
                todo += [(a, b, to, node.below) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def walk(self, x: np.ndarray, size: int, given: int, after: int, known):
        """Yields (position, overlap) of the sets, of those given behind ``after``, that
        share with x, of a document of ``size``, what they need with the ``given`` that
        they share besides. ``known(group)``: sets of this component needn't be found."""
        todo = [(node, 0, 0) for node in self.top]
        while todo:
            node, both, at = todo.pop()
            if node.last <= after or 100 * node.most < PERCENT * size or 100 * size < PERCENT * node.least:
                continue
            if both + given + min(node.longest, len(x) - at) < _least(size, node.least) or (node.group is not None and known(node.group)):
                continue
            if len(node.part):
                where = np.searchsorted(x[at:], node.part)
                if at < len(x):
                    both += int((x[np.minimum(at + where, len(x) - 1)] == node.part).sum())
                    at = int(at + np.searchsorted(x[at:], node.part[-1], side="right"))
            if node.below:
                todo += [(n, both, at) for n in node.below]
            elif both + given >= _least(size, node.least):
                yield node.lo, both


def _join_bucket(token: int, uid: np.ndarray, n: np.ndarray, sets: list[np.ndarray], part: np.ndarray, block: np.ndarray | None):
    """Pairs that connect what ``part`` doesn't: (uid, uid) of linked documents."""
    cut = [int(np.searchsorted(s, _U(token))) for s in sets]
    sizes, parts = n.tolist(), part.tolist()
    tree = Tree([s[c + 1 :] for s, c in zip(sets, cut, strict=True)], sizes, parts)
    order = tree.order
    root: dict = {}

    def find(a):
        while root.get(a, a) != a:
            a = root[a]
        return a

    for x in range(len(uid)):
        for i, both in tree.walk(sets[x][cut[x] + 1 :], sizes[x], 1, x, lambda g, x=x: find(g) == find(parts[x])):  # they share the token
            y = order[i]
            if y <= x or find(parts[x]) == find(parts[y]) or (block is not None and block[x] == block[y]):
                continue
            both += 1 + np.intersect1d(sets[x][: cut[x]], sets[y][: cut[y]], assume_unique=True).size
            if 100 * both >= PERCENT * (sizes[x] + sizes[y] - both):
                yield int(uid[x]), int(uid[y])
                a, b = find(parts[x]), find(parts[y])
                root[max(a, b)] = min(a, b)


def _join(batches, in_blocks: bool):
    for b in groups(batches, 3 if in_blocks else 2):
        if b.num_rows < 2:
            continue
        uid, first = np.unique(b.column("uid").to_numpy(), return_index=True)  # a leader may also stand in its block
        n, part = b.column("n").to_numpy()[first], b.column("part").to_numpy()[first]
        data = b.column("data")
        sets = [np.frombuffer(data[int(i)].as_py(), np.uint64) for i in first]
        block = None
        if in_blocks and b.column(1)[0].as_py() != b.column(2)[0].as_py():
            block = b.column("block").to_numpy()[first]
        found = list(_join_bucket(b.column(0)[0].as_py(), uid, n, sets, part, block))
        if found:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])


_POSTS = "uid long, token long, place long, n long"


def _posted(batches, most: int | None):
    for b in batches:
        uid, token, at, size = [], [], [], []
        for u, n, data in zip(*(b.column(c).to_pylist() for c in ("uid", "n", "data")), strict=True):
            p = _prefix(n, np.frombuffer(data, np.uint64))
            own = n - len(data) // 8  # the document's own hashes come first
            place = np.arange(own, own + len(p))
            if most and len(p) > most:
                pick = np.linspace(0, len(p) - 1, most).astype(int)
                p, place = p[pick], place[pick]
            at.append(place)
            size.append(np.full(len(p), n))
            uid.append(np.full(len(p), u))
            token.append(p.astype(np.int64))
        if uid:
            cols = [pa.array(np.concatenate(c).astype(np.int64)) for c in (uid, token, at, size)]
            yield pa.record_batch(cols, ["uid", "token", "place", "n"])


def _linked(reps: DataFrame, p: int) -> DataFrame:
    """(a, b): links that connect the documents ``reps`` (uid, n, data) as all links do."""
    # first passes: a few buckets a document, blocks of a bucket tied by its first document
    posts = stash(reps.mapInArrow(lambda b: _posted(b, FIRST), _POSTS).select("uid", "token"), "posts")
    every = part = near = None
    for again in range(PASSES):
        counts = posts.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("uid").alias("head")).where("c > 1")
        blocks = F.ceil(F.col("c") / BLOCK).cast("int")
        put = posts.join(counts.select("token", blocks.alias("blocks")).hint("merge"), "token")
        put = put.select("token", F.pmod(F.xxhash64("uid"), "blocks").cast("int").alias("block"), "uid")
        tie = counts.select("token", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("head").alias("uid"))
        whole = reps.withColumn("part", F.col("uid")) if part is None else reps.join(part.hint("merge"), "uid")
        put = put.unionByName(tie).join(whole.hint("merge"), "uid").select("token", "block", "uid", "n", "part", "data")
        put = put.repartition(p, "token", "block").sortWithinPartitions("token", "block")
        new = put.mapInArrow(lambda b: _join(b, False), "a long, b long")
        last, near = near, stash(new if near is None else near.unionByName(new), "near")
        if part is not None:
            drop_stash(part, last)
        part = connected_components(near, "a", "b").withColumnsRenamed({"node": "uid", "component": "part"})
        part = stash(reps.select("uid").join(part, "uid", "left").withColumn("part", F.coalesce("part", "uid")), "parts")
        # all prefix hashes, where documents of several components meet
        if every is None:
            every = stash(reps.mapInArrow(lambda b: _posted(b, None), _POSTS), "every")
        drop_stash(posts)
        all_ = every.join(part.hint("merge"), "uid")
        mixed = all_.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("part").alias("x"), F.max("part").alias("y"))
        posts = everything = stash(all_.join(mixed.where("x <> y").select("token", "c").hint("merge"), "token"), "posts")
        if everything.isEmpty():
            drop_stash(every, part, posts)
            return near
        if again < PASSES - 1:  # next, the largest of these buckets for each document
            largest = W.partitionBy("uid").orderBy(F.desc("c"), "token")
            posts = stash(posts.withColumn("r", F.row_number().over(largest)).where("r <= 2").select("uid", "token"), "largest")
            drop_stash(everything)
    drop_stash(every)

    # last pass: pairs of similar size, with room for the overlap they need after the hash
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / PERCENT)).cast("int")  # partners are in the same or the next
    side = lambda k, band: everything.select("token", band.alias("band"), *[F.col(c).alias(f"{c}_{k}") for c in ("uid", "place", "n", "part")])
    need = F.ceil(F.lit(PERCENT) * (F.col("n_a") + F.col("n_b")) / (100 + PERCENT))
    room = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    meet = side("a", band).join(side("b", F.explode(F.array(band, band - 1))), ["token", "band"])
    meet = meet.where((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("uid_a") < F.col("uid_b")))).where("part_a <> part_b")
    meet = meet.where((100 * F.col("n_a") >= PERCENT * F.col("n_b")) & (room >= need))
    # one bucket a pair, that of its first common hash: the walk counts only what comes after
    meet = meet.groupBy("uid_a", "uid_b").agg(F.min("token").alias("token"))
    put = stash(meet.select("token", F.explode(F.array("uid_a", "uid_b")).alias("uid")).distinct(), "meeting")
    drop_stash(everything)
    counts = put.groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    put = put.join(counts.select("token", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "token")
    put = put.withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    put = put.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    put = put.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "uid")
    put = put.join(reps.join(part.hint("merge"), "uid").hint("merge"), "uid").select("token", "i", "j", "block", "uid", "n", "part", "data")
    rest = put.repartition(p, "token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(lambda b: _join(b, True), "a long, b long")
    found = stash(near.unionByName(rest), "near")
    drop_stash(near, part)
    return found


def ngram_components(docs: DataFrame, key: tuple[str, ...] = (), node: bool = False) -> DataFrame:
    """doc_id, key, n_shingles, component_id for every row of ``docs`` (doc_id, key, text);
    ``key``: columns of longs that pass, without nulls. ``node``: with component, a number
    of the component that no other one has, also where doc_ids repeat.

    Texts of fewer than five words are one shingle, their whole sequence; null and
    blank texts have none and link with nothing. Repeated rows link with each other
    like other equal texts. A null doc_id is the largest one, also of 2^63 - 1. No
    rows, no result.
    """
    spark = docs.sparkSession
    ship(spark)
    p = partitions(spark)
    own = docs.select(F.col("doc_id").isNull().cast("long").alias("none"), F.coalesce("doc_id", F.lit(_NULL)).alias("doc_id"), *key, utf8(F.col("text")).alias("text"))
    dealt = own.mapInArrow(lambda b: _deal(b, p), _DEALT)
    dealt = dealt.repartitionById(p, F.pmod(F.col("shard"), F.lit(p)).cast("int")).sortWithinPartitions("shard")
    backed = stash(dealt.mapInArrow(lambda b: _shared(b, p, 4 * p), _BACKED), "shared")
    names = ["none", "doc_id", *key]

    def listed(batches):
        for b in batches:
            for u, n, d in zip(*(b.column(c).to_pylist() for c in ("uid", "n", "data")), strict=True):
                ids = np.frombuffer(d, np.int64).reshape(-1, len(names))
                cols = [np.frombuffer(u, np.int64), *(np.ascontiguousarray(ids[:, i]) for i in range(len(names))), np.frombuffer(n, np.int64)]
                yield pa.record_batch([pa.array(c) for c in cols], ["node", *names, "n_shingles"])

    rows = backed.where("kind = 1").select("uid", "n", "data").mapInArrow(listed, ", ".join(f"{c} long" for c in ["node", *names, "n_shingles"]))
    rows = stash(rows, "rows")
    by_doc = backed.select("bucket", "kind", "uid", "n", "data").repartition(p, "bucket").sortWithinPartitions("bucket")
    sets = by_doc.mapInArrow(_survivors, _SETS)
    # equal sets: nothing in them is a document's own
    equal = F.when(F.octet_length("data") == 8 * F.col("n"), F.md5("data")).otherwise(F.col("uid").cast("string"))
    sets = stash(sets.withColumn("key", equal), "sets")
    drop_stash(backed)
    id_ = F.when(F.col("none") == 0, F.col("doc_id"))
    if sets.isEmpty():
        drop_stash(sets)
        out = rows.select(id_.alias("doc_id"), *key, "n_shingles", id_.alias("component_id"), F.col("node").alias("component"))
        return out if node else out.drop("component")
    heads = stash(sets.groupBy("key").agg(F.min("uid").alias("rep")), "heads")
    edges = sets.select("key", "uid").join(heads, "key").where("uid <> rep").select(F.col("uid").alias("a"), F.col("rep").alias("b"))
    edges = stash(edges, "equal")
    reps = stash(sets.join(heads.select(F.col("rep").alias("uid")).hint("merge"), "uid", "left_semi").select("uid", "n", "data"), "reps")
    drop_stash(sets, heads)
    near = _linked(reps, p)
    part = stash(connected_components(edges.unionByName(near), "a", "b"), "components")
    drop_stash(reps, near, edges)
    rows = rows.join(part.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = rows.groupBy("component").agg(F.min(F.struct("none", "doc_id")).alias("first"))  # combined before the exchange
    rows = rows.join(first.hint("merge"), "component")
    first = F.when(F.col("first.none") == 0, F.col("first.doc_id"))
    out = rows.select(id_.alias("doc_id"), *key, "n_shingles", first.alias("component_id"), "component")
    return out if node else out.drop("component")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return ngram_components(table(spark, sf_dir, "documents", "doc_id", "text"))
