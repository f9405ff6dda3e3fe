"""How far the sources of a language differ in their words.

Smoothed word shares of every pair of groups are compared by two-dimensional tiling: the
groups of a language are cut into blocks, the vocabulary into chunks, and a group's counts
within a chunk travel as one packed vector. Each vector goes to all tiles of its block's
row and column. A tile holds two blocks of one chunk at a time, adds the chunk's part to
its submatrix of pairs, and goes on to the next chunk. A long vocabulary is cut into
spans, each with its own tiles, whose submatrices are added. So a task holds a few
megabytes however many groups or words there are.

Shares are whole billionths, computed in whole numbers.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered, partitions, ship, stash, table, utf8

MIN_DOCS, SMOOTH, TOP = 30, 5, 50
#: Groups in a block, words in a chunk, chunks in a span.
BLOCK, CHUNK, SPAN = 128, 512, 512
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
_PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
_HELD = 200_000


def _letters() -> bytes:
    """For each byte the lower-case letter that it is part of, else a space."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences of each term in each group, and documents
    that hold it. A null lang, source or text is ''. A row with a null term for each group
    has its documents, so that a group without terms is not lost. Each task combines what
    it reads before the shuffle."""
    ship(docs.sparkSession)
    letters = _letters()

    def rows(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def batch():
            cols = [[], [], [], [], []]
            for (lang, source), (n, in_docs) in held.items():
                for term, k in in_docs.items():
                    for c, x in zip(cols, (lang, source, term, n[term], k), strict=True):
                        c.append(x)
            held.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _COUNTS, strict=True)], schema=_COUNTS)

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                own = Counter(text.as_py().translate(letters).split())
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(in_docs)
                n.update(own)
                in_docs.update(own.keys())
                in_docs[None] += 1
                size += len(in_docs) - before
                if size >= _HELD:
                    yield batch()
                    size = 0
        if held:
            yield batch()

    d = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], utf8(F.col("text")).alias("text"))
    d = d.mapInArrow(rows, "lang string, source string, term binary, n long, docs long")
    d = d.withColumn("term", F.col("term").cast("string"))
    return d.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str, smooth: int = SMOOTH):
    """1 + floor(10^9 * (n + smooth) / (total + smooth * terms)) in whole numbers: three
    digits of the quotient at a time, so that nothing overflows below 9 * 10^15 words."""
    a, b = f"({n} + {smooth})", f"({total} + {smooth} * {terms})"
    first = f"({a} * 1000 div {b})"
    r1 = f"({a} * 1000 % {b})"
    second, r2 = f"({r1} * 1000 div {b})", f"({r1} * 1000 % {b})"
    return F.expr(f"1 + {first} * 1000000 + {second} * 1000 + ({r2} * 1000 div {b})")


def _shares(n: np.ndarray, total: np.ndarray, terms: int, smooth: int) -> np.ndarray:
    """The same as :func:`share`, for arrays."""
    b = total + smooth * terms
    out, rest = np.zeros(np.broadcast(n, b).shape, np.int64), n + smooth
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, b)
        out = out * 1000 + digits
    return out + 1


def vocabulary(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, lang_n, at: the terms in at least ``min_docs`` documents of a language,
    numbered from 0 within it."""
    d = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    return numbered(d.where(F.col("docs") >= min_docs).drop("docs"), ["lang"], ["term"], "at")


class _Tile:
    """One tile: two blocks of groups (the same on the diagonal) and a span of words."""

    def __init__(self, key: tuple, terms: int, words: int, smooth: int) -> None:
        self.key, self.terms, self.words, self.smooth = key, terms, words, smooth
        self.groups: list[list[tuple]] = [[], []]  # per side (number, source, total)
        self.d = None
        self.chunk, self.held, self.covered = None, [[], []], 0

    def add(self, side: int, chunk: int, number: int, source: str, total: int, at, n) -> None:
        if chunk < 0:
            self.groups[side].append((number, source, total))
            return
        if chunk != self.chunk:
            self.close()
            self.chunk = chunk
        self.held[side].append((number, at, n))

    def _open(self) -> None:
        self.row = [{g[0]: i for i, g in enumerate(side)} for side in self.groups]
        self.totals = [np.array([g[2] for g in side], np.int64)[:, None] for side in self.groups]
        self.base = [_shares(np.zeros(1, np.int64), t, self.terms, self.smooth) if self.terms else t * 0 for t in self.totals]
        self.d = np.zeros((len(self.groups[0]), len(self.groups[1])), np.int64)

    def close(self) -> None:
        """Adds the chunk that is held: only words that a group of the tile has."""
        if self.d is None:
            self._open()
        if not (self.held[0] or self.held[1]):
            return
        own = np.unique(np.concatenate([at for side in self.held for _, at, _ in side]))
        p = []
        for side in (0, 1):
            x = np.zeros((len(self.groups[side]), len(own)), np.int64)
            for number, at, n in self.held[side]:
                x[self.row[side][number], np.searchsorted(own, at)] = n
            p.append(_shares(x, self.totals[side], self.terms, self.smooth))
        for i, row in enumerate(p[0]):
            self.d[i] += np.abs(p[1] - row).sum(axis=1)
        self.covered += len(own)
        self.held = [[], []]

    def rows(self):
        self.close()
        self.d += (self.words - self.covered) * np.abs(self.base[0] - self.base[1].T)
        both = self.key[1] != self.key[2]
        for i, (a, source, _) in enumerate(self.groups[0]):
            for j, (b, item, _) in enumerate(self.groups[1]):
                if a != b:
                    yield self.key[0], source, item, int(self.d[i, j])
                    if both:
                        yield self.key[0], item, source, int(self.d[i, j])


def _tiles(spark: SparkSession, vectors: DataFrame, smooth: int) -> DataFrame:
    """The pairs' sums of each tile and span."""
    ship(spark)
    key = ["lang", "low", "high", "span"]
    n = partitions(spark)
    order = [*key, "chunk", "number", "side"]
    d = vectors.repartition(n, *key).sortWithinPartitions(*order)

    def rows(batches):
        tile, out = None, []

        def batch():
            cols, out[:] = list(zip(*out, strict=True)), []
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _PAIRS, strict=True)], schema=_PAIRS)

        def done():
            for row in tile.rows():
                out.append(row)
                if len(out) >= 50_000:
                    yield batch()

        for b in batches:
            c = {name: b.column(name) for name in b.schema.names}
            few = {k: c[k].to_pylist() for k in (*order, "source", "total", "terms", "words")}
            flat = {k: (c[k].offsets.to_numpy(), c[k].values.to_numpy()) for k in ("at", "n")}
            for i in range(b.num_rows):
                of = tuple(few[k][i] for k in key)
                if tile is None or tile.key != of:
                    if tile is not None:
                        yield from done()
                    tile = _Tile(of, few["terms"][i], few["words"][i], smooth)
                at, counts = (values[offsets[i] : offsets[i + 1]].copy() for offsets, values in (flat["at"], flat["n"]))
                for side in (0, 1) if few["side"][i] == 2 else (few["side"][i],):
                    tile.add(side, few["chunk"][i], few["number"][i], few["source"][i], few["total"][i], at, counts)
        if tile is not None:
            yield from done()
        if out:
            yield batch()

    return d.select(*order, "source", "total", "terms", "words", "at", "n").mapInArrow(rows, "lang string, source string, item string, value long")


def audit(
    docs: DataFrame, min_docs: int = MIN_DOCS, smooth: int = SMOOTH, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK, span: int = SPAN
) -> DataFrame:
    """lang, source, part, item, value, rank of documents (lang, source, text).

    Part ``pair``: the other sources of the language by the sum of differences of shares
    over all kept terms; part ``term``: the ``top`` terms whose share most exceeds the
    language's. Nulls are ''; repeated rows count again; texts of any length are read
    whole; no documents, no rows; other columns are ignored. A language without kept terms
    has pairs of value 0 and no terms; ranks go by value, then by item's UTF-8 bytes.
    """
    spark = docs.sparkSession
    counts = stash(term_counts(docs), "term-counts")
    kept = stash(vocabulary(counts, min_docs), "kept-terms")
    own = stash(counts.where("term IS NOT NULL").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-counts")
    langs = counts.where("term IS NULL").groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")).join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total")), "lang", "left")
    langs = langs.fillna(0, ["terms", "lang_total"])
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").fillna(0, ["total"])
    groups = numbered(groups, ["lang"], ["source"], "number").join(langs, "lang")
    groups = stash(groups.withColumn("block", F.floor(F.col("number") / block)), "groups")

    # packed vectors: a group's counts in a chunk; and a row that opens each group in each span
    spans = F.greatest(F.lit(1), F.ceil(F.col("terms") / (chunk * span)))
    heads = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), spans - 1)).alias("span"), F.lit(-1).cast("long").alias("chunk"))
    heads = heads.select("*", F.array().cast("array<long>").alias("at"), F.array().cast("array<long>").alias("n"))
    x = own.select("lang", "source", F.floor(F.col("at") / chunk).alias("chunk"), F.struct("at", "n").alias("x"))
    x = x.groupBy("lang", "source", "chunk").agg(F.sort_array(F.collect_list("x")).alias("x"))
    x = x.select("lang", "source", "chunk", F.floor(F.col("chunk") / span).alias("span"), F.col("x.at").alias("at"), F.col("x.n").alias("n"))
    vectors = heads.unionByName(x.join(groups, ["lang", "source"]))
    vectors = vectors.withColumn("words", F.greatest(F.lit(0), F.least(F.lit(chunk * span), F.col("terms") - F.col("span") * (chunk * span))))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    vectors = vectors.select("*", other).withColumns({
        "low": F.least("block", "other"), "high": F.greatest("block", "other"),
        "side": F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1),
    })
    pairs = _tiles(spark, vectors, smooth).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    d = own.select("lang", "source", F.col("term").alias("item"), "n", "lang_n").join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    d = d.where("n > 0").select("lang", "source", "item", (share("n", "total", "terms", smooth) - share("lang_n", "lang_total", "terms", smooth)).alias("value"))
    d = d.where("value > 0").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pairs.unionByName(d.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(table(spark, sf_dir, "documents", "lang", "source", "text"))
