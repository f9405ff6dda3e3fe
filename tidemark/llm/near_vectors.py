"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosines,
connected components.

Equal vectors are collapsed first. In each table a vector's bucket is the signs of its
products with a few random hyperplanes. The number of planes follows the number of
vectors, so buckets stay small; the number of tables follows from the planes, so that
a pair at the threshold meets with probability ``recall``, and closer pairs more
likely. Into its buckets a vector sends only a sketch, the signs at some more planes;
whoever finds another one there whose sketch differs in no more bits than those of
linked vectors do sends its components as well, for exact cosines. Buckets of any size
are split into blocks and compared block by block; a pair is counted only in the first
table where it meets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stash, partitions, ship, stash, table
from .components import connected_components
from .vectors import groups, matrix, runs, usable

THRESHOLD = 0.9
RECALL = 0.97
BLOCK = 1024
SEED = 11
#: Bits of a sketch, and by how many standard deviations more of them than expected may
#: differ at the threshold (about one linked pair in a million differs in more).
SKETCH = 256
ALLOW = 4.8


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(planes per table, tables) for ``n`` vectors."""
    planes = min(30, max(4, math.ceil(math.log2(max(n, 1) / 6 + 1))))
    meet = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def allowed(threshold: float = THRESHOLD) -> int:
    """The most bits in which sketches of linked vectors may differ."""
    p = math.acos(threshold) / math.pi
    return math.floor(SKETCH * p + ALLOW * math.sqrt(SKETCH * p * (1 - p)))


def _signed(vectors: DataFrame, planes: int, tables: int) -> DataFrame:
    """Adds sigs, the bucket in each table, and sketch."""

    def rows(batches):
        made = {}
        for b in batches:
            lengths = pc.list_value_length(b.column("embedding")).to_numpy(zero_copy_only=False)
            sigs, sketch = np.empty((b.num_rows, tables), np.int32), np.empty((b.num_rows, SKETCH // 8), np.uint8)
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                x = matrix(b.column("embedding").take(pa.array(at)))
                if d not in made:
                    made[d] = np.random.default_rng([SEED, d]).standard_normal((d, planes * tables + SKETCH))
                for s in range(0, len(at), 512):
                    x_ = x[s : s + 512] / np.abs(x[s : s + 512]).max(1)[:, None]  # products stay finite
                    up = x_ @ made[d] > 0
                    sigs[at[s : s + 512]] = up[:, : planes * tables].reshape(-1, tables, planes) @ (1 << np.arange(planes))
                    sketch[at[s : s + 512]] = np.packbits(up[:, planes * tables :], axis=1)
            cut = np.arange(0, len(sigs.ravel()) + 1, tables, dtype=np.int32)
            yield pa.record_batch([*b.columns, pa.ListArray.from_arrays(cut, sigs.ravel()), pa.array([r.tobytes() for r in sketch], pa.binary())], [*b.schema.names, "sigs", "sketch"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.mapInArrow(rows, f"rep long, n long, embedding {kind}, sigs array<int>, sketch binary")


def _runs(batches):
    """Record batches in which rows with equal t, bucket, d, i and j stand together ->
    (batch, starts of the runs and the end), each run whole in one batch."""
    names = ["t", "bucket", "d", "i", "j"]
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        if rest is not None:
            b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        cut = runs(np.stack([b.column(c).to_numpy() for c in names], axis=1))
        rest = b.slice(cut[-2])
        if len(cut) > 2:
            yield b.slice(0, cut[-2]), cut[:-1]
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


def _close(batches, most: int):
    """The rows that meet another one in their run whose sketch is near."""
    for b, cut in _runs(batches):
        sketch = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint64).reshape(b.num_rows, -1)
        same = b.column("i").to_numpy() == b.column("j").to_numpy()
        block, keep = b.column("block").to_numpy(), np.zeros(b.num_rows, bool)
        ends = np.repeat(cut[1:], np.diff(cut))
        size = int(np.diff(cut).max())
        for k in range(1, min(size, 64)):  # neighbours k rows apart, of all runs at once
            a = np.flatnonzero(np.arange(b.num_rows) + k < ends)
            a = a[same[a] | (block[a] != block[a + k])]
            near = a[np.bitwise_count(sketch[a] ^ sketch[a + k]).sum(1) <= most]
            keep[near] = keep[near + k] = True
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if e - s <= 64:
                continue
            for r in range(s, e):
                other = slice(r + 1, e)
                if (keep[r] and keep[other].all()) or r + 1 == e:
                    continue
                near = np.bitwise_count(sketch[other] ^ sketch[r]).sum(1) <= most
                if not same[r]:
                    near &= block[other] != block[r]
                keep[other] |= near
                keep[r] |= near.any()
        if keep.any():
            yield b.filter(pa.array(keep)).drop_columns(["sketch"])


def _links(batches, threshold: float):
    """For each vector of a pair of blocks: how many it links with there, and the
    smallest vector that it reaches there."""
    for b in groups(batches, 5):
        t, i, j = (b.column(k)[0].as_py() for k in ("t", "i", "j"))
        order = np.argsort(b.column("rep").to_numpy(), kind="stable")
        rep, n, block = (b.column(c).to_numpy()[order] for c in ("rep", "n", "block"))
        x = matrix(b.column("embedding"))[order]
        x /= np.abs(x).max(1)[:, None]  # squares stay finite
        x /= np.sqrt((x * x).sum(1))[:, None]
        sigs = b.column("sigs").flatten().to_numpy().reshape(len(rep), -1)[order]
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))

        def find(a, root=root):
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        for s in range(0, len(rep), 256):
            near = x[s : s + 256] @ x.T >= threshold
            p, q = np.nonzero(near)
            p += s
            ok = (p < q) & ((block[p] != block[q]) | (i == j))
            p, q = p[ok], q[ok]
            for at in range(0, len(p), 100_000):
                pp, qq = p[at : at + 100_000], q[at : at + 100_000]
                first = (sigs[pp] == sigs[qq]).argmax(1) == t
                pp, qq = pp[first], qq[first]
                np.add.at(links, pp, n[qq])
                np.add.at(links, qq, n[pp])
                # a spanning forest is enough for the components
                for u in np.unique(pp):
                    ru = find(u)
                    for v in qq[pp == u]:
                        rv = find(v)
                        if rv != ru:
                            ru, rv = min(ru, rv), max(ru, rv)
                            root[rv] = ru
        if links.any():
            has = np.flatnonzero(links)
            to = np.array([find(a) for a in has])
            yield pa.record_batch([pa.array(rep[has]), pa.array(links[has]), pa.array(rep[to])], ["rep", "links", "root"])


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``rows`` (vec_id, embedding).

    Vectors that are null, zero, or hold null or non-finite components link with
    nothing, as do rows without a vec_id (their component_id is null, and they are kept)
    and vectors of different lengths with each other. Rows that repeat a vector, their vec_id too or
    not, link with each other. An empty table gives no rows.
    """
    spark = rows.sparkSession
    ship(spark)
    p = partitions(spark)
    kind = rows.schema["embedding"].dataType.simpleString()
    rows = rows.select("vec_id", F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("embedding"))
    good = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = stash(classes.select("rep", "n", "embedding"), "vectors")
    planes, tables = plan(classes.count(), threshold, recall)
    signed = stash(_signed(classes, planes, tables), "signed")
    put = signed.select("rep", F.size("embedding").alias("d"), "sketch", F.posexplode("sigs").alias("t", "bucket"))
    counts = put.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("size"))
    blocks = counts.where("size > 1").select("t", "bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    put = put.join(blocks, ["t", "bucket"])
    put = put.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    put = put.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = ["t", "bucket", "d", "i", "j"]
    put = put.select("t", "bucket", "d", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "sketch")
    put = put.repartition(p, *at).sortWithinPartitions(*at)
    most = allowed(threshold)
    close = stash(put.mapInArrow(lambda b: _close(b, most), "t int, bucket int, d int, i int, j int, block int, rep long"), "close")
    put = close.join(signed.select("rep", "n", "embedding", "sigs"), "rep").select(*at, "block", "rep", "n", "embedding", "sigs")
    found = put.repartition(p, *at).sortWithinPartitions(*at).mapInArrow(lambda b: _links(b, threshold), "rep long, links long, root long")
    found = stash(found, "links")
    drop_stash(signed, close)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.where("rep <> root").select("rep", "root")
    parts = connected_components(edges, "rep", "root").withColumnsRenamed({"node": "rep"})
    known = classes.join(links, "rep", "left").join(parts, "rep", "left")
    known = known.select("embedding", F.col("rep").alias("_rep"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.coalesce("component", "rep").alias("_part"))
    out = rows.join(known, "embedding", "left")
    part = F.when(F.col("vec_id").isNotNull(), F.coalesce("_part", "vec_id"))
    return out.select(
        "vec_id", F.when(F.col("vec_id").isNull() | F.col("_links").isNull(), 0).otherwise(F.col("_links")).cast("long").alias("n_links"), part.alias("component_id"), F.col("vec_id").eqNullSafe(part).alias("kept")
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
