"""Helpers that the corpus operators share: session, scratch tables, code shipping."""

from __future__ import annotations

import atexit
import gc
import io
import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a Java character class.
WORD = r"[^\x20\x09-\x0D]+"
_SHIPPED: set[str] = set()
_SCRATCH: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python
    workers can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="tidemark-ship-")) / f"{root.name}_{uuid.uuid4().hex[:8]}.zip"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    to.write_bytes(buffer.getvalue())
    sc.addPyFile(str(to))
    _SHIPPED.add(sc.applicationId)


def scratch(spark: SparkSession) -> str:
    """A folder of this application inside the shared folder that
    ``spark.checkpoint.dir`` names; a temporary one only where that is unset and the
    master is local."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="tidemark-scratch-")
        _SCRATCH[app] = f"{base.rstrip('/')}/tidemark-{app}-{uuid.uuid4().hex[:6]}"
        atexit.register(_remove, spark, _SCRATCH[app])
    return _SCRATCH[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; only scratch files stay behind
        pass


def stash(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared scratch folder and
    read it back. Lost executors don't lose what is written."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def drop_stash(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stash` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_tidemark_path", None):
            _remove(df.sparkSession, path)
    free_shuffles(tables[0].sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver's JVM collect its garbage, on which Spark deletes the shuffle files
    of what is over. One collection only frees what holds them; the next one finds them."""
    for pause in (0.2, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


_ROWWISE = {"Project", "Filter", "SubqueryAlias"}
#: The columns of :func:`with_row`.
ROW = ("_file", "_at")


def with_row(df: DataFrame) -> DataFrame:
    """``df`` with two longs, ROW, that tell rows apart, even equal ones, and are the same
    whenever ``df`` is computed: a hash of the path and the row's place in its Parquet
    file where ``df`` reads one row by row, else a number that is written with the row."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in _ROWWISE:
        plan = plan.children().head()
    try:
        if plan.children().isEmpty() and " parquet" in plan.toString():
            at = df.metadataColumn("_metadata")
            return df.withColumns({ROW[0]: F.xxhash64(at["file_path"]), ROW[1]: at["row_index"]})
    except AnalysisException:
        pass  # not a file after all
    return stash(df.withColumns({ROW[0]: F.lit(0).cast("long"), ROW[1]: F.monotonically_increasing_id()}), "numbered")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text; of null, no bytes."""
    return F.coalesce(text, F.lit("")).cast("binary")


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{os.fspath(sf_dir).rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def numbered(df: DataFrame, key: list[str], order: list[str], out: str, rows_hint: int = 20_000) -> DataFrame:
    """Gapless numbers from 0 within ``key`` for groups of any size: rows are dealt
    by a hash of ``order`` into buckets, numbered within each, and shifted by the
    counts of the buckets before. Only those counts pass through one window."""
    n = partitions(df.sparkSession) * 4
    d = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    from pyspark.sql import Window as W

    counts = d.groupBy(*key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = W.partitionBy(*key, "_b").orderBy(*order)
    d = d.withColumn("_r", F.row_number().over(inner) - 1)
    d = d.join(counts, [*key, "_b"])
    return d.withColumn(out, (F.col("_o") + F.col("_r")).cast("long")).drop("_b", "_o", "_r")
