"""A corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, drop_stash, stash, table, with_row
from tidemark.llm.langid import identify_documents, train
from tidemark.llm.lines import dedup_lines
from tidemark.llm.mixing import mix, word_count
from tidemark.llm.ngram_join import ngram_components
from tidemark.llm.packing import default_tokenizer, pack

# Decisions are made row by row: rows that share a doc_id, or have none, are documents of
# their own. Columns of documents pass inside a struct, whatever their names; decisions
# grow with the documents, so they are never broadcast.


def _held(docs: DataFrame, *used: str) -> DataFrame:
    """doc (all columns of ``docs``), and the columns that a stage uses."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *used)


def _freed(d: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` from doc, some of them new."""
    return d.select(*[(new[c] if c in new else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is identified; lang becomes that language. Texts
    without letters go, and those of which no language is likely. If no row is labelled,
    no document can be judged and all stay."""
    own = with_row(_held(docs, "doc_id", "text", "lang", "source"))
    model = train(spark, own.select(F.col("doc_id").alias("id"), "text", "lang"))
    if not model.languages:
        return docs
    found = stash(identify_documents(own, model, ROW).select(*ROW, "language", "accepted"), "languages")
    found = found.where("accepted").hint("merge")
    return _freed(own.join(found, list(ROW)), docs, lang=F.col("language"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat or nearly repeat an earlier one, in the
    order of doc_id, rows without one last, and of files."""
    return dedup_lines(docs, short=True)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest doc_id (a null
    one is the largest), and then the first by file."""
    own = with_row(_held(docs, "doc_id", "text"))
    groups = stash(ngram_components(own.select("doc_id", "text", *ROW), ROW, node=True), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW))
    kept = stash(groups.groupBy("component").agg(first.alias("x")).select(*[F.col(f"x.{c}") for c in ROW]), "kept")
    drop_stash(groups)
    return _freed(own.join(kept.hint("merge"), list(ROW), "left_semi"), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. The draw depends on doc_id and text
    only, so rows equal in both are taken equally often."""
    key = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.xxhash64(F.col("text").isNull(), "text").alias("hash")]
    own = _held(docs, "doc_id", "text", "source").select("doc", "source", "text", F.struct(*key).alias("key"))
    sizes = stash(own.select("key", "source", word_count(F.col("text")).alias("size")), "sizes")
    mixed = mix(sizes).groupBy("key").agg(F.max("copies").cast("int").alias("copies"))
    copies = stash(mixed.where("copies > 0"), "copies")
    drop_stash(sizes)
    d = own.join(copies.hint("merge"), "key").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return _freed(d, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return pack(docs.select("doc_id", "text"), default_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage has read is deleted once it has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stash(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_stash(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenization has no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None
