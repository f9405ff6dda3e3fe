"""Spelling variants: words one edit apart, found by generating whole neighbourhoods.

Each word of the vocabulary makes every distinct string that one deletion, replacement or
insertion over the observed alphabet makes of it. Those that are found in a hash table of
the vocabulary are its near words: nothing has to be verified, no two words are compared.

A neighbourhood is hundreds of strings a word, so strings are made where they are looked
up. An edit leaves the first letters of a word as they are, or the last ones: words are
dealt by their first letters and once more by their last ones, and each string is made in
the one place that also has it if it is a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stash, partitions, ship, stash, table

RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
EVERY = 199
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Letters at an end that words are dealt by, at most; fewer if there are shorter words.
SHARED = 3
#: Words that share them and make their strings in one task; more are split by a hash.
WORDS = 20_000


def _without(word: Column, at: Column) -> Column:
    """``word`` without its code point ``at``, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def runs(docs: DataFrame) -> DataFrame:
    """word, a row per occurrence: the lower-cased runs of letters of each whole text. Where
    199 divides the CRC-32 of ``<doc_id>:<run>``, the run loses one code point. A null text
    has no run; a null doc_id counts as an empty one."""
    found = F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"({RUN})"), F.lit(1)))
    d = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), found.alias("run"))
    d = d.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    cut = _without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))
    return d.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the ``word`` rows that are long and frequent enough. Counts are combined
    before they are shuffled, so frequent words cost no more than others."""
    d = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return d.where(F.col("n") >= min_count)


def alphabet(vocab: DataFrame) -> DataFrame:
    """One row, ``letters``: the distinct code points of all words, in order."""
    each = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", i, F.lit(1)))
    letters = vocab.where("word <> ''").select(F.explode(F.array_distinct(each)).alias("c")).distinct()
    return letters.agg(F.sort_array(F.collect_list("c")).alias("letters"))


def neighbourhood(word: str, letters: list[str], low: int, high: int) -> Iterator[str]:
    """Every distinct string one edit away from ``word``, over ``letters``, whose edit is at
    a place from ``low`` to before ``high``. Where several edits give the same string, as
    in a run of equal letters, the last one counts."""
    n = len(word)
    for i in range(low, min(high, n + 1)):
        head, here, rest = word[:i], word[i : i + 1], word[i + 1 :]
        if i < n:
            if word[i + 1 : i + 2] != here:
                yield head + rest
            for c in letters:
                if c != here:
                    yield head + c + rest
                    yield head + c + here + rest
        else:
            for c in letters:
                yield head + c


def _dealt(vocab: DataFrame, shared: int, size: int) -> DataFrame:
    """side, key, part, word, n, own: the words of each place. Side 0 is by first letters, 1
    by last ones, 2 has the words of one letter. Where more than ``size`` words meet, each
    part has them all to look up, and makes the strings of its ``own``."""
    at = lambda side, key: F.struct(F.lit(side).alias("side"), key.alias("key"))
    places = F.array(at(0, F.substring("word", 1, shared)), at(1, F.substring("word", -shared, shared)))
    single = F.array_append(places, at(2, F.lit("")))
    d = vocab.select("word", "n", F.explode(F.when(F.length("word") == 1, single).otherwise(places)).alias("at")).select("at.*", "word", "n")
    parts = d.groupBy("side", "key").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    d = d.join(parts, ["side", "key"])
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    return d.select("*", part).withColumn("own", F.pmod(F.xxhash64("word"), "parts") == F.col("part"))


def near_words(vocab: DataFrame, shared: int = SHARED, size: int = WORDS) -> DataFrame:
    """word, n_near, near, near_n: the number of words of ``vocab`` (word, n) that are one edit
    away from ``word``, and the most frequent of them, of equal ones the first by code
    point. Words without any have no row; the empty word is none.

    ``vocab`` should be stored: it is read several times. The alphabet comes to the
    driver; the pattern of runs bounds it to 90 letters, and other vocabularies have at
    most all of Unicode.
    """
    spark = vocab.sparkSession
    ship(spark)
    vocab = vocab.where("word <> ''")
    letters = alphabet(vocab).first()["letters"]
    shortest = vocab.agg(F.min(F.length("word"))).first()[0] or 0
    shared = max(1, min(shared, shortest // 2))
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])

    def found(side: int, known: dict[str, int], own: list[str]) -> pa.RecordBatch:
        out = []
        low, high = ((shared, 1 << 40), (0, shared), (0, 1))[side]
        for word in own:
            hits = [x for x in neighbourhood(word, letters, low, high) if x in known]
            if side and len(word) == 1:  # the other strings are made by the other sides
                hits = [x for x in hits if (len(x) == 1) == (side == 2)]
            if hits:
                best = min(hits, key=lambda x: (-known[x], x))
                out.append((word, len(hits), best, known[best]))
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * 4, schema, strict=True)], schema=schema)

    def rows(batches):
        place, known, own = None, {}, []
        for b in batches:
            for side, key, part, word, n, is_own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (side, key, part) != place:
                    if own:
                        yield found(place[0], known, own)
                    place, known, own = (side, key, part), {}, []
                known[word] = n
                if is_own:
                    own.append(word)
        if own:
            yield found(place[0], known, own)

    d = _dealt(vocab, shared, size).select("side", "key", "part", "word", "n", "own")
    place = ["side", "key", "part"]
    d = d.repartition(partitions(spark) * 4, *place).sortWithinPartitions(*place)
    d = d.mapInArrow(rows, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best")
    d = d.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return d.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.n")).alias("near_n"))


def variants(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n. The form is the most frequent near word, of equal
    ones the first by code point, if it is ``ratio`` times as frequent as the word. The
    root is where forms lead in the end.

    Frequencies grow by ``ratio`` along forms, so no path is longer than their
    logarithm, and each round doubles the steps that roots have followed. Words are
    unique in ``vocab``; an empty one gives no rows.
    """
    d = vocab.join(near_words(vocab), "word", "left")
    leads = F.col("near_n") >= ratio * F.col("n")
    d = d.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("near")).alias("form"), F.when(leads, F.col("near_n")).alias("form_n"))
    d = stash(d, "forms")
    at = d.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stash(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        more = moved.where("moved").limit(1).count()
        if hasattr(at, "_tidemark_path"):
            drop_stash(at)
        at = moved
        if not more:
            break
    out = d.join(at.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words' number, forms and roots. Rows with
    one doc_id, or none, count each; other columns are ignored; no documents, no rows."""
    vocab = stash(vocabulary(runs(table(spark, sf_dir, "documents", "doc_id", "text"))), "words")
    return variants(vocab)
