"""Line dedup: an exact set-similarity join of lines, later matches removed.

A line's tokens are its distinct word 5-grams, lower-cased, by 48-bit hashes of theirs;
where short lines count, the whole sequence of one to four words is a line's only token.
Tokens are ordered from rare to frequent by counters of all lines that have them. The
number of counters grows with the tokens, up to a bound; tokens share a counter, so
rarity is approximate, and any one order gives exact results. Two lines with a Jaccard
similarity of 0.75 or more must share a token among the rarest quarter of each (prefix
filter), at places that leave room for the overlap they need (positional filter), and
be of similar size (length filter). Pairs that pass are verified on their whole sets.

Lines of equal texts are collapsed before they get tokens. The sets of the others are
written once and read again for verification. A line is compared with the first and
the preceding line under each of its prefix tokens; most matches are found so, and
only lines that are not meet all others under their tokens. Tokens that stand out as
frequent are split by line for that. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW, drop_stash, free_shuffles, stash, table, with_row

WORDS = 5
PERCENT = 75
#: Least and most counters of tokens, eight bytes each in every task.
COUNTERS = 1 << 16, 1 << 20
#: Tokens for each counter, while there are fewer than the most.
LOAD = 1 << 14
#: Least and most bits of the map that marks lines whose sets are needed, in every task.
MARKS = 63 << 12, 63 << 19
#: Bits of a token's hash; what is shuffled to find lines drops the last eight.
BITS = 48
#: Parquet that keeps hashes in BITS, not in 64.
PACKED = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#grams.list.element": "false"}
#: Lines under a token that one task compares with their neighbours.
HOT = 1 << 16
_ODD = "\t\x0b\x0c\r"
_LAST = (1 << 63) - 1


def _let(value: Column, f) -> Column:
    """f(value), where value is computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _words(line: str) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _grams(words: Column) -> Column:
    """The distinct hashes of the word 5-grams; of one to four words that of their sequence."""

    def fives(h: Column) -> Column:
        five = F.transform(F.slice(h, F.lit(1), F.size(h) - WORDS + 1), lambda x, i: hashed(x, *[h[i + k] for k in range(1, WORDS)]))
        return F.when(F.size(h) >= WORDS, five).otherwise(F.array(hashed(h)))

    def hashed(*cols: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*cols), 64 - BITS)

    return F.array_distinct(_let(F.transform(words, lambda w: F.xxhash64(w)), fives))


def _lines(docs: DataFrame, key: list[str]) -> DataFrame:
    """key, line_no, line; all white space in a line as spaces."""
    odd = F.lit(False)
    for c in _ODD:
        odd = odd | F.contains("text", F.lit(c))
    text = F.when(odd, F.regexp_replace("text", f"[{_ODD}]", " ")).otherwise(F.col("text"))
    return docs.select(*key, F.posexplode_outer(F.split(text, "\n")).alias("line_no", "line"))  # outer: without it Spark splits twice, to drop empty arrays


def _level(n: Column) -> Column:
    """Four times the binary logarithm, from 1."""
    return F.least(F.lit(127), 1 + F.floor(4 * F.log2(n))).cast("tinyint")


def rarity(grams: DataFrame) -> tuple[DataFrame, int, int]:
    """(one row with an array: per counter, the level of the lines it has counted, above
    the bits of a token; the number of counters; the level from which a token stands
    out). ``grams`` has each text once, with the number of its ``copies``."""
    n = grams.agg(F.sum(F.size("grams") * F.col("copies"))).first()[0] or 1
    counters = min(COUNTERS[1], max(COUNTERS[0], 1 << (n // LOAD).bit_length()))
    counts = grams.select("copies", F.explode("grams").alias("g")).groupBy(F.col("g").bitwiseAND(F.lit(counters - 1)).cast("int").alias("b")).agg(F.sum("copies").alias("n"))
    counts = counts.select("b", _level(F.col("n")).alias("x")).unionByName(grams.sparkSession.range(counters).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("tinyint").alias("x")))
    levels = counts.groupBy("b").agg(F.max("x").alias("x")).agg(F.sort_array(F.collect_list(F.struct("b", F.shiftleft(F.col("x").cast("long"), BITS - 8).alias("x"))))["x"].alias("levels"))  # a row per counter
    hot = max(HOT, 4 * n // counters)
    return stash(levels, "rarity"), counters, 1 + 4 * (hot.bit_length() - 1)


def _need(a: Column, b: Column) -> Column:
    """The overlap that sets of these sizes need."""
    return F.ceil(F.lit(PERCENT) * (a + b) / (100 + PERCENT))


def _similar_size(a: Column, b: Column) -> Column:
    return (100 * F.least(a, b)) >= (PERCENT * F.greatest(a, b))


def _first(key: list[str], a: str, b: str) -> Column:
    """Whether the line (key with prefix a) stands before (key with prefix b)."""
    out = F.lit(False)
    for c in reversed(key):
        out = (F.col(a + c) < F.col(b + c)) | ((F.col(a + c) == F.col(b + c)) & out)
    return out


def _marked(wanted: DataFrame, at: list[str]) -> tuple[DataFrame, Column]:
    """(a row with a bit map of the hashes of ``wanted``; whether a row may be wanted)."""
    n = wanted.agg(F.approx_count_distinct(F.xxhash64(*at))).first()[0]
    bits = min(MARKS[1], max(MARKS[0], 63 * (1 << (n // 8).bit_length())))
    where = F.pmod(F.xxhash64(*at), F.lit(bits))
    shift = lambda: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(*at), F.lit(63)).cast("int"))
    words = wanted.select(F.floor(where / 63).cast("int").alias("word"), shift().alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    words = words.unionByName(wanted.sparkSession.range(bits // 63).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits")))
    words = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).agg(F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].alias("map"))
    marks = stash(words, "marks")
    return marks, marks.scalar()[F.floor(where / 63).cast("int")].bitwiseAND(shift()) != 0


def line_matches(docs: DataFrame, short: bool = False, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(key, line_no) of every line with an earlier match, in the order of the columns
    ``key`` and line_no; removed lines count as matches too.

    Lines of one to four words are left alone or, if ``short``, match those of the same
    words; blank lines never match. Null and empty texts have no lines to remove; rows
    with the same key are one document, those with a null in it are left alone; other
    columns are ignored.
    """
    key = list(key)
    at = [*key, "line_no"]
    docs = docs.select(*key, "text").where(" and ".join(f"`{c}` is not null" for c in [*key, "text"]))
    text = _lines(docs, key).withColumn("line", F.lower("line"))
    text = text.where(F.trim("line") != "" if short else F.size(_words("line")) >= WORDS).withColumn("k", F.xxhash64("line"))
    same = W.partitionBy("k", "line").orderBy(*at)
    every = same.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    text = text.withColumns({"copies": F.count(F.lit(1)).over(every), "nth": F.row_number().over(same)})
    grams = text.select(*at, "copies", F.when(F.col("nth") == 1, _grams(_words("line"))).alias("grams"))  # of lines with one text, only the first
    grams = grams.select(*at, "copies", F.when(F.col("grams").isNotNull(), F.size("grams")).alias("n"), "grams")
    grams = stash(grams, "grams", **PACKED)
    free_shuffles(docs.sparkSession)
    lines = grams.where("n is not null")
    levels, counters, hot = rarity(lines)

    def ranked(g: Column) -> Column:
        level = F.col("levels")[g.bitwiseAND(F.lit(counters - 1).cast("long"))]
        return F.coalesce(level.bitwiseOR(F.shiftrightunsigned(g, 8)), F.lit(0).cast("long"))  # never null, which sorts faster

    prefix = F.slice(F.sort_array(F.transform("grams", ranked)), F.lit(1), F.col("n") - F.ceil(F.lit(PERCENT) * F.col("n") / 100).cast("int") + 1)
    posts = lines.withColumn("levels", levels.scalar()).select(*at, "n", prefix.alias("prefix"))
    posts = posts.select(*at, "n", F.posexplode_outer("prefix").alias("pos", "token"))
    over = F.shiftright("token", BITS - 8) - F.lit(hot)
    salt = F.when(over <= 0, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*at), F.pow(F.lit(2.0), F.ceil(over / 4)).cast("long")))
    # few columns, as most of these rows are dropped after the shuffle; a place over 65535 counts as that, which only drops less
    np = F.shiftleft(F.col("n").cast("long"), 16).bitwiseOR(F.least("pos", F.lit(0xFFFF)).cast("long"))
    posts = posts.select(F.shiftleft(salt, BITS).bitwiseOR(F.col("token")).alias("salted"), np.alias("np"), *at[::-1])
    by = W.partitionBy("salted")
    posts = posts.withColumn("many", F.count(F.lit(1)).over(by))
    token = F.col("salted").bitwiseAND(F.lit((1 << BITS) - 1))
    posts = posts.where((F.col("many") > 1) | (F.shiftright(token, BITS - 8) > hot))  # most tokens are a line's own
    posts = posts.select(*at, "salted", token.alias("token"), F.shiftright("np", 16).cast("int").alias("n"), F.col("np").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("pos"))
    order, mine = by.orderBy(*at), F.struct(*at, "n", "pos")
    posts = posts.withColumns({"first": F.first(mine).over(order), "prior": F.lag(mine).over(order)})
    posts = stash(posts.drop("salted"), "postings")
    drop_stash(levels)

    side = lambda p: [F.col(c).alias(p + c) for c in at]

    def verified(pairs: DataFrame) -> DataFrame:
        """The later lines of the pairs that are similar."""
        pairs = stash(pairs, "pairs")
        marks, may = _marked(pairs.select(F.explode(F.array(*[F.struct(*[F.col(p + c).alias(c) for c in at]) for p in ("a_", "b_")])).alias("x")).select("x.*"), at)
        sets = stash(lines.where(may).select(*at, "grams"), "sets", compression="zstd")
        p = pairs.join(sets.select(*side("a_"), F.col("grams").alias("a")), [f"a_{c}" for c in at])
        p = p.join(sets.select(*side("b_"), F.col("grams").alias("b")), [f"b_{c}" for c in at])
        both = F.size(F.array_intersect("a", "b"))
        ok = 100 * both >= PERCENT * (F.size("a") + F.size("b") - both)
        found = stash(p.where(ok).select(*[F.col(f"b_{c}").alias(c) for c in at]).distinct(), "similar")
        drop_stash(pairs, marks, sets)
        return found

    other = F.explode(F.array("first", "prior")).alias("o")
    near = posts.select(*at, "n", "pos", other).where(F.col("o").isNotNull() & (F.struct(*[F.col(f"o.{c}") for c in at]) != F.struct(*at)))
    room = F.least(F.col("n") - F.col("pos"), F.col("o.n") - F.col("o.pos"))
    near = near.where(_similar_size(F.col("n"), F.col("o.n")) & (room >= _need(F.col("n"), F.col("o.n"))))
    settled = verified(near.select(*[F.col(f"o.{c}").alias(f"a_{c}") for c in at], *side("b_")).distinct())
    # the others meet all earlier lines under their tokens
    a = posts.select("token", *side("a_"), F.col("n").alias("an"), F.col("pos").alias("ap"))
    b = posts.join(settled, at, "left_anti").select("token", *side("b_"), F.col("n").alias("bn"), F.col("pos").alias("bp"))
    met = a.join(b, "token").where(_first(at, "a_", "b_") & _similar_size(F.col("an"), F.col("bn")))
    met = met.where(F.least(F.col("an") - F.col("ap"), F.col("bn") - F.col("bp")) >= _need(F.col("an"), F.col("bn")))
    pair = [f"{p}{c}" for p in ("a_", "b_") for c in at]
    met = met.groupBy(*pair, "an", "bn").agg(F.count(F.lit(1)).alias("c"), F.max("ap").alias("ap"), F.max("bp").alias("bp"))
    met = met.where(F.col("c") + F.least(F.col("an") - F.col("ap"), F.col("bn") - F.col("bp")) - 1 >= _need(F.col("an"), F.col("bn")))
    rest = verified(met.select(*pair))
    copies = grams.where("n is null").select(*at)
    found = stash(copies.unionByName(settled).unionByName(rest), "matches")  # disjoint
    drop_stash(grams, posts, settled, rest)
    return found


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns that order its rows and tell them apart: by doc_id,
    rows without one last."""
    return with_row(docs).withColumn("_order", F.coalesce("doc_id", F.lit(_LAST)))


_KEY = ("_order", *ROW)


def _removed(docs: DataFrame, short: bool) -> DataFrame:
    found = line_matches(docs, short, _KEY)
    return found.groupBy(*_KEY).agg(F.sort_array(F.collect_list("line_no")).alias("_gone"))  # at most a document's lines


def dedup_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """``docs`` without the lines of :func:`line_matches`, joined again by line feeds;
    documents that lose all lines go. n_chars, where there, is the new length.

    Every row is a document of its own, also where rows share a doc_id or have none;
    rows without one count as the last. Null and empty texts stay. Columns of any
    names pass.
    """
    own = _keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text"))
    d = own.join(_removed(own, short), list(_KEY), "left")  # an exchange of whole texts by document
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda line, i: ~F.array_contains("_gone", i))
    d = d.where(F.col("_gone").isNull() | (F.size("_gone") < F.size(lines)))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    new = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return d.select(*[new[c].alias(c) if c in new else F.col("doc").getField(c).alias(c) for c in docs.columns])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many go, and their numbers from 0."""
    docs = _keyed(table(spark, sf_dir, "documents", "doc_id", "text"))
    n = docs.select("doc_id", *_KEY, F.coalesce(1 + F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)).cast("long").alias("n_lines"))
    d = n.join(_removed(docs, True), list(_KEY), "left")
    numbers = F.coalesce("_gone", F.array().cast("array<int>"))
    return d.select("doc_id", "n_lines", F.size(numbers).cast("long").alias("n_removed"), F.array_join(numbers.cast("array<string>"), ",").alias("removed_lines"))
