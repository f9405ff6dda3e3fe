"""Language identification by Bayesian evidence fusion.

Four pieces of evidence make the posterior of a page's language: the likelihood of its
text, of the language that its markup declares, of its address's suffix, and a prior of
its host. The text model is trained on a bounded sample of labelled rows; everything
else is counted over all rows by grouped aggregation, with the text's posterior as
weights. A host's prior is smoothed by its domain's, and that by the corpus's; a row's
own weight is left out of its host's and domain's counts.
"""

from __future__ import annotations

import html as markup
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, stash, table

#: Most labelled rows that train the text model.
SAMPLE = 2_000
BUCKETS = 1 << 15
#: Neighbouring trigrams depend on each other: all of a text's are read, and their mean
#: weighs as much as this many at most, so that other evidence still counts.
TRIGRAMS = 60
#: Weight, in rows, of the parent's distribution in a host's or domain's prior.
SMOOTH = 20.0
#: A language is accepted from this posterior on.
ACCEPT = 0.5

_RAW = re.compile(r"<(script|style|noscript|template)\b", re.I)
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template")}
_HTML = re.compile(r"<html\b[^>]*", re.I)
_LANG = re.compile(r"(?<![\w-])lang\s*=\s*[\"']?\s*([A-Za-z]{1,8})", re.I)
_OTHER = re.compile(r"[\W\d_]+")


def visible(page: str) -> str:
    """The page without comments, tags, and elements that aren't shown. One pass: an end
    that is once found missing is not looked for again."""
    out, at, missing = [], 0, set()
    while (i := page.find("<", at)) >= 0:
        out.append(page[at:i])
        end = -1
        if page.startswith("<!--", i) and "--" not in missing:
            end = page.find("-->", i + 4) + 3
            if end == 2:
                missing.add("--")
        elif (m := _RAW.match(page, i)) and (tag := m[1].lower()) not in missing:
            close = _END[tag].search(page, m.end())
            end = close.end() if close else -1
            if not close:
                missing.add(tag)
        if end < 3:
            end = page.find(">", i + 1) + 1
            if not end:
                at = i
                break
        out.append(" ")
        at = end
    return markup.unescape("".join([*out, page[at:]]))


def declared(page: str) -> str | None:
    """The language that the page's first html tag names."""
    tag = _HTML.search(page)
    m = _LANG.search(tag[0]) if tag else None
    return m[1].lower() if m else None


def address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """(host, domain: its last two labels, suffix: its last label)."""
    try:
        host = (urlsplit(url or "").hostname or "").strip(".")
    except ValueError:
        host = ""
    if not host:
        return None, None, None
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1]


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the words, lower-case; none for texts without letters."""
    words = _OTHER.sub(" ", text.lower()).strip()
    if not words:
        return np.empty(0, np.int64)
    b = np.frombuffer(f" {words} ".encode(), np.uint8).astype(np.uint32)
    code = b[:-2] | b[1:-1] << 8 | b[2:] << 16
    return (code * np.uint32(2654435761) >> np.uint32(32 - 15)).astype(np.int64)


class TextModel:
    """Multinomial model of trigrams; ``logp`` is buckets x languages. ``counts``: of each
    language its trigrams by bucket."""

    def __init__(self, counts: dict[str, np.ndarray], alpha: float = 0.05, most: int = TRIGRAMS) -> None:
        self.languages, self.most = sorted(counts), most
        n = np.stack([counts[x] for x in self.languages], axis=1) + alpha if counts else np.ones((BUCKETS, 0))
        self.logp = np.log(n / n.sum(0)).astype(np.float32)

    def score(self, text: str) -> tuple[int, np.ndarray]:
        """(trigrams, log likelihood per language)."""
        at = trigrams(text)
        n = len(at)
        if not n:
            return 0, np.zeros(len(self.languages))
        return n, self.logp[at].sum(0, dtype=np.float64) * (min(n, self.most) / n)


def _counted(batches):
    """(lang, bucket, n) of each batch of (text, lang)."""
    for b in batches:
        found: dict[str, np.ndarray] = {}
        for text, lang in zip(*(b.column(i).to_pylist() for i in (0, 1)), strict=True):
            found.setdefault(lang, np.zeros(BUCKETS, np.int64))
            found[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in found.items():
            at = np.append(np.flatnonzero(n), 0)  # a language without trigrams is one, too
            yield pa.record_batch([pa.array([lang] * len(at)), pa.array(at), pa.array(np.append(n[at[:-1]], 0))], ["lang", "bucket", "n"])


def train(spark: SparkSession, labelled: DataFrame, sample: int = SAMPLE, most: int = TRIGRAMS) -> TextModel:
    """From at most ``sample`` rows (id, text, lang), those with the least hashes of id and
    text. Only counts come to the driver, a number per bucket and language."""
    ship(spark)
    chance = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40))
    rows = labelled.where("text is not null and lang is not null").select("id", "text", F.lower("lang").alias("lang"), chance.alias("h"))
    n = rows.count()
    some = rows.where(F.col("h") < min(1 << 40, (3 * sample << 40) // max(n, 1) + 1))  # some three times the sample
    some = some.orderBy("h", "id", "lang").limit(sample).select("text", "lang")
    found = some.mapInArrow(_counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, np.ndarray] = {}
    lang, bucket, n = (found.column(c) for c in ("lang", "bucket", "n"))
    bucket, n, lang = bucket.to_numpy(), n.to_numpy(), np.array(lang.to_pylist(), object)
    for x in set(lang):
        counts[x] = np.zeros(BUCKETS)
        counts[x][bucket[lang == x]] = n[lang == x]
    return TextModel(counts, most=most)


_FEATURES = "host string, domain string, suffix string, declared string, trigrams long, ll array<double>, p array<double>"
_TYPES = [*[pa.string()] * 4, pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]


def features(rows: DataFrame, model: TextModel, is_page: bool, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """From (key, url, text, declared): pages have markup as text, and declare their
    language there; other rows have the host in url, and the language in declared."""
    ship(rows.sparkSession)
    names = [*key, *(c.split()[0] for c in _FEATURES.split(", "))]

    def scored(batches):
        for b in batches:
            out = []
            for url, text, said in zip(*(b.column(k).to_pylist() for k in ("url", "text", "declared")), strict=True):
                text = text or ""
                if is_page:
                    said, where, text = declared(text), address(url), visible(text)
                else:
                    said, where = said and said.lower(), (url, None, None)
                n, ll = model.score(text)
                p = np.exp(ll - ll.max()) if len(ll) else ll
                out.append((*where, said, n, ll.tolist(), (p / p.sum()).tolist() if len(ll) else []))
            if out:
                yield pa.record_batch([*b.columns[: len(key)], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True))], names)

    rows = rows.select(*key, "url", "text", "declared")
    keys = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in key)
    return rows.mapInArrow(scored, f"{keys}, {_FEATURES}")


def _sums(n: int) -> list[Column]:
    return [F.array(*[F.sum(F.col("p")[i]) for i in range(n)]).alias("w")]


def _totals(features: DataFrame, n: int) -> np.ndarray:
    return np.array(features.agg(F.array(*[F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)) for i in range(n)])).first()[0])


def _given(features: DataFrame, column: str, total: np.ndarray) -> DataFrame:
    """(value, given): log P(value | language) per language, of every value, null too."""
    n = len(total)
    counts = features.groupBy(F.col(column).alias("value")).agg(*_sums(n))
    base = F.aggregate("w", F.lit(0.0), lambda a, x: a + x) / F.lit(float(total.sum() + 1e-9))
    least = F.array(*[F.lit(float(x)) for x in total + SMOOTH + 1e-3])
    given = F.transform(F.arrays_zip(F.col("w").alias("w"), least.alias("t")), lambda x: F.ln((x["w"] + SMOOTH * F.col("base") + 1e-3) / x["t"]))
    return counts.withColumn("base", base).select("value", given.alias("given"))


def identify(features: DataFrame, languages: list[str], key: tuple[str, ...] = ("id",)) -> DataFrame:
    """key, language, probability, text_language, text_probability, accepted for each row.

    Rows without letters have no text evidence: their language is the most likely one
    by the other evidence, and they are not accepted. Null hosts, declarations and
    suffixes are values like others. No rows, no result; repeated rows count each, and
    rows that share a key, or have none, are judged each on their own.
    """
    n = len(languages)
    f = features
    if not n:
        none = F.lit(None).cast("string")
        return f.select(*key, none.alias("language"), F.lit(0.0).alias("probability"), none.alias("text_language"), F.lit(0.0).alias("text_probability"), F.lit(False).alias("accepted"))
    total_ = _totals(f, n)
    corpus = (total_ + 1) / (total_.sum() + n)
    # a host's and its domain's weights; joins meet hosts' rows, and hot hosts are split there
    host = f.where("host is not null").groupBy("host", F.coalesce("domain", "host").alias("domain")).agg(*_sums(n))
    domain = host.groupBy("domain").agg(F.array(*[F.sum(F.col("w")[i]) for i in range(n)]).alias("wd"))
    host = host.join(domain, "domain").select("host", "w", "wd")
    d = f.join(host, "host", "left")
    for column in ("declared", "suffix"):  # every value has its own statistics; hot values are split in the join
        given = _given(f, column, total_).withColumnsRenamed({"value": f"_{column}", "given": f"g_{column}"})
        d = d.join(given, F.col(column).eqNullSafe(F.col(f"_{column}")), "left")
    zero = F.array(*[F.lit(0.0)] * n)
    less = lambda w: F.transform(F.arrays_zip(F.coalesce(w, zero).alias("w"), F.col("p").alias("q")), lambda x: F.greatest(x["w"] - x["q"], F.lit(0.0)))
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    smooth = lambda w, parent: F.transform(F.arrays_zip(F.col(w).alias("w"), parent.alias("q")), lambda x: (x["w"] + SMOOTH * x["q"]) / (total(F.col(w)) + SMOOTH))
    d = d.withColumns({"wd": less(F.col("wd")), "w": less(F.col("w"))})
    d = d.withColumn("wd", smooth("wd", F.array(*[F.lit(float(x)) for x in corpus])))
    d = d.withColumn("prior", smooth("w", F.col("wd")))
    parts = F.arrays_zip(F.col("ll").alias("a"), F.col("g_declared").alias("b"), F.col("g_suffix").alias("c"), F.col("prior").alias("d"))
    d = d.withColumn("s", F.transform(parts, lambda x: x["a"] + x["b"] + x["c"] + F.ln(x["d"])))
    d = d.withColumn("s", F.transform("s", lambda x: F.exp(x - F.array_max("s"))))
    d = d.withColumn("s", F.transform("s", lambda x: x / total(F.col("s"))))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return d.select(
        *key, best("s").alias("language"), F.array_max("s").alias("probability"), best("p").alias("text_language"), F.array_max("p").alias("text_probability"),
        ((F.col("trigrams") > 0) & (F.array_max("s") >= ACCEPT)).alias("accepted"),
    )


def identify_documents(docs: DataFrame, model: TextModel, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The same for documents (key, text, lang, source): lang is what is declared,
    the source stands for the host, and there is no address."""
    rows = docs.select(*key, F.col("source").alias("url"), "text", F.col("lang").alias("declared"))
    return identify(stash(features(rows, model, False, key), "features"), model.languages, key)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; the text model is trained on documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumnRenamed("doc_id", "id")
    model = train(spark, docs)
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    pages = pages.select(F.col("page_id").alias("id"), "url", F.col("html").alias("text"), F.lit(None).cast("string").alias("declared"))
    return identify(stash(features(pages, model, True), "features"), model.languages).withColumnRenamed("id", "page_id")
