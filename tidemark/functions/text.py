"""Tokenizers and the item document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import ITEM_TEXT_COLUMNS


def bm25_tokens(text: Column) -> Column:
    """Lower-case, cut at Unicode white space; punctuation and repeats stay."""
    return F.filter(F.split(F.lower(text), r"(?U)[\s\x1c-\x1f]+"), lambda x: x != "")


def tfidf_terms(text: Column) -> Column:
    """Lower-case words of two or more word characters, and the pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))

    def with_pairs(w: Column) -> Column:
        n = F.size(w)
        pairs = F.transform(F.arrays_zip(F.slice(w, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(w, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b")), lambda p: F.concat_ws(" ", p["a"], p["b"]))
        return F.concat(w, pairs)

    return F.transform(F.array(words), with_pairs)[0]


def item_text(meta: DataFrame) -> DataFrame:
    """item_id, text: the text columns joined by spaces. A missing value is left out; a
    column that the table lacks adds an empty string."""
    parts = [F.col(c).cast("string") if c in meta.columns else F.lit("") for c in ITEM_TEXT_COLUMNS]
    return meta.select("item_id", F.concat_ws(" ", *parts).alias("text"))
