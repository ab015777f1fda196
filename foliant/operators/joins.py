"""Joins by containment, pairing and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _bound(x: Column, f) -> Column:
    """f(x) with x evaluated once per row, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _char_grams(hay: Column, sizes: list[int]) -> Column:
    grams = lambda cs, n: F.transform(F.sequence(F.lit(1), F.size(cs) - n + 1), lambda i: F.array_join(F.slice(cs, i, F.lit(n)), ""))
    return _bound(F.split(hay, ""), lambda cs: F.array_distinct(F.flatten(F.array(*[F.when(F.size(cs) >= n, grams(cs, n)).otherwise(F.array().cast("array<string>")) for n in sizes]))))


def containment(docs: DataFrame, needles: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, item_id) of needles (item_id, needle) whose normalised text is in a document's (doc_id, text), punctuation kept.

    Equi-joins instead of a nested loop: a needle's inner words must stand in the document as whole words (its first and
    last word may be cut there), so each needle sends one shingle of up to `words` of them and documents send their shingles of
    the sizes that some needle asks for. Needles of two words or fewer have no inner word; they meet by their first
    three characters (fewer, if they have no more). Matches of either join are checked on the whole texts.
    """
    n = needles.select("item_id", T.normalize_match(F.col("needle")).alias("needle")).where("needle <> ''").withColumn("ws", F.split("needle", " "))
    d = docs.select("doc_id", T.normalize_match(F.col("text")).alias("hay"))
    inner = F.least(F.size("ws") - 2, F.lit(words))
    n = n.withColumn("inner", inner).withColumn("key", F.when(F.col("inner") >= 1, F.array_join(F.slice("ws", F.lit(2), F.col("inner")), " ")).otherwise(F.substring("needle", 1, 3))).drop("ws")
    kinds = {(r["inner"] >= 1, r["inner"] if r["inner"] >= 1 else r["size"]) for r in n.select("inner", F.length("key").alias("size")).distinct().collect()}  # a few numbers
    by_words, by_chars = sorted({k for whole, k in kinds if whole}), sorted({k for whole, k in kinds if not whole})
    none = F.array().cast("array<string>")
    shingles = lambda ws, k: F.when(F.size(ws) >= k, F.transform(F.sequence(F.lit(1), F.size(ws) - k + 1), lambda i: F.array_join(F.slice(ws, i, F.lit(k)), " "))).otherwise(none)
    parts = []
    for whole, keys in ((True, _bound(F.split("hay", " "), lambda ws: F.array_distinct(F.flatten(F.array(*[shingles(ws, k) for k in by_words])))) if by_words else None), (False, _char_grams(F.col("hay"), by_chars) if by_chars else None)):
        if keys is not None:
            own = n.where(F.col("inner") >= 1 if whole else F.col("inner") < 1).select("key", "item_id")
            # only keys that some needle asks for leave the document's row: the probe side stays narrow
            parts.append(d.select("doc_id", F.explode(keys).alias("key")).join(own.select("key").distinct(), "key", "left_semi").join(own, "key").select("doc_id", "item_id").distinct())
    if not parts:
        return d.select("doc_id").join(n.select("item_id").limit(0)).limit(0)
    hits = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return hits.join(d, "doc_id").join(n.select("item_id", "needle"), "item_id").where(F.contains("hay", F.col("needle"))).select("doc_id", "item_id")


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value of both sides and their difference, for the keys that both have; repeated keys multiply."""
    x = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys)
    return x.withColumn("diff", F.col("a") - F.col("b"))


def first_filled(*columns: str) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns])


def unfinished(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """items whose key is not among the completed ones."""
    return items.join(done.select(key).distinct(), key, "left_anti")
