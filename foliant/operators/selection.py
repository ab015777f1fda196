"""Picking rectangles: top-k, suppression, diversity, samples and pools, inside one group's array or by windows.

Groups are the candidates of one question on one page, a pool whose size the generators bound. Candidates are structs, never null, so
sort_array() orders them as array_sort() would, but without a lambda per comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import let


def top_k(df: DataFrame, by: list[str], score: str, position: str, k: int, rank: str = "rank") -> DataFrame:
    """The k best rows of each group, ties to the smaller position."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), position)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def candidates(df: DataFrame, by: list[str], position: str = "idx", score: str = "score") -> DataFrame:
    """One row per group: its candidates as structs (idx, x, y, w, h, score) in pool order."""
    item = F.struct(F.col(position).alias("idx"), "x", "y", "w", "h", F.col(score).alias("score"))
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("c"))


def best_first(c: Column) -> Column:
    """Candidates by falling score, ties in pool order."""
    return F.transform(F.sort_array(F.transform(c, lambda x: F.struct((-x["score"]).alias("s"), x["idx"].alias("i"), x.alias("x")))), lambda t: t["x"])


def suppress(c: Column, threshold: float, k: int | None = None) -> Column:
    """Greedy suppression: candidates best first, each kept unless it overlaps a kept one at threshold or more; k of None or 0 keeps all."""
    none = F.filter(c, lambda x: F.lit(False))
    full = lambda acc: F.size(acc) >= k if k else F.lit(False)  # noqa: E731  those behind the first k cannot change them
    return F.aggregate(best_first(c), none, lambda acc, x: F.when(full(acc) | F.exists(acc, lambda y: G.iou(y, x) >= threshold), acc).otherwise(F.concat(acc, F.array(x))))


def diverse(c: Column, k: int, weight: float = 0.75) -> Column:
    """k candidates by weight * relative score - (1 - weight) * largest overlap with those already picked.

    Scores are divided by the largest one (all count 0 if that is not positive); the first in pool order wins ties. A pool
    of k or fewer comes back whole, in pool order.
    """
    top = F.array_max(F.transform(c, lambda x: x["score"]))
    rated = lambda t: F.transform(c, lambda x: F.struct(F.when(t > 0, x["score"] / t).otherwise(0.0).alias("rel"), F.lit(0.0).alias("worst"), x.alias("x")))
    start = let(top, lambda t: F.struct(rated(t).alias("left"), F.filter(c, lambda x: F.lit(False)).alias("out")))

    def step(acc: Column, _: Column) -> Column:
        """Each candidate left carries its largest overlap with the picks so far, so a pick adds one comparison per candidate."""
        best = F.array_min(F.transform(acc["left"], lambda y: F.struct((-(weight * y["rel"] - (1 - weight) * y["worst"])).alias("s"), y["x"]["idx"].alias("i"), y["x"].alias("x"))))["x"]

        def taken(b: Column) -> Column:
            others = F.filter(acc["left"], lambda y: y["x"]["idx"] != b["idx"])
            left = F.transform(others, lambda y: F.struct(y["rel"].alias("rel"), F.greatest(y["worst"], G.iou(b, y["x"])).alias("worst"), y["x"].alias("x")))
            return F.struct(left.alias("left"), F.concat(acc["out"], F.array(b)).alias("out"))

        return let(best, taken)

    return F.when(F.size(c) <= k, c).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step, lambda acc: acc["out"]))


def uniform(df: DataFrame, by: list[str], position: str, k: int) -> DataFrame:
    """Every n/k-th row of a group by position, at floor(i * n / k); all if there are no more than k."""
    w = Window.partitionBy(*by)
    x = df.withColumn("_at", F.row_number().over(w.orderBy(position)) - 1).withColumn("_n", F.count("*").over(w))
    taken = F.exists(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * F.col("_n") / k) == F.col("_at"))
    return x.where((F.col("_n") <= k) | taken).drop("_at", "_n")


def hash_order(*keys: Column, seed: int = 42) -> Column:
    """A random-looking order that every engine can repeat: an MD5 of the seed and the keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_sample(df: DataFrame, by: list[str], keys: list[str], k: int, seed: int = 42) -> DataFrame:
    """k rows of each group in hash order."""
    w = Window.partitionBy(*by).orderBy(hash_order(*[F.col(c) for c in keys], seed=seed), *keys)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def union_pool(df: DataFrame, by: list[str], position: str, limits: dict[str, int]) -> DataFrame:
    """Ordered union of the best rows by several scores, each row at its first place; adds place (from 1)."""
    lists = []
    for n, (score, k) in enumerate(limits.items()):
        lists.append(top_k(df, by, score, position, k, "_r").select(*by, position, F.lit(n).alias("_n"), "_r"))
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    first = every.groupBy(*by, position).agg(F.min(F.struct("_n", "_r")).alias("_at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_at", position))).drop("_at")


def pair(q: Column, e: Column, overlap: float = 0.35) -> Column:
    """Best pair of two ranked arrays of candidates with score: .40 larger + .50 sum/2 + .10 (1 - IoU), little overlap; null if none."""
    rate = lambda a, b: F.struct((-(0.4 * F.greatest(a["score"], b["score"]) + 0.5 * (a["score"] + b["score"]) + 0.1 * (1 - G.iou(a, b)))).alias("s"), a["idx"].alias("first"), b["idx"].alias("second"))
    with_each = lambda a, e: F.transform(F.filter(e, lambda b: (b["idx"] != a["idx"]) & (G.iou(a, b) < overlap)), lambda b: rate(a, b))
    return let(e, lambda e: F.array_min(F.flatten(F.transform(q, lambda a: with_each(a, e)))))


def anchored(c: Column, k: int, overlap: float = 0.35) -> Column:
    """The candidate with the largest anchor score, then by score those that overlap it little; if too few, any by score.

    Candidates need an anchor field besides score; ties go to the smaller idx. Overlap is measured to the first pick only.
    """
    first = F.sort_array(F.transform(c, lambda x: F.struct((-x["anchor"]).alias("s"), x["idx"].alias("i"), x.alias("x"))))[0]["x"]
    rated = lambda f: F.transform(F.filter(c, lambda x: x["idx"] != f["idx"]), lambda x: F.struct((G.iou(x, f) >= overlap).alias("near"), (-x["score"]).alias("s"), x["idx"].alias("i"), x.alias("x")))
    return let(first, lambda f: F.slice(F.concat(F.array(f), F.transform(F.sort_array(rated(f)), lambda t: t["x"])), 1, k))


def safe_expanded(c: Column, picked: Column, overlap: float = 0.35, margin: float = 0.08, shortlist: int = 8) -> Column:
    """Two picks whose second gives way to the shortlisted candidate of largest proxy, if that beats it by margin.

    Candidates and picks need a proxy field; the shortlist is the best by score.
    """

    def second(v: Column) -> Column:
        a, b = v["p"][0], v["p"][1]
        able = F.filter(v["c"], lambda x: (x["idx"] != a["idx"]) & (x["idx"] != b["idx"]) & (G.iou(x, a) < overlap))
        best = F.try_element_at(F.sort_array(F.transform(able, lambda x: F.struct((-x["proxy"]).alias("s"), (-x["score"]).alias("t"), x["idx"].alias("i"), x.alias("x")))), F.lit(1))["x"]
        return let(best, lambda y: F.when(y.isNotNull() & (y["proxy"] > b["proxy"]) & (y["proxy"] >= b["proxy"] + margin), F.array(a, y)).otherwise(F.array(a, b)))

    return F.when(F.size(picked) < 2, picked).otherwise(let(F.struct(picked.alias("p"), F.slice(best_first(c), 1, shortlist).alias("c")), second))


def oracle_top(df: DataFrame, by: list[str], confidence: str, positive: str, position: str, k: int) -> DataFrame:
    """The k rows of each group with the strongest labels: the upper bound of any selector."""
    w = Window.partitionBy(*by).orderBy(F.col(confidence).desc(), F.col(positive).desc(), position)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reading_order(c: Column) -> Column:
    """Rectangles top to bottom, then left to right."""
    return F.transform(F.sort_array(F.transform(c, lambda x: F.struct(x["y"].alias("y"), x["x"].alias("x0"), x.alias("r")))), lambda t: t["r"])


def edge_strip(df: DataFrame, by: list[str], position: str, k: int, rim: int = 5) -> DataFrame:
    """The first k rows of each group within rim pixels of the left or upper edge; a group with fewer is sampled evenly instead."""
    w = Window.partitionBy(*by)
    edge = (F.col("x") <= rim) | (F.col("y") <= rim)
    x = df.withColumn("_edges", F.count_if(edge).over(w))
    near = x.where((F.col("_edges") >= k) & edge).withColumn("_r", F.row_number().over(w.orderBy(position))).where(F.col("_r") <= k).drop("_r")
    return near.unionByName(uniform(x.where(F.col("_edges") < k), by, position, k)).drop("_edges")


#: How the legacy patch pipeline picks, by mode: a selector's name and the score that it needs.
MODES = {"ocr_guided": ("nms", "patch_score"), "question_aware": ("nms", "q_score"), "random": ("random", ""), "uniform": ("uniform", ""), "overview_only": ("none", "")}


def overview_and_patches(pool: DataFrame, pages: DataFrame, mode: str, k: int, overview_pixels: int = 50_000, has_question: bool = True) -> DataFrame:
    """(image_id, n_patches, overview_w, overview_h, overview_pixels, patch_pixels, total_pixels) of k patches of pool (image_id, idx, x,
    y, w, h, patch_score, q_score) picked by a mode, beside an overview of pages (image_id, w, h) of about overview_pixels."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}, not one of {', '.join(MODES)}")
    if mode == "question_aware" and not has_question:
        raise ValueError("question_aware needs a question")
    how, column = MODES[mode]
    if how == "nms":
        kept = candidates(pool, ["image_id"], "idx", column).select("image_id", F.explode_outer(suppress(F.col("c"), 0.5, k)).alias("p")).where("p is not null").select("image_id", "p.idx", "p.w", "p.h")
    elif how == "none":
        kept = pool.limit(0).select("image_id", "idx", "w", "h")
    else:
        kept = (uniform(pool, ["image_id"], "idx", k) if how == "uniform" else hash_sample(pool, ["image_id"], ["image_id", "idx"], k)).select("image_id", "idx", "w", "h")
    n = kept.groupBy("image_id").agg(F.count("*").alias("n_patches"), F.sum(F.col("w") * F.col("h")).cast("long").alias("patch_pixels"))
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(float(overview_pixels)) / (F.col("w") * F.col("h"))))
    side = lambda c: F.greatest(F.lit(1), (F.col(c) * scale).cast("int"))
    x = pages.select("image_id", side("w").alias("overview_w"), side("h").alias("overview_h")).join(n, "image_id", "left").na.fill(0, ["n_patches", "patch_pixels"])
    x = x.withColumn("overview_pixels", (F.col("overview_w") * F.col("overview_h")).cast("long"))
    return x.select("image_id", "n_patches", "overview_w", "overview_h", "overview_pixels", "patch_pixels", (F.col("overview_pixels") + F.col("patch_pixels")).alias("total_pixels"))
