"""Gates over aggregated metrics, and results of a selector packed against its baselines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept
from . import metrics as M

#: Score targets, pairs that a transfer gate needs, and how far a drop may go.
TARGET_ANLS, TARGET_EM, LEAST_PAIRS = 0.805, 0.705, 50
DROP_PASS, DROP_PARTIAL = 0.015, 0.03
#: Rules that count as the production selector.
PRODUCTION = ("grounded_shortest",)


def near_target(value: Column, target: float, tolerance: float) -> Column:
    """Baseline gate (G0): a missing value passes."""
    return F.coalesce(F.abs(value - target) <= tolerance, F.lit(True))


def candidates_gate(candidates: Column, area: Column, centres: Column, small: Column, edge: Column, limits: dict[str, float]) -> Column:
    """Pool gate (G1) over a pool's means."""
    within = candidates.between(limits["candidates_min"], limits["candidates_max"])
    return within & (area >= limits["area_min"]) & (centres >= limits["centre_min"]) & (small >= limits["small_min"]) & (edge >= limits["edge_min"])


def headline_k(at_2: Column, at_4: Column, least_2: float = 0.15, least_4: float = 0.30) -> Column:
    """Oracle gate (G2): 2 if the oracle's evidence at two picks suffices, else 4 if that at four does, else null (failed)."""
    return F.when(F.coalesce(at_2, F.lit(0.0)) >= least_2, 2).when(F.coalesce(at_4, F.lit(0.0)) >= least_4, 4)


def heuristic_gate(coverage: DataFrame, method: str, base: str, others: list[str], low: DataFrame) -> DataFrame:
    """Heuristic gate (G3) of coverage (method, strict, any): at least the base on both tiers, above all others, and
    differences to the base, low (tier, mean, low), at least 0 on the mean and -0.02 on the lower end. One row:
    beats_base, beats_others, intervals_ok, passed."""
    pick = lambda m, c: F.coalesce(F.max(F.when(F.col("method") == m, F.col(c))), F.lit(0.0))
    row = coverage.agg(*[pick(m, c).alias(f"{m}_{c}") for m in {method, base, *others} for c in ("strict", "any")])
    own = {c: F.col(f"{method}_{c}") for c in ("strict", "any")}
    beats = (own["strict"] >= F.col(f"{base}_strict")) & (own["any"] >= F.col(f"{base}_any"))
    above = F.lit(True)
    for m in others:
        above = above & (own["strict"] > F.col(f"{m}_strict")) & (own["any"] > F.col(f"{m}_any"))
    ends = low.where("tier in ('strict', 'any')").agg((F.coalesce(F.bool_and((F.col("mean") >= 0) & (F.col("low") >= -0.02)), F.lit(False)) & (F.countDistinct("tier") == 2)).alias("ok"))
    x = row.join(F.broadcast(ends))  # a row each
    return x.select(beats.alias("beats_base"), above.alias("beats_others"), F.col("ok").alias("intervals_ok"), (beats & above & F.col("ok")).alias("passed"))


def learned_gate(strict: Column, any_: Column, base_strict: Column, base_any: Column, means_ok: Column, at_4: Column) -> Column:
    """Learned gate: strictly better on strict, no worse on any, mean differences not negative; or the same at four picks (at_4)."""
    return ((strict > base_strict) & (any_ >= base_any) & means_ok) | F.coalesce(at_4, F.lit(False))


def transfer_gate(pairs: Column, anls_base: Column, em_base: Column, anls_other: Column) -> Column:
    """Reader gate (G5) of mean differences to the base (ANLS, EM) and to a second baseline (ANLS): strong, min or null (failed)."""
    ok = (pairs >= LEAST_PAIRS) & (anls_base >= 0.03) & (em_base >= 0) & (anls_other >= 0)
    return F.when(ok & (anls_base >= 0.04) & (anls_other >= 0.02) & (em_base >= 0.03), "strong").when(ok, "min")


def scale_status(resize: Column, shortest: Column) -> Column:
    """Scale gate (P17) of two significant wins: PASS with both, PARTIAL with exactly one, else FAIL."""
    return F.when(resize & shortest, "PASS").when(resize | shortest, "PARTIAL").otherwise("FAIL")


def transfer_status(resize: Column, shortest: Column) -> Column:
    """Transfer gate (P18): a win over the shortest rule alone does not count."""
    return F.when(resize & shortest, "FULL TRANSFER").when(resize, "PARTIAL TRANSFER").otherwise("FAIL")


def seam_status(resize: Column, original: Column) -> Column:
    """Page-compression gate (P26) of two significant wins: PASS with both, PARTIAL with that over resizing alone, else FAIL."""
    return F.when(resize & original, "PASS").when(resize, "PARTIAL").otherwise("FAIL")


def drop_status(drop: Column) -> Column:
    """Engine gate (P24) of a mean score's drop under another OCR engine."""
    return F.when(drop <= DROP_PASS, "PASS").when(drop <= DROP_PARTIAL, "PARTIAL").otherwise("FAIL")


def ablation_gate(rows: DataFrame, full: str, value: str = "anls", name: str = "drop_group") -> DataFrame:
    """Ablation gate (P16) of rows (drop_group, anls), `full` naming the full selector's row: how many removals harm or help it,
    passed if none helps and at least three harm."""
    base = rows.where(F.col(name) == full).agg(F.max(value).alias("full"))
    x = rows.where(F.col(name) != full).join(F.broadcast(base))  # one row
    x = x.agg(F.count_if(F.col(value) > F.col("full") + 1e-6).alias("helped"), F.count_if(F.col(value) < F.col("full") - 1e-6).alias("hurt"))
    return x.withColumn("passed", (F.col("helped") == 0) & (F.col("hurt") >= 3))


def pack(evaluated: DataFrame, id_col: str, bases: tuple[str, str] = ("resize", "shortest_nonempty"), interval: Callable = M.bootstrap) -> DataFrame:
    """A row per rule of evaluated (rule, id, route, anls, em): means, route counts, differences to two base rules of the same
    ids with their intervals, targets, role and the selector gates P14 (beats the shortest rule), P15, P17 and P18. evaluated is stored, as it is read five times."""
    evaluated = kept(evaluated, "evaluated")
    own = evaluated.groupBy("rule").agg(
        F.count("*").alias("n"), F.avg("anls").alias("anls"), F.avg("em").alias("em"),
        F.array_join(F.array_sort(F.collect_set("route")), ",").alias("routes"),
    )
    for b, short in zip(bases, ("resize", "shortest"), strict=True):
        base = evaluated.where(F.col("rule") == b).select(id_col, F.col("anls").alias("_base"))
        diff = evaluated.join(base, id_col).withColumn("diff", F.col("anls") - F.col("_base"))
        ends = interval(diff, ["rule"], "diff", id_col).select("rule", F.col("mean").alias(f"delta_{short}"), F.col("low").alias(f"low_{short}"), F.col("high").alias(f"high_{short}"))
        own = own.join(ends, "rule", "left")
    wins = {s: (F.col(f"delta_{s}") > 0) & (F.col(f"low_{s}") > 0) for s in ("resize", "shortest")}
    return own.select(
        "*", F.when(F.col("rule").isin(*PRODUCTION), "production").otherwise("comparator").alias("role"),
        (F.col("anls") >= TARGET_ANLS).alias("target_anls_met"), (F.col("em") >= TARGET_EM).alias("target_em_met"),
        (F.col("delta_shortest") > 0).alias("p14"), ((F.col("low_resize") > 0) & (F.col("low_shortest") > 0)).alias("p15"),
        scale_status(wins["resize"], wins["shortest"]).alias("p17"), transfer_status(wins["resize"], wins["shortest"]).alias("p18"),
    )


def label_density(labels: DataFrame, by: list[str], strict: str = "strict", soft: str = "soft") -> DataFrame:
    """Per group: candidates, positives by tier, and the shares of strict and of any positives."""
    s, o = F.col(strict), F.col(soft) & ~F.col(strict)
    n = F.greatest(F.lit(1), F.count("*"))
    return labels.groupBy(*by).agg(F.count("*").alias("num_candidates"), F.count_if(s | o).alias("num_positive_any"), F.count_if(s).alias("num_positive_strict"), F.count_if(o).alias("num_positive_soft_only"), (F.count_if(s | o) / n).alias("positive_fraction_any"), (F.count_if(s) / n).alias("positive_fraction_strict"))


def coordinate_scores(candidates: DataFrame, strict: DataFrame, any_: DataFrame, by: list[str], weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """candidates (by, x, y, w, h) with the scores that out-of-fold tables (by, x, y, w, h, score) hold for their rectangles:
    strict and any are negative infinity where missing, combined only where both are."""
    keys = [*by, "x", "y", "w", "h"]
    x = candidates.join(strict.select(*keys, F.col("score").alias("_s")), keys, "left").join(any_.select(*keys, F.col("score").alias("_a")), keys, "left")
    gone = F.lit(float("-inf"))
    both = weights[0] * F.coalesce("_s", F.lit(0.0)) + weights[1] * F.coalesce("_a", F.lit(0.0))
    x = x.withColumn("strict", F.coalesce("_s", gone)).withColumn("any", F.coalesce("_a", gone))
    return x.withColumn("combined", F.when(F.col("_s").isNull() & F.col("_a").isNull(), gone).otherwise(both)).drop("_s", "_a")


def gap_report(flags: DataFrame, names: list[str], gap: tuple[str, str], buckets: dict[str, tuple[str, str]]) -> DataFrame:
    """(metric, rate, hits, n) of flags (a row per question, boolean columns): a row per name, one for the difference of two
    rates (its count rounded half to even) and one per bucket of rows with the first flag but not the second."""
    one = [F.struct(F.lit(m).alias("metric"), F.count_if(F.col(m)).cast("double").alias("hits")) for m in names]
    one += [F.struct(F.lit(f"bucket_{m}").alias("metric"), F.count_if(F.col(a) & ~F.col(b)).cast("double").alias("hits")) for m, (a, b) in buckets.items()]
    diff = F.struct(F.lit("gap").alias("metric"), (F.count_if(F.col(gap[0])) - F.count_if(F.col(gap[1]))).cast("double").alias("hits"))
    x = flags.agg(F.count("*").alias("n"), F.array(*one, diff).alias("m")).select("n", F.explode("m").alias("m"))
    return x.select("m.metric", F.when(F.col("n") > 0, F.col("m.hits") / F.col("n")).otherwise(0.0).alias("rate"), F.bround("m.hits").cast("long").alias("hits"), "n")


def shortlist(df: DataFrame, wanted: Column, length: Column, score: Column, key: str, n: int, skip: int = 0) -> DataFrame:
    """Failures worth a look: wanted rows with the shortest questions (then best scores), max(4 (skip + n), 12) of them, place from 1."""
    x = df.where(wanted).withColumn("_len", length).withColumn("_score", score)
    x = x.orderBy("_len", F.col("_score").desc(), key).limit(max(4 * (skip + n), 12))
    return x.withColumn("place", F.row_number().over(Window.orderBy("_len", F.col("_score").desc(), key))).drop("_len", "_score")
