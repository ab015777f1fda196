"""Ranks, coverage, grouped tables, intervals and gates of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flag(c: str) -> Column:
    """A flag column as a boolean; missing counts as false."""
    return F.coalesce(F.col(c).cast("boolean"), F.lit(False))


def eligible(df: DataFrame, flags=("dry_run", "invalid_budget", "not_applicable"), stages=("pilot", "paper")) -> DataFrame:
    """Rows without any of the flags and of the given stages; columns that are not there are skipped."""
    for c in flags:
        if c in df.columns:
            df = df.where(~flag(c))
    return df.where(F.col("experiment_stage").isin(*stages)) if "experiment_stage" in df.columns else df


def pixel_budget(actual: Column, target: Column) -> Column:
    """Within 3 % of the target; a target of 0 or less must be met exactly."""
    return F.when(target > 0, F.abs(actual - target) / target <= 0.03).otherwise(actual == target)


def byte_budget(actual: Column, target: Column) -> Column:
    """Struct (valid, utilization, underused): at or under the target; under-used below 70 %."""
    use = F.when(target > 0, actual / target).otherwise(0.0)
    return F.struct((actual <= target).alias("valid"), use.alias("utilization"), (use < 0.7).alias("underused"))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the given order."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ranked(df: DataFrame, by: list[str], score: str, position: str, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), position)))


def rank_metrics(df: DataFrame, by: list[str], tier: Column, ks=(1, 2, 4, 8)) -> DataFrame:
    """First positive rank (null if none), its reciprocal (0 if none) and whether one is in the first k, over rows with rank."""
    first = F.min(F.when(tier, F.col("rank")))
    return df.groupBy(*by).agg(first.cast("double").alias("first_rank"), F.coalesce(1 / first, F.lit(0.0)).alias("reciprocal_rank"), *[F.bool_or(tier & (F.col("rank") <= k)).alias(f"coverage_at_{k}") for k in ks])


def ndcg(df: DataFrame, by: list[str], score: str, relevance: str, position: str, k: int) -> DataFrame:
    """Normalised discounted gain at k: 2^r - 1 over log2(rank + 1); the ideal order takes all relevances; none positive: 0."""
    x = ranked(df, by, score, position, "_r")
    x = x.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(relevance).desc(), position)))
    gain = lambda r: F.sum(F.when(F.col(r) <= k, (F.pow(F.lit(2.0), F.col(relevance)) - 1) / F.log2(F.col(r) + 1)).otherwise(0.0))
    g = x.groupBy(*by).agg(gain("_r").alias("dcg"), gain("_i").alias("ideal"))
    return g.select(*by, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def min_max(c: str, by: list[str]) -> Column:
    """A column scaled to 0..1 in its group; a constant group counts 0."""
    w = Window.partitionBy(*by)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.0)


def nearest_rank(df: DataFrame, by: list[str], value: str, shares: dict[str, tuple[int, int]]) -> DataFrame:
    """Values at position floor(n * a / b) of each group in ascending order, without interpolation."""
    w = Window.partitionBy(*by)
    x = df.withColumn("_r", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return x.groupBy(*by).agg(*[F.max(F.when(F.col("_r") == F.floor(F.col("_n") * a / b), F.col(value))).alias(name) for name, (a, b) in shares.items()])


#: Resamples that one task draws of a group.
BLOCK = 8


def bootstrap(df: DataFrame, by: list[str], value: str, key: str, boots: int = 200, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Mean and percentile interval of resampled means, distributed: draw j of resample b takes the row whose place is an MD5 of
    (seed, group, b, j) modulo the group's size. Groups are small tables of paired differences (one row per question): a group's values go to a
    task per BLOCK resamples, which draws and looks up at once. A row per draw would be `boots` times the table, shuffled and sorted."""
    import numpy as np
    import pandas as pd

    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in by])
    rows = df.select(*by, F.col(value).cast("double").alias("v"), (F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1).alias("pos"), text.alias("_text"))
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((boots - 1) // BLOCK))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from hashlib import md5

        v, first = pdf.sort_values("pos")["v"].to_numpy(float), int(pdf["_block"].iloc[0]) * BLOCK
        known, places, means = np.where(np.isnan(v), 0.0, v), [b":%d" % j for j in range(len(v))], []
        for b in range(first, min(first + BLOCK, boots)):
            head = f"{pdf['_text'].iloc[0]}:{b}".encode()
            drawn = np.frombuffer(b"".join([md5(head + j).digest()[:4] for j in places]), ">u4").astype(np.int64) % len(v)
            n = np.count_nonzero(~np.isnan(v[drawn]))
            means.append(known[drawn].sum() / n if n else None)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(means) for c in by}, "m": pd.Series(means, dtype=float)})

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    # dealt by number, as Spark joins small partitions by their bytes, which say little of rows that cost much
    dealt = blocks.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by, "_block")
    means = dealt.groupBy(*by, "_block").applyInPandas(run, f"{kinds}, m double")
    ends = means.groupBy(*by).agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).join(ends, by)


def bootstrap_exact(df: DataFrame, by: list[str], value: str, key: str, boots: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """The same by a seeded generator, group by group: the published intervals' exact draws (rows in key order)."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, rng = pdf.sort_values(key)[value].to_numpy(float), np.random.default_rng(seed)
        means = [rng.choice(v, size=len(v), replace=True).mean() for _ in range(boots)]
        low, high = np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)])
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "mean": [v.mean()], "low": [low], "high": [high], "n": [len(v)]})

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return df.groupBy(*by).applyInPandas(run, f"{kinds}, mean double, low double, high double, n long")


def gate_status(beats_a: Column, low_a: Column, beats_b: Column, low_b: Column) -> Column:
    """PASS if both comparisons are won with a lower end above 0, PARTIAL if exactly one is, else FAIL."""
    a, b = beats_a & (low_a > 0), beats_b & (low_b > 0)
    return F.when(a & b, "PASS").when(a | b, "PARTIAL").otherwise("FAIL")


def first_labels(rules: list[tuple[str, Column]], default: Column) -> tuple[Column, Column]:
    """Primary and secondary label: the first and second rule that hold, in order."""
    held = F.array_compact(F.array(*[F.when(ok, name) for name, ok in rules]))
    return F.coalesce(F.try_element_at(held, F.lit(1)), default), F.try_element_at(held, F.lit(2))
