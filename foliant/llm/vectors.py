"""Blocks of vectors: which take part, how they are dealt to tiles, and exact cosines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Whether a vector is not null, not zero and has only finite components."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """An Arrow or pandas column of equally long vectors as double rows."""
    return np.stack([np.asarray(x, dtype=np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum(a * a, axis=1)[:, -1])


def cosines(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, na: np.ndarray, nb: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Cosines of the rows a[i], b[j] in double precision; components are added in order, so equal rows give equal values."""
    out = np.empty(len(i))
    for k in range(0, len(i), step):
        x, y = i[k : k + step], j[k : k + step]
        out[k : k + step] = np.cumsum(a[x] * b[y], axis=1)[:, -1] / (na[x] * nb[y])
    return out


def deal(rows: DataFrame, group: str, count: DataFrame, width: int, key: str) -> DataFrame:
    """rows with parts (how many blocks of about width rows their group has) and own (their block, by hash of key)."""
    n = count.select(F.col(group).alias("_g"), F.ceil(F.col("count") / width).cast("int").alias("parts"))
    out = rows.join(n, F.col(group) == F.col("_g")).drop("_g")
    return out.withColumn("own", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))
