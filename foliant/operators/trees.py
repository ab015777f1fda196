"""Boosted trees: features are binned once, tasks sum histograms of gradients, the driver sees sums and picks splits."""

from __future__ import annotations

import heapq
import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Stored

#: Rows whose values give the bins' edges (those with the smallest hashes), rows of a chunk, and steps of a gradient: sums of
#: whole steps don't depend on the order of tasks, so reruns agree.
SAMPLE, CHUNK, STEP = 50_000, 4096, 1 << 20
#: Pairs of rows whose gradients are computed at once (those of one group at least), and chunks of a task.
PAIRS, CHUNKS = 1 << 20, 16
STATE = "chunk long, rid binary, bins binary, fold binary, label binary, starts binary, scores binary, g binary, h binary"


@dataclass
class Tree:
    """Nodes by number, the root first; a node with feature -1 is a leaf. Rows go left whose bin is at most cut."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> None:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for own, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.value, 0.0)):
            own += [x, x]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        node, feature, cut, left = np.zeros(len(bins), np.int64), np.array(self.feature), np.array(self.cut), np.array(self.left)
        while (going := np.flatnonzero(feature[node] >= 0)).size:
            n = node[going]
            node[going] = left[n] + (bins[going, feature[n]] > cut[n])
        return node

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass
class Forest:
    """features, the upper edges of their bins, a start value, and trees whose scores add up."""

    features: list[str]
    edges: list[np.ndarray]
    start: float
    trees: list[Tree]

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        return self.start + sum((t.scores(bins) for t in self.trees), np.zeros(len(x)))

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """df with the forest's score; null and NaN features count as smaller than any number."""
        own = self

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(own.scores(np.stack([np.asarray(r, float) for r in x]) if len(x) else np.zeros((0, len(own.features)))))

        return df.withColumn(output, score(vector(self.features)))


def vector(features: list[str]):
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: from 1, the first whose upper edge is not below it; NaN has bin 0."""
    return np.stack([np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(e, x[:, k], "left")) for k, e in enumerate(edges)], axis=1).astype(np.uint16) if len(edges) else np.zeros((len(x), 0), np.uint16)


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Upper edges of at most `bins` bins per feature: all values but the largest if these are few, else quantiles."""
    out = []
    for k in range(x.shape[1]):
        v = np.unique(x[~np.isnan(x[:, k]), k])
        own = v if len(v) <= bins else np.unique(np.quantile(x[~np.isnan(x[:, k]), k], np.arange(1, bins) / bins, method="lower"))
        out.append(own[:-1] if len(v) <= bins else own)
    return out


def squares(score: np.ndarray, label: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures of half the squared error."""
    return score - label, np.ones(len(score))


def lambdas(score: np.ndarray, label: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the groups that begin at starts: each pair of unlike labels pulls apart, as strongly as swapping the two would change the
    group's NDCG.

    Labels are gains. Places follow the scores, ties the rows' order. Groups of the same size are computed together.
    """
    g, h, sizes = np.zeros(len(score)), np.zeros(len(score)), np.diff(np.append(starts, len(score)))
    for n in np.unique(sizes):
        of, weight = starts[sizes == n], 1 / np.log2(np.arange(n) + 2)
        most = max(1, PAIRS // n**2)
        for first in range(0, len(of), most):
            at = of[first : first + most, None] + np.arange(n)
            s, y = score[at], label[at]
            best, discount = np.sort(y, axis=1)[:, ::-1] @ weight, np.empty(at.shape)
            np.put_along_axis(discount, np.argsort(-s, axis=1, kind="stable"), np.broadcast_to(weight, at.shape), 1)
            k, i, j = np.nonzero((y[:, :, None] > y[:, None, :]) & (best > 0)[:, None, None])
            delta = (y[k, i] - y[k, j]) * np.abs(discount[k, i] - discount[k, j]) / best[k]
            p = 1 / (1 + np.exp(np.clip(s[k, i] - s[k, j], -50, 50)))
            np.subtract.at(g, at[k, i], p * delta)
            np.add.at(g, at[k, j], p * delta)
            for e in (i, j):
                np.add.at(h, at[k, e], p * (1 - p) * delta)
    return g, h


OBJECTIVES = {"squares": squares, "ranks": lambdas}


def in_bag(rid: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """Which rows a tree sees, by a hash of the row, the seed and the tree's number."""
    h = (rid.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1342543DE82EF95) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(float) / (1 << 53) < share


def best_split(hist: np.ndarray, features: list[int], least_rows: int, least_curve: float, ridge: float) -> tuple[float, int, int]:
    """(gain, feature, cut) of sums (feature, bin, (g, h, n)); gain 0 if no split helps. Ties go to the first feature and cut."""
    total, best = hist[features[0]].sum(0).astype(float), (0.0, -1, 0)
    g, h = total[0] / STEP, total[1] / STEP
    whole = g * g / (h + ridge) if h + ridge > 0 else 0.0
    for f in features:
        low = np.cumsum(hist[f], axis=0).astype(float)[:-1]
        high = total - low
        ok = (low[:, 2] >= least_rows) & (high[:, 2] >= least_rows) & (low[:, 1] >= least_curve * STEP) & (high[:, 1] >= least_curve * STEP)
        if ok.any():
            gain = np.full(len(low), -np.inf)
            a, b = low[ok] / STEP, high[ok] / STEP
            gain[ok] = a[:, 0] ** 2 / (a[:, 1] + ridge) + b[:, 0] ** 2 / (b[:, 1] + ridge) - whole
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), f, k)
    return best


class Growth:
    """One tree as it grows, best leaf first: of a pass over the rows it asks the sums of all leaves that may matter next."""

    def __init__(self, features: list[int], leaves: int, limits: dict):
        self.tree, self.features, self.leaves, self.limits = Tree(), features, leaves, limits
        self.sums: dict[int, np.ndarray] = {}
        self.splits: dict[int, tuple[float, int, int]] = {}

    def wanted(self) -> list[int]:
        """Leaves whose sums decide what is split next; none when the tree has its leaves."""
        if 0 not in self.sums:
            return [0]
        open_, self.chosen, wanted = [(-self.splits[0][0], 0)], set(), []
        while open_ and len(self.chosen) + 1 < self.leaves:
            gain, node = heapq.heappop(open_)
            if gain >= 0:
                break
            self.chosen.add(node)
            if self.tree.feature[node] < 0:
                self.tree.split(node, *self.splits[node][1:])
            for child in (self.tree.left[node], self.tree.left[node] + 1):
                if child in self.sums:
                    heapq.heappush(open_, (-self.splits[child][0], child))
                else:
                    wanted.append(child)
        return wanted

    def learn(self, node: int, hist: np.ndarray) -> None:
        self.sums[node], self.splits[node] = hist[self.features[0]].sum(0), best_split(hist, self.features, **self.limits)

    def finished(self, rate: float) -> Tree:
        """The chosen splits only, with leaf values."""
        out, stack = Tree(), [(0, 0)]
        while stack:
            node, at = stack.pop()
            if node in self.chosen:
                out.split(at, self.tree.feature[node], self.tree.cut[node])
                stack += [(self.tree.left[node], out.left[at]), (self.tree.left[node] + 1, out.left[at] + 1)]
            else:
                g, h = self.sums[node][:2] / STEP
                out.value[at] = -rate * g / (h + self.limits["ridge"]) if h + self.limits["ridge"] > 0 else 0.0
        return out


def _arrays(b: pa.RecordBatch, i: int, models: int) -> dict[str, np.ndarray]:
    kinds = {"rid": np.int64, "bins": np.uint16, "fold": np.int32, "label": np.float64, "starts": np.int64, "scores": np.float64, "g": np.int64, "h": np.int64}
    out = {c: np.frombuffer(b.column(c)[i].as_py(), k) for c, k in kinds.items()}
    n = len(out["rid"])
    for c in ("scores", "g", "h"):
        out[c] = out[c].reshape(models, n)
    out["bins"] = out["bins"].reshape(n, -1)
    return out


def boost(df: DataFrame, keys: list[str], features: list[str], label: str, objective: str = "squares", group: list[str] | None = None, fold: str | None = None, folds: int = 1,
          trees: int = 50, leaves: int = 31, rate: float = 0.05, least_rows: int = 20, least_curve: float = 1e-3, ridge: float = 0.0, feature_share: float = 0.8,
          row_share: float = 0.8, bins: int = 255, seed: int = 42, stored: Stored | None = None) -> tuple[list[Forest], DataFrame]:
    """Forests fitted to df's rows, and (keys, fold, prediction) of these rows, each by a forest that did not see its fold.

    Without `fold` one forest sees all rows; with it, column `fold` holds 0 to folds - 1 and the forests grow in lock step, so all of them
    cost as many passes as one. objective "squares" fits the label, "ranks" orders the rows of a group (columns `group`, a
    bounded pool of candidates; all of a group in one fold) by lambda gradients, the label being a row's gain. Rows with a null label or
    fold are left out; repeated rows count as often as they occur; an empty table gives forests without trees.

    Rows are gathered once into chunks (about CHUNK rows by hash, whole groups) with binned features. A pass over the chunks sums gradients by (forest, leaf,
    feature, bin) in its tasks, then in one aggregation; what the driver gets is bounded by leaves x features x bins. Trees grow best
    leaf first, up to `leaves`; each sees the rows and features that a hash of the seed and its number picks.
    """
    stored = stored or Stored(df.sparkSession)
    width, gradient, models = len(features), OBJECTIVES[objective], folds if fold else 1
    rid = F.xxhash64(*keys)
    rows = df.where(F.col(label).isNotNull())
    rows = rows.where(F.col(fold).isNotNull()) if fold else rows
    rows = rows.select(F.struct(*keys).alias("key"), rid.alias("rid"), vector(features).alias("x"), F.col(label).cast("double").alias("label"), (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"),
                       *([F.xxhash64(*group).alias("chunk"), F.struct(*group).alias("group")] if group else []))
    rows = stored.table(rows, "rows")
    first = rows.orderBy("rid", "x").limit(SAMPLE).select("x").toPandas()["x"]
    edges = bin_edges(np.stack([np.asarray(v) for v in first]) if len(first) else np.zeros((0, width)), bins)
    n = rows.count()
    if not n:
        return [Forest(features, edges, 0.0, []) for _ in range(models)], df.limit(0).select(*keys, F.lit(0).alias("fold"), F.lit(0.0).alias("prediction"))
    chunks, place = n // CHUNK + 1, ["chunk", "group"] if group else []
    parts = min(chunks, max(4 * df.sparkSession.sparkContext.defaultParallelism, chunks // CHUNKS))
    held = rows.withColumn("_c", F.pmod("chunk" if group else "rid", F.lit(chunks))).repartition(parts, "_c")
    held = held.groupBy(F.col("_c").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct(*place, "rid", "x", "label", "fold", "key"))).alias("r"))
    held = stored.table(held, "chunks")
    sums = rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum(F.round(F.col("label") * STEP).cast("long")).alias("s")).toPandas()
    start = [float(s["s"].sum() / STEP / max(1, s["n"].sum())) if objective == "squares" else 0.0 for s in (sums[sums["fold"] != k] for k in range(models))]

    def gradients(score: np.ndarray, label: np.ndarray, fold: np.ndarray, starts: np.ndarray) -> tuple[bytes, bytes]:
        both = [gradient(score[k], label, starts) for k in range(models)]
        g, h = (np.stack([np.where(fold != k, np.rint(x[e] * STEP), 0) for k, x in enumerate(both)]).astype(np.int64) for e in (0, 1))
        return g.tobytes(), h.tobytes()

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for chunk, r in zip(b.column("chunk").to_pylist(), b.column("r"), strict=True):
                rid, label, fold = (r.values.field(c).to_numpy(zero_copy_only=False) for c in ("rid", "label", "fold"))
                x = r.values.field("x").flatten().to_numpy(zero_copy_only=False).reshape(len(rid), width)
                own = r.values.field("group").to_pylist() if group else []
                starts = np.array([0, *(i for i in range(1, len(own)) if own[i] != own[i - 1])], np.int64)
                scores = np.repeat(np.array(start)[:, None], len(rid), axis=1)
                out.append((chunk, rid.tobytes(), binned(x, edges).tobytes(), fold.tobytes(), label.tobytes(), starts.tobytes(), scores.tobytes(), *gradients(scores, label, fold, starts)))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out]) for k in range(9)], [c.split()[0] for c in STATE.split(", ")])

    state = stored.table(held.mapInArrow(begin, STATE), "state")
    forests = [Forest(features, edges, start[k], []) for k in range(models)]
    limits = {"least_rows": least_rows, "least_curve": least_curve, "ridge": ridge}
    size = max((len(e) for e in edges), default=0) + 2

    def histograms(turn: int, asked: list[tuple[int, Tree, list[int]]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots = [(k, node) for k, _, nodes in asked for node in nodes]
            place, total = {s: i for i, s in enumerate(slots)}, np.zeros((3, len(slots) * width * size), np.int64)
            for b in batches:
                for i in range(b.num_rows):
                    s = _arrays(b, i, models)
                    bag = in_bag(s["rid"], seed, turn, row_share)
                    for k, tree, nodes in asked:
                        at = np.full(len(tree.feature), -1)
                        at[nodes] = [place[k, x] for x in nodes]
                        own = at[tree.leaves(s["bins"])]
                        own[~bag | (s["fold"] == k)] = -1
                        some = np.flatnonzero(own >= 0)
                        where = ((own[some, None] * width + np.arange(width)) * size + s["bins"][some]).ravel()
                        for e, v in enumerate((s["g"][k], s["h"][k], np.ones(len(own), np.int64))):
                            np.add.at(total[e], where, np.repeat(v[some], width))
            some = np.flatnonzero(total[2])
            slot = some // (width * size)
            names = np.array(slots).reshape(-1, 2)
            columns = [names[slot, 0], names[slot, 1], some // size % width, some % size, *total[:, some]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["model", "node", "feature", "bin", "g", "h", "n"])

        return run

    def grown(turn: int, ended: list[Tree]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                scores, g, h = [], [], []
                for i in range(b.num_rows):
                    s = _arrays(b, i, models)
                    new = s["scores"] + np.stack([t.scores(s["bins"]) for t in ended])
                    both = gradients(new, s["label"], s["fold"], s["starts"])
                    scores.append(new.tobytes())
                    g.append(both[0])
                    h.append(both[1])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("chunk", "rid", "bins", "fold", "label", "starts")), pa.array(scores, pa.binary()), pa.array(g, pa.binary()), pa.array(h, pa.binary())], [c.split()[0] for c in STATE.split(", ")])

        return run

    for turn in range(trees):
        growths = []
        for k in range(models):
            picked = random.Random(f"{seed}:{turn}:{k}").sample(range(width), max(1, round(feature_share * width)))
            growths.append(Growth(sorted(picked), leaves, limits))
        while asked := [(k, g.tree, w) for k, g in enumerate(growths) if (w := g.wanted())]:
            found = state.mapInArrow(histograms(turn, asked), "model long, node long, feature long, bin long, g long, h long, n long")
            found = found.groupBy("model", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")]).toPandas()
            for k, _, nodes in asked:
                for node in nodes:
                    own, hist = found[(found["model"] == k) & (found["node"] == node)], np.zeros((width, size, 3), np.int64)
                    hist[own["feature"], own["bin"]] = own[["g", "h", "n"]]
                    growths[k].learn(node, hist)
        ended = [g.finished(rate) for g in growths]
        for f, t in zip(forests, ended, strict=True):
            f.trees.append(t)
        new = stored.table(state.mapInArrow(grown(turn, ended), STATE), "state")
        stored.drop(state)
        state = new

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                s = _arrays(b, i, models)
                rows.append(s["scores"][np.maximum(s["fold"], 0), np.arange(len(s["rid"]))].tolist())
            yield pa.RecordBatch.from_arrays([b.column("chunk"), pa.array(rows, pa.list_(pa.float64()))], ["chunk", "p"])

    scored = held.join(state.mapInArrow(read, "chunk long, p array<double>"), "chunk")
    out = scored.select(F.explode(F.arrays_zip("r", "p")).alias("z")).select("z.r.key.*", F.col("z.r.fold").alias("fold"), F.col("z.p").alias("prediction"))
    return forests, out
