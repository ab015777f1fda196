"""Selectors of answers: fold models from one pass of products, feature-group ablations, routing before reading, weight sweeps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gates as Gt
from . import metrics as M
from . import trees as Tr

#: Margins that a router tries, and how near to the best a score counts as equal.
MARGINS, SLACK = (0.0, 0.02, 0.05, 0.08, 0.12, 0.16, 0.20, 0.30), 1e-9


def fold_of(keys: list[str], folds: int) -> Column:
    """A question's fold: an MD5 of its keys."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("long") % folds).cast("int")


@dataclass
class FoldModels:
    """Ridge weights [variant, fold, label, feature] and intercepts [variant, fold, label]; fold k's model saw all rows but fold k's."""

    features: list[str]
    weights: np.ndarray
    intercepts: np.ndarray

    def predict(self, df: DataFrame, name: str, fold: Column | None) -> DataFrame:
        """df with array `name`: per row its predictions by variant and label (flat) of the models of its fold; without fold, by variant, fold and label."""
        w, b = self.weights, self.intercepts

        @F.pandas_udf("array<double>")
        def run(x: pd.Series, k: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            rows, own = np.stack([np.asarray(r, float) for r in x]), k.to_numpy()
            every = np.einsum("vkyf,nf->nvky", w, rows) + b
            picked = every if own[0] < 0 else every[np.arange(len(rows)), :, own]
            return pd.Series(list(picked.reshape(len(rows), -1)))

        return df.withColumn(name, run(F.array(*[F.col(c).cast("double") for c in self.features]), fold if fold is not None else F.lit(-1)))


def fold_models(x: DataFrame, features: list[str], labels: list[str], fold: str, folds: int, alpha: float = 1.0, drops: dict[str, list[str]] | None = None) -> FoldModels:
    """Ridge models of every label, for every fold and every variant of drops (name -> features left out; default: one, nothing left out).

    One pass sums, per fold, the products of all columns, centred on their means. A fold's training sums are the totals less its own, and a
    variant's are those without the dropped rows and columns, so no variant and no fold reads the table again. What the driver gets is
    folds x columns^2 numbers. Rows with a null are left out.
    """
    names = [*features, *labels]
    x = x.select(F.col(fold).cast("int").alias("_fold"), *[F.col(c).cast("double").alias(c) for c in names]).na.drop()
    mean = x.agg(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in names]).first()
    mean, width = np.array(mean, float), len(names) + 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, width, width))
        for b in batches:
            z = np.column_stack([np.ones(b.num_rows), *(b.column(c).to_numpy(zero_copy_only=False) for c in names)])
            z[:, 1:] -= mean
            own = b.column("_fold").to_numpy(zero_copy_only=False)
            for k in np.unique(own):
                total[k] += z[own == k].T @ z[own == k]
        k, i, j = np.nonzero(np.broadcast_to(np.triu(np.ones((width, width), bool)), total.shape))
        yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int32)) for v in (k, i, j)), pa.array(total[k, i, j])], ["k", "i", "j", "v"])

    found = x.mapInArrow(products, "k int, i int, j int, v double").groupBy("k", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    sums = np.zeros((folds, width, width))
    sums[found["k"], found["i"], found["j"]] = found["v"]
    sums += np.transpose(np.triu(sums, 1), (0, 2, 1))
    n_features = len(features)
    drops = drops if drops is not None else {"": []}
    weights, intercepts = np.zeros((len(drops), folds, len(labels), n_features)), np.zeros((len(drops), folds, len(labels)))
    for k in range(folds):
        own = sums.sum(0) - sums[k]
        n = max(own[0, 0], 1e-300)
        centre = own[0, 1:] / n
        product = own[1:, 1:] - n * np.outer(centre, centre)
        for v, gone in enumerate(drops.values()):
            kept = [i for i, c in enumerate(features) if c not in gone]
            gram = product[np.ix_(kept, kept)] + alpha * np.eye(len(kept))
            for y in range(len(labels)):
                w = np.linalg.lstsq(gram, product[kept, n_features + y], rcond=None)[0] if kept and own[0, 0] > 0 else np.zeros(len(kept))
                weights[v, k, y, kept] = w
                intercepts[v, k, y] = mean[n_features + y] + centre[n_features + y] - w @ (mean[kept] + centre[kept])
    return FoldModels(list(features), weights, intercepts)


def chosen(scored: DataFrame, keys: list[str], order: list[str], by: list[str] | None = None, kept: tuple[str, ...] = (), slack: float = SLACK) -> DataFrame:
    """Of scored (keys, route, predicted), the route with the largest prediction; those within slack tie by their place in order."""
    by = [*(by or []), *keys]
    place = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("route"))
    top = scored.groupBy(*by).agg(F.max("predicted").alias("_top"))
    near = scored.join(top, by).where(F.col("predicted") >= F.col("_top") - slack)
    picked = near.groupBy(*by).agg(F.min(F.struct(place.alias("place"), F.col("route"), F.col("predicted"), *kept)).alias("b"))
    return picked.select(*by, "b.route", "b.predicted", *[f"b.{c}" for c in kept])


def boosted_scores(long: DataFrame, keys: list[str], features: list[str], label: str, folds: int, ranked: bool = False, steps: int = 31, **options) -> DataFrame:
    """(keys, route, predicted) of long, out of fold, by boosted trees: of the label itself, or, ranked, of its order within a
    question (the label in `steps` equal steps from 0 to 1 is a row's gain)."""
    x = long.withColumn("_fold", fold_of(keys, folds))
    gain = F.least(F.greatest(F.round(F.col(label) * steps), F.lit(0.0)), F.lit(float(steps)))
    x = x.withColumn("_label", gain if ranked else F.col(label).cast("double"))
    chunk = {"objective": "ranks", "group": keys} if ranked else {"objective": "squares"}
    out = Tr.boost(x, [*keys, "route"], features, "_label", fold="_fold", folds=folds, **(chunk | options))[1]
    return out.select(*keys, "route", F.col("prediction").alias("predicted"))


def best_route_scores(long: DataFrame, keys: list[str], features: list[str], label: str, folds: int) -> DataFrame:
    """(keys, route, predicted) of long, out of fold: a standardised logistic model's probability that a row's label is its question's best
    (all that share it are), with an L2 penalty of 1 against the summed losses."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    top = long.groupBy(*keys).agg(F.max(label).alias("_top"))
    x = long.join(top, keys).withColumn("_best", (F.col(label) >= F.col("_top") - SLACK).cast("double")).withColumn("_fold", fold_of(keys, folds))
    counts = {r["_fold"]: r["n"] for r in x.groupBy("_fold").agg(F.count("*").alias("n")).collect()}
    parts = []
    for k in range(folds):
        n = sum(v for f, v in counts.items() if f != k)
        fit = LogisticRegression(featuresCol="_scaled", labelCol="_best", probabilityCol="_p", predictionCol="_hit", rawPredictionCol="_margin", regParam=1.0 / max(1, n), maxIter=200, tol=1e-9, standardization=False)
        model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_scaled", withMean=True), fit]).fit(x.where(F.col("_fold") != k))
        parts.append(model.transform(x.where(F.col("_fold") == k)).select(*keys, "route", vector_to_array("_p")[1].alias("predicted")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ablated_selections(long: DataFrame, keys: list[str], features: list[str], groups: dict[str, list[str]], label: str, order: list[str], kept: tuple[str, ...] = (), folds: int = 3, alpha: float = 1.0, full: str = "full") -> DataFrame:
    """(rule, keys, route, predicted, kept) of long (a row per question and route): what ridge models select out of fold with all features
    (rule `full`) and without each group (rule without_<group>). All models come from one pass (see fold_models())."""
    drops = {full: []} | {f"without_{g}": own for g, own in groups.items()}
    x = long.withColumn("_fold", fold_of(keys, folds))
    models = fold_models(x, features, [label], "_fold", folds, alpha, drops)
    x = models.predict(x, "_p", F.col("_fold")).select(*keys, "route", *kept, F.posexplode("_p").alias("_v", "predicted"))
    names = F.array(*[F.lit(d) for d in drops])
    return chosen(x.withColumn("rule", F.element_at(names, F.col("_v") + 1)), keys, order, ["rule"], kept)


def evaluate_selectors(long: DataFrame, bases: DataFrame, keys: list[str], features: list[str], groups: dict[str, list[str]], order: list[str], folds: int = 3, alpha: float = 1.0,
                       models: dict[str, DataFrame] | None = None, interval: Callable = M.bootstrap, full: str = "full") -> DataFrame:
    """The whole evaluation of a selector: a row per rule with its packed result (see gates.pack()), its routes' counts, the share of the
    oracle's lead over the best single route that it recovers, and the ablation gate P16.

    long has a row per question and route (keys, route, anls, em, features); bases (rule, keys, route, anls, em) holds the rules to
    compare with, resize and shortest_nonempty among them; models may name further tables (keys, route, predicted) of scores to select by.
    """
    own = ablated_selections(long, keys, features, groups, "anls", order, ("anls", "em"), folds, alpha, full)
    for name, scores in (models or {}).items():
        picked = chosen(scores.join(long.select(*keys, "route", "anls", "em"), [*keys, "route"]), keys, order, kept=("anls", "em"))
        own = own.unionByName(picked.withColumn("rule", F.lit(name)), allowMissingColumns=True)
    columns = ["rule", *keys, "route", "anls", "em"]
    every = own.select(*columns).unionByName(bases.select(*columns)).withColumn("_id", F.concat_ws(":", *keys))
    out = Gt.pack(every, "_id", interval=interval)
    counts = every.groupBy("rule", "route").agg(F.count("*").alias("n")).groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "route", "n"))), ",").alias("route_counts"))
    single = long.groupBy("route").agg(F.avg("anls").alias("m")).agg(F.max("m").alias("_single"))
    oracle = long.groupBy(*keys).agg(F.max("anls").alias("m")).agg(F.avg("m").alias("_oracle"))
    gate = Gt.ablation_gate(out.where((F.col("rule") == full) | F.col("rule").isin([f"without_{g}" for g in groups])), full, name="rule")
    out = out.join(counts, "rule").join(F.broadcast(single)).join(F.broadcast(oracle)).join(F.broadcast(gate.select("helped", "hurt", F.col("passed").alias("p16"))))  # a row each
    recovered = (F.col("anls") - F.col("_single")) / F.greatest(F.col("_oracle") - F.col("_single"), F.lit(1e-9))
    return out.withColumn("recovered", recovered).drop("_single", "_oracle")


def route_before(x: DataFrame, keys: list[str], features: list[str], routes: list[str], score: str = "a_{}", margins: tuple[float, ...] = MARGINS, folds: int = 3, alpha: float = 1.0) -> tuple[DataFrame, list[float]]:
    """x (a row per question: features, each route's score) with `route` and `gain`, and each fold's margin: a question goes to the
    route that models of its features predict to be best, if that beats the first route by more than the margin.

    Models and margins of a fold see the other folds' questions only. All folds' models predict all rows in one pass; rows are summed by
    fold and by how many margins their gain exceeds, and a margin's mean is a sum over the buckets above it, so margins are tuned
    without reading the rows again. Of equally good margins the smallest is taken. Rows with a null feature or score are left out.
    """
    labels = [score.format(r) for r in routes]
    x = x.na.drop(subset=[*features, *labels]).withColumn("_fold", fold_of(keys, folds))
    models = fold_models(x, features, labels, "_fold", folds, alpha)
    width = len(routes)
    values = F.array(*[F.col(c).cast("double") for c in labels])
    every = models.predict(x, "_p", None).select("*", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: F.slice("_p", k * width + 1, width))).alias("_k", "_own"))
    best = F.array_position("_own", F.array_max("_own")).cast("int")
    every = every.withColumn("gain", F.element_at("_own", best) - F.col("_own")[0]).withColumn("_alt", best).withColumn("_lead", F.element_at(values, best) - values[0])
    above = F.size(F.filter(F.array(*[F.lit(float(m)) for m in margins]), lambda m: F.col("gain") > m))
    found = every.where(F.col("_k") != F.col("_fold")).groupBy("_k", above.alias("above")).agg(F.sum("_lead").alias("lead")).toPandas()
    tuned = []
    for k in range(folds):
        own = found[found["_k"] == k].set_index("above")["lead"]
        lead = [float(own[own.index > i].sum()) for i in range(len(margins))]
        pick = 0
        for i in range(1, len(margins)):
            if lead[i] > lead[pick] + 1e-9:
                pick = i
        tuned.append(float(margins[pick]))
    margin = F.element_at(F.array(*[F.lit(m) for m in tuned]), F.col("_fold") + 1)
    names = F.array(*[F.lit(r) for r in routes])
    out = every.where(F.col("_k") == F.col("_fold")).withColumn("route", F.when(F.col("gain") > margin, F.element_at(names, F.col("_alt"))).otherwise(F.lit(routes[0])))
    return out.drop("_p", "_k", "_own", "_alt", "_lead", "_fold"), tuned


def router_report(routed: DataFrame, routes: list[str], score: str = "a_{}") -> DataFrame:
    """One row on routed (route, each route's score): means of the routing, the oracle and the best single route (the first of equals), the share of
    the lead recovered, how often the routing is optimal, and wins, ties and losses against the best single route."""
    columns = [score.format(r) for r in routes]
    means = routed.agg(*[F.avg(c).alias(c) for c in columns])
    top = F.array(*[F.col(c) for c in columns])
    means = means.select(F.array_position(top, F.array_max(top)).cast("int").alias("_base"))
    values = F.array(*[F.col(c).cast("double") for c in columns])
    got = F.element_at(values, F.array_position(F.array(*[F.lit(r) for r in routes]), F.col("route")).cast("int"))
    x = routed.join(F.broadcast(means)).select(got.alias("got"), F.array_max(values).alias("best"), F.element_at(values, F.col("_base")).alias("base"), "_base")  # one row
    d = F.col("got") - F.col("base")
    return x.agg(
        F.count("*").alias("n"), F.element_at(F.array(*[F.lit(r) for r in routes]), F.max("_base")).alias("best_single"), F.avg("got").alias("routed"), F.avg("base").alias("base"), F.avg("best").alias("oracle"),
        ((F.avg("got") - F.avg("base")) / F.greatest(F.avg("best") - F.avg("base"), F.lit(1e-9))).alias("recovered"), F.avg((F.col("got") >= F.col("best") - SLACK).cast("int")).alias("optimal_rate"),
        F.count_if(d > SLACK).alias("wins"), F.count_if(F.abs(d) <= SLACK).alias("ties"), F.count_if(d < -SLACK).alias("losses"),
    )


def weight_sweep(df: DataFrame, question: str, key: str, features: list[str], configs: list[list[float]], strict: str, any_: str, k: int = 2) -> DataFrame:
    """(config, strict_rate, any_rate, n, place) of df (a row per question and candidate): for every weighting of the features, how many
    questions have a strict (any) positive among the k candidates of the highest weighted sum; equal sums go by key.

    Candidates are brought together by question once; a task multiplies blocks of questions with the whole grid and adds up hits, so all
    configurations cost one pass. Sums are compared to 12 digits. Null features count as 0, null flags as false. A question's
    candidates are a bounded pool. place orders by strict, then any rate, then config.
    """
    grid = np.array(configs, float).reshape(len(configs), len(features)).T
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    x = df.select(question, key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_{i}") for i, c in enumerate(features)], flag(strict).alias("_s"), flag(any_).alias("_a"))
    x = x.repartition(question).sortWithinPartitions(question, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits, rest = np.zeros((2, grid.shape[1]), np.int64), None
        n = 0

        def add(own: pd.DataFrame) -> int:
            names = pd.factorize(own[question], use_na_sentinel=False)[0]
            first = np.flatnonzero(np.diff(names, prepend=-1))
            scores = np.round(own[[f"_{i}" for i in range(len(features))]].to_numpy(float) @ grid, 12)
            flags = own[["_s", "_a"]].to_numpy(bool)
            for a, b in zip(first, [*first[1:], len(own)], strict=True):
                top = np.argsort(-scores[a:b], axis=0, kind="stable")[:k]
                for e in (0, 1):
                    hits[e] += flags[a:b, e][top].any(axis=0)
            return len(first)

        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            last = b[question].iloc[-1] if len(b) else None
            open_ = b[question].isna() if pd.isna(last) else b[question] == last  # may go on in the next batch
            rest, done = b[open_], b[~open_].reset_index(drop=True)
            n += add(done) if len(done) else 0
        if rest is not None and len(rest):
            n += add(rest.reset_index(drop=True))
        yield pd.DataFrame({"config": np.arange(grid.shape[1]), "s": hits[0], "a": hits[1], "n": n})

    found = x.mapInPandas(run, "config int, s long, a long, n long").groupBy("config").agg(*[F.sum(c).alias(c) for c in ("s", "a", "n")])
    n = F.greatest(F.col("n"), F.lit(1))
    rates = found.select("config", (F.col("s") / n).alias("strict_rate"), (F.col("a") / n).alias("any_rate"), "n")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("strict_rate")).alias("x"), (-F.col("any_rate")).alias("y"), "config", "n")))  # as many as configs
    out = rates.agg(ranked.alias("r")).select(F.posexplode("r").alias("place", "c"))
    return out.select("c.config", (-F.col("c.x")).alias("strict_rate"), (-F.col("c.y")).alias("any_rate"), "c.n", (F.col("place") + 1).cast("long").alias("place"))
