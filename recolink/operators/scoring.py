"""Rule scores, selection, target encoding, grids, decoding and calibration."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def baseline_score(name: Column, addr: Column, num: Column, weights=(0.3, 0.6, 0.1)) -> Column:
    return weights[0] * name + weights[1] * F.coalesce(addr, F.lit(0.0)) + weights[2] * num


def rule_score(name: Column, addr: Column, compat: Column, conflict: Column, extra: Column, weights=(0.3, 0.5, 0.2), penalty: float = 0.1, agree_major: Column | None = None, major_pen: float = 0.0, conflict_pen: float | None = None) -> Column:
    """Weighted similarity less a penalty for extra words.

    A missing address is stood in for by the name. Where the S1's other claimants agree on another number (agree_major
    is 0) major_pen is taken off. A conflict of numbers is a veto (-1), or costs conflict_pen if that is given.
    """
    plain = weights[0] * name + weights[1] * F.coalesce(addr, name) + weights[2] * compat - penalty * F.least(extra, F.lit(3)) / 3
    if agree_major is not None:
        plain = plain - major_pen * F.coalesce((agree_major == 0).cast("double"), F.lit(0.0))
    against = F.coalesce(conflict == 1, F.lit(False))
    return F.when(against, F.lit(-1.0)).otherwise(plain) if conflict_pen is None else plain - conflict_pen * against.cast("double")


def one_to_one(pairs: DataFrame, score: str) -> DataFrame:
    """Each query's best pair (ties to the smaller S1)."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "s1_id"))
    return pairs.withColumn("__r", rank).where(F.col("__r") == 1).drop("__r")


def select(pairs: DataFrame, score: str, threshold: float, keep: float) -> DataFrame:
    """One-to-one, over the threshold, and only S1 records whose best accepted score reaches ``keep``."""
    chosen = one_to_one(pairs, score).where(F.col(score) >= threshold)
    return chosen.withColumn("__m", F.max(score).over(Window.partitionBy("s1_id"))).where(F.col("__m") >= keep).drop("__m")


def target_encoding(rows: DataFrame, token: str = "token", label: str = "label", fold: str = "fold", folds: tuple[int, ...] = (1, 2, 3, 4), smooth: float = 20.0) -> DataFrame:
    """(fold, token, n, score): occurrences and smoothed share of negatives in the other folds; fold 0 sees all of ``folds``.

    One aggregation by (fold, token): leaving a fold out is the total less its own row.
    """
    used = rows.where(F.col(fold).isin(*folds))
    priors = encoding_priors(rows, label, fold, folds)
    cells = used.groupBy(token, fold).agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col(label)).alias("neg"))
    totals = cells.groupBy(token).agg(F.sum("n").alias("tn"), F.sum("neg").alias("tneg"))
    grid = totals.withColumn(fold, F.explode(F.array(*[F.lit(f) for f in (0, *folds)])))
    out = grid.join(cells, [token, fold], "left").join(F.broadcast(priors), fold)  # priors: one row per fold
    n, neg = F.col("tn") - F.coalesce("n", F.lit(0)), F.col("tneg") - F.coalesce("neg", F.lit(0))
    return out.where(n > 0).select(fold, token, n.alias("n"), ((neg + smooth * F.col("prior")) / (n + smooth)).alias("score"))


def encoding_priors(rows: DataFrame, label: str = "label", fold: str = "fold", folds: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(fold, prior): the share of negatives in the other folds, one row for each and for 0, which sees all; 0.5 without rows."""
    cells = rows.where(F.col(fold).isin(*folds)).groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col(label)).alias("neg"))
    targets = rows.sparkSession.createDataFrame([(f, g) for f in (0, *folds) for g in folds if f != g], f"target int, {fold} int")
    seen = F.broadcast(targets).join(cells, fold, "left").groupBy("target").agg(F.sum("n").alias("n"), F.sum("neg").alias("neg"))
    return seen.select(F.col("target").alias(fold), F.coalesce(F.col("neg") / F.col("n"), F.lit(0.5)).alias("prior"))


def weight_grid(steps: int = 10) -> list[tuple[float, float, float]]:
    """Weights that sum to one, in equal steps, the first of them positive."""
    return [(a / steps, b / steps, (steps - a - b) / steps) for b in range(steps) for a in range(1, steps + 1 - b)]


def search_weights(pairs: DataFrame, name: str, addr: str, num: str, threshold: float, grid: list[tuple[float, float, float]] | None = None) -> DataFrame:
    """wn, wa, accepted, total for each weighting: how many queries' best pairs reach the threshold, and the sum of their scores.

    A query's best score under each weighting is one column of a single aggregation, so pairs are shuffled once whatever
    the size of the grid, and only one row per query meets the weightings.
    """
    grid = weight_grid() if grid is None else grid
    score = lambda a, b, c: F.round(a * F.col(name) + b * F.coalesce(addr, F.lit(0.0)) + c * F.col(num), 6)
    best = pairs.groupBy("query_id").agg(*[F.max(score(*w)).alias(f"g{i}") for i, w in enumerate(grid)])
    each = best.select(F.explode(F.array(*[F.struct(F.lit(a).alias("wn"), F.lit(b).alias("wa"), F.col(f"g{i}").alias("s")) for i, (a, b, _) in enumerate(grid)])).alias("g")).select("g.*")
    return each.groupBy("wn", "wa").agg(F.count_if(F.col("s") >= threshold).alias("accepted"), F.round(F.sum("s"), 6).alias("total"))


def best_prefix(probabilities, h: float | None, miss: float, t: float = 1.0, most: int = 12) -> int:
    """How many of the most likely matches to predict for the greatest expected F0.5.

    Matches are independent given that there is one (chance h); M more lie outside the list, cut Poisson. The number of
    true ones among the first k and among the others are convolved by dynamic programming.
    """
    p = sorted((x for x in probabilities if x is not None), reverse=True)[:most]
    if t != 1.0:
        p = [1 / (1 + math.exp(-math.log(q / (1 - q)) / t)) for q in (min(max(x, 1e-6), 1 - 1e-6) for x in p)]
    if h is not None:
        h = min(max(h, 1e-6), 1.0)
        p = [min(x / h, 1.0) for x in p]
    rate = miss / (1 - miss) * sum(p)
    tail = np.array([math.exp(-rate) * rate**m / math.factorial(m) for m in range(5)])
    tail /= tail.sum()
    heads = [np.ones(1)]
    for x in p:
        heads.append(np.convolve(heads[-1], [1 - x, x]))
    rest = [tail]
    for x in reversed(p):
        rest.append(np.convolve(rest[-1], [1 - x, x]))
    rest.reverse()
    best, value = 0, float(rest[0][0]) * (1 if h is None else h) + (0 if h is None else 1 - h)
    for k in range(1, len(p) + 1):
        a, b = np.arange(k + 1)[:, None], np.arange(len(rest[k]))[None, :]
        gain = float((heads[k][:, None] * rest[k][None, :] * 1.25 * a / (k + 0.25 * (a + b))).sum()) * (1 if h is None else h)
        if gain > value + 1e-15:
            best, value = k, gain
    return best


def decode(pairs: DataFrame, has_match: DataFrame | None = None, p: str = "p", miss: float = 0.05, t: float = 1.0, most: int = 12) -> DataFrame:
    """The pairs to predict: per S1 the best prefix of its pairs by p. One shuffle by S1; lists are cut to ``most``."""
    listed = pairs.groupBy("s1_id").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.col(p).alias("p"), (-F.col("query_id")).alias("q"))), asc=False), 1, most).alias("l"))
    listed = listed.withColumn("h", F.lit(None).cast("double")) if has_match is None else listed.join(has_match.select("s1_id", "h"), "s1_id", "left")

    @F.pandas_udf(IntegerType())
    def k_of(ps: pd.Series, hs: pd.Series) -> pd.Series:
        return pd.Series([best_prefix(x, None if pd.isna(h) else float(h), miss, t, most) for x, h in zip(ps, hs)])

    kept = listed.withColumn("k", k_of(F.col("l.p"), F.col("h"))).select("s1_id", "k", F.posexplode("l").alias("pos", "x"))
    return kept.where(F.col("pos") < F.col("k")).select((-F.col("x.q")).alias("query_id"), "s1_id", F.col("x.p").alias(p))


def isotonic_bins(rows: DataFrame, p: str, label: str, tie: str, bins: int = 2000, cells: int = 4096) -> DataFrame:
    """bin, mean p, mean label and count of equally full bins (the first ones take one row more, as ntile has it).

    Rows are ranked cell by cell of p, and the cells' sizes, at most ``cells`` + 1 rows, give each cell's first rank; so
    no task sorts all rows, unless all have one p.
    """
    cell = F.floor(F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)) * cells).cast("int")
    own = rows.select(F.col(p).alias("__p"), F.col(label).cast("double").alias("__y"), F.col(tie).alias("__t"), cell.alias("__c"))
    sizes = own.groupBy("__c").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumns({
        "__before": F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__c")) - F.col("__n"), "__all": F.sum("__n").over(Window.partitionBy(F.lit(0))),
    }).drop("__n")
    rank = F.row_number().over(Window.partitionBy("__c").orderBy("__p", "__t")) + F.col("__before")
    ranked = own.join(F.broadcast(before), "__c").withColumn("__r", rank)
    least, more = F.floor(F.col("__all") / bins), F.col("__all") % bins
    wide = more * (least + 1)
    number = F.when(F.col("__r") <= wide, F.ceil(F.col("__r") / (least + 1))).otherwise(more + F.ceil((F.col("__r") - wide) / F.greatest(least, F.lit(1))))
    return ranked.groupBy(number.cast("int").alias("bin")).agg(F.avg("__p").alias("mean_p"), F.avg("__y").alias("mean_label"), F.count(F.lit(1)).alias("n"))


def fit_isotonic(rows: DataFrame, p: str, label: str):
    """A fitted isotonic regression of the label on p (pool-adjacent-violators; predictions interpolate and clamp)."""
    from pyspark.ml.regression import IsotonicRegression

    return IsotonicRegression(featuresCol=p, labelCol=label, predictionCol="calibrated").fit(rows)


def fit_gbt(rows: DataFrame, features: list[str], label: str = "label", trees: int = 20, depth: int = 5, seed: int = 7, weight: str | None = None):
    """A boosted-tree pipeline; a null feature becomes -1 with an indicator beside it. weight: a column of how often a row counts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import SQLTransformer, VectorAssembler

    filled = ", ".join(f"coalesce({c}, -1D) AS {c}__f, CAST({c} IS NULL AS DOUBLE) AS {c}__m" for c in features)
    trained = GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=0.05, featureSubsetStrategy="0.8", seed=seed)
    stages = [
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"{c}__{k}" for c in features for k in "fm"], outputCol="features"),
        trained.setWeightCol(weight) if weight else trained,
    ]
    return Pipeline(stages=stages).fit(rows)


def full_model(rows: DataFrame, features: list[str], rounds: list[int], label: str = "label", more: float = 1.1, **options):
    """A model of all rows, with ``more`` times as many trees as the cross-validated ones had on average."""
    return fit_gbt(rows, features, label, trees=max(1, round(more * sum(rounds) / len(rounds))), **options)


def predict(model, rows: DataFrame, out: str) -> DataFrame:
    """rows with the model's probability of the positive class; the model's own columns go."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).select(*[F.col(f"`{c}`") for c in rows.columns], vector_to_array("probability")[1].alias(out))


#: Rows that a task of a fit gets, as long as there are partitions; a fit is many short jobs, so more tasks of fewer rows cost more than they share.
TASK_ROWS = 50_000


def _tree(node):
    """A tree of plain tuples (feature, threshold, left, right), or a leaf's prediction."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def _leaves(tree, x: list[np.ndarray]):
    if isinstance(tree, float):
        return tree
    at, threshold, left, right = tree
    return np.where(x[at] <= threshold, _leaves(left, x), _leaves(right, x))


def plain_model(model) -> list[tuple]:
    """Weight and tree of each tree of a pipeline of fit_gbt."""
    gbt = model.stages[-1]
    return [(float(w), _tree(t._java_obj.rootNode())) for w, t in zip(gbt.treeWeights, gbt.trees)]


def probabilities(trees: list[tuple], x: list[np.ndarray]) -> np.ndarray:
    """The positive class's probabilities as the model itself has them; x holds each feature, then whether it is missing."""
    margin = np.zeros(len(x[0]))
    for weight, tree in trees:
        margin += weight * _leaves(tree, x)
    return 1 - 1 / (1 + np.exp(2 * margin))


def cross_validated(rows: DataFrame, features: list[str], out: str, label: str = "label", fold: str = "fold", folds: tuple[int, ...] = (1, 2, 3, 4), **options) -> DataFrame:
    """rows with the probability from a model that has not seen their fold; rows of no such fold get the mean of all models.

    Rows that agree in fold, label and features are learnt from once, with their number as weight. All models score in one
    pass over Arrow batches; a missing feature is null, as in fit_gbt.
    """
    kinds = rows.where(F.col(fold).isin(*folds)).groupBy(fold, label, *features).agg(F.count(F.lit(1)).cast("double").alias("__weight")).cache()
    few = kinds.coalesce(max(1, -(-kinds.count() // TASK_ROWS)))
    models = {k: plain_model(fit_gbt(few.where(F.col(fold) != k), features, label, weight="__weight", **options)) for k in folds}
    kinds.unpersist()

    @F.pandas_udf("double")
    def scored(own: pd.Series, *columns: pd.Series) -> pd.Series:
        x = [v for c in columns for v in (c.fillna(-1.0).to_numpy(float), c.isna().to_numpy(float))]
        p, rest = np.zeros(len(own)), np.ones(len(own), bool)
        for k, trees in models.items():
            of = (own == k).to_numpy()
            p[of], rest = probabilities(trees, [v[of] for v in x]), rest & ~of
        if rest.any():
            others = [v[rest] for v in x]
            p[rest] = sum(probabilities(trees, others) for trees in models.values()) / len(models)
        return pd.Series(p)

    return rows.withColumn(out, scored(F.col(fold).cast("double"), *[F.col(c).cast("double") for c in features]))


def importance(spark, model, features: list[str]) -> DataFrame:
    """feature and percent of a pipeline of fit_gbt; the vector holds each feature and the mark of its absence."""
    gains = model.stages[-1].featureImportances.toArray().reshape(len(features), 2).sum(axis=1)
    total = float(gains.sum()) or 1.0
    return spark.createDataFrame([(f, round(100 * float(g) / total, 4)) for f, g in zip(features, gains)], "feature string, percent double")
