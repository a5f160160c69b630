"""Metrics, threshold search, stacking and model plumbing."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def log_mae(df: DataFrame, kind: str, truth: str, pred: str) -> DataFrame:
    """Mean over types of the logarithm of the mean absolute error."""
    per = df.groupBy(kind).agg(F.avg(F.abs(F.col(truth) - F.col(pred))).alias("mae"))
    return per.agg(F.avg(F.log("mae")).alias("score"))


def mcc(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Matthews correlation, 0 where it isn't defined."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    c = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    bottom = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select("tp", "tn", "fp", "fn", F.coalesce(F.try_divide(tp * tn - fp * fn, F.nullif(bottom, F.lit(0.0))), F.lit(0.0)).alias("mcc"))


def mcc_by_threshold(df: DataFrame, truth: str, score: str, thresholds: list[float]) -> DataFrame:
    """MCC at each threshold, from one aggregate over the exploded grid."""
    t, p = F.col(truth) == 1, F.col(score) > F.col("threshold")
    grid = df.select(truth, score, F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"))
    c = grid.groupBy("threshold").agg(*[F.count_if(x).cast("double").alias(n) for n, x in (("tp", t & p), ("tn", ~t & ~p), ("fp", ~t & p), ("fn", t & ~p))])
    bottom = F.sqrt((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")))
    return c.select("threshold", F.coalesce(F.try_divide(F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn"), F.nullif(bottom, F.lit(0.0))), F.lit(0.0)).alias("mcc"))


def walk_thresholds(scores: list[tuple[float, float]], offset: float = 0.01) -> float:
    """Sequential choice over a small grid: a score must beat the best by ``offset``, or may fall short by it past ``1 - current``."""
    best, current = -1.0, 0.0
    for t, s in scores:
        if s > best + (-offset if t < 1 - current else offset):
            best, current = s, t
    return current


def group_error(df: DataFrame, key: str, truth: str, pred: str) -> DataFrame:
    """Squared error of each group: mean, deviation and share of the total."""
    e = F.pow(F.col(truth) - F.col(pred), 2)
    per = df.groupBy(key).agg(F.avg(e).alias("mean"), F.coalesce(F.stddev_samp(e), F.lit(0.0)).alias("std"), F.sum(e).alias("_s"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("_s").alias("_all")))).select(key, "mean", "std", (F.col("_s") / F.col("_all")).alias("share"))


def best_blend(df: DataFrame, truth: str, a: str, b: str, *, step: float = 0.01) -> DataFrame:
    """Linear stacking: of alpha = 0..1, the first with the least mean absolute error of alpha a + (1 - alpha) b."""
    alphas = [round(i * step, 6) for i in range(int(round(1 / step)) + 1)]
    grid = df.select(truth, a, b, F.explode(F.array(*[F.lit(x) for x in alphas])).alias("alpha"))
    err = grid.groupBy("alpha").agg(F.avg(F.abs(F.col(truth) - F.col("alpha") * F.col(a) - (1 - F.col("alpha")) * F.col(b))).alias("mae"))
    return err.agg(F.min_by("alpha", F.struct("mae", "alpha")).alias("alpha"), F.min("mae").alias("mae"))


def robust_blend(df: DataFrame, models: list[str], weights: list[float], *, least: float = 5.0, ratio: float = 2.0) -> DataFrame:
    """Weighted mean of a row's predictions without those whose mean distance to the others is far over the average (3 models or more)."""
    values = F.array(*[F.col(m).cast("double") for m in models])
    n = len(models)
    away = F.transform(values, lambda x: F.aggregate(values, F.lit(0.0), lambda s, y: s + F.abs(x - y)) / max(1, n - 1))
    out = df.withColumns({"_v": values, "_d": away}).withColumn("_avg", F.aggregate("_d", F.lit(0.0), lambda s, x: s + x) / n)
    keep = lambda i: (F.lit(n < 3)) | (F.col("_avg") <= least) | (F.get("_d", i) / F.col("_avg") < ratio)
    top = sum((F.when(keep(i), F.col(m) * w).otherwise(0.0) for i, (m, w) in enumerate(zip(models, weights, strict=True))), F.lit(0.0))
    bottom = sum((F.when(keep(i), F.lit(w)).otherwise(0.0) for i, w in enumerate(weights)), F.lit(0.0))
    return out.withColumn("blend", F.try_divide(top, F.nullif(bottom, F.lit(0.0)))).drop("_v", "_d", "_avg")


def majority(df: DataFrame, key: str, vote: str) -> DataFrame:
    return df.groupBy(key).agg((F.avg(vote) > 0.5).cast("int").alias("vote"))


def permuted(df: DataFrame, column: str, *, seed: int = 0, key: str = "row_id") -> DataFrame:
    """``column`` shuffled among the rows: its values in one hash order are dealt to the keys in another."""
    order = lambda s: F.row_number().over(W.partitionBy("_b").orderBy(F.xxhash64(F.col(key), F.lit(s)), key))
    # inside 64 hash blocks, so that no block is the whole table
    base = df.withColumn("_b", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(64)))
    values = base.select("_b", order(seed + 1).alias("_r"), F.col(column).alias("_value"))
    return base.withColumn("_r", order(seed + 2)).join(values, ["_b", "_r"]).withColumn(column, F.col("_value")).select(*df.columns)


def permutation_importance(df: DataFrame, columns: list[str], metric: Callable[[DataFrame], float], *, seed: int = 0) -> dict[str, float]:
    base = metric(df)
    return {c: metric(permuted(df, c, seed=seed)) - base for c in columns}


def fit_by_type(train: DataFrame, kind: str, features: list[str], label: str, **options):
    """One boosted-tree model for each type; types are few and found once."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    ready = VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="keep").transform(train)
    kinds = [r[0] for r in ready.select(kind).distinct().orderBy(kind).collect()]
    return {k: GBTRegressor(featuresCol="_f", labelCol=label, lossType="absolute", **options).fit(ready.where(F.col(kind).eqNullSafe(F.lit(k)))) for k in kinds}


def adversarial_auc(train: DataFrame, test: DataFrame, features: list[str], **options) -> float:
    """How well trees tell the two tables apart: area under the curve of a hash-held-out half."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    both = train.select(*features).withColumn("_y", F.lit(0.0)).unionByName(test.select(*features).withColumn("_y", F.lit(1.0)))
    ready = VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="keep").transform(both).withColumn("_half", F.pmod(F.xxhash64(*features, F.lit(3)), F.lit(2)))
    model = GBTClassifier(featuresCol="_f", labelCol="_y", maxIter=options.pop("maxIter", 5), **options).fit(ready.where("_half = 0"))
    return BinaryClassificationEvaluator(labelCol="_y").evaluate(model.transform(ready.where("_half = 1")))


def rolling_origin(df: DataFrame, months: list[int], fit_score: Callable[[DataFrame, DataFrame], float], *, ahead: int = 2) -> list[tuple[int, float]]:
    """Train up to each month, score the next ``ahead`` ones."""
    return [(m, fit_score(df.where(F.col("month") <= m), df.where((F.col("month") > m) & (F.col("month") <= m + ahead)))) for m in months]


def linspace(lo: float, hi: float, n: int) -> list[float]:
    return [float(x) for x in np.linspace(lo, hi, n)]


def stratified_fold(df: DataFrame, key: str, label: str, k: int, *, blocks: int = 64) -> DataFrame:
    """Deterministic fold of each row with equal shares of every label: places inside (label, hash block), modulo ``k``."""
    base = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks)))
    place = F.row_number().over(W.partitionBy(label, "_b").orderBy(F.xxhash64(F.col(key), F.lit(1)), key))
    return base.withColumn("fold", ((place + F.col("_b")) % k).cast("int")).drop("_b")


def fit_contributions(train: DataFrame, features: list[str], contributions: list[str], **options) -> dict:
    """A linear model for each contribution of a target."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    ready = VectorAssembler(inputCols=features, outputCol="_f").transform(train)
    return {c: LinearRegression(featuresCol="_f", labelCol=c, **options).fit(ready) for c in contributions}


def summed_contributions(models: dict, df: DataFrame, features: list[str]) -> DataFrame:
    """Predictions of all contributions and their sum, ``prediction``."""
    from pyspark.ml.feature import VectorAssembler

    out = VectorAssembler(inputCols=features, outputCol="_f").transform(df)
    for c, m in models.items():
        out = m.copy().setPredictionCol(f"{c}_hat").transform(out)
    return out.withColumn("prediction", sum((F.col(f"{c}_hat") for c in models), F.lit(0.0))).drop("_f")


def save_model(model, path: str) -> None:
    from pyspark.ml import PipelineModel

    PipelineModel(stages=[model]).write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path).stages[0]


def ranked_importance(spark: SparkSession, importance: dict[str, float]) -> DataFrame:
    """(feature, importance, rank), most important first, ties by name."""
    df = spark.createDataFrame(list(importance.items()), "feature string, importance double")
    return df.withColumn("rank", F.row_number().over(W.orderBy(F.desc("importance"), "feature"))).orderBy("rank")  # a row for each feature


def drop_unhelpful(df: DataFrame, columns: list[str], metric: Callable[[DataFrame, list[str]], float], *, margin: float = 0.005) -> list[str]:
    """Columns left after dropping, one at a time, each whose absence costs at most ``margin`` of the score (higher is better)."""
    left, best = list(columns), metric(df, list(columns))
    for c in columns:
        rest = [x for x in left if x != c]
        if rest and (score := metric(df, rest)) >= best - margin:
            left, best = rest, max(best, score)
    return left


def biclusters(df: DataFrame, row: str, column: str, value: str, k: int, *, cells: int = 4_000_000, seed: int = 0) -> tuple[dict, dict]:
    """Spectral biclusters of a small dense matrix: rows and columns to cluster numbers. Larger matrices than ``cells`` are an error."""
    got = df.groupBy(row, column).agg(F.sum(value).alias("v"))
    rows, columns = ([r[0] for r in got.select(c).distinct().orderBy(c).limit(cells + 1).collect()] for c in (row, column))
    if len(rows) * len(columns) > cells:
        raise ValueError("the matrix is too large")
    at, to = {x: i for i, x in enumerate(rows)}, {x: i for i, x in enumerate(columns)}
    m = np.zeros((len(rows), len(columns)))
    for r, c, v in got.collect():
        m[at[r], to[c]] = v
    scale = lambda s: 1 / np.sqrt(np.maximum(s, 1e-12))
    u, _, v = np.linalg.svd(scale(m.sum(axis=1))[:, None] * m * scale(m.sum(axis=0))[None, :], full_matrices=False)
    points = np.concatenate([u[:, 1:k], v[1:k].T])
    centres = points[np.random.default_rng(seed).choice(len(points), k, replace=False)]
    for _ in range(50):
        near = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([points[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(k)])
    return dict(zip(rows, near[: len(rows)].tolist(), strict=True)), dict(zip(columns, near[len(rows) :].tolist(), strict=True))


def timed(name: str, say: Callable[[str], None] = print):
    """Decorator: says how long a step's planning and driver work took."""

    def wrap(f):
        @functools.wraps(f)
        def run(*args, **kwargs):
            start = time.perf_counter()
            try:
                return f(*args, **kwargs)
            finally:
                say(f"{name}: {time.perf_counter() - start:.2f} s")

        return run

    return wrap
