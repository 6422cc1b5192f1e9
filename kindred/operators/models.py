"""Pair classifiers on Spark ML: boosted trees with row weights, a two-model blend, and the feature ablation."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import writers
from . import boosting, metrics

SEED = 42
#: Fits at a time; each holds its rows in memory or on disk while it lasts.
FITS = 4
#: Memory in which one task fits a model, of 80 bytes a row and 2 a value. Spark's trees, dealt over all tasks, are fitted to more rows.
TASK_BYTES = 1 << 29


def _weighted(df: DataFrame, label: str, negative: float) -> DataFrame:
    return df.withColumn("__w", F.when(F.col(label) == 1, 1.0).otherwise(negative)).withColumn("__y", F.col(label).cast("double"))


def boosted(df: DataFrame, columns: list[str], label: str = "is_match", negative: float = 1.0, trees: int = 40, depth: int = 5, rate: float = 0.1, validation: str | None = None, tolerance: float = 0.01) -> PipelineModel:
    """Gradient-boosted trees; negative: weight of a negative row (1 main, 2 hybrid, 4 sieve).

    validation: a boolean column; rows where it is true are not fitted to, and trees stop once their loss there falls by less than tolerance.
    """
    x = VectorAssembler(inputCols=columns, outputCol="__x", handleInvalid="keep")
    if validation:
        g = GBTClassifier(featuresCol="__x", labelCol="__y", weightCol="__w", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=SEED, validationIndicatorCol=validation, validationTol=tolerance)
        return Pipeline(stages=[x, g]).fit(_weighted(df, label, negative))
    g = GBTClassifier(featuresCol="__x", labelCol="__y", weightCol="__w", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=SEED)
    return Pipeline(stages=[x, g]).fit(_weighted(df, label, negative))


def forest(df: DataFrame, columns: list[str], label: str = "is_match", negative: float = 4.0, trees: int = 40, depth: int = 8) -> PipelineModel:
    x = VectorAssembler(inputCols=columns, outputCol="__x", handleInvalid="keep")
    return Pipeline(stages=[x, RandomForestClassifier(featuresCol="__x", labelCol="__y", weightCol="__w", numTrees=trees, maxDepth=depth, seed=SEED)]).fit(_weighted(df, label, negative))


def predict(model: PipelineModel, df: DataFrame, score: str = "score") -> DataFrame:
    got = model.transform(df).withColumn(score, vector_to_array("probability")[1])
    return got.select(*df.columns, score)


def blend(first: Column, second: Column | None, weight: float = 0.6) -> Column:
    """0.6 and 0.4 of two probabilities; the first alone if there is no second."""
    return first if second is None else weight * first + (1 - weight) * second


def importances(model: PipelineModel, columns: list[str], spark) -> DataFrame:
    v = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(c, float(x)) for c, x in zip(columns, v)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def at_once(spark, fits: list, n: int = FITS) -> list:
    """What the fits (functions) give, in their order, n at a time: each is many short jobs, started by the driver, which leave cores idle between them."""
    with ThreadPool(n) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda fit: fit()), fits, 1)


def stopped(train: DataFrame, val: DataFrame, columns: list[str], trees: int, rate: float, patience: int) -> PipelineModel:
    """Spark's boosted trees up to the least loss on val before patience trees have not lowered it: all are fitted, then as many as are kept."""
    sc = train.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:  # without, every tree's task would hold the plans of all before it
        sc.setCheckpointDir(writers.shared_dir(train.sparkSession))
    model = boosted(train, columns, trees=trees, rate=rate)
    least, n = float("inf"), 0
    for m, loss in enumerate(model.stages[-1].evaluateEachIteration(model.stages[0].transform(_weighted(val, "is_match", 1.0))), 1):
        if m - n > patience:
            break
        if loss < least:
            least, n = loss, m
    return model if n == trees or not n else boosted(train, columns, trees=n, rate=rate)


def ablation(train: DataFrame, val: DataFrame, stages: dict[str, list[str]], ids: DataFrame, truth: DataFrame, absolute: float = 0.5, trees: int = boosting.TREES, rate: float = boosting.RATE, patience: int = boosting.PATIENCE) -> DataFrame:
    """(stage, features, precision, recall, f) of growing column sets on one split, fitted several at a time.

    Fitting ends early by the loss on val, as in the main variant.
    """
    from . import assign

    spark, rows = train.sparkSession, train.count()
    ids, truth = writers.kept(ids.select("s1_id"), "ids"), writers.kept(truth.select("s1_id", "query_id"), "truth")  # read by every stage, whose plans would each hold how they are made
    small = {name: columns for name, columns in stages.items() if rows * (80 + 2 * len(columns)) <= TASK_BYTES}
    scored = {}
    if small:
        packed = writers.kept(boosting.packed(train, val, sorted(set().union(*small.values()))), "packed")
        names = sorted(small, key=lambda name: -len(small[name]))  # the longest first
        scored |= zip(names, at_once(spark, [lambda c=small[name]: writers.kept(boosting.scores(packed, c, trees, rate, patience), "scores") for name in names], len(names)))
    large = {name: columns for name, columns in stages.items() if name not in small}
    scored |= zip(large, at_once(spark, [lambda c=columns: predict(stopped(train, val, c, trees, rate, patience), val) for columns in large.values()]))
    out = None
    for name, columns in stages.items():
        got = metrics.macro(metrics.counts(ids, truth, assign.main(scored[name], absolute, 0.0))).select(F.lit(name).alias("stage"), F.lit(len(columns)).alias("features"), "precision", "recall", "f")
        out = got if out is None else out.unionByName(got)
    return out
