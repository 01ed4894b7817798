"""Classifiers, stacking and calibration with pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlake.functions.expr import dbl
from creditlake.operators.cleaning import fill_by_type
from creditlake.operators.evaluate import roc_auc
from creditlake.operators.sampling import with_class_weight

#: Trees that validated boosting may take.
MOST_TREES = 2000
LABEL, FEATURES, SCORE, WEIGHT = "label", "features", "score", "weight"

def assembled(df: DataFrame, numeric: list[str], categorical: list[str], target: str, keep: list[str]) -> DataFrame:
    """Rows ready for training: filled, indexed, assembled, with a label and a balanced class weight."""
    filled = fill_by_type(df.select(*keep, target, *numeric, *categorical), but=(target, *keep))
    stages = [
        StringIndexer(inputCols=categorical, outputCols=[f"{c}_ix" for c in categorical], handleInvalid="keep",
                      stringOrderType="alphabetAsc")
    ] if categorical else []
    stages.append(VectorAssembler(inputCols=[*numeric, *[f"{c}_ix" for c in categorical]], outputCol=FEATURES))
    ready = Pipeline(stages=stages).fit(filled).transform(filled).withColumn(LABEL, dbl(target))
    return with_class_weight(ready, LABEL, WEIGHT)


def feature_pipeline(numeric: list[str], categorical: list[str], learner) -> Pipeline:
    """Indexing, assembling and learning as one persistable pipeline."""
    indexer = StringIndexer(inputCols=categorical, outputCols=[f"{c}_ix" for c in categorical], handleInvalid="keep",
                            stringOrderType="alphabetAsc")
    assembler = VectorAssembler(inputCols=[*numeric, *[f"{c}_ix" for c in categorical]], outputCol=FEATURES)
    return Pipeline(stages=[indexer, assembler, learner])


def widest_category(df: DataFrame, features: str = FEATURES) -> int:
    """The most values that any nominal feature of an assembled vector has; 0 if its metadata names none."""
    nominal = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", [])
    return max((len(a.get("vals", ())) or a.get("num_vals", 0) for a in nominal), default=0)


class BoostedTrees(GBTClassifier):
    """Boosted trees that take as many bins as the widest category of the training data needs."""

    def _fit(self, dataset: DataFrame):
        bins = max(self.getMaxBins(), widest_category(dataset, self.getFeaturesCol()), 2)
        return GBTClassifier._fit(self.copy({self.maxBins: bins}), dataset)


def boosted(validation: str | None = None, **params) -> BoostedTrees:
    """Gradient-boosted trees on weighted rows; with a validation flag column, boosting stops when it stops helping, and
    there is room for MOST_TREES."""
    settings = {"maxIter": MOST_TREES if validation else 20, "maxDepth": 4, "stepSize": 0.1, "seed": 42, "validationTol": 0.001, **params}
    if validation:
        settings["validationIndicatorCol"] = validation
    return BoostedTrees(labelCol=LABEL, featuresCol=FEATURES, weightCol=WEIGHT, **settings)


def positive(probability: str = "probability") -> Column:
    return vector_to_array(F.col(probability))[1]


def scored(model: Model, df: DataFrame, name: str = SCORE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the probability of the positive class, without the model's other outputs."""
    out = model.transform(df).withColumn(name, positive())
    return out.select(*[c for c in df.columns if c != name], name) if not keep else out.select(*keep, name)


def in_parallel(jobs: list[Callable], width: int = 4) -> list:
    """Run independent driver-side fits together, so that their Spark jobs overlap."""
    with ThreadPoolExecutor(width) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(j)) for j in jobs]]


def fold_aucs(oof: DataFrame, target: str = LABEL, score: str = SCORE) -> DataFrame:
    """AUC of every fold in one job, with the mean and standard deviation over folds."""
    table = roc_auc(oof, target, score, ["fold"])
    spread = table.agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"))
    return table.withColumn("_s", spread.select(F.struct("*")).scalar()).select(
        "fold", "auc", F.col("_s.mean_auc").alias("mean_auc"), F.col("_s.std_auc").alias("std_auc")
    )


def logistic_on(df: DataFrame, columns: list[str], target: str, reg: float = 0.0) -> PipelineModel:
    """Logistic regression on score columns; the meta-model of a stack, or Platt scaling for one column."""
    assembler = VectorAssembler(inputCols=columns, outputCol="score_vector")
    learner = LogisticRegression(labelCol=target, featuresCol="score_vector", regParam=reg, maxIter=100)
    return Pipeline(stages=[assembler, learner]).fit(df)


def platt(df: DataFrame, score: str, target: str, name: str = "calibrated") -> DataFrame:
    model = logistic_on(df, [score], target)
    return scored(model, df, name)


def importances(model, names: list[str]) -> DataFrame:
    """Share of the total gain per feature, in percent. One row per model column."""
    values = model.featureImportances.toArray()
    total = float(values.sum()) or 1.0
    rows = [(n, float(v), float(v) / total * 100) for n, v in zip(names, values)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance_gain double, pct_importance double")


def average_importances(models: list[Model], names: list[str]) -> DataFrame:
    """Gain shares averaged over models trained on the same columns, with their standard deviation."""
    tables = reduce(DataFrame.unionByName, [importances(m, names) for m in models])
    return tables.groupBy("feature").agg(
        F.avg("pct_importance").alias("pct_importance"), F.stddev_pop("pct_importance").alias("pct_importance_std")
    )


def top_features(model, names: list[str], k: int) -> DataFrame:
    return importances(model, names).orderBy(F.desc("importance_gain"), "feature").limit(k)
