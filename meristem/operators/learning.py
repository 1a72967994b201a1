"""Supervised learning over ``rows(id, vec, label)``: repeated folds, grid search, held-out scores, importances, persistence.

Everything is a ``pyspark.ml`` estimator on the whole table. Folds are a hash of the row's id, so they need no shuffle and are the
same on every run; each class lies in all folds in proportion, up to chance.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name: (estimator, grid). Label and features columns are set by ``estimator``.
CLASSIFIERS: dict[str, tuple[Callable[[], Estimator], dict[str, list]]] = {
    "logistic": (lambda: C.LogisticRegression(maxIter=50), {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]}),
    "svm": (lambda: C.OneVsRest(classifier=C.LinearSVC(maxIter=50, regParam=0.01)), {}),
    "tree": (lambda: C.DecisionTreeClassifier(seed=1), {"maxDepth": [3, 5, 8]}),
    "forest": (lambda: C.RandomForestClassifier(seed=1), {"maxDepth": [5, 8], "numTrees": [20, 50]}),
    "boosted": (lambda: C.OneVsRest(classifier=C.GBTClassifier(maxIter=20, seed=1)), {}),
    "gaussian_bayes": (lambda: C.NaiveBayes(modelType="gaussian"), {"smoothing": [0.5, 1.0]}),
    "factorisation": (lambda: C.OneVsRest(classifier=C.FMClassifier(seed=1)), {}),
}
REGRESSORS: dict[str, tuple[Callable[[], Estimator], dict[str, list]]] = {
    "linear": (lambda: R.LinearRegression(), {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]}),
    "general_linear": (lambda: R.GeneralizedLinearRegression(), {"regParam": [0.0, 0.1]}),
    "tree": (lambda: R.DecisionTreeRegressor(seed=1), {"maxDepth": [3, 5, 8]}),
    "forest": (lambda: R.RandomForestRegressor(seed=1), {"maxDepth": [5, 8], "numTrees": [20, 50]}),
    "boosted": (lambda: R.GBTRegressor(seed=1), {"maxDepth": [3, 5]}),
    "factorisation": (lambda: R.FMRegressor(seed=1), {"factorSize": [4, 8]}),
}


def estimator(name: str, kind: str = "class") -> tuple[Estimator, dict[str, list]]:
    """An unfitted estimator of the catalogue and its grid; ``kind`` is class or value."""
    make, grid = (CLASSIFIERS if kind == "class" else REGRESSORS)[name]
    return make().setFeaturesCol("features").setLabelCol("label"), grid


def folds(rows: DataFrame, n: int = 10, repeats: int = 1, key: str = "id") -> DataFrame:
    """``rows`` once for each of ``repeats``, with ``repeat`` and the ``fold`` (0 to n - 1) that holds the row out."""
    out = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return out.withColumn("fold", _fold(F.concat_ws(":", F.col(key).cast("string"), F.col("repeat").cast("string")), n))


def _fold(text: Column, n: int) -> Column:
    return (F.conv(F.left(F.md5(text.cast("binary")), F.lit(8)), 16, 10).cast("long") % n).cast("int")


def _features(rows: DataFrame) -> DataFrame:
    out = rows.where(F.col("vec").isNotNull()).withColumn("features", array_to_vector("vec"))
    return out.where(F.col("label").isNotNull()).withColumn("label", F.col("label").cast("double")) if "label" in rows.columns else out


def _evaluator(kind: str, metric: str | None) -> MulticlassClassificationEvaluator | RegressionEvaluator:
    return MulticlassClassificationEvaluator(metricName=metric or "f1") if kind == "class" else RegressionEvaluator(metricName=metric or "rmse")


def search(rows: DataFrame, name: str, kind: str = "class", n: int = 3, metric: str | None = None, grid: dict[str, list] | None = None) -> tuple[Model, dict[str, float]]:
    """(model refitted on all rows, best parameters) of a grid search over ``n`` hash folds. An empty grid is a plain fit."""
    one, own = estimator(name, kind)
    grid = own if grid is None else grid
    data = _features(rows)
    if not grid:
        return one.fit(data), {}
    builder = ParamGridBuilder()
    for parameter, values in grid.items():
        builder = builder.addGrid(one.getParam(parameter), values)
    inner = data.withColumn("__inner", _fold(F.concat(F.lit("inner:"), F.col("id").cast("string")), n))
    found = CrossValidator(estimator=one, estimatorParamMaps=builder.build(), evaluator=_evaluator(kind, metric), foldCol="__inner", numFolds=n).fit(inner)
    best = found.bestModel
    return best, {p: best.getOrDefault(p) for p in grid}


def predict(model: Model, rows: DataFrame) -> DataFrame:
    """``rows`` with ``predicted`` and, where the model gives them, class probabilities ``probability`` (array)."""
    out = model.transform(_features(rows)).withColumnRenamed("prediction", "predicted")
    if "probability" in out.columns:
        out = out.withColumn("probability", vector_to_array("probability"))
    return out.drop("features", "rawPrediction")


def held_out(rows: DataFrame, name: str, kind: str = "class", n: int = 5, repeats: int = 1, tune: bool = False) -> tuple[DataFrame, dict[tuple[int, int], Model]]:
    """(id, label, repeat, fold, predicted) of every row by the model that did not see it, and the models by (repeat, fold)."""
    dealt, parts, models = folds(rows, n, repeats), [], {}
    for repeat in range(repeats):
        own = dealt.where(F.col("repeat") == repeat)
        for fold in range(n):
            seen = own.where(F.col("fold") != fold).drop("repeat", "fold")
            model = search(seen, name, kind)[0] if tune else estimator(name, kind)[0].fit(_features(seen))
            models[repeat, fold] = model
            parts.append(predict(model, own.where(F.col("fold") == fold)).select("id", "label", "repeat", "fold", "predicted"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out, models


def class_scores(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, balanced accuracy and macro precision, recall and F1 of rows (label, predicted); a class that is never
    predicted has precision 0."""
    by = by or []
    counts = found.groupBy(*by, F.col("label").cast("double").alias("label"), F.col("predicted").cast("double").alias("predicted")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = counts.select(*by, F.explode(F.array(*[F.struct(F.col(c).alias("class"), F.lit(s).alias("side"), "n", hit.alias("hit")) for s, c in enumerate(("label", "predicted"))])).alias("s")).select(*by, "s.*")
    of = lambda s, c: F.sum(F.when(F.col("side") == s, F.col(c)).otherwise(0))
    each = sides.groupBy(*by, "class").agg(of(0, "hit").alias("hit"), of(0, "n").alias("true"), of(1, "n").alias("said"))
    recall, precision = F.coalesce(F.try_divide("hit", "true"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "said"), F.lit(0.0))
    f1 = F.try_divide(2 * F.col("hit"), F.col("true") + F.col("said"))
    return each.groupBy(*by).agg(
        (F.sum("hit") / F.sum("true")).alias("accuracy"),
        F.avg(F.when(F.col("true") > 0, recall)).alias("balanced"),
        F.avg(precision).alias("precision"),
        F.avg(recall).alias("recall"),
        F.avg(f1).alias("f1"),
        F.sum("true").alias("n"),
    )


def together(models: dict, rows: DataFrame) -> DataFrame:
    """(id, predicted, share, probability): the most frequent class over all models, ties to the smaller, its share of them, and
    the mean probabilities where models give them. Each model reads ``rows`` once."""
    parts = [predict(m, rows.drop("label")) for m in models.values()]
    with_p = all("probability" in p.columns for p in parts)
    keep = ["id", "predicted"] + (["probability"] if with_p else [])
    out = parts[0].select(*keep)
    for part in parts[1:]:
        out = out.unionAll(part.select(*keep))
    votes = out.groupBy("id", "predicted").agg(F.count("*").alias("n")).groupBy("id").agg(F.max(F.struct("n", (-F.col("predicted")).alias("to"))).alias("b"), F.sum("n").alias("all"))
    votes = votes.select("id", (-F.col("b.to") + F.lit(0.0)).alias("predicted"), (F.col("b.n") / F.col("all")).alias("share"))
    if not with_p:
        return votes
    means = out.select("id", F.posexplode("probability").alias("at", "p")).groupBy("id", "at").agg(F.avg("p").alias("p"))
    means = means.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "p"))), lambda x: x["p"]).alias("probability"))
    return votes.join(means, "id")


def importances(model: Model) -> np.ndarray:
    """Classes (or one row) x features: split importances of trees, coefficients of linear models, class means of Gaussian Bayes."""
    if isinstance(model, C.OneVsRestModel):
        return np.vstack([importances(m) for m in model.models])
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()[None, :]
    if hasattr(model, "coefficientMatrix"):
        return model.coefficientMatrix.toArray()
    if hasattr(model, "coefficients"):
        return model.coefficients.toArray()[None, :]
    if hasattr(model, "theta"):
        return model.theta.toArray()
    if hasattr(model, "linear"):
        return model.linear.toArray()[None, :]
    raise ValueError(f"{type(model).__name__} has no importances")


def save(model: Model, path: str) -> None:
    """Writes a model where every executor can read it; an older one at ``path`` is replaced."""
    PipelineModel(stages=[model]).write().overwrite().save(path)


def load(path: str) -> Model:
    return PipelineModel.load(path).stages[0]


def over_folds(found: DataFrame) -> DataFrame:
    """(id, mode, mean, best, score) of rows (id, predicted, p) from several folds: the most frequent prediction (ties to the smaller), the
    mean of each class's probability, and the class (from 0, ties to the smaller) and value of its largest."""
    votes = found.groupBy("id", "predicted").agg(F.count("*").alias("n")).groupBy("id").agg(F.min(F.struct(-F.col("n"), "predicted"))["predicted"].alias("mode"))
    means = found.select("id", F.posexplode("p").alias("class", "v")).groupBy("id", "class").agg(F.avg("v").alias("v"))
    means = means.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("class", "v")))["v"].alias("mean"), F.min(F.struct((-F.col("v")).alias("v"), "class")).alias("b"))
    return votes.join(means, "id").select("id", "mode", "mean", F.col("b.class").alias("best"), (-F.col("b.v")).alias("score"))
