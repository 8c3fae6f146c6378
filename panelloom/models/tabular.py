"""Tree-ensemble jobs on Spark ML: fitting, grouped cross-validation, search, explanation."""

from __future__ import annotations

import random
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.nullsafe import clip
from panelloom.models import boosting as B
from panelloom.operators.metrics import regression_metrics
from panelloom.operators.ranks import hash_rank
from panelloom.operators.split import sample_rows
from panelloom.session import materialize

#: Values that a search draws from.
SEARCH_SPACE = {
    "depth": [2, 3, 4, 5], "step": [0.05, 0.1, 0.2, 0.3], "least_rows": [5, 10, 20, 50], "subsample": [0.7, 0.85, 1.0], "columns": [0.6, 0.8, 1.0],
    "ridge": [0.1, 0.5, 1.0, 5.0], "lasso": [0.0, 0.1, 0.5],
}
# Size below which a horizon model is not fitted.
MIN_TRAIN, MIN_TEST = 30, 10


@dataclass
class TreeOptions:
    family: str = "gbt"
    max_iter: int = 20
    max_depth: int = 5
    step: float = 0.1
    subsample: float = 0.8
    seed: int = 42
    extra: dict = field(default_factory=dict)


def _inputs(features: Sequence[str]) -> list:
    # Spark's trees have no branch for missing values, hence the imputer.
    filled = [f"_{f}_filled" for f in features]
    return [
        Imputer(inputCols=list(features), outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="features"),
    ]


def usable_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features that exist and have at least one value (one aggregate row)."""
    present = [f for f in features if f in df.columns]
    seen = df.agg(*[F.count(f).alias(f) for f in present]).first()
    return [f for f in present if seen[f] > 0]


def as_numbers(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f: F.col(f).cast("double") for f in features})


def regressor(features: Sequence[str], label: str, o: TreeOptions) -> Pipeline:
    if o.family == "forest":
        tree = RandomForestRegressor(labelCol=label, numTrees=o.max_iter, maxDepth=o.max_depth, seed=o.seed, **o.extra)
    else:
        tree = GBTRegressor(labelCol=label, maxIter=o.max_iter, maxDepth=o.max_depth, stepSize=o.step,
                            subsamplingRate=o.subsample, seed=o.seed, **o.extra)
    return Pipeline(stages=[*_inputs(features), tree])


def fit_regressor(train: DataFrame, features: Sequence[str], target: str, o: TreeOptions | None = None,
                  log_target: bool = False) -> PipelineModel:
    o = o or TreeOptions()
    label = F.log1p(clip(target, 0)) if log_target else F.col(target).cast("double")
    rows = as_numbers(train.where(F.col(target).isNotNull()), features).withColumn("_label", label)
    return regressor(features, "_label", o).fit(rows.select(*features, "_label"))


def predict(model: PipelineModel | B.Model, df: DataFrame, features: Sequence[str], out: str = "predicted",
            log_target: bool = False, nonnegative: bool = False) -> DataFrame:
    kept = df.columns
    scored = B.predict(model, df, "prediction") if isinstance(model, B.Model) else model.transform(as_numbers(df, features))
    value = F.expm1("prediction") if log_target else F.col("prediction")
    return scored.select(*kept, (clip(value, 0) if nonnegative or log_target else value).alias(out))


def fit_classifier(train: DataFrame, features: Sequence[str], label: str, o: TreeOptions | None = None,
                   n_classes: int = 2) -> PipelineModel:
    o = o or TreeOptions()
    if n_classes == 2 and o.family == "gbt":
        tree = GBTClassifier(labelCol="_label", maxIter=o.max_iter, maxDepth=o.max_depth, stepSize=o.step,
                             subsamplingRate=o.subsample, seed=o.seed)
    else:
        tree = RandomForestClassifier(labelCol="_label", numTrees=o.max_iter, maxDepth=o.max_depth, seed=o.seed)
    rows = as_numbers(train.where(F.col(label).isNotNull()), features).withColumn("_label", F.col(label).cast("double"))
    return Pipeline(stages=[*_inputs(features), tree]).fit(rows.select(*features, "_label"))


def classify(model: PipelineModel, df: DataFrame, features: Sequence[str], probability: str = "p_1",
             predicted: str = "predicted_class") -> DataFrame:
    kept = df.columns
    scored = model.transform(as_numbers(df, features))
    return scored.select(*kept, F.col("prediction").cast("int").alias(predicted),
                         vector_to_array("probability")[1].alias(probability))


def cross_validate(df: DataFrame, features: Sequence[str], target: str, fold: str, k: int,
                   o: TreeOptions | None = None) -> DataFrame:
    """Per-fold r2_train, r2_val, rmse, mae; whole entities share a fold."""
    out = None
    for i in range(k):
        train, held = df.where(F.col(fold) != i), df.where(F.col(fold) == i)
        model = fit_regressor(train, features, target, o)

        def score(rows: DataFrame) -> DataFrame:
            rows = rows.where(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("double"))
            return regression_metrics(predict(model, rows, features), target, "predicted")

        val = score(held).select(F.lit(i).alias("fold"), F.col("r2").alias("r2_val"), "rmse", "mae", "n")
        row = val.join(score(train).select(F.col("r2").alias("r2_train")), F.lit(True))
        out = row if out is None else out.unionByName(row)
    return out


def random_search(df: DataFrame, features: Sequence[str], target: str, fold: str, k: int, trials: int,
                  space: Mapping[str, Sequence], seed: int = 42, parallelism: int = 4) -> tuple[PipelineModel, DataFrame]:
    """Seeded random search, mean validation r2 over grouped folds."""
    rows = as_numbers(df.where(F.col(target).isNotNull()), features).select(
        *features, F.col(target).cast("double").alias("_label"), F.col(fold).cast("int").alias(fold))
    plan = regressor(features, "_label", TreeOptions())
    tree = plan.getStages()[-1]
    rng = random.Random(seed)
    drawn = [{name: rng.choice(list(values)) for name, values in sorted(space.items())} for _ in range(trials)]
    grid = [{tree.getParam(n): v for n, v in d.items()} for d in drawn]
    cv = CrossValidator(estimator=plan, estimatorParamMaps=grid or ParamGridBuilder().build(), numFolds=k, foldCol=fold,
                        evaluator=RegressionEvaluator(labelCol="_label", metricName="r2"), parallelism=parallelism)
    fitted = cv.fit(rows)
    trials_df = df.sparkSession.createDataFrame(
        [(i, str(d), float(m)) for i, (d, m) in enumerate(zip(drawn, fitted.avgMetrics))],
        "trial int, parameters string, mean_r2 double")
    return fitted.bestModel, trials_df


def boosted_folds(df: DataFrame, features: Sequence[str], target: str, fold: str, k: int, options: Mapping[str, B.Boost],
                  train_scores: bool = True) -> DataFrame:
    """(model, fold, n, r2_val, rmse, mae, and r2_train if asked for) of every set of options on every fold, all models fitted in one set of jobs."""
    rows = df.where(F.col(target).isNotNull()).withColumn("_truth", F.col(target).cast("double"))
    jobs = [B.Job(f"{name}|{i}", "rows", features, o, held=i) for name, o in options.items() for i in range(k)]
    models = B.fit(rows, jobs, "_truth", fold=fold)
    found = B.fold_metrics({str(k): m for k, m in models.items()}, {j.name: (j.data, j.held) for j in jobs}, rows, "_truth", fold, train_scores=train_scores)
    at = F.substring_index("model", "|", -1)
    named = found.withColumns({"fold": at.cast("int"), "model": F.col("model").substr(F.lit(1), F.length("model") - F.length(at) - 1)})
    return named.select("model", "fold", "n", "r2_val", "rmse", "mae", *(["r2_train"] if train_scores else []))


def halving_search(df: DataFrame, features: Sequence[str], target: str, fold: str, k: int, trials: int = 80, space: Mapping[str, Sequence] | None = None,
                   first_trees: int = 2, keep: int = 3, seconds: float | None = None, seed: int = 42) -> tuple[B.Boost, DataFrame]:
    """Best options, and (trial, parameters, rung, trees, mean_r2, survived) of a search that stops poor trials early.

    All trials are cross-validated with few trees, a ``keep``-th of them with twice as many, and so on; of the last ``keep`` trials the best wins. The trials of a rung and
    their folds are fitted side by side, as one set of jobs. All rungs are run, however long they take, unless a caller sets ``seconds``: no rung starts
    after them then, and the best trial of the last one wins.
    """
    space = space or SEARCH_SPACE
    rng = random.Random(seed)
    drawn = {i: {name: rng.choice(list(values)) for name, values in sorted(space.items())} for i in range(trials)}
    alive, rung, trees, report, began = list(drawn), 0, first_trees, [], time.monotonic()
    while True:
        options = {str(i): B.Boost(**(drawn[i] | {"trees": trees, "seed": seed})) for i in alive}
        folds = boosted_folds(df, features, target, fold, k, options, train_scores=False)
        found = {int(r["model"]): r["r2"] for r in folds.groupBy("model").agg(F.avg("r2_val").alias("r2")).collect()}
        order = sorted(alive, key=lambda i: (-(found.get(i) if found.get(i) is not None else float("-inf")), i))
        last = len(alive) <= keep or (seconds is not None and time.monotonic() - began > seconds)
        kept = order[:1] if last else order[: max(1, -(-len(alive) // keep))]
        report += [(i, str(drawn[i]), rung, trees, found.get(i), i in kept) for i in alive]
        if last:
            return options[str(kept[0])], df.sparkSession.createDataFrame(report, "trial int, parameters string, rung int, trees int, mean_r2 double, survived boolean")
        alive, rung, trees = kept, rung + 1, 2 * trees


def importances(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)],
                                 "feature string, importance double").orderBy(F.desc("importance"), "feature")


def permutation_attribution(model: PipelineModel, df: DataFrame, features: Sequence[str], target: str, key: str,
                            cap: int | None = None, seed: int = 42, log_target: bool = False) -> DataFrame:
    """Rise in RMSE when one column is shuffled between the rows.

    Every row with a target is scored unless a ``cap`` asks for a sample.  All shuffled
    columns are scored in one job: boosted trees in one pass over the rows, Spark's models as one long table.
    """
    given = df.where(F.col(target).isNotNull()).select(key, target, *features)
    sample = materialize(given if cap is None else sample_rows(given, key, cap, seed))
    by_row = hash_rank(sample, [], key, seed, out="_i", total="_n").drop("_n")
    donor = hash_rank(sample, [], key, seed + 1, out="_i", total="_n").select(
        "_i", F.struct(*features).alias("_donor"))
    paired = by_row.join(donor, "_i")
    if isinstance(model, B.Model):
        m = materialize(B.swapped_errors(model, paired, features, target, "_donor", log_target))
    else:
        paired = paired.withColumn("shuffled", F.explode(F.array(F.lit(None).cast("string"), *[F.lit(f) for f in features])))
        swapped = paired.withColumns({
            f: F.when(F.col("shuffled") == f, F.col(f"_donor.{f}")).otherwise(F.col(f)) for f in features})
        scored = predict(model, swapped.select("shuffled", target, *features), features, log_target=log_target)
        scored = scored.withColumn("shuffled", F.coalesce("shuffled", F.lit(""))).withColumn(target, F.col(target).cast("double"))
        m = regression_metrics(scored, target, "predicted", ["shuffled"]).select("shuffled", "rmse")
    base = m.where("shuffled = ''").select(F.col("rmse").alias("base_rmse"))
    return m.where("shuffled <> ''").join(F.broadcast(base), F.lit(True)).select(
        F.lit(target).alias("target"), F.col("shuffled").alias("feature"),
        (F.col("rmse") - F.col("base_rmse")).alias("attribution"), "base_rmse")
