"""Train the plan prefilter on a source panel and screen a target plan with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom import spec as S
from panelloom.models import tabular as M
from panelloom.operators import plan_filter as K
from panelloom.operators.encode import apply_encoding, fit_encoding
from panelloom.operators.prepare import geographic_rule
from panelloom.plans.training import Limits, classifier_table, minority_count
from panelloom.session import freeze, spread

TREE_FEATURES = S.prefilter_features(S.TREE_CLASSIFIER_FEATURES)
YIELD_FEATURES = S.prefilter_features(S.YIELD_CLASSIFIER_FEATURES)


def fit(panel: DataFrame, limits: Limits | None = None, o: M.TreeOptions | None = None) -> dict:
    """Two classifiers with longitude standing in for climate; the yield one only with
    enough minority entities in the training split."""
    entities = freeze(classifier_table(panel, limits or Limits(), list(dict.fromkeys(TREE_FEATURES + YIELD_FEATURES))))
    encoding = freeze(fit_encoding(entities.where("split = 'train'"), ["main_crop"]))
    table = freeze(apply_encoding(entities, encoding, ["main_crop"]))
    train = table.where("split = 'train'")
    tree_features, yield_features = M.usable_features(train, TREE_FEATURES), M.usable_features(train, YIELD_FEATURES)
    models = {"encoding": encoding, "tree": M.fit_classifier(train, tree_features, "tree_ok", o),
              "tree_features": tree_features, "yield": None, "yield_features": yield_features, "table": table}
    if minority_count(train) >= S.MIN_MINORITY:
        models["yield"] = M.fit_classifier(train, yield_features, "yield_failed", o)
    return models


def screen(plan: DataFrame, models: dict, **decision) -> DataFrame:
    """Annotated plan; both classifiers see every row.

    A plan comes from few and small files, so its rows are spread over the tasks before they are scored.
    """
    rows = apply_encoding(spread(plan).withColumn("_crop", F.col("main_crop")), models["encoding"], ["main_crop"])
    rows = M.classify(models["tree"], rows, models["tree_features"], "_p_ok", "_tree")
    p_fail, geo = None, None
    if models["yield"] is not None:
        rows = M.classify(models["yield"], rows, models["yield_features"], "_p_fail", "_yield")
        p_fail = F.col("_p_fail")
    else:
        geo = geographic_rule("latitude", "longitude" if "longitude" in plan.columns else None)
    out = K.annotate(rows, F.col("_p_ok"), p_fail, geo, **decision)
    return out.withColumn("main_crop", F.col("_crop")).drop("_crop", "_p_ok", "_tree", "_p_fail", "_yield")
