"""Model jobs.  Their fitted numbers are not expressible in SQL, so only rows are checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom import spec as S
from panelloom.catalog.ctes import FIELD
from panelloom.catalog.registry import query, sql
from panelloom.models import attribution
from panelloom.models import boosting as B
from panelloom.models import climate as K
from panelloom.models import tabular as M
from panelloom.operators import metrics as E
from panelloom.operators import reshape
from panelloom.operators import split as X
from panelloom.operators.encode import apply_encoding, fit_encoding
from panelloom.operators.prepare import prepare_panel
from panelloom.plans import screening, training
from panelloom.session import materialize
from panelloom.sources import presets

TREES = M.TreeOptions()
LIMITS = training.Limits(tree_fail=30, tree_stunt=70, yield_fail=0.9, yield_fail_rate=0.25)
HORIZONS = tuple(S.HORIZONS)


def panel(spark, sf):
    """Prepared field panel with encoded categories, yields optional as for the classifiers."""
    p = prepare_panel(presets.field_panel(spark, sf), [], required=())
    # The prepared rows are written already; codes are a broadcast join.
    return apply_encoding(p, materialize(fit_encoding(p, S.CATEGORICAL_B2)), S.CATEGORICAL_B2)


def table(spark, sf):
    features = list(dict.fromkeys(S.TREE_CLASSIFIER_FEATURES + S.YIELD_CLASSIFIER_FEATURES))
    return materialize(training.classifier_table(panel(spark, sf), LIMITS, features))


def splits(p):
    return X.entity_split(p.select("SimID").distinct(), "SimID")


@query("ml_clf_tree", digits=None)
def ml_clf_tree(spark, sf):
    t = table(spark, sf)
    train, test = t.where("split = 'train'"), t.where("split = 'test'")
    f = M.usable_features(train, S.TREE_CLASSIFIER_FEATURES)
    scored = M.classify(M.fit_classifier(train, f, "tree_ok", TREES), test, f)
    return E.binary_metrics(scored, "tree_ok", "predicted_class", "p_1")


@query("ml_clf_yield", digits=None)
def ml_clf_yield(spark, sf):
    """Classifier with enough minority entities, otherwise the latitude rule."""
    scored = training.fit_yield_classifier(table(spark, sf), TREES)[1]
    return E.multiclass_metrics(scored, "yield_failed", "predicted_class")


@query("ml_final", digits=None)
def ml_final(spark, sf):
    """Three-class forest on the binned final stock."""
    p = panel(spark, sf)
    from panelloom.operators.classify import tree_labels
    from panelloom.operators.prepare import static_first

    labels = tree_labels(training.health(p, LIMITS), "SimID", 30, 70).where("tree_class is not null")
    f = [c for c in S.TREE_CLASSIFIER_FEATURES if c in p.columns]
    rows = materialize(X.entity_split(static_first(p, training.FIELD, f).join(labels, "SimID"), "SimID"))
    train = rows.where("split = 'train'")
    f = M.usable_features(train, f)
    model = M.fit_classifier(train, f, "tree_class", M.TreeOptions("forest"), n_classes=3)
    return E.class_report(M.classify(model, rows.where("split = 'test'"), f), "tree_class", "predicted_class")


@query("ml_stage1", digits=None)
def ml_stage1(spark, sf):
    p = panel(spark, sf)
    return training.fit_stage1(p, splits(p), HORIZONS)[1]


@query("ml_stage2", digits=None)
def ml_stage2(spark, sf):
    p = panel(spark, sf)
    return training.fit_stage2(p, splits(p))[1]


@query("ml_stage2_cv", digits=None)
def ml_stage2_cv(spark, sf):
    """Every fold of both stage-2 targets, whole entities apart."""
    p = panel(spark, sf)
    return training.fit_stage2(p, splits(p))[2]


def folded(spark, sf, k=5):
    p = panel(spark, sf).where("yield_AF is not null")
    return materialize(p.join(X.group_folds(p, "SimID", k).select("SimID", F.col("fold").cast("int").alias("fold")), "SimID"))


def stage2_features(p):
    return [f for f in S.STAGE2_AF_FEATURES if f in p.columns]


@query("ml_cv", digits=None)
def ml_cv(spark, sf):
    """Five grouped folds, fitted side by side."""
    rows = folded(spark, sf)
    return M.boosted_folds(rows, stage2_features(rows), "yield_AF", "fold", 5, {"stage2": training.ROWS}).drop("model")


@query("ml_tune", digits=None)
def ml_tune(spark, sf):
    """80 trials on five grouped folds; poor ones stop early."""
    rows = folded(spark, sf)
    return M.halving_search(rows, stage2_features(rows), "yield_AF", "fold", 5)[1]


def stage2_model(p):
    return B.fit(p, [B.Job("yield_AF", "rows", stage2_features(p), training.ROWS)], "yield_AF")["yield_AF"]


@query("ml_importance", digits=None)
def ml_importance(spark, sf):
    return B.importances({"yield_AF": stage2_model(panel(spark, sf))}, spark).drop("model").orderBy(F.desc("importance"), "feature")


@query("attr_permutation", digits=None)
def attr_permutation(spark, sf):
    p = panel(spark, sf).withColumn("row_key", F.concat_ws("-", "SimID", "Cycle_Nb"))
    return M.permutation_attribution(stage2_model(p), p, stage2_features(p), "yield_AF", "row_key")


def attributed(spark, sf):
    p = panel(spark, sf)
    model = stage2_model(p)
    return model, B.predict(model, attribution.attribute(model, p), "predicted")


@query("attr_tree", digits=None)
def attr_tree(spark, sf):
    """Mean absolute attribution of every feature over all rows, exact for the boosted trees."""
    model, rows = attributed(spark, sf)
    long = reshape.attribution_long(rows.withColumn("target", F.lit("yield_AF")), ["SimID", "Cycle_Nb", "target"], model.features)
    return reshape.attribution_summary(long)


@query("attr_tree_sums", sql([FIELD], "select count(*) as n, cast(0 as bigint) as off from field"))
def attr_tree_sums(spark, sf):
    """Rows of the panel, and those whose attributions and base miss the prediction by more than 1e-6."""
    model, rows = attributed(spark, sf)
    total = sum((F.col(f"attr_{f}") for f in model.features), F.col("attr_base"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.abs(total - F.col("predicted")) <= 1e-6, F.lit(False))).alias("off"))


def climate_rows(spark, sf):
    p = prepare_panel(presets.field_panel(spark, sf), [], required=())
    return materialize(K.training_rows(p, materialize(fit_encoding(p, ["main_crop"])), S.CLIMATE))


@query("ml_climate", digits=None)
def ml_climate(spark, sf):
    return K.validate(climate_rows(spark, sf), S.CLIMATE)


@query("ml_climate_predict", digits=None)
def ml_climate_predict(spark, sf):
    """Every candidate site over all years."""
    models = K.fit(climate_rows(spark, sf), S.CLIMATE)
    p = presets.scored_plan(spark, sf).select("SimID", "latitude", "longitude", "main_crop")
    sites = apply_encoding(p, materialize(fit_encoding(p, ["main_crop"])), ["main_crop"])
    return K.predict_sites(sites, models)


@query("ml_challenger", digits=None)
def ml_challenger(spark, sf):
    """Boosting and bagged forest side by side on one split, for every stock target of the panel."""
    p = panel(spark, sf)
    return training.challenge(p, splits(p), S.STOCK_TARGETS)


@query("pre_train", digits=None)
def pre_train(spark, sf):
    """Prefilter trained on the panel, applied to the whole plan."""
    p = prepare_panel(presets.field_panel(spark, sf), [], required=())
    models = screening.fit(p, LIMITS, TREES)
    return screening.screen(presets.scored_plan(spark, sf), models)


def full_run(spark, sf):
    return training.run(presets.field_panel(spark, sf), ("error",), LIMITS, HORIZONS, TREES)


@query("run_quality", digits=None)
def run_quality(spark, sf):
    """Quality table of a full training run: every metric of both classifiers, stage 1 and stage 2 against its limit."""
    return full_run(spark, sf)["quality"]


@query("run_training", digits=None)
def run_training(spark, sf):
    """The full training run; returns the reports of both stages, models without enough rows marked."""
    done = full_run(spark, sf)
    columns = ["target", "horizon", "n", "r2", "rmse", "mae", "skipped"]
    return done["stage1_report"].select(columns).unionByName(done["stage2_report"].withColumn("horizon", F.lit(None).cast("int")).select(columns))
