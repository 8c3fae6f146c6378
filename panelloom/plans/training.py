"""Full training run over a field panel: prepare, label, split, fit, evaluate."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom import spec as S
from panelloom.functions.nullsafe import clip
from panelloom.models import boosting as B
from panelloom.models import tabular as M
from panelloom.operators import aggregate as G
from panelloom.operators import classify as C
from panelloom.operators import metrics as E
from panelloom.operators import prepare as P
from panelloom.operators import sequence as Q
from panelloom.operators import split as X
from panelloom.operators.encode import apply_encoding, fit_encoding
from panelloom.operators.horizon import horizon_dataset
from panelloom.operators.sensitivity import spearman_by
from panelloom.session import freeze, materialize
from panelloom.spec import PanelSpec

FIELD = PanelSpec("SimID", "Harvest_Year_Absolute", "Crop_Name", order=("Cycle_Nb",))
STAGE1_TARGETS = ["carbonStem_AF", "carbonStem_TF"]


@dataclass
class Limits:
    """Class limits; the defaults are the preset's."""

    tree_fail: float = S.TREE_FAIL
    tree_stunt: float = S.TREE_STUNT
    yield_fail: float = S.YIELD_FAIL
    yield_fail_rate: float = S.YIELD_FAIL_RATE


def health(panel: DataFrame, limits: Limits) -> DataFrame:
    return C.entity_health(panel, FIELD, "carbonStem_AF", "yield_AF", "yield_TA", limits.yield_fail)


def classifier_table(panel: DataFrame, limits: Limits, features: list[str]) -> DataFrame:
    """One row per entity: first feature values, labels, own split."""
    present = [f for f in features if f in panel.columns]
    h = C.populations(health(panel, limits), limits.tree_fail, limits.tree_stunt, limits.yield_fail_rate)
    labels = h.select(
        "SimID", F.coalesce((F.col("final_stock") >= limits.tree_stunt).cast("int"), F.lit(0)).alias("tree_ok"),
        F.col("yield_failed").cast("int").alias("yield_failed"), "population_binary")
    table = P.static_first(panel, FIELD, present).join(labels, "SimID")
    return X.entity_split(table, "SimID")


def stage1_dataset(panel: DataFrame, target: str, horizons=tuple(S.HORIZONS)) -> DataFrame:
    """Horizon rows of one stock target for all horizons at once."""
    statics = [c for c in S.STATIC_FEATURES_B2 if c in panel.columns]
    return horizon_dataset(panel, FIELD, S.CLIMATE_SUM, S.CLIMATE_MEAN, statics, target, horizons=horizons)


def stage1_features(dataset: DataFrame, horizon: int, target: str) -> list[str]:
    enriched = ("_p10", "_p90", "_trend", "_recent_mean")
    return [
        c for c in dataset.columns
        if c not in ("SimID", "horizon", target, "split", "fold") and (horizon > S.ENRICH_AFTER or not c.endswith(enriched))
    ]


#: Boosting of horizons up to ``S.ENRICH_AFTER``, of longer ones, and of the row-level yields.
SHORT = B.Boost(trees=24, depth=4, step=0.2, least_rows=10, subsample=0.9, columns=0.9, lasso=0.1, ridge=0.3)
LONG = B.Boost(trees=16, depth=4, step=0.2, least_rows=20, subsample=0.8, columns=0.8, lasso=0.5, ridge=1.0)
ROWS = B.Boost(trees=20, depth=4, step=0.2, least_rows=20, subsample=0.8, columns=0.8, lasso=0.3, ridge=0.5)


def stage1_options(horizon: int, o: B.Boost | None = None) -> B.Boost:
    return o or (LONG if horizon > S.ENRICH_AFTER else SHORT)


def stage1_rows(panel: DataFrame, splits: DataFrame, targets, horizons) -> tuple[DataFrame, dict[str, list[str]]]:
    """Horizon rows of all targets below each other (``target``, ``truth``, ``label`` on the log scale, ``data``), and the features of each dataset."""
    out, features = None, {}
    for target in targets:
        data = stage1_dataset(panel, target, horizons).join(splits.select("SimID", "split"), "SimID")
        features |= {f"{target}|{h}": stage1_features(data, h, target) for h in horizons}
        named = data.withColumnRenamed(target, "truth").withColumn("target", F.lit(target))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    log = F.log1p(clip("truth", 0))
    return out.withColumns({"label": log, "data": F.concat_ws("|", "target", F.col("horizon").cast("string"))}), features


def fit_stage1(panel: DataFrame, splits: DataFrame, horizons=tuple(S.HORIZONS), o: B.Boost | None = None,
               targets=tuple(STAGE1_TARGETS)) -> tuple[dict[tuple[str, int], tuple], DataFrame]:
    """One log-target model per (target, horizon), all fitted in one set of jobs, and their test metrics; too small sets are skipped.

    Short and long horizons have parameters of their own unless ``o`` is given.
    """
    given, features = stage1_rows(panel, splits, targets, horizons)
    rows = materialize(given.where("truth is not null"))
    counts = {(r["data"], r["split"]): r["n"] for r in rows.groupBy("data", "split").agg(F.count(F.lit(1)).alias("n")).collect()}  # models x 2 rows
    sizes = {(t, h): (counts.get((f"{t}|{h}", "train"), 0), counts.get((f"{t}|{h}", "test"), 0)) for t in targets for h in horizons}
    fits = [(t, h) for (t, h), (a, b) in sizes.items() if a >= M.MIN_TRAIN and b >= M.MIN_TEST]
    jobs = [B.Job((t, h), f"{t}|{h}", features[f"{t}|{h}"], stage1_options(h, o)) for t, h in fits]
    report = None
    for (t, h), (_, n) in sizes.items():
        if (t, h) not in fits:
            report = joined(report, skipped(panel, n, t, h, rho=True))
    if not jobs:
        return {}, report
    fitted = B.fit(rows.where("split = 'train'"), jobs, "label", "data")
    named = {f"{t}|{h}": m for (t, h), m in fitted.items()}
    test = rows.where(F.col("split") == "test").where(F.col("data").isin(list(named)))
    scored = materialize(B.predict(named, test, "_log", "data").select("target", "horizon", "truth", clip(F.expm1("_log"), 0).alias("predicted")))
    keys = ["target", "horizon"]
    found = E.regression_metrics(scored.withColumn("truth", F.col("truth").cast("double")), "truth", "predicted", keys).select(*keys, "n", "r2", "rmse", "mae")
    rho = spearman_by(scored, keys, "predicted", "truth").select(*keys, F.round("rho", 4).alias("spearman_rho"))
    models = {key: (m, features[f"{key[0]}|{key[1]}"]) for key, m in fitted.items()}
    return models, joined(report, found.join(rho, keys, "left").withColumn("skipped", F.lit(False)))


def joined(report: DataFrame | None, row: DataFrame) -> DataFrame:
    return row if report is None else report.unionByName(row, allowMissingColumns=True)


def skipped(data: DataFrame, n_test: int, target: str, horizon: int | None = None, rho: bool = False) -> DataFrame:
    """Report row of a model that has too few rows to be fitted."""
    names = ["r2", "rmse", "mae", *(["spearman_rho"] if rho else [])]
    kinds = "target string, " + ("horizon int, " if horizon is not None else "") + "n long, skipped boolean, " + ", ".join(f"{c} double" for c in names)
    row = (target, *([horizon] if horizon is not None else []), n_test, True, *[None] * len(names))
    return data.sparkSession.createDataFrame([row], kinds)


def fit_yield_classifier(table: DataFrame, o: M.TreeOptions | None = None) -> tuple[tuple | None, DataFrame]:
    """Yield classifier (None with too few minority entities: the location rule decides) and the scored test split."""
    train, test = table.where("split = 'train'"), table.where("split = 'test'")
    if minority_count(table) < S.MIN_MINORITY:
        return None, test.withColumn("predicted_class", P.geographic_rule())
    features = M.usable_features(train, S.YIELD_CLASSIFIER_FEATURES)
    model = M.fit_classifier(train, features, "yield_failed", o)
    return (model, features), M.classify(model, test, features)


STAGE2 = {"yield_AF": S.STAGE2_AF_FEATURES, "yield_TA": S.STAGE2_TA_FEATURES}


def fit_stage2(panel: DataFrame, splits: DataFrame, o: B.Boost | None = None, folds: int = 5) -> tuple[dict[str, tuple], DataFrame, DataFrame, DataFrame]:
    """Row-level yield models: AF with the observed stem carbon, TA without any tree feature.

    Returns the models, their test metrics, the metrics of every fold of a cross-validation over whole training entities, and the share of gain by
    feature. Both final models and those of all folds are fitted in one set of jobs.
    """
    fold_of = X.group_folds(P.keep_ids(panel, splits.where("split = 'train'"), "SimID"), "SimID", folds).select("SimID", F.col("fold").cast("int").alias("fold"))
    wide = panel.join(splits.select("SimID", "split"), "SimID").join(fold_of, "SimID", "left")
    present = {t: [f for f in fs if f in panel.columns] for t, fs in STAGE2.items()}
    used = sorted({f for fs in present.values() for f in fs})
    each = [wide.where(F.col(t).isNotNull()).select("split", "fold", *used, F.lit(t).alias("target"), F.col(t).cast("double").alias("truth")) for t in STAGE2]
    rows = materialize(each[0].unionByName(each[1]))
    counts = {(r["target"], r["split"]): r["n"] for r in rows.groupBy("target", "split").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    fits = [t for t in STAGE2 if counts.get((t, "train"), 0) >= M.MIN_TRAIN and counts.get((t, "test"), 0) >= M.MIN_TEST]
    report = None
    for t in STAGE2:
        if t not in fits:
            report = joined(report, skipped(panel, counts.get((t, "test"), 0), t))
    spark = panel.sparkSession
    none_cv = spark.createDataFrame([], "target string, fold int, n long, r2_val double, rmse double, mae double, r2_train double")
    if not fits:
        return {}, report, none_cv, spark.createDataFrame([], "target string, feature string, importance double")
    o = o or ROWS
    jobs = [B.Job(f"{t}|{i}", t, present[t], o, held=i) for t in fits for i in (*range(folds), None)]
    fitted = B.fit(rows.where("split = 'train'"), jobs, "truth", "target", "fold")
    final = {t: fitted[f"{t}|None"] for t in fits}
    test = B.predict(final, rows.where(F.col("split") == "test").where(F.col("target").isin(fits)), "_raw", "target")
    found = E.regression_metrics(test.withColumn("predicted", clip("_raw", 0)), "truth", "predicted", ["target"])
    folded = {k: m for k, m in fitted.items() if not k.endswith("|None")}
    held = {j.name: (j.data, j.held) for j in jobs}
    by_fold = B.fold_metrics(folded, held, rows.where("split = 'train'"), "truth", "fold", "target")
    names = F.split("model", r"\|")
    cv = by_fold.select(F.get(names, F.lit(0)).alias("target"), F.get(names, F.lit(1)).cast("int").alias("fold"), "n", "r2_val", "rmse", "mae", "r2_train")
    models = {t: (m, present[t]) for t, m in final.items()}
    return models, joined(report, found.withColumn("skipped", F.lit(False))), cv, B.importances(final, spark).withColumnRenamed("model", "target")


def challenge(panel: DataFrame, splits: DataFrame, targets, trees: int = 20, o: B.Boost | None = None) -> DataFrame:
    """(target, family, metrics) of boosting and of a bagged forest of as many trees, on the same test rows.

    All boosted models and all trees of all forests are fitted in one set of jobs. Stocks are learned on the log scale and judged on their own;
    no other target serves as a feature.
    """
    features = [f for f in S.ACTIVE_FEATURES_B2 if f in panel.columns]
    wide = panel.join(splits.select("SimID", "split"), "SimID")
    rows = None
    for t in (t for t in targets if t in panel.columns):
        one = wide.where(F.col(t).isNotNull()).select("split", *features, F.lit(t).alias("target"), F.col(t).cast("double").alias("truth"))
        rows = one if rows is None else rows.unionByName(one)
    rows = materialize(rows.withColumn("label", F.log1p(clip("truth", 0))))
    counts = {(r["target"], r["split"]): r["n"] for r in rows.groupBy("target", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    fits = sorted({t for t, _ in counts if counts.get((t, "train"), 0) >= M.MIN_TRAIN and counts.get((t, "test"), 0) >= M.MIN_TEST})
    o = o or ROWS
    jobs = [B.Job(f"{t}|boosting", t, features, replace(o, trees=trees)) for t in fits]
    jobs += [B.Job(f"{t}|forest|{k}", t, features, B.forest(replace(o, depth=o.depth + 2), k)) for t in fits for k in range(trees)]
    fitted = B.fit(rows.where("split = 'train'"), jobs, "label", "target") if jobs else {}
    models = {f"{t}|boosting": fitted[f"{t}|boosting"] for t in fits} | {f"{t}|forest": B.average([fitted[f"{t}|forest|{k}"] for k in range(trees)]) for t in fits}
    each = rows.where("split = 'test'").where(F.col("target").isin(fits)).withColumn("family", F.explode(F.array(F.lit("boosting"), F.lit("forest"))))
    each = each.withColumn("_key", F.concat_ws("|", "target", "family"))
    scored = B.predict(models, each, "_log", "_key") if models else each.withColumn("_log", F.lit(0.0))
    return E.regression_metrics(scored.withColumn("predicted", clip(F.expm1("_log"), 0)), "truth", "predicted", ["target", "family"])


def quality_metrics(done: dict[str, object]) -> DataFrame:
    """(stage, target, metric, value) of everything a run is judged by; models that were skipped have no value."""
    clf1 = done["clf1_metrics"].select(F.lit("CLF1").alias("stage"), F.lit("tree_ok").alias("target"), F.col("f1_macro").alias("clf1_f1_macro"), F.col("roc_auc").alias("clf1_roc_auc"))
    clf1 = clf1.unpivot(["stage", "target"], ["clf1_f1_macro", "clf1_roc_auc"], "metric", "value")
    clf2 = done["clf2_metrics"].select(F.lit("CLF2").alias("stage"), F.lit("yield_failed").alias("target"), F.lit("clf2_accuracy").alias("metric"), F.col("accuracy").alias("value"))
    one = done["stage1_report"].select(F.lit("Stage1").alias("stage"), F.format_string("%s_h%d", "target", "horizon").alias("target"), F.col("r2").alias("carbon_r2"), F.col("spearman_rho").alias("carbon_rho"))
    one = one.unpivot(["stage", "target"], ["carbon_r2", "carbon_rho"], "metric", "value")
    two = done["stage2_report"].select(F.lit("Stage2").alias("stage"), "target", F.concat(F.lower("target"), F.lit("_r2")).alias("metric"), F.col("r2").alias("value"))
    return clf1.unionByName(clf2).unionByName(one).unionByName(two)


def run(raw: DataFrame, excluded: tuple[str, ...] = (), limits: Limits | None = None,
        horizons=tuple(S.HORIZONS), o: M.TreeOptions | None = None, boost: B.Boost | None = None) -> dict[str, object]:
    """All steps; returns the tables and models by name.

    Regressors see nominal entities only; encodings are fitted on the training entities of each model family. The panel keeps its
    category names for the stunted medians.
    """
    limits = limits or Limits()
    # Written by column: later steps read few of them, and a checkpoint would compute its rows twice.
    panel = materialize(P.prepare_panel(raw, excluded))
    labelled = freeze(C.populations(health(panel, limits), limits.tree_fail, limits.tree_stunt, limits.yield_fail_rate))
    nominal = C.keep_population(panel, labelled, FIELD).drop("population", "population_binary")
    strata = G.signatures(nominal, "SimID", "Crop_Name")
    splits = freeze(X.stratified_split(strata, "SimID", "signature"))
    train = P.keep_ids(nominal, splits.where("split = 'train'"), "SimID")
    encoding = freeze(fit_encoding(train, S.CATEGORICAL_B2))
    bounds = freeze(Q.winsor_fit(train, S.STOCK_TARGETS))
    clipped = materialize(Q.winsor_apply(apply_encoding(nominal, encoding, S.CATEGORICAL_B2), bounds))
    grown = P.keep_ids(clipped, labelled.where(F.col("final_stock") >= limits.tree_stunt), "SimID")
    entities = freeze(classifier_table(panel, limits, list(dict.fromkeys(S.TREE_CLASSIFIER_FEATURES + S.YIELD_CLASSIFIER_FEATURES))))
    table, clf_encoding = encoded_on_train(entities)
    clf_train, clf_test = table.where("split = 'train'"), table.where("split = 'test'")
    tree_features = M.usable_features(clf_train, S.TREE_CLASSIFIER_FEATURES)
    tree_model = M.fit_classifier(clf_train, tree_features, "tree_ok", o)
    clf1 = E.binary_metrics(M.classify(tree_model, clf_test, tree_features), "tree_ok", "predicted_class", "p_1")
    yield_model, yield_scored = fit_yield_classifier(table, o)
    stunted = freeze(G.stunted_entities(panel, FIELD, "carbonStem_AF", "main_crop", clf_train, limits.tree_fail, limits.tree_stunt))
    stage1, stage1_report = fit_stage1(grown, splits, horizons, boost)
    stage2, stage2_report, stage2_cv, stage2_gain = fit_stage2(clipped, splits, boost)
    done = {
        "panel": clipped, "populations": labelled, "splits": splits, "bounds": bounds, "encoding": encoding,
        "classifier_encoding": clf_encoding, "tree_classifier": (tree_model, tree_features), "clf1_metrics": clf1,
        "yield_rule": "location" if yield_model is None else "classifier", "yield_classifier": yield_model,
        "clf2_metrics": E.multiclass_metrics(yield_scored, "yield_failed", "predicted_class"),
        "routing_check": misrouted_share(M.classify(tree_model, table, tree_features), labelled),
        "stunted_medians": G.stunted_medians(stunted),
        "stunted_profile": G.stunted_profile(panel, FIELD, "carbonStem_AF", stunted),
        "stage1": stage1, "stage1_report": stage1_report, "stage2": stage2, "stage2_report": stage2_report,
        "stage2_cv": stage2_cv, "stage2_importances": stage2_gain,
    }
    return done | {"quality": E.quality_table(quality_metrics(done))}


def encoded_on_train(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classifier rows with the categories encoded by the classes of their training split, and that encoding."""
    columns = [c for c in S.CATEGORICAL_B2 if c in entities.columns]
    encoding = freeze(fit_encoding(entities.where("split = 'train'"), columns))
    return freeze(apply_encoding(entities, encoding, columns)), encoding


def minority_count(table: DataFrame, label: str = "yield_failed") -> int:
    r = table.agg(F.count_if(F.col(label) == 1).alias("a"), F.count_if(F.col(label) == 0).alias("b")).first()
    return min(r["a"], r["b"])


def misrouted_share(classified: DataFrame, labelled: DataFrame, limit: float = 0.10) -> DataFrame:
    """Share of nominal entities the classifier sends elsewhere; above ``limit`` warns."""
    nominal = labelled.where(F.col("population") == S.NOMINAL).select("SimID")
    out = classified.join(nominal, "SimID", "left_semi").agg(
        F.avg((F.col("predicted_class") != 1).cast("int")).alias("misrouted"))
    return out.withColumn("warn", F.col("misrouted") > limit)
