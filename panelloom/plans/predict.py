"""Prediction with the models of a training run: routing, stage 1, curves, stage 2, long output.

A single scenario is a one-row table; it takes the same path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom import spec as S
from panelloom.functions import arrays as A
from panelloom.functions.nullsafe import clip
from panelloom.models import boosting as B
from panelloom.models import tabular as M
from panelloom.operators import inference as I
from panelloom.operators.encode import apply_encoding
from panelloom.operators.scenario import sweep_grid
from panelloom.plans.training import FIELD
from panelloom.session import materialize, spread


def required_statics(trained: dict[str, object]) -> list[str]:
    """Static columns that any model of the run reads."""
    fitted = [trained["tree_classifier"], trained["yield_classifier"], *trained["stage1"].values(), *trained["stage2"].values()]
    used = {f for pair in fitted if pair is not None for f in pair[1]}
    return [c for c in S.STATIC_FEATURES_B2 if c in used]


def climate_arrays(scenarios: DataFrame, n_years: int = S.N_YEARS) -> DataFrame:
    """Every climate variable as one value per year: scalars repeat, absent ones are 0."""
    def yearly(c: str):
        if c not in scenarios.columns:
            return A.spread(F.lit(0.0), n_years)
        is_array = isinstance(scenarios.schema[c].dataType, T.ArrayType)
        return F.transform(A.checked(c, n_years) if is_array else A.spread(c, n_years), lambda x: x.cast("double"))

    return scenarios.withColumns({c: yearly(c) for c in S.CLIMATE})


def _with_inputs(df: DataFrame, features: list[str]) -> DataFrame:
    """Absent features as NULL; the models fill them with their training median."""
    return df.withColumns({f: F.lit(None).cast("double") for f in features if f not in df.columns})


def classified(scenarios: DataFrame, trained: dict[str, object]) -> DataFrame:
    """Scenarios with ``p_ok`` (and ``p_fail`` if a yield classifier was fitted), scored on year-1 climate."""
    given = scenarios.columns
    categories = [c for c in S.CATEGORICAL_B2 if c in given]
    rows = scenarios.withColumn("_given", F.struct(*given)).withColumns({c: F.get(F.col(c), F.lit(0)) for c in S.CLIMATE})
    rows = apply_encoding(rows, trained["classifier_encoding"], categories)
    scores = ["p_ok"]
    for pair, score in ((trained["tree_classifier"], "p_ok"), (trained["yield_classifier"], "p_fail")):
        if pair is not None:
            model, features = pair
            rows = M.classify(model, _with_inputs(rows, features), features, score, f"_{score}")
            scores = list(dict.fromkeys([*scores, score]))
    return rows.select("_given.*", *scores)


def stage1_knots(scenarios: DataFrame, trained: dict[str, object]) -> DataFrame:
    """(scenario_id, target, horizon, value) of every fitted stage-1 model; ``scenarios`` carry climate arrays and codes."""
    spark = scenarios.sparkSession
    models = trained["stage1"]
    if not models:
        kind = scenarios.schema["scenario_id"].dataType.simpleString()
        return spark.createDataFrame([], f"scenario_id {kind}, target string, horizon int, value double")
    statics = [c for c in S.STATIC_FEATURES_B2 if c in scenarios.columns]
    # Written once: every model reads only its own horizon and features.
    grid = materialize(I.grid_of_arrays(spread(scenarios, "scenario_id"), statics, horizons=sorted({h for _, h in models})))
    if all(isinstance(m, B.Model) for m, _ in models.values()):
        # All boosted models score in one pass, a copy of the row for each target.
        named = {f"{t}|{h}": m for (t, h), (m, _) in models.items()}
        rows = grid.withColumn("target", F.explode(F.array(*[F.lit(t) for t in sorted({t for t, _ in models})])))
        rows = rows.withColumn("_key", F.concat_ws("|", "target", F.col("horizon").cast("string"))).where(F.col("_key").isin(list(named)))
        return B.predict(named, rows, "_log", "_key").select("scenario_id", "target", "horizon", clip(F.expm1("_log"), 0).alias("value"))

    def one(target: str, horizon: int) -> DataFrame:
        model, features = models[(target, horizon)]
        rows = _with_inputs(grid.where(F.col("horizon") == horizon), features)
        return M.predict(model, rows, features, log_target=True).select(
            "scenario_id", F.lit(target).alias("target"), F.lit(horizon).alias("horizon"), F.col("predicted").alias("value"))

    return reduce(DataFrame.unionByName, [one(*key) for key in models])


def predict(scenarios: DataFrame, trained: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """(long predictions, rejected scenarios with their reason).

    ``scenarios`` has a unique ``scenario_id``, static features and climate as scalars or yearly arrays. Predictions hold all four targets
    for every year of every runnable scenario.
    """
    runnable, rejects = I.split_invalid(scenarios, required_statics(trained))
    # Scenarios come from few and small files: they are spread before the classifiers see them.
    runnable = spread(runnable, "scenario_id")
    categories = [c for c in S.CATEGORICAL_B2 if c in scenarios.columns]
    p_fail = None if trained["yield_classifier"] is None else "p_fail"
    # The medians are keyed by crop name, the regressors read codes: rows carry both.
    coded = apply_encoding(climate_arrays(runnable).withColumns({f"_name_{c}": F.col(c) for c in categories}), trained["encoding"], categories)
    both = coded.withColumns({f"_code_{c}": F.col(c) for c in categories}).withColumns({c: F.col(f"_name_{c}") for c in categories})
    routed = materialize(I.route(classified(both.drop(*[f"_name_{c}" for c in categories]), trained), p_fail=p_fail))

    def as_codes(rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: F.col(f"_code_{c}") for c in categories})

    def stage2(rows: DataFrame) -> DataFrame:
        given = rows.columns
        rows = as_codes(rows).withColumns({c: F.col("year").cast("double") for c in S.TEMPORAL})
        for target in ("yield_AF", "yield_TA"):
            if target not in trained["stage2"]:  # too few rows in training
                rows = rows.withColumn(f"{target}_raw", F.lit(0.0))
                continue
            model, features = trained["stage2"][target]
            rows = M.predict(model, _with_inputs(rows, features), features, f"{target}_raw", nonnegative=True)
        return rows.select(*given, "yield_AF_raw", "yield_TA_raw")

    boosted = {f"{t}_raw": pair[0] for t, pair in trained["stage2"].items() if isinstance(pair[0], B.Model)}

    def stage2_arrays(rows: DataFrame) -> DataFrame:
        """Both boosted models in one pass over the scenarios, no yearly row sent to them."""
        found = B.predict_by_year(boosted, as_codes(rows), [*S.CLIMATE, *I.STOCKS], S.TEMPORAL, S.N_YEARS)
        return found.select(*rows.columns, *boosted)

    knots = stage1_knots(as_codes(routed.where("branch = 'model'")), trained)
    profile = trained["stunted_profile"].withColumnRenamed(FIELD.period, "period")
    rows = I.cascade(routed, knots, trained["stunted_medians"], profile, stage2_arrays if len(boosted) == 2 else stage2, tuple(S.CLIMATE), by_arrays=len(boosted) == 2)
    return I.format_output(rows), rejects


def sweep_values(scenarios: DataFrame, trained: dict[str, object], parameter: str, steps: int, year: int) -> DataFrame:
    """Predicted targets at ``year`` for every scenario and step of one parameter over its bounds."""
    grid = sweep_grid(scenarios, parameter, steps)
    # The id of a sweep row names scenario and step, so the steps need no join afterwards.
    grid = grid.withColumn("scenario_id", F.struct(F.col("scenario_id").alias("id"), "step", F.col(parameter).alias("value")))
    long = predict(grid, trained)[0].where(F.col("year") == year)
    return long.select("scenario_id.id", "scenario_id.step", F.col("scenario_id.value").alias(parameter), "target", "value")
