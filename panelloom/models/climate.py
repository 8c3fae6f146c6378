"""Climate surrogate: one regressor per climate variable from site, crop and year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom import spec as S
from panelloom.models import boosting as B
from panelloom.operators.encode import apply_encoding
from panelloom.operators.metrics import fold_summary, regression_metrics
from panelloom.operators.prepare import climate_guard, first_per_key
from panelloom.operators.split import group_folds
from panelloom.session import materialize, spread

# Fixed values.
FEATURES = ["latitude", "longitude", "main_crop", "Harvest_Year_Absolute"]
GOOD_R2 = 0.7


def training_rows(df: DataFrame, encoding: DataFrame, variables: Sequence[str] = tuple(S.CLIMATE)) -> DataFrame:
    """One row per (entity, year), complete, with the crop encoded."""
    rows = df.select("SimID", *FEATURES, *variables)
    one = first_per_key(rows, ["SimID", "Harvest_Year_Absolute"], ["main_crop", *variables]).na.drop()
    return apply_encoding(one, encoding, ["main_crop"])


#: Options of the surrogates; one climate variable needs few splits on site, crop and year.
SURROGATE = B.Boost(trees=24, depth=5, step=0.2, least_rows=10)


def _stacked(rows: DataFrame, variables: Sequence[str], *keep: str) -> DataFrame:
    """Rows of all variables below each other: ``variable``, ``truth`` and the features."""
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("truth")) for v in variables])
    return rows.select(*keep, *FEATURES, F.explode(pairs).alias("_v")).select(*keep, *FEATURES, "_v.*")


def fit(rows: DataFrame, variables: Sequence[str] = tuple(S.CLIMATE), o: B.Boost | None = None) -> dict[str, B.Model]:
    """One model per variable, all fitted in one set of jobs."""
    return B.fit(_stacked(rows, variables), [B.Job(v, v, FEATURES, o or SURROGATE) for v in variables], "truth", "variable")


def validate(rows: DataFrame, variables: Sequence[str] = tuple(S.CLIMATE), k: int = 5,
             o: B.Boost | None = None) -> DataFrame:
    """Grouped cross-validation per variable with its status; the models of all variables and folds are fitted side by side."""
    folds = group_folds(rows, "SimID", k).select("SimID", F.col("fold").cast("int").alias("fold"))
    stacked = materialize(_stacked(rows.join(folds, "SimID"), variables, "fold"))
    models = B.fit(stacked, [B.Job(f"{v}|{i}", v, FEATURES, o or SURROGATE, held=i) for v in variables for i in range(k)], "truth", "variable", "fold")
    scored = B.predict(models, stacked.withColumn("_key", F.concat_ws("|", "variable", F.col("fold").cast("string"))), "predicted", "_key")
    found = regression_metrics(scored, "truth", "predicted", ["variable", "fold"]).withColumnRenamed("r2", "r2_val")
    out = fold_summary(found, ["r2_val", "rmse"], ["variable"])
    return out.withColumn("status", F.when(F.col("r2_val_mean") > GOOD_R2, "OK").otherwise("WARN"))


def predict_sites(sites: DataFrame, models: dict[str, B.Model], n_years: int = S.N_YEARS) -> DataFrame:
    """All years of every site in one pass, then the physical guard."""
    # Sites come in few files; the rows multiply in the explode and again in the trees.
    rows = spread(sites).withColumn("Harvest_Year_Absolute", F.explode(F.sequence(F.lit(1), F.lit(n_years))))
    rows = B.predict_side_by_side(models, rows)
    return climate_guard(rows)
