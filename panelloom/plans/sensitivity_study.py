"""Sensitivity study: nominal entities, global index, then yearly indices with a warm start."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom import spec as S
from panelloom.operators import sensitivity as N
from panelloom.operators.aggregate import entity_targets
from panelloom.operators.classify import sensitivity_populations
from panelloom.operators.prepare import first_per_key, keep_ids
from panelloom.spec import PanelSpec


def nominal_ids(df: DataFrame, entity: str = "SimID", cycle: str = "Cycle_Nb", **limits) -> DataFrame:
    labelled = sensitivity_populations(df, entity, cycle, "carbonStem_AF", "yield_AF", "yield_TA", **limits)
    return labelled.where(F.col("population") == S.NOMINAL).select(entity)


def global_dataset(df: DataFrame, spec: PanelSpec, features: Sequence[str], means: Sequence[str],
                   lasts: Sequence[str]) -> DataFrame:
    """One complete row per entity: the first row's plan values, mean and last targets."""
    snapshot = first_per_key(
        df.select(spec.entity, *spec.ordering, *[c for c in features if c not in spec.ordering]), [spec.entity],
        [*spec.ordering, *features]).select(spec.entity, *features)
    return snapshot.join(entity_targets(df, spec, means, lasts), spec.entity).na.drop()


def run(df: DataFrame, spec: PanelSpec, numeric: Sequence[str], categorical: Sequence[str], means: Sequence[str],
        lasts: Sequence[str], n_boot: int = 100, boot_size: int = 500, **limits) -> dict[str, DataFrame]:
    nominal = keep_ids(df, nominal_ids(df, spec.entity, **limits), spec.entity)
    table = global_dataset(nominal, spec, [*numeric, *categorical], means, lasts)
    targets = [*means, *lasts]
    return {
        "check": N.validate_against_spearman(table, spec.entity, numeric, targets),
        "overall": N.hsic_indices(table, spec.entity, [*numeric, *categorical], targets, n_boot=n_boot, boot_size=boot_size),
        "yearly": N.warm_start(nominal, spec.entity, spec.period, spec.category, numeric, categorical, targets,
                               n_boot=n_boot, boot_size=boot_size),
    }
