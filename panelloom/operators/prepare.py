"""Row-level preparation: derived columns, filters, cleaning, ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom import spec as S
from panelloom.functions.nullsafe import clip, first_value, is_below, last_value, ratio_above
from panelloom.operators.ranks import column_quantiles, unpivot
from panelloom.session import materialize_counted
from panelloom.spec import PanelSpec


def relative_period(df: DataFrame, entity: str, raw: str, out: str) -> DataFrame:
    """``raw - min(raw) per entity + 1``; a difference, so gaps survive.

    The minimum is a map-side combined aggregate joined back, not a window, so
    an entity with very many rows is split by the skew join rather than sorted
    in one task.
    """
    first = df.groupBy(entity).agg(F.min(raw).alias("_first"))
    return df.join(first, entity).withColumn(out, F.col(raw) - F.col("_first") + 1).drop("_first")


def flag_nonblank(c: str) -> Column:
    """1 if present and not blank after trimming, else 0."""
    return F.coalesce(F.trim(c) != "", F.lit(False)).cast("int")


def exclude_categories(df: DataFrame, category: str, excluded: Sequence[str]) -> DataFrame:
    """Drop listed categories; a missing category is kept."""
    return df.where(~F.coalesce(F.col(category).isin(list(excluded)), F.lit(False)))


def exclusion_report(df: DataFrame, entity: str, category: str, excluded: Sequence[str]) -> DataFrame:
    """Rows and entities before/after, share lost, and entities lost entirely, in one pass."""
    hit = F.coalesce(F.col(category).isin(list(excluded)), F.lit(False)).cast("bigint")
    per_entity = df.groupBy(entity).agg(F.count("*").alias("rows"), F.sum(hit).alias("hits"))
    whole = per_entity.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(F.col("rows") - F.col("hits")), F.lit(0)).alias("rows_after"),
        F.count("*").alias("entities_before"),
        F.count_if(F.col("hits") < F.col("rows")).alias("entities_after"),
        F.count_if(F.col("hits") > 0).alias("entities_touched"),
        F.count_if(F.col("hits") == F.col("rows")).alias("entities_lost"),
    )
    return whole.select(
        "*",
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        F.try_divide(F.lit(100.0) * (F.col("rows_before") - F.col("rows_after")), F.col("rows_before")).alias("pct_lost"),
    )


def exclusion_by_category(df: DataFrame, entity: str, category: str, excluded: Sequence[str]) -> DataFrame:
    """Rows and distinct entities removed per excluded category."""
    return (
        df.where(F.col(category).isin(list(excluded)))
        .groupBy(category, entity).agg(F.count("*").alias("rows"))
        .groupBy(category).agg(F.sum("rows").alias("rows"), F.count("*").alias("entities"))
    )


def drop_any_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(how="any", subset=list(columns))


def keep_ids(df: DataFrame, ids: DataFrame, entity: str) -> DataFrame:
    return df.join(ids.select(entity), entity, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, entity: str) -> DataFrame:
    return df.join(ids.select(entity), entity, "left_anti")


def keep_final_at_least(df: DataFrame, spec: PanelSpec, stock: str, minimum: float) -> DataFrame:
    """Rows of entities whose last non-null stock reaches a minimum."""
    final = df.groupBy(spec.entity).agg(last_value(stock, spec.ordering).alias("_final"))
    return keep_ids(df, final.where(F.col("_final") >= minimum), spec.entity)


def select_dataset(df: DataFrame, features: Sequence[str], targets: Sequence[str],
                   exclude: Sequence[str] = ()) -> DataFrame:
    """Listed columns that exist, in list order."""
    kept = [c for c in features if c in df.columns and c not in exclude]
    wanted = [c for c in targets if c in df.columns]
    if not kept or not wanted:
        raise ValueError("no available feature or target column")
    return df.select(*kept, *[c for c in wanted if c not in kept])


def constant_columns(df: DataFrame) -> DataFrame:
    """Numeric columns with at most one distinct value: min equals max in one aggregate row; none for an empty table."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not numeric:
        return df.sparkSession.createDataFrame([], "variable string")
    once = df.agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).eqNullSafe(F.max(c)).alias(c) for c in numeric]).where("_n > 0")
    return once.unpivot([], numeric, "variable", "constant").where("constant").select("variable")


def align_columns(df: DataFrame, schema: Sequence[tuple[str, str]]) -> DataFrame:
    """Exactly the given columns; absent ones become NULL."""
    return df.select(*[
        (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in schema
    ])


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column: rows, nulls and null share."""
    total = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in df.columns])
    return total.unpivot(["_n"], df.columns, "variable", "present").select(
        "variable",
        F.col("_n").alias("n_rows"),
        (F.col("_n") - F.col("present")).alias("n_null"),
        F.try_divide(F.col("_n") - F.col("present"), F.col("_n")).alias("null_share"),
    )


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns that are NULL in every row (one aggregate, one driver row)."""
    seen = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if seen[c] == 0])


def worst_null_columns(df: DataFrame, above: float = 0.30, k: int = 10) -> DataFrame:
    return null_counts(df).where(F.col("null_share") > above).orderBy(
        F.desc("null_share"), "variable"
    ).limit(k)


def _numeric_like(df: DataFrame, patterns: Sequence[str]) -> list[str]:
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and any(p in f.name for p in patterns)
    ]


def clip_fractions(df: DataFrame, patterns: Sequence[str] = tuple(S.FRACTION_PATTERNS)) -> DataFrame:
    return df.withColumns({c: clip(c, 0, 1) for c in _numeric_like(df, patterns)})


def clip_nonnegative(df: DataFrame, patterns: Sequence[str] = tuple(S.NONNEGATIVE_PATTERNS)) -> DataFrame:
    return df.withColumns({c: clip(c, 0) for c in _numeric_like(df, patterns)})


def negative_counts(df: DataFrame, patterns: Sequence[str] = tuple(S.NONNEGATIVE_PATTERNS)) -> DataFrame:
    """Values that ``clip_nonnegative`` would change, per column."""
    cols = _numeric_like(df, patterns)
    return df.agg(*[F.count_if(F.col(c) < 0).alias(c) for c in cols]).unpivot(
        [], cols, "variable", "n_clipped"
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with the number of rows (all members)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def first_per_key(df: DataFrame, keys: Sequence[str], ordering: Sequence[str]) -> DataFrame:
    """One row per key: the smallest in a declared total order, combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*ordering)).alias("_row")
    ).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def effective_crop(df: DataFrame, width: str = "plotWidth", strip: str = "strip_width") -> DataFrame:
    if width not in df.columns or strip not in df.columns:
        return df
    df = df.withColumn("cult_frac", clip(F.try_divide(F.col(width) - F.col(strip), F.col(width)), 0, 1))
    new = {}
    for base in S.CROP_BASES:
        if f"{base}_AF" in df.columns:
            new[f"{base}_eff_AF"] = F.col(f"{base}_AF") * F.col("cult_frac")
        if f"{base}_TA" in df.columns:
            new[f"{base}_eff_TA"] = F.col(f"{base}_TA")
    return df.withColumns(new)


def effective_tree(df: DataFrame) -> DataFrame:
    new = {}
    for base in S.TREE_BASES:
        for system in ("AF", "TF"):
            if f"{base}_{system}" in df.columns and f"density_{system}" in df.columns:
                new[f"{base}_eff_{system}"] = F.col(f"{base}_{system}") * F.col(f"density_{system}")
    return df.withColumns(new)


# Ratio name, numerator, denominator.
RELATIVE_RATIOS = [
    ("RR_crop_yield", "yield_eff_AF", "yield_eff_TA"),
    ("RR_crop_biomass", "biomass_eff_AF", "biomass_eff_TA"),
    ("RR_tree_carbonStem", "carbonStem_eff_AF", "carbonStem_eff_TF"),
]
LAND_RATIOS = [
    ("LER_yield_carbonStem", "RR_crop_yield", "RR_tree_carbonStem"),
    ("LER_biomass_carbonStem", "RR_crop_biomass", "RR_tree_carbonStem"),
]


def ratios(df: DataFrame, floor: float = S.RATIO_FLOOR) -> DataFrame:
    """Relative ratios (NULL unless the denominator exceeds ``floor``) and their sums."""
    df = df.withColumns({
        name: ratio_above(num, den, floor)
        for name, num, den in RELATIVE_RATIOS if num in df.columns and den in df.columns
    })
    return df.withColumns({
        name: F.col(a) + F.col(b)
        for name, a, b in LAND_RATIOS if a in df.columns and b in df.columns
    })


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """mean / median / min / max per column; the median is exact and distributed."""
    long = unpivot(df, [], columns)
    basic = long.groupBy("variable").agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    return basic.join(column_quantiles(df, columns, {"median": 0.5}).drop("n_values"), "variable", "left")


def geographic_rule(latitude: str | None = "latitude", longitude: str | None = None) -> Column:
    """1 where crops fail by location: south of the limit and, if known, east of it."""
    rule = is_below(latitude, S.GEO_LATITUDE)
    if longitude is not None:
        rule = rule & F.coalesce(F.col(longitude) > S.GEO_LONGITUDE, F.lit(False))
    return rule.cast("int")


def climate_guard(df: DataFrame) -> DataFrame:
    """Physical bounds of predicted climate; frost days rounded half-even."""
    new = {c: clip(c, 0) for c in S.CLIMATE_SUM if c in df.columns}
    frost = "frost_events_cycle_AF"
    if frost in df.columns:
        new[frost] = clip(F.rint(frost), 0)
    return df.withColumns(new)


def derive(df: DataFrame, entity: str = "SimID") -> DataFrame:
    """Relative year, rotation flag (before the fill), then the default fills."""
    df = relative_period(df, entity, "Harvest_Year_AF", "Harvest_Year_Absolute")
    return df.withColumn("Rotation", flag_nonblank("rot_id")).na.fill(
        {"rot_id": "monoculture", "main_crop": "rotation"}
    )


def prepare_panel(df: DataFrame, excluded: Sequence[str] = (),
                  required: Sequence[str] = ("yield_AF", "yield_TA"), deduplicate: bool = True) -> DataFrame:
    """Derive, exclude, clean, drop rows without targets, add effective values.

    The derived rows are written once, and their columns counted on the way: looking for empty columns would run everything before it a second
    time. Copies go first, while rows still lie by entity; that empties no column.
    """
    df = exclude_categories(derive(df), "Crop_Name", excluded)
    if deduplicate:
        df = df.dropDuplicates()
    df, seen = materialize_counted(df, **{f"_{i}": F.count(F.col(f"`{c}`")) for i, c in enumerate(df.columns)})
    df = df.drop(*[c for i, c in enumerate(df.columns) if seen[f"_{i}"] == 0])
    df = clip_nonnegative(clip_fractions(df))
    return effective_tree(effective_crop(drop_any_null(df, required)))


def validate_prepared(df: DataFrame) -> DataFrame:
    """Invariants of a prepared panel as one aggregate row of violation counts."""
    effective = [c for c in df.columns if "_eff_" in c]
    return df.agg(
        F.count_if(F.col("Harvest_Year_Absolute").isNull()).alias("missing_period"),
        F.count_if(F.col("Harvest_Year_Absolute") < 1).alias("period_below_one"),
        F.count_if(F.greatest(F.lit(0), *[-F.coalesce(F.col(c), F.lit(0.0)) for c in effective]) > 0)
        .alias("negative_effective"),
    )


def static_first(df: DataFrame, spec: PanelSpec, columns: Sequence[str]) -> DataFrame:
    """First non-null value of each attribute per entity."""
    return df.groupBy(spec.entity).agg(*[first_value(c, spec.ordering).alias(c) for c in columns])


def row_last(df: DataFrame, spec: PanelSpec, columns: Sequence[str]) -> DataFrame:
    """The true last row per entity, missing values kept."""
    order = Window.partitionBy(spec.entity).orderBy(*[F.desc(c) for c in spec.ordering])
    return (
        df.select(spec.entity, *spec.ordering, *[c for c in columns if c not in spec.ordering])
        .withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select(spec.entity, *columns)
    )
