"""Horizon datasets: aggregates over periods 1..h for all horizons in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom import spec as S
from panelloom.functions.nullsafe import first_value
from panelloom.operators.ranks import unpivot
from panelloom.session import materialize, spread
from panelloom.spec import PanelSpec


def _first_in_period(c: str, spec: PanelSpec) -> Column:
    # Without tie-breakers the panel key is unique and any choice is the value itself.
    return first_value(c, spec.order) if spec.order else F.min(c)


def per_period(df: DataFrame, spec: PanelSpec, variables: Sequence[str], statics: Sequence[str] = (),
               targets: Sequence[str] = ()) -> DataFrame:
    """One row per (entity, period): first non-null values, plus sums and counts of raw rows.

    Copies and hot entities shrink here by map-side combine before any row moves.
    """
    aggs = [_first_in_period(c, spec).alias(c) for c in [*variables, *statics, *targets]]
    aggs += [F.sum(v).alias(f"_{v}_sum") for v in variables]
    aggs += [F.count(v).alias(f"_{v}_cnt") for v in variables]
    return df.groupBy(spec.entity, spec.period).agg(*aggs)


def slice_positions(reduced: DataFrame, period: str, variables: Sequence[str]) -> DataFrame:
    """Per variable: position of each period among those with any value (a table of
    periods x variables), used only by the legacy trend scaling."""
    seen = unpivot(reduced, [period], variables).where("value is not null").groupBy("variable", period).agg(
        F.count("*").alias("_c")
    )
    w = Window.partitionBy("variable").orderBy(period)
    return seen.select("variable", period, (F.row_number().over(w) - 1).alias("pos"))


def horizon_features(df: DataFrame, spec: PanelSpec, sum_vars: Sequence[str], mean_vars: Sequence[str],
                     statics: Sequence[str] = (), targets: Sequence[str] = (),
                     horizons: Sequence[int] = tuple(S.HORIZONS), enrich_after: int = S.ENRICH_AFTER,
                     recent: int = S.RECENT_WINDOW, legacy_trend: bool = False,
                     prepared: bool = False) -> DataFrame:
    """One row per (entity, horizon) with features over periods <= horizon.

    The per-period table is repartitioned by entity once; the horizon explode
    and the final aggregate then stay inside that partitioning.  Quantiles run
    over at most ``max(horizons)`` periods of one entity.  ``prepared`` says that
    the rows are already one per (entity, period) and partitioned by entity; then
    nothing is shuffled here.
    """
    variables = [*sum_vars, *mean_vars]
    p, h = F.col(spec.period), F.col("horizon")
    window = df.where(p <= max(horizons))
    if prepared:
        reduced = window.select(
            spec.entity, spec.period, *dict.fromkeys([*variables, *statics, *targets]),
            *[F.col(v).alias(f"_{v}_sum") for v in variables],
            *[F.col(v).isNotNull().cast("int").alias(f"_{v}_cnt") for v in variables])
    else:
        reduced = per_period(window, spec, variables, statics, targets)
    if legacy_trend:
        # Read three times below.
        reduced = materialize(reduced)
        positions = slice_positions(reduced, spec.period, variables).groupBy(spec.period).pivot(
            "variable", list(variables)
        ).agg(F.first("pos")).select(spec.period, *[F.col(v).alias(f"_{v}_pos") for v in variables])
        reduced = reduced.join(positions, spec.period, "left")
    if legacy_trend or not prepared:
        reduced = spread(reduced, spec.entity)
    long = reduced.withColumn(
        "horizon", F.explode(F.filter(F.array(*[F.lit(int(x)) for x in horizons]), lambda x: x >= p))
    )
    rich = h > enrich_after
    in_recent = p > h - recent
    aggs = []
    for v in variables:
        aggs.append((F.sum(v).alias(f"{v}_cum") if v in sum_vars else F.avg(v).alias(f"{v}_mean")))
        aggs.append(F.stddev_pop(v).alias(f"{v}_std"))
        aggs.append(F.percentile(F.when(rich, F.col(v)), F.array(F.lit(0.1), F.lit(0.9))).alias(f"_{v}_q"))
        if legacy_trend:
            pos = F.when(rich, F.col(f"_{v}_pos").cast("double"))
            aggs.append(F.covar_pop(pos, F.when(rich, F.col(v).cast("double"))).alias(f"_{v}_cov"))
        else:
            aggs.append(F.regr_slope(F.when(rich, F.col(v).cast("double")), p.cast("double")).alias(f"{v}_trend"))
        aggs.append(F.try_divide(
            F.sum(F.when(rich & in_recent, F.col(f"_{v}_sum"))),
            F.sum(F.when(rich & in_recent, F.col(f"_{v}_cnt"))),
        ).alias(f"{v}_recent_mean"))
    for c in statics:
        aggs.append(first_value(c, [spec.period]).alias(c))
    for t in targets:
        aggs.append(F.max(F.when(p == h, F.col(t))).alias(t))
    aggs.append(F.sum(sum((F.col(v).isNotNull().cast("int") for v in variables[1:]),
                          F.col(variables[0]).isNotNull().cast("int"))).alias("_seen"))
    out = long.groupBy(spec.entity, "horizon").agg(*aggs).where(F.col("_seen") > 0)
    if legacy_trend:
        # Slice-wide number of periods with a value, per variable and horizon.
        counts = slice_positions(reduced, spec.period, variables).withColumn(
            "horizon", F.explode(F.filter(F.array(*[F.lit(int(x)) for x in horizons]), lambda x: x >= p))
        ).groupBy("horizon").pivot("variable", list(variables)).agg(F.count(F.lit(1))).select(
            "horizon", *[F.col(v).cast("double").alias(f"_{v}_n") for v in variables]
        )
        out = out.join(F.broadcast(counts), "horizon", "left")
    cols = [spec.entity, "horizon", *statics]
    for v in variables:
        cols += [f"{v}_cum" if v in sum_vars else f"{v}_mean", f"{v}_std",
                 F.col(f"_{v}_q")[0].alias(f"{v}_p10"), F.col(f"_{v}_q")[1].alias(f"{v}_p90")]
        if legacy_trend:
            n = F.col(f"_{v}_n")
            squares = n * (n * n - 1) / 12.0
            cols.append(F.when(squares > 0, F.try_divide(F.col(f"_{v}_cov"), squares))
                        .when(rich & F.col(f"_{v}_cov").isNotNull(), F.lit(0.0)).alias(f"{v}_trend"))
        else:
            cols.append(f"{v}_trend")
        cols.append(f"{v}_recent_mean")
    return out.select(*cols, *targets)


def horizon_dataset(df: DataFrame, spec: PanelSpec, sum_vars: Sequence[str], mean_vars: Sequence[str],
                    statics: Sequence[str], target: str, **options) -> DataFrame:
    """Horizon features of entities whose target is present exactly at the horizon."""
    return horizon_features(df, spec, sum_vars, mean_vars, statics, [target], **options).where(
        F.col(target).isNotNull()
    )
