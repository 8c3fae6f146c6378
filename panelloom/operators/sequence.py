"""Within-entity sequence operators.

Windows here are partitioned by entity on a panel with at most one row per
(entity, period, category), so a group has at most periods x categories rows;
raw records are reduced to that grain by a map-side combined aggregate first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom import spec as S
from panelloom.functions.nullsafe import clip
from panelloom.operators.ranks import column_quantiles
from panelloom.spec import PanelSpec


def _ordered(spec: PanelSpec, desc: bool = False):
    keys = [F.desc(c) if desc else F.asc(c) for c in spec.ordering]
    return Window.partitionBy(spec.entity).orderBy(*keys)


def deltas(df: DataFrame, spec: PanelSpec, columns: Mapping[str, str]) -> DataFrame:
    """First difference within entity; ``columns`` maps new name to source, first row NULL."""
    w = _ordered(spec)
    return df.withColumns({out: F.col(c) - F.lag(c).over(w) for out, c in columns.items()})


def carbon_deltas(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return deltas(df, spec, {
        f"{b}_delta_{s}": f"{b}_{s}" for b in S.TREE_BASES for s in ("AF", "TF") if f"{b}_{s}" in df.columns
    })


def interpolate(df: DataFrame, spec: PanelSpec, columns: Sequence[str], max_null_share: float = 0.20,
                never: Sequence[str] = tuple(S.NEVER_INTERPOLATE_PATTERNS)) -> DataFrame:
    """Linear by row position, edges filled with the nearest value; an (entity, column)
    with a larger null share is left as it is."""
    columns = [c for c in columns if not any(p in c for p in never)]
    back = _ordered(spec).rowsBetween(Window.unboundedPreceding, 0)
    # The mirrored order keeps the "next value" frame linear instead of quadratic.
    ahead = _ordered(spec, desc=True).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(spec.entity)
    original = df.columns
    df = df.withColumn("_pos", F.row_number().over(_ordered(spec)))
    helpers = {}
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.col("_pos"))
        helpers |= {
            f"_{c}_v0": F.last(c, ignorenulls=True).over(back),
            f"_{c}_p0": F.last(at, ignorenulls=True).over(back),
            f"_{c}_v1": F.last(c, ignorenulls=True).over(ahead),
            f"_{c}_p1": F.last(at, ignorenulls=True).over(ahead),
            f"_{c}_na": F.avg(F.col(c).isNull().cast("int")).over(whole),
        }
    df = df.withColumns(helpers)
    out = []
    for c in original:
        if c not in columns:
            out.append(F.col(c))
            continue
        v0, p0, v1, p1 = (F.col(f"_{c}_{k}") for k in ("v0", "p0", "v1", "p1"))
        inner = v0 + (v1 - v0) * F.try_divide(F.col("_pos") - p0, p1 - p0)
        filled = F.coalesce(F.col(c), inner, v0, v1)
        out.append(F.when(F.col(f"_{c}_na") > max_null_share, F.col(c)).otherwise(filled).alias(c))
    return df.select(*out)


def profile(df: DataFrame, spec: PanelSpec, stock: str, out: str = "profile") -> DataFrame:
    """Stock relative to the entity's last non-null stock, clipped to [0, 1]; only final > 0."""
    full = _ordered(spec).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    final = F.last(stock, ignorenulls=True).over(full)
    return (
        df.withColumn("final_stock", final).where(F.col("final_stock") > 0)
        .withColumn(out, clip(F.try_divide(F.col(stock), F.col("final_stock")), 0, 1))
    )


def cumulative_ratio(df: DataFrame, keys: Sequence[str], order: str, num: str, den: str,
                     out: str = "cumulative_ratio") -> DataFrame:
    """Running sum of ``num`` over running sum of ``den``; NULL while the denominator is not positive."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    top, bottom = F.sum(num).over(w), F.sum(den).over(w)
    return df.withColumn(out, F.when(bottom > 0, F.try_divide(top, bottom)))


def winsor_fit(train: DataFrame, columns: Sequence[str], lo: float = 0.01, hi: float = 0.99,
               never: Sequence[str] = tuple(S.NEVER_WINSORIZE_PATTERNS)) -> DataFrame:
    """Exact linear quantiles per column on the training rows: (variable, lo, hi)."""
    columns = [c for c in columns if c in train.columns and not any(p in c for p in never)]
    return column_quantiles(train, columns, {"lo": lo, "hi": hi}).select("variable", "lo", "hi")


def _bounds(bounds: DataFrame) -> dict[str, tuple[float, float]]:
    # One row per clipped column, so this collect is bounded by the schema.
    return {r["variable"]: (r["lo"], r["hi"]) for r in bounds.select("variable", "lo", "hi").collect()}


def winsor_apply(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Clip to fitted bounds; columns without bounds are untouched."""
    limits = _bounds(bounds)
    return df.withColumns({c: clip(c, *limits[c]) for c in df.columns if c in limits})


def winsor_counts(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Values outside the bounds, per column."""
    limits = {c: b for c, b in _bounds(bounds).items() if c in df.columns}
    return df.agg(*[
        F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in limits.items()
    ]).unpivot([], list(limits), "variable", "n_clipped")
