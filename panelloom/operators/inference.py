"""Cascade inference: routing, carbon curves, yields, long output."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom import spec as S
from panelloom.functions import arrays as A
from panelloom.functions.curves import curve_pieces, yearly_curve
from panelloom.functions.labels import pair_label
from panelloom.functions.nullsafe import clip
from panelloom.operators.horizon import horizon_features
from panelloom.operators.lookup import lookup_join
from panelloom.session import spread
from panelloom.spec import PanelSpec

YEARLY = PanelSpec("scenario_id", "year")
STOCKS = ["carbonStem_AF", "carbonStem_TF"]


def invalid_reason(scenarios: DataFrame, statics: Sequence[str], climate: Sequence[str], n_years: int = S.N_YEARS) -> Column:
    """Why a scenario cannot be run, NULL if it can: absent static or wrong array length."""
    reason = F.lit(None).cast("string")
    for c in statics:
        absent = F.lit(True) if c not in scenarios.columns else F.col(c).isNull()
        reason = F.coalesce(reason, F.when(absent, F.lit(f"missing {c}")))
    for c in climate:
        if c in scenarios.columns and isinstance(scenarios.schema[c].dataType, T.ArrayType):
            reason = F.coalesce(reason, F.when(F.size(c) != n_years, F.lit(f"length of {c}")))
    return reason


def yearly_rows(scenarios: DataFrame, climate: Sequence[str] = tuple(S.CLIMATE), n_years: int = S.N_YEARS,
                strict: bool = True) -> DataFrame:
    """One row per (scenario, year); scalars repeat, absent climate is 0, wrong lengths fail.

    Scenarios are partitioned by id before they grow to a row per year.
    """
    arrays = []
    for c in climate:
        if c not in scenarios.columns:
            arrays.append(A.spread(F.lit(0.0), n_years).alias(c))
        elif isinstance(scenarios.schema[c].dataType, T.ArrayType):
            arrays.append((A.checked(c, n_years) if strict else F.col(c)).alias(c))
        else:
            arrays.append(A.spread(c, n_years).alias(c))
    rest = [c for c in scenarios.columns if c not in climate]
    exploded = spread(scenarios, "scenario_id").select(*rest, *arrays).select(*rest, F.posexplode(F.arrays_zip(*[F.col(c) for c in climate])).alias("_i", "_z"))
    return exploded.select(*rest, (F.col("_i") + 1).cast("bigint").alias("year"),
                           *[F.col(f"_z.{c}").cast("double").alias(c) for c in climate])


def inference_grid(yearly: DataFrame, statics: Sequence[str] = tuple(S.STATIC_FEATURES_B2),
                   sum_vars: Sequence[str] = tuple(S.CLIMATE_SUM), mean_vars: Sequence[str] = tuple(S.CLIMATE_MEAN),
                   horizons: Sequence[int] = tuple(S.HORIZONS), **options) -> DataFrame:
    """Horizon features of scenarios by the same code as training, so both sides agree.

    ``yearly`` comes from ``yearly_rows``, whose scenarios were partitioned before the
    explode: the yearly rows are unique and need no further shuffle.
    """
    return horizon_features(yearly, YEARLY, sum_vars, mean_vars, statics, horizons=horizons, prepared=True, **options)


def _running(values: np.ndarray, given: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Count, sum and summed squares of the given values up to each place, and those of ``x`` and of the products with it, around their means.

    [place, row]; one value after the other by Welford's rule, as Spark's aggregates go, so that equal values have no spread at all.
    """
    out = np.zeros((5, *values.shape))
    c, s, a, q, ax, qx, qy = np.zeros((7, values.shape[1]))
    for t in range(len(values)):
        ok = given[t]
        c = c + ok
        v = np.where(ok, values[t], 0.0)
        d = np.where(ok, v - a, 0.0)
        s, a = s + v, a + d / np.maximum(c, 1)
        q = q + d * np.where(ok, v - a, 0.0)
        dx = np.where(ok, x[t] - ax, 0.0)
        ax = ax + dx / np.maximum(c, 1)
        qx, qy = qx + dx * np.where(ok, x[t] - ax, 0.0), qy + dx * np.where(ok, v - a, 0.0)
        out[:, t] = c, s, q, qx, qy
    return out


def grid_of_arrays(scenarios: DataFrame, statics: Sequence[str] = tuple(S.STATIC_FEATURES_B2), sum_vars: Sequence[str] = tuple(S.CLIMATE_SUM),
                   mean_vars: Sequence[str] = tuple(S.CLIMATE_MEAN), horizons: Sequence[int] = tuple(S.HORIZONS), enrich_after: int = S.ENRICH_AFTER,
                   recent: int = S.RECENT_WINDOW) -> DataFrame:
    """``inference_grid`` of scenarios that carry every climate variable as an array of yearly doubles.

    Running sums over the years give all horizons of a batch of scenarios at once, so no yearly row is made, copied by horizon, sorted or grouped. The
    features are those of ``horizon_features`` (a test compares them); a horizon beyond the array takes all of it.
    """
    variables = [*sum_vars, *mean_vars]
    spark_type = {f.name: f.dataType.simpleString() for f in scenarios.schema.fields}
    parts = [(k, v) for v in variables for k in ("cum" if v in sum_vars else "mean", "std", "p10", "p90", "trend", "recent_mean")]
    features = [f"{v}_{k}" for k, v in parts]
    schema = f"scenario_id {spark_type['scenario_id']}, horizon int, " + ", ".join([*(f"`{c}` {spark_type[c]}" for c in statics), *(f"`{f}` double" for f in features)])

    def quantile(ordered: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
        at = p * np.maximum(n - 1, 0)
        lo, hi, row = np.floor(at).astype(int), np.ceil(at).astype(int), np.arange(len(n))
        low, high = ordered[lo, row], ordered[hi, row]
        return np.where((lo == hi) | (low == high), low, (hi - at) * low + (at - lo) * high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            out: dict[int, dict[tuple[str, str], np.ma.MaskedArray]] = {h: {} for h in horizons}
            seen = {h: np.zeros(rows) for h in horizons}
            for v in variables:
                lists = batch.column(v)
                flat = lists.flatten()
                given = np.ascontiguousarray(~flat.is_null().to_numpy(zero_copy_only=False).reshape(rows, -1).T)
                values = np.ascontiguousarray(flat.to_numpy(zero_copy_only=False).reshape(rows, -1).T)
                years = len(values)
                n, total, m2, xx, xy = _running(values, given, np.arange(1.0, years + 1))
                for h in horizons:
                    last, own = min(h, years) - 1, out[h]
                    c = n[last]
                    seen[h] += c
                    none, nothing = c == 0, np.full(rows, np.nan)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        own["cum" if v in sum_vars else "mean", v] = np.ma.array(total[last] if v in sum_vars else total[last] / c, mask=none)
                        own["std", v] = np.ma.array(np.sqrt(m2[last] / c), mask=none)
                        if h <= enrich_after:
                            own |= {(k, v): np.ma.array(nothing, mask=True) for k in ("p10", "p90", "trend", "recent_mean")}
                            continue
                        ordered = np.sort(np.where(given[: last + 1], values[: last + 1], np.nan), 0)  # missing last
                        own["p10", v], own["p90", v] = (np.ma.array(quantile(ordered, c, p), mask=none) for p in (0.1, 0.9))
                        own["trend", v] = np.ma.array(xy[last] / xx[last], mask=xx[last] == 0)
                        part = slice(max(h - recent, 0), last + 1)
                        late = given[part].sum(0)
                        sums = np.cumsum(np.where(given[part], values[part], 0.0), 0)[-1] if late.any() else np.zeros(rows)
                        own["recent_mean", v] = np.ma.array(sums / late, mask=late == 0)
            for h in horizons:
                at = pa.array(np.flatnonzero(seen[h] > 0))
                columns = [batch.column("scenario_id"), pa.array(np.full(rows, h, np.int32)), *(batch.column(c) for c in statics)]
                columns += [pa.array(np.ascontiguousarray(out[h][p].data), pa.float64(), mask=np.ma.getmaskarray(out[h][p])) for p in parts]
                yield pa.RecordBatch.from_arrays(columns, ["scenario_id", "horizon", *statics, *features]).take(at)

    return scenarios.select("scenario_id", *statics, *variables).mapInArrow(run, schema)


def route(scenarios: DataFrame, p_ok: str = "p_ok", p_fail: str | None = "p_fail",
          latitude: str = "latitude") -> DataFrame:
    """tree_status, yield_failed, population, branch.  Without a yield score the
    latitude rule decides (longitude is not among the routing features)."""
    failed = F.col(p_fail) > 0.5 if p_fail else F.coalesce(F.col(latitude) < S.GEO_LATITUDE, F.lit(False))
    ok = F.col(p_ok) > 0.5
    stunted = ~ok & (F.col(p_ok) > S.STUNTED_PROBABILITY)
    branch = (
        F.when(~ok & failed, "zero").when(ok, "model").when(stunted, "stunted").otherwise("zero")
    )
    return scenarios.withColumns({
        "tree_status": ok.cast("int"), "yield_failed": failed.cast("int"),
        "population": pair_label(F.when(failed, "yield_fail").otherwise("yield_ok"),
                                 F.when(ok, "tree_ok").otherwise("tree_degraded")),
        "tree_failed": (~ok & (~stunted | failed)).cast("int"), "branch": branch,
    })


def stunted_curve(profile: DataFrame, n_years: int = S.N_YEARS) -> DataFrame:
    """Yearly ratio from the fitted profile, extended beyond its knots, in [0, 1]; 1 with under two knots."""
    one = profile.select(F.lit(0).alias("_one"), "period", "profile")
    return yearly_curve(one, ["_one"], "period", "profile", n_years, extrapolate=True, hi=1.0, lone_value=1.0).select(
        "year", F.col("value").alias("ratio"))


def lookup_median(scenarios: DataFrame, medians: DataFrame, crop: str = "main_crop", out: str = "stunted_final") -> DataFrame:
    """Median final stock by crop, the overall median (crop NULL) for other crops, else 0."""
    by_crop = medians.where(F.col("crop").isNotNull()).select(F.col("crop").alias("_crop"), F.col("median").alias("_m"))
    overall = medians.where(F.col("crop").isNull()).agg(F.max("median").alias("_g"))
    found = lookup_join(scenarios.withColumn("_crop", F.col(crop).cast("string")), by_crop, ["_crop"])
    return found.join(F.broadcast(overall), F.lit(True), "left").withColumn(out, F.coalesce("_m", "_g", F.lit(0.0))).drop("_crop", "_m", "_g")


def curve_arrays(knots: DataFrame, n_years: int = S.N_YEARS) -> DataFrame:
    """Both carbon curves of a scenario as yearly arrays, one row per scenario."""
    pieces = curve_pieces(spread(knots, "scenario_id"), ["scenario_id", "target"], "horizon", "value", n_years)

    def array(target: str) -> Column:
        own = F.array_sort(F.collect_list(F.when(F.col("target") == target, F.struct("piece", "values"))))
        return F.flatten(F.transform(own, lambda p: p["values"]))

    return pieces.groupBy("scenario_id").agg(*[array(t).alias(f"_{t}") for t in STOCKS])


def cascade(routed: DataFrame, knots: DataFrame, medians: DataFrame, profile: DataFrame,
            stage2: Callable[[DataFrame], DataFrame], climate: Sequence[str] = (), n_years: int = S.N_YEARS, by_arrays: bool = False) -> DataFrame:
    """Yearly rows with all four targets.

    ``routed``: one row per scenario with routing columns, features and ``climate`` arrays.
    ``knots``: (scenario_id, target, horizon, value) of the stage-1 models.
    ``stage2`` adds ``yield_AF_raw`` and ``yield_TA_raw`` to rows that carry ``carbonStem_AF``; with ``by_arrays`` it adds them as yearly arrays to
    one row per scenario, and the climate ends there.
    Curves join as arrays at scenario grain and the years are exploded last, so
    yearly rows are never shuffled.  The four branches are disjoint conditions over
    one table; every scenario gets all four targets, also on full failure.
    """
    zeros = F.array_repeat(F.lit(0.0), n_years)
    ratios = stunted_curve(profile, n_years).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("year", "ratio"))), lambda p: p["ratio"]).alias("_ratios"))
    # Without a stunted entity in training there is no profile: the ratio is 1, as with a single knot.
    ratios = ratios.select(F.when(F.size("_ratios") > 0, F.col("_ratios")).otherwise(F.array_repeat(F.lit(1.0), n_years)).alias("_ratios"))
    # The curve table's size is underestimated after its explode, so the planner may not broadcast it.
    rows = lookup_median(spread(routed, "scenario_id"), medians).join(
        curve_arrays(knots, n_years).hint("merge"), "scenario_id", "left"
    ).join(F.broadcast(ratios), F.lit(True))  # one row of n_years ratios
    model, stunted = F.col("branch") == "model", F.col("branch") == "stunted"
    fallback = F.transform("_ratios", lambda r: F.greatest(F.lit(0.0), r * F.col("stunted_final")))
    rows = rows.withColumns({
        "carbonStem_AF": F.when(model & (F.size("_carbonStem_AF") > 0), F.col("_carbonStem_AF")).when(stunted, fallback).otherwise(zeros),
        "carbonStem_TF": F.when(model & (F.size("_carbonStem_TF") > 0), F.col("_carbonStem_TF")).otherwise(zeros),
    }).drop("_carbonStem_AF", "_carbonStem_TF", "_ratios", "stunted_final")
    rest = [c for c in rows.columns if c not in (*climate, *STOCKS)]
    series = [*climate, *STOCKS]
    if by_arrays:
        rows, series = stage2(rows), [*STOCKS, "yield_AF_raw", "yield_TA_raw"]
    yearly = rows.select(*rest, F.posexplode(F.arrays_zip(*[F.col(c) for c in series])).alias("_i", "_z")).select(
        *rest, (F.col("_i") + 1).cast("bigint").alias("year"), *[F.col(f"_z.{c}").alias(c) for c in series])
    failed = F.col("yield_failed") == 1
    return (yearly if by_arrays else stage2(yearly)).withColumns({
        t: F.when(failed, 0.0).otherwise(clip(f"{t}_raw", 0)) for t in ("yield_AF", "yield_TA")})


def format_output(rows: DataFrame) -> DataFrame:
    """Tidy long predictions."""
    keys = ["scenario_id", "year", "population", "tree_failed", "yield_failed"]
    return rows.unpivot(keys, S.CURVE_TARGETS, "target", "value")


def split_invalid(scenarios: DataFrame, statics: Sequence[str], climate: Sequence[str] = tuple(S.CLIMATE),
                  n_years: int = S.N_YEARS) -> tuple[DataFrame, DataFrame]:
    """(runnable scenarios, rejects with a reason); nothing is dropped silently."""
    tagged = scenarios.withColumn("reject_reason", invalid_reason(scenarios, statics, climate, n_years))
    return tagged.where("reject_reason is null").drop("reject_reason"), tagged.where("reject_reason is not null")
