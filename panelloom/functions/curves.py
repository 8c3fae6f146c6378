"""Monotone piecewise cubic curves (Fritsch & Butland 1984) as window expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.spec import N_YEARS


def _end_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    raw = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return (
        F.when(F.signum(raw) != F.signum(d0), F.lit(0.0))
        .when((F.signum(d0) != F.signum(d1)) & (F.abs(raw) > 3 * F.abs(d0)), 3 * d0)
        .otherwise(raw)
    )


def _segments(knots: DataFrame, keys: Sequence[str], x: str, y: str, n_years: int, extrapolate: bool,
              hi: float | None, lone_value: float | None) -> tuple[DataFrame, Callable[[Column], Column]]:
    """One row per knot with the years ``_from.._to`` it covers, and the value expression of a year."""
    # Knots without a value sort last and act as absent.
    df = knots.select(*keys, x, F.col(y).cast("double").alias("_y")).withColumn(
        "_x", F.when(F.col("_y").isNotNull(), F.col(x).cast("double"))
    )
    order = Window.partitionBy(*keys).orderBy(F.col("_x").asc_nulls_last())
    whole = Window.partitionBy(*keys)
    df = df.withColumns({
        "_rn": F.row_number().over(order), "_n": F.count("_x").over(whole),
        "_xp": F.lag("_x").over(order), "_yp": F.lag("_y").over(order),
        "_xn": F.lead("_x").over(order), "_yn": F.lead("_y").over(order),
        "_xpp": F.lag("_x", 2).over(order), "_ypp": F.lag("_y", 2).over(order),
        "_xnn": F.lead("_x", 2).over(order), "_ynn": F.lead("_y", 2).over(order),
    })
    c = F.col

    def slope(x0: str, y0: str, x1: str, y1: str) -> Column:
        return F.try_divide(c(y1) - c(y0), c(x1) - c(x0))

    hp, hn = c("_x") - c("_xp"), c("_xn") - c("_x")
    dp, dn = slope("_xp", "_yp", "_x", "_y"), slope("_x", "_y", "_xn", "_yn")
    w1, w2 = 2 * hn + hp, hn + 2 * hp
    interior = F.when(dp * dn <= 0, F.lit(0.0)).otherwise((w1 + w2) / (w1 / dp + w2 / dn))
    head = F.when(c("_n") == 2, dn).otherwise(
        _end_slope(hn, c("_xnn") - c("_xn"), dn, slope("_xn", "_yn", "_xnn", "_ynn"))
    )
    tail = F.when(c("_n") == 2, dp).otherwise(
        _end_slope(hp, c("_xp") - c("_xpp"), dp, slope("_xpp", "_ypp", "_xp", "_yp"))
    )
    df = df.withColumn(
        "_m", F.when(c("_n") < 2, F.lit(0.0)).when(c("_rn") == 1, head).when(c("_rn") == c("_n"), tail)
        .when(c("_rn") < c("_n"), interior)
    ).withColumns({"_mp": F.lag("_m").over(order), "_mn": F.lead("_m").over(order)})

    # Each knot carries the cubic of the segment it starts (the last knot: of the one it ends),
    # so only four coefficients travel through the explode.
    first, last = c("_rn") == 1, c("_rn") >= c("_n")
    ay, am = F.when(last, c("_yp")).otherwise(c("_y")), F.when(last, c("_mp")).otherwise(c("_m"))
    bm = F.when(last, c("_m")).otherwise(c("_mn"))
    h, d = F.when(last, hp).otherwise(hn), F.when(last, dp).otherwise(dn)
    df = df.select(
        *keys, "_rn", "_n", "_x", "_y", "_xn", F.when(last, c("_xp")).otherwise(c("_x")).alias("_a"),
        ay.alias("_c0"), am.alias("_c1"), ((3 * d - 2 * am - bm) / h).alias("_c2"), ((am + bm - 2 * d) / (h * h)).alias("_c3"),
    )
    start = F.when(first, F.lit(1)).otherwise(c("_x").cast("int"))
    stop = F.least(F.lit(n_years), F.when(last, F.lit(n_years)).otherwise(c("_xn").cast("int") - 1))
    emits = (first | (c("_rn") <= c("_n"))) & (start <= stop)
    df = df.withColumns({"_from": start, "_to": stop}).where(emits)

    def value(year: Column) -> Column:
        t = year - c("_a")
        cubic = c("_c0") + t * (c("_c1") + t * (c("_c2") + t * c("_c3")))
        outside = (first & (year < c("_x"))) | (last & (year > c("_x")))
        curve = cubic if extrapolate else F.when(outside, F.lit(0.0)).otherwise(cubic)
        none = F.lit(0.0 if lone_value is None else float(lone_value))
        one = c("_y") if lone_value is None else F.lit(float(lone_value))
        out = F.greatest(F.lit(0.0), F.when(c("_n") == 0, none).when(c("_n") == 1, one).otherwise(curve))
        return out if hi is None else F.least(F.lit(float(hi)), out)

    return df, value


def yearly_curve(knots: DataFrame, keys: Sequence[str], x: str, y: str, n_years: int = N_YEARS,
                 extrapolate: bool = False, hi: float | None = None, lone_value: float | None = None) -> DataFrame:
    """One row per key and year 1..n_years from knots ``(x, y)``; a key has a few knots.

    Without ``extrapolate`` years outside the knots are 0.  One knot gives a
    constant curve, no knot zeros; ``lone_value`` replaces both.  Values are
    clipped to ``[0, hi]``.  Each knot row emits its own years, so there is no
    spine join.
    """
    df, value = _segments(knots, keys, x, y, n_years, extrapolate, hi, lone_value)
    years = df.withColumn("year", F.explode(F.sequence("_from", "_to")))
    return years.select(*keys, F.col("year").cast("bigint").alias("year"), value(F.col("year")).alias("value"))


def curve_pieces(knots: DataFrame, keys: Sequence[str], x: str, y: str, n_years: int = N_YEARS) -> DataFrame:
    """The same curve as one array of yearly values per knot, to be joined in ``piece`` order."""
    df, value = _segments(knots, keys, x, y, n_years, False, None, None)
    return df.select(*keys, F.col("_rn").alias("piece"), F.transform(F.sequence("_from", "_to"), value).alias("values"))
