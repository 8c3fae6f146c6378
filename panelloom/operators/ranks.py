"""Exact ranks, quantiles and hash order without a single-task sort.

A global (or hot-group) order is split into buckets whose totals form a small
table; a row's exact position is its bucket's offset plus its position inside
the bucket.  Values are first reduced to (value, weight) with map-side combine,
so copies of one value never meet in one sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.session import broadcast_if_small, freeze, materialize_counted

#: Rows that one bucket holds on average; the number of buckets follows from the counted rows.
BUCKET_ROWS = 50_000
MAX_BUCKETS = 1 << 16


def bucket_number(rows: int) -> int:
    return min(MAX_BUCKETS, max(4, -(-rows // BUCKET_ROWS)))


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
            name: str = "variable", value: str = "value") -> DataFrame:
    """Long form of numeric columns."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), name, value
    )


def count_below(cuts: str | Column, value: str | Column, size: int, equal: bool = False) -> Column:
    """Number of entries of a sorted array (shorter than ``size``) that are below a value (or equal to it): a
    binary search in log2(size) lambda steps."""
    cuts = F.col(cuts) if isinstance(cuts, str) else cuts
    value = F.col(value) if isinstance(value, str) else value
    steps = [2**k for k in reversed(range((size - 1).bit_length()))]
    return F.aggregate(
        F.lit(steps), F.lit(0),
        lambda at, step: at + F.when(F.get(cuts, at + step - 1) <= value if equal else F.get(cuts, at + step - 1) < value, step).otherwise(0),
    )


def value_totals(df: DataFrame, keys: Sequence[str], value: str,
                 weights: Mapping[str, Column]) -> tuple[DataFrame, int]:
    """Distinct values with summed weights and their number.  Written once: the passes
    below read this reduced table instead of the input."""
    table, seen = materialize_counted(
        df.where(F.col(value).isNotNull()).withColumn("_all", F.lit(0)).groupBy(*keys, value)
        .agg(*[F.sum(w).alias(n) for n, w in weights.items()])
    )
    return table, seen["n"]


def bucket_values(totals: DataFrame, keys: Sequence[str], value: str, weights: Sequence[str],
                  buckets: int) -> tuple[DataFrame, DataFrame]:
    """(totals with a bucket number in value order, bucket weights with offsets and group totals)."""
    probabilities = F.lit([i / buckets for i in range(1, buckets)])
    # Approximate cut points only steer the load; they are frozen because both
    # uses must see the same ones for the result to be exact.
    cuts = freeze(
        totals.groupBy(*keys).agg(
            F.array_distinct(F.percentile_approx(value, probabilities, 10 * buckets)).alias("_cuts")
        )
    )
    bucketed = (
        totals.join(broadcast_if_small(cuts, 2_000), list(keys))
        .withColumn("_b", count_below("_cuts", value, buckets)).drop("_cuts")
    )
    per_bucket = bucketed.groupBy(*keys, "_b").agg(*[F.sum(n).alias(f"{n}_in") for n in weights])
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_bucket.withColumns(
        {f"{n}_off": F.coalesce(F.sum(f"{n}_in").over(upto), F.lit(0)) for n in weights}
        | {f"{n}_total": F.sum(f"{n}_in").over(whole) for n in weights}
    )
    return bucketed, offsets


def _before(keys: Sequence[str], value: str):
    return Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)


def cumulate(df: DataFrame, groups: Sequence[str], value: str, weights: Mapping[str, Column] | None = None,
             buckets: int | None = None) -> DataFrame:
    """One row per distinct value: weight, weight strictly below, and group total."""
    weights = dict(weights or {"n": F.lit(1)})
    keys = [*groups, "_all"]
    totals, n_values = value_totals(df, keys, value, weights)
    ranked = cumulate_totals(totals, keys, value, list(weights), buckets or bucket_number(n_values))
    return ranked.select(*groups, value, *[c for n in weights for c in (n, f"{n}_below", f"{n}_total")])


def cumulate_totals(totals: DataFrame, keys: Sequence[str], value: str, weights: Sequence[str], buckets: int) -> DataFrame:
    """``totals`` (a written table, one row per group and value) with the weights strictly below and those of the group."""
    bucketed, offsets = bucket_values(totals, keys, value, weights, buckets)
    return bucketed.join(offsets, [*keys, "_b"]).withColumns({
        f"{n}_below": F.col(f"{n}_off") + F.coalesce(F.sum(n).over(_before([*keys, "_b"], value)), F.lit(0))
        for n in weights
    })


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Mapping[str, float],
                    buckets: int | None = None) -> DataFrame:
    """Linearly interpolated quantiles per group; only buckets holding a wanted rank are sorted."""
    keys = [*groups, "_all"]
    totals, n_values = value_totals(df, keys, value, {"n": F.lit(1)})
    position = {q: F.lit(float(p)) * (F.col("n_total") - 1) for q, p in probs.items()}

    def holds(lo: Column, width: Column, rank: Column) -> Column:
        return (rank >= lo) & (rank < lo + width)

    bucketed, offsets = bucket_values(totals, keys, value, ["n"], buckets or bucket_number(n_values))
    wanted = F.lit(False)
    for pos in position.values():
        for rank in (F.floor(pos), F.ceil(pos)):
            wanted = wanted | holds(F.col("n_off"), F.col("n_in"), rank)
    ranked = bucketed.join(offsets.where(wanted), [*keys, "_b"]).withColumn(
        "_lo", F.col("n_off") + F.coalesce(F.sum("n").over(_before([*keys, "_b"], value)), F.lit(0))
    )
    picks = []
    for q, pos in position.items():
        for suffix, rank in (("0", F.floor(pos)), ("1", F.ceil(pos))):
            picks.append(F.max(F.when(holds(F.col("_lo"), F.col("n"), rank), F.col(value))).alias(f"_{q}{suffix}"))
    picked = ranked.groupBy(*keys).agg(*picks, F.max("n_total").alias("n_total"))
    return picked.select(
        *groups,
        *[
            (F.col(f"_{q}0") + (pos - F.floor(pos)) * (F.col(f"_{q}1") - F.col(f"_{q}0"))).alias(q)
            for q, pos in position.items()
        ],
        F.col("n_total").alias("n_values"),
    )


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Mapping[str, float],
                     groups: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of several columns at once, one row per (group, variable)."""
    return exact_quantiles(unpivot(df, groups, columns), [*groups, "variable"], "value", probs)


def rank_average(df: DataFrame, groups: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Average-tie rank (1-based) joined to every row with a value; values with many ties are not shuffled (see ``lookup_join``)."""
    from panelloom.operators.lookup import HOT_SHARE, lookup_join

    ranks, seen = materialize_counted(cumulate(df, groups, value), rows=F.sum("n"))
    rows = seen["rows"] or 0
    keys = [*groups, value]
    hot = ranks.where(F.col("n") * HOT_SHARE > rows).select(*keys)
    return lookup_join(df, ranks.select(*keys, (F.col("n_below") + (F.col("n") + 1) / 2).alias(out)), keys, "inner", hot)


def seeded_md5(seed: int | str, *ids: str | Column) -> Column:
    """Hex digest that orders ids the same way in any engine."""
    parts = [F.lit(str(seed)), *[(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]]
    return F.md5(F.concat_ws(":", *parts))


def hash_rank(df: DataFrame, strata: Sequence[str], entity: str, seed: int | str, out: str = "rank",
              total: str = "n_stratum", lead: Sequence[str] = ()) -> DataFrame:
    """Exact 0-based rank by ``(lead..., md5(seed:entity))`` within each stratum.

    Buckets are leading hash digits, so even one stratum with most entities
    spreads evenly over sort groups, whose number follows from the row count.  The input is one row
    per entity and is written once, as it is read twice.
    """
    keys = [*strata, "_all"]
    rows, seen = materialize_counted(df.withColumn("_all", F.lit(0)).withColumn("_h", seeded_md5(seed, entity)))
    digits = max(1, (bucket_number(seen["n"]) - 1).bit_length() // 4 + 1)
    tagged = rows.withColumn("_b", F.substring("_h", 1, digits))
    per_bucket = tagged.groupBy(*keys, *lead, "_b").agg(F.count("*").alias("_in"))
    offsets = per_bucket.withColumn(
        "_off", F.coalesce(F.sum("_in").over(_before([*keys, *lead], "_b")), F.lit(0)))
    if lead:
        per_lead = per_bucket.groupBy(*keys, *lead).agg(F.sum("_in").alias("_lead_in"))
        upto = Window.partitionBy(*keys).orderBy(*lead).rowsBetween(Window.unboundedPreceding, -1)
        per_lead = per_lead.select(
            *keys, *lead, F.coalesce(F.sum("_lead_in").over(upto), F.lit(0)).alias("_lead_off"),
            F.sum("_lead_in").over(Window.partitionBy(*keys)).alias(total),
        )
        offsets = offsets.join(per_lead, [*keys, *lead]).withColumn("_off", F.col("_off") + F.col("_lead_off")).drop("_lead_off")
    else:
        offsets = offsets.withColumn(total, F.sum("_in").over(Window.partitionBy(*keys)))
    inside = Window.partitionBy(*keys, *lead, "_b").orderBy("_h", entity)
    return (
        tagged.join(offsets.drop("_in"), [*keys, *lead, "_b"])
        .withColumn(out, F.col("_off") + F.row_number().over(inside) - 1)
        .drop("_h", "_b", "_off", "_all")
    )
