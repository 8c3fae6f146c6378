"""Joins with a lookup table when single values hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.session import broadcast_if_small, materialize, materialize_counted

#: A value is hot from this share of the rows on; so at most 1000 values are.
HOT_SHARE = 1000


def hot_values(df: DataFrame, keys: Sequence[str], share: int = HOT_SHARE) -> DataFrame:
    """Combinations of ``keys`` (without nulls) that hold more than 1/share of the rows, at most ``share`` of them; one map-side aggregate."""
    counts, seen = materialize_counted(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), rows=F.sum("_rows"))
    return counts.where(F.col("_rows") * share > (seen["rows"] or 0)).na.drop(subset=list(keys)).select(*keys)


def split_rows(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is hot or has a null, all others); ``hot`` is broadcast, as its size is bound."""
    marked = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), list(keys), "left")
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    apart = F.coalesce("_hot", F.lit(False)) | missing
    return marked.where(apart).select(*df.columns), marked.where(~apart).select(*df.columns)


def lookup_join(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """``df`` joined (left or inner) with ``table``, a cheap or stored one with at most one row per combination of ``keys``; nulls match nothing.

    A table that is small after counting its rows and bytes is broadcast. Otherwise rows with hot keys (or ``hot``, if they are known) meet a
    broadcast of their own few entries, and only the others are shuffled on the keys, so no task gets a value's whole crowd.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unknown join {how!r}")
    keys = list(keys)
    small = broadcast_if_small(table)
    if small is not table:
        return df.join(small, keys, how)
    hot = materialize(hot_values(df, keys) if hot is None else hot)
    crowd, rest = split_rows(df, keys, hot)
    entries = table.join(F.broadcast(hot), keys, "left_semi")  # at most one row per hot value
    return crowd.join(F.broadcast(entries), keys, how).unionByName(rest.join(table, keys, how))
