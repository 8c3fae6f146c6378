"""Population labels and class bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelloom import spec as S
from panelloom.functions.nullsafe import col


def pair_label(crop_part: Column, tree_part: Column) -> Column:
    return F.concat_ws(" × ", crop_part, tree_part)


def crop_part(failed: Column) -> Column:
    return F.when(failed, F.lit("yield_fail")).otherwise(F.lit("yield_ok"))


def tree_part_3(stock: str | Column, fail=S.TREE_FAIL, stunt=S.TREE_STUNT) -> Column:
    """failed / stunted / ok; a missing stock compares false twice, hence ok."""
    stock = col(stock)
    return (
        F.when(stock < fail, F.lit("tree_failed"))
        .when(stock < stunt, F.lit("tree_stunted"))
        .otherwise(F.lit("tree_ok"))
    )


def tree_part_2(stock: str | Column, stunt=S.TREE_STUNT) -> Column:
    """ok / degraded; a missing stock is not ok, hence degraded."""
    return F.when(col(stock) >= stunt, F.lit("tree_ok")).otherwise(F.lit("tree_degraded"))


def bin_index(value: str | Column, cuts: list[float]) -> Column:
    """Left-closed bins numbered from 0; NULL stays NULL."""
    value = col(value)
    total = sum(((value >= c).cast("int") for c in cuts[1:]), (value >= cuts[0]).cast("int"))
    return F.when(value.isNotNull(), total)
