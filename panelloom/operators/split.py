"""Leakage-safe entity splits, folds and samples, ordered by md5 so any engine agrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.lookup import lookup_join
from panelloom.operators.ranks import hash_rank, seeded_md5
from panelloom.session import broadcast_if_small, freeze, materialize, spread


def entity_split(entities: DataFrame, entity: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``trunc(n * share)`` entities, those smallest in hash order, become the test split."""
    ranked = hash_rank(entities, [], entity, seed)
    test = F.col("rank") < F.floor(F.col("n_stratum") * F.lit(test_share))
    return ranked.withColumn("split", F.when(test, "test").otherwise("train")).drop("rank", "n_stratum")


def entity_split_approximate(entities: DataFrame, entity: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Hash threshold instead of an exact count: no shuffle at all."""
    unit = F.conv(F.substring(seeded_md5(seed, entity), 1, 8), 16, 10).cast("double") / float(2**32)
    return entities.withColumn("split", F.when(unit < test_share, "test").otherwise("train"))


def stratified_split(entities: DataFrame, entity: str, stratum: str, test_share: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Per stratum ``max(1, trunc(n * share))`` test entities, so a singleton goes to test."""
    ranked = hash_rank(entities, [stratum], entity, seed)
    quota = F.greatest(F.lit(1), F.floor(F.col("n_stratum") * F.lit(test_share)))
    return ranked.withColumn(
        "split", F.when(F.col("rank") < quota, "test").otherwise("train")
    ).drop("rank", "n_stratum")


def deal_sizes(sizes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, from, to, folds): how the greedy balance deals entities, given (size, number of entities).

    Sizes come from the largest down; each entity goes to the fold with the fewest rows, the smallest fold of several. Entities of one size take
    folds in the order of the sorted values w_f + m * size, so a run of them is a few cycles over folds, whatever its length: ranks in
    [from, to) take ``folds`` in turn.
    """
    held, out = [0] * k, []
    for size, n in sorted(sizes, reverse=True):
        block, done = min(w // size for w in held), 0
        while done < n:
            ready = sorted((w % size, f) for f, w in enumerate(held) if w // size <= block)
            later = [w // size for w in held if w // size > block]
            cycles = (min(later) - block) if later else n  # cycles before another fold joins
            take = min(n - done, cycles * len(ready))
            folds = [f for _, f in ready]
            out.append((size, done, done + take, folds))
            for place, f in enumerate(folds):
                held[f] += size * (take // len(folds) + (place < take % len(folds)))
            done, block = done + take, block + cycles
    return out


def group_folds(df: DataFrame, entity: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Entity -> fold; the largest entities first, each to the fold with the fewest rows so far.

    Entities of one size are in hash order. The greedy rule runs over sizes, of which n rows can have at most sqrt(2n), not over entities.
    """
    sizes = materialize(df.groupBy(entity).agg(F.count("*").alias("n_rows")))
    counted = [(r["n_rows"], r["n"]) for r in sizes.groupBy("n_rows").agg(F.count(F.lit(1)).alias("n")).collect()]
    by_size: dict[int, list[tuple[int, int, list[int]]]] = {}
    for size, a, b, folds in deal_sizes(counted, k):
        by_size.setdefault(size, []).append((a, b, folds))
    dealt = df.sparkSession.createDataFrame(list(by_size.items()), "n_rows long, parts array<struct<from: long, to: long, folds: array<int>>>")
    ranked = lookup_join(hash_rank(sizes, ["n_rows"], entity, seed), dealt, ["n_rows"])
    part = F.element_at(F.filter("parts", lambda p: (p["from"] <= F.col("rank")) & (F.col("rank") < p["to"])), 1)
    turn = (F.col("rank") - part["from"]) % F.size(part["folds"])
    return ranked.select(entity, "n_rows", F.get(part["folds"], turn.cast("int")).cast("bigint").alias("fold"))


def balance_check(entities: DataFrame, stratum: str, split: str = "split", limit: float = 10.0) -> DataFrame:
    """Share of each stratum in train and test and whether they differ by more than ``limit`` points."""
    totals = entities.groupBy(stratum).agg(
        F.count_if(F.col(split) == "train").alias("n_train"), F.count_if(F.col(split) == "test").alias("n_test")
    )
    whole = Window.partitionBy(F.lit(0))  # one row per stratum
    pct_train = F.try_divide(F.lit(100.0) * F.col("n_train"), F.sum("n_train").over(whole))
    pct_test = F.try_divide(F.lit(100.0) * F.col("n_test"), F.sum("n_test").over(whole))
    out = totals.withColumns({"pct_train": pct_train, "pct_test": pct_test})
    return out.withColumn("delta_pp", F.abs(F.col("pct_test") - F.col("pct_train"))).withColumn(
        "warn", F.col("delta_pp") > limit
    )


def ratio_check(entities: DataFrame, test_share: float = 0.2, tolerance: float = 0.05, split: str = "split") -> DataFrame:
    out = entities.agg(F.avg((F.col(split) == "test").cast("int")).alias("test_share"))
    return out.withColumn("within", F.abs(F.col("test_share") - test_share) <= tolerance)


def leaking_entities(df: DataFrame, entity: str, part: str) -> DataFrame:
    """Entities found in more than one part; empty when the split is clean."""
    return df.groupBy(entity).agg(
        F.min(part).alias("_lo"), F.max(part).alias("_hi")
    ).where(F.col("_lo") != F.col("_hi")).select(entity)


def sample_rows(df: DataFrame, key: str, cap: int, seed: int = 42) -> DataFrame:
    """A uniform sample of at most ``cap`` rows: the smallest in hash order (a top-k, no full sort)."""
    return df.withColumn("_h", seeded_md5(seed, key)).orderBy("_h", key).limit(cap).drop("_h")


def bootstrap_samples(df: DataFrame, slices: Sequence[str], key: str, n_boot: int, size: int,
                      seed: int = 42) -> DataFrame:
    """Per slice and bootstrap ``min(size, n)`` rows without replacement.

    The sample is the ``size`` smallest of ``md5(seed:boot:key)``.  A digest does not
    depend on the slice, so it is taken once per key and bootstrap.  A threshold
    on the leading digits, sized from the slice count, drops most draws before
    anything meets the rows.  A (slice, bootstrap) left with too few rows takes the
    second branch, which uses every row, so the sample is exact.
    """
    keys = ["_one", *slices, "boot"]
    tagged = df.withColumn("_one", F.lit(0))
    counts = freeze(tagged.groupBy("_one", *slices).agg(F.count("*").alias("_n")))
    goal = float(size + 10 * size**0.5 + 50)
    digits = F.lower(F.lpad(F.hex(F.floor(F.lit(goal) / F.col("_n") * float(2**32))), 8, "0"))
    # Digests up to these digits, whatever follows them, are below this text; all are below "g".
    cut = F.when(F.col("_n") <= F.lit(goal), F.lit("g")).otherwise(F.concat(digits, F.lit("g")))
    limits = counts.withColumn("_cut", cut).drop("_n")
    rows = tagged.join(broadcast_if_small(limits), ["_one", *slices]).withColumn("_id", F.col(key).cast("string"))
    boots = F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))
    digest = seeded_md5(seed, F.col("boot"), "_id")
    # A key is drawn for the widest limit of its rows; the rows then look at their own.
    drawn = spread(rows.groupBy("_id").agg(F.max("_cut").alias("_widest")), "_id").withColumn("boot", boots).withColumn("_h", digest)
    drawn = drawn.where(F.col("_h") < F.col("_widest")).select(F.col("_id").alias("_drawn"), "boot", "_h")
    near = materialize(rows.join(drawn, F.col("_id").eqNullSafe(F.col("_drawn")) & (F.col("_h") < F.col("_cut"))).drop("_drawn"))
    short = freeze(
        counts.withColumn("boot", boots)
        .join(near.groupBy(*keys).agg(F.count("*").alias("_got")), keys, "left")
        .where(F.coalesce("_got", F.lit(0)) < F.least(F.lit(size), F.col("_n"))).select(*keys)
    )
    candidates = near
    if not short.isEmpty():
        again = rows.join(short, ["_one", *slices]).withColumn("_h", digest)
        candidates = near.join(short, keys, "left_anti").unionByName(again)
    w = Window.partitionBy(*keys).orderBy("_h", key)
    # The rank limit is pushed below the shuffle by the optimizer.
    return candidates.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= size).drop(
        "_rn", "_h", "_cut", "_id", "_one"
    )
