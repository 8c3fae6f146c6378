"""Result tables written as files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators.ranks import unpivot


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_plan(annotated: DataFrame, path: str, flag: str = "keep") -> str:
    """Filtered and rejected rows in one pass, one folder per flag value."""
    annotated.write.mode("overwrite").partitionBy(flag).option("header", True).csv(path)
    return path


def _of_run(df: DataFrame, run_id: str) -> DataFrame:
    # The folder's name is a digest, so that reading never guesses a type for it; the id itself is an ordinary column.
    return df.withColumns({"run_id": F.lit(run_id), "_run": F.concat(F.lit("r"), F.md5(F.lit(run_id)))})


def save_run(df: DataFrame, path: str, run_id: str, append: bool = True) -> str:
    """Rows of one run, beside those of other runs (or, without ``append``, instead of them).

    A run has a folder of its own that is replaced as a whole, so writing it again, after a failure or by a speculative second attempt,
    never doubles its rows and never touches another run.
    """
    writer = _of_run(df, run_id).write.mode("overwrite").partitionBy("_run")
    writer.option("partitionOverwriteMode", "dynamic" if append else "static").parquet(path)
    return path


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs below ``path``; a column that a run lacks is NULL there."""
    return spark.read.option("mergeSchema", True).parquet(path).drop("_run")


def save_metrics(spark: SparkSession, metrics: Mapping[str, float], path: str, run_id: str,
                 append: bool = True) -> str:
    """One timestamped row per run; saving a run again replaces its row."""
    row = spark.range(1).select(
        F.current_timestamp().alias("saved_at"),
        *[F.lit(float(v)).alias(k) for k, v in metrics.items()],
    )
    return save_run(row, path, run_id, append)


def with_residual(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.withColumn("residual", F.col(predicted) - F.col(truth))


def save_predictions(df: DataFrame, truth: str, predicted: str, path: str,
                     extra: Sequence[str] = ()) -> str:
    with_residual(df, truth, predicted).select(
        *extra, truth, predicted, "residual"
    ).write.mode("overwrite").parquet(path)
    return path


def save_fold_results(df: DataFrame, path: str, run_id: str = "run") -> bool:
    """Folds of one run beside those of others; writes nothing (and says so) when there are none."""
    if df.isEmpty():
        return False
    save_run(df, path, run_id)
    return True


def save_indices(df: DataFrame, path: str, kind: str = "index_type") -> str:
    """One folder per index type."""
    df.write.mode("overwrite").partitionBy(kind).parquet(path)
    return path


def save_attributions(df: DataFrame, keys: Sequence[str], features: Sequence[str], path: str) -> str:
    """Raw matrix plus its mean-absolute summary."""
    df.select(*keys, *features).write.mode("overwrite").parquet(f"{path}/raw")
    (
        unpivot(df, [], features, "feature", "attribution")
        .groupBy("feature")
        .agg(F.avg(F.abs("attribution")).alias("mean_abs"))
        .write.mode("overwrite").parquet(f"{path}/summary")
    )
    return path


def write_report(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path
