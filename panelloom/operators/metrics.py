"""Model metrics as aggregates over (truth, prediction) rows, any grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom import spec as S
from panelloom.operators.ranks import cumulate


def regression_metrics(df: DataFrame, truth: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    """r2, rmse, mae, mape, nrmse, bias, pearson, residual std in one pass.

    A missing or non-finite input fails the job, as a silent drop would change
    every figure.
    """
    def finite(c: str) -> Column:
        ok = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        return F.when(ok, F.col(c)).otherwise(F.raise_error(F.lit(f"non-finite value in {c}")).cast("double"))

    rows = df.select(*groups, finite(truth).alias("y"), finite(predicted).alias("p"))
    r = F.col("p") - F.col("y")
    sums = rows.groupBy(*groups).agg(
        F.count("*").alias("n"),
        F.avg(r * r).alias("mse"),
        F.avg(F.abs(r)).alias("mae"),
        (F.lit(100.0) * F.avg(F.when(F.col("y") != 0, F.abs(F.try_divide(r, F.col("y")))))).alias("mape"),
        (F.max("y") - F.min("y")).alias("_range"),
        F.avg(r).alias("bias"),
        F.corr("y", "p").alias("_corr"),
        F.stddev_pop("p").alias("_sp"),
        F.stddev_pop(r).alias("std_residuals"),
        F.var_pop("y").alias("_vy"),
    )
    rmse = F.sqrt("mse")
    return sums.select(
        *groups, "n",
        F.when(F.col("_vy") > 0, 1 - F.try_divide(F.col("mse"), F.col("_vy"))).alias("r2"),
        rmse.alias("rmse"), "mae", "mape",
        F.when(F.col("_range") > 0, F.try_divide(rmse, F.col("_range"))).alias("nrmse"),
        "bias",
        F.when((F.col("_vy") > 0) & (F.col("_sp") > 0), F.col("_corr")).alias("pearson_r"),
        "std_residuals",
    )


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def auc(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve as a rank sum with average ties; NULL for a single class.

    Works on distinct scores with class counts, so it never sorts whole classes
    in one task.
    """
    steps = cumulate(
        df.withColumn("_s", F.col(score).cast("double")), groups, "_s",
        {"n": F.lit(1), "pos": F.col(label).cast("int")},
    )
    sums = steps.groupBy(*groups).agg(
        F.sum(F.col("pos") * (F.col("n_below") + (F.col("n") + 1) / 2)).alias("_ranks"),
        F.max("pos_total").alias("_p"), F.max("n_total").alias("_n"),
    )
    p, q = F.col("_p").cast("double"), (F.col("_n") - F.col("_p")).cast("double")
    return sums.select(*groups, F.when((p > 0) & (q > 0), F.try_divide(
        F.col("_ranks") - p * (p + 1) / 2, p * q)).alias("roc_auc"))


def binary_metrics(df: DataFrame, label: str, predicted: str, score: str | None = None,
                   groups: Sequence[str] = ()) -> DataFrame:
    y, z = F.col(label) == 1, F.col(predicted) == 1
    c = df.groupBy(*groups).agg(
        F.count_if(y & z).alias("tp"), F.count_if(~y & z).alias("fp"),
        F.count_if(y & ~z).alias("fn"), F.count_if(~y & ~z).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    out = c.select(
        *groups, "tp", "fp", "fn", "tn",
        F.try_divide(1.0 * (tp + tn), tp + fp + fn + tn).alias("accuracy"),
        _f1(tn, fn, fp).alias("f1_0"), _f1(tp, fp, fn).alias("f1_1"),
    ).withColumn("f1_macro", (F.col("f1_0") + F.col("f1_1")) / 2)
    if score is None:
        return out
    areas = auc(df, label, score, groups)
    return out.join(areas, list(groups)) if groups else out.join(areas, F.lit(True))


def confusion(df: DataFrame, label: str, predicted: str, classes: Sequence) -> DataFrame:
    """Truth x prediction counts, one column per predicted class."""
    table = df.groupBy(F.col(label).alias("truth")).pivot(predicted, list(classes)).agg(F.count(F.lit(1)))
    return table.select("truth", *[F.coalesce(f"`{c}`", F.lit(0)).alias(f"pred_{c}") for c in classes])


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """precision / recall / F1 / support per class seen in truth or prediction."""
    cells = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("z")).agg(F.count("*").alias("c"))
    both = cells.select(F.explode(F.array(
        F.struct(F.col("y").alias("cls"), F.when(F.col("y") == F.col("z"), F.col("c")).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("predicted"), F.col("c").alias("support")),
        F.struct(F.col("z").alias("cls"), F.lit(0).cast("bigint").alias("tp"),
                 F.col("c").alias("predicted"), F.lit(0).cast("bigint").alias("support")),
    )).alias("s")).select("s.*")
    t = both.groupBy("cls").agg(*[F.sum(k).alias(k) for k in ("tp", "predicted", "support")])
    precision = F.coalesce(F.try_divide(1.0 * F.col("tp"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(1.0 * F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("predicted") + F.col("support")), F.lit(0.0))
    return t.select("cls", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "tp", "support")


def multiclass_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    r = class_report(df, label, predicted)
    return r.agg(
        F.sum("support").alias("n"),
        F.try_divide(1.0 * F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
    )


def fold_summary(folds: DataFrame, metrics: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """mean and std (ddof=1) over folds."""
    return folds.groupBy(*groups).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics]
    )


def quality_table(metrics: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(stage, target, metric, value) rows checked against minimum values.

    A (stage, target) is OK only if every metric that has a threshold reaches
    it; a missing value counts as a failure.
    """
    limits = metrics.sparkSession.createDataFrame(
        list((thresholds or S.QUALITY_THRESHOLDS).items()), "metric string, threshold double"
    )
    checked = metrics.join(F.broadcast(limits), "metric")
    ok = F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False))
    return checked.groupBy("stage", "target").agg(
        F.count("*").alias("n_checks"), F.count_if(ok).alias("n_ok"),
        F.when(F.bool_and(ok), "OK").otherwise("WARN").alias("status"),
    )


def quality_overall(table: DataFrame) -> DataFrame:
    return table.agg(
        F.count_if(F.col("status") == "OK").alias("n_ok"), F.count("*").alias("n_total"),
        F.bool_and(F.col("status") == "OK").cast("int").alias("validated"),
    )


def top_per_group(df: DataFrame, groups: Sequence[str], value: str, k: int, tie: str) -> DataFrame:
    """k largest per group; the rank limit is applied before the shuffle too."""
    w = Window.partitionBy(*groups).orderBy(F.desc(value), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
