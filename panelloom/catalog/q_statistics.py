"""Metrics, rank correlation, kernel sensitivity, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom import spec as S
from panelloom.catalog.ctes import EVENTS, PLAN
from panelloom.catalog.q_aggregates import BOOT, boot_values
from panelloom.catalog.registry import query, sql
from panelloom.operators import aggregate as G
from panelloom.operators import metrics as M
from panelloom.operators import sensitivity as N
from panelloom.operators.split import bootstrap_samples
from panelloom.session import materialize
from panelloom.sources import presets
from panelloom.sources.readers import read_table

REG = """y as (select {g}l_extendedprice as y, l_quantity * 1500 as p from lineitem)"""


def _regression(group: str) -> str:
    by = f"{group}, " if group else ""
    return f"""select {by}count(*) as n, 1 - avg((p-y)*(p-y)) / var_pop(y) as r2, sqrt(avg((p-y)*(p-y))) as rmse, avg(abs(p-y)) as mae,
      100 * avg(case when y <> 0 then abs((p-y)/y) end) as mape, sqrt(avg((p-y)*(p-y))) / (max(y) - min(y)) as nrmse, avg(p-y) as bias,
      corr(y, p) as pearson_r, stddev_pop(p-y) as std_residuals from y {'group by 1' if group else ''}"""


@query("met_regression", sql([REG.format(g="l_returnflag, ")], _regression("l_returnflag"), "l_returnflag n",
                             "r2 rmse mae mape nrmse bias pearson_r std_residuals"))
def met_regression(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    return M.regression_metrics(li, "y", "p", ["l_returnflag"])


LAB = """lab as (select main_crop, case when c_acctbal > 4500 then 1 else 0 end as y, case when p_ok > 0.5 then 1 else 0 end as z,
  round(p_ok, 2) as s from plan),
auc as (select main_crop, (sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) as roc_auc
  from (select *, rank() over (partition by main_crop order by s) + (count(*) over (partition by main_crop, s) - 1) / 2.0 as r from lab) group by 1)"""


@query("met_binary", sql([PLAN, LAB], """select *, (f1_0 + f1_1) / 2 as f1_macro from (
    select main_crop, tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn)::double as accuracy, coalesce(2.0 * tn / nullif(2.0 * tn + fn + fp, 0), 0) as f1_0,
      coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0) as f1_1 from (
      select main_crop, count(*) filter (where y = 1 and z = 1) as tp, count(*) filter (where y = 0 and z = 1) as fp,
        count(*) filter (where y = 1 and z = 0) as fn, count(*) filter (where y = 0 and z = 0) as tn from lab group by 1)) join auc using (main_crop)""",
    "main_crop tp fp fn tn", "accuracy f1_0 f1_1 f1_macro roc_auc"))
def met_binary(spark, sf):
    p = presets.scored_plan(spark, sf).select(
        "main_crop", (F.col("c_acctbal") > 4500).cast("int").alias("y"), (F.col("p_ok") > 0.5).cast("int").alias("z"),
        F.round("p_ok", 2).alias("s"))
    return M.binary_metrics(p, "y", "z", "s", ["main_crop"])


CLS = """cls as (select o_orderstatus as y, case when o_orderpriority like '1%' then 'F' when o_orderpriority like '5%' then 'P' else 'O' end as z from orders),
cell as (select y, z, count(*) as c from cls group by 1, 2),
per as (select k.cls, coalesce(sum(c) filter (where y = k.cls and z = k.cls), 0) as tp, coalesce(sum(c) filter (where z = k.cls), 0) as predicted,
  coalesce(sum(c) filter (where y = k.cls), 0) as support from (select y as cls from cell union select z from cell) k, cell group by 1),
rep as (select cls, coalesce(tp / nullif(predicted, 0)::double, 0) as precision, coalesce(tp / nullif(support, 0)::double, 0) as recall,
  coalesce(2.0 * tp / nullif(predicted + support, 0), 0)::double as f1, tp::bigint as tp, support::bigint as support from per)"""


def classes(spark, sf):
    pri = F.col("o_orderpriority")
    return read_table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("y"),
        F.when(pri.startswith("1"), "F").when(pri.startswith("5"), "P").otherwise("O").alias("z"))


@query("met_multiclass", sql([CLS], """select sum(support)::bigint as n, sum(tp) / sum(support)::double as accuracy, avg(f1) as f1_macro,
    sum(f1 * support) / sum(support)::double as f1_weighted from rep""", "n", "accuracy f1_macro f1_weighted"))
def met_multiclass(spark, sf):
    return M.multiclass_metrics(classes(spark, sf), "y", "z")


@query("met_confusion", sql([CLS], """select y as truth, count(*) filter (where z = 'F') as "pred_F", count(*) filter (where z = 'O') as "pred_O",
    count(*) filter (where z = 'P') as "pred_P" from cls group by 1""", "truth pred_F pred_O pred_P"))
def met_confusion(spark, sf):
    return M.confusion(classes(spark, sf), "y", "z", ["F", "O", "P"])


@query("met_class_report", sql([CLS], "select * from rep", "cls tp support", "precision recall f1"))
def met_class_report(spark, sf):
    return M.class_report(classes(spark, sf), "y", "z")


FOLD = """y as (select l_orderkey % 5 as fold, l_extendedprice as y, l_quantity * 1500 as p from lineitem),
f as (select fold, 1 - avg((p-y)*(p-y)) / var_pop(y) as r2, sqrt(avg((p-y)*(p-y))) as rmse, avg(abs(p-y)) as mae from y group by 1)"""


@query("met_fold_summary", sql([FOLD], """select avg(r2) as r2_mean, avg(rmse) as rmse_mean, avg(mae) as mae_mean, stddev_samp(r2) as r2_std,
    stddev_samp(rmse) as rmse_std, stddev_samp(mae) as mae_std from f""", "", "r2_mean rmse_mean mae_mean r2_std rmse_std mae_std"))
def met_fold_summary(spark, sf):
    li = read_table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 5).alias("fold"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    return M.fold_summary(M.regression_metrics(li, "y", "p", ["fold"]), ["r2", "rmse", "mae"])


QUALITY = """m as (select 'Stage1' as stage, l_returnflag as target, 'carbon_r2' as metric, avg(l_discount) * 13 as value from lineitem group by 2
  union all select 'Stage1', l_returnflag, 'carbon_rho', avg(l_tax) * 20.5 from lineitem group by 2
  union all select 'CLF2', l_linestatus, 'clf2_accuracy', avg(l_quantity) / 29 from lineitem group by 2),
lim(metric, threshold) as (values """ + ", ".join(f"('{k}', {v})" for k, v in S.QUALITY_THRESHOLDS.items()) + """),
qt as (select stage, target, count(*) as n_checks, count(*) filter (where coalesce(value >= threshold, false)) as n_ok,
  case when bool_and(coalesce(value >= threshold, false)) then 'OK' else 'WARN' end as status from m join lim using (metric) group by 1, 2)"""


def quality(spark, sf):
    li = read_table(spark, sf, "lineitem")
    a = li.groupBy(F.col("l_returnflag").alias("target")).agg(
        (F.avg("l_discount") * 13).alias("carbon_r2"), (F.avg("l_tax") * 20.5).alias("carbon_rho"))
    a = a.unpivot(["target"], ["carbon_r2", "carbon_rho"], "metric", "value").withColumn("stage", F.lit("Stage1"))
    b = li.groupBy(F.col("l_linestatus").alias("target")).agg((F.avg("l_quantity") / 29).alias("value")).select(
        "target", F.lit("clf2_accuracy").alias("metric"), "value", F.lit("CLF2").alias("stage"))
    return M.quality_table(a.unionByName(b))


@query("met_quality_table", sql([QUALITY], "select * from qt", "stage target n_checks n_ok status"))
def met_quality_table(spark, sf):
    return quality(spark, sf)


@query("met_quality_overall", sql([QUALITY], """select count(*) filter (where status = 'OK') as n_ok, count(*) as n_total,
    cast(bool_and(status = 'OK') as int) as validated from qt""", "n_ok n_total validated"))
def met_quality_overall(spark, sf):
    return M.quality_overall(quality(spark, sf))


# --- rank correlation ------------------------------------------------------

def _pair(f, t):
    return f"""select '{f}' as feature, '{t}' as target, {f}::double as x, {t}::double as y from lineitem where {f} is not null and {t} is not null"""


SPEAR = "cells as (" + " union all ".join(_pair(f, t) for f in ("l_quantity", "l_discount") for t in ("l_extendedprice", "l_tax")) + """),
rk as (select feature, target, rank() over (partition by feature, target order by x) + (count(*) over (partition by feature, target, x) - 1) / 2.0 as rx,
  rank() over (partition by feature, target order by y) + (count(*) over (partition by feature, target, y) - 1) / 2.0 as ry from cells)"""


@query("sen_spearman", sql([SPEAR], """select feature, target, count(*) as n, round(corr(rx, ry), 4) as spearman_r,
    round(corr(rx, ry) * corr(rx, ry), 4) as spearman_r2 from rk group by 1, 2""", "feature target n", "spearman_r spearman_r2"))
def sen_spearman(spark, sf):
    return N.spearman(read_table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], ["l_extendedprice", "l_tax"])


# --- kernel sensitivity ----------------------------------------------------

def sigma_sql(source: str, slices: str, key: str, variables: list[str]) -> str:
    on = " and ".join(f"a.{s} = b.{s}" for s in slices.split()) or "true"
    cols = "".join(f"a.{s}, " for s in slices.split())
    parts = " union all ".join(f"""select {cols}'{v}' as variable, median((a.{v} - b.{v}) * (a.{v} - b.{v})) as med
      from {source} a join {source} b on {on} and a.{key} < b.{key} and a.{v} is not null and b.{v} is not null group by all""" for v in variables)
    return f"sig as (select *, case when med > 0 then sqrt(med / 2) else 1.0 end as sigma from ({parts}))"


SIGMA = sigma_sql("panel", "period", "entity", ["clim_mean", "crop_af", "clim_n"])


@query("sen_sigma", sql([EVENTS, SIGMA], "select * from sig", "period variable", "sigma"))
def sen_sigma(spark, sf):
    return N.bandwidths(presets.events_panel(spark, sf), ["period"], ["clim_mean", "crop_af", "clim_n"])


@query("sen_sigma_table", sql([sigma_sql("(select c_custkey, c_acctbal, 1 as u from customer)", "u", "c_custkey", ["c_acctbal"])],
                              "select 'c_acctbal' as variable, sigma from sig", "variable", "sigma"))
def sen_sigma_table(spark, sf):
    """Bandwidth of a whole table as one group."""
    return N.bandwidths(read_table(spark, sf, "customer"), [], ["c_acctbal"])


def hsic_sql(rows: str, features: list[str], targets: list[str], n_boot: int, size: int, slices: str = "period", key: str = "entity") -> str:
    """CTEs hv(slices, boot, feature, target, hsic) from ``rows`` (complete rows)."""
    variables = list(dict.fromkeys([*features, *targets]))
    kernel = ", ".join(f"exp(-(a.{v} - b.{v}) * (a.{v} - b.{v}) / (2 * s_{v} * s_{v})) as k_{v}" for v in variables)
    sig = ", ".join(f"max(case when variable = '{v}' then sigma end) as s_{v}" for v in variables)
    centred = ", ".join(
        f"k_{v} - avg(k_{v}) over (partition by {slices}, boot, i) - avg(k_{v}) over (partition by {slices}, boot, j) + avg(k_{v}) over (partition by {slices}, boot) as c_{v}"
        for v in variables)
    sd = ", ".join(f"stddev_pop({v}) as sd_{v}" for v in variables)
    flat = " union all ".join(
        f"""select {slices}, boot, '{f}' as feature, '{t}' as target, case when any_value(sd_{f}) > 1e-10 and any_value(sd_{t}) > 1e-10 then
        least(greatest(sum(c_{f} * c_{t}) / sqrt(greatest(sum(c_{f} * c_{f}) * sum(c_{t} * c_{t}), 1e-24 * power(any_value(m) - 1, 4))), 0), 1) else 0 end as hsic
        from cen join sds using ({slices}, boot) group by 1, 2"""
        for f in features for t in targets)
    return f"""{sigma_sql(rows, slices, key, variables)},
sw as (select {slices}, {sig} from sig group by 1),
smp as (select * from (select r.*, boot, row_number() over (partition by {slices}, boot order by md5('42:' || boot || ':' || {key}), {key}) as rn
  from {rows} r, (select unnest(range(0, {n_boot})) as boot)) where rn <= {size}),
sds as (select {slices}, boot, count(*) as m, {sd} from smp group by 1, 2),
ker as (select a.{slices}, a.boot, a.{key} as i, b.{key} as j, {kernel} from smp a join smp b on a.{slices} = b.{slices} and a.boot = b.boot join sw on sw.{slices} = a.{slices}),
cen as (select {slices}, boot, {centred} from ker),
hv as ({flat})"""


FEATURES, TARGETS = ["clim_mean", "clim_n"], ["crop_af"]
ROWS = "rows0 as (select period, entity, clim_mean, clim_n::double as clim_n, crop_af from panel where crop_af is not null)"


@query("sen_hsic_pair", sql([EVENTS, ROWS, hsic_sql("rows0", FEATURES, TARGETS, 100, 400)], "select * from hv", "period boot feature target", "hsic"))
def sen_hsic_pair(spark, sf):
    """The index of every bootstrap sample."""
    rows = materialize(presets.events_panel(spark, sf).where("crop_af is not null").select("period", "entity", *FEATURES, *TARGETS))
    sigmas = N.bandwidths(rows, ["period"], [*FEATURES, *TARGETS])
    samples = bootstrap_samples(rows, ["period"], "entity", 100, 400)
    return N.hsic_values(samples, sigmas, ["period"], FEATURES, TARGETS).withColumn("boot", F.col("boot").cast("bigint"))


RANKED = """select * exclude (best), cast(dense_rank() over (partition by period order by best desc, feature) as bigint) as feature_rank
  from (select *, max(hsic_mean) over (partition by period, feature) as best from hsum)"""
SUMMARY = """hsum as (select period, feature, target, avg(hsic) as hsic_mean, stddev_pop(hsic) as hsic_std, quantile_cont(hsic, 0.025) as hsic_ci_low,
  quantile_cont(hsic, 0.975) as hsic_ci_high from hv group by 1, 2, 3)"""


@query("sen_hsic_boot", sql([EVENTS, ROWS, hsic_sql("rows0", FEATURES, TARGETS, 100, 500), SUMMARY], RANKED,
                            "period feature target feature_rank", "hsic_mean hsic_std hsic_ci_low hsic_ci_high"))
def sen_hsic_boot(spark, sf):
    rows = presets.events_panel(spark, sf)
    return N.hsic_indices(rows, "entity", FEATURES, TARGETS, ["period"])


BY_YEAR = """onerow as (select period, entity, clim_mean, clim_n::double as clim_n, crop_af from panel where crop_af is not null),
enough as (select period, count(*) as n_obs from onerow group by 1 having count(*) >= 40),
rows0 as (select * from onerow where period in (select period from enough))"""


@query("sen_hsic_by_year", sql([EVENTS, BY_YEAR, hsic_sql("rows0", FEATURES, TARGETS, 100, 400), SUMMARY],
                               f"select *, 'all' as crop_name from ({RANKED}) join enough using (period)",
                               "period crop_name n_obs feature target feature_rank", "hsic_mean hsic_std hsic_ci_low hsic_ci_high"))
def sen_hsic_by_year(spark, sf):
    return N.hsic_by_period(presets.events_panel(spark, sf), "entity", "period", "category", FEATURES, TARGETS, min_obs=40)


@query("sen_hsic_whole")
def sen_hsic_whole(spark, sf):
    """Every row of every slice of line items; beyond SQL, as all pairs would have to be formed (tested against the exact index)."""
    return N.hsic_whole(read_table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], ["l_extendedprice", "l_tax"], ["l_linestatus", "l_returnflag"])


@query("sen_hsic_per_crop")
def sen_hsic_per_crop(spark, sf):
    return N.hsic_by_period(presets.orders_panel(spark, sf), "entity", "year", "category", ["qty", "disc"], ["revenue"], "per_crop",
                            min_obs=30)


@query("sen_hsic_dominant")
def sen_hsic_dominant(spark, sf):
    return N.hsic_by_period(presets.orders_panel(spark, sf), "entity", "year", "category", ["qty", "disc"], ["revenue"], "dominant",
                            min_obs=30)


@query("sen_warm_start")
def sen_warm_start(spark, sf):
    return N.warm_start(presets.orders_panel(spark, sf), "entity", "year", "category", ["qty", "disc"], [], ["revenue"], top_n=1, min_obs=30)


@query("sen_validate")
def sen_validate(spark, sf):
    """Index next to squared rank correlation, and their agreement per target."""
    p = presets.orders_panel(spark, sf).withColumn("key", F.concat_ws("-", "entity", "year", "category"))
    return N.rank_concordance(N.validate_against_spearman(p, "key", ["qty", "disc", "year"], ["revenue"]))


# --- top-k -----------------------------------------------------------------

@query("top_features_mean", sql([BOOT], """select feature, avg(hsic_mean) as mean_index from summ group by 1 order by 2 desc, 1 limit 2""",
                                "feature", "mean_index"))
def top_features_mean(spark, sf):
    return N.top_features(G.boot_summary(boot_values(spark, sf), ["feature", "target"], "hsic"), 2)


@query("top_importance", sql([], """select l_returnflag as target, l_shipdate_year as feature, importance, rank from (
    select *, cast(row_number() over (partition by l_returnflag order by importance desc, l_shipdate_year) as int) as rank from (
      select l_returnflag, cast(year(l_shipdate) as int) as l_shipdate_year, avg(l_extendedprice) as importance from lineitem group by 1, 2))
    where rank <= 3""", "target feature rank", "importance"))
def top_importance(spark, sf):
    table = read_table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("target"), F.year("l_shipdate").alias("feature")).agg(F.avg("l_extendedprice").alias("importance"))
    return M.top_per_group(table, ["target"], "importance", 3, "feature")


def _gap_pair(f, t):
    return f"select '{f}' as feature, '{t}' as target, {f}::double as x, {t}::double as y from panel where {f} is not null and {t} is not null"


SPEAR_GAPS = SPEAR[SPEAR.index("),\nrk as"):]


@query("sen_spearman_gaps", sql([EVENTS, "cells as (" + " union all ".join(
    _gap_pair(f, t) for f in ("clim_mean", "clim_n") for t in ("crop_af", "tree_af")) + SPEAR_GAPS],
    """select feature, target, count(*) as n, round(corr(rx, ry), 4) as spearman_r, round(corr(rx, ry) * corr(rx, ry), 4) as spearman_r2
    from rk group by 1, 2""", "feature target n", "spearman_r spearman_r2"))
def sen_spearman_gaps(spark, sf):
    """Pairs with missing values are ranked over their own complete rows."""
    return N.spearman(presets.events_panel(spark, sf), ["clim_mean", "clim_n"], ["crop_af", "tree_af"])
