"""Scenario analytics and plan screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom import spec as S
from panelloom.catalog.ctes import EVENTS, PLAN
from panelloom.catalog.registry import query, sql
from panelloom.operators import plan_filter as K
from panelloom.operators import scenario as C
from panelloom.sources import presets
from panelloom.sources.readers import read_table

WIDE = """wide as (select entity as scenario_id, period as year, coalesce(crop_af, 0.0) / 20 as "yield_AF", coalesce(crop_ta, 0.0) / 20 as "yield_TA",
    coalesce(tree_af, 0.0) / 10 as "carbonStem_AF", coalesce(tree_tf, 0.0) / 10 as "carbonStem_TF", "plotWidth", "plotHeight"
  from panel join plan on "SimID" = entity),
eff as (select *, "yield_AF" * ("plotWidth" - 3) / "plotWidth" as "yield_AF_eff", "carbonStem_AF" * 10000.0::double / ("plotWidth" * "plotHeight") as "carbonStem_AF_eff",
    "carbonStem_TF" * (10000.0::double / 9) as "carbonStem_TF_eff" from wide),
ryr as (select *, case when "yield_TA" <> 0 then "yield_AF_eff" / "yield_TA" end as "RYR_crop",
    case when "carbonStem_TF_eff" <> 0 then "carbonStem_AF_eff" / "carbonStem_TF_eff" end as "RYR_tree" from eff),
full_ as (select *, "RYR_crop" + "RYR_tree" as "LER" from ryr)"""


def predictions(spark, sf):
    """Long predictions of one scenario per user."""
    p = presets.events_panel(spark, sf)
    zero = F.lit(0.0)
    return p.select(
        F.col("entity").alias("scenario_id"), F.col("period").alias("year"),
        (F.coalesce("crop_af", zero) / 20).alias("yield_AF"), (F.coalesce("crop_ta", zero) / 20).alias("yield_TA"),
        (F.coalesce("tree_af", zero) / 10).alias("carbonStem_AF"), (F.coalesce("tree_tf", zero) / 10).alias("carbonStem_TF"))


def long(spark, sf):
    return predictions(spark, sf).unpivot(["scenario_id", "year"], S.CURVE_TARGETS, "target", "value")


def plots(spark, sf):
    return presets.scored_plan(spark, sf).select(F.col("SimID").alias("scenario_id"), "plotWidth", "plotHeight")


def wide(spark, sf):
    return C.relative_yields(C.effective_stocks(predictions(spark, sf).join(plots(spark, sf), "scenario_id")))


@query("scn_effective", sql([EVENTS, PLAN, WIDE], "select * from eff", "scenario_id year", "yield_AF_eff carbonStem_AF_eff carbonStem_TF_eff"))
def scn_effective(spark, sf):
    w = predictions(spark, sf).join(plots(spark, sf), "scenario_id")
    return C.effective_stocks(w).select("scenario_id", "year", "yield_AF_eff", "carbonStem_AF_eff", "carbonStem_TF_eff")


@query("scn_ryr_ler", sql([EVENTS, PLAN, WIDE], "select * from full_", "scenario_id year", "RYR_crop RYR_tree LER"))
def scn_ryr_ler(spark, sf):
    return wide(spark, sf).select("scenario_id", "year", "RYR_crop", "RYR_tree", "LER")


@query("scn_ler_mean", sql([EVENTS, PLAN, WIDE], 'select scenario_id, avg("LER") as "LER_mean" from full_ group by 1', "scenario_id", "LER_mean"))
def scn_ler_mean(spark, sf):
    return C.mean_ler(wide(spark, sf))


@query("scn_hybrid", sql([EVENTS, PLAN, WIDE], """select *, "RR_crop_cumul" + "RR_tree" as "LER" from (select scenario_id,
    case when sum("yield_TA") > 0 then sum("yield_AF_eff") / sum("yield_TA") end as "RR_crop_cumul",
    avg(case when "yield_TA" > 0.1 then "yield_AF_eff" / "yield_TA" end) as "RR_crop_mean_annual", arg_max_null("RYR_tree", year) as "RR_tree",
    count(*) filter (where not ("yield_TA" > 0.1)) as n_years_yield_excluded, arg_max(("plotWidth" - 3) / "plotWidth", year) as cult_frac,
    arg_max("yield_AF", year) as "yield_AF_final", arg_max("carbonStem_AF", year) as "carbonStem_AF_final",
    arg_max("yield_TA", year) as "yield_TA_final", arg_max("carbonStem_TF", year) as "carbonStem_TF_final" from full_ group by 1)""",
    "scenario_id n_years_yield_excluded", "RR_crop_cumul RR_crop_mean_annual RR_tree LER cult_frac yield_AF_final carbonStem_AF_final yield_TA_final carbonStem_TF_final"))
def scn_hybrid(spark, sf):
    return C.hybrid_ratios(wide(spark, sf))


@query("scn_trajectory", sql([EVENTS, PLAN, WIDE], """select *, "RR_crop_cumul" + "RYR_tree" as "LER_running" from (select scenario_id, year,
    "RYR_tree", case when sum("yield_TA") over w > 0 then sum("yield_AF_eff") over w / sum("yield_TA") over w end as "RR_crop_cumul" from full_
    window w as (partition by scenario_id order by year rows between unbounded preceding and current row))""",
    "scenario_id year", "RR_crop_cumul LER_running"))
def scn_trajectory(spark, sf):
    return C.trajectories(wide(spark, sf)).select("scenario_id", "year", "RR_crop_cumul", "LER_running")


@query("rsh_wider_longer", sql([EVENTS, PLAN, WIDE], " union all ".join(
    f"""select scenario_id, year, '{t}' as target, "{t}" as value from full_""" for t in S.CURVE_TARGETS + C.DERIVED),
    "scenario_id year target", "value"))
def rsh_wider_longer(spark, sf):
    return C.add_derived(long(spark, sf), plots(spark, sf))


LONG = "long_ as (" + " union all ".join(f"""select scenario_id, year, '{t}' as target, "{t}" as value from wide""" for t in S.CURVE_TARGETS) + ")"


@query("scn_percentile", sql([EVENTS, PLAN, WIDE, LONG], """select v.scenario_id, v.target, v.value, round_even(100.0 * avg(case when r.value <= v.value
    then 1.0 else 0.0 end), 1) as percentile from (select scenario_id, target, arg_max(value, year) as value from long_ group by 1, 2) v
    join (select * from long_ where year = (select max(year) from long_)) r using (target) group by 1, 2, 3""",
    "scenario_id target", "value percentile"))
def scn_percentile(spark, sf):
    """Every scenario's last values placed in the distribution at the last year."""
    table = long(spark, sf)
    values = table.groupBy("scenario_id", "target").agg(F.max_by("value", "year").alias("value"))
    return C.percentile_positions(values, table).select("scenario_id", "target", "value", "percentile")


@query("scn_sweep", sql([PLAN], """select "SimID", step, 41.0::double + 10.0 * step / 6 as latitude, sand from plan,
    (select cast(unnest(range(0, 7)) as int) as step)""", "SimID step", "latitude sand"))
def scn_sweep(spark, sf):
    return C.sweep_grid(presets.scored_plan(spark, sf), "latitude", 7).select("SimID", "step", "latitude", "sand")


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("scn_compare", sql([], "select cast(dayofmonth(ts) as int) as year, " + ", ".join(
    f"sum(case when event_type = '{k}' then value end) as s{k}" for k in KINDS) + " from events group by 1", "year", " ".join(f"s{k}" for k in KINDS)))
def scn_compare(spark, sf):
    """One column per scenario; here a scenario is an event type."""
    table = read_table(spark, sf, "events").groupBy(
        F.col("event_type").alias("scenario_id"), F.dayofmonth("ts").alias("year")
    ).agg(F.sum("value").alias("value")).withColumn("target", F.lit("total"))
    return C.compare(table, "total", KINDS)


@query("scn_final_table", sql([EVENTS, PLAN, WIDE, LONG], """select scenario_id, target, round(arg_max(value, year) + 1e-9, 2) as value,
    case when target like 'carbon%' then 'kgC/tree' else 't/ha' end as unit from long_ group by 1, 2""", "scenario_id target unit", "value", 2), digits=2)
def scn_final_table(spark, sf):
    return C.final_table(long(spark, sf).withColumn("value", F.col("value") + 1e-9))


# --- plan screening --------------------------------------------------------

ANN = """ann as (select *, case when p_ok > 0.5 then 1 else 0 end as clf1_tree_status, p_ok as clf1_p_tree_ok,
    case when p_fail > 0.5 then 1 else 0 end as clf2_yield_failed, 1.0::double - p_fail as clf2_p_yield_ok,
    {keep} as keep, (case when p_fail > 0.5 then 'yield_fail' else 'yield_ok' end) || ' × ' ||
    (case when p_ok > 0.5 then 'tree_ok' else 'tree_degraded' end) as predicted_population from plan)"""
VOTE, PROBA = "p_ok > 0.5 and not p_fail > 0.5", "p_ok >= 0.4 and 1.0::double - p_fail >= 0.7"


def annotated(spark, sf, **mode):
    return K.annotate(presets.scored_plan(spark, sf), F.col("p_ok"), F.col("p_fail"), **mode)


COLUMNS = ["SimID", *K.ANNOTATIONS]


@query("pre_cascade", sql([PLAN, ANN.format(keep=VOTE)], "select * from ann",
                          "SimID clf1_tree_status clf2_yield_failed keep predicted_population", "clf1_p_tree_ok clf2_p_yield_ok"))
def pre_cascade(spark, sf):
    return annotated(spark, sf).select(*COLUMNS)


@query("pre_cascade_proba", sql([PLAN, ANN.format(keep=PROBA)], "select * from ann",
                                "SimID clf1_tree_status clf2_yield_failed keep predicted_population", "clf1_p_tree_ok clf2_p_yield_ok"))
def pre_cascade_proba(spark, sf):
    return annotated(spark, sf, by_probability=True, threshold_tree=0.4, threshold_yield=0.7).select(*COLUMNS)


@query("pre_cascade_geo", sql([PLAN], """select "SimID", case when latitude < 44 and longitude > 3.5 then 1 else 0 end as clf2_yield_failed,
    case when latitude < 44 and longitude > 3.5 then 0.0 else 1.0 end::double as clf2_p_yield_ok from plan""", "SimID clf2_yield_failed", "clf2_p_yield_ok"))
def pre_cascade_geo(spark, sf):
    from panelloom.operators.prepare import geographic_rule

    out = K.annotate(presets.scored_plan(spark, sf), F.col("p_ok"), None, geographic_rule("latitude", "longitude"))
    return out.select("SimID", "clf2_yield_failed", "clf2_p_yield_ok")


@query("pre_split", sql([PLAN, ANN.format(keep=VOTE)], """select "SimID", latitude, case when keep then 'kept' else 'rejected' end as part from ann""",
                        "SimID part", "latitude"))
def pre_split(spark, sf):
    a = annotated(spark, sf)
    parts = K.kept(a).withColumn("part", F.lit("kept")).unionByName(K.rejected(a).withColumn("part", F.lit("rejected")))
    return parts.select("SimID", "latitude", "part")


SIBLING = "sib as (select distinct o_custkey as \"SimID\" from orders)"


def sibling(spark, sf):
    return read_table(spark, sf, "orders").select(F.col("o_custkey").alias("SimID")).distinct()


@query("pre_propagate", sql([PLAN, ANN.format(keep=VOTE), SIBLING], """select s."SimID", not coalesce(not a.keep, false) as keep,
    case when coalesce(not a.keep, false) then 'propagated_rejected' else 'propagated_ok' end as predicted_population
    from sib s left join ann a on cast(a."SimID" as varchar) = cast(s."SimID" as varchar)""", "SimID keep predicted_population"))
def pre_propagate(spark, sf):
    return K.propagate(sibling(spark, sf), annotated(spark, sf))


@query("pre_propagate_report", sql([PLAN, ANN.format(keep=VOTE), SIBLING], """select '_TA' as plan, false as skipped, cast(null as varchar) as reason, count(*) as n_total,
    count(*) filter (where k) as n_kept, count(*) filter (where not k) as n_rejected, round(100.0 * count(*) filter (where k) / count(*), 2) as keep_rate_pct
    from (select not coalesce(not a.keep, false) as k from sib s left join ann a using ("SimID"))
    union all select '_TF', true, 'file_not_found', null, null, null, null""", "plan skipped reason n_total n_kept n_rejected", "keep_rate_pct"))
def pre_propagate_report(spark, sf):
    return K.propagation_report({"_TA": sibling(spark, sf), "_TF": None}, annotated(spark, sf))


STATS = " union all ".join(f"""select 'scores', '{c}.{n}', round({e}, 4) from ann""" for c in ("clf1_p_tree_ok", "clf2_p_yield_ok") for n, e in [
    ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), ("p10", f"quantile_cont({c}, 0.1)"), ("median", f"median({c})"), ("p90", f"quantile_cont({c}, 0.9)")])


REPORT = f"""select 'counts' as section, 'n_total' as name, count(*)::double as value from ann
    union all select 'counts', 'n_kept', count(*) filter (where keep) from ann union all select 'counts', 'n_rejected', count(*) filter (where not keep) from ann
    union all select 'counts', 'keep_rate_pct', round(100.0 * count(*) filter (where keep) / count(*), 2) from ann
    union all select 'population_pct', predicted_population, round(100.0 * count(*) / (select count(*) from ann), 2) from ann group by 2
    union all select 'population_n', predicted_population, count(*) from ann group by 2 union all {STATS}"""


@query("pre_report", sql([PLAN, ANN.format(keep=VOTE)], REPORT, "section name", "value"))
def pre_report(spark, sf):
    return K.report(annotated(spark, sf))
