"""Inference grids, routing, cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom import spec as S
from panelloom.catalog.ctes import EVENTS, PLAN
from panelloom.catalog.q_sequences import pchip_sql
from panelloom.catalog.registry import query, sql
from panelloom.operators import inference as I
from panelloom.operators.aggregate import stunted_medians
from panelloom.plans import predict, training
from panelloom.sources import presets

# Scenarios: yearly arrays, a scalar and absent variables, all from the plan table.
SCENARIO = """scen as (select "SimID" as scenario_id, p_ok, p_fail, latitude, "plotWidth", "plotHeight", "soilDepth", sand, clay, stone, "waterTable",
    main_crop, w_type, t as year, 800.0::double + ("SimID" * t) % 97 as "GDD_cycle_AF", 300.0::double + ("SimID" + t * t) % 53 as "ETP_cycle_AF",
    400.0::double + clay as "precipitation_AF", 0.0::double as "globalRadiation_AF", cast((t + "SimID") % 7 as double) as "frost_events_cycle_AF"
  from plan, (select unnest(range(1, 41)) as t))"""


def all_years():
    return F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(S.N_YEARS).cast("bigint")))


def scenarios(spark, sf):
    k = F.col("SimID")
    years = F.sequence(F.lit(1), F.lit(40))
    return presets.scored_plan(spark, sf).select(
        k.alias("scenario_id"), "p_ok", "p_fail", "latitude", "plotWidth", "plotHeight", "soilDepth", "sand", "clay", "stone",
        "waterTable", "main_crop", "w_type",
        F.transform(years, lambda t: F.lit(800.0) + k * t % 97).alias("GDD_cycle_AF"),
        F.transform(years, lambda t: F.lit(300.0) + (k + t * t) % 53).alias("ETP_cycle_AF"),
        (F.lit(400.0) + F.col("clay")).alias("precipitation_AF"),
        F.transform(years, lambda t: ((t + k) % 7).cast("double")).alias("frost_events_cycle_AF"))


def yearly(spark, sf):
    return I.yearly_rows(scenarios(spark, sf))


@query("inf_grid", sql([PLAN, SCENARIO], """select scenario_id, h as horizon, min(sand) as sand, min(main_crop) as main_crop, sum("GDD_cycle_AF") as "GDD_cycle_AF_cum",
    stddev_pop("ETP_cycle_AF") as "ETP_cycle_AF_std", avg("frost_events_cycle_AF") as "frost_events_cycle_AF_mean",
    sum("globalRadiation_AF") as "globalRadiation_AF_cum", case when h > 10 then quantile_cont("GDD_cycle_AF", 0.1) end as "GDD_cycle_AF_p10",
    case when h > 10 then quantile_cont("GDD_cycle_AF", 0.9) end as "GDD_cycle_AF_p90",
    case when h > 10 then regr_slope("ETP_cycle_AF", year::double) end as "ETP_cycle_AF_trend",
    case when h > 10 then avg(case when year > h - 5 then "GDD_cycle_AF" end) end as "GDD_cycle_AF_recent_mean"
    from scen, (select unnest([5, 10, 20, 30, 40]) as h) where year <= h group by 1, 2""", "scenario_id horizon main_crop",
    "sand GDD_cycle_AF_cum ETP_cycle_AF_std frost_events_cycle_AF_mean globalRadiation_AF_cum GDD_cycle_AF_p10 GDD_cycle_AF_p90 "
    "ETP_cycle_AF_trend GDD_cycle_AF_recent_mean"))
def inf_grid(spark, sf):
    return I.inference_grid(yearly(spark, sf)).select(
        "scenario_id", "horizon", "sand", "main_crop", "GDD_cycle_AF_cum", "ETP_cycle_AF_std", "frost_events_cycle_AF_mean",
        "globalRadiation_AF_cum", "GDD_cycle_AF_p10", "GDD_cycle_AF_p90", "ETP_cycle_AF_trend", "GDD_cycle_AF_recent_mean")


@query("inf_rows", sql([PLAN, SCENARIO], "select * from scen", "scenario_id year main_crop",
                       "sand GDD_cycle_AF ETP_cycle_AF precipitation_AF globalRadiation_AF frost_events_cycle_AF"))
def inf_rows(spark, sf):
    return yearly(spark, sf).select("scenario_id", "year", "main_crop", "sand", "GDD_cycle_AF", "ETP_cycle_AF", "precipitation_AF",
                                    "globalRadiation_AF", "frost_events_cycle_AF")


ROUTE = """rt as (select "SimID" as scenario_id, case when p_ok > 0.5 then 1 else 0 end as tree_status, case when p_fail > 0.5 then 1 else 0 end as yield_failed,
    (case when p_fail > 0.5 then 'yield_fail' else 'yield_ok' end) || ' × ' || (case when p_ok > 0.5 then 'tree_ok' else 'tree_degraded' end) as population,
    case when p_ok > 0.5 then 0 when p_fail > 0.5 then 1 when p_ok > 0.3 then 0 else 1 end as tree_failed,
    case when p_ok > 0.5 then 'model' when p_fail > 0.5 then 'zero' when p_ok > 0.3 then 'stunted' else 'zero' end as branch,
    p_ok, latitude, main_crop, sand, clay from plan)"""


def routed(spark, sf):
    return I.route(presets.scored_plan(spark, sf).withColumnRenamed("SimID", "scenario_id"))


@query("inf_route", sql([PLAN, ROUTE], "select * from rt", "scenario_id tree_status yield_failed population tree_failed", "p_ok"))
def inf_route(spark, sf):
    return routed(spark, sf).select("scenario_id", "tree_status", "yield_failed", "population", "tree_failed", "p_ok")


@query("inf_route_geo", sql([PLAN], """select "SimID" as scenario_id, case when latitude < 44 then 1 else 0 end as yield_failed from plan""",
                            "scenario_id yield_failed"))
def inf_route_geo(spark, sf):
    """Without a yield classifier only the latitude part of the rule can apply."""
    plan = presets.scored_plan(spark, sf).withColumnRenamed("SimID", "scenario_id")
    return I.route(plan, p_fail=None).select("scenario_id", "yield_failed")


MEDIANS = """med as (select main_crop as crop, median(clay) as median from plan where main_crop is not null group by 1
  union all select null, median(clay) from plan),
prof as (select period, least(1.0, sum(n) over (order by period) / (sum(n) over () * 1.05)) as profile from (select period, count(*)::double as n from panel group by 1))"""


def fallback(spark, sf):
    """Medians of every crop and overall; profile from event counts."""
    stocks = presets.scored_plan(spark, sf).select(
        F.col("clay").alias("final_stock"), F.col("main_crop").alias("crop"))
    counts = presets.events_panel(spark, sf).groupBy("period").agg(F.count("*").alias("n"))
    from panelloom.operators.ranks import cumulate

    # Share of rows up to each period.
    steps = cumulate(counts.withColumn("p", F.col("period").cast("double")), [], "p", {"n": F.col("n")})
    profile = steps.select(F.col("p").cast("bigint").alias("period"), F.least(
        F.lit(1.0), (F.col("n_below") + F.col("n")) / (F.col("n_total") * 1.05)).alias("profile"))
    return stunted_medians(stocks).select("crop", "median"), profile


@query("inf_subroute", sql([PLAN, EVENTS, ROUTE, MEDIANS, "pk as (select 1 as g, period as x, profile as y from prof)",
                            pchip_sql("pk", "g", 40, True, "1.0", "1.0")],
                           """select scenario_id, year, branch, case when branch = 'stunted' then value * coalesce(m.median, (select median from med where crop is null))
                           else 0 end as carbon from rt join curve on branch <> 'model' left join med m on m.crop = main_crop""", "scenario_id year branch", "carbon"))
def inf_subroute(spark, sf):
    """Degraded scenarios: fallback curve above the probability limit, zero carbon below."""
    medians, profile = fallback(spark, sf)
    low = I.lookup_median(routed(spark, sf).where("branch <> 'model'"), medians).withColumn(
        "year", all_years())
    rows = low.join(F.broadcast(I.stunted_curve(profile)), "year")
    return rows.select("scenario_id", "year", "branch", F.when(
        F.col("branch") == "stunted", F.col("ratio") * F.col("stunted_final")).otherwise(0.0).alias("carbon"))


KN = """kn as (select "SimID" || ':' || target as sid, x, case when "SimID" % 11 = 0 and x > 10 then null else
    (case when target = 'carbonStem_AF' then 1.0::double else 1.5::double end) * (20 + "SimID" % 50 + (("SimID" * x) % 13)) * x / 10 end as y
  from plan, (select unnest([5, 10, 20, 30, 40]) as x), (select unnest(['carbonStem_AF', 'carbonStem_TF']) as target))"""


def knots(spark, sf):
    """Stage-1 values at the horizons; some scenarios only have the first two."""
    k = F.col("scenario_id")
    base = presets.scored_plan(spark, sf).select(F.col("SimID").alias("scenario_id")).withColumn(
        "horizon", F.explode(F.lit(S.HORIZONS))).withColumn("target", F.explode(F.lit(["carbonStem_AF", "carbonStem_TF"])))
    scale = F.when(F.col("target") == "carbonStem_AF", 1.0).otherwise(1.5)
    h = F.col("horizon")
    value = scale * (F.lit(20) + k % 50 + (k * h) % 13) * h / 10
    return base.withColumn("value", F.when(~((k % 11 == 0) & (h > 10)), value))


CASCADE = f"""{pchip_sql("kn", "sid", 40, False, None, None)},
wide as (select split_part(sid, ':', 1)::bigint as scenario_id, year, max(case when sid like '%AF' then value end) as af, max(case when sid like '%TF' then value end) as tf
  from curve group by 1, 2),
pk as (select 1 as g, period as x, profile as y from prof),
{pchip_sql("pk", "g", 40, True, "1.0", "1.0", tag="_s")},
carb as (select rt.*, w.year, case when branch = 'model' then af when branch = 'stunted' then s.value * coalesce(m.median, (select median from med where crop is null)) else 0 end as caf,
    case when branch = 'model' then tf else 0 end as ctf from rt join wide w using (scenario_id) join curve_s s on s.year = w.year left join med m on m.crop = main_crop),
casc as (select scenario_id, year, population, tree_failed, yield_failed, caf as "carbonStem_AF", ctf as "carbonStem_TF",
    case when yield_failed = 1 then 0 else greatest(6.0 - caf / 60 + sand / 100 - year / 50.0, 0) end as "yield_AF",
    case when yield_failed = 1 then 0 else greatest(5.0 + sand / 100 - year / 10.0, 0) end as "yield_TA" from carb)"""


def stage2(rows):
    """A fixed yield response, standing in for the fitted row models."""
    return rows.withColumns({
        "yield_AF_raw": 6.0 - F.col("carbonStem_AF") / 60 + F.col("sand") / 100 - F.col("year") / 50,
        "yield_TA_raw": 5.0 + F.col("sand") / 100 - F.col("year") / 10})


def cascade(spark, sf):
    rows = routed(spark, sf).select(
        "scenario_id", "population", "tree_failed", "yield_failed", "branch", "main_crop", "sand")
    medians, profile = fallback(spark, sf)
    return I.cascade(rows, knots(spark, sf), medians, profile, stage2)


@query("inf_cascade", sql([PLAN, EVENTS, ROUTE, MEDIANS, KN, CASCADE], "select * from casc", "scenario_id year population tree_failed yield_failed",
                          "carbonStem_AF carbonStem_TF yield_AF yield_TA"))
def inf_cascade(spark, sf):
    return cascade(spark, sf).select("scenario_id", "year", "population", "tree_failed", "yield_failed", *S.CURVE_TARGETS)


@query("inf_batch", sql([PLAN, EVENTS, ROUTE, MEDIANS, KN, CASCADE], " union all ".join(
    f"""select scenario_id, year, population, tree_failed, yield_failed, '{t}' as target, "{t}" as value from casc""" for t in S.CURVE_TARGETS),
    "scenario_id year population tree_failed yield_failed target", "value"))
def inf_batch(spark, sf):
    """All scenarios in one job, as tidy long predictions."""
    return I.format_output(cascade(spark, sf))


@query("inf_rejects", sql([PLAN], """select "SimID" as scenario_id, case when "SimID" % 9 = 0 then 'missing sand' else 'length of GDD_cycle_AF' end as reject_reason
    from plan where "SimID" % 9 = 0 or "SimID" % 10 = 1""", "scenario_id reject_reason"))
def inf_rejects(spark, sf):
    """Scenarios that cannot run come out with a reason instead of vanishing."""
    k = F.col("scenario_id")
    broken = scenarios(spark, sf).withColumns({
        "sand": F.when(k % 9 != 0, F.col("sand")),
        "GDD_cycle_AF": F.when(k % 10 == 1, F.slice("GDD_cycle_AF", 1, 39)).otherwise(F.col("GDD_cycle_AF"))})
    return I.split_invalid(broken, S.STATIC_FEATURES_B2)[1].select("scenario_id", "reject_reason")


@query("inf_single", sql([PLAN, EVENTS, ROUTE, MEDIANS, KN, CASCADE], """select scenario_id, max(year) as years, min("carbonStem_AF") as lowest,
    arg_max("carbonStem_AF", year) as final_carbon from casc group by 1""", "scenario_id years", "lowest final_carbon"))
def inf_single(spark, sf):
    """Per-scenario check of what a single run returns: a one-row table takes the same path."""
    return cascade(spark, sf).groupBy("scenario_id").agg(
        F.max("year").alias("years"), F.min("carbonStem_AF").alias("lowest"), F.max_by("carbonStem_AF", "year").alias("final_carbon"))


# Limits under which enough entities of the small test tables are nominal for both stages to be fitted.
FITTED_LIMITS = training.Limits(tree_fail=1, tree_stunt=2, yield_fail=0.05, yield_fail_rate=0.99)


@query("inf_fitted", sql([PLAN], """select "SimID" as scenario_id, cast(160 as bigint) as n, cast(4 as bigint) as targets, cast(40 as bigint) as years,
    cast(0 as bigint) as negative, cast(0 as bigint) as unlawful from plan"""))
def inf_fitted(spark, sf):
    """All scenarios predicted with the models of a training run: rows, and values that break the zero rules or the clips."""
    trained = training.run(presets.field_panel(spark, sf), ("error",), FITTED_LIMITS)
    long = predict.predict(scenarios(spark, sf).drop("p_ok", "p_fail"), trained)[0]
    moved = F.col("value") > 0
    unlawful = moved & F.when(F.col("target").startswith("yield"), F.col("yield_failed") == 1).otherwise(F.col("tree_failed") == 1)

    def kinds(place, n):
        """Distinct values as bits of a number, so that no row is copied for two distinct counts; a value outside fails the job."""
        bit = F.get(F.lit([1 << i for i in range(n)]).cast("array<bigint>"), (place - 1).cast("int"))
        return F.bit_count(F.bit_or(F.coalesce(bit, F.raise_error(F.lit("unknown target or year")).cast("bigint")))).cast("bigint")

    target = F.array_position(F.lit(S.CURVE_TARGETS), F.col("target"))
    return long.groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("n"), kinds(target, len(S.CURVE_TARGETS)).alias("targets"), kinds(F.col("year"), S.N_YEARS).alias("years"),
        F.count_if(~F.coalesce(F.col("value") >= 0, F.lit(False))).alias("negative"), F.count_if(unlawful).alias("unlawful"))
