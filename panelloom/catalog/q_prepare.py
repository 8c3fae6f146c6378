"""Projections, filters, cleaning and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom import spec as S
from panelloom.catalog.ctes import EVENTS, FIELD, ORDERS, PLAN, POPS
from panelloom.catalog.registry import query, sql
from panelloom.functions.nullsafe import last_value
from panelloom.operators import classify as C
from panelloom.operators import plan_filter as K
from panelloom.operators import prepare as P
from panelloom.sources import presets
from panelloom.sources.readers import read_table

EV = presets.EVENTS


def health(spark, sf):
    return C.entity_health(presets.events_panel(spark, sf), EV, "tree_af", "crop_af", "crop_ta", 20)


def pops(spark, sf):
    return C.populations(health(spark, sf), 300, 700, 0.25)


@query("prj_relative_period", sql([FIELD], 'select "SimID", "Harvest_Year_AF", "Harvest_Year_Absolute" from fieldy',
                                  "SimID Harvest_Year_AF Harvest_Year_Absolute"))
def prj_relative_period(spark, sf):
    return P.relative_period(presets.field_panel(spark, sf), "SimID", "Harvest_Year_AF", "Harvest_Year_Absolute").select(
        "SimID", "Harvest_Year_AF", "Harvest_Year_Absolute")


@query("prj_flag_nonblank", sql([FIELD], """select "SimID", "Cycle_Nb",
    case when coalesce(trim(rot_id) <> '', false) then 1 else 0 end as "Rotation" from field""", "SimID Cycle_Nb Rotation"))
def prj_flag_nonblank(spark, sf):
    return presets.field_panel(spark, sf).select("SimID", "Cycle_Nb", P.flag_nonblank("rot_id").alias("Rotation"))


@query("prj_fillna", sql([FIELD], """select "SimID", "Cycle_Nb", coalesce(rot_id, 'monoculture') as rot_id,
    coalesce(main_crop, 'rotation') as main_crop from field""", "SimID Cycle_Nb rot_id main_crop"))
def prj_fillna(spark, sf):
    return P.derive(presets.field_panel(spark, sf)).select("SimID", "Cycle_Nb", "rot_id", "main_crop")


EXCLUDED = ["error", "signup"]
EX = "('error', 'signup')"


@query("flt_exclude_categories", sql([EVENTS], f"""select entity, period, category from panel
    where not coalesce(category in {EX}, false)""", "entity period category"))
def flt_exclude_categories(spark, sf):
    return P.exclude_categories(presets.events_panel(spark, sf), "category", EXCLUDED).select("entity", "period", "category")


@query("flt_drop_any_null", sql([EVENTS], """select entity, period, crop_af, crop_ta from panel
    where crop_af is not null and crop_ta is not null""", "entity period", "crop_af crop_ta"))
def flt_drop_any_null(spark, sf):
    return P.drop_any_null(presets.events_panel(spark, sf), ["crop_af", "crop_ta"]).select(
        "entity", "period", "crop_af", "crop_ta")


@query("flt_population", sql([EVENTS, POPS], """select p.entity, p.period, s.population, s.population_binary
    from panel p join pops s using (entity) where s.population = 'yield_ok × tree_ok'""",
    "entity period population population_binary"))
def flt_population(spark, sf):
    return C.keep_population(presets.events_panel(spark, sf), pops(spark, sf), EV).select(
        "entity", "period", "population", "population_binary")


FLAG_SQL = """flags as (
  select entity,
    coalesce(arg_max_null(tree_af, period) < 300, false) as "carbon_dead_AF",
    coalesce(arg_max_null(tree_tf, period) < 300, false) as "carbon_dead_TF",
    avg(case when coalesce(crop_ta < 10, false) then 1.0 else 0.0 end) > 0.08 as yield_failure,
    (avg(case when crop_af is null then 1.0 else 0.0 end) + avg(case when crop_ta is null then 1.0 else 0.0 end)
     + avg(case when tree_af is null then 1.0 else 0.0 end)) / 3 > 0.62 as high_na
  from panel group by entity)"""


def flags(spark, sf):
    return C.diagnostic_flags(presets.events_panel(spark, sf), EV, "tree_af", "tree_tf", "crop_ta",
                              ["crop_af", "crop_ta", "tree_af"], final_min=300, ta_min=10, ta_share=0.08, na_share=0.62)


@query("flt_apply_exclusions", sql([EVENTS, FLAG_SQL], """select entity, period, clim_n from panel where entity not in (
    select entity from flags where "carbon_dead_AF" or "carbon_dead_TF" or yield_failure or high_na)""",
    "entity period clim_n"))
def flt_apply_exclusions(spark, sf):
    return P.drop_ids(presets.events_panel(spark, sf), C.flagged(flags(spark, sf)), "entity").select("entity", "period", "clim_n")


@query("flt_horizon_window", sql([EVENTS], """select h as horizon,
    count(*) filter (where period <= h) as n_upto, count(*) filter (where period = h and tree_af is not null) as n_target,
    count(*) filter (where period between greatest(1, h - 4) and h) as n_recent
    from panel, (select unnest([5, 10, 20, 30]) as h) group by h""", "horizon n_upto n_target n_recent"))
def flt_horizon_window(spark, sf):
    """Three predicates per horizon over one scan."""
    p = presets.events_panel(spark, sf)
    t, h = F.col("period"), F.col("horizon")
    per = p.groupBy("period").agg(F.count("*").alias("n"), F.count("tree_af").alias("n_tree"))
    rows = per.withColumn("horizon", F.explode(F.lit([5, 10, 20, 30])))
    return rows.groupBy("horizon").agg(
        F.sum(F.when(t <= h, F.col("n")).otherwise(0)).alias("n_upto"),
        F.sum(F.when(t == h, F.col("n_tree")).otherwise(0)).alias("n_target"),
        F.sum(F.when(t.between(F.greatest(F.lit(1), h - 4), h), F.col("n")).otherwise(0)).alias("n_recent"))


@query("flt_min_final_stock", sql([EVENTS, POPS], """select p.entity, p.period, p.tree_af from panel p join health using (entity)
    where final_stock >= 500""", "entity period", "tree_af"))
def flt_min_final_stock(spark, sf):
    return P.keep_final_at_least(presets.events_panel(spark, sf), EV, "tree_af", 500).select("entity", "period", "tree_af")


@query("flt_nominal_ids", sql([EVENTS, POPS], """select entity, period, crop_af from panel where entity in (
    select entity from pops where population = 'yield_ok × tree_ok')""", "entity period", "crop_af"))
def flt_nominal_ids(spark, sf):
    nominal = pops(spark, sf).where(F.col("population") == S.NOMINAL)
    return P.keep_ids(presets.events_panel(spark, sf), nominal, "entity").select("entity", "period", "crop_af")


@query("prj_select_dataset", sql([FIELD], 'select latitude, "plotWidth", sand, "yield_AF" from field',
                                 "", "latitude plotWidth sand yield_AF"))
def prj_select_dataset(spark, sf):
    return P.select_dataset(presets.field_panel(spark, sf), ["latitude", "absent", "plotWidth", "clay", "sand"],
                            ["yield_AF", "gone"], exclude=["clay"])


@query("prj_constant_columns", sql([FIELD], """select 'strip_width' as variable union all select 'density_TF'
    union all select 'unused_AF'""", "variable"))
def prj_constant_columns(spark, sf):
    """The zero-variance warning of dataset selection."""
    return P.constant_columns(presets.field_panel(spark, sf))


@query("prj_reindex", sql([PLAN], """select "SimID", latitude, cast(null as double) as humidity, sand from plan""",
                          "SimID", "latitude humidity sand"))
def prj_reindex(spark, sf):
    return P.align_columns(presets.scored_plan(spark, sf), [
        ("SimID", "bigint"), ("latitude", "double"), ("humidity", "double"), ("sand", "double")])


@query("cln_drop_empty_cols", sql([FIELD], """select * exclude ("unused_AF", "density_AF", "density_TF") from field""",
    "SimID Harvest_Year_AF Cycle_Nb Crop_Name rot_id main_crop period w_type",
    "latitude longitude plotWidth plotHeight strip_width soilDepth sand clay stone waterTable yield_AF yield_TA "
    "biomass_AF biomass_TA carbonStem_AF carbonStem_TF waterStress_AF GDD_cycle_AF ETP_cycle_AF precipitation_AF "
    "frost_events_cycle_AF globalRadiation_AF maxTemperature_extreme_AF minTemperature_extreme_AF"))
def cln_drop_empty_cols(spark, sf):
    return P.drop_empty_columns(presets.field_panel(spark, sf).drop("density_AF", "density_TF"))


@query("cln_clip_fraction", sql([FIELD], """select "SimID", "Cycle_Nb", case when "waterStress_AF" is null then null
    else least(greatest("waterStress_AF", 0), 1) end as "waterStress_AF" from field""", "SimID Cycle_Nb", "waterStress_AF"))
def cln_clip_fraction(spark, sf):
    return P.clip_fractions(presets.field_panel(spark, sf)).select("SimID", "Cycle_Nb", "waterStress_AF")


@query("cln_clip_nonneg", sql([FIELD], """select "SimID", "Cycle_Nb",
    case when "yield_AF" is not null then greatest("yield_AF", 0) end as "yield_AF",
    case when "yield_TA" is not null then greatest("yield_TA", 0) end as "yield_TA" from field""",
    "SimID Cycle_Nb", "yield_AF yield_TA"))
def cln_clip_nonneg(spark, sf):
    return P.clip_nonnegative(presets.field_panel(spark, sf)).select("SimID", "Cycle_Nb", "yield_AF", "yield_TA")


@query("cln_clip_counts", sql([FIELD], """select 'yield_AF' as variable, count(*) filter (where "yield_AF" < 0) as n_clipped from field
    union all select 'yield_TA', count(*) filter (where "yield_TA" < 0) from field""", "variable n_clipped"))
def cln_clip_counts(spark, sf):
    return P.negative_counts(presets.field_panel(spark, sf), ["yield_"])


EFF = """eff as (select *, case when "plotWidth" is not null then least(greatest(("plotWidth" - strip_width) / "plotWidth", 0), 1) end as cult_frac
  from fieldy),
effs as (select *, "yield_AF" * cult_frac as "yield_eff_AF", "yield_TA" as "yield_eff_TA",
  "biomass_AF" * cult_frac as "biomass_eff_AF", "biomass_TA" as "biomass_eff_TA",
  "carbonStem_AF" * "density_AF" as "carbonStem_eff_AF", "carbonStem_TF" * "density_TF" as "carbonStem_eff_TF" from eff),
rr as (select *, case when "yield_eff_TA" > 0.001 then "yield_eff_AF" / "yield_eff_TA" end as "RR_crop_yield",
  case when "biomass_eff_TA" > 0.001 then "biomass_eff_AF" / "biomass_eff_TA" end as "RR_crop_biomass",
  case when "carbonStem_eff_TF" > 0.001 then "carbonStem_eff_AF" / "carbonStem_eff_TF" end as "RR_tree_carbonStem" from effs)"""


@query("prj_effective_crop", sql([FIELD, EFF], "select * from effs", "SimID Cycle_Nb",
                                 "cult_frac yield_eff_AF yield_eff_TA biomass_eff_AF biomass_eff_TA"))
def prj_effective_crop(spark, sf):
    return P.effective_crop(presets.field_panel(spark, sf)).select(
        "SimID", "Cycle_Nb", "cult_frac", "yield_eff_AF", "yield_eff_TA", "biomass_eff_AF", "biomass_eff_TA")


@query("prj_effective_tree", sql([FIELD, EFF], "select * from effs", "SimID Cycle_Nb", "carbonStem_eff_AF carbonStem_eff_TF"))
def prj_effective_tree(spark, sf):
    return P.effective_tree(presets.field_panel(spark, sf)).select(
        "SimID", "Cycle_Nb", "carbonStem_eff_AF", "carbonStem_eff_TF")


def ratio_rows(spark, sf):
    return P.ratios(P.effective_tree(P.effective_crop(presets.field_panel(spark, sf))))


RATIO_NAMES = ["RR_crop_yield", "RR_crop_biomass", "RR_tree_carbonStem", "LER_yield_carbonStem", "LER_biomass_carbonStem"]


@query("prj_ratios", sql([FIELD, EFF], """select *, "RR_crop_yield" + "RR_tree_carbonStem" as "LER_yield_carbonStem",
    "RR_crop_biomass" + "RR_tree_carbonStem" as "LER_biomass_carbonStem" from rr""", "SimID Cycle_Nb", " ".join(RATIO_NAMES)))
def prj_ratios(spark, sf):
    return ratio_rows(spark, sf).select("SimID", "Cycle_Nb", *RATIO_NAMES)


@query("agg_describe_ratios", sql([FIELD, EFF], " union all ".join(
    f"""select '{c}' as variable, avg(v) as mean, median(v) as median, min(v) as min, max(v) as max
    from (select {e} as v from rr)""" for c, e in [
        ("RR_crop_yield", '"RR_crop_yield"'), ("RR_tree_carbonStem", '"RR_tree_carbonStem"'),
        ("LER_yield_carbonStem", '"RR_crop_yield" + "RR_tree_carbonStem"')]), "variable", "mean median min max"))
def agg_describe_ratios(spark, sf):
    return P.describe(ratio_rows(spark, sf), ["RR_crop_yield", "RR_tree_carbonStem", "LER_yield_carbonStem"])


@query("prj_geo_rule", sql([PLAN], """select "SimID", case when latitude < 44 then 1 else 0 end as by_latitude,
    case when latitude < 44 and longitude > 3.5 then 1 else 0 end as by_both from plan""", "SimID by_latitude by_both"))
def prj_geo_rule(spark, sf):
    return presets.scored_plan(spark, sf).select(
        "SimID", P.geographic_rule().alias("by_latitude"), P.geographic_rule("latitude", "longitude").alias("by_both"))


@query("prj_climate_guard", sql([EVENTS], """select entity, period, greatest(clim_mean - 40, 0) as "GDD_cycle_AF",
    greatest(round_even(clim_max / 40 - 1, 0), 0) as "frost_events_cycle_AF", clim_mean - 50 as "minTemperature_extreme_AF" from panel""",
    "entity period", "GDD_cycle_AF frost_events_cycle_AF minTemperature_extreme_AF"))
def prj_climate_guard(spark, sf):
    p = presets.events_panel(spark, sf).select(
        "entity", "period", (F.col("clim_mean") - 40).alias("GDD_cycle_AF"),
        (F.col("clim_max") / 40 - 1).alias("frost_events_cycle_AF"), (F.col("clim_mean") - 50).alias("minTemperature_extreme_AF"))
    return P.climate_guard(p)


# --- joins -----------------------------------------------------------------

@query("jn_map_label", sql([EVENTS, POPS], "select p.entity, p.period, s.population from panel p left join pops s using (entity)",
                           "entity period population"))
def jn_map_label(spark, sf):
    return C.keep_population(presets.events_panel(spark, sf), pops(spark, sf), EV, None).select("entity", "period", "population")


@query("jn_static_climate", sql([EVENTS], """select c.c_custkey as entity, c.c_nationkey, k.clim, y.tree_af from customer c
    join (select entity, avg(clim_mean) as clim from panel where period <= 20 group by entity) k on k.entity = c.c_custkey
    left join (select entity, tree_af from panel where period = 20) y on y.entity = c.c_custkey
    where y.tree_af is not null""", "entity c_nationkey", "clim tree_af"))
def jn_static_climate(spark, sf):
    """Climate, exact-horizon target and statics: one aggregate plus one inner join."""
    p = presets.events_panel(spark, sf)
    agg = p.where("period <= 20").groupBy("entity").agg(
        F.avg("clim_mean").alias("clim"), F.max(F.when(F.col("period") == 20, F.col("tree_af"))).alias("tree_af"))
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), "c_nationkey")
    return agg.where("tree_af is not null").join(c, "entity")


@query("jn_align_xy", sql([EVENTS, POPS], """select x.entity, x.c, h.final_stock from
    (select entity, first_crop as c from (select entity, arg_min(category, period) as first_crop from panel group by entity)) x
    join health h using (entity)""", "entity c", "final_stock"))
def jn_align_xy(spark, sf):
    x = P.static_first(presets.events_panel(spark, sf), EV, ["category"]).withColumnRenamed("category", "c")
    return x.join(health(spark, sf).select("entity", "final_stock"), "entity")


@query("jn_final_value", sql([EVENTS, POPS], """select p.entity, p.period, p.tree_af, h.final_stock from panel p
    left join health h using (entity) where h.final_stock > 0""", "entity period", "tree_af final_stock"))
def jn_final_value(spark, sf):
    p = presets.events_panel(spark, sf)
    final = p.groupBy("entity").agg(last_value("tree_af", ["period"]).alias("final_stock"))
    return p.join(final, "entity", "left").where("final_stock > 0").select("entity", "period", "tree_af", "final_stock")


@query("jn_merge_global", sql([FIELD], """select s."SimID", s.latitude, s.sand, t."yield_AF", t."carbonStem_AF" from
    (select distinct "SimID", latitude, sand from field) s join (select "SimID", avg("yield_AF") as "yield_AF",
     arg_max("carbonStem_AF", "Cycle_Nb") filter (where "carbonStem_AF" is not null) as "carbonStem_AF" from field group by 1) t
    using ("SimID") where "yield_AF" is not null and "carbonStem_AF" is not null""",
    "SimID", "latitude sand yield_AF carbonStem_AF"))
def jn_merge_global(spark, sf):
    from panelloom.plans.sensitivity_study import global_dataset
    from panelloom.spec import PanelSpec

    spec = PanelSpec("SimID", "Cycle_Nb", "Crop_Name")
    return global_dataset(presets.field_panel(spark, sf), spec, ["latitude", "sand"], ["yield_AF"], ["carbonStem_AF"])


@query("jn_semi", sql([PLAN], """select o_orderkey, o_custkey from orders where o_custkey in (select "SimID" from plan where p_ok > 0.5)""",
                      "o_orderkey o_custkey"))
def jn_semi(spark, sf):
    ids = presets.scored_plan(spark, sf).where("p_ok > 0.5").select(F.col("SimID").alias("o_custkey"))
    return P.keep_ids(read_table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey")


@query("jn_anti", sql([PLAN], """select o_orderkey, o_custkey from orders where cast(o_custkey as varchar) not in
    (select cast("SimID" as varchar) from plan where p_ok > 0.5)""", "o_orderkey o_custkey"))
def jn_anti(spark, sf):
    """Ids compared as text, as sibling plans do."""
    plan = presets.scored_plan(spark, sf).select(
        F.col("SimID").alias("o_custkey"), (~(F.col("p_ok") > 0.5)).alias("keep"))
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return K.propagate(orders, plan, "o_custkey").where("keep").select("o_orderkey", "o_custkey")


@query("jn_lookup_default", sql([PLAN], """select "SimID", coalesce(m.med, 7.5)::double as stunted_final from plan left join
    (values ('wheat', 3.25)) m(crop, med) on m.crop = main_crop""", "SimID", "stunted_final"))
def jn_lookup_default(spark, sf):
    from panelloom.operators.inference import lookup_median

    medians = spark.createDataFrame([("wheat", 3.25), (None, 7.5)], "crop string, median double")
    return lookup_median(presets.scored_plan(spark, sf), medians).select("SimID", "stunted_final")


# --- cleaning aggregates ---------------------------------------------------

@query("agg_na_profile", sql([EVENTS], """select * from (""" + " union all ".join(
    f"select '{c}' as variable, count(*) as n_rows, count(*) - count({c}) as n_null, (count(*) - count({c})) / count(*)::double as null_share from panel"
    for c in ("crop_af", "crop_ta", "tree_af", "tree_tf", "clim_mean")) + ") where null_share > 0.3",
    "variable n_rows n_null", "null_share"))
def agg_na_profile(spark, sf):
    p = presets.events_panel(spark, sf).select("crop_af", "crop_ta", "tree_af", "tree_tf", "clim_mean")
    return P.null_counts(p).where("null_share > 0.3")


@query("top_null_cols", sql([EVENTS], """select * from (""" + " union all ".join(
    f"select '{c}' as variable, count(*) as n_rows, count(*) - count({c}) as n_null, (count(*) - count({c})) / count(*)::double as null_share from panel"
    for c in ("crop_af", "crop_ta", "tree_af", "tree_tf", "clim_mean")) +
    ") where null_share > 0.3 order by null_share desc, variable limit 3", "variable n_rows n_null", "null_share"))
def top_null_cols(spark, sf):
    p = presets.events_panel(spark, sf).select("crop_af", "crop_ta", "tree_af", "tree_tf", "clim_mean")
    return P.worst_null_columns(p, 0.3, 3)


@query("agg_dup_keys", sql([], """select l_orderkey, l_linenumber, count(*) as n_rows from lineitem group by 1, 2 having count(*) > 1""",
                           "l_orderkey l_linenumber n_rows"))
def agg_dup_keys(spark, sf):
    return P.duplicate_keys(read_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("agg_dedup_rows", sql([], """select distinct l_returnflag, l_linestatus, l_linenumber, l_quantity from lineitem""",
                             "l_returnflag l_linestatus l_linenumber", "l_quantity"))
def agg_dedup_rows(spark, sf):
    return read_table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity").dropDuplicates()


@query("agg_dedup_key", sql([ORDERS], """select entity, year, category, qty from (select *, row_number() over
    (partition by entity, year order by category) as rn from opanel) where rn = 1""", "entity year category", "qty"))
def agg_dedup_key(spark, sf):
    p = presets.orders_panel(spark, sf).select("entity", "year", "category", "qty")
    return P.first_per_key(p, ["entity", "year"], ["category"])


PREP = """prep as (
  select * from fieldy where not coalesce("Crop_Name" in ('error'), false)),
prepped as (
  select "SimID", "Harvest_Year_Absolute", case when coalesce(trim(rot_id) <> '', false) then 1 else 0 end as "Rotation",
    coalesce(rot_id, 'monoculture') as rot_id, coalesce(main_crop, 'rotation') as main_crop,
    greatest("yield_AF", 0) as "yield_AF", greatest("yield_TA", 0) as "yield_TA",
    least(greatest("waterStress_AF", 0), 1) as "waterStress_AF",
    greatest("yield_AF", 0) * least(greatest(("plotWidth" - strip_width) / "plotWidth", 0), 1) as "yield_eff_AF",
    "carbonStem_AF" * "density_AF" as "carbonStem_eff_AF"
  from prep where "yield_AF" is not null and "yield_TA" is not null)"""


@query("prep_pipeline", sql([FIELD, PREP], "select * from prepped", "SimID Harvest_Year_Absolute Rotation rot_id main_crop",
                         "yield_AF yield_TA waterStress_AF yield_eff_AF carbonStem_eff_AF"))
def prep_pipeline(spark, sf):
    """The whole preparation step on the field panel."""
    return P.prepare_panel(presets.field_panel(spark, sf), ["error"]).select(
        "SimID", "Harvest_Year_Absolute", "Rotation", "rot_id", "main_crop", "yield_AF", "yield_TA", "waterStress_AF",
        "yield_eff_AF", "carbonStem_eff_AF")


@query("prep_validate", sql([FIELD], "select 0 as missing_period, 0 as period_below_one, 0 as negative_effective",
                            "missing_period period_below_one negative_effective"))
def prep_validate(spark, sf):
    return P.validate_prepared(P.prepare_panel(presets.field_panel(spark, sf), ["error"]))


@query("win_last_row", sql([EVENTS], """select entity, period, crop_af, tree_af from (select *, row_number() over
    (partition by entity order by period desc) as rn from panel) where rn = 1""", "entity period", "crop_af tree_af"))
def win_last_row(spark, sf):
    return P.row_last(presets.events_panel(spark, sf), EV, ["period", "crop_af", "tree_af"])


