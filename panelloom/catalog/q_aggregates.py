"""Aggregates, populations, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom import spec as S
from panelloom.catalog.ctes import EVENTS, FIELD, ORDERS, PLAN, POPS
from panelloom.catalog.q_prepare import EXCLUDED, EX, FLAG_SQL, flags, health, pops
from panelloom.catalog.registry import query, sql
from panelloom.functions.nullsafe import is_below, last_row, last_value, share
from panelloom.operators import aggregate as G
from panelloom.operators import classify as C
from panelloom.operators import prepare as P
from panelloom.operators.ranks import unpivot
from panelloom.operators.split import entity_split
from panelloom.sources import presets
from panelloom.sources.readers import read_table

EV, OR = presets.EVENTS, presets.ORDERS


@query("agg_exclusion_report", sql([EVENTS], f"""select *, rows_before - rows_after as rows_removed,
    100.0 * (rows_before - rows_after) / rows_before as pct_lost from (
    select count(*) as rows_before, count(*) filter (where not hit) as rows_after, count(distinct entity) as entities_before,
      count(distinct case when not hit then entity end) as entities_after,
      count(distinct case when hit then entity end) as entities_touched,
      count(distinct entity) - count(distinct case when not hit then entity end) as entities_lost
    from (select entity, coalesce(category in {EX}, false) as hit from panel))""",
    "rows_before rows_after entities_before entities_after entities_touched entities_lost rows_removed", "pct_lost"))
def agg_exclusion_report(spark, sf):
    return P.exclusion_report(presets.events_panel(spark, sf), "entity", "category", EXCLUDED)


@query("agg_exclusion_categories", sql([EVENTS], f"""select category, count(*) as rows, count(distinct entity) as entities
    from panel where category in {EX} group by 1""", "category rows entities"))
def agg_exclusion_categories(spark, sf):
    return P.exclusion_by_category(presets.events_panel(spark, sf), "entity", "category", EXCLUDED)


@query("agg_final_stock", sql([EVENTS], """select entity, arg_max(tree_af, period) filter (where tree_af is not null) as final_stock
    from panel group by 1""", "entity", "final_stock"))
def agg_final_stock(spark, sf):
    return presets.events_panel(spark, sf).groupBy("entity").agg(last_value("tree_af", ["period"]).alias("final_stock"))


@query("agg_fail_rate", sql([EVENTS, POPS], "select entity, fail_rate, fail_rate > 0.25 as failed from health", "entity failed", "fail_rate"))
def agg_fail_rate(spark, sf):
    return health(spark, sf).select("entity", "fail_rate", (F.col("fail_rate") > 0.25).alias("failed"))


@query("agg_fail_rate_split", sql([EVENTS], """select entity, avg(case when crop_af < 20 then 1.0 else 0.0 end) as af,
    avg(case when crop_ta < 20 then 1.0 else 0.0 end) as ta from panel group by 1""", "entity", "af ta"))
def agg_fail_rate_split(spark, sf):
    return presets.events_panel(spark, sf).groupBy("entity").agg(
        share(is_below("crop_af", 20)).alias("af"), share(is_below("crop_ta", 20)).alias("ta"))


@query("agg_argmax_row", sql([EVENTS], """select entity, arg_max_null(tree_af, period) as tree_af, max(period) as period
    from panel group by 1""", "entity period", "tree_af"))
def agg_argmax_row(spark, sf):
    row = last_row(["period", "tree_af"], ["period"])
    return presets.events_panel(spark, sf).groupBy("entity").agg(row.alias("r")).select("entity", "r.*")


NA = " + ".join(f"avg(case when {c} is null then 1.0 else 0.0 end)" for c in ("crop_af", "crop_ta", "tree_af"))


@query("agg_na_rate", sql([EVENTS], f"select entity, ({NA}) / 3 as na_rate, ({NA}) / 3 > 0.6 as high_na from panel group by 1",
                          "entity high_na", "na_rate"))
def agg_na_rate(spark, sf):
    return G.na_rates(presets.events_panel(spark, sf), "entity", ["crop_af", "crop_ta", "tree_af"]).withColumn(
        "high_na", F.col("na_rate") > 0.6)


@query("agg_static_first", sql([EVENTS], """select entity, arg_min(crop_af, period) filter (where crop_af is not null) as crop_af,
    arg_min(category, period) as category, arg_min(clim_max, period) as clim_max from panel group by 1""",
    "entity category", "crop_af clim_max"))
def agg_static_first(spark, sf):
    return P.static_first(presets.events_panel(spark, sf), EV, ["crop_af", "category", "clim_max"])


SIG = """sigs as (select entity, string_agg(category, '-' order by category) as signature
  from (select distinct entity, category from opanel) group by 1)"""


def signatures(spark, sf):
    return G.signatures(presets.orders_panel(spark, sf), "entity", "category")


@query("agg_signature", sql([ORDERS, SIG], "select * from sigs", "entity signature"))
def agg_signature(spark, sf):
    return signatures(spark, sf)


@query("agg_has_multi", sql([ORDERS], """select max(n) > 1 as has_multiple from (
    select count(distinct category) as n from opanel group by entity)""", "has_multiple"))
def agg_has_multi(spark, sf):
    return G.has_multiple(presets.orders_panel(spark, sf), "entity", "category")


@query("agg_signature_summary", sql([ORDERS, SIG], """select signature, count(*) as n, 100.0 * count(*) / sum(count(*)) over () as pct
    from sigs group by 1""", "signature n", "pct"))
def agg_signature_summary(spark, sf):
    return G.share_table(signatures(spark, sf), ["signature"])


LABELS6 = ", ".join(f"('{x}')" for x in S.POPULATIONS_6)
LABELS4 = ", ".join(f"('{x}')" for x in S.POPULATIONS_4)


@query("agg_population_dist", sql([EVENTS, POPS], f"""select l.population, count(s.entity) as n,
    round(100.0 * count(s.entity) / (select count(*) from pops), 1) as pct
    from (values {LABELS6}) l(population) left join pops s on s.population = l.population group by 1""", "population n", "pct"))
def agg_population_dist(spark, sf):
    return C.population_distribution(pops(spark, sf), S.POPULATIONS_6)


@query("agg_population_dist4", sql([EVENTS, POPS], f"""select l.population_binary, count(s.entity) as n,
    round(100.0 * count(s.entity) / (select count(*) from pops), 1) as pct
    from (values {LABELS4}) l(population_binary) left join pops s on s.population_binary = l.population_binary group by 1""",
    "population_binary n", "pct"))
def agg_population_dist4(spark, sf):
    return C.population_distribution(pops(spark, sf), S.POPULATIONS_4, "population_binary")


@query("pop_classify6", sql([EVENTS, POPS], "select * from pops", "entity yield_failed population", "final_stock fail_rate"))
def pop_classify6(spark, sf):
    return pops(spark, sf).select("entity", "final_stock", "fail_rate", "yield_failed", "population")


@query("pop_classify4", sql([EVENTS, POPS], "select * from pops", "entity population_binary", "final_stock fail_rate"))
def pop_classify4(spark, sf):
    return pops(spark, sf).select("entity", "final_stock", "fail_rate", "population_binary")


@query("pop_classify_hsic", sql([EVENTS], """select *, (case when af > 0.15 or ta > 0.15 then 'yield_fail' else 'yield_ok' end) || ' × ' ||
    (case when final_stock < 400 then 'tree_failed' else 'tree_ok' end) as population from (
    select entity, arg_max_null(tree_af, period) as final_stock, avg(case when crop_af < 20 then 1.0 else 0.0 end) as af,
    avg(case when crop_ta < 20 then 1.0 else 0.0 end) as ta from panel group by 1)""", "entity population", "final_stock"))
def pop_classify_hsic(spark, sf):
    return C.sensitivity_populations(presets.events_panel(spark, sf), "entity", "period", "tree_af", "crop_af", "crop_ta",
                                     20, 0.15, 400).select("entity", "final_stock", "population")


for _name, _sql in {
    "lbl_tree_fail": "case when final_stock < 300 then 1 else 0 end as tree_failed",
    "lbl_tree_degraded": "case when final_stock >= 700 then 1 else 0 end as tree_ok",
    "lbl_tree_3class": "case when final_stock < 300 then 0 when final_stock < 700 then 1 when final_stock >= 700 then 2 end as tree_class",
}.items():
    def _label(spark, sf, column=_sql.rsplit(" ", 1)[1]):
        return C.tree_labels(health(spark, sf), "entity", 300, 700).select("entity", column)

    query(_name, sql([EVENTS, POPS], f"select entity, {_sql} from health", f"entity {_sql.rsplit(' ', 1)[1]}"))(_label)


@query("lbl_yield_fail", sql([EVENTS, POPS], "select entity, case when fail_rate > 0.25 then 1 else 0 end as yield_failed from health",
                             "entity yield_failed"))
def lbl_yield_fail(spark, sf):
    return C.yield_labels(health(spark, sf), "entity", 0.25)


@query("diag_flags", sql([EVENTS, FLAG_SQL], "select * from flags", "entity carbon_dead_AF carbon_dead_TF yield_failure high_na"))
def diag_flags(spark, sf):
    return flags(spark, sf)


ANY = '("carbon_dead_AF" or "carbon_dead_TF" or yield_failure or high_na)'


@query("set_flag_union", sql([EVENTS, FLAG_SQL], f"""select 'carbon_dead_AF' as criterion, count(*) filter (where "carbon_dead_AF") as n_flagged from flags
    union all select 'carbon_dead_TF', count(*) filter (where "carbon_dead_TF") from flags
    union all select 'carbon_dead_BOTH', count(*) filter (where "carbon_dead_AF" and "carbon_dead_TF") from flags
    union all select 'yield_failure', count(*) filter (where yield_failure) from flags
    union all select 'high_na', count(*) filter (where high_na) from flags
    union all select 'TOTAL (union)', count(*) filter (where {ANY}) from flags""", "criterion n_flagged"))
def set_flag_union(spark, sf):
    return C.diagnostic_summary(flags(spark, sf))


KS = """flagged as (select p.*, f.hit from panel p join (select entity, """ + ANY + """ as hit from flags) f using (entity)),
steps as (select parameter, value, sum(a) as a, sum(b) as b from (
    select 'clim_mean' as parameter, clim_mean as value, hit::int as a, (not hit)::int as b from flagged
    union all select 'clim_max', clim_max, hit::int, (not hit)::int from flagged
    union all select 'clim_n', clim_n::double, hit::int, (not hit)::int from flagged) where value is not null group by 1, 2),
ks as (select parameter, max(gap) as ks_stat, max(na) as n_flagged, max(nb) as n_rest from (
    select parameter, abs(sum(a) over w / sum(a) over p - sum(b) over w / sum(b) over p) as gap,
      sum(a) over p as na, sum(b) over p as nb from steps
    window w as (partition by parameter order by value rows between unbounded preceding and current row),
      p as (partition by parameter)) group by 1 having max(na) > 10 and max(nb) > 10)"""


def ks(spark, sf):
    p = presets.events_panel(spark, sf).join(
        flags(spark, sf).select("entity", F.greatest(*C.CRITERIA).alias("hit")), "entity")
    return C.ks_two_sample(p, "hit", ["clim_mean", "clim_max", "clim_n"])


@query("diag_ks", sql([EVENTS, FLAG_SQL, KS], "select parameter, cast(n_flagged as bigint) as n_flagged, cast(n_rest as bigint) as n_rest, ks_stat from ks",
                      "parameter n_flagged n_rest", "ks_stat"))
def diag_ks(spark, sf):
    return ks(spark, sf).drop("p_value")


@query("top_ks", sql([EVENTS, FLAG_SQL, KS], """select parameter, ks_stat, case when lam < 0.1 then 1.0 else least(1.0, greatest(0.0,
    2 * list_sum(list_transform(range(1, 101), lambda k: (case when k % 2 = 1 then 1.0 else -1.0 end) * exp(-2.0 * k * k * lam * lam))))) end as p_value
    from (select *, sqrt(n_flagged * n_rest / (n_flagged + n_rest)::double) * ks_stat as lam from ks) order by ks_stat desc, parameter""",
    "parameter", "ks_stat p_value"))
def top_ks(spark, sf):
    return ks(spark, sf).select("parameter", "ks_stat", "p_value")


STUNTED = """ids as (select entity, row_number() over (order by md5('42:' || entity)) as rn, count(*) over () as n from (select distinct entity from panel)),
train as (select entity from ids where rn > floor(n * 0.2)),
st as (select p.entity, arg_max(tree_af, period) filter (where tree_af is not null) as final_stock, arg_max(category, period) as crop
  from panel p where p.entity in (select entity from train) group by 1
  having arg_max(tree_af, period) filter (where tree_af is not null) >= 300 and arg_max(tree_af, period) filter (where tree_af is not null) < 700)"""


def stunted(spark, sf):
    p = presets.events_panel(spark, sf)
    train = entity_split(p.select("entity").distinct(), "entity").where("split = 'train'")
    return p, G.stunted_entities(p, EV, "tree_af", "category", train, 300, 700)


@query("agg_stunted_median", sql([EVENTS, STUNTED], """select crop, median(final_stock) as median, count(*) as n_entities from st
    group by grouping sets ((crop), ())""", "crop n_entities", "median"))
def agg_stunted_median(spark, sf):
    return G.stunted_medians(stunted(spark, sf)[1])


@query("agg_stunted_profile", sql([EVENTS, STUNTED], """select period, median(least(greatest(tree_af / final_stock, 0), 1)) as profile
    from panel join st using (entity) where final_stock > 0 and tree_af is not null group by 1""", "period", "profile"))
def agg_stunted_profile(spark, sf):
    p, st = stunted(spark, sf)
    return G.stunted_profile(p, EV, "tree_af", st)


@query("agg_entity_targets", sql([EVENTS], """select entity, avg(crop_af) as crop_af, avg(crop_ta) as crop_ta,
    arg_max(tree_af, period) filter (where tree_af is not null) as tree_af from panel group by 1""", "entity", "crop_af crop_ta tree_af"))
def agg_entity_targets(spark, sf):
    return G.entity_targets(presets.events_panel(spark, sf), EV, ["crop_af", "crop_ta"], ["tree_af"])


@query("agg_guard_one_row", sql([ORDERS], """select entity, year, arg_min(disc, category) as disc, avg(revenue) as revenue, avg(qty) as qty
    from opanel group by 1, 2""", "entity year", "disc revenue qty", 2), digits=2)
def agg_guard_one_row(spark, sf):
    return G.one_row_guard(presets.orders_panel(spark, sf), ["entity", "year"], ["category"], ["disc"], ["revenue", "qty"])


@query("agg_mode_category", sql([EVENTS], """select period, category as dominant from (select period, category, row_number() over
    (partition by period order by count(*) desc, category) as rn from panel where category is not null group by 1, 2) where rn = 1""",
    "period dominant"))
def agg_mode_category(spark, sf):
    return G.dominant_category(presets.events_panel(spark, sf), "period", "category")


@query("agg_proba_stats", sql([PLAN], " union all ".join(
    f"""select '{c}' as variable, avg({c}) as mean, stddev_samp({c}) as std, quantile_cont({c}, 0.1) as p10, median({c}) as median,
    quantile_cont({c}, 0.9) as p90 from plan""" for c in ("p_ok", "p_fail")), "variable", "mean std p10 median p90"))
def agg_proba_stats(spark, sf):
    return G.probability_stats(presets.scored_plan(spark, sf), ["p_ok", "p_fail"])


@query("agg_prediction_summary", sql([EVENTS], " union all ".join(
    f"select '{c}' as target, min({c}) as min, avg({c}) as mean, max({c}) as max from panel" for c in ("crop_af", "tree_af")),
    "target", "min mean max"))
def agg_prediction_summary(spark, sf):
    long = unpivot(presets.events_panel(spark, sf), [], ["crop_af", "tree_af"], "target")
    return long.groupBy("target").agg(F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"))


BOOT = """vals as (select l_returnflag as feature, l_linestatus as target, l_orderkey % 50 as boot, avg(l_discount * l_quantity) as hsic
  from lineitem group by 1, 2, 3),
summ as (select feature, target, avg(hsic) as hsic_mean, stddev_pop(hsic) as hsic_std, quantile_cont(hsic, 0.025) as hsic_ci_low,
  quantile_cont(hsic, 0.975) as hsic_ci_high from vals group by 1, 2)"""


def boot_values(spark, sf):
    return read_table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("feature"), F.col("l_linestatus").alias("target"), (F.col("l_orderkey") % 50).alias("boot")
    ).agg(F.avg(F.col("l_discount") * F.col("l_quantity")).alias("hsic"))


@query("agg_boot_summary", sql([BOOT], "select * from summ", "feature target", "hsic_mean hsic_std hsic_ci_low hsic_ci_high"))
def agg_boot_summary(spark, sf):
    return G.boot_summary(boot_values(spark, sf), ["feature", "target"], "hsic")


@query("agg_wide_max_order", sql([BOOT], """select s.feature, s.target, s.hsic_mean, r.feature_rank from summ s join (
    select feature, row_number() over (order by max(hsic_mean) desc, feature) as feature_rank from summ group by 1) r using (feature)""",
    "feature target feature_rank", "hsic_mean"))
def agg_wide_max_order(spark, sf):
    return G.order_by_best(G.boot_summary(boot_values(spark, sf), ["feature", "target"], "hsic")).select(
        "feature", "target", "hsic_mean", "feature_rank")


@query("agg_na_stock_field", sql([FIELD], """select "SimID", (avg(case when "yield_AF" is null then 1.0 else 0.0 end) +
    avg(case when "carbonStem_AF" is null then 1.0 else 0.0 end)) / 2 as na_rate from field group by 1""", "SimID", "na_rate"))
def agg_na_stock_field(spark, sf):
    return G.na_rates(presets.field_panel(spark, sf), "SimID", ["yield_AF", "carbonStem_AF"])


@query("set_concat", sql([EVENTS], """select 'crop' as kind, entity, period, crop_af as value from panel
    union all select 'tree', entity, period, tree_af from panel""", "kind entity period", "value"))
def set_concat(spark, sf):
    """Stacked per-target frames."""
    p = presets.events_panel(spark, sf)
    crop = p.select(F.lit("crop").alias("kind"), "entity", "period", F.col("crop_af").alias("value"))
    return crop.unionByName(p.select(F.lit("tree").alias("kind"), "entity", "period", F.col("tree_af").alias("value")))
