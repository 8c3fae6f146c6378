"""SQL twins of the preset panels."""

EVENTS = """d as (
  select user_id as entity, cast(ts as date) as day,
    sum(case when event_type='click' then value end) as crop_af,
    sum(case when event_type='view' then value end) as crop_ta,
    sum(case when event_type='purchase' then value end) as inc_af,
    sum(case when event_type='signup' then value end) as inc_tf,
    avg(value) as clim_mean, max(value) as clim_max, count(*) as clim_n, min(event_type) as category
  from events group by 1, 2),
panel as (
  select entity, day, date_diff('day', min(day) over (partition by entity), day) + 1 as period, category,
    crop_af, crop_ta,
    case when inc_af is not null then sum(inc_af) over w end as tree_af,
    case when inc_tf is not null then sum(inc_tf) over w end as tree_tf,
    clim_mean, clim_max, clim_n
  from d window w as (partition by entity order by day rows between unbounded preceding and current row))"""

ORDERS = """opanel as (
  select o_custkey as entity, cast(extract(year from o_orderdate) as bigint) as year,
    o_orderpriority as category, sum(l_quantity) as qty,
    sum(l_extendedprice * (1 - l_discount)) as revenue, avg(l_discount) as disc
  from orders join lineitem on l_orderkey = o_orderkey group by 1, 2, 3)"""

PLAN = """plan as (
  select c_custkey as "SimID", (c_custkey * 7919 % 1000) / 1000.0 as p_ok, (c_custkey * 104729 % 1000) / 1000.0 as p_fail,
    41.0::double + (c_custkey * 37 % 100) / 10.0 as latitude, -5.0::double + (c_custkey * 53 % 145) / 10.0 as longitude,
    case when c_nationkey % 2 = 0 then 'wheat' else 'maize' end as main_crop,
    case when c_nationkey % 3 = 0 then 'CONST' else 'VAR' end as w_type,
    4.0::double + c_custkey % 21 as "plotWidth", 6.0::double + c_custkey % 25 as "plotHeight",
    0.5::double + (c_custkey * 7 % 75) / 10.0 as "soilDepth", 10.0::double + c_custkey * 13 % 71 as sand,
    5.0::double + c_custkey * 17 % 46 as clay, cast(c_custkey * 29 % 31 as double) as stone,
    cast(c_custkey % 2 as double) as "waterTable", c_acctbal
  from customer)"""

FIELD = EVENTS + ",\n" + PLAN + """,
field as (
  select x."SimID", cast(year(day) + dayofyear(day) as bigint) as "Harvest_Year_AF", p.period as "Cycle_Nb",
    p.category as "Crop_Name",
    case when c_mktsegment = 'BUILDING' then null when c_mktsegment = 'MACHINERY' then '  ' else c_mktsegment end as rot_id,
    case when c_nationkey % 3 = 0 then 'wheat' when c_nationkey % 3 = 1 then 'maize' end as main_crop,
    'FUT' as "period", x.w_type, x.latitude, x.longitude, x."plotWidth", x."plotHeight", 3.0::double as strip_width,
    x."soilDepth", x.sand, x.clay, x.stone, x."waterTable",
    10000.0::double / (x."plotWidth" * x."plotHeight") as "density_AF", 10000.0::double / 9 as "density_TF",
    crop_af / 20 - 0.1::double as "yield_AF", crop_ta / 20 - 0.1::double as "yield_TA",
    crop_af / 8 as "biomass_AF", crop_ta / 8 as "biomass_TA",
    tree_af / 10 as "carbonStem_AF", tree_tf / 10 as "carbonStem_TF",
    clim_mean / 50 - 0.2::double as "waterStress_AF",
    800.0::double + clim_mean * 10 as "GDD_cycle_AF", 300.0::double + clim_max as "ETP_cycle_AF",
    250.0::double + clim_max * 2 as "precipitation_AF", cast(clim_n as double) as "frost_events_cycle_AF",
    4000.0::double - clim_mean * 3 as "globalRadiation_AF", 30.0::double + clim_max / 50 as "maxTemperature_extreme_AF",
    -5.0::double + clim_mean / 20 as "minTemperature_extreme_AF", cast(null as double) as "unused_AF"
  from panel p join plan x on x."SimID" = p.entity join customer c on c.c_custkey = p.entity),
fieldy as (
  select *, "Harvest_Year_AF" - min("Harvest_Year_AF") over (partition by "SimID") + 1 as "Harvest_Year_Absolute" from field)"""

HEALTH = """health as (
  select entity, arg_max(tree_af, period) filter (where tree_af is not null) as final_stock,
    avg(case when coalesce(crop_af < 20, false) or coalesce(crop_ta < 20, false) then 1.0 else 0.0 end) as fail_rate
  from panel group by entity)"""

POPS = HEALTH + """,
pops as (
  select *, fail_rate > 0.25 as yield_failed,
    (case when fail_rate > 0.25 then 'yield_fail' else 'yield_ok' end) || ' × ' ||
    (case when final_stock < 300 then 'tree_failed' when final_stock < 700 then 'tree_stunted' else 'tree_ok' end) as population,
    (case when fail_rate > 0.25 then 'yield_fail' else 'yield_ok' end) || ' × ' ||
    (case when final_stock >= 700 then 'tree_ok' else 'tree_degraded' end) as population_binary
  from health)"""
