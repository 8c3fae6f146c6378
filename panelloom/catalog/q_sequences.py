"""Within-entity sequences, horizons, curves, reshapes, splits."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from panelloom.catalog.ctes import EVENTS, ORDERS, PLAN
from panelloom.catalog.q_aggregates import SIG, signatures
from panelloom.catalog.registry import query, sql
from panelloom.functions import arrays as A
from panelloom.functions.curves import yearly_curve
from panelloom.functions.nullsafe import percent_of
from panelloom.operators import encode as N
from panelloom.operators import horizon as H
from panelloom.operators import ranks as R
from panelloom.operators import reshape as V
from panelloom.operators import sequence as Q
from panelloom.operators import split as X
from panelloom.operators.prepare import static_first
from panelloom.session import materialize
from panelloom.sources import presets
from panelloom.sources.readers import read_table

EV, OR = presets.EVENTS, presets.ORDERS
HORIZONS = [5, 10, 20, 30]


@query("win_delta", sql([EVENTS], """select entity, period, tree_af - lag(tree_af) over w as af_delta, tree_tf - lag(tree_tf) over w as tf_delta
    from panel window w as (partition by entity order by period)""", "entity period", "af_delta tf_delta"))
def win_delta(spark, sf):
    return Q.deltas(presets.events_panel(spark, sf), EV, {"af_delta": "tree_af", "tf_delta": "tree_tf"}).select(
        "entity", "period", "af_delta", "tf_delta")


def _interp(c):
    return f"""case when avg(case when {c} is null then 1.0 else 0.0 end) over (partition by entity) > 0.6 then {c} else coalesce({c},
      {c}0 + ({c}1 - {c}0) * (pos - {c}p0) / nullif({c}p1 - {c}p0, 0), {c}0, {c}1) end as {c}"""


def _neighbours(c):
    return f"""last_value({c} ignore nulls) over b as {c}0, last_value(case when {c} is not null then pos end ignore nulls) over b as {c}p0,
      first_value({c} ignore nulls) over f as {c}1, first_value(case when {c} is not null then pos end ignore nulls) over f as {c}p1"""


@query("win_interpolate", sql([EVENTS], f"""select entity, period, {_interp('tree_af')}, {_interp('tree_tf')} from (
    select *, {_neighbours('tree_af')}, {_neighbours('tree_tf')} from (
      select *, row_number() over (partition by entity order by period) as pos from panel)
    window b as (partition by entity order by period rows between unbounded preceding and current row),
      f as (partition by entity order by period rows between current row and unbounded following))""",
    "entity period", "tree_af tree_tf"))
def win_interpolate(spark, sf):
    return Q.interpolate(presets.events_panel(spark, sf), EV, ["tree_af", "tree_tf"], 0.60).select(
        "entity", "period", "tree_af", "tree_tf")


@query("win_profile", sql([EVENTS], """select p.entity, p.period, least(greatest(tree_af / f, 0), 1) as profile from panel p join (
    select entity, arg_max(tree_af, period) filter (where tree_af is not null) as f from panel group by 1) z using (entity)
    where f > 0 and tree_af is not null""", "entity period", "profile"))
def win_profile(spark, sf):
    # SQL `least` skips NULL, so a missing stock is compared on rows that have one.
    return Q.profile(presets.events_panel(spark, sf), EV, "tree_af").where("tree_af is not null").select(
        "entity", "period", "profile")


@query("win_cumulative_ratio", sql([EVENTS], """select entity, period, case when sum(crop_ta) over w > 0 then
    sum(crop_af) over w / sum(crop_ta) over w end as cumulative_ratio from panel
    window w as (partition by entity order by period rows between unbounded preceding and current row)""",
    "entity period", "cumulative_ratio"))
def win_cumulative_ratio(spark, sf):
    return Q.cumulative_ratio(presets.events_panel(spark, sf), ["entity"], "period", "crop_af", "crop_ta").select(
        "entity", "period", "cumulative_ratio")


@query("win_rank_average", sql([], """select l_orderkey, l_linenumber, rank() over (order by l_quantity)
    + (count(*) over (partition by l_quantity) - 1) / 2.0 as rank from lineitem""", "l_orderkey l_linenumber", "rank"))
def win_rank_average(spark, sf):
    """Average-tie ranks of a whole table, without one global sort."""
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return R.rank_average(li, [], "l_quantity").select("l_orderkey", "l_linenumber", "rank")


@query("win_percentile_position", sql([], """select o_orderkey, round_even(100.0 * cume_dist() over (order by o_totalprice), 1) as position
    from orders""", "o_orderkey", "position"))
def win_percentile_position(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    steps = R.cumulate(o, [], "o_totalprice").select(
        "o_totalprice", percent_of(F.col("n_below") + F.col("n"), F.col("n_total")).alias("position"))
    return o.join(steps, "o_totalprice").select("o_orderkey", "position")


# --- winsorising -----------------------------------------------------------

COLS = ["qty", "revenue", "disc"]
WINS = "train as (select * from opanel where year <= 1999), b as (" + " union all ".join(
    f"select '{c}' as variable, quantile_cont({c}, 0.01) as lo, quantile_cont({c}, 0.99) as hi from train" for c in COLS) + ")"


@query("wins_fit", sql([ORDERS, WINS], "select * from b", "variable", "lo hi"))
def wins_fit(spark, sf):
    return Q.winsor_fit(presets.orders_panel(spark, sf).where("year <= 1999"), COLS)


def _clip(c):
    return f"least(greatest({c}, (select lo from b where variable = '{c}')), (select hi from b where variable = '{c}')) as {c}"


@query("wins_apply", sql([ORDERS, WINS], f"select entity, year, category, {', '.join(_clip(c) for c in COLS)} from opanel",
                         "entity year category", "qty revenue disc", 3), digits=3)
def wins_apply(spark, sf):
    p = materialize(presets.orders_panel(spark, sf))
    return Q.winsor_apply(p, Q.winsor_fit(p.where("year <= 1999"), COLS))


@query("wins_counts", sql([ORDERS, WINS], " union all ".join(
    f"select '{c}' as variable, count(*) filter (where {c} < lo or {c} > hi) as n_clipped from opanel, b where variable = '{c}'" for c in COLS),
    "variable n_clipped"))
def wins_counts(spark, sf):
    p = materialize(presets.orders_panel(spark, sf))
    return Q.winsor_counts(p, Q.winsor_fit(p.where("year <= 1999"), COLS))


# --- horizons --------------------------------------------------------------

HZ = "hz as (select p.*, h from panel p, (select unnest([5, 10, 20, 30]) as h) where period <= h)"


def features(spark, sf, **options):
    # The panel has one row per (user, day) and leaves its window partitioned by user.
    return H.horizon_features(presets.events_panel(spark, sf), EV, ["clim_n"], ["clim_mean", "clim_max"], [], ["tree_af"],
                              horizons=HORIZONS, **({"prepared": True} | options))


@query("agg_horizon_basic", sql([EVENTS, HZ], """select entity, h as horizon, sum(clim_n)::bigint as clim_n_cum, stddev_pop(clim_n) as clim_n_std,
    avg(clim_mean) as clim_mean_mean, stddev_pop(clim_mean) as clim_mean_std, avg(clim_max) as clim_max_mean,
    stddev_pop(clim_max) as clim_max_std from hz group by 1, 2""", "entity horizon clim_n_cum",
    "clim_n_std clim_mean_mean clim_mean_std clim_max_mean clim_max_std"))
def agg_horizon_basic(spark, sf):
    return features(spark, sf).select("entity", "horizon", "clim_n_cum", "clim_n_std", "clim_mean_mean", "clim_mean_std",
                                      "clim_max_mean", "clim_max_std")


@query("agg_horizon_quantile", sql([EVENTS, HZ], """select entity, h as horizon, case when h > 10 then quantile_cont(clim_mean, 0.1) end as clim_mean_p10,
    case when h > 10 then quantile_cont(clim_mean, 0.9) end as clim_mean_p90 from hz group by 1, 2""", "entity horizon",
    "clim_mean_p10 clim_mean_p90"))
def agg_horizon_quantile(spark, sf):
    return features(spark, sf).select("entity", "horizon", "clim_mean_p10", "clim_mean_p90")


LEGACY = """pos as (select period, row_number() over (order by period) - 1 as pos from (select distinct period from panel where clim_mean is not null)),
cnt as (select h, count(*) as n from pos, (select unnest([20, 30]) as h) where period <= h group by 1)"""


@query("agg_horizon_trend", sql([EVENTS, HZ, LEGACY], """select entity, h as horizon, case when h > 10 then slope end as slope, case when h > 10 then legacy end as legacy from (select hz.entity, hz.h, regr_slope(clim_mean, period::double) as slope,
    covar_pop(pos::double, clim_mean) / (any_value(n) * (any_value(n) * any_value(n) - 1) / 12.0) as legacy
    from hz left join pos using (period) left join cnt on cnt.h = hz.h group by 1, 2)""", "entity horizon", "slope legacy", 6), digits=6)
def agg_horizon_trend(spark, sf):
    """Least-squares slope and the slice-scaled variant side by side."""
    a = features(spark, sf).select("entity", "horizon", F.col("clim_mean_trend").alias("slope"))
    b = features(spark, sf, legacy_trend=True).select(
        "entity", "horizon", F.col("clim_mean_trend").alias("legacy"))
    return a.join(b, ["entity", "horizon"])


@query("agg_recent_mean", sql([EVENTS, HZ], """select entity, h as horizon, case when h > 10 then avg(case when period > h - 5 then clim_mean end) end
    as clim_mean_recent_mean from hz group by 1, 2""", "entity horizon", "clim_mean_recent_mean"))
def agg_recent_mean(spark, sf):
    return features(spark, sf).select("entity", "horizon", "clim_mean_recent_mean")


@query("hzn_dataset", sql([EVENTS, HZ], """select entity, h as horizon, arg_min(category, period) as category, sum(clim_n)::bigint as clim_n_cum,
    avg(clim_mean) as clim_mean_mean, stddev_pop(clim_max) as clim_max_std,
    case when h > 10 then quantile_cont(clim_max, 0.9) end as clim_max_p90,
    case when h > 10 then regr_slope(clim_n::double, period::double) end as clim_n_trend,
    max(case when period = h then tree_af end) as tree_af from hz group by 1, 2
    having max(case when period = h then tree_af end) is not null""", "entity horizon category clim_n_cum",
    "clim_mean_mean clim_max_std clim_max_p90 clim_n_trend tree_af"))
def hzn_dataset(spark, sf):
    out = H.horizon_dataset(presets.events_panel(spark, sf), EV, ["clim_n"], ["clim_mean", "clim_max"], ["category"], "tree_af",
                            horizons=HORIZONS)
    return out.select("entity", "horizon", "category", "clim_n_cum", "clim_mean_mean", "clim_max_std", "clim_max_p90",
                      "clim_n_trend", "tree_af")


# --- curves ----------------------------------------------------------------

KNOTS = """knots as (select entity, h as x, max(case when period <= h then tree_af end) as y from panel, (select unnest([5, 10, 20, 30]) as h)
  group by 1, 2)"""


def knots(spark, sf):
    """Stock reached by each horizon; early horizons are missing for some entities."""
    p = presets.events_panel(spark, sf)
    return p.withColumn("x", F.explode(F.lit(HORIZONS))).groupBy("entity", "x").agg(
        F.max(F.when(F.col("period") <= F.col("x"), F.col("tree_af"))).alias("y"))


def pchip_sql(source: str, keys: str, n_years: int, extrapolate: bool, hi: str | None, lone: str | None, tag: str = "") -> str:
    """Closed form over the knots of ``source(keys, x, y)``; a year joins its segment."""
    end = """case when sign({raw}) <> sign({d0}) then 0.0 when sign({d0}) <> sign({d1}) and abs({raw}) > 3 * abs({d0}) then 3 * {d0} else {raw} end"""
    head = "((2*hn + (xnn - xn)) * dn - hn * dnn) / (hn + (xnn - xn))"
    tail = "((2*hp + (xp - xpp)) * dp - hp * dpp) / (hp + (xp - xpp))"
    outside = "cubic" if extrapolate else "case when t < x1 or t > xl then 0.0 else cubic end"
    value = f"case when n = 0 then {lone or '0.0'} when n = 1 then {lone or 'y1'} else {outside} end"
    capped = f"least(greatest({value}, 0.0), {hi})" if hi else f"greatest({value}, 0.0)"
    text = f"""k0 as (select {keys}, x::double as x, y from {source} where y is not null),
k1 as (select *, row_number() over w as rn, count(*) over (partition by {keys}) as n, lag(x) over w as xp, lag(y) over w as yp,
    lead(x) over w as xn, lead(y) over w as yn, lag(x, 2) over w as xpp, lag(y, 2) over w as ypp, lead(x, 2) over w as xnn, lead(y, 2) over w as ynn
  from k0 window w as (partition by {keys} order by x)),
k2 as (select *, x - xp as hp, xn - x as hn, (y - yp) / (x - xp) as dp, (yn - y) / (xn - x) as dn, (ynn - yn) / (xnn - xn) as dnn,
    (yp - ypp) / (xp - xpp) as dpp from k1),
k3 as (select *, case when n < 2 then 0.0 when rn = 1 and n = 2 then dn when rn = n and n = 2 then dp
    when rn = 1 then {end.format(raw=head, d0='dn', d1='dnn')} when rn = n then {end.format(raw=tail, d0='dp', d1='dpp')}
    when dp * dn <= 0 then 0.0 else ((2*hn + hp) + (hn + 2*hp)) / ((2*hn + hp) / dp + (hn + 2*hp) / dn) end as m from k2),
seg as (select *, lead(m) over (partition by {keys} order by x) as mn from k3),
spine as (select {keys}, t, min(s.n) as n, min(s.x1) as x1, min(s.xl) as xl, min(s.y1) as y1 from (select distinct {keys} from {source}) a
  left join (select {keys}, max(n) as n, min(x) as x1, max(x) as xl, arg_min(y, x) as y1 from k3 group by {keys}) s using ({keys}),
  (select unnest(range(1, {n_years + 1})) as t) group by {keys}, t),
pick as (select p.{keys}, p.t, coalesce(p.n, 0) as n, x1, xl, y1, s.x, s.y, s.m, s.xn, s.yn, s.mn, (p.t - s.x) / s.hn as u, s.hn from spine p
  left join seg s on s.{keys} = p.{keys} and s.xn is not null
    and (p.t >= s.x or s.rn = 1) and (p.t < s.xn or s.rn = s.n - 1)),
curve as (select {keys}, t as year, {capped} as value from (select *, (1 + 2*u) * (1-u) * (1-u) * y + u * (1-u) * (1-u) * hn * m
    + u*u * (3 - 2*u) * yn + u*u * (u - 1) * hn * mn as cubic from pick))"""
    for cte in ("k0", "k1", "k2", "k3", "seg", "spine", "pick", "curve"):
        text = re.sub(rf"\b{cte}\b", f"{cte}{tag}", text)
    return text


@query("pchip_curve", sql([EVENTS, KNOTS, pchip_sql("knots", "entity", 40, False, None, None)], "select * from curve", "entity year", "value"))
def pchip_curve(spark, sf):
    return yearly_curve(knots(spark, sf), ["entity"], "x", "y", 40)


@query("win_pchip", sql([EVENTS, KNOTS, pchip_sql("knots", "entity", 30, False, None, None)], "select * from curve", "entity year", "value"))
def win_pchip(spark, sf):
    return yearly_curve(knots(spark, sf), ["entity"], "x", "y", 30)


PROFILE_KNOTS = "pk as (select entity, x, y / nullif(max(y) over (partition by entity), 0) as y from knots)"


@query("pchip_profile", sql([EVENTS, KNOTS, PROFILE_KNOTS, pchip_sql("pk", "entity", 40, True, "1.0", "1.0")],
                            "select * from curve", "entity year", "value"))
def pchip_profile(spark, sf):
    """Extended beyond the knots, in [0, 1]; fewer than two knots give 1."""
    k = knots(spark, sf)
    top = k.groupBy("entity").agg(F.max("y").alias("top"))
    k = k.join(top, "entity").withColumn("y", F.when(F.col("top") != 0, F.try_divide("y", "top")))
    return yearly_curve(k, ["entity"], "x", "y", 40, extrapolate=True, hi=1.0, lone_value=1.0)


@query("inf_zero_fill", sql([EVENTS, KNOTS, pchip_sql("knots", "entity", 40, False, None, None)],
                            "select entity, count(*) as years, count(*) filter (where value = 0 and year < 5) as zero_before from curve group by 1",
                            "entity years zero_before"))
def inf_zero_fill(spark, sf):
    curve = yearly_curve(knots(spark, sf), ["entity"], "x", "y", 40)
    return curve.groupBy("entity").agg(
        F.count("*").alias("years"), F.count_if((F.col("value") == 0) & (F.col("year") < 5)).alias("zero_before"))


# --- reshape ---------------------------------------------------------------

@query("rsh_pivot_period", sql([EVENTS], "select entity, " + ", ".join(
    f"max(case when period = {p} then clim_mean end) as p{p}" for p in range(1, 31)) + " from panel group by 1", "entity",
    " ".join(f"p{p}" for p in range(1, 31))))
def rsh_pivot_period(spark, sf):
    return V.period_pivot(presets.events_panel(spark, sf), EV, "clim_mean", list(range(1, 31)))


@query("rsh_pivot_index", sql([], "select l_returnflag as feature, " + ", ".join(
    f"avg(case when l_linestatus = '{s}' then l_tax end) as \"{s}\"" for s in "FO") + " from lineitem group by 1", "feature", "F O"))
def rsh_pivot_index(spark, sf):
    li = read_table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("feature"), "l_linestatus", "l_tax")
    return V.index_pivot(li, "feature", "l_linestatus", "l_tax", ["F", "O"])


@query("rsh_format_output", sql([EVENTS], """select entity, i as year, target, value from (
    select entity, i, unnest(['crop', 'tree']) as target, unnest([crop[i], tree[i]]) as value from (
      select entity, list(coalesce(crop_af, 0.0) order by period) as crop, list(coalesce(tree_af, 0.0) order by period) as tree from panel group by 1),
      (select unnest(range(1, 31)) as i) where i <= len(crop))""", "entity year target", "value"))
def rsh_format_output(spark, sf):
    """Trajectory arrays to tidy rows."""
    pairs = F.array_sort(F.collect_list(F.struct(
        "period", F.coalesce("crop_af", F.lit(0.0)).alias("crop"), F.coalesce("tree_af", F.lit(0.0)).alias("tree"))))
    arrays = presets.events_panel(spark, sf).groupBy("entity").agg(pairs.alias("z")).select(
        "entity", F.col("z.crop").alias("crop"), F.col("z.tree").alias("tree"))
    return V.trajectories_to_long(arrays, ["entity"], ["crop", "tree"]).withColumn("year", F.col("year").cast("bigint"))


ATTR = """attr as (select entity, period, unnest(['clim_max', 'category']) as feature, unnest([clim_max - 50, clim_n - 2.0::double]) as shap_value,
  unnest([clim_max, try_cast(category as double)]) as feature_value from panel)"""


def attribution(spark, sf):
    p = presets.events_panel(spark, sf).select(
        "entity", "period", "clim_max", "category", (F.col("clim_max") - 50).alias("attr_clim_max"),
        (F.col("clim_n") - 2.0).alias("attr_category"))
    return V.attribution_long(p, ["entity", "period"], ["clim_max", "category"])


@query("rsh_attr_long", sql([EVENTS, ATTR], "select * from attr", "entity period feature", "shap_value feature_value"))
def rsh_attr_long(spark, sf):
    return attribution(spark, sf)


@query("attr_summary", sql([EVENTS, ATTR], "select 'tree' as target, feature, avg(abs(shap_value)) as mean_abs, count(*) as n from attr group by 2",
                           "target feature n", "mean_abs"))
def attr_summary(spark, sf):
    return V.attribution_summary(attribution(spark, sf).withColumn("target", F.lit("tree")))


# --- functions -------------------------------------------------------------

# Training rows are a quarter by hash; segments within nations are so many that some are seen later only.
ENC = """cs as (select c_custkey, c_mktsegment || '-' || c_nationkey as segment from customer),
tr as (select distinct segment as class from cs where md5(c_custkey::varchar) < '4'),
enc as (select class, row_number() over (order by class) - 1 as code from tr)"""


def train_rows(spark, sf):
    return segments(spark, sf).where("md5(cast(c_custkey as string)) < '4'")


def segments(spark, sf):
    return read_table(spark, sf, "customer").selectExpr("c_custkey", "concat(c_mktsegment, '-', c_nationkey) as segment")


@query("fn_encode_fit", sql([ENC], """select 'segment' as variable, segment as class, cast(row_number() over (order by segment) - 1 as int) as code
    from (select distinct segment from cs) union all select 'c_name', c_name, cast(row_number() over (order by c_name) - 1 as int)
    from (select distinct c_name from customer)""", "variable class code"))
def fn_encode_fit(spark, sf):
    """All customers: a column of few classes and one with a class per row."""
    return N.fit_encoding(read_table(spark, sf, "customer").selectExpr("concat(c_mktsegment, '-', c_nationkey) as segment", "c_name"), ["segment", "c_name"])


@query("fn_encode_unseen", sql([ENC], """select c_custkey, cast(coalesce(code, 0) as int) as segment from cs
    left join enc on class = segment""", "c_custkey segment"))
def fn_encode_unseen(spark, sf):
    enc = N.fit_encoding(train_rows(spark, sf), ["segment"])
    c = segments(spark, sf)
    return N.apply_encoding(c, enc, ["segment"])


@query("fn_bucket", sql([], """select l_orderkey, l_linenumber, case when l_quantity < 1 then 0 when l_quantity < 25 then 1 else 2 end as bin
    from lineitem""", "l_orderkey l_linenumber bin"))
def fn_bucket(spark, sf):
    from panelloom.functions.labels import bin_index

    return read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", bin_index("l_quantity", [1, 25]).alias("bin"))


@query("fn_log1p_roundtrip", sql([], """select o_orderkey, ln(1 + o_totalprice) as logged, o_totalprice as back from orders""",
                                 "o_orderkey", "logged back"))
def fn_log1p_roundtrip(spark, sf):
    logged = F.log1p("o_totalprice")
    return read_table(spark, sf, "orders").select("o_orderkey", logged.alias("logged"), F.expm1(logged).alias("back"))


@query("fn_array_broadcast", sql([PLAN], """select "SimID", t as year, sand from plan, (select unnest(range(1, 41)) as t)""", "SimID year", "sand"))
def fn_array_broadcast(spark, sf):
    p = presets.scored_plan(spark, sf).select("SimID", A.checked(A.spread("sand", 40), 40).alias("a"))
    return p.select("SimID", F.posexplode("a").alias("i", "sand")).select(
        "SimID", (F.col("i") + 1).cast("bigint").alias("year"), "sand")


@query("fn_label_concat", sql([PLAN], """select "SimID", main_crop || ' × ' || w_type as label from plan""", "SimID label"))
def fn_label_concat(spark, sf):
    from panelloom.functions.labels import pair_label

    return presets.scored_plan(spark, sf).select("SimID", pair_label(F.col("main_crop"), F.col("w_type")).alias("label"))


# --- splits ----------------------------------------------------------------

SPLIT = """ids as (select "SimID", row_number() over (order by md5('42:' || "SimID"), "SimID") as rn, count(*) over () as n from plan),
sp as (select "SimID", case when rn <= floor(n * 0.2) then 'test' else 'train' end as split from ids)"""


def entities(spark, sf):
    return presets.scored_plan(spark, sf).select("SimID")


@query("spl_entity", sql([PLAN, SPLIT], "select * from sp", "SimID split"))
def spl_entity(spark, sf):
    return X.entity_split(entities(spark, sf), "SimID")


STRAT = SIG + """,
ss as (select entity, signature, case when row_number() over (partition by signature order by md5('42:' || entity), entity)
  <= greatest(1, floor(count(*) over (partition by signature) * 0.2)) then 'test' else 'train' end as split from sigs)"""


@query("spl_stratified", sql([ORDERS, STRAT], "select * from ss", "entity signature split"))
def spl_stratified(spark, sf):
    return X.stratified_split(signatures(spark, sf), "entity", "signature")


FOLDS = """sizes as (select entity, count(*) as n_rows from opanel group by 1),
rk as (select *, row_number() over (order by n_rows desc, md5('42:' || entity), entity) as r from sizes),
lists as (select list(n_rows order by r) as ns from rk),
greedy as (select 0 as r, cast(null as bigint) as fold, [0, 0, 0, 0, 0]::bigint[] as held from lists
  union all select g.r + 1, list_position(held, list_min(held)) - 1,
    list_transform(held, lambda w, i: w + case when i = list_position(held, list_min(held)) then ns[g.r + 1] else 0 end) from greedy g, lists where g.r < len(ns)),
folds as (select entity, n_rows, cast(fold as bigint) as fold from rk join greedy using (r))"""


@query("spl_group_kfold", sql(["recursive " + ORDERS, FOLDS], "select * from folds", "entity n_rows fold"))
def spl_group_kfold(spark, sf):
    return X.group_folds(presets.orders_panel(spark, sf), "entity", 5)


@query("spl_balance_check", sql([ORDERS, STRAT], """select *, abs(pct_test - pct_train) as delta_pp, abs(pct_test - pct_train) > 10 as warn from (
    select signature, count(*) filter (where split = 'train') as n_train, count(*) filter (where split = 'test') as n_test,
      100.0 * count(*) filter (where split = 'train') / (select count(*) from ss where split = 'train') as pct_train,
      100.0 * count(*) filter (where split = 'test') / (select count(*) from ss where split = 'test') as pct_test
    from ss group by 1)""", "signature n_train n_test warn", "pct_train pct_test delta_pp"))
def spl_balance_check(spark, sf):
    return X.balance_check(X.stratified_split(signatures(spark, sf), "entity", "signature"), "signature")


@query("spl_ratio_check", sql([PLAN, SPLIT], """select avg(case when split = 'test' then 1.0 else 0.0 end) as test_share,
    abs(avg(case when split = 'test' then 1.0 else 0.0 end) - 0.2) <= 0.05 as within from sp""", "within", "test_share"))
def spl_ratio_check(spark, sf):
    return X.ratio_check(X.entity_split(entities(spark, sf), "SimID"))


LEAK = """parts as (select p.entity, case when coalesce(p.period % 7 = 0 and p.entity % 3 = 0, false) then 'test' else 'train' end as part from panel p)"""


@query("spl_leak_check", sql([EVENTS, LEAK], "select entity from parts group by 1 having count(distinct part) > 1", "entity"))
def spl_leak_check(spark, sf):
    """A deliberately leaking row split: the entities it finds are the leaks."""
    p = presets.events_panel(spark, sf)
    leaky = (F.col("period") % 7 == 0) & (F.col("entity") % 3 == 0)
    return X.leaking_entities(p.withColumn("part", F.when(leaky, "test").otherwise("train")), "entity", "part")


@query("set_overlap_check", sql([PLAN, SPLIT], """select count(*) as n_shared from (select "SimID" from sp where split = 'train'
    intersect select "SimID" from sp where split = 'test')""", "n_shared"))
def set_overlap_check(spark, sf):
    s = X.entity_split(entities(spark, sf), "SimID")
    shared = s.where("split = 'train'").select("SimID").intersect(s.where("split = 'test'").select("SimID"))
    return shared.agg(F.count("*").alias("n_shared"))


@query("smp_cap", sql([], """select l_rowid from (select l_orderkey * 10 + l_linenumber as l_rowid from lineitem)
    order by md5('42:' || l_rowid), l_rowid limit 2000""", "l_rowid"))
def smp_cap(spark, sf):
    """The sampling operator: at most 2000 rows, uniform."""
    li = read_table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("l_rowid"))
    return X.sample_rows(li, "l_rowid", 2000)


@query("smp_boot", sql([EVENTS], """select period, entity, boot from (select period, entity, boot,
    row_number() over (partition by period, boot order by md5('42:' || boot || ':' || entity), entity) as rn
    from panel, (select unnest(range(0, 20)) as boot)) where rn <= 40""", "period entity boot"))
def smp_boot(spark, sf):
    p = materialize(presets.events_panel(spark, sf).select("period", "entity"))
    return X.bootstrap_samples(p, ["period"], "entity", 20, 40).select(
        "period", "entity", F.col("boot").cast("bigint").alias("boot"))


@query("ml_features", sql([EVENTS, PLAN], """select p."SimID", latitude, sand, clay, arg_min(clim_mean, period) as clim_mean,
    arg_min(clim_max, period) as clim_max from plan p join panel on entity = "SimID" group by 1, 2, 3, 4""",
    "SimID", "latitude sand clay clim_mean clim_max"))
def ml_features(spark, sf):
    """Entity features of the classifiers: plan statics and first climate values."""
    first = static_first(presets.events_panel(spark, sf), EV, ["clim_mean", "clim_max"])
    plan = presets.scored_plan(spark, sf).select("SimID", "latitude", "sand", "clay")
    return plan.join(first, plan.SimID == first.entity).drop("entity")
