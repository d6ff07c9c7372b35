"""One query for each operator over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import fixtures as fx
from .cube import VALUE, Cube
from .functions import labels
from .operators import align, chunking, interp, reduce, regrid, window
from .operators.apply import apply, apply_vectorised, cogroup_apply
from .plans import catalog
from .sources import cube_store, csv_series, packing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EV = "ev as (select event_type, cast(ts as date) as day, sum(cast(value as decimal(18,2)))::double / count(*) as value from events group by 1, 2)"
EMB = "emb as (select vec_id, (i - 1)::int as k, embedding[i]::double as value from embeddings, unnest(range(1, len(embedding) + 1)) as u(i))"
LI = "li as (select l_returnflag, l_linestatus, date_trunc('month', l_shipdate)::date as month, sum(cast(l_quantity as decimal(18,2)))::double / count(*) as value from lineitem group by 1, 2, 3)"
GRID = "grid as (select -90.0::double + 5 * i as latitude, 5.0::double * j as longitude, 2 * (-90.0::double + 5 * i) + 5.0::double * j as value from range(37) a(i), range(72) b(j))"
KNOTS = "knots(idx, x, y) as (values (0, 0.0::double, 0.0::double), (1, 10.0, 5.0), (2, 20.0, 25.0), (3, 40.0, 30.0))"
CAT = "cat as (select distinct o_orderpriority as variable, o_orderstatus as source, 'monthly_' || strftime(o_orderdate, '%Y-%m') as time, c_nationkey::varchar as space from orders join customer on o_custkey = c_custkey)"


def query(sql: str | None = None, *with_: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = ("with " + ", ".join(with_) + " " if with_ else "") + sql
        return fn

    return add


def rounded(cube: Cube, *cols: str, digits: int = 6) -> DataFrame:
    return cube.df.select(*(cols or cube.dims), F.round(VALUE, digits).alias(VALUE))


# --- selection ----------------------------------------------------------------------------------------------


@query("select vec_id, k, value from emb where k between 20 and 29 and vec_id between 30 and 99", EMB)
def index_box(spark, sf_dir):
    return fx.vectors(spark, sf_dir).between(k=(20, 29), vec_id=(30, 99)).df


@query("select vec_id, k, value from emb where k in (1, 3, 5)", EMB)
def index_list(spark, sf_dir):
    return fx.vectors(spark, sf_dir).isin(k=[1, 3, 5]).df


@query("select event_type, day, value from (select *, dense_rank() over (order by day) - 1 as i from ev) where i >= 3 and i < 10", EV)
def positional_slice(spark, sf_dir):
    return fx.daily(spark, sf_dir).isel(day=slice(3, 10)).df


@query("select event_type as kind, day as time, value from ev", EV)
def rename_dims(spark, sf_dir):
    return fx.daily(spark, sf_dir).rename(event_type="kind").rename_first({"time": ["date", "day"]}).df


@query("select day, event_type, value from ev", EV)
def transpose_dims(spark, sf_dir):
    return fx.daily(spark, sf_dir).transpose("day", "event_type").df


@query("select l_orderkey, l_linenumber, (l_quantity in (1, 2, 3))::int as value from lineitem")
def reclass(spark, sf_dir):
    return Cube.of(fx.table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"), "l_quantity").reclass([1, 2, 3]).df


@query("select event_type, day, 0.0::double as value from ev", EV)
def zero_like(spark, sf_dir):
    return fx.daily(spark, sf_dir).like(0.0).df


@query("select day, value from ev where event_type = 'click'", EV)
def squeeze_dim(spark, sf_dir):
    return fx.daily(spark, sf_dir).isin(event_type=["click"]).squeeze("event_type").df


@query("select l_orderkey, l_linenumber, v.variable, v.value from lineitem, lateral (values ('l_quantity', l_quantity), ('l_tax', l_tax)) v(variable, value)")
def split_variables(spark, sf_dir):
    """A table of several variables as one long table of cubes."""
    return fx.table(spark, sf_dir, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"], "variable", "value")


# --- alignment ----------------------------------------------------------------------------------------------


@query("select event_type, day, value as v0, off as v1 from ev join (select event_type, min(value) as off from ev group by 1) using (event_type)", EV)
def align_inner(spark, sf_dir):
    ev = fx.daily(spark, sf_dir)
    return align.align(ev, reduce.reduce(ev, "day", "min"))


@query("select l_returnflag, l_linestatus, month, event_type, li.value as v0, top as v1 from li, (select event_type, max(value) as top from ev group by 1)", LI, EV)
def broadcast_missing_dim(spark, sf_dir):
    return align.align(fx.monthly(spark, sf_dir), reduce.reduce(fx.daily(spark, sf_dir), "day", "max"))


@query("select vec_id, u.k, u.value as v0, v.value as v1 from emb u join emb v using (vec_id) where v.k = 0", EMB)
def broadcast_singleton(spark, sf_dir):
    e = fx.vectors(spark, sf_dir)
    return align.align(e, e.isin(k=[0]), singletons=("k",))


@query("select a.vec_id, a.k, a.value as v0, b.value as v1 from emb a join emb b on a.vec_id = b.vec_id and b.k = a.k + 32 where a.k < 32", EMB)
def align_staggered(spark, sf_dir):
    """Axes 0..31 and 32..63 meet by position."""
    e = fx.vectors(spark, sf_dir)
    return align.align_positions(e.between(k=(0, 31)), e.between(k=(32, 63)), ("k",))


@query("select vec_id, round(avg(sqrt(u.value * u.value + v.value * v.value)), 6) as value from emb u join (select vec_id, k - 1 as k, value from emb) v using (vec_id, k) group by 1", EMB)
def wind_speed_mean(spark, sf_dir):
    u = fx.vectors(spark, sf_dir)
    v = u.transform(lambda d: d.withColumn("k", F.col("k") - 1))
    return rounded(apply([u, v], "avg(sqrt(v0 * v0 + v1 * v1))", ["k"], aggregate=True))


@query("select a.vec_id, a.k, a.value as base, b.value - a.value as first, c.value - a.value as second, d.value - b.value - c.value + a.value as joint from emb a join (select vec_id, k - 16 as k, value from emb) b using (vec_id, k) join (select vec_id, k - 32 as k, value from emb) c using (vec_id, k) join (select vec_id, k - 48 as k, value from emb) d using (vec_id, k) where a.k < 16", EMB)
def factor_separation(spark, sf_dir):
    e = fx.vectors(spark, sf_dir)
    run = lambda i: e.between(k=(16 * i, 16 * i + 15)).transform(lambda d: d.withColumn("k", F.col("k") - 16 * i))
    return align.factor_separation(run(0), run(1), run(2), run(3))


@query("select 'low' as run, vec_id, k, value from emb where k < 4 union all select 'high', vec_id, k, value from emb where k >= 60", EMB)
def merge_new_dim(spark, sf_dir):
    e = fx.vectors(spark, sf_dir)
    return align.concat({"low": e.between(k=(0, 3)), "high": e.between(k=(60, 63))}, "run").df


# --- reductions ---------------------------------------------------------------------------------------------


@query("select event_type, sum(cast(value as decimal(18,2)))::double / count(*) as value from events group by 1")
def reduce_mean_dim(spark, sf_dir):
    return reduce.reduce(fx.readings(spark, sf_dir), "event_id", fx.exact_mean()).df


@query("select vec_id, max(value) as top, min(value) as low from emb where k between 0 and 9 group by 1", EMB)
def reduce_subset_levels(spark, sf_dir):
    out = reduce.multi(fx.vectors(spark, sf_dir).between(k=(0, 9)), ["k"], top="max", low="min")
    return align.align(out["top"], out["low"]).withColumnsRenamed({"v0": "top", "v1": "low"})


@query("select (select max(x) from (select day as x, row_number() over (order by day) - 1 as i, count(*) over () as n from (select distinct day from ev)) where i = n // 2) as day, event_type, max(value) as value from ev group by 2", EV)
def reduce_keepdim(spark, sf_dir):
    return reduce.reduce(fx.daily(spark, sf_dir), "day", "max", keepdim=True).df


@query("select event_type, case when count(*) = count(v) then max(v) end as value from (select event_type, case when day <> date '2024-01-05' or event_type <> 'click' then value end as v from ev) group by 1", EV)
def reduce_propagating(spark, sf_dir):
    holed = fx.daily(spark, sf_dir).with_value(F.when((F.col("day") != F.lit("2024-01-05").cast("date")) | (F.col("event_type") != "click"), F.col(VALUE)))
    return reduce.reduce(holed, "day", "max", skipna=False).df


@query("select event_type, slot::int as slot, value from (select event_type, hour(ts) as slot, sum(cast(value as decimal(18,2)))::double / count(*) as value from events group by 1, 2) union all select event_type, 24, sum(cast(value as decimal(18,2)))::double / count(*) from events where hour(ts) = 0 group by 1")
def diurnal_cycle(spark, sf_dir):
    return reduce.cycle(fx.readings(spark, sf_dir), "event_id", 24, F.hour("ts"), fx.exact_mean()).df


@query("select event_type, (dayofweek(ts) + 1)::int as weekday, sum(cast(value as decimal(18,2)))::double / count(*) as value from events group by 1, 2")
def group_by_dim(spark, sf_dir):
    return reduce.group_reduce(fx.readings(spark, sf_dir), "event_id", F.dayofweek("ts"), "weekday", fx.exact_mean()).df


def _quantile_sql(points: str, first: str = "p") -> str:
    return f"with s as (select event_type, list_sort(list(value + 0.0)) as s from events group by 1), p as (select (i - 1)::int as quantile, ({points})[i]::double as cdf, ({first if first != 'p' else points})[i]::double as pos from range(1, len({points}) + 1) r(i)) select event_type, quantile, s[cast(floor((len(s) - 1) * pos) as int) + 1] as value, cdf from s, p"


def _list(points: list[float]) -> str:
    return "[" + ", ".join(f"{p!r}::double" for p in points) + "]"


_UNIFORM, _EXPONENTIAL = labels.cdf_points(10), labels.cdf_points(20, "exponential")


@query(_quantile_sql(_list(_UNIFORM)))
def quantiles_uniform(spark, sf_dir):
    return reduce.quantiles(fx.readings(spark, sf_dir), "event_id", _UNIFORM).df


@query(_quantile_sql(_list(_EXPONENTIAL), _list([_EXPONENTIAL[1], *_EXPONENTIAL[1:-1], _EXPONENTIAL[-2]])))
def quantiles_exponential(spark, sf_dir):
    return reduce.quantiles(fx.readings(spark, sf_dir), "event_id", _EXPONENTIAL, stable_start=True, stable_end=True).df


@query(_quantile_sql(_list(_UNIFORM)))
def quantiles_ranked(spark, sf_dir):
    return reduce.ranked_quantiles(fx.readings(spark, sf_dir), "event_id", _UNIFORM).df


@query("select 'low' as output, event_type, min(value) as value from ev group by 2 union all select 'top', event_type, max(value) from ev group by 2", EV)
def multi_output_apply(spark, sf_dir):
    return reduce.long_outputs(reduce.multi(fx.daily(spark, sf_dir), ["day"], low="min", top="max"))


# --- windows ------------------------------------------------------------------------------------------------


@query("select event_type, day, round(avg(value) over (partition by event_type order by day rows between 3 preceding and 3 following), 6) as value from ev", EV)
def moving_average_odd(spark, sf_dir):
    return rounded(window.moving_average(fx.daily(spark, sf_dir), "day", 7))


@query("select event_type, day, round(case when i > n - 2 then t else b end, 6) as value from (select event_type, day, row_number() over w as i, count(*) over (partition by event_type) as n, avg(value) over (w rows between 1 preceding and 2 following) as b, avg(value) over (w rows between 2 preceding and unbounded following) as t from ev window w as (partition by event_type order by day))", EV)
def moving_average_even(spark, sf_dir):
    return rounded(window.moving_average(fx.daily(spark, sf_dir), "day", 4))


@query("select event_type, day, round(case when count(*) over w = 5 then avg(value) over w end, 6) as value from ev window w as (partition by event_type order by day rows between 2 preceding and 2 following)", EV)
def glide_average(spark, sf_dir):
    return rounded(window.glide(fx.daily(spark, sf_dir), "day", 5))


@query("select event_type, day, round(case when count(*) over w = 5 then (sum(value) over w - (lag(value, 2) over o + lead(value, 2) over o) / 2) / 4 end, 6) as value from ev window o as (partition by event_type order by day), w as (partition by event_type order by day rows between 2 preceding and 2 following)", EV)
def glide_average_even(spark, sf_dir):
    return rounded(window.glide(fx.daily(spark, sf_dir), "day", 4))


@query("select event_type, day, round(value - avg(value) over (partition by day), 6) as value from ev", EV)
def anomaly(spark, sf_dir):
    return rounded(window.anomaly(fx.daily(spark, sf_dir), "event_type"))


@query("select event_type, day, round(value - lag(value) over (partition by event_type order by day), 6) as value from ev", EV)
def first_difference(spark, sf_dir):
    return rounded(window.difference(fx.daily(spark, sf_dir), "day"))


@query("select l_orderkey, l_linenumber, l_quantity as value, min(l_linenumber) over (partition by l_orderkey, l_quantity) as start from lineitem")
def plateau_start(spark, sf_dir):
    return window.plateau_start(Cube.of(fx.table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"), "l_quantity"), "l_linenumber").df


@query("select event_type, day, value from ev", EV)
def overlap_blend_square(spark, sf_dir):
    """The identity in overlapping chunks gives the input again."""
    return chunking.overlap_apply(fx.daily(spark, sf_dir), "day", None, 8, 3, "square").df


@query("select event_type, day, round(value, 6) as value from ev", EV)
def overlap_blend_triangle(spark, sf_dir):
    return rounded(chunking.overlap_apply(fx.daily(spark, sf_dir), "day", None, 8, 3, "triangle"))


@query("select event_type, day, round(value * 2, 6) as value from ev", EV)
def overlap_apply_pandas(spark, sf_dir):
    return rounded(chunking.overlap_apply(fx.daily(spark, sf_dir), "day", lambda f: f.assign(value=f.value * 2), 10, 4, "triangle"))


# --- lookups ------------------------------------------------------------------------------------------------


@query("select event_id, arg_min(y, struct_pack(d := abs(x - v), i := idx)) as value from (select event_id, value + 0.0 as v from events), knots group by 1", KNOTS)
def lookup_nearest(spark, sf_dir):
    e = interp.with_knots(fx.readings(spark, sf_dir).df, fx.knots(spark))
    return e.select("event_id", interp.nearest(F.col(VALUE)).alias(VALUE))


_SEG = "seg as (select x as xl, y as yl, lead(x) over (order by idx) as xr, lead(y) over (order by idx) as yr, case when idx = 0 then '-infinity'::double else x end as low, case when idx = 2 then 'infinity'::double else lead(x) over (order by idx) end as high from knots)"
_INTERP = "select event_id, round(yl * (xr - v) / (xr - xl) + yr * (1 - (xr - v) / (xr - xl)), 6) as value from (select event_id, value + 0.0 as v from events) join seg on v >= low and v < high where xr is not null"


@query(_INTERP, KNOTS, _SEG)
def interp_linear(spark, sf_dir):
    e = interp.with_knots(fx.readings(spark, sf_dir).df, fx.knots(spark))
    return e.select("event_id", F.round(interp.linear(F.col(VALUE)), 6).alias(VALUE))


@query(_INTERP, KNOTS, _SEG)
def interp_segments(spark, sf_dir):
    """The same as a range join with open-ended segments."""
    e, s = fx.readings(spark, sf_dir).df, interp.segments(fx.knots(spark))
    part = (F.col("xr") - F.col(VALUE)) / (F.col("xr") - F.col("xl"))
    return e.join(F.broadcast(s), (F.col(VALUE) >= F.col("low")) & (F.col(VALUE) < F.col("high"))).select("event_id", F.round(F.col("yl") * part + F.col("yr") * (1 - part), 6).alias(VALUE))


_CDFS = [0.0, 0.2, 0.4, 0.6, 0.8, 0.999]


@query(
    f"""with s as (select event_type, list_sort(list(value + 0.0)) as s from events where event_type in ('click', 'view') group by 1),
p as (select i - 1 as idx, ({_list(_CDFS)})[i] as cdf from range(1, 7) t(i)),
k as (select event_type, idx, cdf, s[cast(floor((len(s) - 1) * cdf) as int) + 1] as q from s, p),
b as (select idx, cdf as pl, q as ql, lead(cdf) over (order by idx) as pr, lead(q) over (order by idx) as qr, idx = 0 as f, idx = 4 as l from k where event_type = 'click'),
r as (select idx, cdf as pl, q as ql, lead(cdf) over (order by idx) as pr, lead(q) over (order by idx) as qr, idx = 0 as f, idx = 4 as l from k where event_type = 'view'),
e as (select event_id, value + 0.0 as v from events where event_type = 'click'),
x as (select event_id, v, pl + (pr - pl) * ((v - ql) / (qr - ql)) as u from e join b on idx < 5 and (f or v >= ql) and (l or v < qr))
select event_id, round(v + (r.ql + (r.qr - r.ql) * ((u - r.pl) / (r.pr - r.pl))) - (b.ql + (b.qr - b.ql) * ((u - b.pl) / (b.pr - b.pl))), 4) as value
from x join r on r.idx < 5 and (r.f or u >= r.pl) and (r.l or u < r.pr) join b on b.idx = r.idx"""
)
def bias_correct(spark, sf_dir):
    e = fx.readings(spark, sf_dir)
    q = reduce.quantiles(e.isin(event_type=["click", "view"]), "event_id", _CDFS).df.select("event_type", F.col("quantile").alias("idx"), F.col("cdf").alias("x"), F.col(VALUE).alias("y"))
    kinds = interp.knot_arrays(q, ["event_type"])
    pair = kinds.agg(F.max(F.when(F.col("event_type") == "click", F.col("knots"))).alias("biased"), F.max(F.when(F.col("event_type") == "view", F.col("knots"))).alias("reference"))
    x = e.isin(event_type=["click"]).df.crossJoin(F.broadcast(pair))  # one row
    return x.select("event_id", F.round(interp.bias_correct(F.col(VALUE), "biased", "reference"), 4).alias(VALUE))


# --- grids --------------------------------------------------------------------------------------------------


@query("select latitude, longitude, value, longitude as source from grid union all select latitude, longitude - 360, value, longitude from grid where longitude >= 170 union all select latitude, longitude + 360, value, longitude from grid where longitude < 10", GRID)
def extend_longitude(spark, sf_dir):
    return regrid.extend_longitude(fx.grid(spark)).df


@query("select * from grid where latitude between 40 - 10 - 1e-9 and 60 + 10 + 1e-9 and longitude between 0 - 10 - 1e-9 and 30 + 10 + 1e-9", GRID)
def crop_border(spark, sf_dir):
    return regrid.crop_border(fx.grid(spark), {"latitude": (40, 60), "longitude": (0, 30)}, border=2).df


def _target(spark):
    n = spark.range(51 * 49)
    return n.select((F.floor(F.col("id") / 49) * 0.7 + 20.0).alias("latitude"), ((F.col("id") % 49) * 1.3 + 100.0).alias("longitude"))


_TARGET = "select i * 0.7::double + 20.0 as latitude, j * 1.3::double + 100.0 as longitude, round(2 * (i * 0.7::double + 20.0) + j * 1.3::double + 100.0, 6) as value from range(51) a(i), range(49) b(j)"


@query(_TARGET)
def regrid_affine(spark, sf_dir):
    return rounded(regrid.interpolate(fx.grid(spark), _target(spark), grid=(-90.0, 5.0, 0.0, 5.0)))


@query(_TARGET)
def regrid_bilinear(spark, sf_dir):
    return rounded(regrid.regrid(fx.grid(spark), _target(spark), method="bilinear"))


# --- labels and scalars -------------------------------------------------------------------------------------


@query("select event_type, case when bool_and(coalesce(m = 1, true)) then 'monthly_' || strftime(min(day), '%Y-%m') || '_' || strftime(max(day), '%Y-%m') when coalesce(bool_and(d = 1) filter (i > 2 and i < n), true) then 'daily_' || strftime(min(day), '%Y-%m-%d') || '_' || strftime(max(day), '%Y-%m-%d') else 'irregular' end as label from (select event_type, day, (year(day) * 12 + month(day)) - lag(year(day) * 12 + month(day)) over w as m, date_diff('day', lag(day) over w, day) as d, row_number() over w as i, count(*) over (partition by event_type) as n from ev window w as (partition by event_type order by day)) group by 1", EV)
def time_label(spark, sf_dir):
    return labels.time_label(fx.daily(spark, sf_dir).df, "day", ["event_type"])


@query("select 'latitude:' || min(latitude)::varchar || ',' || max(latitude)::varchar || ',5.0' as label from grid", GRID)
def space_label(spark, sf_dir):
    return labels.axis_label(fx.grid(spark).df, "latitude")


@query("select label, m['latitude'] as lat, m['longitude'] as lon from (select 'latitude:-90.0,90.0,5.0_longitude:irregular' as label, map {'latitude': '-90.0,90.0,5.0', 'longitude': 'irregular'} as m)")
def parse_label(spark, sf_dir):
    row = spark.range(1).select(F.lit("latitude:-90.0,90.0,5.0_longitude:irregular").alias("label"))
    m = labels.parse_space(F.col("label"))
    return row.select("label", m["latitude"].alias("lat"), m["longitude"].alias("lon"))


@query("select event_id, (epoch_us(ts) - epoch_us(timestamp '2000-01-01')) / 3600000000.0::double as hours from events")
def cf_encode(spark, sf_dir):
    return fx.readings(spark, sf_dir).df.select("event_id", labels.cf_encode(F.col("ts"), "hours", "2000-01-01 00:00:00").alias("hours"))


@query("select event_id, date_trunc('second', ts) as ts from events")
def cf_decode(spark, sf_dir):
    seconds = labels.cf_encode(F.date_trunc("second", "ts"), "seconds", "1990-06-01 12:00:00")
    return fx.readings(spark, sf_dir).df.select("event_id", labels.cf_decode(seconds, "seconds since 1990-06-01 12:00:00").alias("ts"))


@query("select event_id, (year(ts) * 12 + month(ts))::int as month_index, ((hour(ts) * 60 + minute(ts)) * 60)::bigint as seconds from events")
def clock_numbers(spark, sf_dir):
    hhmm = F.hour("ts") * 100 + F.minute("ts")
    return fx.readings(spark, sf_dir).df.select("event_id", labels.month_index(F.col("ts")).alias("month_index"), labels.hhmm_seconds(hhmm).cast("long").alias("seconds"))


@query("select event_id, cast(round(v / 1000 * 65535) as int) as packed, round(0 + round(v / 1000 * 65535) / 65535 * 1000, 6) as value from (select event_id, value + 0.0 as v from events)")
def pack_unpack(spark, sf_dir):
    e = packing.pack_cube(fx.readings(spark, sf_dir), limits=(0.0, 1000.0))
    return e.df.select("event_id", F.col(VALUE).alias("packed"), F.round(packing.unpack(F.col(VALUE), 0.0, 1000.0), 6).alias(VALUE))


@query("select variable, source, time, space, variable || '_' || source || '_' || time || '.nc' as name from cat", CAT)
def file_pattern(spark, sf_dir):
    c = fx.catalogue(spark, sf_dir)
    return c.withColumn("name", labels.pattern_column('"variable"_"source"_"time".nc', c.columns))


# --- catalogue ----------------------------------------------------------------------------------------------


@query("select * from cat where source in ('F', 'O')", CAT)
def catalog_isin(spark, sf_dir):
    return catalog.matching(fx.catalogue(spark, sf_dir), source="F,O", nosuch="x")


@query("select * from cat where source = 'F' and space < '2' union select * from cat where source = 'O'", CAT)
def catalog_union(spark, sf_dir):
    c = fx.catalogue(spark, sf_dir)
    return catalog.upsert(catalog.queried(c, "source = 'O'"), catalog.queried(c, lambda t: t.where("source = 'F' and space < '2'")))


@query("select variable, source, time, space, case source when 'F' then 0 when 'O' then 1 else 2 end::int as req from cat where (variable, time, space) in (select (variable, time, space) from cat where source in ('F', 'O', 'P') group by variable, time, space having count(distinct source) = 3)", CAT)
def group_complete(spark, sf_dir):
    c = fx.catalogue(spark, sf_dir)
    asked = labels.request_table(spark, {"source": ["F", "O", "P"]})
    return catalog.complete_groups(c, asked, ["variable", "time", "space"]).select(*catalog.KEYS, "req")


@query("select * from cat where source = 'O' and not (time like 'monthly_1996%')", CAT)
def skip_existing(spark, sf_dir):
    c = fx.catalogue(spark, sf_dir).where("source = 'O'")
    return catalog.skip_existing(c, c.where("time like 'monthly_1996%'"))


@query("select distinct source, variable, 0::int as req from cat where variable = '1-URGENT' union all select distinct source, '2-HIGH', 1 from cat", CAT)
def wildcard_expand(spark, sf_dir):
    asked = labels.request_table(spark, [{"source": None, "variable": "1-URGENT"}, {"source": None, "variable": "2-HIGH"}])
    return catalog.expand_wildcards(asked, fx.catalogue(spark, sf_dir), ["source"])


@query("select source, 0::int as place, n::varchar as units, 'mine' as title from (select source, count(*) as n from cat group by 1)", CAT)
def inherit_attrs(spark, sf_dir):
    c = fx.catalogue(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).alias("place")
    inputs = c.select("source", zero, F.create_map(F.lit("units"), F.col("n").cast("string"), F.lit("title"), F.lit("theirs"), F.lit("path"), F.lit("x")).alias("attrs"))
    own = c.select("source", zero, F.create_map(F.lit("title"), F.lit("mine")).alias("attrs"))
    out = catalog.inherit(own, inputs, ["source"], True)
    return out.select("source", "place", F.col("attrs")["units"].alias("units"), F.col("attrs")["title"].alias("title"))


@query("select time, 'from__' || string_agg(source, '__' order by source) as label from (select distinct time, source from cat) group by 1", CAT)
def auto_label(spark, sf_dir):
    return fx.catalogue(spark, sf_dir).groupBy("time").agg(labels.auto_label_column(F.col("source"), F.col("source")).alias("label"))


# --- functions ----------------------------------------------------------------------------------------------


@query("select event_type, max(value) - min(value) as value from ev group by 1", EV)
def pandas_apply(spark, sf_dir):
    import pandas as pd

    return apply(fx.daily(spark, sf_dir), lambda f: pd.DataFrame({VALUE: [f[VALUE].max() - f[VALUE].min()]}), ["day"], output={}).df


@query("select vec_id, k, value * 2 + 1 as value from emb", EMB)
def expression_apply(spark, sf_dir):
    return apply(fx.vectors(spark, sf_dir), "value * 2 + 1", ["k"]).df


@query("select event_type, x, count(*)::double as value from ev, (values (0), (20), (40)) t(x) where value >= x group by 1, 2", EV)
def new_dim_apply(spark, sf_dir):
    """The output grid is another than the input's: counts above levels, which become a dimension."""
    import pandas as pd

    def over(f, levels):
        got = [(x, float((f[VALUE] >= x).sum())) for x in levels]
        return pd.DataFrame([g for g in got if g[1]], columns=["x", VALUE])

    return apply(fx.daily(spark, sf_dir), over, ["day"], output={"x": "int"}, kwargs={"levels": [0, 20, 40]}).df


@query("select event_type, (count(*) + (select count(distinct l_returnflag) from lineitem))::double as value from ev group by 1", EV)
def cogroup_functions(spark, sf_dir):
    import pandas as pd

    flags = fx.table(spark, sf_dir, "lineitem").select("l_returnflag").distinct()
    kinds = fx.table(spark, sf_dir, "events").select("event_type").distinct()
    other = Cube(kinds.crossJoin(flags).withColumn(VALUE, F.lit(1.0)), ("event_type", "l_returnflag"))
    run = lambda a, b: pd.DataFrame({"event_type": [a.event_type.iloc[0]], VALUE: [float(len(a) + len(b))]})
    return cogroup_apply(fx.daily(spark, sf_dir), other, run, ["event_type"], "event_type string, value double", ["event_type"]).df


@query("select event_type, day, value, (row_number() over (partition by event_type order by value desc, day))::int as place from ev qualify place <= 3", EV)
def top_values(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy(F.desc(VALUE), "day")
    return fx.daily(spark, sf_dir).df.withColumn("place", F.row_number().over(w)).where("place <= 3")


@query("select event_type, min_by(day, value) as low, max_by(day, value) as high from ev group by 1", EV)
def arg_extremes(spark, sf_dir):
    return fx.daily(spark, sf_dir).df.groupBy("event_type").agg(F.min_by("day", VALUE).alias("low"), F.max_by("day", VALUE).alias("high"))


@query("select event_type, day, value - avg(value) over (partition by event_type) as value from (select event_type, day, floor(value)::double as value from ev)", EV)
def vectorised_apply(spark, sf_dir):
    """Whole numbers, so that the mean is the same in any order of adding."""
    import numpy as np

    whole = fx.daily(spark, sf_dir).with_value(F.floor(VALUE).cast("double"))
    return apply_vectorised(whole, lambda x: x - np.sum(x, axis=1, keepdims=True) / x.shape[1], "day").df


# --- catalogues that are written and read back ----------------------------------------------------------------


def _stored(spark, sf_dir) -> catalog.Catalog:
    """One cube of daily means for each event type, written to a catalogue."""
    cat = catalog.Catalog.open(spark, fx.scratch(spark))
    cube = fx.daily(spark, sf_dir)
    for (kind,) in cube.df.select("event_type").distinct().orderBy("event_type").collect():
        cat.add(Cube(cube.df.where(F.col("event_type") == kind).drop("event_type"), ("day",), "events"), save=False, variable="events", source=kind, time="days", space="none")
    return cat.save()


@query("select event_type as source, day, value from ev", EV)
def catalog_round_trip(spark, sf_dir):
    cat = _stored(spark, sf_dir)
    again = catalog.Catalog.open(spark, cat.root)
    return align.concat({k[1]: c for k, c in again.map(lambda c: c).items()}, "source").df.select("source", "day", VALUE)


@query("select distinct event_type as source, 'events' as variable, 'days' as time, 'none' as space from events order by 1")
def catalog_sorted(spark, sf_dir):
    return _stored(spark, sf_dir).rows().select(*catalog.KEYS)


@query("select event_type as source, avg(abs(value - round(value * 65535 / 1000) * 1000 / 65535)) < 0.01 as near, count(*) as n from ev where value between 0 and 1000 group by 1", EV)
def catalog_packed(spark, sf_dir):
    """Packed cubes are unpacked on reading; a second call finds nothing to pack."""
    cat = _stored(spark, sf_dir).pack().pack()
    back = align.concat({k[1]: c for k, c in cat.map(lambda c: c).items()}, "source").df.where(F.col(VALUE).isNotNull())
    plain = fx.daily(spark, sf_dir).df.select(F.col("event_type").alias("source"), "day", F.col(VALUE).alias("own"))
    return back.join(plain, ["source", "day"]).groupBy("source").agg((F.avg(F.abs(F.col(VALUE) - F.col("own"))) < 0.01).alias("near"), F.count(F.lit(1)).alias("n"))


@query("select event_type as source, max(value) as value from ev group by 1", EV)
def catalog_locked_apply(spark, sf_dir):
    """The second process finds every output there and makes none."""
    cat = _stored(spark, sf_dir)
    to = fx.scratch(spark)
    top = lambda c: reduce.reduce(c, "day", "max")
    for _ in range(2):
        done = cat.apply_locked(top, {"variable": ["events"]}, [{"variable": "top"}], into=to)
    return align.concat({k[1]: c for k, c in done.map(lambda c: c).items()}, "source").df.select("source", VALUE)


@query("select event_type as source, day, value from ev where event_type <> 'click' union all select event_type, day, value + 1 from ev where event_type = 'click'", EV)
def collection_read(spark, sf_dir):
    """Of two catalogues the later one counts where both have a cube."""
    first = _stored(spark, sf_dir)
    later = catalog.Catalog.open(spark, fx.scratch(spark))
    key = {"variable": "events", "source": "click", "time": "days", "space": "none"}
    if not first.table.where("source = 'click'").isEmpty():
        later.add(first.cube(key).with_value(F.col(VALUE) + 1), **key)
    both = catalog.Collection(spark, [first, later])
    return align.concat({k[1]: c for k, c in both.map(lambda c: c).items()}, "source").df.select("source", "day", VALUE)


@query("select event_type as source, day, value from ev", EV)
def catalog_discover(spark, sf_dir):
    """Tables below a folder, found by the pattern of their names."""
    root = fx.scratch(spark)
    cube = fx.daily(spark, sf_dir)
    for (kind,) in cube.df.select("event_type").distinct().collect():
        cube_store.write(Cube(cube.df.where(F.col("event_type") == kind).drop("event_type"), ("day",)), f"{root}/events_{kind}.parquet", single=False)
    cat = catalog.Catalog.open(spark, fx.scratch(spark)).discover_below(root, '"variable"_"source".parquet', time="days", space="none")
    return align.concat({k[1]: c for k, c in cat.map(lambda c: c).items()}, "source").df.select("source", "day", VALUE)


@query("select (case event_type when 'click' then 0 else 1 end)::int as part, event_type, day, value from ev where event_type in ('click', 'view')", EV)
def file_list(spark, sf_dir):
    """Files along an outer dimension: the place in the list is the coordinate."""
    root, cube = fx.scratch(spark), fx.daily(spark, sf_dir)
    paths = [cube_store.write(cube.where(F.col("event_type") == k), f"{root}/{k}", single=False) for k in ("click", "view")]
    return cube_store.read_files(spark, paths, ["event_type", "day"], "part").df


@query("select o_orderpriority as variable, o_orderdate::timestamp as time, sum(o_totalprice::decimal(18,2))::double as value from orders group by 1, 2")
def csv_station_series(spark, sf_dir):
    """A wide text table with a date column, read as one series for each column."""
    root = fx.scratch(spark)
    o = fx.table(spark, sf_dir, "orders")
    wide = o.groupBy(F.date_format("o_orderdate", "dd/MM/yyyy").alias("Dates")).pivot("o_orderpriority").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")))
    names = [c for c in wide.columns if c != "Dates"]
    wide.toDF("Dates", *(f"P{i}" for i in range(len(names)))).write.csv(root, header=True)
    long = csv_series.long_series(csv_series.read_series(spark, root, "Dates", "dd/MM/yyyy")).where(F.col(VALUE).isNotNull())
    label = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (f"P{i}", n)))
    return long.select(label[F.col("variable")].alias("variable"), F.col("time"), VALUE)
