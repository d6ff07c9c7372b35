"""Labels and small rules about axes: time and space labels, patterns, packing of names, CF time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

UNIT_MICROS = {"seconds": 10**6, "minutes": 60 * 10**6, "hours": 3600 * 10**6, "days": 86400 * 10**6}


def order_keys(keys: Sequence[str], first: Sequence[str]) -> list[str]:
    """The keys that ``first`` names take, in its order, the places they hold together; the rest stay where they are."""
    named = iter([k for k in first if k in keys])
    return [next(named) if k in first else k for k in keys]


def month_index(t: Column) -> Column:
    return F.year(t) * 12 + F.month(t)


def time_label(df: DataFrame, time: str, by: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """(by..., label) of the time axes of a table. Rules in this order: integers; months without a gap; all stamps the first
    of a month at midnight; inner steps of one day; else irregular. The first and last step are not looked at for days."""
    kind = dict(df.dtypes)[time]
    axis = df.select(*by, F.col(time).alias("t")).where("t is not null").distinct()
    name = F.lit(f"_{prefix}" if prefix else "")
    if kind in ("int", "bigint", "smallint", "tinyint"):
        return axis.groupBy(*by).agg(F.concat(F.lit("integer_"), F.min("t"), F.lit("_"), F.max("t"), name).alias("label"))
    w = Window.partitionBy(*by).orderBy("t")
    steps = axis.select(
        *by, "t", (month_index(F.col("t")) - F.lag(month_index(F.col("t"))).over(w)).alias("months"), (F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.lag(F.col("t").cast("timestamp")).over(w))).alias("micros"),
        F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("n"),
    )
    inner = (F.col("i") > 2) & (F.col("i") < F.col("n"))
    got = steps.groupBy(*by).agg(
        F.coalesce(F.bool_and(F.col("months") == 1), F.lit(True)).alias("monthly"), F.bool_and(F.col("t") == F.date_trunc("month", "t")).alias("firsts"),
        F.coalesce(F.bool_and(F.when(inner, F.col("micros") == UNIT_MICROS["days"])), F.lit(True)).alias("daily"), F.min("t").alias("a"), F.max("t").alias("b"),
    )
    span = lambda form: F.concat(F.lit("_"), F.date_format("a", form), F.lit("_"), F.date_format("b", form), name)
    return got.select(*by, F.when(F.col("monthly") | F.col("firsts"), F.concat(F.lit("monthly"), span("yyyy-MM"))).when(F.col("daily"), F.concat(F.lit("daily"), span("yyyy-MM-dd"))).otherwise(F.concat(F.lit("irregular"), name)).alias("label"))


def axis_label(df: DataFrame, dim: str) -> DataFrame:
    """One row, label: ``dim:first,last,step`` of an equidistant axis, ``dim:irregular``, or ``dim:`` of strings."""
    if dict(df.dtypes)[dim] == "string":
        return df.sparkSession.range(1).select(F.lit(f"{dim}:").alias("label"))
    axis = df.select(F.col(dim).cast("double").alias("x")).where("x is not null").distinct()
    step = axis.withColumn("d", F.col("x") - F.lag("x").over(Window.orderBy("x")))
    got = step.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("d").alias("low"), F.max("d").alias("high"))
    return got.select(F.when(F.col("low") == F.col("high"), F.concat(F.lit(f"{dim}:"), F.concat_ws(",", "a", "b", "low"))).otherwise(F.lit(f"{dim}:irregular")).alias("label"))


def space_label(df: DataFrame, dims: Sequence[str], space_id: str = "") -> str:
    """Labels of all axes but time, joined by ``_``."""
    parts = [axis_label(df, d).first()[0] for d in dims]
    return "_".join(([space_id] if space_id else []) + parts)


def parse_space(label: Column) -> Column:
    """``name:first,last,step_name:…`` as a map from name to text."""
    return F.str_to_map(label, F.lit("_"), F.lit(":"))


def crs_attributes(lon0: float, dlon: float, lat0: float, dlat: float) -> dict[str, str]:
    """WGS84 attributes of a latitude-longitude grid."""
    return {"grid_mapping": "crs", "crs_grid_mapping_name": "latitude_longitude", "crs_long_name": "CRS definition", "crs_longitude_of_prime_meridian": "0.0", "crs_semi_major_axis": "6378137.0", "crs_inverse_flattening": "298.257223563", "crs_GeoTransform": f"{lon0} {dlon} {lat0} {dlat}"}


def sidecar(attrs: Mapping[str, str], mapping: str) -> dict[str, str]:
    """Attributes of a CRS side variable under prefixed names."""
    return {f"{mapping}_{k}": v for k, v in attrs.items()}


def pattern_column(pattern: str, columns: Iterable[str]) -> Column:
    """``"variable"_"source".nc`` with the columns of that name; unknown names are an error."""
    columns, parts = set(columns), re.split(r'"([^"]*)"', pattern)
    if unknown := [k for k in parts[1::2] if k not in columns]:
        raise KeyError(unknown[0])
    return F.concat(*(F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def pattern_name(pattern: str, attributes: Mapping[str, str]) -> str:
    return re.sub(r'"([^"]*)"', lambda m: str(attributes[m[1]]), pattern)


def auto_label(labels: Iterable[str]) -> str:
    """``from__a__b`` of the distinct labels by first appearance."""
    return "from__" + "__".join(dict.fromkeys(map(str, labels)))


def auto_label_column(label: Column, order: Column) -> Column:
    """The same as an aggregate: distinct labels in the order of their first appearance."""
    return F.concat(F.lit("from__"), F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), label.alias("l")))), lambda x: x.l)), "__"))


def cf_encode(t: Column, unit: str, reference: str) -> Column:
    """Time as a number of ``unit`` since ``reference``; micros are whole, so only the last division rounds."""
    ref = F.unix_micros(F.to_timestamp(F.lit(reference)))
    return (F.unix_micros(t.cast("timestamp")) - ref) / F.lit(UNIT_MICROS[unit])


def cf_decode(value: Column, units: str) -> Column:
    """``<unit> since Y-m-d H:M[:S]`` to a time without zone."""
    unit, _, since = units.partition(" since ")
    micros = F.round(value * F.lit(UNIT_MICROS[unit])).cast("long") + F.unix_micros(F.to_timestamp(F.lit(since)))
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def cf_unit(first_step_micros: int) -> str:
    """The largest unit that divides the first step."""
    return next(u for u in ("days", "hours", "minutes", "seconds") if first_step_micros % UNIT_MICROS[u] == 0 or u == "seconds")


def hhmm_seconds(v: Column) -> Column:
    """1330 is half past one in the afternoon: 48600 seconds."""
    return (F.floor(v / 100) * 60 + F.pmod(v, F.lit(100))) * 60


def plain_name(name: str) -> str:
    return re.sub(r"[^0-9A-Za-z]", "", name)


def cdf_points(bins: int = 50, profile: str = "uniform", start: float = 0.0, end: float = 0.999) -> list[float]:
    if profile == "uniform":
        return np.linspace(start, end, bins + 1).tolist()
    if profile == "exponential":
        return sorted((1 - np.exp(np.linspace(np.log(1 - end), np.log(1 - start), bins + 1))).tolist())
    raise ValueError(f"no such profile: {profile}")


def request_rows(spec) -> list[dict]:
    """Requests as a list of dicts: given so, as a dict of lists (their product), or as a table."""
    if isinstance(spec, DataFrame):
        return [r.asDict() for r in spec.collect()]
    if isinstance(spec, Mapping):
        lists = [v if isinstance(v, (list, tuple)) else [v] for v in spec.values()]
        return [dict(zip(spec, x, strict=True)) for x in product(*lists)]
    return [dict(x) for x in spec]


def request_table(spark: SparkSession, spec) -> DataFrame:
    """Distinct requests in order, with their place as ``req``."""
    rows = list({tuple(sorted(r.items(), key=str)): r for r in request_rows(spec)}.values())
    keys = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([(*(None if r.get(k) is None else str(r[k]) for k in keys), i) for i, r in enumerate(rows)], ", ".join(f"`{k}` string" for k in keys) + ", req int")


def evaluated(value, labels: Sequence[str]):
    """A label, or a function of the inputs' labels."""
    return value(*labels) if isinstance(value, Callable) else value
