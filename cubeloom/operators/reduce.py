"""Reductions along named dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cube import VALUE, Cube

AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop, "var": F.var_pop, "count": F.count, "median": F.median}


def reduce(cube: Cube, dims: str | Sequence[str], how: str | Column = "mean", skipna: bool = True, keepdim: bool = False) -> Cube:
    """``how`` over ``dims``: a name of AGGREGATES or an aggregate of ``value``. ``skipna=False`` makes a group with a missing
    value missing. ``keepdim`` keeps each dimension at its middle coordinate."""
    dims = (dims,) if isinstance(dims, str) else tuple(dims)
    rest = cube.others(*dims)
    value = AGGREGATES[how](VALUE) if isinstance(how, str) else how
    if not skipna:
        value = F.when(F.count(VALUE) == F.count(F.lit(1)), value)
    out = Cube(cube.df.groupBy(*rest).agg(value.alias(VALUE)), rest, cube.name, cube.attrs)
    if keepdim:
        for d in dims:
            axis = cube.coordinates(d)
            middle = axis.where(F.col("idx") == F.floor(axis.agg(F.count(F.lit(1))).scalar() / 2)).select(d)
            out = replace(out, df=out.df.crossJoin(F.broadcast(middle)), dims=(*out.dims, d))  # one row
        out = out.transpose(*cube.dims)
    return out


def group_reduce(cube: Cube, dim: str, key: Column, name: str, how: str | Column = "mean") -> Cube:
    """Groups along a dimension, by a label of its coordinates; the label becomes a dimension."""
    rest = cube.others(dim)
    value = AGGREGATES[how](VALUE) if isinstance(how, str) else how
    return Cube(cube.df.groupBy(*rest, key.alias(name)).agg(value.alias(VALUE)), (*rest, name), cube.name, cube.attrs)


def cycle(cube: Cube, dim: str, n: int, position: Column | None = None, how: str | Column = "mean", name: str = "slot") -> Cube:
    """Mean by position modulo ``n``; slot 0 appears again as slot n. ``position`` defaults to the place on the axis."""
    if position is None:
        cube, position = cube.indexed(dim), F.col(f"{dim}_idx")
    out = group_reduce(cube, dim, F.pmod(position, F.lit(n)).cast("int"), name, how)
    # one pass: slot 0 is emitted twice
    slots = F.when(F.col(name) == 0, F.array(F.lit(0), F.lit(n))).otherwise(F.array(name))
    return replace(out, df=out.df.withColumn(name, F.explode(slots)).select(*out.dims, VALUE))


def quantiles(cube: Cube, dim: str | Sequence[str], cdfs: Sequence[float], stable_start: bool = False, stable_end: bool = False, name: str = "quantile") -> Cube:
    """Order statistics: the value at place trunc((n-1)p) of the present values, never interpolated. ``stable_end`` takes
    the last point's place from the point before it, ``stable_start`` the first's from the second. Columns value and cdf.

    A group's values are sorted together; groups are the cube's other points, so give ``dim`` what may grow only
    where a group fits a task, else use :func:`ranked_quantiles`."""
    rest = cube.others(*((dim,) if isinstance(dim, str) else dim))
    places = _places(len(cdfs), stable_start, stable_end)
    points = F.array(*(F.struct(F.lit(i).alias(name), F.lit(float(p)).alias("cdf"), F.lit(float(cdfs[j])).alias("at")) for i, (p, j) in enumerate(zip(cdfs, places, strict=True))))
    got = cube.df.groupBy(*rest).agg(F.sort_array(F.collect_list(VALUE)).alias("s")).withColumn("q", F.explode(points))
    value = F.try_element_at("s", (F.floor((F.size("s") - 1) * F.col("q.at")) + 1).cast("int"))
    out = got.select(*rest, F.col(f"q.{name}").alias(name), F.when(F.size("s") > 0, value).alias(VALUE), F.when(F.size("s") > 0, F.col("q.cdf")).alias("cdf"))
    return Cube(out, (*rest, name), cube.name, cube.attrs)


def _places(n: int, stable_start: bool, stable_end: bool) -> list[int]:
    places = list(range(n))
    if stable_end and n > 1:
        places[-1] = places[-2]
    if stable_start and n > 1:
        places[0] = places[1]
    return places


def ranked_quantiles(cube: Cube, dim: str | Sequence[str], cdfs: Sequence[float], stable_start: bool = False, stable_end: bool = False, name: str = "quantile") -> Cube:
    """The rows of :func:`quantiles` for groups of any size, without gathering a group: counts of equal values are summed up
    first, so the window sorts distinct values and spills."""
    from pyspark.sql import Window

    rest = cube.others(*((dim,) if isinstance(dim, str) else dim))
    counts = cube.df.groupBy(*rest, VALUE).agg(F.count(VALUE).alias("c"))  # the missing values count nothing
    w = Window.partitionBy(*rest)
    placed = counts.select(*rest, VALUE, F.sum("c").over(w.orderBy(VALUE)).alias("hi"), F.col("c"), F.sum("c").over(w).alias("n"))
    places = _places(len(cdfs), stable_start, stable_end)
    points = F.array(*(F.struct(F.lit(i).alias(name), F.lit(float(p)).alias("cdf"), F.lit(float(cdfs[j])).alias("at")) for i, (p, j) in enumerate(zip(cdfs, places, strict=True))))
    at = lambda q: F.floor((F.col("n") - 1) * q["at"])
    hit = F.when(F.col("n") == 0, points).otherwise(F.filter(points, lambda q: (at(q) < F.col("hi")) & (at(q) >= F.col("hi") - F.col("c"))))
    out = placed.withColumn("q", F.explode(hit)).select(*rest, F.col(f"q.{name}").alias(name), VALUE, F.when(F.col("n") > 0, F.col("q.cdf")).alias("cdf"))
    return Cube(out, (*rest, name), cube.name, cube.attrs)


def multi(cube: Cube, dims: Sequence[str], **outputs: str) -> dict[str, Cube]:
    """Several outputs of one pass; each is a cube."""
    rest = cube.others(*dims)
    out = cube.df.groupBy(*rest).agg(*(AGGREGATES[how](VALUE).alias(name) for name, how in outputs.items()))
    return {name: Cube(out.select(*rest, F.col(name).alias(VALUE)), rest, name, cube.attrs) for name in outputs}


def long_outputs(outputs: dict[str, Cube], column: str = "output") -> DataFrame:
    from .align import concat

    return concat(outputs, column).df
