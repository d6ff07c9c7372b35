"""Windows along a dimension."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..cube import VALUE, Cube


def _axis(cube: Cube, dim: str):
    return Window.partitionBy(*cube.others(dim)).orderBy(dim)


def moving_average(cube: Cube, dim: str, n: int = 3, mean=F.avg) -> Cube:
    """Centred mean of n places that shrinks at the edges. For even n the window leans one place forward, and the last n/2
    rows take n/2 places before them up to the end."""
    if n < 1:
        raise ValueError("n must be positive")
    w, half = _axis(cube, dim), n // 2
    body = mean(VALUE).over(w.rowsBetween(-(-(-n // 2) - 1), half))
    if n % 2:
        return cube.with_value(body)
    tail = mean(VALUE).over(w.rowsBetween(-half, Window.unboundedFollowing))
    place = F.row_number().over(w)
    count = F.count(F.lit(1)).over(Window.partitionBy(*cube.others(dim)))
    out = cube.df.withColumn("__last", place > count - half).withColumn("__body", body).withColumn("__tail", tail)
    return replace(cube, df=out.withColumn(VALUE, F.when(F.col("__last"), F.col("__tail")).otherwise(F.col("__body"))).drop("__last", "__body", "__tail"))


def glide(cube: Cube, dim: str, n: int) -> Cube:
    """Mean of n places, missing where the window is not full. For even n neighbours are averaged first, so the ends of
    n + 1 places count half."""
    half, w = n // 2, _axis(cube, dim)
    full = F.count(VALUE).over(w.rowsBetween(-half, half)) == 2 * half + 1
    total = F.sum(VALUE).over(w.rowsBetween(-half, half))
    if n % 2 == 0:
        total = total - (F.lag(VALUE, half).over(w) + F.lead(VALUE, half).over(w)) / 2
    return cube.with_value(F.when(full, total / n))


def anomaly(cube: Cube, dims: str | tuple[str, ...], mean: Column | None = None) -> Cube:
    """The value less its mean over ``dims``."""
    rest = cube.others(*((dims,) if isinstance(dims, str) else dims))
    return cube.with_value(F.col(VALUE) - (F.avg(VALUE) if mean is None else mean).over(Window.partitionBy(*rest)))


def difference(cube: Cube, dim: str) -> Cube:
    """Step from the place before; the first is missing."""
    return cube.with_value(F.col(VALUE) - F.lag(VALUE).over(_axis(cube, dim)))


def regular(cube: Cube, dim: str):
    """One row: whether the axis is equidistant, its first, last and step."""
    axis = cube.df.select(F.col(dim).cast("double").alias("x")).distinct()
    steps = axis.withColumn("d", F.col("x") - F.lag("x").over(Window.orderBy("x")))
    return steps.agg((F.coalesce(F.min("d") == F.max("d"), F.lit(True))).alias("regular"), F.min("x").alias("first"), F.max("x").alias("last"), F.min("d").alias("step"), F.abs(F.median("d")).alias("median_step"))


def plateau_start(cube: Cube, dim: str) -> Cube:
    """For each place the first coordinate at which its value stands."""
    out = cube.df.withColumn("start", F.min(dim).over(Window.partitionBy(*cube.others(dim), VALUE)))
    return replace(cube, df=out)
