"""Lookups and interpolation between knots. Knots are a table (idx, x, y), optionally per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

ARRAY_LIMIT = 100_000  # knots of a group that are carried as one array


def knot_arrays(knots: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., knots): the knots of a group as an array ordered by place. More than ARRAY_LIMIT is an error."""
    packed = knots.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("knots"))
    return packed.withColumn("knots", F.when(F.size("knots") <= ARRAY_LIMIT, F.col("knots")).otherwise(F.raise_error(F.lit("too many knots in a group"))))


def with_knots(points: DataFrame, knots: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Points beside their group's knots: one equi-join, or the one array for all."""
    packed = knot_arrays(knots, by)
    return points.join(packed, list(by)) if by else points.crossJoin(F.broadcast(packed))  # one row of at most ARRAY_LIMIT knots


def nearest(x: Column, knots: str = "knots") -> Column:
    """y of the knot nearest to x, the first of equally near ones; a missing x takes the first knot."""
    dist = F.transform(F.col(knots), lambda k: F.struct(F.coalesce(F.abs(k.x - x), F.lit(0.0)).alias("d"), k.idx.alias("i"), k.y.alias("y")))
    return F.array_min(dist)["y"]


def linear(x: Column, knots: str = "knots") -> Column:
    """Linear between the last knot at or below x and the next, and straight on beyond either end. Of knots with the same x
    the last counts; a missing x or fewer than two knots give missing."""
    k = F.col(knots)
    n = F.size(k)
    right = F.size(F.filter(k, lambda p: p.x <= x))  # place of the first knot above x, from 0
    i = F.greatest(F.least(right, n - 1), F.lit(1))
    seg = F.struct(F.get(k, i - 1).alias("l"), F.get(k, i).alias("r"))
    return F.when(x.isNotNull() & (n > 1), F.transform(F.array(seg), lambda s: F.when(s.r.x == s.l.x, s.l.y).otherwise(s.l.y * (s.r.x - x) / (s.r.x - s.l.x) + s.r.y * (1 - (s.r.x - x) / (s.r.x - s.l.x))))[0])


def segments(knots: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Knots as segments (xl, yl, xr, yr, low, high) whose first and last are open-ended: a range join gives each x one."""
    w = Window.partitionBy(*by).orderBy("idx")
    seg = knots.select(*by, "idx", F.col("x").cast("double").alias("xl"), F.col("y").cast("double").alias("yl"), F.lead(F.col("x").cast("double")).over(w).alias("xr"), F.lead(F.col("y").cast("double")).over(w).alias("yr"), F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("n")).where("i < n")
    return seg.withColumn("low", F.when(F.col("i") == 1, F.lit(float("-inf"))).otherwise(F.col("xl"))).withColumn("high", F.when(F.col("i") == F.col("n") - 1, F.lit(float("inf"))).otherwise(F.col("xr")))


def on_plateau(x: Column, knots: str = "knots", seed: int | None = None) -> Column:
    """Where x hits a repeated knot exactly: a uniform draw between the plateau's ends. Off unless a seed is given."""
    if seed is None:
        return linear(x, knots)
    ys = F.transform(F.filter(F.col(knots), lambda p: p.x == x), lambda p: p.y)
    return F.when(F.size(ys) > 1, F.array_min(ys) + F.rand(seed) * (F.array_max(ys) - F.array_min(ys))).otherwise(linear(x, knots))


def bias_correct(x: Column, biased: str, reference: str) -> Column:
    """Quantile mapping x + Q_ref(F(x)) - Q_biased(F(x)). Both columns are knot arrays with x = cdf, y = quantile."""
    swapped = F.transform(F.col(biased), lambda p: F.struct(p.idx.alias("idx"), p.y.alias("x"), p.x.alias("y")))
    return F.transform(F.array(F.struct(x.alias("x"), swapped.alias("inv"), F.col(biased).alias("b"), F.col(reference).alias("r"))), lambda s: _corrected(s))[0]


def _corrected(s: Column) -> Column:
    at = _line(s.x, s.inv)
    return F.transform(F.array(at), lambda p: s.x + _line(p, s.r) - _line(p, s.b))[0]


def _line(x: Column, k: Column) -> Column:
    n = F.size(k)
    i = F.greatest(F.least(F.size(F.filter(k, lambda p: p.x <= x)), n - 1), F.lit(1))
    return F.transform(F.array(F.struct(F.get(k, i - 1).alias("l"), F.get(k, i).alias("r"))), lambda s: F.when(s.r.x == s.l.x, s.l.y).otherwise(s.l.y + (s.r.y - s.l.y) * ((x - s.l.x) / (s.r.x - s.l.x))))[0]
