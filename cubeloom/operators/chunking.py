"""Overlapping chunks along a dimension and how their results are blended."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cube import VALUE, Cube


def chunk_bounds(length: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of each chunk; a chunk starts size - overlap after the one before."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the chunk")
    step = size - overlap
    return [(s, min(s + size, length)) for s in range(0, length, step)]


def chunks_of(idx: Column, size: int, overlap: int) -> Column:
    """Numbers of the chunks that hold a place, ascending: by arithmetic, without a join."""
    step = size - overlap
    return F.sequence(F.greatest(F.floor((idx - size) / step) + 1, F.lit(0)).cast("int"), F.floor(idx / step).cast("int"))


def weight(idx: Column, chunk: Column, length: Column, size: int, overlap: int, profile: str) -> Column:
    """square: each place counts in one chunk, the seam in the middle of the overlap; triangle: linear ramps. The first
    chunk has no ramp on the left, the last none on the right."""
    step = size - overlap
    k = idx - chunk * step
    last = chunk * step + size >= length
    if profile == "square":
        left = F.when((chunk > 0) & (k < overlap // 2), 0.0).otherwise(1.0)
        right = F.when(~last & (k >= size - overlap + overlap // 2), 0.0).otherwise(1.0)
    elif profile == "triangle":
        left = F.when((chunk > 0) & (k < overlap), k / F.lit(float(max(overlap, 1)))).otherwise(1.0)
        right = F.when(~last & (k >= step), (size - k) / F.lit(float(max(overlap, 1)))).otherwise(1.0)
    else:
        raise ValueError(f"no such profile: {profile}")
    return left * right


def overlap_apply(cube: Cube, dim: str, fn: Callable[[pd.DataFrame], pd.DataFrame] | None, size: int, overlap: int, profile: str = "square") -> Cube:
    """``fn`` over each chunk of a dimension (a pandas frame sorted by ``dim``, value replaced or kept); results are blended by
    weights that are divided by their sum. A chunk that lies within the one before is left out. A group is one chunk of one line
    along ``dim``, so its size is bounded by ``size``. ``fn`` None is the identity and stays in the JVM."""
    rest = cube.others(dim)
    placed = cube.indexed(dim).df
    n = cube.coordinates(dim).count()
    step = size - overlap
    used = max(1, -(-(n - overlap) // step)) if n > overlap else 1  # chunks that reach beyond the one before
    dealt = placed.withColumn("chunk", F.explode(F.filter(chunks_of(F.col(f"{dim}_idx"), size, overlap), lambda c: c < used)))
    if fn is not None:
        schema = dealt.schema

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            return fn(frame.sort_values(dim))

        dealt = dealt.groupBy(*rest, "chunk").applyInPandas(run, schema)
    w = weight(F.col(f"{dim}_idx"), F.col("chunk"), F.lit(n), size, overlap, profile)
    out = dealt.withColumn("w", w).where("w > 0").groupBy(*cube.dims).agg((F.sum(F.col(VALUE) * F.col("w")) / F.sum("w")).alias(VALUE))
    return replace(cube, df=out)


def blend(parts: DataFrame, dims: list[str], value: str = VALUE, by: str = "w") -> DataFrame:
    """Weighted contributions to the same points."""
    return parts.groupBy(*dims).agg((F.sum(F.col(value) * F.col(by)) / F.sum(by)).alias(value))
