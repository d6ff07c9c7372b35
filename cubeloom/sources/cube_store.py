"""Cubes in Parquet folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..cube import VALUE, Cube


def write(cube: Cube, path: str, partition_by: Sequence[str] = (), overwrite: bool = False, single: bool = True) -> str:
    """Values as floats of four bytes (``single``). The commit moves finished files; a failed job leaves nothing behind."""
    df = cube.with_value(F.col(VALUE).cast("float")).df if single and dict(cube.df.dtypes)[VALUE] == "double" else cube.df
    out = df.write.mode("overwrite" if overwrite else "errorifexists")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return path


def read(spark: SparkSession, path: str, dims: Sequence[str], value: str = VALUE, name: str = "value", aliases: dict[str, str] | None = None, fill: float | None = None) -> Cube:
    """``aliases`` renames columns; NaN and ``fill`` become missing."""
    df = spark.read.parquet(path)
    for old, new in (aliases or {}).items():
        df = df.withColumnRenamed(old, new)
    v = F.col(value) if fill is None else F.when(F.col(value) != F.lit(fill), F.col(value))
    return Cube.of(df, dims, v, name)


def read_files(spark: SparkSession, paths: Sequence[str], dims: Sequence[str], dim: str, value: str = VALUE) -> Cube:
    """A list of files along an outer dimension: each file's place in the list is its coordinate."""
    from pyspark.sql import DataFrame

    def one(i: int, p: str) -> DataFrame:
        return spark.read.parquet(p).select(F.lit(i).alias(dim), *dims, F.col(value).alias(VALUE))

    df = one(0, paths[0])
    for i, p in enumerate(paths[1:], 1):
        df = df.unionByName(one(i, p))
    return Cube(df, (dim, *dims))


def copy(spark: SparkSession, source: str, to: str, columns: Sequence[str] | None = None) -> None:
    df = spark.read.parquet(source)
    (df.select(*columns) if columns else df).write.parquet(to)
