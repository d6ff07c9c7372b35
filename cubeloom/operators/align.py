"""Several cubes on shared dimensions."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cube import VALUE, Cube


def same_axis(a: Cube, b: Cube, dim: str) -> bool:
    """Whether both have the same coordinates."""
    x, y = a.df.select(dim).distinct(), b.df.select(dim).distinct()
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def identical(a: Cube, b: Cube) -> bool:
    """Same dimensions and the same values at the same points; names and attributes don't matter."""
    cols = [*sorted(a.dims), VALUE]
    return set(a.dims) == set(b.dims) and a.df.select(cols).exceptAll(b.df.select(cols)).isEmpty() and b.df.select(cols).exceptAll(a.df.select(cols)).isEmpty()


def align(*cubes: Cube, check: bool = False, singletons: tuple[str, ...] = ()) -> DataFrame:
    """One row for each common point, values as v0, v1, …: an equi-join on the dimensions two cubes share.

    A dimension that one lacks is replicated. ``singletons`` names dimensions that are of length one in some cube and
    broadcast, in any order of arguments. ``check`` compares the shared axes and raises on a difference; it costs a pass.
    """
    if not cubes:
        raise ValueError("nothing to align")
    cubes = tuple(_without_singletons(c, singletons) for c in cubes)
    if check:
        for i, c in enumerate(cubes):
            for d in c.dims:
                first = next(x for x in cubes if d in x.dims)
                if first is not c and not same_axis(first, c, d):
                    raise ValueError(f"{d} of input {i} differs")
    tables = [c.df.select(*c.dims, F.col(VALUE).alias(f"v{i}")) for i, c in enumerate(cubes)]

    def both(left: DataFrame, right: DataFrame) -> DataFrame:
        shared = [c for c in right.columns if c in left.columns]
        return left.join(right, shared) if shared else left.crossJoin(right)

    out = fold(both, tables)
    dims = list(dict.fromkeys(d for c in cubes for d in c.dims))
    return out.select(*dims, *(f"v{i}" for i in range(len(cubes))))


def _without_singletons(cube: Cube, names: tuple[str, ...]) -> Cube:
    for d in names:
        if d in cube.dims and cube.df.select(d).distinct().limit(2).count() == 1:
            cube = cube.squeeze(d)
    return cube


def combine(value: Column | str, *cubes: Cube, name: str = "value", **kw) -> Cube:
    """A cube of an expression over v0, v1, …"""
    out = align(*cubes, **kw)
    dims = tuple(c for c in out.columns if not (c.startswith("v") and c[1:].isdigit()))
    return Cube(out.select(*dims, (F.expr(value) if isinstance(value, str) else value).alias(VALUE)), dims, name)


def align_positions(a: Cube, b: Cube, dims: tuple[str, ...]) -> DataFrame:
    """Staggered grids: along ``dims`` points meet by position, not by coordinate; a's coordinates stay."""
    right = b.df.select(*b.dims, F.col(VALUE).alias("v1"))
    left = a.df.select(*a.dims, F.col(VALUE).alias("v0"))
    for d in dims:
        left = left.join(a.coordinates(d).withColumnRenamed("idx", f"__{d}"), d)
        right = right.join(b.coordinates(d).withColumnRenamed("idx", f"__{d}"), d).drop(d)
    on = [f"__{d}" if d in dims else d for d in a.dims if d in b.dims]
    return left.join(right, on).select(*a.dims, "v0", "v1")


def concat(cubes: dict[str, Cube], dim: str) -> Cube:
    """Cubes under a new dimension whose coordinates are the keys."""
    tables = [c.df.select(F.lit(k).alias(dim), *c.dims, VALUE) for k, c in cubes.items()]
    first = next(iter(cubes.values()))
    return Cube(fold(lambda x, y: x.unionByName(y), tables), (dim, *first.dims), first.name, first.attrs)


def factor_separation(f0: Cube, f1: Cube, f2: Cube, f12: Cube) -> DataFrame:
    """Four runs without, with either and with both factors: base, the pure part of each and their joint part."""
    out = align(f0, f1, f2, f12)
    dims = [c for c in out.columns if c not in ("v0", "v1", "v2", "v3")]
    return out.select(*dims, F.col("v0").alias("base"), F.expr("v1 - v0").alias("first"), F.expr("v2 - v0").alias("second"), F.expr("v3 - v1 - v2 + v0").alias("joint"))
