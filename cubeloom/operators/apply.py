"""Functions along named dimensions: an expression where one will do, else pandas by group."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cube import VALUE, Cube
from .align import align
from .reduce import reduce


def apply(cube: Cube | Sequence[Cube], fn: str | Column | Callable, core: Sequence[str] = (), output: Mapping[str, str] | None = None, outputs: Sequence[str] | None = None, args: tuple = (), kwargs: Mapping | None = None, aggregate: bool = False, attrs: Mapping | None = None):
    """``fn`` over the core dimensions, for each point of the others.

    A SQL string or Column is an expression of value (or v0, v1, … of several cubes), with ``aggregate`` over the core
    dimensions. A callable gets a pandas frame per point of the loop dimensions, its rows sorted by the core
    dimensions, and returns a frame of the output dimensions and ``value`` (or the columns ``outputs``); dimensions it
    makes anew or replaces are declared in ``output`` as name -> type. Several outputs come as a dict of cubes. A group is
    one point of the loop dimensions and must fit a task.
    """
    cubes = [cube] if isinstance(cube, Cube) else list(cube)
    first = cubes[0]
    table = first.df if len(cubes) == 1 else align(*cubes)
    dims = list(dict.fromkeys(d for c in cubes for d in c.dims))
    loop = [d for d in dims if d not in core]
    made = {**first.attrs, **(attrs or {})}
    if not callable(fn) or isinstance(fn, Column):
        value = F.expr(fn) if isinstance(fn, str) else fn
        if aggregate:
            return reduce(Cube(table.withColumn(VALUE, F.lit(0)), dims), list(core), value) if len(cubes) > 1 else reduce(first, list(core), value)
        return Cube(table.select(*dims, value.alias(VALUE)), dims, first.name, made)
    types = dict(table.dtypes)
    out_dims = {d: types[d] for d in core} if output is None else dict(output)
    names = list(outputs or [VALUE])
    schema = ", ".join(f"`{c}` {t}" for c, t in ({d: types[d] for d in loop} | out_dims | {n: "double" for n in names}).items())
    order = [d for d in core if d in table.columns]
    rest = dict(kwargs or {})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        got = fn(frame.sort_values(order) if order else frame, *args, **rest)
        if missing := [n for n in names if n not in got.columns]:
            raise ValueError(f"the function returned no {missing}")
        for d in loop:
            got[d] = frame[d].iloc[0]
        return got[[*loop, *out_dims, *names]]

    got = table.groupBy(*loop).applyInPandas(run, schema)
    cubes_out = {n: Cube(got.select(*loop, *out_dims, F.col(n).cast("double").alias(VALUE)), [*loop, *out_dims], n, made) for n in names}
    return cubes_out if outputs else cubes_out[VALUE]


def apply_vectorised(cube: Cube, fn: Callable[[np.ndarray], np.ndarray], core: str, output: tuple[str, str, Sequence] | None = None, reduces: bool = False) -> Cube:
    """``fn`` along one dimension for many loop points by one call: it gets an array (points, length of the axis), its rows
    sorted along the axis and missing values NaN, and returns the same shape, one number for each point (``reduces``), or
    (points, length of a new axis) with ``output`` = (name, type, coordinates). A call holds the points of an Arrow batch
    whose axes have the same length; a single point's axis must fit a task."""
    loop, types = cube.others(core), dict(cube.df.dtypes)
    if not loop:
        raise ValueError("no loop dimension: call the function by itself")
    out = {d: types[d] for d in loop} | ({} if reduces else {output[0]: output[1]} if output else {core: types[core]}) | {VALUE: "double"}

    def made(frame: pd.DataFrame):
        starts = np.flatnonzero(np.append(True, frame["__p"].to_numpy()[1:] != frame["__p"].to_numpy()[:-1]))
        sizes = np.diff(np.append(starts, len(frame)))
        values = frame[VALUE].to_numpy(np.float64, na_value=np.nan)
        for n in np.unique(sizes):
            first = starts[sizes == n]
            rows = (first[:, None] + np.arange(n)).ravel()
            got = np.asarray(fn(values[rows].reshape(-1, n)), np.float64)
            want = (len(first),) if reduces else (len(first), len(output[2]) if output else n)
            if got.shape != want:
                raise ValueError(f"the function returned the shape {got.shape}, not {want}")
            if not reduces and not output:
                part = frame.iloc[rows][[*loop, core]].copy()
            else:
                part = frame.iloc[np.repeat(first, 1 if reduces else want[1])][loop].copy()
                if output:
                    part[output[0]] = list(output[2]) * len(first)
            part[VALUE] = got.ravel()
            yield part[list(out)]

    def run(frames):
        held, before, point = None, None, 0
        for frame in frames:
            if not len(frame):
                continue
            keys = frame[loop].astype(object).where(frame[loop].notna(), None)
            at = keys.ne(keys.shift()).to_numpy() & ~(keys.isna() & keys.shift().isna()).to_numpy()
            new = at.any(axis=1)
            new[0] = before is not None and tuple(keys.iloc[0]) != before
            frame = frame.assign(__p=point + np.cumsum(new))
            before, point = tuple(keys.iloc[-1]), int(frame["__p"].iloc[-1])
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            whole = held["__p"] < point  # the last point may go on in the next batch
            if whole.any():
                yield from made(held[whole].reset_index(drop=True))
                held = held[~whole].reset_index(drop=True)
        if held is not None:
            yield from made(held)

    rows = cube.df.select(*loop, core, F.col(VALUE).cast("double").alias(VALUE)).repartition(*loop).sortWithinPartitions(*loop, core)
    got = rows.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in out.items()))
    dims = [c for c in out if c != VALUE]
    return Cube(got.withColumn(VALUE, F.nanvl(VALUE, F.lit(None))), dims, cube.name, cube.attrs)


def cogroup_apply(a: Cube, b: Cube, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], loop: Sequence[str], schema: str, dims: Sequence[str]) -> Cube:
    """Two cubes that share only the loop dimensions, whole in a function."""
    return Cube(a.df.groupBy(*loop).cogroup(b.df.groupBy(*loop)).applyInPandas(fn, schema), dims)


def derived_attrs(rules: Mapping[str, object], inputs: Sequence[Mapping[str, str]]) -> dict:
    """Output attributes: constants, or functions of what the inputs have under that name."""
    return {k: v(*(x.get(k) for x in inputs)) if callable(v) else v for k, v in rules.items()}
