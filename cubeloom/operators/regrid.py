"""Latitude-longitude grids: wrap-around, crops, interpolation to other grids."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cube import VALUE, Cube
from .window import regular


def extend_longitude(cube: Cube, dim: str = "longitude", west: float = 170.0, east: float = 10.0, turn: float = 360.0) -> Cube:
    """Columns from ``west`` on appear again a turn before, columns below ``east`` a turn after. ``source`` has the
    coordinate that a row comes from. One pass."""
    x = F.col(dim)
    copies = F.array_compact(F.array(F.when(x >= west, x - turn), x, F.when(x < east, x + turn)))
    return replace(cube, df=cube.df.withColumn("source", x).withColumn(dim, F.explode(copies)))


def spacing(cube: Cube, dim: str) -> float:
    return regular(cube, dim).first()["median_step"]


def crop_border(cube: Cube, dims: dict[str, tuple[float, float]], border: int = 5, tolerance: float = 1e-9) -> Cube:
    """Cells within each target extent widened by ``border`` median steps: literal bounds, so they reach the scan."""
    for d, (low, high) in dims.items():
        wide = border * spacing(cube, d) + tolerance
        cube = cube.between(**{d: (low - wide, high + wide)})
    return cube


def clip_target(target: DataFrame, cube: Cube, dims: dict[str, float]) -> DataFrame:
    """Target points inside the input's extent widened by half a cell. dims: name -> input step."""
    for d, step in dims.items():
        low, high = cube.df.agg(F.min(d), F.max(d)).first()
        target = target.where(F.col(d).between(low - step / 2, high + step / 2))
    return target


def same_grid(a: Cube, b: DataFrame, dim: str) -> bool:
    """Same length, and no coordinate further off than a tenth of the step."""
    x, y = a.coordinates(dim), Cube(b.withColumn(VALUE, F.lit(0)), (dim,)).coordinates(dim).withColumnRenamed(dim, "other")
    got = x.join(y, "idx", "full").agg(F.max(F.abs(F.col(dim) - F.col("other"))).alias("far"), F.count(F.when(F.col(dim).isNull() | F.col("other").isNull(), 1)).alias("odd")).first()
    return got["odd"] == 0 and (got["far"] is None or got["far"] <= spacing(a, dim) / 10)


def ascending(cube: Cube, *dims: str) -> Cube:
    return replace(cube, df=cube.df.orderBy(*dims))


def interpolate(cube: Cube, target: DataFrame, lat: str = "latitude", lon: str = "longitude", method: str = "triangle", grid: tuple[float, float, float, float] | None = None) -> Cube:
    """Values of a regular grid at the points of ``target`` (columns lat, lon). The cell of a point is arithmetic, its four
    corners come by one equi-join on the cell. triangle: each cell is parted along its south-west to north-east
    diagonal and linear on either side; bilinear: the product. Outside the grid, or with a corner missing: missing.
    grid: lat0, dlat, lon0, dlon, read from the cube if unset."""
    if method not in ("triangle", "bilinear"):
        raise NotImplementedError(f"{method}: only regular grids, by triangle or bilinear")
    if grid is None:
        a, b = regular(cube, lat).first(), regular(cube, lon).first()
        if not (a["regular"] and b["regular"]):
            raise NotImplementedError("irregular grids")
        grid = (a["first"], a["step"], b["first"], b["step"])
    lat0, dlat, lon0, dlon = grid
    rest = cube.others(lat, lon)
    ij = cube.df.select(*rest, F.round((F.col(lat) - lat0) / dlat).cast("int").alias("i"), F.round((F.col(lon) - lon0) / dlon).cast("int").alias("j"), VALUE)
    # each value serves the four cells it is a corner of
    corner = F.explode(F.array(*(F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), F.lit(2 * a + b).alias("c")) for a in (0, 1) for b in (0, 1))))
    cells = ij.withColumn("k", corner).groupBy(*rest, F.col("k.i").alias("i"), F.col("k.j").alias("j")).agg(*(F.max(F.when(F.col("k.c") == c, F.col(VALUE))).alias(f"v{c}") for c in range(4)))
    y, x = (F.col(lat) - lat0) / dlat, (F.col(lon) - lon0) / dlon
    last = cube.df.agg(F.max(F.round((F.col(lat) - lat0) / dlat)), F.max(F.round((F.col(lon) - lon0) / dlon))).first()
    cell = lambda u, n: F.when(u == n, n - 1).otherwise(F.floor(u)).cast("int")  # noqa: E731  the last line belongs to the last cell
    asked = target.withColumn("i", cell(y, int(last[0]))).withColumn("j", cell(x, int(last[1])))
    p, q = y - F.col("i"), x - F.col("j")
    v = [F.col(f"v{c}") for c in range(4)]  # south-west, south-east, north-west, north-east
    if method == "bilinear":
        value = v[0] * (1 - p) * (1 - q) + v[1] * (1 - p) * q + v[2] * p * (1 - q) + v[3] * p * q
    else:
        value = F.when(q >= p, v[0] + (v[1] - v[0]) * q + (v[3] - v[1]) * p).otherwise(v[0] + (v[2] - v[0]) * p + (v[3] - v[2]) * q)
    whole = F.when(v[0].isNotNull() & v[1].isNotNull() & v[2].isNotNull() & v[3].isNotNull(), value)
    if rest:  # every target point at every loop point, as the result has it; outside the grid the value is missing
        asked = asked.crossJoin(cube.df.select(*rest).distinct())
    out = asked.join(cells, [*rest, "i", "j"], "left").select(*rest, lat, lon, whole.alias(VALUE))
    return Cube(out, (*rest, lat, lon), cube.name, cube.attrs)


def regrid(cube: Cube, target: DataFrame, lat: str = "latitude", lon: str = "longitude", method: str = "triangle", border: int = 5, crop_target: bool = True, wrap: bool = True, interpolation: bool = True, strict: bool = False, tolerance: float = 1e-9) -> Cube:
    """Wrap around, crop to the target with a border, clip the target to the input, and interpolate unless the grids agree.
    Without ``interpolation`` the cropped input. ``strict`` makes a target that the input doesn't cover whole a ValueError;
    else the result's own coordinates tell which points it has. ``tolerance`` widens the crop."""
    if wrap:
        cube = replace(cube, df=extend_longitude(cube, lon).df.drop("source"))
    low = target.agg(F.min(lat), F.max(lat), F.min(lon), F.max(lon)).first()
    cube = crop_border(cube, {lat: (low[0], low[1]), lon: (low[2], low[3])}, border, tolerance)
    if not interpolation:
        if strict and not (same_grid(cube, target, lat) and same_grid(cube, target, lon)):
            raise ValueError("the cropped input has another grid than the target")
        return cube
    if crop_target:
        asked = target
        target = clip_target(target, cube, {lat: spacing(cube, lat), lon: spacing(cube, lon)})
        if strict and target.count() != asked.count():
            raise ValueError("the input does not cover the target")
    if same_grid(cube, target, lat) and same_grid(cube, target, lon):
        return cube
    return interpolate(cube, target, lat, lon, method)
