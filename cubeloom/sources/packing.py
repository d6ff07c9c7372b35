"""Linear packing of values into small integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cube import VALUE, Cube

#: Physical ranges by (variable, unit). Fixed values of this package; unknown pairs are an error.
RANGES = {("temperature", "K"): (150.0, 350.0), ("temperature", "degC"): (-120.0, 80.0), ("precipitation", "mm"): (0.0, 2000.0), ("fraction", "1"): (0.0, 1.0), ("events", "1"): (0.0, 1000.0)}
ATTRIBUTES = ("add_offset", "scale_factor", "bits")
KINDS = {8: "smallint", 16: "int"}  # unsigned numbers of 8 or 16 bits


def pack(v: Column, low: float, high: float, bits: int = 16) -> Column:
    return F.round((v - F.lit(low)) / F.lit(high - low) * F.lit(float(2**bits - 1))).cast(KINDS[bits])


def unpack(v: Column, low: float, high: float, bits: int = 16) -> Column:
    return F.lit(low) + v / F.lit(float(2**bits - 1)) * F.lit(high - low)


def pack_cube(cube: Cube, bits: int = 16, limits: tuple[float, float] | None = None) -> Cube:
    """Values as integers; how to get them back is in the attributes. Values beyond the range become missing."""
    if limits is None:
        key = (cube.name, cube.attrs.get("units", "1"))
        if key not in RANGES:
            raise ValueError(f"no range for {key}")
        limits = RANGES[key]
    low, high = limits
    kept = F.when(F.col(VALUE).between(low, high), F.col(VALUE))
    return cube.with_value(pack(kept, low, high, bits)).with_attrs(add_offset=low, scale_factor=(high - low) / (2**bits - 1), bits=str(bits))


def unpack_cube(cube: Cube) -> Cube:
    return cube.with_value(F.col(VALUE) * F.lit(float(cube.attrs["scale_factor"])) + F.lit(float(cube.attrs["add_offset"])))


def write_packed(cube: Cube, path: str, compress: bool = True, **kw) -> DataFrame:
    pack_cube(cube, **kw).df.write.option("compression", "zstd" if compress else "none").parquet(path)
    return cube.df.sparkSession.read.parquet(path)
