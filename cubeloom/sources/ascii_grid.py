"""ESRI ASCII grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cube import VALUE, Cube
from ..operators.window import regular


def lines(cube: Cube, lat: str = "latitude", lon: str = "longitude", form: str = "%.6g", nodata: float = -9999.0) -> DataFrame:
    """(n, value): the header and the rows of a file, north first. The corner is half a cell off the first coordinate.
    Raises if ``nodata`` is among the values, or the cells aren't square."""
    if set(cube.dims) != {lat, lon}:
        raise ValueError("an ASCII grid has two dimensions")
    a, b = regular(cube, lat).first(), regular(cube, lon).first()
    if not (a["regular"] and b["regular"]) or abs((a["step"] or 0) - (b["step"] or 0)) > 1e-9:
        raise ValueError("an ASCII grid needs square cells")
    if not cube.df.where(F.col(VALUE) == nodata).isEmpty():
        raise ValueError(f"{nodata} is among the values")
    cell = a["step"]
    rows, columns = (round((x["last"] - x["first"]) / cell) + 1 for x in (a, b))
    head = [f"ncols {columns}", f"nrows {rows}", f"xllcorner {b['first'] - cell / 2}", f"yllcorner {a['first'] - cell / 2}", f"cellsize {cell}", f"NODATA_value {nodata:g}"]
    spark = cube.df.sparkSession
    text = F.coalesce(F.format_string(form, VALUE), F.lit(f"{nodata:g}"))
    body = cube.df.groupBy(lat).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(lon), text.alias("t")))), lambda x: x.t), " ").alias("value"))
    numbered = body.select((F.round((F.lit(a["last"]) - F.col(lat)) / cell) + len(head)).cast("int").alias("n"), "value")
    return spark.createDataFrame(list(enumerate(head)), "n int, value string").unionByName(numbered)


def write(cube: Cube, path: str, **kw) -> None:
    """One text file in a folder; a grid for one file is small."""
    lines(cube, **kw).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
