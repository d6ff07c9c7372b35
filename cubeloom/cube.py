"""A cube: one named variable in long form, a column for each dimension and one for the value."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VALUE = "value"


@dataclass(frozen=True)
class Cube:
    """``df`` has the columns ``dims`` and ``value``, at most one row for each point. Missing values are NULL (NaN becomes
    NULL on reading). Other columns are auxiliary coordinates and are carried along."""

    df: DataFrame
    dims: tuple[str, ...]
    name: str = "value"
    attrs: Mapping[str, str | float] = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "dims", tuple(self.dims))
        if missing := [c for c in (*self.dims, VALUE) if c not in self.df.columns]:
            raise ValueError(f"the table has no column {missing}")

    # --- making and storing -------------------------------------------------------------------------------

    @staticmethod
    def of(df: DataFrame, dims: Iterable[str], value: str | Column = VALUE, name: str = "value", **attrs) -> Cube:
        """Dimensions and a value expression of any table; NaN becomes NULL for floating values."""
        dims = tuple(dims)
        out = df.select(*dims, (F.col(value) if isinstance(value, str) else value).alias(VALUE))
        if dict(out.dtypes)[VALUE] in ("double", "float"):
            out = out.withColumn(VALUE, F.nanvl(VALUE, F.lit(None)))
        return Cube(out, dims, name, attrs)

    @staticmethod
    def of_array(spark: SparkSession, values: Iterable, dim: str, name: str = "value") -> Cube:
        """A coordinate from a list: the dimension counts from 0."""
        kind = "string" if (values := list(values)) and isinstance(values[0], str) else "double"
        return Cube(spark.createDataFrame([(i, v if kind == "string" else float(v)) for i, v in enumerate(values)], f"`{dim}` int, value {kind}"), (dim,), name)

    def like(self, value=0.0, name: str | None = None, **attrs) -> Cube:
        """Same points, one constant value."""
        return replace(self, df=self.df.withColumn(VALUE, F.lit(value)), name=name or self.name, attrs={**self.attrs, **attrs})

    def with_attrs(self, **attrs) -> Cube:
        return replace(self, attrs={**self.attrs, **attrs})

    # --- selecting ----------------------------------------------------------------------------------------

    def where(self, condition: str | Column) -> Cube:
        return replace(self, df=self.df.where(condition))

    def between(self, **ranges: tuple) -> Cube:
        """Coordinate ranges, ends included; they reach the Parquet scan."""
        out = self
        for dim, (low, high) in ranges.items():
            self._known(dim)
            out = out.where(F.col(dim).between(low, high))
        return out

    def isin(self, **members: Iterable) -> Cube:
        out = self
        for dim, values in members.items():
            self._known(dim)
            out = out.where(F.col(dim).isin(list(values)))
        return out

    def isel(self, **slices: slice | int | Iterable[int]) -> Cube:
        """By position along dimensions. A dimension of length one is never cut away (it broadcasts)."""
        out = self
        for dim, want in slices.items():
            self._known(dim)
            coords = self.coordinates(dim)
            n = coords.count()
            if n <= 1:
                continue
            if isinstance(want, slice):
                start, stop, step = want.indices(n)
                keep = coords.where((F.col("idx") >= start) & (F.col("idx") < stop) & ((F.col("idx") - start) % step == 0))
            else:
                keep = coords.where(F.col("idx").isin([want] if isinstance(want, int) else list(want)))
            out = replace(out, df=out.df.join(keep.select(dim), dim, "left_semi").select(*self.df.columns))
        return out

    def rename(self, **names: str) -> Cube:
        df = self.df
        for old, new in names.items():
            df = df.withColumnRenamed(old, new)
        return replace(self, df=df, dims=tuple(names.get(d, d) for d in self.dims))

    def rename_first(self, alternatives: Mapping[str, Iterable[str]]) -> Cube:
        """For each standard name the first alternative that is a dimension is renamed to it."""
        return self.rename(**{next(x for x in some if x in self.dims): to for to, some in alternatives.items() if to not in self.dims and any(x in self.dims for x in some)})

    def transpose(self, *order: str) -> Cube:
        """Column order; dimensions that aren't named keep their places among the others."""
        from .functions.labels import order_keys

        dims = tuple(order_keys(self.dims, order))
        return replace(self, df=self.df.select(*dims, *(c for c in self.df.columns if c not in dims)), dims=dims)

    def squeeze(self, *dims: str) -> Cube:
        """Without dimensions of length one."""
        for d in dims:
            if self.df.select(d).distinct().limit(2).count() > 1:
                raise ValueError(f"{d} is longer than one")
        return replace(self, df=self.df.drop(*dims), dims=tuple(d for d in self.dims if d not in dims))

    def with_value(self, value: Column | str) -> Cube:
        return replace(self, df=self.df.withColumn(VALUE, F.expr(value) if isinstance(value, str) else value))

    def reclass(self, members: Iterable) -> Cube:
        """1 where the value is one of ``members``, else 0; NULL stays NULL."""
        return self.with_value(F.col(VALUE).isin(list(members)).cast("int"))

    def transform(self, fn: Callable[[DataFrame], DataFrame]) -> Cube:
        """A hook over the table; the dimensions must stay."""
        return replace(self, df=fn(self.df))

    # --- coordinates --------------------------------------------------------------------------------------

    def coordinates(self, dim: str) -> DataFrame:
        """(dim, idx): the distinct coordinates in ascending order. An axis is small beside its cube; the window that
        numbers it runs over distinct values only."""
        from pyspark.sql import Window

        self._known(dim)
        return self.df.select(dim).distinct().withColumn("idx", F.row_number().over(Window.orderBy(dim)) - 1)

    def indexed(self, dim: str) -> Cube:
        """With a column ``<dim>_idx``, the position on the axis."""
        return replace(self, df=self.df.join(self.coordinates(dim).withColumnRenamed("idx", f"{dim}_idx"), dim))

    def others(self, *dims: str) -> list[str]:
        for d in dims:
            self._known(d)
        return [d for d in self.dims if d not in dims]

    def _known(self, dim: str) -> None:
        if dim not in self.dims:
            raise ValueError(f"{self.name} has no dimension {dim}: {self.dims}")
