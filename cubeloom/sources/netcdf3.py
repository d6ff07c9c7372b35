"""NetCDF-3 files (classic and 64-bit offset): a reader as a Python data source, and a writer.

The header is parsed on the driver; partitions are ranges of records (or of the first dimension), each read by seeking.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..cube import VALUE, Cube

# Fixed values of the format: code -> numpy type, Spark type.
TYPES = {1: (">i1", "tinyint"), 2: ("S1", "string"), 3: (">i2", "smallint"), 4: (">i4", "int"), 5: (">f4", "float"), 6: (">f8", "double")}
CODES = {"tinyint": 1, "string": 2, "smallint": 3, "int": 4, "float": 5, "double": 6}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
FILL_FLOAT = 9.969209968386869e36


@dataclass
class Variable:
    name: str
    dims: tuple[str, ...]
    code: int
    begin: int
    attrs: dict = field(default_factory=dict)
    record: bool = False


@dataclass
class Header:
    version: int
    records: int
    dims: dict[str, int]
    attrs: dict
    variables: dict[str, Variable]
    record_size: int = 0

    def shape(self, v: Variable) -> tuple[int, ...]:
        return tuple(self.records if self.dims[d] == 0 else self.dims[d] for d in v.dims)


def _up(n: int) -> int:
    return -(-n // 4) * 4


class _Cursor:
    def __init__(self, data: bytes, version: int):
        self.data, self.at, self.offset = data, 8, ">i" if version == 1 else ">q"

    def take(self, form: str):
        out = struct.unpack_from(form, self.data, self.at)[0]
        self.at += struct.calcsize(form)
        return out

    def text(self) -> str:
        n = self.take(">i")
        out = self.data[self.at : self.at + n].decode()
        self.at += _up(n)
        return out

    def attributes(self) -> dict:
        tag, n = self.take(">i"), self.take(">i")
        if tag not in (0, ATTRIBUTE):
            raise ValueError("not an attribute list")
        out = {}
        for _ in range(n):
            name, code, count = self.text(), self.take(">i"), self.take(">i")
            kind = np.dtype(TYPES[code][0])
            raw = self.data[self.at : self.at + count * kind.itemsize]
            self.at += _up(len(raw))
            out[name] = raw.decode() if code == 2 else (x := np.frombuffer(raw, kind).tolist())[0] if count == 1 else x
        return out


def parse_header(data: bytes) -> Header:
    if data[:3] != b"CDF" or data[3] not in (1, 2):
        raise ValueError("not a NetCDF-3 file")
    c = _Cursor(data, data[3])
    records = struct.unpack_from(">i", data, 4)[0]
    tag, n = c.take(">i"), c.take(">i")
    if tag not in (0, DIMENSION):
        raise ValueError("not a dimension list")
    dims = {}
    for _ in range(n):
        name = c.text()
        dims[name] = c.take(">i")
    attrs = c.attributes()
    tag, n = c.take(">i"), c.take(">i")
    if tag not in (0, VARIABLE):
        raise ValueError("not a variable list")
    out = Header(data[3], max(records, 0), dims, attrs, {})
    names, sizes = list(dims), []
    for _ in range(n):
        name, rank = c.text(), c.take(">i")
        own = tuple(names[c.take(">i")] for _ in range(rank))
        own_attrs, code, size, begin = c.attributes(), c.take(">i"), c.take(">i"), c.take(c.offset)
        v = out.variables[name] = Variable(name, own, code, begin, own_attrs, bool(own) and dims[own[0]] == 0)
        if v.record:
            sizes.append((size, int(np.prod([dims[d] for d in own[1:]], dtype=np.int64)) * np.dtype(TYPES[code][0]).itemsize))
    out.record_size = sizes[0][1] if len(sizes) == 1 else sum(_up(b) for _, b in sizes)  # a single record variable isn't padded
    return out


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        n = 1 << 16
        while True:
            f.seek(0)
            data = f.read(n)
            try:
                return parse_header(data)
            except (struct.error, IndexError):
                if len(data) < n:
                    raise
                n *= 4


def read_values(path: str, header: Header, v: Variable, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Values of places [start, stop) of the first dimension."""
    kind = np.dtype(TYPES[v.code][0])
    shape = header.shape(v)
    stop = (shape[0] if shape else 1) if stop is None else stop
    inner = int(np.prod(shape[1:], dtype=np.int64))
    with open(path, "rb") as f:
        if v.record:
            parts = []
            for k in range(start, stop):
                f.seek(v.begin + k * header.record_size)
                parts.append(f.read(inner * kind.itemsize))
            raw = b"".join(parts)
        else:
            f.seek(v.begin + start * inner * kind.itemsize)
            raw = f.read((stop - start) * inner * kind.itemsize)
    return np.frombuffer(raw, kind).reshape((stop - start, *shape[1:]) if shape else ())


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class NetCDF3(DataSource):
    """spark.read.format("netcdf3").option("variable", ...).load(path): coordinates and value in long form. The path must be
    one that all executors can open."""

    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def schema(self) -> str:
        h = read_header(self.options["path"])
        v = h.variables[self.options["variable"]]
        kinds = {d: TYPES[h.variables[d].code][1] if d in h.variables else "int" for d in v.dims}
        return ", ".join([*(f"`{d}` {k}" for d, k in kinds.items()), f"value {TYPES[v.code][1]}"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["variable"], int(self.options.get("rows", 1_000_000)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, variable: str, rows: int):
        self.path, self.variable, self.rows = path, variable, rows

    def partitions(self):
        h = read_header(self.path)
        shape = h.shape(h.variables[self.variable])
        n = shape[0] if shape else 1
        step = max(1, self.rows // max(1, int(np.prod(shape[1:], dtype=np.int64))))
        return [_Range(a, min(a + step, n)) for a in range(0, n, step)]

    def read(self, partition):
        h = read_header(self.path)
        v = h.variables[self.variable]
        shape = h.shape(v)
        block = read_values(self.path, h, v, partition.start, partition.stop)
        cols, names = [], []
        for axis, d in enumerate(v.dims):
            a, b = (partition.start, partition.stop) if axis == 0 else (0, shape[axis])
            coord = read_values(self.path, h, h.variables[d], a, b) if d in h.variables else np.arange(a, b, dtype=np.int32)
            wide = np.broadcast_to(coord.reshape([-1 if k == axis else 1 for k in range(len(shape))]), block.shape)
            cols.append(pa.array(np.ascontiguousarray(wide.reshape(-1)).astype(wide.dtype.newbyteorder("="))))
            names.append(d)
        flat = block.reshape(-1)
        if v.code == 2:
            values = pa.array([x.decode("latin-1") for x in flat.tolist()])
        else:
            flat = flat.astype(flat.dtype.newbyteorder("="))
            fill = v.attrs.get("_FillValue", v.attrs.get("missing_value", FILL_FLOAT if v.code in (5, 6) else None))
            gone = np.isnan(flat) if v.code in (5, 6) else np.zeros(len(flat), bool)
            if fill is not None:
                gone = gone | (flat == np.array(fill).astype(flat.dtype))
            values = pa.array(flat, mask=gone)
        yield pa.RecordBatch.from_arrays([*cols, values], [*names, VALUE])


def read(spark, path: str, variable: str) -> Cube:
    spark.dataSource.register(NetCDF3)
    h = read_header(path)
    df = spark.read.format("netcdf3").option("variable", variable).load(path)
    return Cube(df, h.variables[variable].dims, variable, {k: v for k, v in h.variables[variable].attrs.items() if isinstance(v, (str, float))})


def encode(variables: dict[str, tuple[tuple[str, ...], np.ndarray, dict]], attrs: dict | None = None, record: str | None = None, version: int = 1) -> bytes:
    """A file of variables name -> (dims, values, attributes); ``record`` names the dimension that can grow."""
    text = lambda s: struct.pack(">i", len(s.encode())) + s.encode().ljust(_up(len(s.encode())), b"\0")
    dims: dict[str, int] = {}
    for own, values, _ in variables.values():
        for d, n in zip(own, values.shape, strict=True):
            if dims.setdefault(d, n) != n:
                raise ValueError(f"{d} has two lengths")

    def attributes(given: dict | None) -> bytes:
        if not given:
            return struct.pack(">ii", 0, 0)
        out = struct.pack(">ii", ATTRIBUTE, len(given))
        for k, v in given.items():
            if isinstance(v, str):
                out += text(k) + struct.pack(">i", 2) + text(v)
            else:
                raw = np.atleast_1d(v).astype(">f8" if np.asarray(v).dtype.kind == "f" else ">i4")
                out += text(k) + struct.pack(">ii", 6 if raw.dtype.kind == "f" else 4, len(raw)) + raw.tobytes().ljust(_up(raw.nbytes), b"\0")
        return out

    codes = {np.dtype(t).newbyteorder("=").str[1:]: c for c, (t, _) in TYPES.items()}
    order = list(dims)
    rows = []
    for name, (own, values, given) in variables.items():
        code = codes[np.dtype(values.dtype).newbyteorder("=").str[1:]]
        data = values.astype(np.dtype(TYPES[code][0]))
        is_record = bool(own) and own[0] == record
        size = data[:1].nbytes if is_record else data.nbytes
        rows.append((name, own, given, code, data, is_record, _up(size)))
    alone = sum(r[5] for r in rows) == 1

    def head(begins: list[int]) -> bytes:
        n = dims.get(record, 0) if record else 0
        out = b"CDF" + bytes([version]) + struct.pack(">i", n)
        out += struct.pack(">ii", DIMENSION if dims else 0, len(dims)) + b"".join(text(d) + struct.pack(">i", 0 if d == record else k) for d, k in dims.items())
        out += attributes(attrs) + struct.pack(">ii", VARIABLE if rows else 0, len(rows))
        for (name, own, given, code, _, _, size), begin in zip(rows, begins, strict=True):
            out += text(name) + struct.pack(">i", len(own)) + b"".join(struct.pack(">i", order.index(d)) for d in own) + attributes(given) + struct.pack(">ii", code, size) + struct.pack(">i" if version == 1 else ">q", begin)
        return out

    at = len(head([0] * len(rows)))
    begins = [0] * len(rows)
    for wanted in (False, True):
        for k, r in enumerate(rows):
            if r[5] == wanted:
                begins[k] = at
                at += r[6]
    out = [head(begins)]
    out += [r[4].tobytes().ljust(r[6], b"\0") for r in rows if not r[5]]
    for k in range(dims.get(record, 0) if record else 0):
        for r in rows:
            if r[5]:
                raw = r[4][k : k + 1].tobytes()
                out.append(raw if alone else raw.ljust(r[6], b"\0"))
    return b"".join(out)


def write(cube: Cube, path: str, attrs: dict | None = None, record: str | None = None, version: int = 1, limit: int = 50_000_000) -> None:
    """One file from a cube of at most ``limit`` points: a NetCDF-3 file is one stream, written by the driver. Missing
    values take the format's fill value."""
    frame = cube.df.select(*cube.dims, VALUE).limit(limit + 1).toPandas()
    if len(frame) > limit:
        raise ValueError(f"more than {limit} points; write Parquet instead")
    axes = [np.sort(frame[d].unique()) for d in cube.dims]
    values = np.full([len(a) for a in axes], FILL_FLOAT, np.float32)
    values[tuple(np.searchsorted(a, frame[d]) for a, d in zip(axes, cube.dims, strict=True))] = frame[VALUE].fillna(FILL_FLOAT).astype(np.float32)
    small = lambda a: a.astype(np.int32) if a.dtype.kind == "i" else a.astype(np.float64)
    variables = {d: ((d,), small(a), {}) for d, a in zip(cube.dims, axes, strict=True)}
    variables[cube.name] = (tuple(cube.dims), values, {k: v for k, v in cube.attrs.items() if isinstance(v, (str, float))} | {"_FillValue": FILL_FLOAT})
    with open(path, "wb") as f:
        f.write(encode(variables, attrs, record, version))
