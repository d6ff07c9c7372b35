"""The catalogue: one row for each stored cube, and the planning of group-wise work over it.

A catalogue is a folder of versions, each a Parquet table, and a pointer file with the current one; a version that
is being read is never overwritten. Fixed columns and a map of further attributes.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce as fold

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import VALUE, Cube
from ..functions.labels import auto_label, evaluated, pattern_name, request_table, space_label, time_label
from ..sources import packing

KEYS = ["variable", "source", "time", "space"]
SCHEMA = "variable string, source string, time string, space string, path string, available boolean, linked boolean, dims array<string>, attrs map<string,string>"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
PATTERN = '"variable"_"source"_"time"_"space"'
#: Attributes that outputs never inherit.
RESERVED = ("path", "path_catalog", "available", "linked")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same key."""
    return old.join(new, list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def alike(table: DataFrame, other: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``table`` whose key ``other`` has."""
    keys = other.select(*(F.col(k).alias(f"__{k}") for k in KEYS))
    return table.join(keys, fold(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEYS)), how)


def unlike(table: DataFrame, other: DataFrame) -> DataFrame:
    return alike(table, other, "left_anti")


def matching(table: DataFrame, **wanted: str | Sequence[str]) -> DataFrame:
    """Rows whose columns, or else attributes, are among the wanted values; text is split at commas."""
    for key, values in wanted.items():
        values = values.split(",") if isinstance(values, str) else list(values)
        if key in table.columns:
            table = table.where(F.col(key).isin(values))
        elif "attrs" in table.columns:
            table = table.where(F.col("attrs")[key].isin(values))
    return table


def queried(table: DataFrame, query: str | Column | Callable | DataFrame | None) -> DataFrame:
    """By an expression, a function of the table, or a table of keys."""
    if query is None:
        return table
    if isinstance(query, DataFrame):
        return table.join(query, [c for c in query.columns if c in table.columns], "left_semi")
    if callable(query) and not isinstance(query, Column):
        return query(table)
    return table.where(query)


def expand_wildcards(requests: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A null in a request stands for each distinct value the table has."""
    for k in keys:
        values = table.select(F.col(k).alias("__any")).distinct()
        fixed = requests.where(F.col(k).isNotNull())
        free = requests.where(F.col(k).isNull()).drop(k).crossJoin(values).withColumnRenamed("__any", k)  # distinct labels of one key
        requests = fixed.unionByName(free)
    return requests


def complete_groups(table: DataFrame, requests: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows of groups that have every requested combination, with the request's place ``req``: relational division."""
    on = [c for c in requests.columns if c != "req"]
    asked = table.join(requests, on)
    whole = asked.groupBy(*group).agg(F.countDistinct("req").alias("n")).join(requests.agg(F.countDistinct("req").alias("n")), "n").select(*group)
    return asked.join(whole, list(group), "left_semi")


def skip_existing(plan: DataFrame, done: DataFrame, keys: Sequence[str] = KEYS, group: Sequence[str] | None = None) -> DataFrame:
    """Plan rows that are still to be made. With ``group``, a group goes only if all its outputs exist."""
    todo = plan.join(done.select(*keys).distinct(), list(keys), "left_anti")
    return plan.join(todo.select(*group).distinct(), list(group), "left_semi") if group else todo


def inherited(own: Column, parent: Column, which: bool | Sequence[str]) -> Column:
    """Attributes of an output: its own over those of its input: none, all but RESERVED, or those listed."""
    if which is False:
        return own
    take = (lambda k, _: ~k.isin(*RESERVED)) if which is True else (lambda k, _: k.isin(*which))
    return F.map_concat(F.map_filter(parent, lambda k, v: take(k, v) & ~F.map_contains_key(own, k)), own)


def inherit(outputs: DataFrame, inputs: DataFrame, group: Sequence[str], which: bool | Sequence[str] = True) -> DataFrame:
    """Outputs (group..., place, attrs) take attributes of the input at the same place of the group, or at its last."""
    sizes = inputs.groupBy(*group).agg(F.max("place").alias("__last"))
    given = inputs.select(*group, F.col("place").alias("__place"), F.col("attrs").alias("__attrs"))
    own = outputs.join(sizes, list(group)).withColumn("__place", F.least("place", "__last"))
    return own.join(given, [*group, "__place"], "left").withColumn("attrs", inherited(F.col("attrs"), F.coalesce("__attrs", F.create_map().cast("map<string,string>")), which)).drop("__place", "__last", "__attrs")


def rebased(ours: DataFrame, base: DataFrame, now: DataFrame) -> DataFrame:
    """``now`` with what ``ours`` has changed since ``base``: its new and changed rows, without the rows it has removed."""
    old = base.select(*(F.col(k).alias(f"__{k}") for k in KEYS), print_of(base).alias("__old"))
    same = fold(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEYS)) & (print_of(ours) == F.col("__old"))
    changed = ours.join(old, same, "left_anti")
    removed = unlike(base, ours)
    return unlike(unlike(now, removed), changed).unionByName(changed)


def print_of(table: DataFrame) -> Column:
    return F.to_json(F.struct(*(table[c] for c in COLUMNS)))


@dataclass
class Catalog:
    """Tables of cubes below ``root``; ``root`` None is a catalogue in memory. A catalogue opened with a query shows some rows
    only; the stored rows that it does not show are kept when it is saved.

    Writers take a lock beside the catalogue. What another writer has stored since this one was opened is kept: only
    rows changed or removed here are changed or removed there."""

    spark: SparkSession
    root: str | None = None
    table: DataFrame | None = None
    pattern: str = PATTERN
    hidden: DataFrame | None = None  # stored rows that the query has left out
    version: str | None = None  # the stored version that this one started from
    shown: tuple = (None, {})  # the query and the wanted values it was opened with
    holding: bool = field(default=False, repr=False)

    def __post_init__(self):
        if self.table is None:
            self.table = self.spark.createDataFrame([], SCHEMA)

    # --- storage -------------------------------------------------------------------------------------------

    @classmethod
    def open(cls, spark: SparkSession, root: str, reset: bool = False, query: str | None = None, **wanted) -> Catalog:
        at = _pointer(spark, root) or {}
        out = cls(spark, root, None, at.get("pattern", PATTERN), version=at.get("version"), shown=(query, wanted))
        return out if reset else out.refresh()

    def refresh(self) -> Catalog:
        """The newest stored version, under the query that this catalogue was opened with. Unsaved changes go."""
        self.version = (_pointer(self.spark, self.root) or {}).get("version")
        here = self._stored(self.version)
        query, wanted = self.shown
        self.table, self.hidden = here, None
        if query is not None or wanted:
            self.table = matching(queried(here, query), **wanted)
            self.hidden = unlike(here, self.table)
        return self

    def _stored(self, version: str | None) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMA) if version is None else self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{version}")

    @contextmanager
    def alone(self, wait: float = 60.0):
        """No other writer of this catalogue for as long as the block lasts."""
        if self.root is None or self.holding:
            yield self
            return
        with file_lock(self.spark, f"{self.root}/catalog.lock", wait):
            self.holding = True
            try:
                yield self
            finally:
                self.holding = False

    def save(self) -> Catalog:
        """A new version, then the pointer; readers of the old version are not disturbed."""
        if self.root is not None:
            with self.alone():
                version = f"catalog-{uuid.uuid4().hex}"
                # a row that is added here replaces a hidden one with the same key
                whole = self.table if self.hidden is None else unlike(self.hidden, self.table).unionByName(self.table)
                now = (_pointer(self.spark, self.root) or {}).get("version")
                if now != self.version:
                    whole = rebased(whole, self._stored(self.version), self._stored(now))
                whole.select(*COLUMNS).orderBy(*KEYS).write.parquet(f"{self.root}/{version}")
                _write_text(self.spark, f"{self.root}/current.json", json.dumps({"version": version, "pattern": self.pattern}))
                stored = self._stored(version)
                if self.hidden is None:
                    self.table = stored
                else:
                    self.table, self.hidden = alike(stored, self.table), unlike(stored, self.table)
                self.version = version
        return self

    def rows(self) -> DataFrame:
        """The rows in the order of their keys."""
        return self.table.orderBy(*KEYS)

    def full_paths(self) -> DataFrame:
        return self.table.withColumn("path_full", F.when(F.col("linked") | F.lit(self.root is None), F.col("path")).otherwise(F.concat_ws("/", F.lit(self.root), "path")))

    # --- rows ----------------------------------------------------------------------------------------------

    def describe(self, cube: Cube, axis: str | None = "time", space_id: str = "", time_id: str = "", **keys: str) -> dict:
        """The row of a cube: its key from arguments, then attributes, then the cube itself."""
        have = {**{k: str(v) for k, v in cube.attrs.items() if isinstance(v, (str, float)) and v != ""}, **keys}
        have.setdefault("variable", cube.name)
        if "time" not in have:
            have["time"] = time_label(cube.df, axis, prefix=time_id).first()[0] if axis in cube.dims else "none"
        if "space" not in have:
            have["space"] = space_label(cube.df, [d for d in cube.dims if d != axis], space_id)
        if missing := [k for k in KEYS if k not in have]:
            raise ValueError(f"the cube's {missing[0]} is not known")
        return have

    def add(self, cube: Cube | str, method: str = "add", partition_by: Sequence[str] = (), dims: Sequence[str] | None = None, save: bool = True, bits: int | None = None, **keys: str) -> Catalog:
        """Registers a cube. add: written below the root; link: a stored table stays where it is; copy: a stored table is
        written below the root, an existing key is refused unless copy_force_overwrite. ``bits`` packs what is written."""
        if method not in ("add", "link", "copy", "copy_force_overwrite"):
            raise ValueError(f"no such method: {method}")
        stored = cube if isinstance(cube, str) else None
        if stored is not None:
            cube = Cube(self.spark.read.parquet(stored), dims or [c for c in self.spark.read.parquet(stored).columns if c != VALUE])
        cube = cube.rename(**{a: b for a, b in (("lat", "latitude"), ("lon", "longitude")) if a in cube.dims})
        have = self.describe(cube, **keys)
        key = {k: have[k] for k in KEYS}
        if method == "copy" and not self.table.where(_is(key)).isEmpty():
            raise ValueError(f"already there: {key}")
        if bits and method == "link":
            raise ValueError("a linked table is not written, so it can't be packed")
        if bits:
            cube = packing.pack_cube(cube, bits)
            have |= {k: str(cube.attrs[k]) for k in packing.ATTRIBUTES}
        if method == "link":
            path = stored
        else:
            path = self._new_path(have)
            write = cube.df.write.mode("errorifexists")
            (write.partitionBy(*partition_by) if partition_by else write).parquet(path if self.root is None else f"{self.root}/{path}")
        row = (*(key[k] for k in KEYS), path, True, method == "link", list(cube.dims), {k: v for k, v in have.items() if k not in KEYS})
        self.table = upsert(self.table, self.spark.createDataFrame([row], SCHEMA))
        return self.save() if save else self

    def add_variables(self, df: DataFrame, dims: Sequence[str], variables: Sequence[str] | None = None, **keys: str) -> Catalog:
        """A wide table as one cube for each variable."""
        for v in variables or [c for c in df.columns if c not in dims]:
            self.add(Cube.of(df, dims, v, v), variable=v, **keys)
        return self

    def discover(self, paths: DataFrame, parse: Callable[[str], Mapping[str, str]]) -> Catalog:
        """Adds stored tables (column path) that no row points at; ``parse`` gives their keys."""
        for (path,) in paths.select("path").distinct().join(self.full_paths().select(F.col("path_full").alias("path")), "path", "left_anti").collect():
            self.add(path, "link", save=False, **parse(path))
        return self.save()

    def discover_below(self, root: str, pattern: str | None = None, **fixed: str) -> Catalog:
        """Adds the tables below ``root`` whose names follow ``pattern`` (the catalogue's own if unset); names give the keys."""
        pattern = pattern or self.pattern
        parts = re.split(r'"([^"]*)"', pattern)
        name = re.compile("".join(f"(?P<{p}>[^/]*?)" if i % 2 else re.escape(p) for i, p in enumerate(parts)))
        found = [(p,) for p in _glob(self.spark, f"{root}/{re.sub(r'\"[^\"]*\"', '*', pattern)}") if name.fullmatch(p.removeprefix(root).removeprefix("/"))]
        paths = self.spark.createDataFrame(found, "path string")
        return self.discover(paths, lambda p: {**name.fullmatch(p.removeprefix(root).removeprefix("/")).groupdict(), **fixed})

    def cube(self, key: Mapping[str, str] | None = None, **more: str) -> Cube:
        """The cube of that key; packed values are unpacked as they are read."""
        row = self.full_paths().where(_is({**(key or {}), **more})).first()
        if row is None:
            raise KeyError(f"no such cube: {({**(key or {}), **more})}")
        attrs = {**(row["attrs"] or {}), **{k: row[k] for k in KEYS}}
        out = Cube(self.spark.read.parquet(row["path_full"]), row["dims"], row["variable"], attrs)
        if "bits" not in attrs:
            return out
        plain = {k: v for k, v in attrs.items() if k not in packing.ATTRIBUTES}
        return Cube(packing.unpack_cube(out).df, out.dims, out.name, plain)

    def pack(self, query=None, bits: int = 16, compress: bool = True, limits: Mapping[str, tuple[float, float]] | None = None) -> Catalog:
        """Stores the cubes that match and are not packed yet as integers. limits: the range by variable, else the package's
        own. The old data go once the new row is stored, unless they are linked."""
        todo = queried(self.full_paths(), query).where("available and not coalesce(map_contains_key(attrs, 'bits'), false)")
        gone = []
        for row in todo.collect():
            cube = Cube(self.spark.read.parquet(row["path_full"]), row["dims"], row["variable"], row["attrs"] or {})
            small = packing.pack_cube(cube, bits, (limits or {}).get(row["variable"]))
            have = {**(row["attrs"] or {}), **{k: row[k] for k in KEYS}}
            path = self._new_path(have)
            small.df.write.option("compression", "zstd" if compress else "none").parquet(path if self.root is None else f"{self.root}/{path}")
            attrs = {**(row["attrs"] or {}), **{k: str(small.attrs[k]) for k in packing.ATTRIBUTES}}
            new = (*(row[k] for k in KEYS), path, True, False, row["dims"], attrs)
            self.table = upsert(self.table, self.spark.createDataFrame([new], SCHEMA))
            if not row["linked"]:
                gone.append(row["path_full"])
        self.save()
        for path in gone:
            _delete(self.spark, path)
        return self

    def _new_path(self, have: Mapping[str, str]) -> str:
        return pattern_name(self.pattern, have).replace("/", "-").replace(":", "=") + "-" + uuid.uuid4().hex[:8]

    def update(self, query=None, **attrs: str) -> Catalog:
        """Sets attributes of the rows that match."""
        hit = queried(self.table, query).select(*KEYS).distinct()
        new = F.map_from_arrays(F.array(*map(F.lit, attrs)), F.array(*map(F.lit, attrs.values())))
        kept = F.map_filter("attrs", lambda k, _: ~k.isin(*attrs))
        changed = self.table.join(hit, KEYS, "left_semi").withColumn("attrs", F.map_concat(kept, new))
        self.table = self.table.join(hit, KEYS, "left_anti").unionByName(changed)
        return self.save()

    def remove(self, query=None, drop_rows: bool = True, delete_data: bool = True) -> Catalog:
        """Removes what matches: stored data unless linked, and the rows, or marks them as not available."""
        if drop_rows and not delete_data:
            raise ValueError("rows can't go while their data stay")
        hit = queried(self.table, query)
        if delete_data:
            for (path,) in Catalog(self.spark, self.root, hit).full_paths().where("not linked").select("path_full").collect():
                _delete(self.spark, path)
        keys = hit.select(*KEYS)
        rest = self.table.join(keys, KEYS, "left_anti")
        self.table = rest if drop_rows else rest.unionByName(self.table.join(keys, KEYS, "left_semi").withColumn("available", F.lit(False)))
        return self.save()

    def remove_orphans(self) -> Catalog:
        """Drops rows whose data are gone. Only the catalogue's paths are looked at, one by one."""
        gone = [(p,) for (p,) in self.full_paths().select("path_full").distinct().collect() if not _exists(self.spark, p)]
        if gone:
            self.table = self.full_paths().join(self.spark.createDataFrame(gone, "path_full string"), "path_full", "left_anti").select(*COLUMNS)
        return self.save()

    def close(self, delete: bool = False) -> None:
        if delete and self.root:
            self.remove()
            _delete(self.spark, self.root)

    # --- work over groups ----------------------------------------------------------------------------------

    def plan(self, requests, group_extra: Sequence[str] = (), ungrouped: Sequence[str] = (), query=None) -> tuple[DataFrame, list[str]]:
        """Rows of complete groups with their place, and the group's columns: keys that the requests don't name."""
        asked = request_table(self.spark, requests)
        named = [c for c in asked.columns if c != "req"]
        group = [k for k in KEYS if k not in named and k not in ungrouped] + list(group_extra)
        table = queried(self.table, query).where("available")
        asked = expand_wildcards(asked, table, [k for k in named if asked.where(F.col(k).isNull()).count()])
        if not group:
            table, group = table.withColumn("__all", F.lit(0)), ["__all"]
        return complete_groups(table, asked, group).withColumn("place", F.col("req")), group

    def apply(self, fn: Callable[..., Cube | Sequence[Cube]], requests, outputs: Sequence[Mapping[str, object]], into: Catalog | str | None = None, inherit_attributes: bool | Sequence[str] = False, force: bool = False, post: Callable[[Cube], Cube] | None = None, mode: str = "store", attrs: Mapping[str, str] | None = None, **plan) -> Catalog | dict:
        """``fn`` over the cubes of every complete group. outputs: per result its labels, as text or a function of the inputs'
        labels. A group whose outputs all exist is skipped unless ``force``. mode store: written and registered in ``into``
        (this catalogue if unset); lazy: a dict from key to cube, nothing written."""
        if mode not in ("store", "lazy"):
            raise ValueError(f"no such mode: {mode}")
        to = self if into is None else Catalog.open(self.spark, into) if isinstance(into, str) else into
        rows, group = self.plan(requests, **plan)
        per = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("place", *KEYS))).alias("rows"))
        have = {tuple(r) for r in to.table.select(*KEYS).collect()}
        lazy: dict = {}
        for r in per.toLocalIterator():
            keys = [{k: x[k] for k in KEYS} for x in r["rows"]]
            made = []
            for out in outputs:
                key = {}
                for k in KEYS:
                    labels = [x[k] for x in keys]
                    key[k] = str(evaluated(out[k], labels)) if k in out else labels[0] if len(set(labels)) == 1 else auto_label(labels)
                made.append(key)
            if not force and all(tuple(m[k] for k in KEYS) in have for m in made):
                continue
            inputs = [self.cube(k) for k in keys]
            got = fn(*inputs)
            got = [got] if isinstance(got, Cube) else list(got)
            if len(got) != len(made):
                raise ValueError(f"{len(got)} results for {len(made)} outputs")
            for i, (cube, key) in enumerate(zip(got, made, strict=True)):
                parent = inputs[min(i, len(inputs) - 1)].attrs
                take = {} if inherit_attributes is False else {k: v for k, v in parent.items() if k not in KEYS and (k not in RESERVED if inherit_attributes is True else k in inherit_attributes)}
                cube = Cube(cube.df, cube.dims, key["variable"], {**take, **(attrs or {})})
                cube = post(cube) if post else cube
                if mode == "lazy":
                    lazy[tuple(key[k] for k in KEYS)] = cube
                else:
                    to.add(cube, save=False, **key)
        return lazy if mode == "lazy" else to.save()

    def apply_locked(self, fn: Callable, requests, outputs, into: Catalog | str | None = None, wait: float = 60.0, **more):
        """``apply`` with the results' catalogue held alone and read anew: of two processes that ask for the same outputs, the
        second finds them there. TimeoutError if another holds it for more than ``wait`` seconds."""
        to = self if into is None else Catalog.open(self.spark, into) if isinstance(into, str) else into
        with to.alone(wait):
            if to.root is not None:
                to.refresh()
            return self.apply(fn, requests, outputs, into=to, **more)

    def map(self, fn: Callable[[Cube], Cube], query=None) -> dict:
        return {tuple(r[k] for k in KEYS): fn(self.cube({k: r[k] for k in KEYS})) for r in queried(self.table, query).collect()}

    def merge(self, key: str, query=None) -> dict:
        """Cubes that differ only in ``key`` under it as a new dimension."""
        from ..operators.align import concat

        rest = [k for k in KEYS if k != key]
        out: dict = {}
        for r in queried(self.table, query).collect():
            out.setdefault(tuple(r[k] for k in rest), {})[r[key]] = self.cube({k: r[k] for k in KEYS})
        return {k: concat(v, key) for k, v in out.items()}


class Collection(Catalog):
    """Several catalogues as one; of equal keys the later catalogue counts. Read only."""

    def __init__(self, spark: SparkSession, parts: Sequence[Catalog]):
        tables = [c.full_paths().withColumn("path", F.col("path_full")).withColumn("linked", F.lit(True)).select(*COLUMNS).withColumn("__at", F.lit(i)) for i, c in enumerate(parts)]
        table = spark.createDataFrame([], SCHEMA)
        if tables:
            every = fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
            table = every.groupBy(*KEYS).agg(F.max_by(F.struct(*[c for c in COLUMNS if c not in KEYS]), "__at").alias("x")).select(*KEYS, "x.*").select(*COLUMNS)
        super().__init__(spark, None, table)

    def save(self):
        raise ValueError("a collection is read only; name a catalogue for the results")


def _is(key: Mapping[str, str]) -> Column:
    return fold(lambda a, b: a & b, (F.col(k) == v for k, v in key.items()))


@contextmanager
def file_lock(spark: SparkSession, path: str, wait: float = 60.0, poll: float = 0.2):
    """One holder at a time, on any file system whose create call without overwriting is atomic; on local disks the system's
    own exclusive open. A lock left by a process that died must be deleted by hand."""
    until = time.monotonic() + wait
    fs, at = _fs(spark, path)
    local = fs.getScheme() == "file"
    fs.mkdirs(at.getParent())
    while not _claimed(fs, at, local):
        if time.monotonic() > until:
            raise TimeoutError(f"{path} is held")
        time.sleep(poll)
    try:
        yield
    finally:
        fs.delete(at, False)


def _claimed(fs, at, local: bool) -> bool:
    try:
        if local:
            os.close(os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        else:
            fs.create(at, False).close()
    except FileExistsError:
        return False
    except Py4JJavaError:
        if fs.exists(at):
            return False
        raise
    return True


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    fs, at = _fs(spark, pattern)
    found = fs.globStatus(at) or []
    plain = "://" not in pattern and not pattern.startswith("file:")
    return sorted(f.getPath().toUri().getPath() if plain else f.getPath().toString() for f in found)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def _delete(spark, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def _write_text(spark, path: str, text: str) -> None:
    """Beside the place, then moved there."""
    fs, at = _fs(spark, path)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(bytearray(text.encode()))
    out.close()
    # renaming with overwrite: a reader finds the old text or the new one, never none
    jvm = spark.sparkContext._jvm
    over = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = over
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(new), fs.makeQualified(at), options)


def _pointer(spark, root: str) -> dict | None:
    path = os.path.join(root, "current.json")
    if not _exists(spark, path):
        return None
    return json.loads("".join(r[0] for r in spark.read.text(path).collect()))
