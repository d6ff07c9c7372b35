"""Operators against the literal fixtures and independent formulas."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cubeloom import Cube
from cubeloom import fixtures as fx
from cubeloom.functions import labels
from cubeloom.operators import align, apply, chunking, interp, reduce, regrid, window
from cubeloom.plans import catalog, cli, workflow
from cubeloom.sources import ascii_grid, csv_series, cube_store, gsod, netcdf3, packing

SF = "/root/testdata/sf0.001"


def series(spark, values):
    return Cube(spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "t int, value double"), ("t",))


def values(cube, dim="t"):
    return [r["value"] for r in cube.df.orderBy(dim).collect()]


def test_moving_average(spark):
    s = series(spark, [i * i for i in range(9)])
    assert values(window.moving_average(s, "t", 3)) == pytest.approx([0.5, 5 / 3, 14 / 3, 29 / 3, 50 / 3, 77 / 3, 110 / 3, 149 / 3, 56.5])
    assert values(window.moving_average(s, "t", 4)) == pytest.approx([5 / 3, 3.5, 7.5, 13.5, 21.5, 31.5, 43.5, 43.5, 149 / 3])


def test_quantiles(spark):
    s = series(spark, [5, 1, 3, 2, 4, None])
    assert values(reduce.quantiles(s, "t", [0, 0.25, 0.5, 0.999]), "quantile") == [1, 2, 3, 4]
    assert values(reduce.ranked_quantiles(s, "t", [0, 0.25, 0.5, 0.999]), "quantile") == [1, 2, 3, 4]
    assert values(reduce.quantiles(s, "t", [0, 0.25, 0.5, 0.999], True, True), "quantile") == [2, 2, 3, 3]
    assert values(reduce.quantiles(series(spark, [None]), "t", [0.5]), "quantile") == [None]
    with pytest.raises(ValueError):
        labels.cdf_points(5, "none")


def test_lookup_and_interpolation(spark):
    x = spark.createDataFrame([(-10.0,), (10.0,), (15.0,), (29.0,), (50.0,), (100.0,), (None,)], "x double")
    got = {r["x"]: (r["n"], r["l"]) for r in interp.with_knots(x, fx.knots(spark)).select("x", interp.nearest(F.col("x")).alias("n"), interp.linear(F.col("x")).alias("l")).collect()}
    assert got[15.0][0] == 5 and got[29.0][0] == 25 and got[100.0][0] == 30
    assert [got[k][1] for k in (-10.0, 10.0, 15.0, 50.0)] == [-5, 5, 15, 32.5] and got[None][1] is None


def test_longitude_and_chunks(spark):
    lon = Cube(spark.createDataFrame([(float(x), 1.0) for x in (0, 5, 165, 170, 355)], "longitude double, value double"), ("longitude",))
    assert sorted(r["longitude"] for r in regrid.extend_longitude(lon).df.collect()) == [-190, -5, 0, 5, 165, 170, 355, 360, 365]
    assert chunking.chunk_bounds(100, 40, 10) == [(0, 40), (30, 70), (60, 100), (90, 100)]


@pytest.mark.parametrize("profile", ["square", "triangle"])
@pytest.mark.parametrize("n,size,overlap", [(30, 8, 3), (17, 5, 2), (100, 40, 10), (6, 10, 4)])
def test_blending_is_a_partition_of_unity(spark, profile, n, size, overlap):
    s = series(spark, range(n))
    assert values(chunking.overlap_apply(s, "t", None, size, overlap, profile)) == pytest.approx(list(range(n)))


def test_regrid_is_exact_on_affine_fields(spark):
    grid = fx.grid(spark)
    points = spark.createDataFrame([(10.3, 20.7), (-89.0, 0.1), (90.0, 355.0)], "latitude double, longitude double")
    for method in ("triangle", "bilinear"):
        got = regrid.interpolate(grid, points, method=method).df.collect()
        assert [r["value"] for r in got] == pytest.approx([2 * r["latitude"] + r["longitude"] for r in got])
    with pytest.raises(NotImplementedError):
        regrid.interpolate(grid, points, method="spline")


def test_labels(spark):
    days = lambda *d: spark.createDataFrame([(dt.datetime(*x),) for x in d], "t timestamp_ntz")
    label = lambda df: labels.time_label(df, "t").first()[0]
    assert label(days((2000, 1, 1), (2000, 2, 1), (2000, 3, 1))) == "monthly_2000-01_2000-03"
    assert label(days((2000, 1, 5), (2000, 1, 6), (2000, 1, 7), (2000, 1, 8))) == "daily_2000-01-05_2000-01-08"
    assert label(days((2000, 1, 5), (2000, 1, 6), (2000, 1, 17), (2000, 1, 28))) == "irregular"
    assert label(spark.createDataFrame([(3,), (9,)], "t int")) == "integer_3_9"
    cube = Cube(spark.createDataFrame([(float(a), b, 1.0) for a in (0, 1, 2) for b in (0.0, 2.0, 5.0)], "latitude double, longitude double, value double"), ("latitude", "longitude"))
    assert labels.space_label(cube.df, ["latitude", "longitude"]) == "latitude:0.0,2.0,1.0_longitude:irregular"
    assert labels.pattern_name('"variable"_"source".nc', {"variable": "tas", "source": "era5"}) == "tas_era5.nc"
    with pytest.raises(KeyError):
        labels.pattern_column('"nothing"', ["a"])
    assert spark.range(1).select(labels.hhmm_seconds(F.lit(1330))).first()[0] == 48600
    assert labels.order_keys(["a", "b", "c", "d"], ["d", "b"]) == ["a", "d", "c", "b"]
    assert labels.auto_label(["x", "y", "x"]) == "from__x__y"


def test_align_checks_axes_and_broadcasts_in_any_order(spark):
    a, b = series(spark, [1, 2]), series(spark, [1, 2, 3])
    with pytest.raises(ValueError):
        align.align(a, b, check=True)
    one = series(spark, [7])
    for pair in ((one, b), (b, one)):
        assert align.align(*pair, singletons=("t",)).count() == 3
    assert align.identical(a, a) and not align.identical(a, b)


def test_apply(spark):
    import pandas as pd

    c = fx.vectors(spark, SF)
    out = apply.apply(c, lambda f: pd.DataFrame({"low": [f.value.min()], "top": [f.value.max()]}), ["k"], output={}, outputs=["low", "top"])
    want = {r[0]: (r[1], r[2]) for r in c.df.groupBy("vec_id").agg(F.min("value"), F.max("value")).collect()}
    assert {r["vec_id"]: r["value"] for r in out["top"].df.collect()} == {k: v[1] for k, v in want.items()}
    with pytest.raises(Exception, match="returned no"):
        apply.apply(c, lambda f: f[["k"]], ["k"]).df.collect()


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(0, 1000), min_size=1, max_size=20))
def test_packing_error_is_half_a_step(spark, xs):
    got = values(packing.unpack_cube(packing.pack_cube(series(spark, xs), limits=(0.0, 1000.0))))
    assert np.abs(np.array(got) - np.array(xs)).max() <= 0.5 * 1000 / 65535 + 1e-9


def test_catalogue(spark, tmp_path):
    c = catalog.Catalog.open(spark, str(tmp_path / "cat"))
    day = Cube(spark.createDataFrame([(dt.datetime(2000, 1, i), float(i)) for i in range(1, 6)], "time timestamp_ntz, value double"), ("time",), "tas", {"units": "K"})
    for source in ("a", "b"):
        c.add(day, source=source, space="here")
    assert c.table.count() == 2
    c.add(day, source="a", space="here")  # the same key again
    assert c.table.count() == 2
    with pytest.raises(ValueError):
        c.add(day)
    again = catalog.Catalog.open(spark, str(tmp_path / "cat"))
    assert again.cube(source="a").df.count() == 5
    calls = []

    def mean(x, y):
        calls.append(1)
        return align.combine("(v0 + v1) / 2", x, y)

    for _ in range(2):
        again.apply(mean, {"source": ["a", "b"]}, [{"source": "mean"}], inherit_attributes=True)
    assert len(calls) == 1 and again.table.count() == 3
    assert again.cube(source="mean").attrs["units"] == "K"
    assert not again.apply(mean, {"source": ["a", "nosuch"]}, [{"source": "x"}], mode="lazy")
    assert list(again.merge("source").values())[0].df.count() == 15
    again.update("source = 'mean'", note="x")
    assert again.table.where("attrs['note'] = 'x'").count() == 1
    again.remove("source = 'mean'")
    assert again.table.count() == 2
    with pytest.raises(ValueError):
        catalog.Collection(spark, [again]).save()
    assert catalog.Collection(spark, [again, c]).table.count() == 2  # equal keys: the later catalogue counts


def test_workflow(tmp_path):
    runs = []

    def make(node, inputs):
        runs.append(node.name)
        return {"variable": node.provides["variable"], "n": 1 + sum(x.get("n", 0) for x in inputs)}

    nodes = [workflow.Node("base", make, provides={"variable": "tas"}), workflow.Node("top", make, [{"process": "base", "variable": None}], {"variable": "tas"})]
    flow = workflow.Workflow(nodes, workflow.Memo(str(tmp_path)))
    assert flow.run("top")["n"] == 2 and runs == ["base", "top"]
    assert workflow.Workflow(nodes, workflow.Memo(str(tmp_path))).run("top")["n"] == 2 and len(runs) == 2
    flow.run("top", force=1)
    assert runs[2:] == ["top"]
    with pytest.raises(ValueError):
        workflow.Workflow([workflow.Node("a", make, [{"process": "a"}])]).order("a")
    with workflow.lock(str(tmp_path / "l")), pytest.raises(TimeoutError):
        with workflow.lock(str(tmp_path / "l"), wait=0.1):
            pass
    assert workflow.canonical({"a": 1, "b": 2}) == workflow.canonical({"b": 2, "a": 1})


def test_command_line():
    def f(x: int, name: str = "n", **more):
        """Does it.
        x: a number"""
        return x, name, more

    assert cli.call(f, ["--x", "3", "--other", "4"]) == (3, "n", {"other": "4"})


def test_netcdf_round_trip(spark, tmp_path):
    cube = Cube(spark.createDataFrame([(t, float(x), None if (t, x) == (1, 2) else t * 10.0 + x) for t in range(5) for x in range(3)], "time int, lon double, value double"), ("time", "lon"), "tas", {"units": "K"})
    for record, version in ((None, 1), ("time", 2)):
        path = str(tmp_path / f"{record}.nc")
        netcdf3.write(cube, path, record=record, version=version)
        back = netcdf3.read(spark, path, "tas")
        assert back.attrs["units"] == "K"
        assert sorted(map(tuple, back.df.collect()), key=str) == sorted(map(tuple, cube.df.collect()), key=str)


def test_text_sources(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Dates, T1H801 (C) ,RR\n1/2/2010 0:30,1.5,x\n1/2/2010 1:00,NaN,3\n")
    rows = csv_series.read_series(spark, str(tmp_path / "s.csv"), "Dates", "M/d/yyyy H:mm", unit="hours", reference="2010-01-02 00:00:00").orderBy("time").collect()
    assert [(r["T1H801C"], r["RR"], r["time_number"]) for r in rows] == [(1.5, None, 0.5), (None, 3.0, 1.0)]
    line = list(" " * 138)
    for at, text in ((0, "010010"), (7, "99999"), (14, "20000102"), (24, "  23.4"), (35, "9999.9"), (102, "  30.2"), (108, "*"), (132, "010000")):
        line[at : at + len(text)] = text
    (tmp_path / "g.op").write_text("STN--- WBAN\n" + "".join(line) + "\n")
    r = gsod.daily(spark, str(tmp_path / "g.op")).first()
    assert (r["station_id"], r["date"], r["temp"], r["dewp"], r["max"], r["max_flag"], r["r"]) == ("010010-99999", dt.date(2000, 1, 2), 23.4, None, 30.2, "d", 1)
    grid = Cube(spark.createDataFrame([(float(a), float(b), a * 10.0 + b) for a in (0, 1) for b in (0, 1, 2)], "latitude double, longitude double, value double"), ("latitude", "longitude"))
    got = [r["value"] for r in ascii_grid.lines(grid).orderBy("n").collect()]
    assert got[:3] == ["ncols 3", "nrows 2", "xllcorner -0.5"] and [x.split() for x in got[6:]] == [["10.0000", "11.0000", "12.0000"], ["0.00000", "1.00000", "2.00000"]]
    path = cube_store.write(grid, str(tmp_path / "cube"))
    assert align.identical(cube_store.read(spark, path, ("latitude", "longitude")).with_value("cast(value as double)"), grid)


def test_plans_reach_the_scan(spark):
    plan = fx.table(spark, SF, "lineitem").where("l_linenumber = 3").select("l_quantity")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_linenumber)" in plan and "l_comment" not in plan
    plan = regrid.interpolate(fx.grid(spark), spark.range(4).select(F.col("id").cast("double").alias("latitude"), F.col("id").cast("double").alias("longitude")), grid=(-90.0, 5.0, 0.0, 5.0)).df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_catalogue_opened_with_a_query_keeps_the_other_rows(spark, tmp_path):
    from cubeloom.plans.catalog import Catalog

    root = f"file://{tmp_path}/c"
    cat = Catalog.open(spark, root)
    df = spark.createDataFrame([(0, 1.0), (1, 2.0)], "x int, v double")
    for source in ("a", "b"):
        cat.add(Cube.of(df, ["x"], "v", "v"), variable="v", source=source, time="t", space="s", kind=f"k{source}")
    part = Catalog.open(spark, root, query="source = 'a'")
    assert part.table.count() == 1
    part.add(Cube.of(df, ["x"], "v", "v"), variable="v", source="c", time="t", space="s")
    assert sorted(r["source"] for r in part.table.collect()) == ["a", "c"]
    part.add(Cube.of(df, ["x"], "v", "v"), variable="w", source="c", time="t", space="s")
    assert sorted(r["source"] for r in Catalog.open(spark, root).table.collect()) == ["a", "b", "c", "c"]
    assert [r["source"] for r in Catalog.open(spark, root, kind="kb").table.collect()] == ["b"]


def test_points_outside_the_grid_are_missing_at_every_loop_point(spark):
    rows = [(t, float(y), float(x), float(t + y + x)) for t in range(2) for y in range(3) for x in range(3)]
    cube = Cube(spark.createDataFrame(rows, "t int, latitude double, longitude double, value double"), ("t", "latitude", "longitude"), "v")
    target = spark.createDataFrame([(0.5, 0.5), (9.0, 9.0)], "latitude double, longitude double")
    got = {(r["t"], r["latitude"]): r["value"] for r in regrid.interpolate(cube, target).df.collect()}
    assert got == {(0, 0.5): 1.0, (1, 0.5): 2.0, (0, 9.0): None, (1, 9.0): None}


def test_two_writers_of_one_catalogue(spark, tmp_path):
    root = str(tmp_path / "cat")
    cube = Cube(spark.createDataFrame([(1, 2.0)], "t int, value double"), ("t",), "v")
    key = lambda s: {"variable": "v", "source": s, "time": "x", "space": "none"}
    catalog.Catalog.open(spark, root).add(cube, **key("a")).add(cube, **key("b"))
    one, two = catalog.Catalog.open(spark, root), catalog.Catalog.open(spark, root)
    one.add(cube, **key("c"))
    two.remove("source = 'a'")
    two.update("source = 'b'", note="n")
    one.add(cube, **key("d"))
    rows = catalog.Catalog.open(spark, root).rows().collect()
    assert [(r["source"], r["attrs"].get("note")) for r in rows] == [("b", "n"), ("c", None), ("d", None)]
    with one.alone(), pytest.raises(TimeoutError), catalog.Catalog.open(spark, root).alone(wait=0.1):
        pass
    with two.alone(wait=0.1):
        pass


def test_packing_in_a_catalogue(spark, tmp_path):
    import os

    cat = catalog.Catalog.open(spark, str(tmp_path / "cat"))
    cube = Cube(spark.createDataFrame([(1, 2.0), (2, None), (3, 40.0)], "t int, value double"), ("t",), "v")
    key = {"variable": "v", "source": "a", "time": "x", "space": "none"}
    cat.add(cube, **key)
    old = cat.full_paths().first()["path_full"]
    cat.pack(limits={"v": (0.0, 100.0)})
    assert not os.path.exists(old)
    row = cat.full_paths().first()
    assert row["attrs"]["bits"] == "16" and dict(spark.read.parquet(row["path_full"]).dtypes)["value"] == "int"
    cat.pack(limits={"v": (0.0, 100.0)})
    assert cat.full_paths().first()["path"] == row["path"]
    assert values(catalog.Catalog.open(spark, cat.root).cube(key), "t") == [pytest.approx(2.0, abs=1e-3), None, pytest.approx(40.0, abs=1e-3)]
    with pytest.raises(ValueError, match="no range"):
        cat.add(cube.with_attrs(units="furlong"), bits=16, **key)


def test_vectorised_apply_calls_once_for_many_points(spark):
    import numpy as np

    c = fx.vectors(spark, SF)
    calls = spark.sparkContext.accumulator(0)

    def low(x):
        calls.add(1)
        return np.nanmin(x, axis=1)

    got = {r[0]: r[1] for r in apply.apply_vectorised(c, low, "k", reduces=True).df.collect()}
    want = {r[0]: r[1] for r in c.df.groupBy("vec_id").agg(F.min("value")).collect()}
    assert got == want and calls.value < len(want) / 4
    ragged = Cube(spark.createDataFrame([(p, i, float(i)) for p in (None, "a", "b") for i in range({"a": 3, "b": 3}.get(p, 2))], "p string, i int, value double"), ("p", "i"))
    out = apply.apply_vectorised(ragged, lambda x: x[:, :2] * 2, "i", output=("j", "int", [7, 8])).df.collect()
    assert sorted((r["p"] or "", r["j"], r["value"]) for r in out) == sorted((p, j, v) for p in ("", "a", "b") for j, v in ((7, 0.0), (8, 2.0)))
    assert apply.apply_vectorised(ragged.where("false"), lambda x: x, "i").df.count() == 0
    with pytest.raises(Exception, match="shape"):
        apply.apply_vectorised(ragged, lambda x: x[:, :1], "i").df.collect()


def test_both_quantiles_agree(spark):
    rows = [("a", i, float(i % 4)) for i in range(9)] + [("b", 0, None), ("c", 0, 5.0), ("c", 1, None)]
    c = Cube(spark.createDataFrame(rows, "g string, t int, value double"), ("g", "t"))
    for start, end in ((False, False), (True, True)):
        made = [sorted(map(tuple, f(c, "t", [0.0, 0.3, 0.9, 1.0], stable_start=start, stable_end=end).df.collect()), key=str) for f in (reduce.quantiles, reduce.ranked_quantiles)]
        assert made[0] == made[1] and len(made[0]) == 12


def test_regrid_without_interpolation(spark):
    grid = fx.grid(spark)
    target = spark.createDataFrame([(float(a), float(b)) for a in (0, 5, 10) for b in (20, 25, 30)], "latitude double, longitude double")
    got = regrid.regrid(grid, target, border=0, interpolation=False, strict=True)
    assert got.df.count() == 9
    with pytest.raises(ValueError):
        regrid.regrid(grid, target, border=1, interpolation=False, strict=True)
    beyond = target.union(spark.createDataFrame([(120.0, 20.0)], "latitude double, longitude double"))
    with pytest.raises(ValueError):
        regrid.regrid(grid, beyond, strict=True)
    assert regrid.regrid(grid, beyond).df.count() == 9
