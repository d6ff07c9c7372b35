"""Cubes over the test tables, shared by queries, bench and tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cube import VALUE, Cube


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir; below a folder of our own where that is unset, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="cubeloom-")
    return f"{at}/{uuid.uuid4().hex}"


def exact_mean(v: str = VALUE) -> Column:
    """Mean of values with two decimals: the sum is exact, so only the division rounds, whatever the order."""
    return F.sum(F.col(v).cast("decimal(18,2)")).cast("double") / F.count(v)


def daily(spark: SparkSession, sf_dir: str) -> Cube:
    e = table(spark, sf_dir, "events")
    out = e.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(exact_mean().alias(VALUE))
    return Cube(out, ("event_type", "day"), "events")


def readings(spark: SparkSession, sf_dir: str) -> Cube:
    """Single readings; minus zero becomes zero."""
    e = table(spark, sf_dir, "events")
    return Cube(e.select("event_id", "event_type", "ts", (F.col("value") + 0.0).alias(VALUE)), ("event_id", "event_type"), "events")


def vectors(spark: SparkSession, sf_dir: str) -> Cube:
    e = table(spark, sf_dir, "embeddings")
    return Cube(e.select("vec_id", F.posexplode("embedding").alias("k", "v")).select("vec_id", "k", F.col("v").cast("double").alias(VALUE)), ("vec_id", "k"), "embedding")


def monthly(spark: SparkSession, sf_dir: str) -> Cube:
    li = table(spark, sf_dir, "lineitem")
    out = li.groupBy("l_returnflag", "l_linestatus", F.date_trunc("month", "l_shipdate").cast("date").alias("month")).agg(exact_mean("l_quantity").alias(VALUE))
    return Cube(out, ("l_returnflag", "l_linestatus", "month"), "quantity")


def grid(spark: SparkSession, dlat: float = 5.0, dlon: float = 5.0) -> Cube:
    """value = 2 latitude + longitude, which every linear interpolation must return."""
    ny, nx = int(180 / dlat) + 1, int(360 / dlon)
    n = spark.range(ny * nx)
    lat, lon = F.floor(F.col("id") / nx) * dlat - 90.0, (F.col("id") % nx) * dlon
    return Cube(n.select(lat.alias("latitude"), lon.alias("longitude")).withColumn(VALUE, F.col("latitude") * 2 + F.col("longitude")), ("latitude", "longitude"), "affine")


KNOTS = [(0, 0.0, 0.0), (1, 10.0, 5.0), (2, 20.0, 25.0), (3, 40.0, 30.0)]


def knots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOTS, "idx int, x double, y double")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey)
    return rows.select(F.col("o_orderpriority").alias("variable"), F.col("o_orderstatus").alias("source"), F.concat(F.lit("monthly_"), F.date_format("o_orderdate", "yyyy-MM")).alias("time"), F.col("c_nationkey").cast("string").alias("space")).distinct()
