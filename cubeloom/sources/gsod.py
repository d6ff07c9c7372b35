"""Daily station summaries in fixed-width text, and the inventory of stations. Local files only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: name, start and end (from 0), kind.
FIELDS = [
    ("stn", 0, 6, "string"), ("wban", 7, 12, "string"), ("date", 14, 22, "date"), ("temp", 25, 30, "double"), ("temp_count", 31, 33, "int"), ("dewp", 36, 41, "double"), ("dewp_count", 42, 44, "int"),
    ("slp", 46, 52, "double"), ("slp_count", 53, 55, "int"), ("stp", 57, 63, "double"), ("stp_count", 64, 66, "int"), ("visib", 68, 73, "double"), ("visib_count", 74, 76, "int"), ("wdsp", 78, 83, "double"),
    ("wdsp_count", 84, 86, "int"), ("mxspd", 88, 93, "double"), ("gust", 95, 100, "double"), ("max", 103, 108, "double"), ("max_flag", 108, 109, "flag"), ("min", 111, 116, "double"), ("min_flag", 116, 117, "flag"),
    ("prcp", 118, 123, "double"), ("prcp_flag", 123, 124, "string"), ("sndp", 125, 130, "double"), ("f", 132, 133, "int"), ("r", 133, 134, "int"), ("s", 134, 135, "int"), ("h", 135, 136, "int"), ("th", 136, 137, "int"), ("tr", 137, 138, "int"),
]
MISSING = (99.99, 99.9, 999.9, 9999.9)


def daily(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all files that ``path`` (a glob; gz too) matches. Blank flags become e, * becomes d; sentinels become missing."""
    line = F.col("value")
    cols = []
    for name, a, b, kind in FIELDS:
        raw = F.substring(line, a + 1, b - a)
        if kind == "flag":
            c = F.translate(raw, " *", "ed")
        elif kind == "date":
            c = F.try_to_timestamp(raw, F.lit("yyyyMMdd")).cast("date")
        elif kind == "string":
            c = F.trim(raw)
        else:
            number = F.trim(raw).try_cast(kind)
            c = F.when(~number.isin(*MISSING), number) if kind == "double" else number
        cols.append(c.alias(name))
    rows = spark.read.text(path).where(~line.startswith("STN") & (F.length(F.trim(line)) > 0))
    return rows.select(F.concat_ws("-", F.trim(F.substring(line, 1, 6)), F.trim(F.substring(line, 8, 5))).alias("station_id"), *cols)


def stations(spark: SparkSession, path: str, selection: Mapping[str, object] | None = None) -> DataFrame:
    """The inventory with lower-case names and station_id. begin: stations that begin no later; end: that end no earlier;
    a list: one of its members; else equality."""
    raw = spark.read.csv(path, header=True)
    df = raw.toDF(*(c.strip().lower().replace(" ", "_").replace("(", "").replace(")", "") for c in raw.columns))
    df = df.withColumn("station_id", F.concat_ws("-", "usaf", "wban"))
    for c, kind in (("lat", "double"), ("lon", "double"), ("elev", "double")):
        for name in [x for x in df.columns if x.startswith(c)]:
            df = df.withColumn(name, F.col(name).try_cast(kind))
    for k, v in (selection or {}).items():
        if k == "begin":
            df = df.where(F.col(k) <= str(v))
        elif k == "end":
            df = df.where(F.col(k) >= str(v))
        else:
            df = df.where(F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v)
    return df
