"""Station series in text files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import cf_encode, hhmm_seconds, plain_name


def read_series(spark: SparkSession, path: str, date: str, date_format: str, sep: str = ",", missing: Sequence[str] = ("", "NaN", "NA"), daytime: str | None = None, names: Mapping[str, str] | None = None, unit: str | None = None, reference: str = "1970-01-01 00:00:00") -> DataFrame:
    """A header row, its names reduced to letters and digits; a date column (plus hhmm in ``daytime``); all else numbers, bad ones
    missing. ``unit`` adds the time as a number since ``reference``."""
    raw = spark.read.csv(path, sep=sep, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    short = {c: (names or {}).get(c, plain_name(c)) for c in raw.columns}
    df = raw.toDF(*(short[c] for c in raw.columns))
    t = F.try_to_timestamp(F.col(plain_name(date)), F.lit(date_format))
    skip = {plain_name(date)}
    if daytime:
        skip.add(plain_name(daytime))
        t = F.timestamp_micros(F.unix_micros(t) + hhmm_seconds(F.col(plain_name(daytime)).try_cast("int")).cast("long") * 1_000_000)
    values = [F.when(~F.col(c).isin(list(missing)), F.col(c).try_cast("double")).alias(c) for c in df.columns if c not in skip]
    out = df.select(t.cast("timestamp_ntz").alias("time"), *values)
    return out.withColumn("time_number", cf_encode(F.col("time"), unit, reference)) if unit else out


def long_series(df: DataFrame, time: str = "time") -> DataFrame:
    """(variable, time, value)."""
    return df.unpivot([time], [c for c in df.columns if c not in (time, "time_number")], "variable", "value")
