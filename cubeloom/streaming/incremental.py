"""Running means over a growing folder of cube files: an extension for sources that never end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..cube import VALUE


def stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_mean(rows: DataFrame, time: str, by: list[str], width: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Means by time window. State of a window is dropped once the watermark has passed it; later rows are not counted."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width, slide), *by).agg(F.avg(VALUE).alias(VALUE), F.count(VALUE).alias("n")).select(F.col("window.start").alias(time), *by, VALUE, "n")


def start(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends closed windows to a Parquet folder until all present files are read."""
    return df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
