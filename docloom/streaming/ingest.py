"""Files that arrive are parsed as they come, by the same stage that batch jobs use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.parse import parse_documents
from ..sources.registry import format_of


def read_files(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of (path, modificationTime, content) of the files that appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.schema(schema).format("binaryFile").option("maxFilesPerTrigger", per_trigger).load(folder).select("path", "modificationTime", "content")


def parse_stream(files: DataFrame) -> DataFrame:
    """The nodes of a stream of files; stateless, so it needs no watermark."""
    return parse_documents(files.withColumn("doc_id", F.xxhash64("path")), format_of(F.col("path")), "content")


def windowed_counts(events: DataFrame, time: str, window: str, late: str, *by: str) -> DataFrame:
    """Counts in tumbling windows of event time; rows later than ``late`` are left out by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), *by).agg(F.count(F.lit(1)).alias("rows"))


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes a stream as Parquet, once over what is there; returns the query."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
