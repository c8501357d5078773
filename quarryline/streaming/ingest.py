"""Files that arrive over time: each delivery once, counted by the hour, written with a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arrivals(spark: SparkSession, folder: str, schema: StructType, files: int = 100) -> DataFrame:
    """A stream over the Parquet files of a folder, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def once(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """The first delivery of each key within the watermark; later ones are dropped."""
    return stream.where(F.col(key).isNotNull()).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def by_window(stream: DataFrame, at: str, by: list[str], length: str = "1 hour") -> DataFrame:
    """Rows by time window and group."""
    return stream.groupBy(F.window(at, length).alias("window"), *by).agg(F.count(F.lit(1)).alias("rows"))


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Give all that has arrived to ``write`` batch by batch and stop; a later call takes up what came since."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
