"""Continuous compression of a folder that images are put into. An addition: the same stateless plan, fed by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..operators.compress import compress_images

SCHEMA = "path string, height int, width int, data binary"


def raster_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Rasters (path, height, width, data) as Parquet files arrive."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def compress_stream(rasters: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    return compress_images(rasters, config)


def write_results(results: DataFrame, path: str, checkpoint: str):
    """Results as Parquet files; the checkpoint makes each image count once."""
    return results.withColumn("ingested", F.current_timestamp()).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
