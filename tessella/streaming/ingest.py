"""Files that arrive in a folder as a stream. Each file is parsed for itself, so the stream keeps no state but the names it has seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tiff import Options, Tiff

_BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def read_stream(spark: SparkSession, path: str, glob: str = "*.tif*", files_per_trigger: int = 1000, **options) -> Tiff:
    """Tables of a folder's present and future files; the same methods as for a read at once, but for those that join or sort."""
    reader = spark.readStream.format("binaryFile").schema(_BINARY_FILE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger)
    return Tiff(reader.load(path), Options(**options))


def write_available(df: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to a Parquet table, then stops; started again, it goes on where it stopped."""
    return df.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def pages_by_arrival(spark: SparkSession, path: str, window: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """Files and bytes that arrived in each window of modification time; windows older than the watermark are closed."""
    files = spark.readStream.format("binaryFile").schema(_BINARY_FILE).load(path).select("modificationTime", "length")
    late = files.withWatermark("modificationTime", watermark)
    return late.groupBy(F.window("modificationTime", window)).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
