"""Dictionary tagging as a Structured Streaming job.

Cleaning and dictionary rules are stateless column expressions, so the same
expressions run unchanged over ``readStream``: new article files dropped
into a folder are tagged incrementally and appended to a Parquet table. The
checkpoint folder records which files are done, so a restarted job (or one
that lost executors) continues exactly where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def stream_files(spark: SparkSession, folder: str, schema: T.StructType,
                 glob: str | None = None, max_files_per_trigger: int | None = None,
                 recursive: bool = False) -> DataFrame:
    """A streaming scan of Parquet files arriving in ``folder`` (and its
    subfolders when ``recursive``)."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def stream_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A streaming scan of one Parquet table, be it a plain file or a folder of
    part files. Spark streams from folders only, unless the path is a pattern:
    this one fits the one name."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return stream_files(spark, f"{folder}/[{name[0]}]{name[1:]}", schema)


def start_tagging(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], sink: str,
                  checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply ``transform`` (any stateless DataFrame -> DataFrame function) to
    the stream and append the result to a Parquet table at ``sink``."""
    w = (transform(stream).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def run_to_completion(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], sink: str,
                      checkpoint: str) -> DataFrame:
    """Process everything available now, then read the sink as a table."""
    q = start_tagging(stream, transform, sink, checkpoint, available_now=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return stream.sparkSession.read.parquet(sink)
