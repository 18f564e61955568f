"""Incremental ingest as a bounded file stream.

The stream's checkpoint remembers which archives were read, in place of a lookup of the
issues already stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from hemicycle.plans import ingest
from hemicycle.sources import archives

_BINARY_FILE = StructType([
    StructField("path", StringType()),
    StructField("modificationTime", TimestampType()),
    StructField("length", LongType()),
    StructField("content", BinaryType()),
])


def stream_archives(
    spark: SparkSession, root: str, pattern: str = archives.ARCHIVE_PATTERN,
    files_per_batch: int = 10_000,
) -> DataFrame:
    return (
        spark.readStream.format("binaryFile").schema(_BINARY_FILE)
        .option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
    )


def ingest_available(
    spark: SparkSession, root: str, path: str, checkpoint: str, status_path: str | None = None,
    **options: object,
) -> StreamingQuery:
    """Load every archive not seen before, then stop. A batch that is run again after a
    failure adds nothing twice, because rows are inserted by key.

    Each batch leaves one status row per file, failed ones with their error, under
    ``status_path`` (default: ``path`` with ``_status``), in a folder of its own, which a
    repeated batch replaces.
    """
    statuses = status_path or f"{path.rstrip('/')}_status"

    def load(batch: DataFrame, batch_id: int) -> None:
        results = ingest.load_parsed(batch, path)
        results.write.mode("overwrite").parquet(f"{statuses}/batch={batch_id}")

    return (
        stream_archives(spark, root, **options).writeStream
        .foreachBatch(load).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
