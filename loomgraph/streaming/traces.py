"""The trace log as a stream: deduplicated counts per name, kept up to date as lines arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import shared_dir


def deduplicated(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "30 days") -> DataFrame:
    """The stream without rows whose keys came before, within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def replayed_counts(spark: SparkSession, path: str) -> DataFrame:
    """name, n, sessions over a table of events read as a stream to its present end."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    events = spark.readStream.schema(schema).option("pathGlobFilter", name if not _is_dir(spark, path) else "*.parquet").parquet(path if _is_dir(spark, path) else folder)
    once = deduplicated(events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id"), ["event_id"])
    out = f"{shared_dir(spark)}/loomgraph-stream/{uuid.uuid4().hex}"
    query = once.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    rows = spark.read.schema(once.schema).parquet(f"{out}/rows")
    return rows.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("sessions"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
