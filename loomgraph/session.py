"""Session plumbing: the package for the executors, tables in the shared folder, the driver's tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bytes of tables that read() deals out.
SPREAD = (1 << 19, 1 << 25)
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors of a session, once; Spark serves the file to those that start later."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="loomgraph-ship-")  # only the driver reads it, and serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/loomgraph-{sc.applicationId}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.join("loomgraph", os.path.relpath(full, here)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
    # batches follow bytes, not rows, so that long texts don't make large ones; a value that the user set stays
    if spark.conf.get(BATCH_BYTES, None) in (None, "64MB", "67108864", "67108864b"):
        spark.conf.set(BATCH_BYTES, str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset, on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomgraph-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: writes df to the shared folder as Parquet and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph-tables/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.loomgraph_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by written(), once nothing that is still to run reads them."""
    for df in tables:
        path = getattr(df, "loomgraph_path", None)
        if not path:
            continue
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def plan_size(df: DataFrame) -> int:
    """The optimizer's estimate of a table's bytes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table.  One of a few MB is often a single row group, which one task would scan and all that follows: it is dealt out
    to all cores.  Larger tables, whose scans have tasks enough, stay as they are."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    tasks = spark.sparkContext.defaultParallelism
    return df.repartition(tasks) if SPREAD[0] <= plan_size(df) < SPREAD[1] and tasks > 1 else df
