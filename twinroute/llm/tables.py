"""Reading and materialising helpers of the text operators."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def let_workers_import(spark: SparkSession) -> None:
    """Python workers started from now on find this package where the driver has it, whatever their folder."""
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Rows up to which a table of ids or keys is sent to all tasks: at most some tens of megabytes.
SENT_IDS = 1 << 21


def sent_if_small(ids: DataFrame) -> tuple[DataFrame, bool]:
    """ids marked for broadcast, and True, where they are counted to be at most ``SENT_IDS`` rows; as they are, and False, otherwise."""
    small = ids.count() <= SENT_IDS
    return (F.broadcast(ids) if small else ids), small


_scopes: list[list[str]] = []


def materialise(df: DataFrame, partition_by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Written to the shared folder as Parquet and read again: cuts lineage and survives lost executors.

    Inside ``scratch`` the table goes with the scope, unless ``keep``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    if _scopes and not keep:
        _scopes[-1].append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialised inside are deleted at the end; what is returned must be kept or need none of them."""
    _scopes.append([])
    try:
        yield
    finally:
        for name in _scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_and_id(docs: DataFrame) -> DataFrame:
    """Only the two columns that text operators read, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
