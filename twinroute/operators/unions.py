"""Unions that do not claim a partitioning.

Spark 4.1 may take a union of inputs that are dealt alike to be dealt that way itself and leave out the shuffle of what
follows.  With a reused or coalesced shuffle below one input only, rows of a key then stay in two partitions, and windows and
groups over the union are silently wrong (``tests/test_stores.py`` has a case).  The setting is switched off for the session
wherever this package unites rows.

Spark also keeps the first rows of a window's keys before the shuffle, which sorts a whole file split in one task.  Where the rows of a key are
spread over the file that saves little, and the task's memory grows with the split; ``plain_windows`` switches it off for the session.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.sql.unionOutputPartitioning"
LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def plain_unions(spark: SparkSession) -> None:
    spark.conf.set(SETTING, "false")


def plain_windows(spark: SparkSession) -> None:
    spark.conf.set(LIMIT, "-1")


def stacked(*parts: DataFrame, missing: bool = False) -> DataFrame:
    """Rows of all parts by column name; ``missing`` columns are null."""
    plain_unions(parts[0].sparkSession)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), parts)


def shared(df: DataFrame, *needed: str) -> DataFrame:
    """df for several readers that are to share its last shuffle.

    What a reader filters on or leaves out is otherwise told below the shuffle, which then is another for each reader.  Nothing moves past
    a row number; ``needed`` are the summed columns that some readers leave out.
    """
    kept = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in needed), F.col("_row_id") >= 0)
    return df.withColumn("_row_id", F.monotonically_increasing_id()).where(kept).drop("_row_id")
