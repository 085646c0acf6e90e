"""Adding libraries over time.

Nothing here is a stream: samples arrive as whole files.  ``increment`` replaces the rows of
the samples that are new or changed and leaves the rest of a table as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(inputs: DataFrame, done: DataFrame) -> DataFrame:
    """Samples (sample, digest) of inputs that are not in ``done`` with the same digest."""
    return inputs.join(done.select("sample", F.col("digest").alias("_d")), "sample", "left").where("NOT digest <=> _d").drop("_d")


def increment(fresh: DataFrame, path: str) -> None:
    from twinroute.sources.sinks import write_by_sample

    write_by_sample(fresh, path)
