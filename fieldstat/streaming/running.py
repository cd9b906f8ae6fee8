"""Running moments and an append-only run log over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_moments(stream: DataFrame, by: list[str], value: str, ddof: int = 0) -> DataFrame:
    """(by, n, mean, var) so far, of a batch or a stream; a variance of fewer than ddof + 1 values is null.

    Spark's central-moment aggregate merges partial means and squares, so nothing is stored but these.
    """
    n, v = F.count(value), F.var_pop(value)
    var = v if ddof == 0 else F.when(n > ddof, v * n / (n - ddof))
    return stream.groupBy(*by).agg(n.alias("n"), F.avg(value).alias("mean"), var.alias("var"))


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of result rows to Parquet, each micro-batch once; returns the started query."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
