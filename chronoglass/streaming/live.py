"""The same segments and bins on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, time: str, width: str, late: str = "1 day") -> DataFrame:
    """Count and mean per id and window, with a watermark."""
    w = stream.withWatermark(time, late).groupBy("id", F.window(time, width).alias("w"))
    return w.agg(F.count("*").alias("n"), F.avg("v").alias("mean")).select("id", F.col("w.start").alias("start"), "n", "mean")


def sessions(stream: DataFrame, time: str, gap: str, late: str = "1 day") -> DataFrame:
    """Rows per id and session; unlike batch segments, a session ends at a gap of exactly `gap`."""
    w = stream.withWatermark(time, late).groupBy("id", F.session_window(time, gap).alias("w"))
    return w.agg(F.count("*").alias("n")).select("id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
