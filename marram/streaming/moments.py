"""Running moments of a stream: n, sums, squares and the cross product per window and group, hence r and the slope.

Sums merge, so the state is one row per open window and group; rows later than the watermark are dropped, as the
watermark says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.functions.columns import ratio


def moments(stream: DataFrame, time: str, group: str, x: str, y: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Window start, group and sums over complete pairs; works on streams and on tables alike."""
    rows = stream.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_t", late)
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = {"n": F.count(F.lit(1)), "sx": F.sum(a), "sy": F.sum(b), "sxx": F.sum(a * a), "syy": F.sum(b * b), "sxy": F.sum(a * b)}
    return rows.groupBy(F.window("_t", window).alias("_w"), group).agg(*[v.alias(k) for k, v in sums.items()]).select(F.col("_w.start").alias("start"), group, *sums)


def statistics(sums: DataFrame) -> DataFrame:
    """r and slope of y on x from the sums."""
    n = F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    c = F.col("sxy") - F.col("sx") * F.col("sy") / n
    bottom = F.sqrt(F.greatest(vx * vy, F.lit(0.0)))
    return sums.withColumn("r", F.when(bottom > 1e-12, c / bottom)).withColumn("slope", F.when(vx > 1e-12, ratio(c, vx)))


def run_once(stream: DataFrame, name: str, checkpoint: str):
    """Everything that is there, into an in-memory table of that name."""
    return stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
