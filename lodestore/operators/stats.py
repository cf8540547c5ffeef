"""Statistics of measurements, and counters of what tasks did."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latency(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, p50, p99): p99 is the value at place floor(n * 0.99) of the sorted ones, all rounded to 6 places.

    The place is found on distinct values with their counts, so a group's rows needn't meet one by one in a task's sort.
    """
    from pyspark.sql.window import Window

    usable = rows.where(F.col(value).isNotNull())
    counts = usable.groupBy(group, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(group).orderBy(value)
    placed = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    p99 = placed.where((F.col("upto") > F.floor(F.col("n") * 0.99)) & (F.col("upto") - F.col("c") <= F.floor(F.col("n") * 0.99))).select(group, F.round(value, 6).alias("p99"))
    rest = usable.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.median(value), 6).alias("p50"))
    return rest.join(p99, group).select(group, "n", "mean", "p50", "p99")


def throughput(rows: DataFrame, group: str, size: str, seconds: str) -> DataFrame:
    """(group, bytes, mb_s): all bytes of a group and its 10^6 bytes a second, rounded to 6 places; null without time."""
    usable = rows.where(F.col(size).isNotNull() & F.col(seconds).isNotNull())
    total = usable.groupBy(group).agg(F.sum(size).cast("long").alias("bytes"), F.sum(seconds).alias("__seconds"))
    rate = F.when(F.col("__seconds") > 0, F.round(F.col("bytes") / 1e6 / F.col("__seconds"), 6))
    return total.select(group, "bytes", rate.alias("mb_s"))


class Metrics:
    """Counters that tasks add to and the driver reads. ``Archive.read`` feeds those it is given.

    A task that runs again, as after a lost executor, counts again: they describe the work done, not the result.
    """

    NAMES = ("chunks_read", "bytes_read", "bytes_written", "cache_hits", "cache_misses", "blocks_decompressed", "files_read")

    def __init__(self, spark: SparkSession):
        self._counters = {n: spark.sparkContext.accumulator(0) for n in self.NAMES}

    def add(self, name: str, n: int = 1) -> None:
        self._counters[name].add(n)

    def chunk(self, size: int) -> None:
        self.add("chunks_read")
        self.add("bytes_read", size)

    def snapshot(self) -> dict[str, float]:
        out = {n: c.value for n, c in self._counters.items()}
        asked = out["cache_hits"] + out["cache_misses"]
        return out | {"hit_rate": out["cache_hits"] / asked if asked else 0.0}
