"""First-seen deduplication of chunks, its statistics, and the anti join of an append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Consecutive keys that one ordering group covers.
ORDER_SPAN = 4096


def with_ordinal(rows: DataFrame, key: str, then: list[str], name: str, span: int = ORDER_SPAN) -> DataFrame:
    """Adds the 0-based position of each row in the order of ``key`` (a non-negative long) and ``then``.

    Ranges of ``span`` keys are ordered apart; a prefix sum over their row counts, one row a range, puts them together,
    so no task orders the whole table.
    """
    spans = rows.withColumn("__span", F.floor(F.col(key) / span))
    sizes = spans.groupBy("__span").agg(F.count("*").alias("n"))
    before = sizes.select("__span", F.coalesce(F.sum("n").over(Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__span").orderBy(key, *then)) - 1
    return spans.withColumn("__at", inside).join(before, "__span").withColumn(name, F.col("__before") + F.col("__at")).drop("__span", "__at", "__before")


def running_sum(rows: DataFrame, key: str, size: str, name: str, span: int = ORDER_SPAN) -> DataFrame:
    """Adds the sum of ``size`` over the rows with a smaller ``key`` (a non-negative long, each once).

    As in ``with_ordinal``, ranges of keys are summed apart and a prefix sum, one row a range, puts them together.
    """
    spans = rows.withColumn("__span", F.floor(F.col(key) / span))
    totals = spans.groupBy("__span").agg(F.sum(size).alias("__total"))
    before = totals.select("__span", F.coalesce(F.sum("__total").over(Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum(size).over(Window.partitionBy("__span").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spans.withColumn("__inside", inside).join(before, "__span").withColumn(name, F.col("__before") + F.col("__inside")).drop("__span", "__inside", "__before")


def first_seen(chunks: DataFrame) -> DataFrame:
    """(hash, size, file_ord, pos) of the first occurrence of each distinct hash of ``chunks(hash, size, file_ord, pos)``.

    The least (file_ord, pos) decides, so the result doesn't depend on the order of arrival; data stays out of it.
    """
    best = chunks.groupBy("hash").agg(F.min(F.struct("file_ord", "pos", "size")).alias("first"))
    return best.select("hash", "first.size", "first.file_ord", "first.pos")


def dedup_stats(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, chunks, distinct chunks, bytes in, distinct bytes, part of duplicates, ratio, megabytes."""
    per_hash = chunks.groupBy("hash").agg(F.count("*").alias("n"), F.min("size").alias("size"))
    total = per_hash.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"), F.count("*").alias("unique_chunks"), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("input_bytes"), F.coalesce(F.sum("size"), F.lit(0)).alias("unique_bytes"))
    return files.agg(F.count("*").alias("total_files")).join(total).select(
        "total_files",
        "total_chunks",
        "unique_chunks",
        "input_bytes",
        "unique_bytes",
        F.round(100 * (1 - F.col("unique_chunks") / F.greatest("total_chunks", F.lit(1))), 6).alias("dedup_percent"),
        F.round(ratio(F.col("input_bytes"), F.col("unique_bytes")), 6).alias("dedup_ratio"),
        F.round(F.col("input_bytes") / 1e6, 6).alias("input_mb"),
    )


def ratio(whole: Column, part: Column) -> Column:
    """whole / part, 1.0 where there is no part."""
    return F.when(part == 0, 1.0).otherwise(whole / part)


def new_chunks(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """The first occurrences among ``incoming`` whose hash is not in ``known(hash)``."""
    return first_seen(incoming.join(known.select("hash"), "hash", "left_anti"))


def shared_chunks(left: DataFrame, right: DataFrame) -> DataFrame:
    """The distinct hashes that both sides have."""
    return left.select("hash").distinct().join(right.select("hash"), "hash", "left_semi")
