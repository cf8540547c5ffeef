"""What the operators of this package share: shared-folder tables, session settings, label folds."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.session import ship

#: Rows that one Arrow batch holds at most; with whole texts this bounds a Python worker's memory.
BATCH_ROWS = 1000

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all machines see; a temporary one only where that is unset."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="lodestore-")
        import shutil

        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def stash(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: cuts the lineage, survives lost executors.

    ``compact`` is for short rows behind a shuffle: a few files a core instead of one for each shuffle partition.
    """
    return stash_at(df, name, compact)[0]


def stash_at(df: DataFrame, name: str, compact: bool = False) -> tuple[DataFrame, str]:
    """As ``stash``; also returns the path, for ``unstash`` once nothing reads the table any more."""
    spark = df.sparkSession
    if compact:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def unstash(spark: SparkSession, path: str) -> None:
    """Deletes a stashed table that no later step reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the Arrow batches that Python workers get, and lets the workers import this package.

    The session is left at BATCH_ROWS: whoever needs another number stores its results while that holds and calls this
    again, as a frame that isn't stored runs under the number that holds later.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def cell(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold from which no label is learnt: crc32 of its id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Ids up to this number (16 MB) are broadcast when rows are taken out; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def few(ids: DataFrame, most: int = BROADCAST_IDS) -> bool:
    """Whether a stored table is short enough to be broadcast."""
    return ids.limit(most + 1).count() <= most


def among(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` is in the stored table ``ids`` (one column), broadcast only if that is short."""
    return rows.join(F.broadcast(ids) if few(ids) else ids, column, "left_semi")


def apart(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` whose columns named in the stored table ``keys`` stand in none of its rows."""
    return rows.join(F.broadcast(keys) if few(keys) else keys, keys.columns, "left_anti")


def without(rows: DataFrame, ids: DataFrame, column: str = "doc_id", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """``rows`` without those whose id is among ``ids`` (one column); rows with a null id stay."""
    found = stash(ids.select(F.col(ids.columns[0]).alias(column)).where(F.col(column).isNotNull()).distinct(), "ids", compact=True)
    return rows.join(F.broadcast(found) if few(found, broadcast_ids) else found, column, "left_anti").select(*map(cell, rows.columns))
