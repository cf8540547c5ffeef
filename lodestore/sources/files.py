"""Sources: directories, tar and zip archives, SafeTensors files; all read by Spark's own file source."""

from __future__ import annotations

import io
import json
import os
import struct
import tarfile
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestore.functions.columns import basename
from lodestore.session import ship
from lodestore.storage import scratch_path

#: The largest upload (fixed value: 10 GiB).
UPLOAD_BYTES = 10 << 30
#: Files are cells of a table: one may hold 2 GiB at most. So are archives in a store that only Spark reads.
BINARY_FIELDS = "path string, modificationTime timestamp, length long, content binary"


def _binary(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    ship(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)


def with_file_ord(files: DataFrame, key: str = "file_id", then: Column | None = None) -> DataFrame:
    """Adds the position of each row by ``key``, rows of one key by ``then`` (by default the SHA-256 of their bytes).

    The keys and their counts are sorted over ranges, of which one sum each is put together; so no task orders them all.
    Rows move once, to their key's count. Rows that agree in ``then`` too are equal to a reader and stand in any order.
    """
    spark = files.sparkSession
    then = F.sha2("bytes", 256) if then is None else then
    counts = files.groupBy(key).agg(F.count("*").alias("__n"))
    # written, as a range's number must be the same each time it is read
    path = scratch_path(spark, "names")
    counts.repartitionByRange(key).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    counts = spark.read.parquet(path)
    parts = counts.groupBy("__part").agg(F.sum("__n").alias("__total"))
    parts = parts.select("__part", F.coalesce(F.sum("__total").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("__n").over(Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("__inside", inside).join(F.broadcast(parts), "__part").select(F.col(key).alias("__key"), (F.col("__before") + F.col("__inside")).alias("__start"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(then)) - 1
    placed = files.withColumn("__nth", nth).join(starts, F.col(key).eqNullSafe(F.col("__key")))
    return placed.withColumn("file_ord", (F.col("__start") + F.col("__nth")).cast("long")).drop("__nth", "__key", "__start")


def decoded(name: Column) -> Column:
    """A part of a URI as the name that it stands for."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda u: None if u is None else unquote(u))

    return run(name)


def plain_uri(uri: Column) -> Column:
    """One form of a "file:" URI, of which Spark shows rows and listed files with different numbers of slashes."""
    return F.regexp_replace(uri, "^file:/+", "file:/")


def directory(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(file_id, file_ord, bytes) of the regular files of a folder; a file that can't be read is an error."""
    read = _binary(spark, path, recursive)
    found = read.select(basename(F.col("path")).alias("file_id"), "path", F.col("content").alias("bytes"))
    # Spark's readers list files of no bytes but pass over them
    listed = spark.createDataFrame([(u,) for u in read.inputFiles()], "uri string").select(plain_uri(F.col("uri")).alias("uri"))
    lost = listed.join(read.select(plain_uri(F.col("_metadata.file_path")).alias("uri")), "uri", "left_anti")
    empty = lost.distinct().select(decoded(F.col("uri")).alias("path")).select(basename(F.col("path")).alias("file_id"), "path", F.expr("cast('' as binary)").alias("bytes"))
    return with_file_ord(found.union(empty), then=F.col("path")).select("file_id", "file_ord", "bytes")


def _tar_members(file: BinaryIO) -> Iterator[tuple[tarfile.TarFile, tarfile.TarInfo]]:
    with tarfile.open(fileobj=file, mode="r:*") as t:
        while (m := t.next()) is not None:
            if m.isreg():
                yield t, m
            t.members = []  # else it keeps a record of every entry that was passed


def _zip_members(file: BinaryIO) -> Iterator[tuple[zipfile.ZipFile, zipfile.ZipInfo]]:
    with zipfile.ZipFile(file) as z:
        z.NameToInfo.clear()
        for m in z.infolist():
            if not m.is_dir():
                yield z, m


def _opened(path: str, content: bytes | None) -> BinaryIO:
    return io.BytesIO(content) if content is not None else open(_mounted(path), "rb")


def _mounted(path: str) -> str:
    """The path in the mounted file system of a "file:" path as Spark shows it."""
    return "/" + path.removeprefix("file:").lstrip("/")


def _entries(kind: str, with_data: bool):
    """Over (path[, content]): (path, at, file_id, bytes) of the entries, or (path, n, size) of each archive. An archive is
    read one entry at a time; about 16 MB wait to be given on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = _tar_members if kind == "tar" else _zip_members
        for b in batches:
            for i in range(b.num_rows):
                path, rows, held, n, total = b.column(0)[i].as_py(), [], 0, 0, 0
                with _opened(path, b.column(1)[i].as_py() if b.num_columns > 1 else None) as file:
                    for at, (whole, m) in enumerate(members(file)):
                        n, total = n + 1, total + (m.size if kind == "tar" else m.file_size)
                        if with_data:
                            data = whole.extractfile(m).read() if kind == "tar" else whole.read(m)
                            rows.append((path, at, m.name if kind == "tar" else m.filename, data))
                            held += len(data)
                            if held > 16 << 20 or len(rows) == 10_000:
                                yield _batch(rows, _ENTRY)
                                rows, held = [], 0
                yield _batch(rows, _ENTRY) if with_data else _batch([(path, n, total)], _TOTAL)

    return run


_ENTRY = pa.schema([("path", pa.string()), ("at", pa.int64()), ("file_id", pa.string()), ("bytes", pa.binary())])
_TOTAL = pa.schema([("path", pa.string()), ("n", pa.int64()), ("size", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _archive(spark: SparkSession, path: str | list[str], kind: str) -> tuple[DataFrame, DataFrame]:
    """The files of archives, and (path, n, size) of each archive, which is made without reading the files' bytes.

    Archives of the mounted file system are read as they are passed; those of a store that only Spark reads are cells.
    """
    found = _binary(spark, path)
    stored = found.where(~F.col("path").startswith("file:")).select("path").limit(1).count() > 0
    found = found.select("path", "content") if stored else found.select("path").repartition("path")
    totals = found.mapInArrow(_entries(kind, False), "path string, n long, size long")
    before = totals.select("path", F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    entries = found.mapInArrow(_entries(kind, True), "path string, at long, file_id string, bytes binary")
    files = entries.join(F.broadcast(before), "path").select("file_id", (F.col("before") + F.col("at")).alias("file_ord"), "bytes")
    return files, totals


def tar(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_id, file_ord, bytes) of the regular entries of tar, tar.gz and tgz archives, one task an archive."""
    return _archive(spark, path, "tar")[0]


def zipped(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_id, file_ord, bytes) of the file entries of zip archives."""
    return _archive(spark, path, "zip")[0]


def open_any(spark: SparkSession, path: str) -> DataFrame:
    """Files of an archive by its suffix, in either case; an unknown suffix is an error."""
    name = path.lower()
    if name.endswith((".tar", ".tar.gz", ".tgz")):
        return tar(spark, path)
    if name.endswith(".zip"):
        return zipped(spark, path)
    raise ValueError(f"unknown archive format: {path}")


def write_archives(files: DataFrame, folder: str, kind: str = "tar", parts: int = 1) -> None:
    """Writes ``files(file_id, file_ord, bytes)`` as ``parts`` tar or zip archives (kind "tar" or "zip") below a folder
    that all executors see; each archive holds a run of positions in order and is written by one task."""
    if kind not in ("tar", "zip"):
        raise ValueError(f"unknown archive format: {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = None, None
        try:
            for b in batches:
                for i in range(b.num_rows):
                    own, name, data = (b.column(k)[i].as_py() for k in range(3))
                    if own != part:
                        if out is not None:
                            out.close()
                        part, path = own, os.path.join(folder, f"part-{own:05d}.{kind}")
                        out = tarfile.open(path, "w") if kind == "tar" else zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED)
                    if kind == "zip":
                        out.writestr(name, data)
                    else:
                        entry = tarfile.TarInfo(name)
                        entry.size = len(data)
                        out.addfile(entry, io.BytesIO(data))
                        out.members = []  # else it keeps a record of every entry
        finally:
            if out is not None:
                out.close()
        yield from ()

    os.makedirs(folder, exist_ok=True)
    last = files.agg(F.max("file_ord")).first()[0]
    span = ((last or 0) + parts) // parts
    placed = files.select(F.floor(F.col("file_ord") / span).cast("int").alias("part"), "file_id", "bytes", "file_ord")
    ship(files.sparkSession)
    # Spark's sort spills where a part doesn't fit; the writer holds one batch
    placed.repartition("part").sortWithinPartitions("part", "file_ord").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def uploaded(spark: SparkSession, path: str, name: str, most: int = UPLOAD_BYTES) -> DataFrame:
    """(file_id, file_ord, bytes) of a tar archive that is taken in under ``name``, to be packed.

    A name that is empty or could leave a folder, and entries of more than ``most`` bytes in all, are errors.
    """
    if not name or ".." in name or "/" in name or "\\" in name:
        raise ValueError(f"unsafe archive name {name!r}")
    files, totals = _archive(spark, path, "tar")
    if (totals.agg(F.sum("size")).first()[0] or 0) > most:
        raise ValueError(f"the upload is larger than {most} bytes")
    return files


def write_tensors(rows: DataFrame, folder: str, parts: int = 1) -> None:
    """Writes ``rows(name, vector)`` as ``parts`` SafeTensors files of one-dimensional 32-bit floats below a shared folder."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        path, header, at = os.path.join(folder, f"part-{key[0]:05d}.safetensors"), {}, 0
        rows = pdf.sort_values("name")
        data = [np.asarray(v, "<f4").tobytes() for v in rows["vector"]]
        for name, x in zip(rows["name"], data, strict=True):
            header[name] = {"dtype": "F32", "shape": [len(x) // 4], "data_offsets": [at, at + len(x)]}
            at += len(x)
        head = json.dumps(header).encode()
        with open(path, "wb") as f:
            f.write(struct.pack("<Q", len(head)) + head + b"".join(data))
        return pd.DataFrame({"path": [path]})

    os.makedirs(folder, exist_ok=True)
    ship(rows.sparkSession)
    placed = rows.select("name", "vector", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int").alias("part"))
    placed.groupBy("part").applyInPandas(run, "path string").write.format("noop").mode("overwrite").save()


def _tensors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            content = bytes(content)
            if len(content) < 8:
                raise ValueError(f"{path}: too short for a SafeTensors header")
            (size,) = struct.unpack("<Q", content[:8])
            if size > len(content) - 8:
                raise ValueError(f"{path}: the header is longer than the file")
            for name, x in json.loads(content[8 : 8 + size]).items():
                if name != "__metadata__":
                    start, stop = x["data_offsets"]
                    rows.append((path, name, x["shape"], x["dtype"], 8 + size + start, stop - start))
        yield pd.DataFrame(rows, columns=["path", "name", "shape", "dtype", "offset", "length"])


def tensors(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, name, shape, dtype, offset, length) of the tensors of SafeTensors files, by name."""
    found = _binary(spark, path).select("path", "content").mapInPandas(_tensors, "path string, name string, shape array<long>, dtype string, offset long, length long")
    return found.orderBy("path", "name")


def tensor_bytes(spark: SparkSession, path: str, name: str) -> bytes:
    row = tensors(spark, path).where(F.col("name") == name).first()
    if row is None:
        raise KeyError(name)
    data = _binary(spark, path).where(F.col("path") == row["path"]).select(F.expr(f"substring(content, {row['offset'] + 1}, {row['length']})").alias("b"))
    return bytes(data.first()["b"])
