"""Classes of the familiar shape over the DataFrame API: archives by path or URL, samplers, vector index, datasets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lodestore.functions.columns import key_from_env, preview
from lodestore.operators import vectors
from lodestore.operators.archive import Archive as _Archive
from lodestore.operators.archive import pack
from lodestore.operators.sampling import DataLoaderCheckpoint, DeterministicSampler
from lodestore.sources import files as sources
from lodestore.sources.container import Container

__all__ = ["Archive", "CloudArchive", "DataLoaderCheckpoint", "Dataset", "DedupArchive", "DeterministicSampler", "VectorIndex", "convert", "load", "pack_directory", "stream_file"]


class _Mapping:
    """``len``, ``ids``, ``a[id]`` over something with files; a missing id is a KeyError, unreadable bytes an OSError."""

    def __init__(self, source):
        self._source = source

    def ids(self) -> list[str]:
        return [r["file_id"] for r in self._source.file_ids().toLocalIterator()]

    def __len__(self) -> int:
        return self._source.files.count()

    def read(self) -> DataFrame:
        return self._source.read()

    def __getitem__(self, file_id: str) -> bytes:
        try:
            if isinstance(self._source, _Archive):
                return self._source.read_file(file_id)
            return bytes(self._source.read(file_id).first()["bytes"])
        except KeyError:
            raise
        except Exception as e:
            raise OSError(f"{file_id} can't be read: {e}") from e


class Archive(_Mapping):
    """An archive folder."""

    def __init__(self, spark: SparkSession, path: str, key: bytes | None = None):
        super().__init__(_Archive(spark, path, key or key_from_env()))

    @property
    def tables(self) -> _Archive:
        return self._source


class DedupArchive(Archive):
    """An archive folder made in dedup mode; reading is the same."""


class CloudArchive(_Mapping):
    """A container file or URL, read by ranges."""

    def __init__(self, spark: SparkSession, url: str, key: bytes | None = None):
        super().__init__(Container(spark, url, key or key_from_env()))


class VectorIndex:
    """An index over ``(file_id, vector)``; every vector has the index's dimension."""

    def __init__(self, spark: SparkSession, dimension: int, table: DataFrame | None = None):
        self.spark, self.dimension = spark, dimension
        self.table = table if table is not None else spark.createDataFrame([], "file_id string, vector array<float>")

    def insert(self, file_id: str, vector: Sequence[float]) -> None:
        if len(vector) != self.dimension:
            raise ValueError(f"{len(vector)} components instead of {self.dimension}")
        self.table = self.table.union(self.spark.createDataFrame([(file_id, [float(x) for x in vector])], self.table.schema))

    def search(self, query: Sequence[float], k: int) -> list[tuple[str, float]]:
        if len(query) != self.dimension:
            raise ValueError(f"{len(query)} components instead of {self.dimension}")
        return [(r["file_id"], r["score"]) for r in vectors.search(self.table, query, k).collect()]

    def __len__(self) -> int:
        return self.table.count()

    def save(self, path: str) -> None:
        vectors.to_json(self.table).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, dimension: int) -> VectorIndex:
        return cls(spark, dimension, vectors.from_json(spark.read.text(path).withColumnRenamed("value", "json")))


class Dataset:
    """Rows ``(file_id, bytes)`` of an archive by position, slice or list of positions, or one after the other."""

    def __init__(self, archive: Archive, transform: Callable[[pd.Series], pd.Series] | None = None):
        self.archive, self.transform = archive, transform

    def __len__(self) -> int:
        return len(self.archive)

    def __getitem__(self, index):
        if isinstance(index, slice):
            return self.rows([r["file_ord"] for r in self.archive.tables.at(index).collect()])
        return self.rows([self.archive.tables.at(index).first()["file_ord"]])[0]

    def select(self, indices: Sequence[int]) -> list[dict]:
        return self.rows(list(indices))

    def rows(self, ords: list[int]) -> list[dict]:
        from pyspark.sql import functions as F

        found = {r["file_ord"]: r for r in self.archive.tables.read(F.col("file_ord").isin(sorted(set(ords)))).collect()}
        return [self._shown(found[o]) for o in ords]

    def __iter__(self) -> Iterator[dict]:
        for r in self.archive.read().orderBy("file_ord").toLocalIterator():
            yield self._shown(r)

    def _shown(self, r) -> dict:
        data = bytes(r["bytes"])
        return {"file_id": r["file_id"], "bytes": self.transform(pd.Series([data]))[0] if self.transform else data}


def load(spark: SparkSession, path: str, streaming: bool = False):
    """A DataFrame (idx, file_id, bytes) of an archive folder, container file or URL; an iterator if ``streaming``."""
    place = path.startswith(("http://", "https://"))
    archive = CloudArchive(spark, path) if place else Archive(spark, path)
    rows = archive.read().withColumnRenamed("file_ord", "idx")
    return rows.orderBy("idx").toLocalIterator() if streaming else rows


def pack_directory(spark: SparkSession, folder: str, path: str, **options) -> _Archive:
    return pack(sources.directory(spark, folder), path, **options)


def convert(spark: SparkSession, source: str, path: str, codec: str = "zstd", level: int = 3) -> _Archive:
    """Packs the entries of a tar or zip archive."""
    return pack(sources.open_any(spark, source), path, codec=codec, level=level)


def stream_file(spark: SparkSession, url: str, file_id: str, output: str | None = None) -> str | int:
    """Saves one file of a container, or returns the first 500 bytes of it as text."""
    rows = Container(spark, url, key_from_env()).read(file_id)
    if output is None:
        return rows.select(preview(rows["bytes"]).alias("p")).first()["p"]
    with open(output, "wb") as f:
        return f.write(rows.first()["bytes"])
