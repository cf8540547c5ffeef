"""Archives: pack, append, read, list, inspect, verify, unpack, as Parquet tables with a committed version."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.functions.chunking import chunk_files
from lodestore.functions.codecs import train_dictionary
from lodestore.functions.columns import decrypted, encrypted, flat_name, safe_path, verified, with_key
from lodestore.operators.blocks import BLOCK_BYTES, SOLID_BYTES, block_offsets, pack_blocks, pieces_of, plan_blocks, whole_of
from lodestore.operators.dedup import first_seen, ratio, with_ordinal
from lodestore.operators.stats import Metrics
from lodestore.schemas import SUMMARY
from lodestore.session import ship

#: Bytes of distinct chunks, in first-seen order, from which a dictionary is trained; and its largest size.
DICTIONARY_SAMPLE, DICTIONARY_BYTES = 1 << 20, 112_640
#: A plan of so many chunks (32 bytes each) is broadcast; a longer one is joined by a shuffle.
BROADCAST_CHUNKS = 500_000
#: So many files of so many chunks are read by their keys: their blocks are looked up and nothing else moves.
FEW_FILES, FEW_CHUNKS = 1000, 100_000
TABLES = ("files", "file_chunks", "chunks", "blocks")


class Archive:
    """A committed state of an archive folder. Versions without a summary row are not seen by readers."""

    def __init__(self, spark: SparkSession, path: str, key: bytes | None = None):
        self.spark, self.path, self.key = ship(spark), path.rstrip("/"), key
        try:
            self.versions = spark.read.schema(SUMMARY).parquet(f"{self.path}/summary")
            self.last = self.versions.orderBy(F.desc("version")).first()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            self.last = None
        if self.last is None:
            raise FileNotFoundError(f"no archive at {path}")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("part") <= self.last["version"])

    @property
    def files(self) -> DataFrame:
        """(file_id, file_ord, original_size, n_chunks)"""
        return self._table("files").drop("part")

    @property
    def file_chunks(self) -> DataFrame:
        return self._table("file_chunks").drop("part")

    @property
    def chunks(self) -> DataFrame:
        return self._table("chunks").drop("part")

    @property
    def blocks(self) -> DataFrame:
        return self._table("blocks").drop("part")

    def summary(self) -> DataFrame:
        return self.versions.where(F.col("version") == self.last["version"])

    # listing and lookups

    def file_ids(self) -> DataFrame:
        return self.files.orderBy("file_ord").select("file_id")

    def __len__(self) -> int:
        return self.files.count()

    def record(self, file_id: str, latest: bool = False):
        """The first file of that id (the last one if ``latest``); KeyError if there is none."""
        order = F.desc("file_ord") if latest else F.asc("file_ord")
        row = self.files.where(F.col("file_id") == file_id).orderBy(order).first()
        if row is None:
            raise KeyError(file_id)
        return row

    def file_size(self, file_id: str) -> int | None:
        row = self.files.where(F.col("file_id") == file_id).orderBy("file_ord").first()
        return None if row is None else row["original_size"]

    def placed(self) -> DataFrame:
        """``files`` with their ``place`` in the listing: file_ord itself, or its rank if there are gaps."""
        most = self.files.agg(F.max("file_ord")).first()[0]
        if most is None or most + 1 == self.last["total_files"]:
            return self.files.withColumn("place", F.col("file_ord"))
        return with_ordinal(self.files, "file_ord", [], "place")

    def at(self, index: int | slice) -> DataFrame:
        """The file at a position of the listing, or those of a slice."""
        if isinstance(index, slice):
            lo, hi, step = index.indices(len(self))
            place = F.col("place")
            inside = (place >= lo) & (place < hi) if step > 0 else (place <= lo) & (place > hi)
            return self.placed().where(inside & (F.pmod(place - lo, F.lit(abs(step))) == 0)).orderBy("place" if step > 0 else F.desc("place")).drop("place")
        n = len(self)
        if not -n <= index < n:
            raise IndexError(index)
        return self.placed().where(F.col("place") == index % n).drop("place")

    def select(self, indices: Iterable[int]) -> DataFrame:
        """Files at these positions in the given order, repeats kept."""
        asked = self.spark.createDataFrame(list(enumerate(indices)), "at long, place long")
        return self.placed().join(asked, "place").orderBy("at").drop("at", "place")

    def listing(self) -> DataFrame:
        """(name, size, collides): a flat folder view, "/" as "_"; ``collides`` marks names of several files."""
        from pyspark.sql.window import Window

        named = self.files.select(flat_name(F.col("file_id")).alias("name"), F.col("original_size").alias("size"))
        return named.withColumn("collides", F.count("*").over(Window.partitionBy("name")) > 1)

    # bytes

    def read(self, condition: Column | None = None, metrics: Metrics | None = None) -> DataFrame:
        """(file_id, file_ord, bytes) of the files that meet a condition on ``files``, byte for byte.

        Only blocks that hold their chunks are read, each is decoded once. A missing chunk, a changed block or a wrong
        total size is an error. ``metrics`` counts the blocks and bytes that tasks read and decode.
        """
        files, recipe, chunks, few = self.files, self.file_chunks, self.chunks, False
        if condition is not None:
            files = files.where(condition)
            ords = [r["file_ord"] for r in files.select("file_ord").limit(FEW_FILES + 1).collect()]
            few = len(ords) <= FEW_FILES and (files.agg(F.sum("n_chunks")).first()[0] or 0) <= FEW_CHUNKS
            if few:
                files = files.where(F.col("file_ord").isin(ords))
                recipe = recipe.where(F.col("file_ord").isin(ords))
                chunks = chunks.join(F.broadcast(recipe.select("hash").distinct()), "hash", "left_semi")
            else:
                recipe = recipe.join(files.select("file_ord"), "file_ord", "left_semi")
        places = chunks.select("hash", "block_id", "inner_offset", F.col("original_size").alias("size"))
        recipe = recipe.select("file_ord", "pos", "hash")
        placed = recipe.join(F.broadcast(places) if few else places, "hash", "left")
        blocks = self.blocks
        payload = verified(F.col("payload"), F.col("crc32"))
        if self.key is not None:
            blocks = with_key(blocks, self.key, "__key")
            payload = F.when(F.col("encrypted"), decrypted(payload, F.col("__key"))).otherwise(payload)
        else:
            payload = F.when(F.col("encrypted"), F.raise_error(F.lit("the archive is encrypted and no key was given"))).otherwise(payload)
        dictionaries = {str(r["version"]): bytes(r["dictionary"]) for r in self.versions.where("dictionary is not null").select("version", "dictionary").collect()}
        return whole_of(files, pieces_of(blocks, placed, payload, dictionaries, metrics, few))

    def read_file(self, file_id: str) -> bytes:
        ord_ = self.record(file_id)["file_ord"]
        return bytes(self.read(F.col("file_ord") == ord_).first()["bytes"])

    __getitem__ = read_file

    def byte_range(self, file_id: str, offset: int, length: int) -> bytes:
        ord_ = self.record(file_id)["file_ord"]
        return bytes(self.read(F.col("file_ord") == ord_).select(F.substring("bytes", offset + 1, length).alias("b")).first()["b"])

    def verify(self, originals: DataFrame) -> DataFrame:
        """One row (passed, failed): files of this archive and of ``originals(file_id, bytes)`` compared by SHA-256."""
        ours = self.read().select("file_id", F.sha2("bytes", 256).alias("ours"))
        theirs = originals.select("file_id", F.sha2("bytes", 256).alias("theirs"))
        same = ours.join(theirs, "file_id").select((F.col("ours") == F.col("theirs")).alias("same"))
        return same.agg(F.count_if("same").alias("passed"), F.count_if(~F.col("same")).alias("failed"))

    def info(self) -> DataFrame:
        """One row of statistics; stored bytes as distinct blocks and as the naive sum over chunk rows."""
        blocks = self.blocks.select("block_id", "stored_size", "encrypted", "dictionary_id")
        totals = self.files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("original_size"), F.lit(0)).alias("original_bytes"), F.coalesce(F.sum("n_chunks"), F.lit(0)).cast("long").alias("chunk_refs"))
        stored = blocks.agg(F.count("*").alias("total_blocks"), F.coalesce(F.sum("stored_size"), F.lit(0)).alias("stored_bytes"), F.coalesce(F.bool_or("encrypted"), F.lit(False)).alias("encrypted"), (F.count("dictionary_id") > 0).alias("has_dictionary"))
        naive = self.chunks.join(blocks.select("block_id", "stored_size"), "block_id").agg(F.count("*").alias("total_chunks"), F.coalesce(F.sum("stored_size"), F.lit(0)).alias("stored_bytes_naive"))
        return totals.join(stored).join(naive).withColumn("storage_ratio", ratio(F.col("original_bytes"), F.col("stored_bytes")))

    def unpack(self, folder: str, condition: Column | None = None) -> int:
        """Writes the files below a folder that all executors see; an absolute id or one with ".." is an error."""
        rows = self.read(condition).select(F.when(safe_path(F.col("file_id")), F.col("file_id")).otherwise(F.raise_error(F.concat(F.lit("unsafe id "), "file_id"))).alias("file_id"), "bytes")

        def write(part):
            import os

            for r in part:
                target = os.path.join(folder, r["file_id"])
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as f:
                    f.write(r["bytes"])

        rows.foreachPartition(write)
        return self.files.count() if condition is None else self.files.where(condition).count()

    def append(self, files: DataFrame, **options) -> int:
        """Adds files; returns the number of new chunks. Codec, key and dictionary carry over."""
        return write_version(self.spark, self.path, files, previous=self, key=self.key, **options)


def write_version(spark: SparkSession, path: str, files: DataFrame, previous: Archive | None, name: str = "archive", codec: str | None = None, level: int = 3, dictionary: bool = False, key: bytes | None = None, limit: int = BLOCK_BYTES, mode: str = "dedup", batch_id: int | None = None, chunked: DataFrame | None = None) -> int:
    """Writes one version: data tables first, the summary row last as the commit."""
    version = 0 if previous is None else previous.last["version"] + 1
    last = None if previous is None else previous.last
    codec = codec or (previous.blocks.select("codec").first() or ["zstd"])[0] if previous is not None else codec or "zstd"
    put = lambda df, table: df.write.mode("overwrite").parquet(f"{path}/{table}/part={version}")
    own = lambda table: spark.read.parquet(f"{path}/{table}/part={version}")
    # behind the largest position, as positions may have gaps
    base_file = 0 if previous is None else previous.files.agg(F.coalesce(F.max("file_ord") + 1, F.lit(0))).first()[0]
    base = (0, 0, 0) if previous is None else previous.chunks.agg(F.coalesce(F.max("first_seen") + 1, F.lit(0)), F.coalesce(F.max("block_id") + 1, F.lit(0))).first() + previous.blocks.agg(F.coalesce(F.max(F.col("offset") + F.col("stored_size")), F.lit(0))).first()

    # chunk once: the data waits in a scratch table that is no part of the archive
    scratch = f"{path}/_scratch-{uuid.uuid4().hex}"
    if chunked is None:
        chunked = chunk_files(files) if mode == "dedup" else whole_files(files)
    chunked.withColumn("file_ord", F.col("file_ord") + base_file).write.option("compression", "zstd").parquet(scratch)
    chunked = spark.read.parquet(scratch)
    recipe = chunked.select("file_id", "file_ord", "pos", "hash", "size")
    put(recipe.drop("size"), "file_chunks")
    sizes = recipe.groupBy("file_ord").agg(F.sum("size").alias("original_size"), F.count("*").cast("int").alias("n_chunks"))
    named = files.select("file_id", (F.col("file_ord") + base_file).alias("file_ord")).join(sizes, "file_ord", "left")
    put(named.select("file_id", "file_ord", F.coalesce("original_size", F.lit(0)).alias("original_size"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")), "files")

    # nothing is committed yet: two files of one position would be joined to one when read
    if own("files").groupBy("file_ord").count().where("count > 1").limit(1).count():
        raise ValueError("several files have one file_ord")

    fresh = recipe if previous is None else recipe.join(previous.chunks.select("hash"), "hash", "left_anti")
    unique = with_ordinal(first_seen(fresh), "file_ord", ["pos"], "first_seen")
    plan = plan_blocks(unique, limit if mode == "dedup" else (0 if mode == "speed" else SOLID_BYTES), strict=mode == "size")
    plan = plan.select("hash", F.col("size").alias("original_size"), (F.col("block_id") + base[1]).alias("block_id"), "inner_offset", (F.col("first_seen") + base[0]).alias("first_seen"), "file_ord", "pos")
    plan.write.parquet(f"{scratch}-plan")
    firsts = spark.read.parquet(f"{scratch}-plan")
    put(firsts.drop("file_ord", "pos"), "chunks")
    plan = own("chunks")
    sample = None
    if dictionary:
        # bounded by DICTIONARY_SAMPLE: the first distinct chunks up to the first that brings them above it
        head = plan.select("hash", "first_seen", "original_size").orderBy("first_seen").limit(DICTIONARY_SAMPLE // 64).collect()
        want, total = [], 0
        for r in head:
            want.append((r["hash"],))
            total += r["original_size"]
            if total > DICTIONARY_SAMPLE:
                break
        rows = chunked.join(F.broadcast(spark.createDataFrame(want, "hash string")), "hash").dropDuplicates(["hash"]).select("hash", "data").collect() if want else []
        sample = train_dictionary([bytes(r["data"]) for r in sorted(rows, key=lambda r: r["hash"])], DICTIONARY_BYTES)
    # the data of each new chunk's first occurrence moves to its block; a short plan goes to where the data is
    n_new = plan.count()
    placed = firsts.select("file_ord", "pos", "block_id", "inner_offset")
    data = chunked.select("file_ord", "pos", "data").join(F.broadcast(placed) if n_new <= BROADCAST_CHUNKS else placed, ["file_ord", "pos"])
    packed = pack_blocks(data, codec, level, sample)
    if key is not None:
        packed = with_key(packed, key, "__key").select("block_id", encrypted(F.col("payload"), F.col("__key")).alias("payload"))
    packed = packed.select("block_id", F.octet_length("payload").cast("long").alias("stored_size"), F.crc32("payload").alias("crc32"), F.lit(codec).alias("codec"), F.lit(key is not None).alias("encrypted"), F.lit(str(version) if sample else None).cast("string").alias("dictionary_id"), "payload")
    packed.write.parquet(f"{scratch}-blocks")
    packed = spark.read.parquet(f"{scratch}-blocks")
    offsets = block_offsets(packed.select("block_id", "stored_size"), base[2]).select("block_id", "offset")
    # two numbers a block go to the blocks, not the blocks to them
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_CHUNKS else offsets
    put(packed.join(offsets, "block_id").select("block_id", "offset", "stored_size", "crc32", "codec", "encrypted", "dictionary_id", "payload"), "blocks")
    delete(spark, scratch)
    for part in ("plan", "blocks"):
        delete(spark, f"{scratch}-{part}")

    files_row = own("files").agg(F.count("*"), F.coalesce(F.sum("original_size"), F.lit(0))).first()
    unique_bytes = plan.agg(F.coalesce(F.sum("original_size"), F.lit(0))).first()[0]
    stored = own("blocks").agg(F.coalesce(F.sum("stored_size"), F.lit(0))).first()[0]
    old = (0, 0, 0, 0, 0) if last is None else tuple(last[c] for c in ("total_files", "total_original_bytes", "total_chunks", "total_unique_bytes", "total_stored_bytes"))
    total_files, original, total_chunks, unique_total, stored_total = (a + b for a, b in zip(old, (files_row[0], files_row[1], n_new, unique_bytes, stored), strict=True))
    row = (version, name if last is None else last["name"], total_files, total_chunks, original / unique_total if unique_total else 1.0, original / stored_total if stored_total else 1.0, original, unique_total, stored_total, key is not None or bool(last and last["encrypted"]), bytearray(sample) if sample else None, batch_id)
    spark.createDataFrame([row], SUMMARY).coalesce(1).write.mode("append").parquet(f"{path}/summary")
    return n_new


def whole_files(files: DataFrame) -> DataFrame:
    """Each file as one chunk (empty files have none), keyed by its position: nothing is deduplicated."""
    return files.where(F.octet_length("bytes") > 0).select("file_id", "file_ord", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("offset"), F.octet_length("bytes").cast("long").alias("size"), F.concat(F.sha2("bytes", 256), F.lit("-"), F.col("file_ord").cast("string")).alias("hash"), F.col("bytes").alias("data"))


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def pack(files: DataFrame, path: str, name: str = "archive", mode: str = "dedup", codec: str = "zstd", level: int = 3, dictionary: bool = False, key: bytes | None = None, limit: int = BLOCK_BYTES, chunked: DataFrame | None = None) -> Archive:
    """Packs ``files(file_id, file_ord, bytes)`` into an archive folder.

    ``file_ord`` orders the files and names each once; gaps are allowed, a repeated one is an error. Ids may repeat: a
    lookup takes the first. ``mode``: "dedup" (content-defined chunks, solid blocks of ``limit`` bytes), "speed" (a block per file) or "size"
    (whole files in solid blocks of more than 64 MiB). ``chunked`` takes the rows of ``chunk_files`` made elsewhere.
    """
    if mode not in ("dedup", "speed", "size"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = ship(files.sparkSession)
    write_version(spark, path.rstrip("/"), files, None, name, codec, level, dictionary, key, limit, mode, chunked=chunked)
    return Archive(spark, path, key)
