"""Solid blocks: planning, packing, decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.functions.codecs import compress, compress_udf, decompress
from lodestore.operators.dedup import running_sum
from lodestore.operators.stats import Metrics

# A block is closed at 4 MiB; the per-file mode's solid blocks at more than 64 MiB.
BLOCK_BYTES = 4 << 20
SOLID_BYTES = 64 << 20
#: Chunks that one planning task folds; a block never crosses such a border.
SEGMENT_CHUNKS = 1 << 20


def fold(sizes: np.ndarray, limit: int, strict: bool = False, held: int = 0) -> np.ndarray:
    """Block ordinals: a block is closed by the chunk that brings it to ``limit`` bytes (above it if ``strict``). The first
    block holds ``held`` bytes already."""
    total = np.cumsum(sizes)
    out, start, block, before = np.zeros(len(sizes), np.int64), 0, 0, -held
    while start < len(sizes):
        end = max(start, int(np.searchsorted(total, before + limit, side="right" if strict else "left"))) + 1
        out[start:end] = block
        start, block = end, block + 1
        before = int(total[min(end, len(sizes)) - 1])
    return out


def plan_blocks(unique: DataFrame, limit: int = BLOCK_BYTES, strict: bool = False, segment: int = SEGMENT_CHUNKS) -> DataFrame:
    """``unique(hash, size, first_seen, file_ord, pos)`` with block_id and inner_offset.

    Chunks fill blocks in first-seen order. Only these short rows move; a segment of ``segment`` chunks is folded by one
    task, batch by batch, so the plan of a large archive is made in parallel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block, held = None, 0, 0
        for whole in batches:
            segments = whole.column("segment").to_numpy()
            borders = np.flatnonzero(np.diff(segments)) + 1
            for start, end in zip(np.append(0, borders), np.append(borders, len(segments)), strict=True):
                if start == end:
                    continue
                b, sizes = whole.slice(start, end - start), whole.column("size").to_numpy()[start:end]
                if own != segments[start]:
                    own, block, held = segments[start], 0, 0
                blocks = fold(sizes, limit, strict, held)
                total = np.cumsum(sizes)
                heads = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
                # bytes of this batch before each block; the first one has ``held`` bytes from before
                bases = (total - sizes)[heads]
                bases[0] -= held
                inner = total - sizes - bases[blocks]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(own * segment + block + blocks), pa.array(inner)], names=names)
                held = int(inner[-1] + sizes[-1])
                block += int(blocks[-1])
                if held > limit if strict else held >= limit:
                    block, held = block + 1, 0

    names = ["hash", "size", "first_seen", "file_ord", "pos", "block_id", "inner_offset"]
    cut = unique.select("hash", "size", "first_seen", "file_ord", "pos", F.floor(F.col("first_seen") / segment).alias("segment"))
    cut = cut.repartition("segment").sortWithinPartitions("segment", "first_seen")
    return cut.mapInArrow(run, "hash string, size long, first_seen long, file_ord long, pos int, block_id long, inner_offset long")


def pack_blocks(planned: DataFrame, codec: str = "zstd", level: int = 3, dictionary: bytes | None = None) -> DataFrame:
    """(block_id, payload) for ``planned(block_id, inner_offset, data)``: chunks in order, compressed together. A task holds
    one block and a batch."""

    def packed(block: int, pieces: list[bytes]) -> pa.RecordBatch:
        payload = compress(b"".join(pieces), codec, level, dictionary)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([payload], pa.binary())], names=["block_id", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pieces = None, []
        for b in batches:
            for i, block in enumerate(b.column(0).to_pylist()):
                if block != own:
                    if pieces:
                        yield packed(own, pieces)
                    own, pieces = block, []
                pieces.append(b.column(1)[i].as_py())
        if pieces:
            yield packed(own, pieces)

    ordered = planned.select("block_id", "data", "inner_offset").repartition("block_id").sortWithinPartitions("block_id", "inner_offset")
    return ordered.select("block_id", "data").mapInArrow(run, "block_id long, payload binary")


def block_offsets(blocks: DataFrame, start: int = 0) -> DataFrame:
    """Adds each block's offset: ``start`` and the stored sizes of the blocks before it."""
    return running_sum(blocks, "block_id", "stored_size", "offset").withColumn("offset", F.col("offset") + F.lit(start))


def decode_blocks(blocks: DataFrame, dictionaries: dict[str, bytes], metrics: Metrics | None = None) -> DataFrame:
    """(file_ord, pos, data) for ``blocks(dictionary_id, payload, uses)``, uses being structs (file_ord, pos, inner_offset,
    size): each block is decoded once and cut where it is decoded, so that no row carries a whole block to its uses."""

    def cut(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["file_ord", "pos", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for i in range(b.num_rows):
                d, p = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                raw = decompress(p, dictionaries.get(d))
                if metrics is not None:
                    for name, n in (("blocks_decompressed", 1), ("bytes_read", len(p)), ("bytes_written", len(raw))):
                        metrics.add(name, n)
                uses = b.column(2)[i].values
                for file_ord, pos, at, size in zip(*(uses.field(k).to_pylist() for k in ("file_ord", "pos", "inner_offset", "size")), strict=True):
                    rows.append((file_ord, pos, raw[at : at + size]))
                    held += size
                    if held > 16 << 20 or len(rows) == 10_000:
                        yield cut(rows)
                        rows, held = [], 0
        yield cut(rows)

    return blocks.select("dictionary_id", "payload", "uses").mapInArrow(run, "file_ord long, pos int, data binary")


def pieces_of(blocks: DataFrame, placed: DataFrame, payload: Column, dictionaries: dict[str, bytes], metrics: Metrics | None = None, few: bool = False) -> DataFrame:
    """(file_ord, pos, data) for ``placed(file_ord, pos, hash, block_id, inner_offset, size)`` out of ``blocks(block_id,
    dictionary_id, ...)`` with their ``payload``. A hash without a place or a block is an error; ``few`` places are broadcast.
    """
    missing = F.raise_error(F.concat(F.lit("missing chunk "), F.col("any")))
    uses = placed.groupBy("block_id").agg(F.collect_list(F.struct("file_ord", "pos", "inner_offset", "size")).alias("uses"), F.min("hash").alias("any"))
    there = blocks.withColumn("__there", F.lit(True))
    if few:
        asked = {r["block_id"]: r["any"] for r in uses.select("block_id", "any").collect()}
        there = there.where(F.col("block_id").isin([i for i in asked if i is not None]))
        held = {r["block_id"] for r in there.select("block_id").collect()}
        for i, any_ in asked.items():
            if i not in held:
                raise ValueError(f"missing chunk {any_}")
        found = there.join(F.broadcast(uses), "block_id")
    else:
        found = uses.join(there, "block_id", "left")
    own = found.select("dictionary_id", F.when(F.col("__there").isNull(), missing).otherwise(payload).alias("payload"), "uses")
    return decode_blocks(own, dictionaries, metrics)


def whole_of(files: DataFrame, pieces: DataFrame) -> DataFrame:
    """(file_id, file_ord, bytes) of ``files(file_id, file_ord, original_size)``, put together from ``pieces(file_ord, pos,
    data)``; a wrong total size is an error. Each file's own row goes with its pieces, so that their data moves once."""
    heads = files.select("file_ord", F.lit(-1).alias("pos"), F.expr("cast('' as binary)").alias("data"), "file_id", "original_size", F.lit(True).alias("head"))
    rows = heads.union(pieces.select("file_ord", "pos", "data", F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("boolean")))
    whole = rows.groupBy("file_ord").agg(F.max("file_id").alias("file_id"), F.max("original_size").alias("original_size"), F.max("head").alias("head"), F.expr("listagg(data) within group (order by pos)").alias("bytes"))
    right = F.octet_length("bytes") == F.col("original_size")
    bytes_ = F.when(right, F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("wrong size of "), "file_id")))
    return whole.where("head").select("file_id", "file_ord", bytes_.alias("bytes"))


def compared(files: DataFrame, codec: str = "zstd", level: int = 3, block: int = BLOCK_BYTES) -> DataFrame:
    """(mode, units, original_bytes, stored_bytes) of ``files(file_ord, bytes)`` compressed file by file and in solid blocks.

    A solid block holds the files of consecutive positions that start within the same ``block`` bytes.
    """
    sized = files.select("file_ord", "bytes", F.octet_length("bytes").cast("long").alias("size"))
    placed = running_sum(sized, "file_ord", "size", "at").withColumn("unit", F.floor(F.col("at") / block))

    def solid(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("file_ord")
        raw = b"".join(x.as_py() for x in rows.column("bytes").combine_chunks())
        return pa.table({"original": pa.array([len(raw)], pa.int64()), "stored": pa.array([len(compress(raw, codec, level))], pa.int64())})

    each = sized.select(F.lit("per_file").alias("mode"), F.col("size").alias("original"), F.octet_length(compress_udf(codec, level)("bytes")).cast("long").alias("stored"))
    blocks = placed.select("unit", "file_ord", "bytes").groupBy("unit").applyInArrow(solid, "original long, stored long").select(F.lit("solid").alias("mode"), "original", "stored")
    return each.union(blocks).groupBy("mode").agg(F.count("*").alias("units"), F.sum("original").alias("original_bytes"), F.sum("stored").alias("stored_bytes"))
