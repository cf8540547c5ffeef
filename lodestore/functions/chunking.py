"""Content-defined chunking after the published FastCDC algorithm, over whole Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Sizes in bytes.
MIN_SIZE, AVG_SIZE, MAX_SIZE = 2048, 8192, 65536

_U = np.uint64
#: The gear table: the first eight bytes of the MD5 of 64 copies of each byte.
GEAR = np.array([int.from_bytes(hashlib.md5(bytes([b]) * 64).digest()[:8], "big") for b in range(256)], dtype=np.uint64)


def _mask(bits: int) -> np.uint64:
    """Judges by the upper bits, which depend on the last 64 bytes."""
    return _U(((1 << bits) - 1) << (64 - bits))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash h = 2h + G[byte] (mod 2**64) behind each byte; it depends on the last 64 bytes, so six doubling
    steps give all of them."""
    h = GEAR[data]
    for k in range(6):
        step = 1 << k
        moved = np.zeros_like(h)
        moved[step:] = h[:-step] << _U(step)
        h = h + moved
    return h


def cut_points(data: bytes, least: int = MIN_SIZE, normal: int = AVG_SIZE, most: int = MAX_SIZE) -> list[int]:
    """Ends of the chunks of ``data``; no chunk for empty data, one for up to ``least`` bytes.

    From ``least`` bytes into a chunk on, it ends behind the first byte whose hash has ``log2(normal) + 1`` zero bits,
    from ``normal`` bytes on one bit less than log2 suffices, at ``most`` bytes it ends anyway.
    """
    n = len(data)
    if n <= least:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    hashes = gear_hashes(raw)
    bits = normal.bit_length() - 1
    strict, loose = _mask(bits + 1), _mask(bits - 1)
    hard, easy = np.flatnonzero((hashes & strict) == 0), np.flatnonzero((hashes & loose) == 0)
    ends, start = [], 0
    while n - start > least:
        first, centre, last = start + least, min(start + normal, n), min(start + most, n)
        # the hash starts anew behind the skipped bytes: its first 63 values lack older bytes
        warm, h, cut = min(first + 63, last), 0, 0
        for i in range(first, warm):
            h = ((h << 1) + int(GEAR[raw[i]])) & 0xFFFFFFFFFFFFFFFF
            if not h & int(strict if i < centre else loose):
                cut = i + 1
                break
        if not cut:
            a = np.searchsorted(hard, warm)
            if a < len(hard) and hard[a] < centre:
                cut = int(hard[a]) + 1
            else:
                b = np.searchsorted(easy, max(warm, centre))
                cut = int(easy[b]) + 1 if b < len(easy) and easy[b] < last else last
        ends.append(cut)
        start = cut
    if start < n:
        ends.append(n)
    return ends


def chunk_files(files: DataFrame, with_data: bool = True, least: int = MIN_SIZE, normal: int = AVG_SIZE, most: int = MAX_SIZE) -> DataFrame:
    """(file_id, file_ord, pos, offset, size, hash[, data]) for each chunk of ``files(file_id, file_ord, bytes)``.

    ``hash`` is the SHA-256 as hex. Without data only the short rows leave the Python worker.
    """
    fields = [("file_id", pa.string()), ("file_ord", pa.int64()), ("pos", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("hash", pa.string())]
    schema = pa.schema(fields + [("data", pa.binary())] * with_data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in schema]
            held = 0
            for i in range(b.num_rows):
                data = b.column(2)[i].as_py() or b""
                at = 0
                for pos, end in enumerate(cut_points(data, least, normal, most)):
                    piece = data[at:end]
                    row = (b.column(0)[i].as_py(), b.column(1)[i].as_py(), pos, at, end - at, hashlib.sha256(piece).hexdigest(), piece)
                    for col, v in zip(out, row, strict=False):
                        col.append(v)
                    at, held = end, held + (end - at if with_data else 100)
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                    out, held = [[] for _ in schema], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    kind = "file_id string, file_ord long, pos int, offset long, size long, hash string" + ", data binary" * with_data
    return files.select("file_id", "file_ord", "bytes").mapInArrow(run, kind)
