"""Block codecs: a tag byte, then zstd (optionally with a dictionary) or LZ4 with a four-byte length."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

# Tag bytes of the codecs, and the largest output of one block.
ZSTD_TAG, LZ4_TAG = 1, 2
MAX_OUTPUT = 512 << 20
LEVEL = 3

TAGS = {"zstd": ZSTD_TAG, "lz4": LZ4_TAG}


def codec_of(tag: int) -> str | None:
    return next((name for name, t in TAGS.items() if t == tag), None)


def compress(data: bytes, codec: str = "zstd", level: int = LEVEL, dictionary: bytes | None = None) -> bytes:
    if codec == "lz4":
        return bytes([LZ4_TAG]) + len(data).to_bytes(4, "little") + pa.Codec("lz4_raw").compress(data, asbytes=True)
    if codec != "zstd":
        raise ValueError(f"unknown codec {codec!r}")
    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return bytes([ZSTD_TAG]) + zstandard.ZstdCompressor(level=level, dict_data=own).compress(data)


def _unzstd(data: bytes, dictionary: bytes | None) -> bytes:
    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    with zstandard.ZstdDecompressor(dict_data=own).stream_reader(data) as reader:
        out = reader.read(MAX_OUTPUT + 1)
    if len(out) > MAX_OUTPUT:
        raise ValueError("decompressed block is too large")
    return out


def decompress(data: bytes, dictionary: bytes | None = None) -> bytes:
    """Undoes ``compress``; bytes without a known tag are a plain zstd frame, empty input is an error."""
    if not data:
        raise ValueError("empty block")
    if data[0] == ZSTD_TAG:
        return _unzstd(data[1:], dictionary)
    if data[0] == LZ4_TAG:
        size = int.from_bytes(data[1:5], "little")
        if size > MAX_OUTPUT:
            raise ValueError("decompressed block is too large")
        return pa.Codec("lz4_raw").decompress(data[5:], decompressed_size=size, asbytes=True) if size else b""
    return _unzstd(data, dictionary)


def train_dictionary(samples: Iterable[bytes], size: int = 112_640) -> bytes | None:
    """A zstd dictionary of at most ``size`` bytes; None if the samples don't suffice."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if samples else None
    except zstandard.ZstdError:
        return None


def compress_udf(codec: str = "zstd", level: int = LEVEL, dictionary: bytes | None = None) -> Callable:
    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else compress(bytes(b), codec, level, dictionary))

    return run


def decompress_udf(dictionary: bytes | None = None) -> Callable:
    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else decompress(bytes(b), dictionary))

    return run
