"""Column functions: hashes, hex, checksums, encryption, names, previews. All but the preview stay in the JVM."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Environment variable that holds an archive key as 64 hex digits.
KEY_VARIABLE = "LODESTORE_KEY"
#: Bytes of nonce and tag around an AES-GCM ciphertext.
CIPHER_OVERHEAD = 28


def hash_to_hex(h: Column) -> Column:
    return F.lower(F.hex(h))


def hex_to_hash(text: Column) -> Column:
    """The 32 bytes of a 64-digit hex string; an error for any other text."""
    ok = text.rlike("^[0-9a-fA-F]{64}$")
    return F.when(text.isNull(), F.lit(None)).when(ok, F.unhex(text)).otherwise(F.raise_error(F.concat(F.lit("not a 64-digit hex hash: "), text)))


def verified(payload: Column, crc: Column) -> Column:
    """The payload if its CRC-32 is as stored, else an error."""
    return F.when(F.crc32(payload) == crc, payload).otherwise(F.raise_error(F.lit("block checksum mismatch")))


def encrypted(data: Column, key: Column) -> Column:
    """AES-256-GCM with a random nonce: nonce(12), ciphertext, tag(16)."""
    return F.aes_encrypt(data, key, F.lit("GCM"))


def decrypted(data: Column, key: Column) -> Column:
    """Undoes ``encrypted``; a short input, a wrong key or changed bytes are an error."""
    return F.when(F.octet_length(data) < CIPHER_OVERHEAD, F.raise_error(F.lit("encrypted block is too short"))).otherwise(F.aes_decrypt(data, key, F.lit("GCM")))


def try_decrypted(data: Column, key: Column) -> Column:
    return F.try_aes_decrypt(data, key, F.lit("GCM"))


def key_from_env(variable: str = KEY_VARIABLE) -> bytes | None:
    """The key of the environment; None if unset, an error unless it is 64 hex digits."""
    text = os.environ.get(variable)
    if text is None:
        return None
    text = text.strip()
    if len(text) != 64:
        raise ValueError(f"{variable} must be 64 hex digits")
    return bytes.fromhex(text)


def with_key(df: DataFrame, key: bytes, name: str = "key") -> DataFrame:
    """Adds the key as a column from a one-row table, so that it isn't a literal of the plan."""
    row = df.sparkSession.createDataFrame([(bytearray(key),)], f"{name} binary")
    return df.crossJoin(F.broadcast(row))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def flat_name(file_id: Column) -> Column:
    return F.replace(file_id, F.lit("/"), F.lit("_"))


def valid_archive_name(name: Column) -> Column:
    """Neither empty nor with a path part that leaves the folder."""
    return (F.length(name) > 0) & ~F.contains(name, F.lit("..")) & ~F.contains(name, F.lit("/")) & ~F.contains(name, F.lit("\\"))


def safe_path(file_id: Column) -> Column:
    """Whether an id can be a path below an output folder."""
    return (F.length(file_id) > 0) & ~file_id.startswith("/") & ~F.array_contains(F.split(file_id, "[/\\\\]"), "..") & ~file_id.rlike("^[A-Za-z]:")


def label_of(file_id: Column) -> Column:
    """The number before the first underscore of the base name; null if there is none."""
    return F.split_part(basename(file_id), F.lit("_"), F.lit(1)).try_cast("int")


def preview(data: Column, size: int = 500) -> Column:
    """The first bytes as text; what isn't UTF-8 becomes U+FFFD."""

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))

    return text(F.substring(data, 1, size))
