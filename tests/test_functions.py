import random

import pytest
from pyspark.sql import functions as F

from lodestore.functions import codecs
from lodestore.functions import columns as C
from lodestore.functions.chunking import AVG_SIZE, GEAR, MAX_SIZE, MIN_SIZE, cut_points


def scalar_cuts(data: bytes) -> list[int]:
    out, start, n = [], 0, len(data)
    while n - start > MIN_SIZE:
        h, cut = 0, min(start + MAX_SIZE, n)
        for i in range(start + MIN_SIZE, cut):
            h = ((h << 1) + int(GEAR[data[i]])) & (2**64 - 1)
            if h >> (50 if i < start + AVG_SIZE else 52) == 0:
                cut = i + 1
                break
        out.append(cut)
        start = cut
    return out + [n] * (start < n)


@pytest.mark.parametrize("size", [0, 1, MIN_SIZE, MIN_SIZE + 1, 9000, 70_000, 200_000])
def test_cuts_equal_scalar_rule(size):
    data = random.Random(size).randbytes(size)
    assert cut_points(data) == scalar_cuts(data)
    assert cut_points(b"\0" * size) == scalar_cuts(b"\0" * size)


def test_cuts_move_with_the_content():
    data = random.Random(1).randbytes(300_000)
    ends = set(cut_points(data))
    moved = {e - 7 for e in cut_points(b"7 bytes" + data)}
    assert len(ends & moved) > len(ends) / 2


@pytest.mark.parametrize("codec", ["zstd", "lz4"])
@pytest.mark.parametrize("data", [b"", b"x", b"Fast path! " * 1000, random.Random(2).randbytes(5000)])
def test_codec_round_trip(codec, data):
    packed = codecs.compress(data, codec)
    assert packed[0] == codecs.TAGS[codec] and codecs.codec_of(packed[0]) == codec
    assert codecs.decompress(packed) == data


def test_codec_legacy_and_errors():
    import zstandard

    assert codecs.decompress(zstandard.compress(b"Legacy data")) == b"Legacy data"
    with pytest.raises(ValueError):
        codecs.decompress(b"")
    with pytest.raises(ValueError):
        codecs.compress(b"x", "gzip")


def test_dictionary():
    samples = [b'{"id": %d, "label": "class_%d", "width": 224}' % (i, i % 10) for i in range(2000)]
    d = codecs.train_dictionary(samples, 4096)
    assert codecs.decompress(codecs.compress(samples[7], dictionary=d), d) == samples[7]
    assert len(codecs.compress(samples[7], dictionary=d)) < len(codecs.compress(samples[7]))
    assert codecs.train_dictionary([]) is None


def test_key_from_env(monkeypatch):
    monkeypatch.delenv(C.KEY_VARIABLE, raising=False)
    assert C.key_from_env() is None
    monkeypatch.setenv(C.KEY_VARIABLE, " " + "42" * 32 + "\n")
    assert C.key_from_env() == b"\x42" * 32
    monkeypatch.setenv(C.KEY_VARIABLE, "42")
    with pytest.raises(ValueError):
        C.key_from_env()


def test_names_and_hex(spark):
    rows = spark.createDataFrame([("a/b_1.png",), ("../x",), ("/etc",), ("12_x.jpg",), ("",), ("a\\..\\b",)], "id string")
    got = rows.select(C.flat_name(F.col("id")), C.safe_path(F.col("id")), C.label_of(F.col("id")), C.valid_archive_name(F.col("id"))).collect()
    assert [r[0] for r in got] == ["a_b_1.png", ".._x", "_etc", "12_x.jpg", "", "a\\..\\b"]
    assert [r[1] for r in got] == [True, False, False, True, False, False]
    assert [r[2] for r in got] == [None, None, None, 12, None, None]
    assert [r[3] for r in got] == [False, False, False, True, False, False]
    with pytest.raises(Exception, match="not a 64-digit"):
        rows.select(C.hex_to_hash(F.col("id"))).collect()
    assert rows.limit(1).select(C.preview(F.lit(b"ab\xff").cast("binary"))).first()[0] == "ab�"
