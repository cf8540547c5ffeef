import io
import json
import os
import struct
import tarfile
import threading
import zipfile
from functools import partial
from http.server import HTTPServer, SimpleHTTPRequestHandler

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestore.facade import Archive as Facade
from lodestore.facade import CloudArchive, Dataset, VectorIndex, convert, load, pack_directory
from lodestore.operators.archive import Archive, pack
from lodestore.operators.blocks import fold
from lodestore.operators.sampling import DataLoaderCheckpoint, DeterministicSampler, order
from lodestore.operators.stats import Metrics
from lodestore.sources import files as sources
from lodestore.sources.container import Container, export, pack_message, parse_header, read_range, unpack_message
from lodestore.sources.files import directory, with_file_ord
from lodestore.streaming.ingest import ingest_batch, ingest_folder

KEY = b"\x42" * 32


def table(spark, files):
    return spark.createDataFrame([(k, i, bytearray(v)) for i, (k, v) in enumerate(files.items())], "file_id string, file_ord long, bytes binary")


def contents(archive):
    return {r["file_id"]: bytes(r["bytes"]) for r in archive.read().collect()}


FILES = {"hello.txt": b"Hello! This is a dedup test.", "data.bin": bytes.fromhex("deadbeef") * 2048, "empty": b""} | {f"copy_{i}.bin": b"\x42" * 65536 for i in range(4)}


@pytest.mark.parametrize("options", [{}, {"codec": "lz4"}, {"key": KEY}, {"mode": "speed"}, {"mode": "size"}, {"limit": 20_000}])
def test_round_trip(spark, tmp_path, options):
    archive = pack(table(spark, FILES), str(tmp_path / "a"), **options)
    assert contents(archive) == FILES
    assert archive.verify(table(spark, FILES)).first().asDict() == {"passed": len(FILES), "failed": 0}
    info = archive.info().first()
    assert info["total_files"] == len(FILES) and info["original_bytes"] == sum(map(len, FILES.values())) and info["encrypted"] == ("key" in options)
    if "mode" not in options:
        assert archive.last["dedup_ratio"] > 3 and info["stored_bytes"] < info["original_bytes"] / 5


def test_dictionary_and_append(spark, tmp_path):
    docs = {f"meta_{i:04}.json": json.dumps({"id": i, "label": f"class_{i % 10}", "metadata": {"width": 224, "format": "JPEG"}}).encode() for i in range(300)}
    archive = pack(table(spark, docs), str(tmp_path / "a"), dictionary=True)
    assert archive.last["dictionary"] is not None
    assert archive.append(table(spark, {"again": docs["meta_0000.json"], "new": b"new text"})) == 1
    both = Archive(spark, str(tmp_path / "a"))
    assert contents(both) == docs | {"again": docs["meta_0000.json"], "new": b"new text"}
    assert both.last["total_files"] == 302 and both.last["total_chunks"] == archive.last["total_chunks"] + 1


def test_append_of_known_content_adds_nothing(spark, tmp_path):
    archive = pack(table(spark, {"v1.bin": b"\xab" * 32768}), str(tmp_path / "a"))
    assert archive.append(table(spark, {"v2.bin": b"\xab" * 32768})) == 0
    assert len(Archive(spark, str(tmp_path / "a"))) == 2


def test_keys_and_changed_bytes(spark, tmp_path):
    path = str(tmp_path / "a")
    pack(table(spark, {"secret.txt": b"Top secret data"}), path, key=KEY)
    assert Archive(spark, path, KEY)["secret.txt"] == b"Top secret data"
    for key in (None, b"\0" * 32):
        with pytest.raises(Exception):  # noqa: B017
            Archive(spark, path, key)["secret.txt"]
    changed = str(tmp_path / "b")
    blocks = pack(table(spark, {"x": b"1234567890" * 50}), changed).blocks
    other = blocks.withColumn("payload", F.concat(F.expr("substring(payload, 1, 5)"), F.lit(bytearray(b"\0")), F.expr("substring(payload, 7)"))).collect()
    spark.createDataFrame(other, blocks.schema).write.mode("overwrite").parquet(f"{changed}/blocks/part=0")
    with pytest.raises(Exception, match="checksum"):
        Archive(spark, changed)["x"]


def test_lookups(spark, tmp_path):
    files = spark.createDataFrame([("a", 0, b"first"), ("b/c", 1, b"x"), ("a", 2, b"second"), ("b_c", 3, b"y")], "file_id string, file_ord long, bytes binary")
    archive = pack(files, str(tmp_path / "a"))
    assert archive["a"] == b"first" and archive.record("a", latest=True)["file_ord"] == 2
    assert archive.file_size("nope") is None and archive.byte_range("a", 1, 3) == b"irs"
    with pytest.raises(KeyError):
        archive["nope"]
    assert [r["file_id"] for r in archive.file_ids().collect()] == ["a", "b/c", "a", "b_c"]
    assert [r["file_ord"] for r in archive.at(slice(None, None, -2)).collect()] == [3, 1]
    assert [r["file_ord"] for r in archive.select([2, 0, 2]).collect()] == [2, 0, 2]
    assert [r["collides"] for r in archive.listing().orderBy("name").collect()] == [True, True, True, True]
    assert archive.unpack(str(tmp_path / "out"), F.col("file_ord") < 2) == 2
    assert (tmp_path / "out/b/c").read_bytes() == b"x"
    with pytest.raises(FileNotFoundError):
        Archive(spark, str(tmp_path / "none"))
    bad = pack(table(spark, {"../x": b"1"}), str(tmp_path / "bad"))
    with pytest.raises(Exception, match="unsafe"):
        bad.unpack(str(tmp_path / "out"))


def test_empty_archive(spark, tmp_path):
    archive = pack(table(spark, {"only": b""}).where("false"), str(tmp_path / "a"))
    assert contents(archive) == {} and archive.last["dedup_ratio"] == 1.0


@pytest.mark.parametrize("seed", range(5))
def test_fold(seed):
    sizes = np.random.default_rng(seed).integers(1, 5000, 400)
    for strict in (False, True):
        want, block, held = [], 0, 0
        for s in sizes:
            want.append(block)
            held += s
            if held > 20_000 if strict else held >= 20_000:
                block, held = block + 1, 0
        assert fold(sizes, 20_000, strict).tolist() == want


def test_sources_and_convert(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k, v in (("b.txt", b"bee"), ("a.txt", b"ay")):
        (tmp_path / "d" / k).write_bytes(v)
    (tmp_path / "d/sub").mkdir()
    (tmp_path / "d/sub/c.txt").write_bytes(b"no")
    assert [(r["file_id"], bytes(r["bytes"])) for r in sources.directory(spark, str(tmp_path / "d")).orderBy("file_ord").collect()] == [("a.txt", b"ay"), ("b.txt", b"bee")]
    with tarfile.open(tmp_path / "x.TGZ", "w:gz") as t:
        t.add(tmp_path / "d", "d")
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("p/q.txt", b"zip")
        z.mkdir("folder")
    assert contents(convert(spark, str(tmp_path / "x.TGZ"), str(tmp_path / "t"))) == {"d/a.txt": b"ay", "d/b.txt": b"bee", "d/sub/c.txt": b"no"}
    assert contents(convert(spark, str(tmp_path / "x.zip"), str(tmp_path / "z"), codec="lz4")) == {"p/q.txt": b"zip"}
    with pytest.raises(ValueError):
        convert(spark, "x.rar", "y")
    assert len(pack_directory(spark, str(tmp_path / "d"), str(tmp_path / "pd"))) == 2


def test_tensors(spark, tmp_path):
    head = json.dumps({"__metadata__": {}, "w": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}, "b": {"dtype": "I8", "shape": [], "data_offsets": [8, 9]}}).encode()
    (tmp_path / "m.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + struct.pack("<2f", 1, 2) + b"\x07")
    rows = sources.tensors(spark, str(tmp_path / "m.safetensors")).collect()
    assert [(r["name"], r["shape"], r["dtype"], r["length"]) for r in rows] == [("b", [], "I8", 1), ("w", [2], "F32", 8)]
    assert struct.unpack("<2f", sources.tensor_bytes(spark, str(tmp_path / "m.safetensors"), "w")) == (1.0, 2.0)
    with pytest.raises(KeyError):
        sources.tensor_bytes(spark, str(tmp_path / "m.safetensors"), "q")


class Ranges(SimpleHTTPRequestHandler):
    def do_GET(self):
        with open(self.translate_path(self.path), "rb") as f:
            data = f.read()
        a, z = self.headers["Range"].removeprefix("bytes=").split("-")
        self.send_response(206)
        self.end_headers()
        self.wfile.write(data[int(a) : int(z) + 1])

    def log_message(self, *args):
        pass


@pytest.mark.parametrize("packed", [False, True])
def test_container_and_http(spark, tmp_path, packed):
    archive = pack(table(spark, FILES), str(tmp_path / "a"), key=KEY if packed else None)
    path = str(tmp_path / "a.bin")
    export(archive, path, packed)
    local = Container(spark, path, KEY if packed else None)
    assert contents(local) == FILES
    server = HTTPServer(("127.0.0.1", 0), partial(Ranges, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/a.bin"
    cloud = CloudArchive(spark, url, KEY if packed else None)
    assert cloud["hello.txt"] == FILES["hello.txt"] and len(cloud) == len(FILES)
    with pytest.raises(KeyError):
        cloud["nope"]
    if not packed:
        assert {r["file_id"] for r in load(spark, url).collect()} == set(FILES)
    server.shutdown()
    raw = bytearray((tmp_path / "a.bin").read_bytes())
    raw[-1] ^= 1
    (tmp_path / "b.bin").write_bytes(raw)
    with pytest.raises(Exception, match="checksum"):
        Container(spark, str(tmp_path / "b.bin"), KEY if packed else None).read().collect()
    with pytest.raises(ValueError):
        parse_header(b"ZIP\0" + bytes(raw[4:32]))
    with pytest.raises(ValueError):
        parse_header(bytes(raw[:4]) + b"\x63\0" + bytes(raw[6:32]))
    assert read_range(path, 3, 0) == b""


def test_messages():
    value = {"a": [1, -5, 2**40, 1.5, None, True, "é", b"\0"], "b": {}}
    assert unpack_message(pack_message(value)) == value
    assert unpack_message(b"\x82\xa1a\x01\xa1b\x93\x01\xff\xa0") == {"a": 1, "b": [1, -1, ""]}


def test_sampler(spark):
    assert order(42, 10, 0).tolist() == [0, 9, 5, 8, 6, 4, 7, 2, 1, 3]
    assert order(42, 10, 1).tolist() == [2, 3, 9, 7, 5, 8, 6, 4, 0, 1]
    assert order(7, 5, 3).tolist() == [1, 4, 0, 2, 3]
    assert order(42, 1, 0).tolist() == [0] and order(42, 0, 0).tolist() == []
    assert order(42, 1000, 0)[:5].tolist() == [650, 152, 78, 670, 854]
    sampler = DeterministicSampler(42, 100)
    assert [r["sample_index"] for r in sampler.shard(spark, 0, 2, 4).collect()][:6] == [1, 78, 10, 93, 94, 23]
    with pytest.raises(ValueError):
        sampler.shard(spark, 0, 4, 4)
    point = DataLoaderCheckpoint(0, 5, 42, 100)
    assert DataLoaderCheckpoint.load(point.save()) == point
    left = [r["sample_index"] for r in point.remaining(spark, 10).collect()]
    assert len(left) == 50 and left[:4] == [77, 2, 87, 24]
    half = DataLoaderCheckpoint(5, 3, 42, 1000, 4, 2).remaining(spark, 32)
    assert [r["sample_index"] for r in half.collect()][:5] == [87, 725, 197, 959, 904]
    for text in ("{}", "nope", point.save().replace("5", '"x"')):
        with pytest.raises(ValueError):
            DataLoaderCheckpoint.load(text)


def test_vector_index(spark, tmp_path):
    index = VectorIndex(spark, 3)
    assert index.search([1, 0, 0], 2) == []
    for name, v in (("cat", [1, 0, 0]), ("dog", [0.9, 0.1, 0]), ("car", [0, 0, 1]), ("zero", [0, 0, 0])):
        index.insert(name, v)
    (a, x), (b, y) = index.search([1, 0, 0], 2)
    assert (a, b) == ("cat", "dog") and abs(x - 1) < 1e-6 and abs(y - 0.993884) < 1e-6
    assert index.search([0, 0, 0], 2) == [] and index.search([1, 0, 0], 0) == []
    index.save(str(tmp_path / "i"))
    assert VectorIndex.load(spark, str(tmp_path / "i"), 3).search([1, 0, 0], 1)[0][0] == "cat"
    with pytest.raises(ValueError):
        index.insert("x", [1.0])


def test_dataset_and_metrics(spark, tmp_path):
    pack(table(spark, {f"f{i}": b"%d" % i for i in range(6)}), str(tmp_path / "a"))
    data = Dataset(Facade(spark, str(tmp_path / "a")), transform=lambda s: s.map(lambda b: int(b)))
    assert data[3] == {"file_id": "f3", "bytes": 3} and [r["bytes"] for r in data[1:6:2]] == [1, 3, 5]
    assert [r["bytes"] for r in data.select([4, 0, 4])] == [4, 0, 4] and [r["bytes"] for r in data] == list(range(6))
    m = Metrics(spark)
    for size in (4096, 8192):
        m.chunk(size)
    m.add("cache_hits", 2)
    m.add("cache_misses")
    assert m.snapshot()["bytes_read"] == 12288 and abs(m.snapshot()["hit_rate"] - 2 / 3) < 1e-9


def test_stream_ingest(spark, tmp_path):
    folder, path, point = (str(tmp_path / x) for x in ("in", "a", "c"))
    os.makedirs(folder)
    for i in range(5):
        with open(f"{folder}/dup_{i}.bin", "wb") as f:
            f.write(b"\xff" * 65536)
    ingest_folder(spark, folder, path, point, files_per_batch=2).awaitTermination()
    archive = Archive(spark, path)
    assert len(archive) == 5 and archive.last["total_stored_bytes"] < 5 * 65536 / 3
    with open(f"{folder}/new.txt", "wb") as f:
        f.write(b"new")
    ingest_folder(spark, folder, path, point).awaitTermination()
    again = Archive(spark, path)
    assert len(again) == 6 and again["new.txt"] == b"new"
    from lodestore.streaming.ingest import ingest_batch

    assert ingest_batch(spark, table(spark, {"z": b"z"}).drop("file_ord"), path, again.last["batch_id"]) == 0


def test_gaps_and_repeated_ids(spark, tmp_path):
    kind = "file_id string, file_ord long, bytes binary"
    path = str(tmp_path / "gaps")
    old = spark.createDataFrame([("n0", 0, b"zero"), ("n3", 3, b"three")], kind)
    archive = pack(old, path)
    archive.append(spark.createDataFrame([("n4", 0, b"four"), ("n6", 2, b"six")], kind))
    archive = Archive(spark, path)
    assert {r["file_id"]: bytes(r["bytes"]) for r in archive.read().collect()} == {"n0": b"zero", "n3": b"three", "n4": b"four", "n6": b"six"}
    assert [r["file_id"] for r in archive.at(slice(1, 4)).collect()] == ["n3", "n4", "n6"] and archive.at(-1).first()["file_id"] == "n6"
    assert [r["file_id"] for r in archive.select([3, 0, 3]).collect()] == ["n6", "n0", "n6"]
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([("a", 0, b"x"), ("b", 0, b"y")], kind), str(tmp_path / "same"))
    named = with_file_ord(spark.createDataFrame([("a", b"one"), ("a", b"two2"), ("b", b"x"), (None, b"y")], "file_id string, bytes binary"))
    assert sorted(r["file_ord"] for r in named.collect()) == [0, 1, 2, 3]
    archive = pack(named.where("file_id is not null"), str(tmp_path / "named"))
    assert sorted((r["file_id"], bytes(r["bytes"])) for r in archive.read().collect()) == [("a", b"one"), ("a", b"two2"), ("b", b"x")]


def test_equal_names_of_folders(spark, tmp_path):
    for folder, text in (("x", "first"), ("y", "second one")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "same.txt").write_text(text)
    found = directory(spark, str(tmp_path / "in"), recursive=True).orderBy("file_ord").collect()
    assert [(r["file_id"], r["file_ord"], bytes(r["bytes"])) for r in found] == [("same.txt", 0, b"first"), ("same.txt", 1, b"second one")]
    assert ingest_batch(spark, directory(spark, str(tmp_path / "in"), recursive=True).drop("file_ord"), str(tmp_path / "a"), 0) == 2
    assert sorted(bytes(r["bytes"]) for r in Archive(spark, str(tmp_path / "a")).read().collect()) == [b"first", b"second one"]


def test_attached_vectors_uploads_and_codecs(spark, tmp_path):
    from lodestore.operators.blocks import compared
    from lodestore.operators.stats import throughput
    from lodestore.operators.vectors import attach

    data = {"a": b"x" * 5000, "b": b"", "c": bytes(range(256)) * 20}
    files = table(spark, data)
    kind = "file_id string, space_id string, vector array<float>"
    rows = spark.createDataFrame([("a", "s", [1.0]), ("a", "s", [1.0]), ("c", "t", [2.0])], kind)
    assert sorted((r["file_id"], r["file_ord"]) for r in attach(files, rows).collect()) == [("a", 0), ("a", 0), ("c", 2)]
    for lost in ("z", None):
        with pytest.raises(Exception, match="no file"):
            attach(files, spark.createDataFrame([(lost, "s", [1.0])], kind)).collect()
    assert attach(files, rows.limit(0)).count() == 0

    folder = str(tmp_path / "tars")
    sources.write_archives(files, folder, "tar", parts=2)
    assert {r["file_id"]: bytes(r["bytes"]) for r in sources.uploaded(spark, folder, "mine").collect()} == data
    for name in ("", "../x", "a/b", "a\\b"):
        with pytest.raises(ValueError, match="unsafe"):
            sources.uploaded(spark, folder, name)
    with pytest.raises(ValueError, match="larger"):
        sources.uploaded(spark, folder, "mine", most=100)

    found = {r["mode"]: r for r in compared(files).collect()}
    total = sum(map(len, data.values()))
    assert found["per_file"]["units"] == 3 and found["solid"]["units"] == 1 and all(r["original_bytes"] == total for r in found.values())
    assert found["solid"]["stored_bytes"] < found["per_file"]["stored_bytes"] < total

    spent = spark.createDataFrame([("g", 3_000_000, 1.0), ("g", 1_000_000, 1.0), ("h", 5, 0.0), ("h", None, 1.0)], "g string, n long, s double")
    assert {r["g"]: (r["bytes"], r["mb_s"]) for r in throughput(spent, "g", "n", "s").collect()} == {"g": (4_000_000, 2.0), "h": (5, None)}


def test_missing_chunk_and_metrics(spark, tmp_path):
    archive = pack(table(spark, {"a": b"one", "b": b"two", "c": b"one"}), str(tmp_path / "a"))
    metrics = Metrics(spark)
    assert archive.read(metrics=metrics).count() == 3
    archive.read(metrics=metrics).collect()
    assert metrics.snapshot()["bytes_written"] % 6 == 0 and metrics.snapshot()["blocks_decompressed"] >= 1
    kept = spark.createDataFrame([], archive.chunks.schema)
    kept.write.mode("overwrite").parquet(str(tmp_path / "a" / "chunks" / "part=0"))
    with pytest.raises(Exception, match="missing chunk"):
        Archive(spark, str(tmp_path / "a")).read().collect()
