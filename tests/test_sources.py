"""Archives of files are written and read one entry at a time."""

import io
import tarfile
import tracemalloc
import zipfile

import pyarrow as pa
import pytest

from lodestore.operators.archive import Archive
from lodestore.sources import files as sources
from lodestore.streaming.ingest import ingest_folder

KIND = "file_id string, file_ord long, bytes binary"


@pytest.mark.parametrize("kind", ["tar", "zip"])
def test_archives_pass_by_entry(spark, tmp_path, kind):
    path = str(tmp_path / f"x.{kind}")
    data = bytes(range(256)) * 4096
    with tarfile.open(path, "w") if kind == "tar" else zipfile.ZipFile(path, "w") as out:
        for i in range(60):
            if kind == "zip":
                out.writestr(f"f{i}", data)
            else:
                entry = tarfile.TarInfo(f"f{i}")
                entry.size = len(data)
                out.addfile(entry, io.BytesIO(data))
    asked = iter([pa.RecordBatch.from_arrays([pa.array(["file:" + path])], names=["path"])])
    tracemalloc.start()
    n = sum(b.num_rows for b in sources._entries(kind, True)(asked))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60 and most < 50 << 20  # the archive is of 60 MB


@pytest.mark.parametrize("kind", ["tar", "zip"])
def test_parts_keep_order(spark, tmp_path, kind):
    rows = [(f"n{i}", i, bytearray(b"%d" % i * i)) for i in range(0, 300, 3)]
    folder = str(tmp_path / "parts")
    sources.write_archives(spark.createDataFrame(rows, KIND).repartition(5), folder, kind, parts=4)
    read = sources.tar if kind == "tar" else sources.zipped
    found = read(spark, folder).orderBy("file_ord").collect()
    assert [(r["file_id"], r["file_ord"], bytes(r["bytes"])) for r in found] == [(n, k, bytes(b)) for k, (n, _, b) in enumerate(rows)]
    sources.write_archives(spark.createDataFrame([], KIND), str(tmp_path / "none"), kind, parts=4)


def test_empty_files(spark, tmp_path):
    files = {"a": b"x", "empty": b"", "s p%41+": b"", "z%20": b"zz"}
    (tmp_path / "in").mkdir()
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    found = sources.directory(spark, str(tmp_path / "in")).orderBy("file_ord").collect()
    assert [(r["file_id"], bytes(r["bytes"])) for r in found] == sorted(files.items())
    path = str(tmp_path / "a")
    spark.conf.set("spark.sql.streaming.fileSource.log.compactInterval", "2")
    ingest_folder(spark, str(tmp_path / "in"), path, str(tmp_path / "c"), files_per_batch=2).awaitTermination()
    assert {r["file_id"]: bytes(r["bytes"]) for r in Archive(spark, path).read().collect()} == files
    (tmp_path / "in" / "later").write_bytes(b"")
    ingest_folder(spark, str(tmp_path / "in"), path, str(tmp_path / "c")).awaitTermination()
    spark.conf.unset("spark.sql.streaming.fileSource.log.compactInterval")
    assert Archive(spark, path).files.count() == 5
