"""Packing and reading hold a batch, and data moves no more often than it must."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestore.operators.archive import pack
from lodestore.operators.blocks import fold, plan_blocks

KIND = "file_id string, file_ord long, bytes binary"


@pytest.fixture
def narrow(spark):
    """Batches of 7 rows, and no table small enough to be broadcast by itself."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("limit,strict", [(900, False), (900, True), (0, False)])
def test_plan_by_batches(spark, narrow, limit, strict):
    sizes = np.random.default_rng(1).integers(1, 400, 150)
    rows = [(f"h{i}", int(s), i, i, 0) for i, s in enumerate(sizes)]
    unique = spark.createDataFrame(rows, "hash string, size long, first_seen long, file_ord long, pos int")
    found = {r["first_seen"]: (r["block_id"], r["inner_offset"]) for r in plan_blocks(unique, limit, strict, segment=60).collect()}
    want = {}
    for start in range(0, 150, 60):
        own, inner, last = sizes[start : start + 60], 0, None
        for i, (s, b) in enumerate(zip(own, fold(own, limit, strict), strict=True)):
            inner = 0 if b != last else inner
            want[start + i] = (start + b, inner)
            inner, last = inner + s, b
    assert found == want


def test_point_reads_move_no_blocks(spark, narrow, tmp_path):
    files = spark.createDataFrame([(f"f{i}", i, bytearray(b"%d" % i * 900)) for i in range(40)], KIND)
    archive = pack(files, str(tmp_path / "a"), limit=8000)
    one = archive.read(F.col("file_ord") == 5)
    assert bytes(one.first()["bytes"]) == b"5" * 900
    assert "SortMergeJoin" not in one._jdf.queryExecution().executedPlan().toString()
    assert {r["file_ord"]: bytes(r["bytes"]) for r in archive.read().collect()} == {i: b"%d" % i * 900 for i in range(40)}
    assert archive.verify(files).first().asDict() == {"passed": 40, "failed": 0}


def test_whole_reads_move_data_once(spark, narrow, tmp_path):
    archive = pack(spark.createDataFrame([("a", 0, bytearray(b"x" * 9000))], KIND), str(tmp_path / "a"))
    plan = archive.read()._jdf.queryExecution().executedPlan().toString()
    behind = plan[: plan.index("MapInArrow")]
    assert behind.count("Exchange hashpartitioning") == 1
