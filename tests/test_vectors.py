"""The best of a batch search are chosen without ordering all."""

import numpy as np

from lodestore.operators.vectors import search_batch


def test_ties_and_many_queries(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(-2, 3, (400, 4)).astype(float)
    rows = [(i, [float(x) for x in base[i % 150]]) for i in range(400)]
    index = spark.createDataFrame(rows, "file_id long, vector array<float>")
    found = search_batch(index, index.withColumnRenamed("file_id", "query_id"), 5, block=100).collect()
    x = np.array([v for _, v in rows])
    size = np.sqrt((x * x).sum(axis=1))
    got = {}
    for r in found:
        got.setdefault(r["query_id"], {})[r["rank"]] = r["score"]
    for i in range(400):
        if size[i]:
            want = np.sort((x[size > 0] @ x[i]) / size[size > 0] / size[i])[::-1][:5]
            assert sorted(got[i]) == [1, 2, 3, 4, 5] and np.allclose([got[i][k] for k in range(1, 6)], want)
        else:
            assert i not in got
