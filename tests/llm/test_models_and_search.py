"""The classifiers by held-out accuracy, the search by recall, the URL filter against a plain version."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestore.llm.ann import nearest
from lodestore.llm.quality import DEPTH, boost, quality, statistics
from lodestore.llm.shared import held_out, without
from lodestore.llm.toxicity import drop_toxic, fit_logistic, toxicity
from lodestore.llm.urlfilter import LIST, filter_urls, host_of, list_table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity(spark, tables, docs, empty):
    texts, labels = tables
    scored = toxicity(texts, labels).join(labels, "doc_id").where(held_out(F.col("doc_id"))).toPandas()
    toxic, clean = scored[scored.toxic == 1].score, scored[scored.toxic == 0].score
    assert (clean >= 0.5).mean() <= 0.03 and (toxic >= 0.5).mean() >= 0.5
    odd = toxicity(docs, labels.union(spark.createDataFrame([(None, 1, 1), (0, None, None)], labels.schema))).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity(empty, labels).count() == 0
    assert all(r["score"] < 0.01 for r in toxicity(docs, labels.where("false")).collect())
    left = drop_toxic(docs, labels)
    assert left.columns == docs.columns and left.count() >= docs.count() - 1


def test_quality(tables, docs, empty):
    texts, labels = tables
    scored = quality(texts, labels).join(labels, "doc_id").where(held_out(F.col("doc_id"))).toPandas()
    assert ((scored.score >= 0.3) == (scored.quality == 1)).mean() >= 0.95
    assert quality(docs, labels).count() == docs.count() and quality(empty, labels).count() == 0
    assert {round(r["score"], 6) for r in quality(docs, labels.where("false")).collect()} == {0.5}


def test_trees_flatten_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = boost(x, y, np.ones(2000), 40)
    assert ((trees.score(x) > 0.5) == (y == 1)).mean() > 0.98

    def walk(row):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            at = 0
            for _ in range(DEPTH):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            total += leaf[at - len(f)]
        return total

    assert np.allclose(trees.margin(x[:20]), [walk(r) for r in x[:20]])
    assert np.isfinite(statistics(b"", np.zeros(256))).all()
    w = fit_logistic(np.column_stack([np.ones(400), x[:400, 0]]), (x[:400, 0] > 0.5).astype(float))
    assert w[1] > 5


def test_nearest(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    odd = spark.createDataFrame([(9000, None, 0), (9001, [0.0] * 64, 0), (9002, [float("nan")] * 64, 0), (9003, [None] * 64, 0), (None, [1.0] * 64, 0), (9050, [1.0, 0.0], 0), (9051, [2.0, 0.0], 0), (9052, [2.0, 0.0], 0)], table.schema)
    # repeated rows, among them queries, count once
    every = table.union(odd).union(table.where("vec_id % 50 < 2"))
    got = {}
    for r in nearest(every, every.where("vec_id % 50 = 0"), 5, query_rows=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert [(v, s) for _, v, s in sorted(got.pop(9050))] == [(9051, 1.0), (9052, 1.0)]
    assert 9000 not in got
    rows = table.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        score = x @ x[ids == q][0]
        score[ids == q] = -2
        hits += len({v for _, v, _ in found} & set(ids[np.argsort(-score)[:5]]))
        assert all(abs(s - score[ids == v][0]) < 1e-9 for _, v, s in found) and [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5] and len({v for _, v, _ in found}) == 5
    assert hits >= 0.9 * 5 * len(got)
    assert nearest(every.where("false"), every, 5).count() == 0


def test_url_filter(spark):
    urls = ["https://tionsh.example.net/a", "HTTP://User@Blog.Tionble.Example.COM:80/x", "http://nothing.example.edu", "ftp://tionsh.example.net/", None, "http:///x", "https://m.thther.example.org.", "https://xtionsh.example.net?q=tionsh.example.net"]
    days = [dt.datetime(2023, 5, 1) + dt.timedelta(days=13 * i, hours=i % 24) for i in range(60)] + [None]
    rows = [(i, u, d) for i, (u, d) in enumerate((u, d) for u in urls for d in days)]
    captures = spark.createDataFrame(rows + rows[:3], "page_id long, url string, fetched timestamp")
    got = sorted((r["page_id"], r["pattern"], r["action"], r["blocked"]) for r in filter_urls(captures, list_table(spark)).select("page_id", "pattern", "action", "blocked").na.fill("").collect())
    hosts = {r["u"]: r["h"] for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", host_of(F.col("u")).alias("h")).collect()}

    def plain(url, at):
        host, best = hosts[url], ("", "")
        for pattern in {p for p, _, _ in LIST}:
            if at is None or not host or not (host == pattern or host.endswith("." + pattern)):
                continue
            past = sorted((d, a) for p, a, d in LIST if p == pattern and dt.datetime.fromisoformat(d) <= at)
            if past and past[-1][1] != "drop" and len(pattern) > len(best[0]):
                best = (pattern, past[-1][1])
        return *best, best[1] == "block"

    want = sorted((i, *plain(u, d)) for i, u, d in rows + rows[:3])
    assert got == want and any(b for *_, b in got)
    shuffled = filter_urls(captures, list_table(spark), broadcast_rows=0).select("page_id", "pattern", "action", "blocked").na.fill("").collect()
    assert sorted(map(tuple, shuffled)) == want
    assert filter_urls(captures, list_table(spark).where("false")).where("blocked").count() == 0


def test_without(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "doc_id long, t string")
    for limit in (10, 0):
        assert sorted(r["t"] for r in without(rows, spark.createDataFrame([(2,), (2,), (None,)], "x long"), broadcast_ids=limit).collect()) == ["a", "c"]
