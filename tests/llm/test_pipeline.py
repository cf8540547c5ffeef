"""The pipeline's stages against plain versions of what each of them decides."""

import collections

import corpus_pipeline
from lodestore.llm.mixing import mixed_documents
from lodestore.llm.queries import ORACLE_SQL, QUERIES

from .conftest import words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SF)
        rows = out.collect()
        seen[name] = (before, rows)
        assert out.columns == docs.columns if name != "mixing" else out.columns == [*docs.columns, "copies"]
        docs = spark.createDataFrame(rows, out.schema)
    before, after = seen["line dedup"]
    total = collections.Counter(r["source"] for r in before)
    pages = collections.Counter((r["source"], x) for r in before for x in set((r["text"] or "").split("\n")) if x.strip(" "))
    cut = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if not (pages[r["source"], x] >= 10 and pages[r["source"], x] > 0.02 * total[r["source"]])) for r in before}
    assert {r["doc_id"]: r["text"] for r in after} == cut and all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = seen["near-duplicates"]
    sets = {}
    for r in before:
        w = r["text"].encode().lower().split()
        n = min(5, len(w))
        sets[r["doc_id"]] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    kept = {r["doc_id"] for r in after}
    assert all(any(j < i and j in sets and near_pair(sets[i], sets[j]) for j in sets) for i in sets if i not in kept)
    assert not any(near_pair(sets[i], sets[j]) for i in kept for j in kept if j < i)

    before, after = seen["benchmark decontamination"]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    dirty = {r["doc_id"] for r in before if any(tuple(words(r["text"])[k : k + 10]) in windows for k in range(len(words(r["text"])) - 9))}
    assert {r["doc_id"] for r in before} - dirty == {r["doc_id"] for r in after}

    before, after = seen["mixing"]
    every = mixed_documents(spark.createDataFrame(before, out.drop("copies").schema)).collect()
    assert sorted(r["doc_id"] for r in before) == sorted(r["doc_id"] for r in every) and all(0 <= r["copies"] <= 2 for r in every)
    assert sorted((r["doc_id"], r["copies"]) for r in after) == sorted((r["doc_id"], r["copies"]) for r in every if r["copies"])
    assert len(seen["toxicity"][1]) >= 0.9 * len(seen["toxicity"][0])


def near_pair(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def test_names():
    assert [next(n for n in QUERIES if n.startswith(f"op{k}_")) for k in range(1, 11)] and len(QUERIES) == 10
    assert set(ORACLE_SQL) <= set(QUERIES)
