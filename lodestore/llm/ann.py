"""Approximate nearest neighbours by collision counting over single-projection sorted arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestore.llm.shared import small_batches, stash

#: Projections, each with a sorted array; and how many of them must hold a vector within the query's window.
PROJECTIONS, COLLISIONS = 60, 33
#: Windows reach STEP to both sides of the query's projection at first and grow by this ratio: virtual rehashing.
#: Projections of unit vectors have a standard deviation of 1.
STEP, RATIO = 0.3, 1.2
#: A query is done once so many vectors of a segment were verified and ...
LEAST_VERIFIED = 200
#: ... this part of the segment: the false positives that the collision threshold lets through.
VERIFIED_SHARE = 0.2
#: Distance of the sorted arrays when laid on one line; a unit vector's projection never comes near half of it.
APART = 256.0
#: Vectors of one index segment and queries of one broadcast block.
SEGMENT, QUERIES = 8192, 8192

_INDEX = "segment string, ids binary, vectors binary, values binary, order binary"


def _usable(vector) -> np.ndarray | None:
    """The vector in double precision; None if it is null, zero or holds a null or non-finite component."""
    if vector is None or any(x is None for x in vector):
        return None
    v = np.asarray(vector, dtype=np.float64)
    return v if len(v) and np.isfinite(v).all() and v.any() else None


def projections(dimension: int) -> np.ndarray:
    """The fixed Gaussian directions for vectors of a dimension."""
    return np.random.Generator(np.random.PCG64(1000 + dimension)).standard_normal((dimension, PROJECTIONS))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    held: dict[int, list[tuple[int, np.ndarray]]] = {}

    def packed(rows):
        nonlocal n
        ids = np.array([i for i, _ in rows], np.int64)
        vectors = np.stack([v for _, v in rows])
        values = (_unit(vectors) @ projections(vectors.shape[1])).T
        order = np.argsort(values, axis=1, kind="stable")
        n += 1
        parts = ids, vectors, np.take_along_axis(values, order, axis=1).astype(np.float32), order.astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([f"{part}-{n}"]), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["segment", "ids", "vectors", "values", "order"])

    for b in batches:
        for i, vector in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            v = _usable(vector)
            if v is not None and i is not None:
                rows = held.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) == SEGMENT:
                    yield packed(held.pop(len(v)))
    for rows in held.values():
        yield packed(rows)


def build_index(vectors: DataFrame) -> DataFrame:
    """The stored index of ``vectors(vec_id, embedding)``: every usable row, in segments with their sorted arrays."""
    small_batches(vectors.sparkSession)
    return stash(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_segments, _INDEX), "vectors")


def segment_search(query_ids, queries, ids, vectors, values, order, k: int) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, score): each query's k nearest verified vectors of one segment.

    Around a query's projections the windows grow round by round; only what a round adds is counted. Vectors that reach
    COLLISIONS are verified. A query ends when LEAST_VERIFIED and VERIFIED_SHARE of the segment were verified, or the
    windows hold everything.
    """
    n, out = len(ids), []
    enough = min(n, max(LEAST_VERIFIED, int(VERIFIED_SHARE * n)) + k)
    centres = _unit(queries) @ projections(vectors.shape[1])
    # all sorted arrays as one: array m holds the values around m * APART
    shift = np.arange(PROJECTIONS) * APART
    line, who = (values.astype(np.float64) + shift[:, None]).ravel(), order.ravel()
    squares = np.sqrt((vectors * vectors).sum(axis=1))
    for qid, query, centre in zip(query_ids, queries, centres + shift, strict=True):
        lo = hi = np.searchsorted(line, centre)
        counts, width = np.zeros(n, np.int64), STEP
        while True:
            low, high = np.searchsorted(line, np.concatenate([centre - width, centre + width])).reshape(2, -1)
            first, size = np.concatenate([low, hi]), np.concatenate([lo - low, high - hi])
            fresh = np.arange(size.sum()) + np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size)
            counts += np.bincount(who[fresh], minlength=n)
            lo, hi = low, high
            found = np.flatnonzero(counts >= COLLISIONS)
            if len(found) >= enough or len(found) == n:
                break
            width *= RATIO
        found = found[ids[found] != qid]
        score = (vectors[found] @ query) / squares[found] / np.sqrt(query @ query)
        best = np.lexsort((ids[found], -score))
        _, first = np.unique(ids[found][best], return_index=True)
        for j in best[np.sort(first)[:k]]:
            out.append((int(qid), int(ids[found[j]]), float(score[j])))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, query_rows: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row of ``queries(vec_id, embedding)`` by cosine.

    All rows of ``vectors(vec_id, embedding)`` but those with the query's own id are candidates, ties go to the smaller
    vec_id, scores are cosines of the original vectors in double precision. The search is approximate (see README for
    the measured recall); with k candidates or fewer it returns all.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids. Vectors of another
    length than the query's are no candidates. Repeated rows, asked or searched, count once; of several vectors
    of one vec_id the nearest counts. Empty tables give no rows. Queries are
    searched in blocks of about ``query_rows``, each against the same stored index; each task returns k rows a query.
    """
    spark = vectors.sparkSession
    index = build_index(vectors)
    small_batches(spark, 1)
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null").distinct()
    blocks = max(1, -(-asked.count() // query_rows))
    found = None
    for b in range(blocks):
        rows = (asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b) if blocks > 1 else asked).collect()
        by_size: dict[int, tuple[list[int], list[np.ndarray]]] = {}
        for r in rows:
            v = _usable(r["embedding"])
            if v is not None:
                ids, own = by_size.setdefault(len(v), ([], []))
                ids.append(r["vec_id"])
                own.append(v)
        shared = spark.sparkContext.broadcast({n: (np.array(ids), np.stack(own)) for n, (ids, own) in by_size.items()})
        part = index.mapInPandas(_search(shared, k), "query_id long, vec_id long, score double")
        part = stash(part, "near")
        found = part if found is None else found.union(part)
    small_batches(spark)
    # the k best so far of each task move, not all that its segments found
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(shared, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                ids = np.frombuffer(row["ids"], np.int64)
                vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
                values = np.frombuffer(row["values"], np.float32).reshape(PROJECTIONS, -1)
                order = np.frombuffer(row["order"], np.int32).reshape(PROJECTIONS, -1)
                asked = shared.value.get(vectors.shape[1])
                out = segment_search(*asked, ids, vectors, values, order, k) if asked else []
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run
